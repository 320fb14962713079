"""Audit and alert sinks.  A sink has ``write(df)``; ``fan_out`` feeds several of them."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from veilframe.plans.audit import export_columns
from veilframe.session import remove_folder, shared_folder
from veilframe.sources.commits import CommitLog, read_committed, write_once

log = logging.getLogger(__name__)


class Sink(Protocol):
    """Where audit rows go.  ``query`` is for sinks that can be read back."""

    def write(self, audit: DataFrame) -> None: ...


@runtime_checkable
class RunSink(Sink, Protocol):
    """A sink that takes the rows of a run once, however often the run is repeated."""

    def write_run(self, audit: DataFrame, run_id: str) -> bool: ...

    def has_run(self, spark: SparkSession, run_id: str) -> bool: ...


class JsonLinesSink:
    """Appends one JSON object per record under ``path``."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, audit: DataFrame) -> None:
        export_columns(audit).write.mode("append").json(self.path)

    def write_run(self, audit: DataFrame, run_id: str) -> bool:
        return write_once(export_columns(audit), self.path, run_id, lambda rows, folder: rows.write.json(folder))

    def has_run(self, spark: SparkSession, run_id: str) -> bool:
        return CommitLog(spark, self.path).committed(run_id)

    def query(self, audit: DataFrame) -> DataFrame:
        """The stored records, of committed runs only, read with the schema of ``audit``."""
        return read_committed(audit.sparkSession, self.path, export_columns(audit).schema, "json")


def console_columns(audit: DataFrame) -> DataFrame:
    """The fields the console shows."""
    return audit.select(
        "audit_id", "action", "classification", "entities_found", "entities_anonymized"
    )


def print_lines(rows: Iterator[Row]) -> None:
    """Print the lines of one partition where its task runs."""
    for row in rows:
        print(row["line"], flush=True)


class ConsoleSink:
    """Prints every record as one line.  The tasks print, each its own partition, so nothing passes the driver; on a
    cluster the lines are in the executors' logs.  ``emit`` may put another printer in place."""

    def __init__(self, level: str = "INFO", emit: Callable[[Iterator[Row]], None] = print_lines) -> None:
        self.level, self.emit = level.upper(), emit

    def lines(self, audit: DataFrame) -> DataFrame:
        """The column ``line``: the level, then name=value for each field; NULL shows as None."""
        shown = console_columns(audit)
        fields = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in shown.columns]
        return shown.select(F.concat_ws(" ", F.lit(self.level), *fields).alias("line"))

    def write(self, audit: DataFrame) -> None:
        self.lines(audit).foreachPartition(self.emit)


def outbox_rows(governed: DataFrame, id_cols: Iterable[str]) -> DataFrame:
    """One row per triggered ``webhook`` alert with an address, for a sender to pick up."""
    keys = list(id_cols)
    alerts = governed.select(
        *keys, "audit_id", "classification", "entities_found",
        F.explode("alerts_triggered").alias("a"),
    )
    return alerts.select(
        "a.webhook_url", F.col("a.name").alias("rule"), F.col("a.level").alias("level"), "a.action",
        *keys, "audit_id", "classification", "entities_found",
    ).where("action = 'webhook' and webhook_url <> ''").drop("action")


class OutboxSink:
    """Appends records addressed to ``url`` to a table partitioned by a digest of the address.

    An address may hold a token, so it is a column of the files and no part of their names.
    """

    def __init__(self, url: str, path: str) -> None:
        self.url, self.path = url, path

    def rows(self, audit: DataFrame) -> DataFrame:
        rows = export_columns(audit).withColumn("webhook_url", F.lit(self.url))
        return rows.withColumn("target", F.substring(F.sha2("webhook_url", 256), 1, 16))

    def write(self, audit: DataFrame) -> None:
        self.rows(audit).write.mode("append").partitionBy("target").parquet(self.path)

    def write_run(self, audit: DataFrame, run_id: str) -> bool:
        # Several addresses may share a path, and each has runs of its own.
        return write_once(self.rows(audit), self.path, self._own(run_id),
                          lambda rows, folder: rows.write.partitionBy("target").parquet(folder))

    def has_run(self, spark: SparkSession, run_id: str) -> bool:
        return CommitLog(spark, self.path).committed(self._own(run_id))

    def _own(self, run_id: str) -> str:
        return f"{hashlib.sha256(self.url.encode()).hexdigest()[:16]} {run_id}"

    def query(self, audit: DataFrame) -> DataFrame:
        """The stored records of all addresses, of committed runs only."""
        return read_committed(audit.sparkSession, self.path, self.rows(audit).schema)


def sinks_from_policy(configs: Iterable[Mapping[str, Any]]) -> list[Sink]:
    """Sinks for ``file``, ``stdout`` and ``outbox`` entries; any other type is ignored."""
    sinks: list[Sink] = []
    for config in configs:
        kind = config.get("type", "stdout")
        if kind == "file":
            sinks.append(JsonLinesSink(config["path"]))
        elif kind == "stdout":
            sinks.append(ConsoleSink(config.get("level", "INFO")))
        elif kind == "outbox":
            sinks.append(OutboxSink(config["url"], config["path"]))
    return sinks


def fan_out(audit: DataFrame, sinks: Iterable[Sink], staging: str | None = None, run_id: str | None = None) -> list[str]:
    """Write ``audit`` to every sink; one that fails is logged and does not stop the others.

    The rows are written once to a staging table and every sink reads that, so the texts are
    scanned once however many sinks there are and whichever executors are lost meanwhile.
    Returns the class names of the sinks that failed.  The staging table is removed at the end.

    With ``run_id`` a repeated run, after whatever fault, adds nothing to sinks that it has committed to; if these are all,
    nothing is computed.  Sinks that know no runs are written every time.
    """
    spark = audit.sparkSession
    if run_id is not None:
        sinks = [s for s in sinks if not isinstance(s, RunSink) or not s.has_run(spark, run_id)]
        if not sinks:
            return []
    folder = staging or shared_folder(spark, "audit-staging")
    failed = []
    try:
        audit.write.mode("overwrite").parquet(folder)
        staged = spark.read.schema(audit.schema).parquet(folder)
        for sink in sinks:
            try:
                if run_id is not None and isinstance(sink, RunSink):
                    sink.write_run(staged, run_id)
                else:
                    sink.write(staged)
            except Exception:
                log.exception("audit sink failed: %s", type(sink).__name__)
                failed.append(type(sink).__name__)
    finally:
        remove_folder(spark, folder)
    return failed
