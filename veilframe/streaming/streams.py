"""The same transforms on streams, plus the stateful parts: windows, deduplication, policy swaps."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from veilframe.operators.policy import GovernancePolicy
from veilframe.plans.audit import policies_until, policy_change_row, policy_history_row
from veilframe.plans.protect import scan_and_protect


def read_stream(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options: Any
) -> DataFrame:
    """A stream of the files that appear under ``path``."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def table_stream(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options: Any
) -> DataFrame:
    """A stream of one table, which is a file or a folder of files.

    A plain path to a stream must be a folder; a pattern may match either, so the last letter is written as one.
    """
    path = path.rstrip("/")
    return read_stream(spark, f"{path[:-1]}[{path[-1]}]", schema, fmt, **options)


def protect_stream(
    stream: DataFrame, text_col: str, id_cols: Sequence[str], **settings: Any
) -> DataFrame:
    """Stateless protection: the batch transform, row by row.

    Audit records carry the time of their micro-batch, or of ``ts_col`` where given, never that of
    the query's start.
    """
    return scan_and_protect(stream, text_col, id_cols, **settings)


def to_files(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> DataStreamWriter:
    """Exactly-once files; ``checkpoint`` must be a shared folder."""
    return (
        stream.writeStream.format(fmt)
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def windowed_counts(
    audit: DataFrame, window: str = "1 hour", slide: str | None = None,
    watermark: str = "10 minutes",
) -> DataFrame:
    """Audit counts per event-time window, action and classification.

    Rows later than the watermark are dropped, which bounds the state to the open windows.
    """
    if audit.isStreaming:
        audit = audit.withWatermark("ts", watermark)
    grouped = audit.groupBy(
        F.window("ts", window, slide or window).alias("w"), "action", "classification"
    )
    return grouped.agg(
        F.count(F.lit(1)).alias("records"), F.sum("entities_found").alias("entities_found")
    ).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "action",
        "classification", "records", "entities_found",
    )


def alert_rows(governed: DataFrame, id_cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per triggered alert."""
    alerts = governed.select(
        *id_cols, *keep, "audit_id", "classification", "entities_found",
        F.explode("alerts_triggered").alias("a"),
    )
    return alerts.select(
        *id_cols, *keep, "audit_id", "classification", "entities_found",
        F.col("a.name").alias("rule"), F.col("a.action").alias("action"),
        F.col("a.level").alias("level"), F.col("a.webhook_url").alias("webhook_url"),
    )


def alert_stream(
    governed: DataFrame, id_cols: Sequence[str], ts_col: str, watermark: str = "10 minutes"
) -> DataFrame:
    """Alerts with repeats of one record removed while the watermark holds it.

    The key is the input key and the rule, not the short audit id, which may collide at scale.
    """
    alerts = alert_rows(governed, id_cols, [ts_col])
    if not alerts.isStreaming:
        return alerts.dropDuplicates([*id_cols, "rule"])
    return alerts.withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark(
        [*id_cols, "rule"]
    )


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that may be retried: each batch owns one folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def hot_swap(
    load: Callable[[], GovernancePolicy],
    text_col: str,
    id_cols: Sequence[str],
    out_path: str,
    audit_path: str,
    batch_ts: Callable[[int], str],
    initial: GovernancePolicy | None = None,
    history_path: str | None = None,
    **settings: Any,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that reloads the policy for every micro-batch.

    When it differs from that of the previous batch, a ``policy_change`` row is written first.  All
    output of a batch lies in folders of its own, so a retried batch overwrites itself.  With
    ``history_path`` the policy of every batch is kept there: a retried batch uses the policy of its
    first try and a restarted query knows the one before.  Without it, ``initial`` is the policy in force
    before the first batch of this run.
    """
    state = {"policy": initial} if initial else {}

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ts = batch_ts(batch_id)
        if history_path:
            known = {b: p for b, p in policies_until(spark, history_path, batch_id)}
            policy = known.pop(batch_id, None) or load()
            previous = known[max(known)] if known else (initial or policy)
            policy_history_row(spark, policy, batch_id, ts).write.mode("overwrite").parquet(f"{history_path}/batch={batch_id}")
        else:
            policy = load()
            previous = state.get("policy", policy)
        if policy != previous:
            change = policy_change_row(spark, previous, policy, ts)
            change.write.mode("overwrite").parquet(f"{audit_path}/batch={batch_id}")
        out = scan_and_protect(
            batch, text_col, id_cols, policy=policy, batch_ts=ts, **settings
        ).withColumn("policy_version", F.lit(policy.version))
        out.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        state["policy"] = policy

    return run
