"""The audit table: rows from governed data, export shape, queries and retention.

Stored audit data is partitioned by ``date`` and ``action``, so the usual queries read only the
partitions they name.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.sqltext import lit
from veilframe.operators.policy import GovernancePolicy
from veilframe.plans.protect import AUDIT_DDL, audit_id_sql, now_iso, utc_timestamp
from veilframe.session import remove_folder, shared_folder
from veilframe.sources.commits import read_committed, write_once


def audit_rows(governed: DataFrame) -> DataFrame:
    """One row per record of a call made ``with_audit``; refused texts leave none."""
    return governed.where("audit is not null").select("audit.*")


def policy_change_row(
    spark: SparkSession, old: GovernancePolicy, new: GovernancePolicy, batch_ts: str | None = None
) -> DataFrame:
    """The record of a policy replacement: always RESTRICTED, with the previous name and version."""
    ts = batch_ts or now_iso()
    values = {
        "audit_id": audit_id_sql("policy_change", (), new, lit(f"{ts}|{old.name}|{old.version}")),
        "ts": utc_timestamp(ts),
        "action": "'policy_change'",
        "classification": "'RESTRICTED'",
        "entities_found": "0",
        "entity_types": "array()",
        "entities_anonymized": "0",
        "operators_used": "map()",
        "policy_name": lit(new.name),
        "policy_version": lit(new.version),
        "text_length": "0",
        "anonymized_text": "null",
        "metadata": (
            f"map('previous_policy', {lit(old.name)}, 'previous_version', {lit(old.version)})"
        ),
    }
    kinds = dict(part.split(" ", 1) for part in AUDIT_DDL.split(", "))
    columns = [f"cast({sql} as {kinds[name]}) as {name}" for name, sql in values.items()]
    return spark.range(1).selectExpr(*columns)


def set_policy(
    spark: SparkSession, old: GovernancePolicy, config: dict, batch_ts: str | None = None
) -> tuple[GovernancePolicy, DataFrame]:
    """A new policy from a mapping, and the audit row to append."""
    if not config:
        raise ValueError("a policy configuration is required")
    new = GovernancePolicy.from_mapping(config)
    return new, policy_change_row(spark, old, new, batch_ts)


HISTORY_DDL = "batch_id bigint, ts timestamp, name string, version string, config string"


def policy_history_row(spark: SparkSession, policy: GovernancePolicy, batch_id: int, batch_ts: str) -> DataFrame:
    """The policy in force in a batch, whole, as one row of the history table."""
    row = spark.createDataFrame(
        [(batch_id, policy.name, policy.version, json.dumps(policy.as_dict()))],
        "batch_id bigint, name string, version string, config string")
    return row.select("batch_id", F.expr(utc_timestamp(batch_ts)).alias("ts"), "name", "version", "config")


def policies_until(spark: SparkSession, path: str, batch_id: int) -> list[tuple[int, GovernancePolicy]]:
    """The policies of ``batch_id`` and of the last batch before it, as far as the history has them."""
    try:
        history = spark.read.schema(HISTORY_DDL).option("recursiveFileLookup", "true").parquet(path)
        rows = history.where(F.col("batch_id") <= batch_id).orderBy(F.desc("batch_id")).limit(2).collect()
    except AnalysisException as problem:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return []
    return [(r["batch_id"], GovernancePolicy.from_dict(json.loads(r["config"]))) for r in rows]


def utc_date(ts: Column) -> Column:
    """The day of a timestamp in UTC: writers and readers in different zones name the same partition."""
    return F.to_date(F.to_utc_timestamp(ts, F.current_timezone()))


def export_columns(audit: DataFrame) -> DataFrame:
    """The exported fields: all but the rewritten text."""
    return audit.drop("anonymized_text").withColumnRenamed("ts", "timestamp")


def filter_audit(
    audit: DataFrame,
    since: str | None = None,
    action_type: str | None = None,
    classification: str | None = None,
) -> DataFrame:
    """Records at or after ``since`` with the given action and classification; empty means any."""
    if since:
        audit = audit.where(F.col("ts") >= F.lit(since).cast("timestamp"))
        if "date" in audit.columns:
            audit = audit.where(F.col("date") >= utc_date(F.lit(since).cast("timestamp")))
    if action_type:
        audit = audit.where(F.col("action") == action_type)
    if classification:
        audit = audit.where(F.col("classification") == classification)
    return audit


def newest(audit: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` newest records, newest first (a per-task top-k, then one merge)."""
    return audit.orderBy(F.desc("ts"), F.desc("audit_id")).limit(limit)


def query_audit(
    audit: DataFrame,
    limit: int = 50,
    since: str | None = None,
    action_type: str | None = None,
    classification: str | None = None,
) -> DataFrame:
    """The newest ``limit`` matching records in export shape."""
    return export_columns(newest(filter_audit(audit, since, action_type, classification), limit))


def audit_totals(audit: DataFrame, limit: int = 50, **filters: str | None) -> DataFrame:
    """``total_records`` (unfiltered) and ``returned`` (after filter and limit) in one scan."""
    conditions = F.lit(True)
    if filters.get("since"):
        conditions &= F.col("ts") >= F.lit(filters["since"]).cast("timestamp")
    if filters.get("action_type"):
        conditions &= F.col("action") == filters["action_type"]
    if filters.get("classification"):
        conditions &= F.col("classification") == filters["classification"]
    return audit.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.least(F.count_if(conditions), F.lit(limit).cast("bigint")).alias("returned"),
    )


def retain_newest(audit: DataFrame, max_records: int = 10_000, within_task: int = 100_000) -> DataFrame:
    """Bounded retention: the newest ``max_records`` records, by time and then by id.

    Up to ``within_task`` records this is a top-k.  Beyond, the record with which the number is reached is searched in the
    records' keys, which are written first: counts per stretch of time narrow the stretch it lies in, then counts
    per next character of the id.  A step sends the driver a few thousand counts at most; no step orders records, and no task holds more
    than ``within_task`` of them, however many share one time.
    """
    if max_records <= within_task:
        return newest(audit, max_records)
    spark = audit.sparkSession
    folder = shared_folder(spark, "audit-keys")
    audit.select(F.unix_micros("ts").alias("at"), F.col("audit_id").alias("id")).write.parquet(folder)
    keys = spark.read.schema("at bigint, id string").parquet(folder)
    try:
        cut = _cut_key(keys, max_records, within_task)
    finally:
        remove_folder(spark, folder)
    if cut is None:
        return audit
    at, key, ties = cut
    micros, id_ = F.unix_micros("ts"), F.col("audit_id")
    if at is None:  # among the records without a time
        same = micros.isNull()
        newer = micros.isNotNull()
    else:
        same = micros == F.lit(at)
        newer = micros > F.lit(at)
    after = id_.isNotNull() if key is None else id_ > F.lit(key)
    equal = id_.isNull() if key is None else id_ == F.lit(key)
    # Records of one key are alike in order, so any of them will do.
    return audit.where(newer | (same & after)).unionByName(audit.where(same & equal).limit(ties))


_STRETCHES = 4096


def _cut_key(keys: DataFrame, wanted: int, within_task: int) -> tuple[int | None, str | None, int] | None:
    """(time, id, how many of that key stay) of the ``wanted``-th newest record; None if there are no more.

    Records without a time are the oldest, those without an id the last of their time.
    """
    ends = keys.agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).first()
    if ends["n"] <= wanted:
        return None
    low, high, left = ends["low"], ends["high"], wanted
    timed = keys.where("at is not null")
    at: int | None = None
    inside = keys.where("at is null")
    while low is not None:
        width = max(1, -(-(high - low + 1) // _STRETCHES))
        here = timed.where((F.col("at") >= low) & (F.col("at") <= high))
        rows = here.groupBy(F.floor((F.col("at") - F.lit(low)) / F.lit(width)).cast("bigint").alias("k")).count().collect()
        found = _reached({r["k"]: r["count"] for r in rows}, left)
        if found is None:  # only records without a time are left
            left -= sum(r["count"] for r in rows)
            break
        k, left, n = found
        low, high = low + k * width, min(high, low + (k + 1) * width - 1)
        inside = timed.where((F.col("at") >= low) & (F.col("at") <= high))
        if low == high:
            at = low
            break
        if n <= within_task:
            row = inside.orderBy(F.desc("at"), F.desc("id")).limit(left).collect()[-1]
            return _ties(inside, row["at"], row["id"], left)
    return _cut_id(inside, at, left, within_task)


def _reached(counts: dict, wanted: int) -> tuple[Any, int, int] | None:
    """The group, from the largest key on, in which the number is reached, how many of it are wanted, and its size."""
    for k in sorted(counts, reverse=True):
        if wanted <= counts[k]:
            return k, wanted, counts[k]
        wanted -= counts[k]
    return None


def _cut_id(inside: DataFrame, at: int | None, left: int, within_task: int) -> tuple[int | None, str | None, int]:
    """The same among records of one time: ids are ordered by their bytes, character by character."""
    start, named = "", inside.where("id is not null")
    while True:
        here = named.where(F.col("id").startswith(start)) if start else named
        rows = here.groupBy(F.substring("id", len(start) + 1, 1).alias("c")).count().collect()
        found = _reached({r["c"]: r["count"] for r in rows}, left)
        if found is None:
            return at, None, left - sum(r["count"] for r in rows)
        c, left, n = found
        if not c:  # the id ends here
            return at, start, left
        start += c
        if n <= within_task:
            ids = named.where(F.col("id").startswith(start)).orderBy(F.desc("id")).limit(left).collect()
            return _ties(named, at, ids[-1]["id"], left, start)


def _ties(inside: DataFrame, at: int | None, key: str | None, left: int, start: str | None = None) -> tuple[int | None, str | None, int]:
    """How many records of the last key stay: those wanted, less the ones before that key."""
    before = F.col("id") > F.lit(key) if key is not None else F.col("id").isNotNull()
    if start is None:
        before = (F.col("at") > F.lit(at)) | ((F.col("at") == F.lit(at)) & before)
    else:
        before &= F.col("id").startswith(start)
    return at, key, left - inside.where(before).count()


def write_audit(audit: DataFrame, path: str, run_id: str | None = None) -> bool:
    """Append to the audit table at ``path``; with ``run_id`` once, however often the run is repeated.

    True if rows were added.
    """
    dated = audit.withColumn("date", utc_date(F.col("ts")))
    if run_id is not None:
        return write_once(dated, path, run_id, lambda rows, folder: rows.write.partitionBy("date", "action").parquet(folder))
    dated.write.mode("append").partitionBy("date", "action").parquet(path)
    return True


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The table: appended records, and those of committed runs."""
    return read_committed(spark, path, f"{AUDIT_DDL}, date date")
