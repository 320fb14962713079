"""Policies in a table: which one was in force when, and what a change of policy changes.

The table has a row per version with the time from which it holds.  Versions are few, so the driver reads them; rows
find theirs by their own event time inside an expression, without a join or a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.sqltext import ident, lit, lits
from veilframe.operators import classify as cls
from veilframe.operators.policy import GovernancePolicy
from veilframe.plans.protect import utc_timestamp

POLICY_DDL = "valid_from timestamp, name string, version string, config string"


@dataclass(frozen=True)
class Version:
    """A policy and the time (UTC, as text) from which it is in force."""

    valid_from: str
    policy: GovernancePolicy


def version_row(spark: SparkSession, policy: GovernancePolicy, valid_from: str) -> DataFrame:
    """The row that puts a policy in force; append it to the table."""
    row = spark.createDataFrame([(policy.name, policy.version, json.dumps(policy.as_dict()))], "name string, version string, config string")
    return row.select(F.expr(utc_timestamp(valid_from)).alias("valid_from"), "*")


def versions(table: DataFrame) -> list[Version]:
    """The versions, oldest first.  Of several from one time on, the last by version counts."""
    stamp = F.date_format(F.to_utc_timestamp("valid_from", F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    rows = table.select(stamp.alias("at"), "version", "config").orderBy("valid_from", "version").collect()
    latest = {r["at"]: r["config"] for r in rows}
    return [Version(at, GovernancePolicy.from_dict(json.loads(config))) for at, config in latest.items()]


def in_force(ts_col: str, listed: Sequence[Version]) -> str:
    """SQL text: the number of the version in force at the row's time, -1 before the first; NULL without a time."""
    starts = ", ".join(utc_timestamp(v.valid_from) for v in listed)
    at = f"cast({ident(ts_col)} as timestamp)"
    return f"if({at} is null, null, size(filter(array({starts}), v -> v <= {at})) - 1)"


def with_policy_as_of(df: DataFrame, listed: Sequence[Version], ts_col: str = "ts", types_col: str = "entity_types") -> DataFrame:
    """Adds ``policy_name``, ``policy_version`` and ``classification`` by the policy in force at each row's time.

    Rows before the first version, and rows without a time, get NULL.  Columns of these names are replaced.
    """
    if not listed:
        raise ValueError("the policy table is empty")
    numbered = df.withColumn("_version", F.expr(in_force(ts_col, listed)))

    def by_version(values: list[str]) -> str:
        branches: dict[str, list[int]] = {}
        for k, value in enumerate(values):
            branches.setdefault(value, []).append(k)
        whens = " ".join(f"when _version in ({', '.join(map(str, ks))}) then {value}" for value, ks in branches.items())
        return f"case {whens} end"

    types = ident(types_col)
    return numbered.withColumns({
        "policy_name": F.expr(by_version([lit(v.policy.name) for v in listed])),
        "policy_version": F.expr(by_version([lit(v.policy.version) for v in listed])),
        "classification": F.expr(by_version([cls.classification(types, v.policy) for v in listed])),
    }).drop("_version")


def changed_types(old: GovernancePolicy, new: GovernancePolicy) -> list[str]:
    """The entity types whose level differs between two policies."""
    return sorted(t for t in {*old.known_types(), *new.known_types()} if old.sensitivity_of(t) != new.sensitivity_of(t))


def reclassified(audit: DataFrame, old: GovernancePolicy, new: GovernancePolicy, types_col: str = "entity_types") -> DataFrame:
    """The audit rows whose classification a change of policy changes: their columns with the new ``classification``,
    ``policy_name`` and ``policy_version``, and ``previous_classification``.

    Only rows that hold a type whose level differs are classified again; the others are filtered at the scan.
    """
    types, changed = ident(types_col), changed_types(old, new)
    if not changed:
        return audit.where("false").withColumn("previous_classification", F.col("classification"))
    touched = audit.where(F.expr(f"arrays_overlap({types}, array({lits(changed)}))"))
    again = touched.withColumn("previous_classification", F.col("classification")).withColumn(
        "classification", F.expr(cls.classification(types, new)))
    return again.where("classification <> previous_classification or previous_classification is null").withColumns(
        {"policy_name": F.lit(new.name), "policy_version": F.lit(new.version)})
