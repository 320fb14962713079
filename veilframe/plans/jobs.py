"""Jobs on governed data: routing, gate, evidence, dashboard, slices, column profile."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.policy import GovernancePolicy
from veilframe.plans.protect import scan_and_protect, with_spans
from veilframe.sources.commits import write_once

BLOCKED, ANONYMIZED, PASSED = "BLOCKED", "ANONYMIZED", "PASSED"


def tiered_route(
    df: DataFrame, text_col: str, id_cols: Sequence[str], *,
    policy: GovernancePolicy | None = None, **settings: Any,
) -> DataFrame:
    """PUBLIC and INTERNAL text passes, CONFIDENTIAL is rewritten, RESTRICTED is withheld.

    A text over the size limit was not looked at, so it is withheld as well.
    """
    out = scan_and_protect(
        df, text_col, id_cols, policy=policy, return_original=True, **settings
    )
    route = (
        F.when(F.col("error").isNotNull() | (F.col("classification") == "RESTRICTED"), BLOCKED)
        .when(F.col("classification") == "CONFIDENTIAL", ANONYMIZED)
        .otherwise(PASSED)
    )
    released = F.when(route == PASSED, F.col("original_text")).when(
        route == ANONYMIZED, F.col("protected_text")
    )
    return out.select(
        *[c for c in df.columns if c != text_col], "classification", "entity_types", "audit_id",
        "error", route.alias("route"), released.alias("released_text"),
    )


def write_routed(routed: DataFrame, path: str, run_id: str | None = None) -> bool:
    """One folder per route, so a consumer reads only what it may see; with ``run_id`` once per run, to be read with
    ``sources.commits.read_committed``.  True if rows were added."""
    if run_id is not None:
        return write_once(routed, path, run_id, lambda rows, folder: rows.write.partitionBy("route").parquet(folder))
    routed.write.mode("append").partitionBy("route").parquet(path)
    return True


def leak_gate(df: DataFrame, text_col: str, max_entities: int = 0, **settings: Any) -> DataFrame:
    """Per row: BLOCKED if more than ``max_entities`` entities (or not scanned), else CLEAN."""
    found = with_spans(df, text_col, **settings).withColumn("entities_found", F.expr("size(spans)"))
    unsafe = F.col("error").isNotNull() | (F.col("entities_found") > max_entities)
    return found.select(
        *[c for c in df.columns if c != text_col], "entities_found",
        F.when(unsafe, BLOCKED).otherwise("CLEAN").alias("verdict"),
    )


def gate_summary(verdicts: DataFrame) -> DataFrame:
    """One row for the whole corpus: BLOCKED if any row is."""
    blocked = F.count_if(F.col("verdict") == BLOCKED)
    return verdicts.agg(
        F.count(F.lit(1)).alias("texts"),
        blocked.alias("blocked"),
        F.coalesce(F.sum("entities_found"), F.lit(0)).alias("entities"),
        F.when(blocked > 0, BLOCKED).otherwise("CLEAN").alias("verdict"),
    )


def compliance_evidence(audit: DataFrame, window: str = "7 days") -> DataFrame:
    """Audit counts per time window, action and classification."""
    grouped = audit.groupBy(F.window("ts", window).alias("w"), "action", "classification")
    return grouped.agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("entities_found").alias("entities_found"),
        F.sum("entities_anonymized").alias("entities_anonymized"),
    ).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "action",
        "classification", "records", "entities_found", "entities_anonymized",
    )


def type_counts(spanned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per input row and entity type with its span count.

    Counting inside the row first means the later group-by needs no distinct count, and only one
    small record per row and type reaches the shuffle.
    """
    counted = F.expr(
        "transform(array_distinct(transform(spans, s -> s.entity_type)), t -> struct(t as "
        "entity_type, size(filter(spans, s -> s.entity_type = t)) as n))"
    )
    return spanned.select(*keys, F.explode(counted).alias("c")).select(*keys, "c.*")


def dashboard(
    df: DataFrame, text_col: str, group_col: str, *, totals: bool = True, **settings: Any
) -> DataFrame:
    """Entities and affected rows per ``group_col`` and entity type.

    ``totals`` adds the totals of each group and of all: ``level`` is 0 for a group and type, 1 for
    a group, 2 for all, so a group that is NULL is not taken for a total.  ``level`` 3 counts per group
    the texts that a size limit kept from being read (``rows_affected``).
    """
    spanned = with_spans(df, text_col, **settings)
    facts = [
        "transform(array_distinct(transform(spans, s -> s.entity_type)), t -> "
        f"{_fact(0, '_group', 't', 'size(filter(spans, s -> s.entity_type = t))')})"
    ]
    if totals:
        each = f"array({_fact(1, '_group', 'null', 'size(spans)')}, {_fact(2, 'null', 'null', 'size(spans)')})"
        facts.append(f"if(size(spans) > 0, {each}, {_NO_FACTS})")
    if settings.get("max_chars"):
        facts.append(f"if(error is not null, array({_fact(3, '_group', 'null', '0')}), {_NO_FACTS})")
    # All records of a row come from one explode over its spans, so the text is scanned once.
    rows = spanned.select(F.col(group_col).alias("_group"), "spans", "error").select(
        "_group", F.expr(f"explode(flatten(filter(array({', '.join(facts)}), f -> f is not null)))").alias("f"))
    grouped = rows.select(
        F.when(F.col("f.grouped"), F.col("_group")).alias(group_col), F.col("f.entity_type").alias("entity_type"),
        F.col("f.level").alias("level"), F.col("f.n").alias("n")
    ).groupBy(group_col, "entity_type", "level")
    return grouped.agg(F.sum("n").alias("entities"), F.count(F.lit(1)).alias("rows_affected"))


_FACT = "struct<level:int,grouped:boolean,entity_type:string,n:int>"
_NO_FACTS = f"cast(array() as array<{_FACT}>)"


def _fact(level: int, group: str, entity_type: str, n: str) -> str:
    return (
        f"struct({level} as level, {'false' if group == 'null' else 'true'} as grouped, "
        f"cast({entity_type} as string) as entity_type, {n} as n)"
    )


def classification_counts(governed: DataFrame, group_col: str) -> DataFrame:
    """Rows and entities per group and classification."""
    return governed.groupBy(group_col, "classification").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("entities_found").alias("entities")
    )


def labelled_slices(
    governed: DataFrame, labels: DataFrame, key: str, slice_cols: Sequence[str]
) -> DataFrame:
    """Classification counts per label slice; only three narrow columns enter the join."""
    narrow = governed.select(key, "classification", "entities_found")
    joined = narrow.join(labels.select(key, *slice_cols), key, "left")
    return joined.groupBy(*slice_cols, "classification").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("entities_found").alias("entities")
    )


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, **settings: Any) -> DataFrame:
    """Which string columns of a table hold which entity types: values affected and spans.

    With ``max_chars``, values over the limit are counted under the entity type NULL."""
    texts = list(columns or [f.name for f in df.schema if f.dataType.simpleString() == "string"])
    values = df.select(*texts).unpivot([], texts, "column_name", "value").where("value is not null")
    spanned = with_spans(values, "value", **settings)
    counts = type_counts(spanned, ["column_name"])
    if settings.get("max_chars"):
        counts = counts.unionByName(spanned.where("error is not null").select(
            "column_name", F.lit(None).cast("string").alias("entity_type"), F.lit(0).alias("n")))
    return counts.groupBy("column_name", "entity_type").agg(
        F.count(F.lit(1)).alias("values_affected"), F.sum("n").alias("entities")
    )
