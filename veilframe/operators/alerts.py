"""Alert rules compiled to expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from veilframe.functions.sqltext import lit
from veilframe.operators.policy import AlertRule

ALERT_TYPE = "struct<name:string,action:string,level:string,webhook_url:string>"
RULE_SCHEMA = (
    "rule_no int, name string, condition string, action string, level string, "
    "webhook_url string, on_classification string, above_count int"
)


def condition_sql(rule: AlertRule, classification: str, entities_found: str) -> str | None:
    """The rule as a boolean expression, or None if its condition is not understood."""
    parsed = rule.parsed()
    if parsed is None:
        return None
    field, bound = parsed
    if field == "classification":
        return f"{classification} = {lit(bound)}"
    return f"{entities_found} > {bound}"


def alerts_sql(rules: Iterable[AlertRule], classification: str, entities_found: str) -> str:
    """Array of the alerts a row triggers, in rule order."""
    parts = []
    for rule in rules:
        fires = condition_sql(rule, classification, entities_found)
        if fires is None:
            continue
        alert = (
            f"struct({lit(rule.name)} as name, {lit(rule.action)} as action, "
            f"{lit(rule.level)} as level, {lit(rule.webhook_url or '')} as webhook_url)"
        )
        parts.append(f"if({fires}, {alert}, cast(null as {ALERT_TYPE}))")
    if not parts:
        return f"cast(array() as array<{ALERT_TYPE}>)"
    return f"filter(array({', '.join(parts)}), a -> a is not null)"


def rules_df(spark: SparkSession, rules: Iterable[AlertRule]) -> DataFrame:
    """The rules as a table: one row each, with the parsed condition in two columns."""
    rows = []
    for i, rule in enumerate(rules):
        field, bound = rule.parsed() or (None, None)
        rows.append((
            i, rule.name, rule.condition, rule.action, rule.level, rule.webhook_url or "",
            bound if field == "classification" else None,
            bound if field == "entities_found" else None,
        ))
    return spark.createDataFrame(rows, RULE_SCHEMA)
