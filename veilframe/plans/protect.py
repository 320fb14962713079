"""The four governance calls as DataFrame transforms.

Each adds columns to the rows it is given: no shuffle, no join, no Python on the rows.  Spans are
computed once per row in a projection of their own, and everything else is derived from them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import spans as sp
from veilframe.functions.sqltext import ident, lit
from veilframe.functions.text import DEFAULT_MAX_CHARS, size_error
from veilframe.operators import alerts, anonymize as anon, classify as cls, gazetteer
from veilframe.operators.detect import spans_sql
from veilframe.operators.overlaps import settled
from veilframe.operators.policy import GovernancePolicy
from veilframe.operators.recognizers import RecognizerRegistry
from veilframe.plans.span_tables import collect_spans, term_spans

# A caller's own detector: text column in, span-array column out.
Detector = Callable[[Column], Column]

AUDIT_DDL = (
    "audit_id string, ts timestamp, action string, classification string, entities_found int, "
    "entity_types array<string>, entities_anonymized int, operators_used map<string,string>, "
    "policy_name string, policy_version string, text_length int, anonymized_text string, "
    "metadata map<string,string>"
)


def now_iso() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")


def utc_timestamp(ts: str) -> str:
    """A timestamp literal; a text without a zone is meant in UTC, whatever the session's zone."""
    zoned = ts if re.search(r"(Z|UTC|[+-][0-9]{2}:?[0-9]{2})$", ts) else f"{ts}+00:00"
    return f"timestamp {lit(zoned)}"


@dataclass(frozen=True)
class AuditTime:
    """When a record was made: one time for all rows of a batch, or a time per row."""

    sql: str  # a timestamp
    text: str  # the same as text, for the record's id

    @classmethod
    def of(cls, df: DataFrame, batch_ts: str | None, ts_col: str | None) -> AuditTime:
        """``ts_col`` names an event-time column.  Without it a batch has the time given or that of the
        call, and a stream that of each micro-batch, which a retried micro-batch repeats."""
        if ts_col is not None:
            return cls(f"cast({ident(ts_col)} as timestamp)", f"coalesce(cast(unix_micros(cast({ident(ts_col)} as timestamp)) as string), '')")
        if batch_ts is None and df.isStreaming:
            return cls("current_timestamp()", "cast(unix_micros(current_timestamp()) as string)")
        ts = batch_ts or now_iso()
        return cls(utc_timestamp(ts), lit(ts))


def record_key_sql(id_cols: Sequence[str]) -> str:
    """The row's key as one text that no other key shares: NULL and separators inside are told apart."""
    if len(id_cols) == 1:
        return f"coalesce(cast({ident(id_cols[0])} as string), '')"
    values = ", ".join(f"cast({ident(c)} as string)" for c in id_cols)
    return f"to_json(array({values}))" if id_cols else "''"


def audit_id_sql(action: str, id_cols: Sequence[str], policy: GovernancePolicy, ts: str) -> str:
    """Twelve hex digits from what makes the record unique, so a retried task repeats them.

    At many billions of records short ids do meet; ``metadata['record_key']`` holds the key itself.
    """
    return (
        f"substring(sha2(concat_ws('|', {lit(action)}, {record_key_sql(id_cols)}, {lit(policy.name)}, "
        f"{lit(policy.version)}, {ts}), 256), 1, 12)"
    )


#: Names the calls use for what they work out.
_OWN = frozenset({
    "spans", "error", "entity_types", "entities_found", "audit_id", "classification", "audit",
    "operators_applied", "_rewritten", "_scores", "_found",
})


def _checked(df: DataFrame, text_col: str, id_cols: Sequence[str], results: Sequence[str], with_audit: bool) -> list[str]:
    """The columns to hand through; refuses input columns that a result would hide."""
    keep = [c for c in df.columns if c != text_col]
    taken = sorted({c for c in df.columns if c in _OWN or c in results or c.startswith("_detector_")})
    if taken:
        raise ValueError(f"the input has columns named like results: {', '.join(taken)}; rename them first")
    if with_audit and not id_cols:
        raise ValueError("audit records need id_cols, the columns that tell one row from another")
    return keep


def with_spans(
    df: DataFrame,
    text_col: str = "text",
    *,
    registry: RecognizerRegistry | None = None,
    entities: Iterable[str] | None = None,
    language: str | None = "en",
    language_col: str | None = None,
    score_threshold: float = 0.4,
    max_chars: int = DEFAULT_MAX_CHARS,
    detectors: Sequence[Detector] = (),
    spans: DataFrame | None = None,
    names: DataFrame | None = None,
    id_cols: Sequence[str] = (),
    gated: bool = True,
    resolve: bool = True,
) -> DataFrame:
    """Add ``error`` (text over the size limit) and ``spans`` (NULL where there is an error).

    ``spans`` is a table of spans found elsewhere (a term list, long texts section by section), joined by
    ``id_cols``, which must identify a text; its spans are settled together with those found here.  With
    ``registry=RecognizerRegistry(())`` they are the only ones.  Rows whose key is NULL get none.

    ``names`` is a table of names (term, entity_type): its types, PERSON and LOCATION say, are found by it instead
    of by the built-in word lists.  A list of up to 64 MB is broadcast as a trie; a larger one is joined, which
    needs ``id_cols``.
    """
    if names is not None:
        df, registry, detectors, spans = _named(df, text_col, names, registry, detectors, spans, id_cols)
    text = ident(text_col)
    fits = f"char_length({text}) <= {max_chars}" if max_chars > 0 else "true"
    names = []
    for i, detector in enumerate(detectors):
        names.append(f"_detector_{i}")
        df = df.withColumn(names[-1], detector(F.expr(f"if({fits}, {text}, null)")))
    if spans is not None:
        if not id_cols:
            raise ValueError("a span table needs id_cols, the columns that identify a text")
        names.append("_detector_table")
        table = collect_spans(spans, id_cols).withColumnRenamed("spans", names[-1])
        df = df.join(table, list(id_cols), "left")
    found = spans_sql(
        text, registry, entities=entities, language=language, language_col=language_col,
        score_threshold=score_threshold, gated=gated, resolve=False, extra_span_cols=names,
    )
    if max_chars > 0:
        found = f"if(char_length({text}) > {max_chars}, cast(null as {sp.SPAN_ARRAY}), {found})"
    # One-row explode: the optimizer does not push a later filter on a derived column below it, so
    # such a filter cannot make the text be scanned a second time.  Overlaps are settled in a step of their own:
    # the analyzer goes over an expression once per level of nesting, so two shallow ones cost less than a deep one.
    once = df.select("*", F.expr(f"explode(array({found}))").alias("spans")).drop(*names)
    if resolve:
        once = once.withColumnRenamed("spans", "_found")
        # Only detectors of the caller report chains of many spans.
        kept = settled("_found") if names else F.expr(sp.resolve_overlaps("_found", in_order=True))
        once = once.select("*", F.explode(F.array(kept)).alias("spans")).drop("_found")
    return once.withColumn("error", F.expr(size_error(text, max_chars)))


def _named(
    df: DataFrame, text_col: str, names: DataFrame, registry: RecognizerRegistry | None,
    detectors: Sequence[Detector], spans: DataFrame | None, id_cols: Sequence[str],
) -> tuple[DataFrame, RecognizerRegistry, Sequence[Detector], DataFrame | None]:
    """What ``with_spans`` works with once the types of a name table are looked up in the table."""
    kinds = [r["entity_type"] for r in names.select("entity_type").distinct().collect()]
    registry = (registry or RecognizerRegistry()).without_types(kinds)
    small = gazetteer.load(names)
    if small is not None:
        return df, registry, (*detectors, gazetteer.detector(names, small)), spans
    if not id_cols:
        raise ValueError("a name table of this size needs id_cols, the columns that identify a text")
    found = term_spans(df.dropDuplicates(list(id_cols)), text_col, id_cols, names)
    return df, registry, detectors, found if spans is None else spans.unionByName(found)


def _with_audit(
    df: DataFrame, action: str, policy: GovernancePolicy, ts: AuditTime, changed: bool, text_col: str,
    id_cols: Sequence[str],
) -> DataFrame:
    """Add the ``audit`` struct; NULL where the text was refused or auditing is off."""
    keep_text = changed and policy.audit.log_anonymized_text
    values = {
        "audit_id": "audit_id",
        "ts": ts.sql,
        "action": lit(action),
        "classification": "classification",
        "entities_found": "entities_found",
        "entity_types": "entity_types",
        "entities_anonymized": "entities_found" if changed else "0",
        "operators_used": "operators_applied" if changed else "map()",
        "policy_name": lit(policy.name),
        "policy_version": lit(policy.version),
        "text_length": f"coalesce(char_length({ident(text_col)}), 0)",
        "anonymized_text": "_rewritten" if keep_text else "null",
        "metadata": f"map('record_key', {record_key_sql(id_cols)})",
    }
    fields = ", ".join(f"{sql} as {name}" for name, sql in values.items())
    record = f"cast(struct({fields}) as struct<{_struct_fields()}>)"
    allowed = "error is null" if policy.audit.enabled else "false"
    return df.withColumn("audit", F.expr(f"if({allowed}, {record}, null)"))


def _struct_fields() -> str:
    return ",".join(part.replace(" ", ":", 1) for part in AUDIT_DDL.split(", "))


def _base(
    df: DataFrame, action: str, text_col: str, id_cols: Sequence[str], policy: GovernancePolicy,
    ts: AuditTime, settings: Mapping[str, Any],
) -> DataFrame:
    """Spans and the facts every call needs."""
    df = with_spans(df, text_col, id_cols=id_cols, **settings)
    df = df.withColumns({
        "entity_types": F.expr(sp.entity_types("spans")),
        "entities_found": F.expr("size(spans)"),
        "audit_id": F.expr(
            f"if(error is null, {audit_id_sql(action, id_cols, policy, ts.text)}, null)"
        ),
    })
    return df.withColumn("classification", F.expr(cls.classification("entity_types", policy)))


def _policy_settings(policy: GovernancePolicy, settings: Mapping[str, Any]) -> dict[str, Any]:
    return {
        "language": policy.detection.language,
        "score_threshold": policy.detection.score_threshold,
        **settings,
    }


def _rewrite(
    df: DataFrame, text_col: str, policy: GovernancePolicy, types: Iterable[str],
    overrides: Mapping[str, Mapping[str, Any]] | None,
) -> DataFrame:
    listed = list(types)
    new_text = sp.rewritten(
        ident(text_col), "spans", lambda s: anon.replacement_sql(s, policy, listed, overrides)
    )
    return df.withColumns({
        "_rewritten": F.expr(f"if(error is null, {new_text}, null)"),
        "operators_applied": F.expr(
            anon.operators_applied_sql("entity_types", policy, listed, overrides)
        ),
    })


def _types_in(registry: RecognizerRegistry | None) -> list[str]:
    return (registry or RecognizerRegistry()).supported_entities(None)


def analyze(
    df: DataFrame,
    text_col: str = "text",
    id_cols: Sequence[str] = (),
    *,
    policy: GovernancePolicy | None = None,
    batch_ts: str | None = None,
    ts_col: str | None = None,
    with_audit: bool = False,
    **settings: Any,
) -> DataFrame:
    """Detect: ``entities_found``, ``results`` (spans without the matched text), ``analysis_id``.

    ``settings`` are those of ``with_spans``; the score threshold is 0.4 unless given.
    """
    policy, ts = policy or GovernancePolicy(), AuditTime.of(df, batch_ts, ts_col)
    keep = _checked(df, text_col, id_cols, ("results", "analysis_id"), with_audit)
    out = _base(df, "analyze", text_col, id_cols, policy, ts, settings)
    if with_audit:
        out = _with_audit(out, "analyze", policy, ts, False, text_col, id_cols)
    return out.select(
        *keep, "entities_found", F.expr(sp.without_values("spans")).alias("results"),
        F.col("audit_id").alias("analysis_id"), "error", *(["audit"] if with_audit else []),
    )


def anonymize(
    df: DataFrame,
    text_col: str = "text",
    id_cols: Sequence[str] = (),
    *,
    policy: GovernancePolicy | None = None,
    operators: Mapping[str, Mapping[str, Any]] | None = None,
    batch_ts: str | None = None,
    ts_col: str | None = None,
    with_audit: bool = False,
    **settings: Any,
) -> DataFrame:
    """Rewrite: ``anonymized_text``, counts, ``operators_applied``, ``analysis_id``.

    ``operators`` overrides the policy per entity type: ``{"EMAIL_ADDRESS": {"type": "mask", ...}}``.
    """
    policy, ts = policy or GovernancePolicy(), AuditTime.of(df, batch_ts, ts_col)
    keep = _checked(df, text_col, id_cols, ("anonymized_text", "entities_anonymized", "analysis_id"), with_audit)
    used = {"score_threshold": policy.detection.score_threshold, **settings}
    out = _base(df, "anonymize", text_col, id_cols, policy, ts, used)
    out = _rewrite(out, text_col, policy, _types_in(settings.get("registry")), operators)
    if with_audit:
        out = _with_audit(out, "anonymize", policy, ts, True, text_col, id_cols)
    return out.select(
        *keep, F.col("_rewritten").alias("anonymized_text"), "entities_found",
        F.col("entities_found").alias("entities_anonymized"), "operators_applied",
        F.col("audit_id").alias("analysis_id"), "error", *(["audit"] if with_audit else []),
    )


def classify(
    df: DataFrame,
    text_col: str = "text",
    id_cols: Sequence[str] = (),
    *,
    policy: GovernancePolicy | None = None,
    batch_ts: str | None = None,
    ts_col: str | None = None,
    with_audit: bool = False,
    **settings: Any,
) -> DataFrame:
    """Classify: level, ``confidence``, ``reason``, ``entity_summary``, ``policy_applied``."""
    policy, ts = policy or GovernancePolicy(), AuditTime.of(df, batch_ts, ts_col)
    keep = _checked(df, text_col, id_cols, ("confidence", "reason", "entity_summary", "policy_applied", "analysis_id"), with_audit)
    out = _base(df, "classify", text_col, id_cols, policy, ts, _policy_settings(policy, settings))
    if with_audit:
        out = _with_audit(out, "classify", policy, ts, False, text_col, id_cols)
    out = classified_columns(
        out.withColumn("_scores", F.expr("transform(spans, s -> s.score)")), policy, "_scores"
    )
    return out.select(
        *keep, "classification", "confidence", "reason", "entity_summary", "policy_applied",
        F.col("audit_id").alias("analysis_id"), "error", *(["audit"] if with_audit else []),
    )


def classified_columns(
    df: DataFrame, policy: GovernancePolicy, scores_col: str, types_col: str = "entity_types"
) -> DataFrame:
    """Add classification, confidence, entity_summary, reason and policy_applied."""
    types, scores = ident(types_col), ident(scores_col)
    df = df.withColumns({
        "classification": F.expr(cls.classification(types, policy)),
        "entity_summary": F.expr(cls.entity_summary(types, policy)),
        "confidence": F.expr(cls.confidence(types, scores)),
        "policy_applied": F.lit(policy.name),
    })
    return df.withColumn("reason", F.expr(cls.reason("entity_summary", "classification")))


def scan_and_protect(
    df: DataFrame,
    text_col: str = "text",
    id_cols: Sequence[str] = (),
    *,
    policy: GovernancePolicy | None = None,
    return_original: bool = False,
    batch_ts: str | None = None,
    ts_col: str | None = None,
    with_audit: bool = False,
    with_spans_col: bool = False,
    **settings: Any,
) -> DataFrame:
    """Detect, classify, rewrite and evaluate alerts in one pass over the text."""
    policy, ts = policy or GovernancePolicy(), AuditTime.of(df, batch_ts, ts_col)
    keep = _checked(df, text_col, id_cols, ("protected_text", "entities_anonymized", "policy_applied", "alerts_triggered", "original_text"), with_audit)
    action = "scan_and_protect"
    out = _base(df, action, text_col, id_cols, policy, ts, _policy_settings(policy, settings))
    out = _rewrite(out, text_col, policy, _types_in(settings.get("registry")), None)
    if with_audit:
        out = _with_audit(out, action, policy, ts, True, text_col, id_cols)
    rules = alerts.alerts_sql(policy.alerts, "classification", "entities_found")
    original = [F.col(text_col).alias("original_text")] if return_original else []
    return out.select(
        *keep, F.col("_rewritten").alias("protected_text"), "classification", "entities_found",
        F.col("entities_found").alias("entities_anonymized"), "entity_types",
        F.lit(policy.name).alias("policy_applied"), "audit_id",
        F.expr(f"if(error is null, {rules}, null)").alias("alerts_triggered"), "error",
        *original, *(["audit"] if with_audit else []), *(["spans"] if with_spans_col else []),
    )


def explode_spans(df: DataFrame, id_cols: Sequence[str], spans_col: str = "spans") -> DataFrame:
    """One row per span: the id columns, its number within the row, and its fields."""
    pairs = df.select(*id_cols, F.posexplode(spans_col).alias("span_no", "span"))
    return pairs.select(*id_cols, "span_no", "span.*")


def split_by_size(
    df: DataFrame, text_col: str = "text", max_chars: int = DEFAULT_MAX_CHARS
) -> tuple[DataFrame, DataFrame]:
    """Rows within the limit, and refused rows with their ``error``."""
    marked = df.withColumn("error", F.expr(size_error(ident(text_col), max_chars)))
    return (
        marked.where("error is null").drop("error"),
        marked.where("error is not null").drop(text_col),
    )
