"""Policy, classification, rewriting, alerts, the four calls, audit and sinks: A5-A8, E-J."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import duck
from catalog.tables import BATCH_TS, K, case_sql, cases, documents, table
from veilframe.operators import alerts, anonymize as anon, classify as cls
from veilframe.operators.policy import AlertRule, AuditSettings, GovernancePolicy, OperatorSpec
from veilframe.operators.tokens import KeyRing
from veilframe.plans import audit as au
from veilframe.plans import policy_table as pt
from veilframe.plans import protect
from veilframe.plans.protect import classified_columns, explode_spans
from veilframe.session import shared_folder
from veilframe.sources import sinks

ENTRIES: dict = {}

# Whole texts, however long; the size limit has queries of its own (a4, i1).
analyze, anonymize, classify, scan_and_protect, with_spans = (
    partial(call, max_chars=0)
    for call in (protect.analyze, protect.anonymize, protect.classify, protect.scan_and_protect, protect.with_spans)
)
DEFAULT = GovernancePolicy()
AUDIT_ID = "substr(sha256(concat_ws('|', '{0}', cast({1} AS string), 'default', '1.0', '" + BATCH_TS + "')), 1, 12)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "text")


def _doc_key(sql: str) -> str:
    return sql.replace("SELECT t.id,", "SELECT t.id AS doc_id,", 1)


DUCK_ALL = duck.spans(duck.DOCS)
MAP_TEXT = "array_join(array_sort(transform(map_entries({0}), e -> concat(e.key, '=', e.value))), ',')"
OPERATOR = (
    f"CASE {duck.level_of('{0}')} WHEN 'HIGH' THEN 'redact' WHEN 'MEDIUM' THEN 'replace' "
    "WHEN 'LOW' THEN 'mask' ELSE 'replace' END"
)
DUCK_OPERATORS = (
    f"coalesce(string_agg(DISTINCT sp.entity_type || '=' || {OPERATOR.format('sp.entity_type')}, ',' "
    f"ORDER BY sp.entity_type || '=' || {OPERATOR.format('sp.entity_type')}), '')"
)
DUCK_TYPES = "coalesce(string_agg(DISTINCT sp.entity_type, ',' ORDER BY sp.entity_type), '')"

# --- E: policy -----------------------------------------------------------------------------------

def _found_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of documents and of the mixed order texts, and one type no policy lists."""
    docs = explode_spans(with_spans(_docs(spark, sf_dir)), ["doc_id"])
    mixed = explode_spans(with_spans(cases(spark, sf_dir, "DATE_TIME")), ["id"])
    unknown = table(spark, sf_dir, "labels").selectExpr("'TOTALLY_UNKNOWN' as entity_type")
    return docs.select("entity_type").unionByName(mixed.select("entity_type")).unionByName(unknown)


DUCK_FOUND_TYPES = f"""SELECT entity_type FROM ({DUCK_ALL})
UNION ALL SELECT entity_type FROM ({duck.spans(case_sql('DATE_TIME'))})
UNION ALL SELECT 'TOTALLY_UNKNOWN' FROM labels"""


def e1_sensitivity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _found_types(spark, sf_dir).groupBy("entity_type").agg(F.count(F.lit(1)).alias("spans"))
    # The policy table has one row per configured type, so its size does not grow with the data.
    levels = F.broadcast(DEFAULT.entities_df(spark).select("entity_type", "level"))
    return counts.join(levels, "entity_type", "left").select("entity_type", "level", "spans")


ENTRIES["e1_sensitivity_lookup"] = (e1_sensitivity_lookup, f"""
SELECT entity_type, {duck.level_of('entity_type')} AS level, count(*) AS spans
FROM ({DUCK_FOUND_TYPES}) GROUP BY entity_type""")


def e2_operator_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = GovernancePolicy(operator_overrides={"EMAIL_ADDRESS": OperatorSpec("hash")})
    found = _found_types(spark, sf_dir)
    applied = anon.operators_applied_sql("array(entity_type)", policy)
    return found.groupBy("entity_type").agg(F.count(F.lit(1)).alias("spans")).select(
        "entity_type", F.expr(f"({applied})[entity_type]").alias("operator"), "spans"
    )


ENTRIES["e2_operator_lookup"] = (e2_operator_lookup, f"""
SELECT entity_type, CASE WHEN entity_type = 'EMAIL_ADDRESS' THEN 'hash'
  ELSE {OPERATOR.format('entity_type')} END AS operator, count(*) AS spans
FROM ({DUCK_FOUND_TYPES}) GROUP BY entity_type""")


def e3_call_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    overrides = {
        "EMAIL_ADDRESS": {"new_value": "HIDDEN"},
        "CREDIT_CARD": {"type": "mask", "masking_char": "#", "chars_to_mask": 12, "from_end": False},
    }
    out = anonymize(_docs(spark, sf_dir), "text", ["doc_id"], operators=overrides)
    return out.selectExpr(
        "doc_id", "anonymized_text", f"{MAP_TEXT.format('operators_applied')} as operators_applied"
    )


_OVERRIDDEN = f"""CASE entity_type WHEN 'EMAIL_ADDRESS' THEN 'HIDDEN'
  WHEN 'CREDIT_CARD' THEN repeat('#', least(12, length(v))) || substr(v, 13)
  ELSE {duck.default_replacement()} END"""
_OP3 = f"CASE WHEN sp.entity_type = 'CREDIT_CARD' THEN 'mask' ELSE {OPERATOR.format('sp.entity_type')} END"
ENTRIES["e3_call_override"] = (e3_call_override, f"""
WITH sp AS MATERIALIZED ({DUCK_ALL}), r AS ({duck.rewritten(duck.DOCS, 'SELECT * FROM sp', _OVERRIDDEN)})
SELECT r.id AS doc_id, any_value(r.new_text) AS anonymized_text,
  coalesce(string_agg(DISTINCT sp.entity_type || '=' || {_OP3}, ','
    ORDER BY sp.entity_type || '=' || {_OP3}), '') AS operators_applied
FROM r LEFT JOIN sp ON sp.id = r.id GROUP BY r.id""")


def e4_param_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found_types(spark, sf_dir)
    filled = anon.fill_template("<{entity_type}|{entity_type}>", "entity_type")
    return found.select("entity_type", F.expr(filled).alias("filled")).groupBy(
        "entity_type", "filled").agg(F.count(F.lit(1)).alias("spans"))


ENTRIES["e4_param_template"] = (e4_param_template, f"""
SELECT entity_type, '<' || entity_type || '|' || entity_type || '>' AS filled, count(*) AS spans
FROM ({DUCK_FOUND_TYPES}) GROUP BY entity_type""")


def e5_policy_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy table with how often each listed type occurs."""
    counts = _found_types(spark, sf_dir).groupBy("entity_type").agg(F.count(F.lit(1)).alias("spans"))
    listed = DEFAULT.entities_df(spark).drop("level_rank")
    return listed.join(counts, "entity_type", "left").fillna(0, ["spans"])


ENTRIES["e5_policy_get"] = (e5_policy_get, f"""
SELECT l.entity_type, {duck.level_of('l.entity_type')} AS level,
  {OPERATOR.format('l.entity_type')} AS operator, count(f.entity_type) AS spans
FROM (SELECT unnest([{', '.join(repr(t) for t in duck.ALL_TYPES)}]) AS entity_type) l
LEFT JOIN ({DUCK_FOUND_TYPES}) f ON f.entity_type = l.entity_type GROUP BY l.entity_type""")


def e6_policy_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classify, replace the policy, classify again: three kinds of audit rows."""
    config = {"name": "strict", "version": "2.0", "entity_sensitivity": {"HIGH": ["EMAIL_ADDRESS"]}}
    new, change = au.set_policy(spark, DEFAULT, config, BATCH_TS)
    parts = [
        au.audit_rows(classify(_docs(spark, sf_dir), "text", ["doc_id"], policy=p, batch_ts=BATCH_TS,
                               with_audit=True))
        for p in (DEFAULT, new)
    ]
    rows = parts[0].unionByName(change).unionByName(parts[1])
    return rows.groupBy("action", "policy_name", "policy_version", "classification").agg(
        F.count(F.lit(1)).alias("records"),
        F.max(F.expr("concat(metadata['previous_policy'], '@', metadata['previous_version'])")).alias("previous"),
    )


ENTRIES["e6_policy_set"] = (e6_policy_set, f"""
WITH sp AS MATERIALIZED ({DUCK_ALL})
SELECT 'classify' AS action, 'default' AS policy_name, '1.0' AS policy_version, classification,
  count(*) AS records, NULL AS previous
FROM ({duck.per_text(duck.DOCS, 'SELECT * FROM sp', duck.classification() + ' AS classification')})
GROUP BY classification
UNION ALL
SELECT 'classify', 'strict', '2.0', c, count(*), NULL FROM (
  SELECT t.id, CASE WHEN count(sp.id) = 0 THEN 'PUBLIC'
    WHEN bool_or(sp.entity_type = 'EMAIL_ADDRESS') THEN 'RESTRICTED' ELSE 'INTERNAL' END AS c
  FROM ({duck.DOCS}) t LEFT JOIN sp ON sp.id = t.id GROUP BY t.id) GROUP BY c
UNION ALL
SELECT 'policy_change', 'strict', '2.0', 'RESTRICTED', 1, 'default@1.0'""")

# --- F: classification, on entity sets derived from order keys -------------------------------------

_SET_TYPES = ("US_SSN", "EMAIL_ADDRESS", "URL", "UNKNOWN_TYPE", "PERSON", "CREDIT_CARD")
_SPARK_SET = "filter(array({0}), t -> t is not null)".format(
    ", ".join(f"if(({K} div {2 ** i}) % 2 = 1, '{t}', null)" for i, t in enumerate(_SET_TYPES))
)
_DUCK_SET = "list_filter([{0}], lambda t: t IS NOT NULL)".format(
    ", ".join(f"CASE WHEN ({K} // {2 ** i}) % 2 = 1 THEN '{t}' END" for i, t in enumerate(_SET_TYPES))
)
DUCK_SETS = f"""SELECT {K} AS id, {_DUCK_SET} AS types,
  CASE WHEN {K} % 3 = 0 THEN NULL ELSE list_transform({_DUCK_SET},
    lambda t: (50 + ({K} + length(t)) % 50) / 100.0) END AS scores FROM orders"""


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "orders").selectExpr(f"{K} as id", f"{_SPARK_SET} as types")
    return sets.withColumn("scores", F.expr(
        "if(id % 3 = 0, null, transform(types, t -> cast((50 + (id + length(t)) % 50) / 100.0 as double)))"
    ))


_DUCK_LEVELS = f"list_transform(types, lambda t: coalesce({duck.level_of('t')}, 'UNKNOWN'))"
_DUCK_CLASS = f"""CASE WHEN len(types) = 0 THEN 'PUBLIC'
  WHEN list_contains({_DUCK_LEVELS}, 'HIGH') THEN 'RESTRICTED'
  WHEN list_contains({_DUCK_LEVELS}, 'MEDIUM') THEN 'CONFIDENTIAL' ELSE 'INTERNAL' END"""
_DUCK_CONFIDENCE = """CASE WHEN len(scores) > 0 THEN round(cast(list_avg(scores) AS double), 4)
  WHEN len(types) = 0 THEN cast(1.0 AS double) ELSE cast(0.8 AS double) END"""


def _duck_group(level: str) -> str:
    return f"list_sort(list_filter(types, lambda t: coalesce({duck.level_of('t')}, 'UNKNOWN') = '{level}'))"


_DUCK_SUMMARY = "concat_ws(' ', {0})".format(", ".join(
    f"CASE WHEN len({_duck_group(level)}) > 0 THEN '{level}:' || array_to_string({_duck_group(level)}, ',') END"
    for level in ("HIGH", "LOW", "MEDIUM", "UNKNOWN")
))
_DUCK_REASON = "CASE WHEN len(types) = 0 THEN 'No PII entities detected' ELSE 'Contains ' || concat_ws('; ', {0}) END".format(
    ", ".join(
        f"CASE WHEN len({_duck_group(level)}) > 0 THEN len({_duck_group(level)}) || ' {level}-sensitivity entit' "
        f"|| CASE WHEN len({_duck_group(level)}) = 1 THEN 'y' ELSE 'ies' END || ' (' "
        f"|| array_to_string({_duck_group(level)}, ', ') || ')' END"
        for level in ("HIGH", "MEDIUM", "LOW")
    )
)
SUMMARY_TEXT = (
    "array_join(array_sort(transform(map_entries({0}), e -> concat(e.key, ':', array_join(e.value, ',')))), ' ')"
)


def f1_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir).select("id", F.expr(cls.classification("types", DEFAULT)).alias("classification"))


ENTRIES["f1_classify"] = (f1_classify, f"SELECT id, {_DUCK_CLASS} AS classification FROM ({DUCK_SETS})")


def f1_classify_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table form: spans joined to the policy table, highest rank per text."""
    found = with_spans(_docs(spark, sf_dir))
    spans = found.select("doc_id", F.explode_outer(F.expr("transform(spans, s -> s.entity_type)")).alias("entity_type"))
    levels = F.broadcast(DEFAULT.entities_df(spark).select("entity_type", "level_rank"))
    ranks = spans.join(levels, "entity_type", "left").groupBy("doc_id").agg(
        F.count("entity_type").alias("n"), F.max("level_rank").alias("rank")
    )
    return ranks.selectExpr("doc_id", (
        "case when n = 0 then 'PUBLIC' when rank = 3 then 'RESTRICTED' when rank = 2 then 'CONFIDENTIAL' "
        "else 'INTERNAL' end as classification"
    ))


ENTRIES["f1_classify_by_join"] = (f1_classify_by_join, _doc_key(duck.per_text(
    duck.DOCS, DUCK_ALL, duck.classification() + " AS classification")))


def f2_entity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _sets(spark, sf_dir).withColumn("summary", F.expr(cls.entity_summary("types", DEFAULT)))
    return out.selectExpr("id", f"{SUMMARY_TEXT.format('summary')} as entity_summary")


ENTRIES["f2_entity_summary"] = (f2_entity_summary, f"SELECT id, {_DUCK_SUMMARY} AS entity_summary FROM ({DUCK_SETS})")


def f3_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir).select("id", F.expr(cls.confidence("types", "scores")).alias("confidence"))


ENTRIES["f3_confidence"] = (f3_confidence, f"SELECT id, {_DUCK_CONFIDENCE} AS confidence FROM ({DUCK_SETS})")


def f4_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified_columns(_sets(spark, sf_dir), DEFAULT, "scores", "types").select("id", "reason")


ENTRIES["f4_reason"] = (f4_reason, f"SELECT id, {_DUCK_REASON} AS reason FROM ({DUCK_SETS})")


def f5_classification_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classified_columns(_sets(spark, sf_dir), DEFAULT, "scores", "types")
    return out.selectExpr(
        "id", "classification", "confidence", "reason",
        f"{SUMMARY_TEXT.format('entity_summary')} as entity_summary", "policy_applied",
    )


ENTRIES["f5_classification_result"] = (f5_classification_result, f"""
SELECT id, {_DUCK_CLASS} AS classification, {_DUCK_CONFIDENCE} AS confidence, {_DUCK_REASON} AS reason,
  {_DUCK_SUMMARY} AS entity_summary, 'default' AS policy_applied FROM ({DUCK_SETS})""")

# --- G: rewriting --------------------------------------------------------------------------------

_G_TYPES = ["EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS"]


def _rewrite_query(spec: dict, duck_replacement: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = anonymize(
            _docs(spark, sf_dir), "text", ["doc_id"], entities=_G_TYPES,
            operators={t: spec for t in _G_TYPES},
        )
        return out.select("doc_id", "anonymized_text")

    sql = duck.rewritten(duck.DOCS, duck.spans(duck.DOCS, _G_TYPES), duck_replacement)
    return run, f"SELECT id AS doc_id, new_text AS anonymized_text FROM ({sql})"


ENTRIES["g1_replace"] = _rewrite_query(
    {"type": "replace", "new_value": "<{entity_type}>"}, "'<' || entity_type || '>'")
ENTRIES["g2_redact"] = _rewrite_query({"type": "redact"}, "''")
ENTRIES["g3_mask_left"] = _rewrite_query(
    {"type": "mask", "masking_char": "x", "chars_to_mask": 8, "from_end": False},
    "repeat('x', least(8, length(v))) || substr(v, 9)")
ENTRIES["g3_mask_right"] = _rewrite_query(
    {"type": "mask", "masking_char": "*", "chars_to_mask": 14, "from_end": True},
    "substr(v, 1, greatest(length(v) - 14, 0)) || repeat('*', least(14, length(v)))")
ENTRIES["g4_hash"] = _rewrite_query({"type": "hash", "salt": "pepper-"}, "sha256('pepper-' || v)")


def g5_encrypt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token per value, which decrypts to the value."""
    key = "0123456789abcdef"
    spec = OperatorSpec("encrypt", {"key": key})
    found = with_spans(_docs(spark, sf_dir), entities=["EMAIL_ADDRESS"])
    values = found.select("doc_id", F.explode("spans").alias("s"))
    tokens = values.select("doc_id", F.expr(anon.operator_sql(spec, "s.text")).alias("token"))
    return tokens.selectExpr(
        "doc_id", f"cast(aes_decrypt(unbase64(token), '{key}', 'CBC', 'PKCS') as string) as found",
        "cast(length(token) as bigint) as token_length",
    )


ENTRIES["g5_encrypt"] = (g5_encrypt, f"""
SELECT id AS doc_id, v AS found,
  cast(4 * ((16 + (length(v) // 16 + 1) * 16 + 2) // 3) AS bigint) AS token_length
FROM ({duck.spans(duck.DOCS, ['EMAIL_ADDRESS'])})""")


ENTRIES["g4_hmac"] = _rewrite_query(
    {"type": "hash", "hash_type": "hmac_sha256", "key": "Jefe"},
    "sha256(unhex('" + bytes(b ^ 0x5C for b in b"Jefe".ljust(64, b"\0")).hex() + "') || unhex(sha256(unhex('"
    + bytes(b ^ 0x36 for b in b"Jefe".ljust(64, b"\0")).hex() + "') || encode(v))))")


def g5_joinable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables whose names were encrypted under different keys, joined after one was brought under the other's key."""
    old, new = "0123456789abcdef", "another key of 32 bytes, longer "
    former, ring = KeyRing({"k1": old}, "k1"), KeyRing({"k1": old, "k2": new}, "k2")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.expr(ring.token("c_name")).alias("token"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(former.token(
        "concat('Customer#', lpad(cast(o_custkey * 2 as string), 9, '0'))")).alias("token"))
    joined = ring.rotated(orders, ["token"]).join(customers, "token")
    return joined.groupBy("token", "c_custkey").agg(F.count(F.lit(1)).alias("orders")).select(
        "c_custkey", "orders", F.expr(ring.value("token")).alias("name"), F.expr("substring_index(token, ':', 1)").alias("key_id"))


ENTRIES["g5_joinable_tokens"] = (g5_joinable_tokens, """
SELECT c_custkey, count(*) AS orders, c_name AS name, 'k2' AS key_id
FROM orders JOIN customer ON c_name = 'Customer#' || lpad(cast(o_custkey * 2 AS string), 9, '0')
GROUP BY c_custkey, c_name""")


def g6_operators_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anonymize(_docs(spark, sf_dir), "text", ["doc_id"])
    return out.selectExpr("doc_id", f"{MAP_TEXT.format('operators_applied')} as operators_applied")


ENTRIES["g6_operators_applied"] = (g6_operators_applied, _doc_key(duck.per_text(
    duck.DOCS, DUCK_ALL, f"{DUCK_OPERATORS} AS operators_applied")))


def g7_entities_anonymized(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anonymize(_docs(spark, sf_dir), "text", ["doc_id"])
    return out.selectExpr("doc_id", "cast(entities_anonymized as bigint) as entities_anonymized")


ENTRIES["g7_entities_anonymized"] = (g7_entities_anonymized, _doc_key(duck.per_text(
    duck.DOCS, DUCK_ALL, "count(sp.id) AS entities_anonymized")))


def g8_anonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = anonymize(cases(spark, sf_dir, "MIXED"), "text", ["id"])
    dates = anonymize(cases(spark, sf_dir, "DATE_TIME"), "text", ["id"])
    return mixed.selectExpr("'mixed' as kind", "id", "anonymized_text").unionByName(
        dates.selectExpr("'dates' as kind", "id", "anonymized_text"))


_G8 = "SELECT '{0}' AS kind, id, new_text AS anonymized_text FROM ({1})"
ENTRIES["g8_anonymize"] = (g8_anonymize, " UNION ALL ".join(
    _G8.format(name, duck.rewritten(case_sql(kind), duck.spans(case_sql(kind)), duck.default_replacement()))
    for name, kind in (("mixed", "MIXED"), ("dates", "DATE_TIME"))))


def d2_rewrite_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymize(_docs(spark, sf_dir), "text", ["doc_id"]).select("doc_id", "anonymized_text")


ENTRIES["d2_rewrite_text"] = (d2_rewrite_text, "SELECT id AS doc_id, new_text AS anonymized_text FROM ({0})".format(
    duck.rewritten(duck.DOCS, DUCK_ALL, duck.default_replacement())))

# --- H: alerts -----------------------------------------------------------------------------------

RULES = (
    AlertRule("restricted", "classification == RESTRICTED", "webhook", "CRITICAL", "https://hooks.example.com/a"),
    AlertRule("many", "entities_found > 3"),
    AlertRule("confidential", "classification == CONFIDENTIAL", "webhook", "INFO", "https://hooks.example.com/b"),
    AlertRule("any", "entities_found > 0", "webhook", "INFO"),
    AlertRule("unknown", "text_length is odd", "webhook", "INFO", "https://hooks.example.com/c"),
)
ALERTING = GovernancePolicy(alerts=RULES)
DUCK_RULES = """(VALUES ('restricted', 'webhook', 'CRITICAL', 'https://hooks.example.com/a', 'RESTRICTED', NULL),
  ('many', 'log', 'WARNING', '', NULL, 3),
  ('confidential', 'webhook', 'INFO', 'https://hooks.example.com/b', 'CONFIDENTIAL', NULL),
  ('any', 'webhook', 'INFO', '', NULL, 0),
  ('unknown', 'webhook', 'INFO', 'https://hooks.example.com/c', NULL, NULL))
  r(rule, action, level, webhook_url, on_class, above)"""
DUCK_STATE = duck.per_text(duck.DOCS, DUCK_ALL, f"{duck.classification()} AS classification, count(sp.id) AS entities_found")
DUCK_ALERTS = f"""SELECT d.id AS doc_id, rule, action, level, webhook_url, classification, entities_found
  FROM ({DUCK_STATE}) d JOIN {DUCK_RULES} ON classification = on_class OR entities_found > above"""


def _governed(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return scan_and_protect(_docs(spark, sf_dir), "text", ["doc_id"], policy=ALERTING, batch_ts=BATCH_TS, **kw)


def _single_rule(rule: AlertRule, condition: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = scan_and_protect(_docs(spark, sf_dir), "text", ["doc_id"], policy=GovernancePolicy(alerts=(rule,)))
        return out.selectExpr("doc_id", "size(alerts_triggered) > 0 as fires")

    return run, f"SELECT id AS doc_id, {condition} AS fires FROM ({DUCK_STATE})"


ENTRIES["h1_alert_on_classification"] = _single_rule(RULES[0], "classification = 'RESTRICTED'")
ENTRIES["h2_alert_on_count"] = _single_rule(AlertRule("two", "entities_found > 1"), "entities_found > 1")


def h3_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _governed(spark, sf_dir).select(
        "doc_id", "classification", "entities_found", F.explode("alerts_triggered").alias("a"))
    return rows.selectExpr(
        "doc_id", "a.name as rule", "a.action as action", "a.level as level", "a.webhook_url as webhook_url",
        "classification", "cast(entities_found as bigint) as entities_found",
    )


ENTRIES["h3_alerts"] = (h3_alerts, DUCK_ALERTS)


def h3_alert_condition_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules as a table: what each understood condition means and how often it holds."""
    rules = alerts.rules_df(spark, RULES)
    fired = h3_alerts(spark, sf_dir).groupBy("rule").agg(F.count(F.lit(1)).alias("fired"))
    return rules.join(fired, rules["name"] == fired["rule"], "left").selectExpr(
        "name", "condition", "on_classification", "cast(above_count as bigint) as above_count",
        "coalesce(fired, 0) as fired",
    )


ENTRIES["h3_alert_condition_table"] = (h3_alert_condition_table, f"""
SELECT r.rule AS name, c.condition, r.on_class AS on_classification, cast(r.above AS bigint) AS above_count,
  count(a.doc_id) AS fired
FROM {DUCK_RULES} JOIN (VALUES ('restricted', 'classification == RESTRICTED'), ('many', 'entities_found > 3'),
  ('confidential', 'classification == CONFIDENTIAL'), ('any', 'entities_found > 0'),
  ('unknown', 'text_length is odd')) c(name, condition) ON c.name = r.rule
LEFT JOIN ({DUCK_ALERTS}) a ON a.rule = r.rule GROUP BY ALL""")

# --- I: the four calls ----------------------------------------------------------------------------

def i1_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analyze(_docs(spark, sf_dir), "text", ["doc_id"], batch_ts=BATCH_TS)
    return out.selectExpr(
        "doc_id", "cast(entities_found as bigint) as entities_found",
        "array_join(transform(results, r -> concat(r.entity_type, ':', r.start, '-', r.end)), ',') as results",
        "analysis_id", "error is not null as refused",
    )


ENTRIES["i1_analyze"] = (i1_analyze, f"""
WITH sp AS MATERIALIZED ({duck.spans(duck.DOCS)})
SELECT d.doc_id, count(sp.id) AS entities_found,
  coalesce(string_agg(sp.entity_type || ':' || sp.s || '-' || sp.e, ',' ORDER BY sp.s), '') AS results,
  {AUDIT_ID.format('analyze', 'd.doc_id')} AS analysis_id, false AS refused
FROM documents d LEFT JOIN sp ON sp.id = d.doc_id GROUP BY d.doc_id, d.text""")


def i2_anonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anonymize(_docs(spark, sf_dir), "text", ["doc_id"], batch_ts=BATCH_TS,
                    entities=["CREDIT_CARD", "PHONE_NUMBER"],
                    operators={"PHONE_NUMBER": {"type": "mask", "masking_char": "#", "chars_to_mask": 99}})
    return out.selectExpr(
        "doc_id", "anonymized_text", "cast(entities_found as bigint) as entities_found",
        "cast(entities_anonymized as bigint) as entities_anonymized",
        f"{MAP_TEXT.format('operators_applied')} as operators_applied", "analysis_id",
    )


_I2 = duck.spans(duck.DOCS, ["CREDIT_CARD", "PHONE_NUMBER"])
_I2_OP = "sp.entity_type || '=' || CASE sp.entity_type WHEN 'CREDIT_CARD' THEN 'redact' ELSE 'mask' END"
ENTRIES["i2_anonymize"] = (i2_anonymize, f"""
WITH sp AS MATERIALIZED ({_I2}), r AS ({duck.rewritten(duck.DOCS, 'SELECT * FROM sp',
    "CASE entity_type WHEN 'CREDIT_CARD' THEN '' ELSE repeat('#', length(v)) END")})
SELECT r.id AS doc_id, any_value(new_text) AS anonymized_text, count(sp.id) AS entities_found,
  count(sp.id) AS entities_anonymized,
  coalesce(string_agg(DISTINCT {_I2_OP}, ',' ORDER BY {_I2_OP}), '') AS operators_applied,
  {AUDIT_ID.format('anonymize', 'r.id')} AS analysis_id
FROM r LEFT JOIN sp ON sp.id = r.id GROUP BY r.id""")


def i3_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(_docs(spark, sf_dir), "text", ["doc_id"], batch_ts=BATCH_TS)
    return out.selectExpr(
        "doc_id", "classification", "confidence", "reason",
        f"{SUMMARY_TEXT.format('entity_summary')} as entity_summary", "policy_applied", "analysis_id",
    )


ENTRIES["i3_classify"] = (i3_classify, f"""
WITH x AS ({duck.per_text(duck.DOCS, DUCK_ALL,
    "coalesce(list_sort(list(DISTINCT sp.entity_type) FILTER (sp.id IS NOT NULL)), []) AS types, "
    "list(sp.score) FILTER (sp.id IS NOT NULL) AS scores")})
SELECT id AS doc_id, {_DUCK_CLASS} AS classification, {_DUCK_CONFIDENCE} AS confidence,
  {_DUCK_REASON} AS reason, {_DUCK_SUMMARY} AS entity_summary, 'default' AS policy_applied,
  {AUDIT_ID.format('classify', 'id')} AS analysis_id FROM x""")


def i4_scan_and_protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _governed(spark, sf_dir, return_original=True)
    return out.selectExpr(
        "doc_id", "protected_text", "classification", "cast(entities_found as bigint) as entities_found",
        "cast(entities_anonymized as bigint) as entities_anonymized", "policy_applied", "audit_id",
        "array_join(transform(alerts_triggered, a -> a.name), ',') as alerts_triggered",
        "sha2(original_text, 256) as original_hash",
    )


ENTRIES["i4_scan_and_protect"] = (i4_scan_and_protect, f"""
WITH sp AS MATERIALIZED ({DUCK_ALL}),
r AS ({duck.rewritten(duck.DOCS, 'SELECT * FROM sp', duck.default_replacement())}),
x AS ({duck.per_text(duck.DOCS, 'SELECT * FROM sp',
    duck.classification() + ' AS classification, count(sp.id) AS entities_found')})
SELECT x.id AS doc_id, new_text AS protected_text, classification, entities_found,
  entities_found AS entities_anonymized, 'default' AS policy_applied,
  {AUDIT_ID.format('scan_and_protect', 'x.id')} AS audit_id,
  concat_ws(',', CASE WHEN classification = 'RESTRICTED' THEN 'restricted' END,
    CASE WHEN entities_found > 3 THEN 'many' END,
    CASE WHEN classification = 'CONFIDENTIAL' THEN 'confidential' END,
    CASE WHEN entities_found > 0 THEN 'any' END) AS alerts_triggered,
  sha256(d.text) AS original_hash
FROM x JOIN r ON r.id = x.id JOIN documents d ON d.doc_id = x.id""")

# --- J: audit ------------------------------------------------------------------------------------

def _audit(spark: SparkSession, sf_dir: str, policy: GovernancePolicy = DEFAULT) -> DataFrame:
    return au.audit_rows(scan_and_protect(
        _docs(spark, sf_dir), "text", ["doc_id"], policy=policy, batch_ts=BATCH_TS, with_audit=True))


def _flat_audit(audit: DataFrame) -> DataFrame:
    return audit.selectExpr(
        "audit_id", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as ts", "action", "classification",
        "cast(entities_found as bigint) as entities_found",
        "array_join(entity_types, ',') as entity_types",
        "cast(entities_anonymized as bigint) as entities_anonymized",
        f"{MAP_TEXT.format('operators_used')} as operators_used", "policy_name", "policy_version",
        "cast(text_length as bigint) as text_length", "cast(size(metadata) as bigint) as metadata_entries",
    )


_DUCK_AUDIT_COLUMNS = f"""'{BATCH_TS}' AS ts, {duck.classification()} AS classification,
  count(sp.id) AS entities_found, {DUCK_TYPES} AS entity_types, 'default' AS policy_name,
  '1.0' AS policy_version, cast(1 AS bigint) AS metadata_entries"""


def _duck_audit(action: str, rewrites: bool) -> str:
    changed = "count(sp.id)" if rewrites else "cast(0 AS bigint)"
    used = DUCK_OPERATORS if rewrites else "''"
    return f"""SELECT {AUDIT_ID.format(action, 't.id')} AS audit_id, '{action}' AS action,
      {_DUCK_AUDIT_COLUMNS}, {changed} AS entities_anonymized, {used} AS operators_used,
      length(any_value(t.text)) AS text_length
    FROM ({duck.DOCS}) t LEFT JOIN ({DUCK_ALL}) sp ON sp.id = t.id GROUP BY t.id"""


def j1_audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all four calls."""
    kw = {"policy": DEFAULT, "batch_ts": BATCH_TS, "with_audit": True}
    docs = _docs(spark, sf_dir)
    parts = [au.audit_rows(call(docs, "text", ["doc_id"], **kw))
             for call in (analyze, anonymize, classify, scan_and_protect)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return _flat_audit(rows)


ENTRIES["j1_audit_records"] = (j1_audit_records, " UNION ALL BY NAME ".join(
    f"({_duck_audit(action, rewrites)})" for action, rewrites in (
        ("analyze", False), ("anonymize", True), ("classify", False), ("scan_and_protect", True))))


def j2_export_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = au.export_columns(_audit(spark, sf_dir))
    names = ",".join(sorted(out.columns))
    return _flat_audit(out.withColumnRenamed("timestamp", "ts")).withColumn("exported_fields", F.lit(names))


ENTRIES["j2_export_record"] = (j2_export_record, f"""
SELECT *, 'action,audit_id,classification,entities_anonymized,entities_found,entity_types,metadata,'
  || 'operators_used,policy_name,policy_version,text_length,timestamp' AS exported_fields
FROM ({_duck_audit('scan_and_protect', True)})""")

_ACTIONS = "case event_type when 'click' then 'analyze' when 'view' then 'anonymize' when 'purchase' then 'classify' else 'scan_and_protect' end"
_CLASSES = "case user_id % 4 when 0 then 'PUBLIC' when 1 then 'INTERNAL' when 2 then 'CONFIDENTIAL' else 'RESTRICTED' end"


def event_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit table with real event times: one record per event."""
    return table(spark, sf_dir, "events").selectExpr(
        "lpad(cast(event_id as string), 12, '0') as audit_id", "cast(ts as timestamp) as ts",
        f"{_ACTIONS} as action", f"{_CLASSES} as classification",
        "cast(if(user_id % 4 = 0, 0, value) as int) as entities_found",
        "cast(array() as array<string>) as entity_types", "cast(value / 2 as int) as entities_anonymized",
        "cast(map() as map<string,string>) as operators_used", "'default' as policy_name",
        "'1.0' as policy_version", "cast(value * 10 as int) as text_length",
        "cast(null as string) as anonymized_text", "cast(map() as map<string,string>) as metadata",
    )


DUCK_EVENTS = f"""SELECT lpad(cast(event_id AS string), 12, '0') AS audit_id, ts, {_ACTIONS} AS action,
  {_CLASSES} AS classification, cast(trunc(CASE WHEN user_id % 4 = 0 THEN 0 ELSE value END) AS bigint) AS entities_found,
  cast(trunc(value / 2) AS bigint) AS entities_anonymized FROM events"""
_STAMP = "date_format({0}, 'yyyy-MM-dd HH:mm:ss') as ts"
_DUCK_STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
SINCE = "2024-01-15 12:00:00"


def _short(audit: DataFrame, ts: str = "ts") -> DataFrame:
    return audit.selectExpr("audit_id", _STAMP.format(ts), "action", "classification",
                            "cast(entities_found as bigint) as entities_found")


_DUCK_SHORT = f"audit_id, {_DUCK_STAMP}, action, classification, entities_found"


def j3_query_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = event_audit(spark, sf_dir)
    return _short(au.filter_audit(audit, SINCE, "classify", "RESTRICTED"))


ENTRIES["j3_query_filters"] = (j3_query_filters, f"""
SELECT {_DUCK_SHORT} FROM ({DUCK_EVENTS})
WHERE ts >= TIMESTAMP '{SINCE}' AND action = 'classify' AND classification = 'RESTRICTED'""")


def j3_stored_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the partitioned audit table, read it back by partition."""
    path = shared_folder(spark, "audit-table")
    au.write_audit(event_audit(spark, sf_dir), path)
    return _short(au.filter_audit(au.read_audit(spark, path), SINCE, "analyze"))


ENTRIES["j3_stored_audit"] = (j3_stored_audit, f"""
SELECT {_DUCK_SHORT} FROM ({DUCK_EVENTS}) WHERE ts >= TIMESTAMP '{SINCE}' AND action = 'analyze'""")


def j4_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = au.query_audit(event_audit(spark, sf_dir), limit=50, classification="CONFIDENTIAL")
    return _short(out, "timestamp")


ENTRIES["j4_newest_first"] = (j4_newest_first, f"""
SELECT {_DUCK_SHORT} FROM (SELECT * FROM ({DUCK_EVENTS}) WHERE classification = 'CONFIDENTIAL'
  ORDER BY ts DESC, audit_id DESC LIMIT 50)""")


def j5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = event_audit(spark, sf_dir)
    small = au.audit_totals(audit, 50, action_type="classify").withColumn("query", F.lit("page"))
    large = au.audit_totals(audit, 1_000_000, action_type="classify", since=SINCE).withColumn("query", F.lit("all"))
    return small.unionByName(large)


ENTRIES["j5_totals"] = (j5_totals, f"""
SELECT 'page' AS query, count(*) AS total_records, least(count(*) FILTER (action = 'classify'), 50) AS returned
FROM ({DUCK_EVENTS})
UNION ALL SELECT 'all', count(*), count(*) FILTER (action = 'classify' AND ts >= TIMESTAMP '{SINCE}')
FROM ({DUCK_EVENTS})""")


def j6_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(au.retain_newest(event_audit(spark, sf_dir), 1000))


ENTRIES["j6_retention"] = (j6_retention, f"""
SELECT {_DUCK_SHORT} FROM (SELECT * FROM ({DUCK_EVENTS}) ORDER BY ts DESC, audit_id DESC LIMIT 1000)""")


def j7_log_anonymized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        _audit(spark, sf_dir, GovernancePolicy(audit=settings)).groupBy("action").agg(
            F.count(F.lit(1)).alias("records"), F.count("anonymized_text").alias("with_text"),
            F.coalesce(F.sum(F.char_length("anonymized_text")), F.lit(0)).alias("chars"),
        ).withColumn("setting", F.lit(name))
        for name, settings in (
            ("kept", AuditSettings()), ("dropped", AuditSettings(log_anonymized_text=False)),
            ("off", AuditSettings(enabled=False)))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_J7 = duck.rewritten(duck.DOCS, DUCK_ALL, duck.default_replacement())
ENTRIES["j7_log_anonymized_text"] = (j7_log_anonymized_text, f"""
SELECT 'kept' AS setting, 'scan_and_protect' AS action, count(*) AS records, count(*) AS with_text,
  cast(sum(length(new_text)) AS bigint) AS chars FROM ({_J7})
UNION ALL SELECT 'dropped', 'scan_and_protect', count(*), 0, 0 FROM documents""")

# --- A5-A8: sinks --------------------------------------------------------------------------------

def a5_jsonl_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = _audit(spark, sf_dir)
    sink = sinks.JsonLinesSink(shared_folder(spark, "audit-json"))
    sink.write(audit)
    return _flat_audit(sink.query(audit).withColumnRenamed("timestamp", "ts"))


ENTRIES["a5_jsonl_sink"] = (a5_jsonl_sink, _duck_audit("scan_and_protect", True))


def a6_console_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.console_columns(_audit(spark, sf_dir)).selectExpr(
        "audit_id", "action", "classification", "cast(entities_found as bigint) as entities_found",
        "cast(entities_anonymized as bigint) as entities_anonymized")


ENTRIES["a6_console_columns"] = (a6_console_columns, f"""
SELECT audit_id, action, classification, entities_found, entities_anonymized
FROM ({_duck_audit('scan_and_protect', True)})""")


def a7_alert_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.outbox_rows(_governed(spark, sf_dir), ["doc_id"]).selectExpr(
        "doc_id", "webhook_url", "rule", "level", "classification",
        "cast(entities_found as bigint) as entities_found", "audit_id")


ENTRIES["a7_alert_outbox"] = (a7_alert_outbox, f"""
SELECT doc_id, webhook_url, rule, level, classification, entities_found,
  {AUDIT_ID.format('scan_and_protect', 'doc_id')} AS audit_id
FROM ({DUCK_ALERTS}) WHERE action = 'webhook' AND webhook_url <> ''""")


class _BrokenSink:
    def write(self, audit: DataFrame) -> None:
        raise OSError("sink is down")


def a8_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two good sinks and a failing one between them."""
    audit = _audit(spark, sf_dir)
    json_path, outbox = shared_folder(spark, "fan-json"), shared_folder(spark, "fan-outbox")
    configs = [{"type": "file", "path": json_path}, {"type": "carrier_pigeon"},
               {"type": "outbox", "url": "https://hooks.example.com/audit", "path": outbox}]
    made = sinks.sinks_from_policy(configs)
    failed = sinks.fan_out(audit, [made[0], _BrokenSink(), *made[1:]])
    stored = made[0].query(audit).groupBy("classification").agg(F.count(F.lit(1)).alias("in_file"))
    sent = spark.read.parquet(outbox).groupBy("classification").agg(F.count(F.lit(1)).alias("in_outbox"))
    return stored.join(sent, "classification", "full").withColumn("failed_sinks", F.lit(",".join(failed)))


ENTRIES["a8_fan_out"] = (a8_fan_out, f"""
SELECT classification, count(*) AS in_file, count(*) AS in_outbox, '_BrokenSink' AS failed_sinks
FROM ({DUCK_STATE}) GROUP BY classification""")


class _Stop(BaseException):
    """The job dies here: no sink can catch it."""


class _DyingSink:
    def write(self, audit: DataFrame) -> None:
        raise _Stop


def a8_repeated_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job that dies between two sinks and is run again, twice: every record is in each of them once."""
    audit = event_audit(spark, sf_dir)
    first = sinks.JsonLinesSink(shared_folder(spark, "run-json"))
    second = sinks.OutboxSink("https://hooks.example.com/audit", shared_folder(spark, "run-outbox"))
    try:
        sinks.fan_out(audit, [first, _DyingSink(), second], run_id="2026-01-01")
    except _Stop:
        pass
    for _ in range(2):
        sinks.fan_out(audit, [first, second], run_id="2026-01-01")
    stored = [sink.query(audit).select("audit_id", "action", F.lit(name).alias("sink")) for sink, name in ((first, "file"), (second, "outbox"))]
    return stored[0].unionByName(stored[1]).groupBy("sink", "action").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("audit_id").alias("ids"))


ENTRIES["a8_repeated_run"] = (a8_repeated_run, f"""
SELECT sink, action, count(*) AS records, count(*) AS ids FROM ({DUCK_EVENTS}), (VALUES ('file'), ('outbox')) s(sink)
GROUP BY sink, action""")

# --- policies over time ------------------------------------------------------------------------------

_TYPED = "case user_id % 5 when 0 then array('EMAIL_ADDRESS') when 1 then array('URL', 'IP_ADDRESS') when 2 then array('US_SSN', 'URL') when 3 then array('BADGE') else array() end"
_STRICT = GovernancePolicy(name="strict", version="2", entity_sensitivity={"HIGH": ("US_SSN", "EMAIL_ADDRESS"), "MEDIUM": ("BADGE",), "LOW": ("URL",)})
_LOOSE = GovernancePolicy(name="loose", version="3", entity_sensitivity={"LOW": ("US_SSN", "URL"), "MEDIUM": ("IP_ADDRESS",)})
_FROM = ("2024-01-05 00:00:00", "2024-01-12 06:00:00", "2024-01-20 12:30:00")


def e7_policy_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event classified by the policy that was in force at its time; three versions from a table."""
    table_ = pt.version_row(spark, _STRICT, _FROM[1]).unionByName(pt.version_row(spark, _LOOSE, _FROM[2])).unionByName(
        pt.version_row(spark, GovernancePolicy(), _FROM[0]))
    events = table(spark, sf_dir, "events").selectExpr("event_id", "cast(ts as timestamp) as ts", f"{_TYPED} as entity_types")
    return pt.with_policy_as_of(events, pt.versions(table_)).select("event_id", "policy_name", "policy_version", "classification")


_DUCK_KIND = "user_id % 5"
_DUCK_LEVELS = {
    "default": "case {k} when 0 then 'CONFIDENTIAL' when 1 then 'CONFIDENTIAL' when 2 then 'RESTRICTED' when 3 then 'INTERNAL' else 'PUBLIC' end",
    "strict": "case {k} when 0 then 'RESTRICTED' when 1 then 'INTERNAL' when 2 then 'RESTRICTED' when 3 then 'CONFIDENTIAL' else 'PUBLIC' end",
    "loose": "case {k} when 0 then 'INTERNAL' when 1 then 'CONFIDENTIAL' when 2 then 'INTERNAL' when 3 then 'INTERNAL' else 'PUBLIC' end",
}
_DUCK_LEVELS = {k: v.format(k=_DUCK_KIND) for k, v in _DUCK_LEVELS.items()}
ENTRIES["e7_policy_as_of"] = (e7_policy_as_of, f"""
WITH p AS (SELECT *, case when ts >= TIMESTAMP '{_FROM[2]}' then 'loose' when ts >= TIMESTAMP '{_FROM[1]}' then 'strict'
  when ts >= TIMESTAMP '{_FROM[0]}' then 'default' end AS policy_name FROM events)
SELECT event_id, policy_name, case policy_name when 'loose' then '3' when 'strict' then '2' when 'default' then '1.0' end AS policy_version,
  case policy_name when 'loose' then {_DUCK_LEVELS['loose']} when 'strict' then {_DUCK_LEVELS['strict']}
    when 'default' then {_DUCK_LEVELS['default']} end AS classification
FROM p""")


def e6_policy_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that a new policy classifies otherwise, with both classifications."""
    events = table(spark, sf_dir, "events").selectExpr("event_id", f"{_TYPED} as entity_types", "'default' as policy_name", "'1.0' as policy_version")
    audit = events.withColumn("classification", F.expr(cls.classification("entity_types", GovernancePolicy())))
    return pt.reclassified(audit, GovernancePolicy(), _STRICT).select("event_id", "previous_classification", "classification", "policy_version")


ENTRIES["e6_policy_delta"] = (e6_policy_delta, f"""
SELECT event_id, {_DUCK_LEVELS['default']} AS previous_classification, {_DUCK_LEVELS['strict']} AS classification, '2' AS policy_version
FROM events WHERE {_DUCK_LEVELS['default']} <> {_DUCK_LEVELS['strict']}""")
