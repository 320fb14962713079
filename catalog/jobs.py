"""Text utilities, governance jobs and streams: K1, K2, L, M."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import duck
from catalog.governance import (
    ALERTING, DEFAULT, DUCK_ALERTS, DUCK_EVENTS, DUCK_STATE, event_audit, scan_and_protect,
)
from catalog.tables import BATCH_TS, CASE_TEXT, documents, table
from veilframe.functions import text as tx
from veilframe.operators.policy import GovernancePolicy
from veilframe.plans import jobs, nested, summaries
from veilframe.plans.protect import with_spans
from veilframe.session import shared_folder
from veilframe.streaming import escalation, streams

ENTRIES: dict = {}
DUCK_ALL = duck.spans(duck.DOCS)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "text")


# --- K: text utilities ---------------------------------------------------------------------------

def k1_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.expr(tx.truncated("text", 500)).alias("short"))


ENTRIES["k1_truncate"] = (k1_truncate, r"""
SELECT doc_id, CASE WHEN length(text) <= 500 THEN text
  ELSE regexp_replace(substr(text, 1, 500), ' [^ ]*\z', '') || '...' END AS short FROM documents""")


def k2_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.expr(tx.chunks("text"))).alias("no", "chunk"))
    return chunks.selectExpr("doc_id", "cast(no as bigint) as no", "chunk")


ENTRIES["k2_chunk"] = (k2_chunk, """
SELECT doc_id, cast(i AS bigint) AS no, substr(text, i * 4800 + 1, 5000) AS chunk FROM documents,
  unnest(range(0, CASE WHEN length(text) <= 5000 THEN 1 ELSE cast(ceil(length(text) / 4800.0) AS bigint) END)) r(i)""")

# --- L: jobs -------------------------------------------------------------------------------------

def l1_tiered_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.tiered_route(_docs(spark, sf_dir), "text", ["doc_id"], max_chars=0)
    return out.selectExpr("doc_id", "classification", "route", "released_text",
                          "array_join(entity_types, ',') as entity_types")


ENTRIES["l1_tiered_routing"] = (l1_tiered_routing, f"""
WITH sp AS MATERIALIZED ({DUCK_ALL}),
r AS ({duck.rewritten(duck.DOCS, 'SELECT * FROM sp', duck.default_replacement())}),
x AS ({duck.per_text(duck.DOCS, 'SELECT * FROM sp', duck.classification() + ''' AS classification,
  coalesce(string_agg(DISTINCT sp.entity_type, ',' ORDER BY sp.entity_type), '') AS entity_types''')})
SELECT x.id AS doc_id, classification, entity_types,
  CASE classification WHEN 'RESTRICTED' THEN 'BLOCKED' WHEN 'CONFIDENTIAL' THEN 'ANONYMIZED' ELSE 'PASSED' END AS route,
  CASE classification WHEN 'RESTRICTED' THEN NULL WHEN 'CONFIDENTIAL' THEN new_text ELSE d.text END AS released_text
FROM x JOIN r ON r.id = x.id JOIN documents d ON d.doc_id = x.id""")


def l1_written_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "routes")
    jobs.write_routed(jobs.tiered_route(_docs(spark, sf_dir), "text", ["doc_id"], max_chars=0), path)
    return spark.read.parquet(path).groupBy("route").agg(
        F.count(F.lit(1)).alias("texts"), F.count("released_text").alias("released"))


ENTRIES["l1_written_routes"] = (l1_written_routes, f"""
SELECT CASE classification WHEN 'RESTRICTED' THEN 'BLOCKED' WHEN 'CONFIDENTIAL' THEN 'ANONYMIZED' ELSE 'PASSED' END AS route,
  count(*) AS texts, count(*) FILTER (classification <> 'RESTRICTED') AS released
FROM ({DUCK_STATE}) GROUP BY 1""")


def l2_leak_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.leak_gate(_docs(spark, sf_dir), "text", max_chars=0).selectExpr(
        "doc_id", "cast(entities_found as bigint) as entities_found", "verdict")


ENTRIES["l2_leak_gate"] = (l2_leak_gate, f"""
SELECT id AS doc_id, entities_found, CASE WHEN entities_found > 0 THEN 'BLOCKED' ELSE 'CLEAN' END AS verdict
FROM ({DUCK_STATE})""")


def l2_gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = jobs.gate_summary(jobs.leak_gate(_docs(spark, sf_dir), "text", max_chars=0)).withColumn("corpus", F.lit("documents"))
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    items = jobs.gate_summary(jobs.leak_gate(bench, "text", max_chars=0)).withColumn("corpus", F.lit("benchmark"))
    return docs.unionByName(items)


_BENCH = "SELECT item_id AS id, text FROM benchmark"
ENTRIES["l2_gate_summary"] = (l2_gate_summary, " UNION ALL ".join(f"""
SELECT '{name}' AS corpus, count(*) AS texts, count(*) FILTER (n > 0) AS blocked,
  cast(sum(n) AS bigint) AS entities, CASE WHEN max(n) > 0 THEN 'BLOCKED' ELSE 'CLEAN' END AS verdict
FROM ({duck.per_text(src, duck.spans(src), 'count(sp.id) AS n')})"""
    for name, src in (("documents", duck.DOCS), ("benchmark", _BENCH))))

_WINDOW = "date_format(window_start, 'yyyy-MM-dd HH:mm:ss') as window_start"


def l3_compliance_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.compliance_evidence(event_audit(spark, sf_dir).where("classification = 'CONFIDENTIAL'"))
    return out.selectExpr(_WINDOW, "action", "classification", "records", "entities_found", "entities_anonymized")


ENTRIES["l3_compliance_evidence"] = (l3_compliance_evidence, f"""
SELECT strftime(time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start,
  action, classification, count(*) AS records, cast(sum(entities_found) AS bigint) AS entities_found,
  cast(sum(entities_anonymized) AS bigint) AS entities_anonymized
FROM ({DUCK_EVENTS}) WHERE classification = 'CONFIDENTIAL' GROUP BY 1, 2, 3""")


def l4_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return jobs.dashboard(docs, "text", "source", max_chars=0).selectExpr(
        "if(level = 2, 'ALL', source) as source", "if(level > 0, 'ALL', entity_type) as entity_type",
        "cast(level as bigint) as level", "cast(entities as bigint) as entities", "rows_affected")


ENTRIES["l4_dashboard"] = (l4_dashboard, f"""
SELECT coalesce(source, 'ALL') AS source, coalesce(entity_type, 'ALL') AS entity_type,
  cast(grouping(entity_type) + grouping(source) AS bigint) AS level, count(*) AS entities,
  count(DISTINCT id) AS rows_affected
FROM ({DUCK_ALL}) sp JOIN documents d ON d.doc_id = sp.id
GROUP BY ROLLUP (source, entity_type)""")


def l4_classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return jobs.classification_counts(scan_and_protect(docs, "text", ["doc_id"]), "source")


ENTRIES["l4_classifications"] = (l4_classifications, f"""
SELECT source, classification, count(*) AS texts, cast(sum(entities_found) AS bigint) AS entities
FROM ({DUCK_STATE}) x JOIN documents d ON d.doc_id = x.id GROUP BY source, classification""")


def l4_stored_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order texts summarised by quarter of the year into a store, each quarter a run, and merged over all."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority", "o_orderdate", f"{CASE_TEXT['MIXED']} as text", "quarter(o_orderdate) as quarter")
    path = shared_folder(spark, "summaries")
    for quarter in range(1, 5):
        for _ in range(2):  # a repeated run adds nothing
            part = orders.where(F.col("quarter") == quarter)
            summaries.store(summaries.summarized(part, "text", "o_orderpriority", "o_orderdate", entities=_SUMMED), path, f"Q{quarter}")
    out = summaries.merged(summaries.stored(spark, path))
    exact = with_spans(orders, "text", entities=_SUMMED).select("o_orderpriority", F.explode("spans").alias("s")).groupBy(
        F.col("o_orderpriority").alias("g"), F.col("s.entity_type").alias("t")).agg(F.count_distinct("s.text").alias("exact"))
    near = F.abs(F.col("distinct_values") - F.coalesce("exact", F.lit(0))) <= 0.05 * F.coalesce("exact", F.lit(0))
    joined = out.join(exact, (F.col("grp") == F.col("g")) & F.col("entity_type").eqNullSafe(F.col("t")), "left")
    return joined.select("grp", "entity_type", "texts", "rows_affected", "entities", near.alias("within_error"))


_SUMMED = ["EMAIL_ADDRESS", "US_SSN"]
_MIXED_ORDERS = f"SELECT o_orderkey AS id, {CASE_TEXT['MIXED']} AS text FROM orders"
ENTRIES["l4_stored_summaries"] = (l4_stored_summaries, f"""
WITH sp AS ({duck.spans(_MIXED_ORDERS, ["EMAIL_ADDRESS", "US_SSN"])})
SELECT o_orderpriority AS grp, NULL AS entity_type, count(*) AS texts, cast(0 AS bigint) AS rows_affected, cast(0 AS bigint) AS entities, true AS within_error
FROM orders GROUP BY 1
UNION ALL
SELECT o_orderpriority, entity_type, cast(0 AS bigint), count(DISTINCT id), count(*), true FROM sp JOIN orders ON o_orderkey = id GROUP BY ALL""")


def l5_corpus_governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    governed = scan_and_protect(_docs(spark, sf_dir), "text", ["doc_id"])
    out = jobs.labelled_slices(governed, table(spark, sf_dir, "labels"), "doc_id", ["quality", "toxic"])
    return out.selectExpr("cast(quality as bigint) as quality", "cast(toxic as bigint) as toxic",
                          "classification", "texts", "entities")


ENTRIES["l5_corpus_governance"] = (l5_corpus_governance, f"""
SELECT cast(quality AS bigint) AS quality, cast(toxic AS bigint) AS toxic, classification, count(*) AS texts,
  cast(sum(entities_found) AS bigint) AS entities
FROM ({DUCK_STATE}) x LEFT JOIN labels l ON l.doc_id = x.id GROUP BY ALL""")


def l6_role_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return jobs.classification_counts(scan_and_protect(turns, "text", ["conv_id", "turn"]), "role")


_TURNS = "SELECT conv_id * 100000 + turn AS id, text FROM conversations"
ENTRIES["l6_role_screening"] = (l6_role_screening, f"""
SELECT role, classification, count(*) AS texts, cast(sum(n) AS bigint) AS entities FROM (
  {duck.per_text(_TURNS, duck.spans(_TURNS), duck.classification() + ' AS classification, count(sp.id) AS n')}) x
JOIN conversations c ON c.conv_id * 100000 + c.turn = x.id GROUP BY role, classification""")


def l7_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.column_profile(table(spark, sf_dir, "pages"), max_chars=0).withColumn("table_name", F.lit("pages"))
    docs = jobs.column_profile(table(spark, sf_dir, "documents"), max_chars=0).withColumn("table_name", F.lit("documents"))
    return out.unionByName(docs)


_COLUMNS = [("pages", "page_id", "url"), ("pages", "page_id", "html"), ("documents", "doc_id", "text"),
            ("documents", "doc_id", "lang"), ("documents", "doc_id", "source")]
ENTRIES["l7_column_profile"] = (l7_column_profile, " UNION ALL ".join(f"""
SELECT '{t}' AS table_name, '{c}' AS column_name, entity_type, count(DISTINCT id) AS values_affected,
  count(*) AS entities
FROM ({duck.spans(f'SELECT {k} AS id, {c} AS text FROM {t}')}) GROUP BY entity_type""" for t, k, c in _COLUMNS))

_NESTED = ("""named_struct('mails', array(concat('u', o_custkey, '@example.com'), if(o_orderkey % 2 = 0, concat('v', o_orderkey, '@x.org'), null)),
               'text', if(o_orderkey % 3 = 0, 'call 555-123-4567', null), 'n', o_orderkey) as contact""",
  """map('ip', array(concat('10.0.', o_custkey % 200, '.1'), 'none')) as tags""",
  """if(o_orderkey % 7 = 0, concat('no json, z', o_orderkey, '@x.org'),
     concat('{"who":{"mail":"w', o_custkey, '@x.org","n":', o_orderkey, '},"log":["host 10.1.1.', o_orderkey % 200, '",{"note":"',
            if(o_orderkey % 5 = 0, 'SSN 219-09-9999', 'none'), '"}]}')) as raw""")


def l7_nested_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structs, arrays, maps and JSON of every order, profiled by path."""
    orders = table(spark, sf_dir, "orders").selectExpr(*_NESTED)
    return nested.path_profile(orders, json_columns=["raw"], entities=["EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS", "US_SSN"])


_PATHS = [("contact.mails[]", "EMAIL_ADDRESS", "1 + (o_orderkey % 2 = 0)::int"), ("contact.text", "PHONE_NUMBER", "(o_orderkey % 3 = 0)::int"),
          ("tags{}[]", "IP_ADDRESS", "1"), ("raw", "EMAIL_ADDRESS", "(o_orderkey % 7 = 0)::int"),
          ("raw.who.mail", "EMAIL_ADDRESS", "(o_orderkey % 7 <> 0)::int"), ("raw.log[]", "IP_ADDRESS", "(o_orderkey % 7 <> 0)::int"),
          ("raw.log[].note", "US_SSN", "(o_orderkey % 7 <> 0 and o_orderkey % 5 = 0)::int")]
ENTRIES["l7_nested_profile"] = (l7_nested_profile, " UNION ALL ".join(f"""
SELECT '{path}' AS path, '{kind}' AS entity_type, sum({n})::bigint AS values_affected, sum({n})::bigint AS entities FROM orders
HAVING sum({n}) > 0""" for path, kind, n in _PATHS))


def l7_json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value in the JSON properties of all events, with its path."""
    return nested.text_leaves(table(spark, sf_dir, "events"), ["props"], json_columns=["props"], numbers=True, keep=["event_id"])


ENTRIES["l7_json_texts"] = (l7_json_texts, """
SELECT event_id, 'props.' || key AS path, json_extract_string(props, '$.' || key) AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""")

# --- M: streams ----------------------------------------------------------------------------------

_DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
_EVENT_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
                 "props string")


def _doc_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.table_stream(spark, f"{sf_dir}/documents.parquet", _DOC_SCHEMA)


def _finish(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def m1_stream_protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.protect_stream(_doc_stream(spark, sf_dir), "text", ["doc_id"], batch_ts=BATCH_TS, max_chars=0)
    rows = out.select("doc_id", "classification", "entities_found", "protected_text")
    path = shared_folder(spark, "protected")
    _finish(streams.to_files(rows, path, shared_folder(spark, "protected-ck")))
    return spark.read.parquet(path).selectExpr(
        "doc_id", "classification", "cast(entities_found as bigint) as entities_found", "protected_text")


ENTRIES["m1_stream_protect"] = (m1_stream_protect, f"""
WITH sp AS MATERIALIZED ({DUCK_ALL}),
r AS ({duck.rewritten(duck.DOCS, 'SELECT * FROM sp', duck.default_replacement())}),
x AS ({duck.per_text(duck.DOCS, 'SELECT * FROM sp',
    duck.classification() + ' AS classification, count(sp.id) AS entities_found')})
SELECT x.id AS doc_id, classification, entities_found, new_text AS protected_text FROM x JOIN r ON r.id = x.id""")


def m2_windowed_audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows in append mode: a window comes out once the watermark has passed its end."""
    stream = streams.table_stream(spark, f"{sf_dir}/events.parquet", _EVENT_SCHEMA)
    audit = stream.selectExpr(
        "cast(ts as timestamp) as ts", "event_type as action",
        "if(user_id % 4 = 0, 'PUBLIC', 'RESTRICTED') as classification", "cast(value as int) as entities_found")
    counts = streams.windowed_counts(audit, "6 hours", "3 hours")
    path = shared_folder(spark, "windows")
    _finish(streams.to_files(counts, path, shared_folder(spark, "windows-ck")))
    return spark.read.parquet(path).selectExpr(
        _WINDOW, "action", "classification", "records", "entities_found")


ENTRIES["m2_windowed_audit_counts"] = (m2_windowed_audit_counts, """
WITH e AS (SELECT ts, event_type AS action, cast(trunc(value) AS bigint) AS n,
             CASE WHEN user_id % 4 = 0 THEN 'PUBLIC' ELSE 'RESTRICTED' END AS classification,
             time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01') AS b FROM events),
w AS (SELECT b - k * INTERVAL '3 hours' AS s, * FROM e, (VALUES (0), (1)) v(k))
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, action, classification, count(*) AS records,
  cast(sum(n) AS bigint) AS entities_found
FROM w WHERE s + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)
GROUP BY s, action, classification""")


def m3_alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document arrives twice; each alert leaves once."""
    docs = _doc_stream(spark, sf_dir)
    twice = docs.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "ts", F.lit(BATCH_TS).cast("timestamp")).select("doc_id", "text", "ts")
    governed = streams.protect_stream(twice, "text", ["doc_id"], policy=ALERTING, batch_ts=BATCH_TS, max_chars=0)
    alerts = streams.alert_stream(governed, ["doc_id"], "ts")
    path = shared_folder(spark, "alerts")
    writer = alerts.writeStream.foreachBatch(streams.append_batches(path)).option(
        "checkpointLocation", shared_folder(spark, "alerts-ck"))
    _finish(writer)
    return spark.read.parquet(path).selectExpr(
        "doc_id", "rule", "action", "level", "webhook_url", "classification",
        "cast(entities_found as bigint) as entities_found")


ENTRIES["m3_alert_stream"] = (m3_alert_stream, DUCK_ALERTS)


def m4_policy_hot_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive twice; the policy changes between the two micro-batches."""
    strict = GovernancePolicy(name="strict", version="2.0", entity_sensitivity={"HIGH": ("EMAIL_ADDRESS",)})
    served = iter([DEFAULT, strict])
    out, audit = shared_folder(spark, "swap"), shared_folder(spark, "swap-audit")
    run = streams.hot_swap(lambda: next(served), "text", ["doc_id"], out, audit, lambda i: BATCH_TS, max_chars=0)
    source, checkpoint = shared_folder(spark, "swap-source"), shared_folder(spark, "swap-ck")
    for _ in range(2):
        _docs(spark, sf_dir).write.mode("append").parquet(source)
        stream = streams.read_stream(spark, source, "doc_id bigint, text string")
        _finish(stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint))
    rows = spark.read.parquet(out)
    changes = spark.read.parquet(audit).count()
    return rows.groupBy("policy_applied", "policy_version").agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(F.col("classification") == "RESTRICTED").alias("restricted"),
    ).withColumn("policy_changes", F.lit(changes))


ENTRIES["m4_policy_hot_swap"] = (m4_policy_hot_swap, f"""
WITH sp AS MATERIALIZED ({DUCK_ALL})
SELECT 'default' AS policy_applied, '1.0' AS policy_version, count(*) AS texts,
  count(*) FILTER (classification = 'RESTRICTED') AS restricted, cast(1 AS bigint) AS policy_changes
FROM ({duck.per_text(duck.DOCS, 'SELECT * FROM sp', duck.classification() + ' AS classification')})
UNION ALL
SELECT 'strict', '2.0', (SELECT count(*) FROM documents), count(DISTINCT id) FILTER (entity_type = 'EMAIL_ADDRESS'), 1
FROM sp""")


def m3_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three RESTRICTED events of one type within half an hour, found on a stream in order of event time."""
    audit = event_audit(spark, sf_dir).join(table(spark, sf_dir, "events").selectExpr(
        "lpad(cast(event_id as string), 12, '0') as audit_id", "event_type as source"), "audit_id").select("source", "ts", "audit_id", "classification")
    # One more event a year later for every source: the stream judges what it knows to be complete.
    ends = audit.groupBy("source").agg(F.expr("max(ts) + interval 1 year").alias("ts"), F.lit("end").alias("audit_id"), F.lit("PUBLIC").alias("classification"))
    folder, out = shared_folder(spark, "escalation-in"), shared_folder(spark, "escalation-out")
    audit.unionByName(ends).write.parquet(folder)
    keys = {"spark.sql.streaming.stateStore.providerClass": escalation.PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        stream = streams.read_stream(spark, folder, "source string, ts timestamp, audit_id string, classification string")
        found = escalation.escalations(stream, "source", least=3, span="30 minutes")
        _finish(streams.to_files(found, out, shared_folder(spark, "escalation-check")))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(escalation.OUTPUT).parquet(out).selectExpr("source", "kind", "record_id", "cast(restricted as bigint) as restricted")


ENTRIES["m3_escalations"] = (m3_escalations, """
SELECT source, 'escalation' AS kind, record_id, n AS restricted FROM (
  SELECT event_type AS source, lpad(cast(event_id AS string), 12, '0') AS record_id,
    count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTES PRECEDING AND CURRENT ROW) AS n
  FROM events WHERE user_id % 4 = 3) WHERE n >= 3""")
