"""Sources and detection: A1, A4, B, C, D."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog import duck
from catalog.tables import CASE_TEXT, case_sql, cases, documents
from veilframe.functions.spans import SPAN_ARRAY, entity_types, resolve_overlaps
from veilframe.operators.custom_detectors import arrow_detector
from veilframe.operators.detect import detect
from veilframe.operators.recognizers import RecognizerRegistry
from veilframe.plans import protect
from veilframe.plans.protect import explode_spans, split_by_size
from veilframe.plans.span_tables import collect_spans, detect_long, term_spans
from veilframe.sources.readers import read_texts

ENTRIES: dict = {}

# Whole texts, however long; the size limit has queries of its own (a4, i1).
analyze = partial(protect.analyze, max_chars=0)
with_spans = partial(protect.with_spans, max_chars=0)

FOUND = "array_join(array_sort(transform(spans, s -> s.text)), '|')"
DUCK_FOUND = "coalesce(string_agg(sp.v, '|' ORDER BY sp.v), '') AS found"
DUCK_N = "count(sp.id) AS n"


def _per_text(df: DataFrame, key: str = "id") -> DataFrame:
    return df.selectExpr(key, "cast(size(spans) as bigint) as n", f"{FOUND} as found")


def _span_rows(df: DataFrame, key: str) -> DataFrame:
    return explode_spans(df, [key]).selectExpr(
        key, "cast(start as bigint) as start_pos", "cast(end as bigint) as end_pos", "entity_type",
        "score", "text as found",
    )


def _duck_rows(key: str, span_sql: str) -> str:
    return (
        f"SELECT id AS {key}, s AS start_pos, e AS end_pos, entity_type, score, v AS found "
        f"FROM ({span_sql})"
    )


# --- sources -----------------------------------------------------------------------------------

def a1_text_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read_texts(
        spark, f"{sf_dir}/documents.parquet", id_cols=["doc_id"], text_col="text", keep=["lang"]
    )
    return texts.selectExpr("doc_id", "lang", "cast(char_length(text) as bigint) as chars")


ENTRIES["a1_text_input"] = (
    a1_text_input, "SELECT doc_id, lang, length(text) AS chars FROM documents")


def a4_size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    accepted, rejected = split_by_size(docs, "text", 5000)
    none = F.lit(None).cast("string").alias("error")
    return accepted.select("doc_id", F.lit(True).alias("accepted"), none).unionByName(
        rejected.select("doc_id", F.lit(False).alias("accepted"), "error")
    )


ENTRIES["a4_size_guard"] = (a4_size_guard, """
SELECT doc_id, length(text) <= 5000 AS accepted,
  CASE WHEN length(text) > 5000 THEN 'text too large: ' || length(text) ||
    ' characters, limit 5000' END AS error
FROM documents""")

# --- detection ---------------------------------------------------------------------------------

def b1_detect_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return _span_rows(with_spans(docs, entities=["EMAIL_ADDRESS"]), "doc_id")


ENTRIES["b1_detect_email"] = (
    b1_detect_email, _duck_rows("doc_id", duck.spans(duck.DOCS, ["EMAIL_ADDRESS"])))


def b1_detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return _span_rows(with_spans(docs), "doc_id")


ENTRIES["b1_detect_all"] = (b1_detect_all, _duck_rows("doc_id", duck.spans(duck.DOCS)))


def b1_detect_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return _span_rows(with_spans(pages, "html"), "page_id")


ENTRIES["b1_detect_html"] = (
    b1_detect_html, _duck_rows("page_id", duck.spans("SELECT page_id AS id, html AS text FROM pages")))


def b2_entity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return _per_text(with_spans(docs, entities=["IP_ADDRESS", "EMAIL_ADDRESS"]), "doc_id")


ENTRIES["b2_entity_filter"] = (b2_entity_filter, duck.per_text(
    duck.DOCS, duck.spans(duck.DOCS, ["IP_ADDRESS", "EMAIL_ADDRESS"]), f"{DUCK_N}, {DUCK_FOUND}"
).replace("SELECT t.id,", "SELECT t.id AS doc_id,", 1))


def b3_score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return _per_text(with_spans(docs, score_threshold=0.7), "doc_id")


ENTRIES["b3_score_threshold"] = (b3_score_threshold, duck.per_text(
    duck.DOCS, duck.spans(duck.DOCS, threshold=0.7), f"{DUCK_N}, {DUCK_FOUND}"
).replace("SELECT t.id,", "SELECT t.id AS doc_id,", 1))


def _with_token(score: float = 0.85, **kw) -> RecognizerRegistry:
    return RecognizerRegistry().with_pattern(
        "secret_token", "SECRET_TOKEN", [duck.HEX_TOKEN], score=score, line_bounded=True, **kw
    )


def _duck_token(score: float = 0.85, src: str = duck.DOCS) -> str:
    return duck.rule_sql(src, "SECRET_TOKEN", (duck.HEX_TOKEN, "true", score, ()), 0.4)


def b4_span_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = with_spans(docs, registry=_with_token(0.876543), entities=["SECRET_TOKEN", "PHONE_NUMBER"])
    rows = found.select("doc_id", F.col("text").alias("body"), F.explode("spans").alias("s"))
    return rows.selectExpr(
        "doc_id", "s.score as score", "s.text as found",
        "substring(body, s.start + 1, s.end - s.start) = s.text as offsets_fit",
    )


ENTRIES["b4_span_text"] = (b4_span_text, f"""
SELECT id AS doc_id, round(score, 4) AS score, v AS found, true AS offsets_fit
FROM ({duck.spans(duck.DOCS, ['PHONE_NUMBER'], extra=_duck_token(0.876543))})""")


def b5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    registry = _with_token(languages=["en", "de"])
    found = with_spans(
        docs, registry=registry, language_col="lang", entities=["SECRET_TOKEN", "EMAIL_ADDRESS"]
    )
    return found.selectExpr(
        "doc_id", "lang", "cast(size(spans) as bigint) as n", f"{FOUND} as found"
    )


ENTRIES["b5_language"] = (b5_language, f"""
SELECT t.doc_id, t.lang, {DUCK_N}, {DUCK_FOUND} FROM documents t LEFT JOIN (
  {duck.spans(duck.DOCS, ['EMAIL_ADDRESS'], extra=_duck_token())}) sp
ON sp.id = t.doc_id AND (sp.entity_type <> 'SECRET_TOKEN' OR t.lang IN ('en', 'de'))
GROUP BY t.doc_id, t.lang""")


def b6_entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(documents(spark, sf_dir).select("doc_id", "text"))
    return found.selectExpr("doc_id", f"array_join({entity_types('spans')}, ',') as entity_types")


ENTRIES["b6_entity_types"] = (b6_entity_types, duck.per_text(
    duck.DOCS, duck.spans(duck.DOCS),
    "coalesce(string_agg(DISTINCT sp.entity_type, ',' ORDER BY sp.entity_type), '') AS entity_types",
).replace("SELECT t.id,", "SELECT t.id AS doc_id,", 1))


def b7_entities_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(documents(spark, sf_dir).select("doc_id", "text"))
    return found.selectExpr("doc_id", "cast(size(spans) as bigint) as entities_found")


ENTRIES["b7_entities_found"] = (b7_entities_found, duck.per_text(
    duck.DOCS, duck.spans(duck.DOCS), "count(sp.id) AS entities_found",
).replace("SELECT t.id,", "SELECT t.id AS doc_id,", 1))


def b8_supported_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = explode_spans(with_spans(documents(spark, sf_dir).select("doc_id", "text")), ["doc_id"])
    used = found.groupBy("entity_type").agg(F.count(F.lit(1)).alias("spans"))
    supported = RecognizerRegistry().supported_df(spark, "en")
    return supported.join(used, "entity_type", "left").fillna(0, ["spans"])


ENTRIES["b8_supported_entities"] = (b8_supported_entities, f"""
SELECT l.entity_type, count(sp.id) AS spans
FROM (SELECT unnest([{', '.join(repr(t) for t in duck.ALL_TYPES)}]) AS entity_type) l
LEFT JOIN ({duck.spans(duck.DOCS)}) sp ON sp.entity_type = l.entity_type GROUP BY l.entity_type""")


def b9_redacted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analyze(documents(spark, sf_dir).select("doc_id", "text"), "text", ["doc_id"])
    rows = out.select("doc_id", F.explode("results").alias("r")).select("doc_id", "r.*")
    return rows.selectExpr(
        "doc_id", "cast(start as bigint) as start_pos", "cast(end as bigint) as end_pos",
        "entity_type", "score",
    )


ENTRIES["b9_redacted_results"] = (b9_redacted_results, f"""
SELECT id AS doc_id, s AS start_pos, e AS end_pos, entity_type, score FROM ({duck.spans(duck.DOCS)})""")


def b10_explode_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(documents(spark, sf_dir).select("doc_id", "text"))
    return explode_spans(found, ["doc_id"]).selectExpr(
        "doc_id", "cast(span_no as bigint) as span_no", "entity_type", "text as found"
    )


ENTRIES["b10_explode_spans"] = (b10_explode_spans, f"""
SELECT id AS doc_id, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS span_no, entity_type,
  v AS found FROM ({duck.spans(duck.DOCS)})""")


def b11_custom_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return _span_rows(with_spans(docs, registry=_with_token(0.9)), "doc_id")


ENTRIES["b11_custom_pattern"] = (
    b11_custom_pattern, _duck_rows("doc_id", duck.spans(duck.DOCS, extra=_duck_token(0.9))))


def b12_removed_recognizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    registry, removed = _with_token(0.9).remove("secret_token")
    return _per_text(with_spans(docs, registry=registry), "doc_id").withColumn(
        "removed", F.lit(removed)
    )


ENTRIES["b12_removed_recognizer"] = (b12_removed_recognizer, duck.per_text(
    duck.DOCS, duck.spans(duck.DOCS), f"{DUCK_N}, {DUCK_FOUND}, true AS removed"
).replace("SELECT t.id,", "SELECT t.id AS doc_id,", 1))


def b13_custom_recognizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = _with_token(0.9).with_pattern("hash_mark", "HASH_MARK", [r"#{3,}", r"\*{3,}"])
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = explode_spans(
        with_spans(docs, registry=registry, entities=["SECRET_TOKEN", "HASH_MARK"]), ["doc_id"]
    )
    used = found.groupBy("entity_type").agg(F.count(F.lit(1)).alias("spans"))
    listed = registry.custom_df(spark).withColumn("pattern_count", F.col("pattern_count").cast("bigint"))
    return listed.join(used, "entity_type", "left").fillna(0, ["spans"])


ENTRIES["b13_custom_recognizers"] = (b13_custom_recognizers, """
SELECT 'secret_token' AS name, 'SECRET_TOKEN' AS entity_type, cast(1 AS bigint) AS pattern_count,
  cast(sum(len(regexp_extract_all(text, 'token = "[0-9a-f]{40}"'))) AS bigint) AS spans FROM documents
UNION ALL
SELECT 'hash_mark', 'HASH_MARK', 2, cast(sum(len(regexp_extract_all(text, '#{3,}'))
  + len(regexp_extract_all(text, '\\*{3,}'))) AS bigint) FROM documents""")


def b14_context_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_rows(with_spans(cases(spark, sf_dir, "US_BANK_NUMBER"), score_threshold=0.0,
                                 entities=["US_BANK_NUMBER"]), "id")


ENTRIES["b14_context_boost"] = (b14_context_boost, _duck_rows(
    "id", duck.spans(case_sql("US_BANK_NUMBER"), ["US_BANK_NUMBER"], 0.0)))

# --- one query per entity type, on texts derived from `orders` ------------------------------------

def _case_query(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _per_text(with_spans(cases(spark, sf_dir, kind), entities=[kind]))

    return run, duck.per_text(
        case_sql(kind), duck.spans(case_sql(kind), [kind]), f"{DUCK_N}, {DUCK_FOUND}"
    )


_TYPE_IDS = {
    "US_SSN": 1, "CREDIT_CARD": 2, "US_BANK_NUMBER": 3, "IBAN_CODE": 4, "CRYPTO": 5, "US_PASSPORT": 6,
    "UK_NHS": 7, "MEDICAL_LICENSE": 8, "EMAIL_ADDRESS": 9, "PHONE_NUMBER": 10, "PERSON": 11,
    "US_DRIVER_LICENSE": 12, "IP_ADDRESS": 13, "LOCATION": 14, "URL": 15, "DATE_TIME": 16, "NRP": 17,
    "TITLE": 18,
}
for _kind, _no in _TYPE_IDS.items():
    ENTRIES[f"c{_no}_{_kind.lower()}"] = _case_query(_kind)
assert set(_TYPE_IDS) == set(duck.ALL_TYPES) == set(CASE_TEXT) - {"MIXED"}


def c2_credit_card_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return _span_rows(with_spans(docs, entities=["CREDIT_CARD"]), "doc_id")


ENTRIES["c2_credit_card_documents"] = (
    c2_credit_card_documents, _duck_rows("doc_id", duck.spans(duck.DOCS, ["CREDIT_CARD"])))


def c15_url_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return _per_text(with_spans(pages, "url", entities=["URL"]), "page_id")


ENTRIES["c15_url_pages"] = (c15_url_pages, duck.per_text(
    "SELECT page_id AS id, url AS text FROM pages",
    duck.spans("SELECT page_id AS id, url AS text FROM pages", ["URL"]), f"{DUCK_N}, {DUCK_FOUND}",
).replace("SELECT t.id,", "SELECT t.id AS page_id,", 1))


def _customer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = "'Customer#' || lpad(cast(o_custkey * 2 as string), 9, '0')"
    return orders.selectExpr(
        "o_orderkey as id", f"'Bill of ' || {name} || ', shipped by ' || {name} || '!' as text"
    )


def c11_term_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name list that grows with the data: customers named in order texts."""
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "c_name as term", "'PERSON' as entity_type"
    )
    spans = term_spans(_customer_texts(spark, sf_dir), "text", ["id"], names)
    return spans.selectExpr(
        "id", "cast(start as bigint) as start_pos", "cast(end as bigint) as end_pos", "entity_type",
        "score", "text as found",
    )


ENTRIES["c11_term_table"] = (c11_term_table, """
WITH t AS (SELECT o_orderkey AS id, 'Customer#' || lpad(cast(o_custkey * 2 AS string), 9, '0') AS name
           FROM orders),
m AS (SELECT id, name FROM t WHERE name IN (SELECT c_name FROM customer))
SELECT id, cast(8 AS bigint) AS start_pos, cast(8 + length(name) AS bigint) AS end_pos,
  'PERSON' AS entity_type, cast(0.6 AS double) AS score, name AS found FROM m
UNION ALL
SELECT id, 8 + length(name) + 13, 8 + length(name) + 13 + length(name), 'PERSON', 0.6, name FROM m""")


def c11_protected_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from a table, rewritten and classified by the same call as patterns."""
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_name as term", "'PERSON' as entity_type")
    texts = _customer_texts(spark, sf_dir)
    out = protect.scan_and_protect(texts, "text", ["id"], spans=term_spans(texts, "text", ["id"], names))
    return out.selectExpr("id", "protected_text", "classification", "cast(entities_found as bigint) as entities_found")


ENTRIES["c11_protected_terms"] = (c11_protected_terms, """
WITH t AS (SELECT o_orderkey AS id, 'Customer#' || lpad(cast(o_custkey * 2 AS string), 9, '0') AS name
           FROM orders),
m AS (SELECT id, name, name IN (SELECT c_name FROM customer) AS listed FROM t)
SELECT id, 'Bill of ' || CASE WHEN listed THEN '[PERSON]' ELSE name END || ', shipped by '
    || CASE WHEN listed THEN '[PERSON]' ELSE name END || '!' AS protected_text,
  CASE WHEN listed THEN 'CONFIDENTIAL' ELSE 'PUBLIC' END AS classification,
  cast(CASE WHEN listed THEN 2 ELSE 0 END AS bigint) AS entities_found
FROM m""")


# Order, line and part alone do not tell all rows of `lineitem` apart.
_ITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def c14_term_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word terms from `part` in texts derived from `lineitem`; longer terms win."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    terms = parts.selectExpr("p_name as term", "'PRODUCT' as entity_type").unionByName(
        parts.selectExpr("split(p_name, ' ')[1] as term", "'KIND' as entity_type")
    )
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        *_ITEM_KEY
    )
    texts = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        *_ITEM_KEY,
        "'Sent ' || p_name || ' and a ' || split(p_name, ' ')[1] || '.' as text",
    )
    spans = term_spans(
        texts, "text", _ITEM_KEY, terms, capitalised=False
    )
    return spans.groupBy("entity_type", F.col("text").alias("found")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("start").alias("start_sum")
    )


ENTRIES["c14_term_phrases"] = (c14_term_phrases, """
WITH x AS (SELECT p_name, split_part(p_name, ' ', 2) AS kind,
             l_orderkey, l_linenumber, l_partkey
           FROM lineitem JOIN part ON p_partkey = l_partkey),
y AS (SELECT 'PRODUCT' AS entity_type, p_name AS found, 5 AS start_pos FROM x
      UNION ALL SELECT 'KIND', kind, 5 + length(p_name) + 7 FROM x)
SELECT entity_type, found, count(*) AS n, cast(sum(start_pos) AS bigint) AS start_sum FROM y
GROUP BY entity_type, found""")

def c11_name_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People, countries and regions from three tables, in place of the built-in lists, in one protecting call."""
    customers, nations, regions = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "region"))
    names = customers.selectExpr("c_name as term", "'PERSON' as entity_type").unionByName(
        nations.selectExpr("n_name as term", "'LOCATION' as entity_type")).unionByName(
        regions.selectExpr("r_name as term", "'LOCATION' as entity_type"))
    texts = customers.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).join(
        F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("c_custkey as id", _NAMED_TEXT)
    out = protect.scan_and_protect(texts, "text", ["id"], names=names, with_spans_col=True)
    return out.selectExpr("id", "protected_text", "classification", "cast(entities_found as bigint) as entities_found",
                          "array_join(transform(spans, s -> concat(s.entity_type, '@', s.start, '-', s.end)), ' ') as places")


_NAMED_TEXT = ("'Dear ' || c_name || 'X or ' || c_name || ' of ' || n_name || ' (' || r_name || 'S), John of ' || lower(n_name) || ' ' || "
               "n_name || ' ' || r_name || ', Paris' as text")

ENTRIES["c11_name_tables"] = (c11_name_tables, """
WITH t AS (SELECT c_custkey AS id, c_name, n_name, r_name, lower(n_name) AS low, length(c_name) AS c, length(n_name) AS n, length(r_name) AS r
           FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT *, 10 + c AS a, 10 + c + c + 4 AS b, 10 + c + c + 4 + n + 2 + r + 12 + n + 1 AS d FROM t)
SELECT id, 'Dear ' || c_name || 'X or [PERSON] of [LOCATION] (' || r_name || 'S), John of ' || low || ' [LOCATION] [LOCATION], Paris' AS protected_text,
  'CONFIDENTIAL' AS classification, cast(4 AS bigint) AS entities_found,
  concat_ws(' ', 'PERSON@' || a || '-' || (a + c), 'LOCATION@' || b || '-' || (b + n), 'LOCATION@' || d || '-' || (d + n),
            'LOCATION@' || (d + n + 1) || '-' || (d + n + 1 + r)) AS places
FROM p""")

# --- overlaps, rewriting, sections -----------------------------------------------------------------

_OVERLAPPING = ["CREDIT_CARD", "US_BANK_NUMBER", "URL", "EMAIL_ADDRESS", "PHONE_NUMBER", "US_SSN", "PERSON"]


def d1_resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span seen, and whether it is kept: texts are searched once, and a text alone with its id needs no join."""
    texts = cases(spark, sf_dir, "MIXED").where("text is not null").withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("id")))
    raw = with_spans(texts, entities=_OVERLAPPING, resolve=False).where("size(spans) > 0")
    # One-row explode: settled once for each text, not once for each span.
    both = raw.select("id", "copies", "spans", F.explode(F.expr(f"array({resolve_overlaps('spans')})")).alias("best"))
    marked = both.selectExpr(
        "id", "copies", "explode(transform(spans, s -> struct(s as s, array_contains(best, s) as kept))) as m",
    ).selectExpr(
        "id", "copies", "cast(m.s.start as bigint) as start_pos", "cast(m.s.end as bigint) as end_pos",
        "m.s.entity_type as entity_type", "m.s.score as score", "m.s.text as found", "m.kept as kept")
    # Texts that share an id are compared by the spans' values.
    keys = ["id", "start_pos", "end_pos", "entity_type", "score", "found"]
    shared = marked.where("copies > 1")
    compared = shared.select(keys).join(shared.where("kept").select(*keys, "kept"), keys, "left").fillna(False, ["kept"])
    return marked.where("copies = 1").select(*keys, "kept").unionByName(compared)


ENTRIES["d1_resolve_overlaps"] = (d1_resolve_overlaps, f"""
WITH seen AS ({duck.spans(case_sql('MIXED'), _OVERLAPPING, resolve=False)}),
kept AS ({duck.spans(case_sql('MIXED'), _OVERLAPPING)})
SELECT id, s AS start_pos, e AS end_pos, entity_type, score, v AS found,
  EXISTS (SELECT 1 FROM kept k WHERE k.id = seen.id AND k.s = seen.s AND k.e = seen.e
          AND k.entity_type = seen.entity_type) AS kept
FROM seen""")


def k3_chunked_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    spans = detect_long(docs, "text", ["doc_id"], section_chars=1000)
    return spans.selectExpr(
        "doc_id", "cast(start as bigint) as start_pos", "cast(end as bigint) as end_pos",
        "entity_type", "score", "text as found",
    )


ENTRIES["k3_chunked_detection"] = (
    k3_chunked_detection, _duck_rows("doc_id", duck.spans(duck.DOCS)))


def k3_collected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    spans = collect_spans(detect_long(docs, "text", ["doc_id"], section_chars=2000, spread=8), ["doc_id"], docs)
    return _per_text(spans, "doc_id")


ENTRIES["k3_collected_spans"] = (k3_collected_spans, duck.per_text(
    duck.DOCS, duck.spans(duck.DOCS), f"{DUCK_N}, {DUCK_FOUND}",
).replace("SELECT t.id,", "SELECT t.id AS doc_id,", 1))


def k3_protected_long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rewritten from spans that were found section by section."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    spans = detect_long(docs, "text", ["doc_id"], section_chars=1000)
    out = protect.scan_and_protect(docs, "text", ["doc_id"], spans=spans, registry=RecognizerRegistry(()))
    return out.selectExpr("doc_id", "protected_text", "classification", "cast(entities_found as bigint) as entities_found")


ENTRIES["k3_protected_long_texts"] = (k3_protected_long_texts, f"""
WITH sp AS MATERIALIZED ({duck.spans(duck.DOCS)}),
r AS ({duck.rewritten(duck.DOCS, 'SELECT * FROM sp', duck.default_replacement())}),
x AS ({duck.per_text(duck.DOCS, 'SELECT * FROM sp',
    duck.classification() + ' AS classification, count(sp.id) AS entities_found')})
SELECT x.id AS doc_id, new_text AS protected_text, classification, entities_found
FROM x JOIN r ON r.id = x.id""")

# --- extension points ---------------------------------------------------------------------------

def n1_column_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return _per_text(docs.select("doc_id", detect("text", entities=["PHONE_NUMBER"]).alias("spans")), "doc_id")


ENTRIES["n1_column_builder"] = (n1_column_builder, duck.per_text(
    duck.DOCS, duck.spans(duck.DOCS, ["PHONE_NUMBER"]), f"{DUCK_N}, {DUCK_FOUND}"
).replace("SELECT t.id,", "SELECT t.id AS doc_id,", 1))


def _find_tokens(texts):
    import re

    pattern = re.compile(duck.HEX_TOKEN)
    return texts.map(lambda t: [
        {"start": m.start(), "end": m.end(), "entity_type": "SECRET_TOKEN", "score": 0.85, "text": m.group()}
        for m in pattern.finditer(t or "")
    ])


def n2_arrow_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return _span_rows(with_spans(docs, detectors=[arrow_detector(_find_tokens)]), "doc_id")


ENTRIES["n2_arrow_detector"] = (
    n2_arrow_detector, _duck_rows("doc_id", duck.spans(duck.DOCS, extra=_duck_token())))


def n2_native_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector written with Column functions: the whole text when it is one long word."""

    def detector(text):
        span = F.struct(
            F.lit(0).alias("start"), F.char_length(text).alias("end"), F.lit("BLOB").alias("entity_type"),
            F.lit(0.5).alias("score"), text.alias("text"),
        )
        return F.when(~text.contains(" ") & ~text.contains("\n"), F.array(span)).cast(SPAN_ARRAY)

    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = with_spans(docs, entities=["BLOB", "EMAIL_ADDRESS"], detectors=[detector])
    return found.selectExpr("doc_id", "cast(size(spans) as bigint) as n", f"{FOUND} as found")


ENTRIES["n2_native_detector"] = (n2_native_detector, duck.per_text(duck.DOCS, duck.spans(
    duck.DOCS, ["EMAIL_ADDRESS"], extra=f"""SELECT id, cast(0 AS bigint) AS s, length(text) AS e,
    'BLOB' AS entity_type, cast(0.5 AS double) AS score, text AS v FROM ({duck.DOCS})
    WHERE NOT contains(text, ' ') AND NOT contains(text, chr(10))"""), f"{DUCK_N}, {DUCK_FOUND}"
).replace("SELECT t.id,", "SELECT t.id AS doc_id,", 1))
