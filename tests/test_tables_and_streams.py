"""Text helpers, readers, span tables, streams."""

import itertools

import pytest
from conftest import texts
from pyspark.sql import functions as F

from veilframe import GovernancePolicy, explode_spans, read_texts, scan_and_protect, with_spans
from veilframe.functions import text as tx
from veilframe.plans import jobs
from veilframe.plans.span_tables import collect_spans, detect_long, resolve_table, term_spans
from veilframe.session import shared_folder
from veilframe.streaming import streams

TS = "2026-01-01 00:00:00"


def _truncate(text, n):
    return text if len(text) <= n else text[:n].rsplit(" ", 1)[0] + "..."


def _chunk(text, size, overlap):
    if len(text) <= size:
        return [text]
    return [text[s:s + size] for s in range(0, len(text), size - overlap)]


def test_truncate_and_chunk(docs):
    rows = docs.select("text", F.expr(tx.truncated("text", 120)).alias("cut"), F.expr(tx.chunks("text", 300, 40)).alias("parts")).collect()
    for r in rows:
        assert r["cut"] == _truncate(r["text"], 120)
        assert r["parts"] == _chunk(r["text"], 300, 40)


def test_truncate_edges(spark):
    frame = texts(spark, "", "abc", "abcdef", "ab cd", "ab\ncd ef\n", None)
    got = [r[0] for r in frame.orderBy("id").select(F.expr(tx.truncated("text", 4))).collect()]
    assert got == ["", "abc", "abcd...", "ab...", "ab\nc...", None]


@pytest.mark.parametrize("size, overlap", [(10, 10), (10, 11), (0, 0), (5, -1)])
def test_chunk_arguments(size, overlap):
    with pytest.raises(ValueError):
        tx.chunks("text", size, overlap)


def test_sections_cover_the_text(docs):
    for r in docs.select("text", F.expr(tx.sections("text", 200, "\\n")).alias("cut")).collect():
        assert "".join(r["cut"]) == r["text"]
        assert all(c[-1] == "\n" and len(c) > 200 for c in r["cut"][:-1])


def _rows(frame, *keys):
    return sorted(tuple(r) for r in frame.select(*keys, "start", "end", "entity_type", "score", "text").collect())


@pytest.mark.parametrize("size", [1, 50, 700])
def test_long_texts_like_whole_texts(docs, spark, size):
    context = "my bank account\n" + "x" * 30 + "\n123456789012\n"
    extra = texts(spark, context * 4, "a@b.co\n" * 50, "", "\n\n").selectExpr(
        "cast(-1 - id as bigint) as doc_id", "text", "'en' as lang")
    every = docs.unionByName(extra)
    whole = explode_spans(with_spans(every), ["doc_id"])
    assert _rows(detect_long(every, "text", ["doc_id"], section_chars=size), "doc_id") == _rows(whole, "doc_id")


def test_patterns_that_cross_lines(spark):
    from veilframe import RecognizerRegistry

    registry = RecognizerRegistry().with_pattern("x", "BLOCK", [r"BEGIN\n.*\nEND"]).with_pattern("y", "ANCHORED", ["^q"])
    frame = texts(spark, "a\nBEGIN\nsecret\nEND\nb " * 30)
    for entities in (["BLOCK"], ["BLOCK", "ANCHORED"]):
        out = detect_long(frame, "text", ["id"], section_chars=2, registry=registry, entities=entities)
        assert [r["text"] for r in out.collect()] == ["BEGIN\nsecret\nEND"] * 30


def test_resolve_table_like_rows(docs):
    raw = with_spans(docs, resolve=False)
    kept = resolve_table(explode_spans(raw, ["doc_id"]).drop("span_no"), ["doc_id"])
    assert _rows(kept, "doc_id") == _rows(explode_spans(with_spans(docs), ["doc_id"]), "doc_id")
    back = collect_spans(kept, ["doc_id"])
    assert back.where("size(spans) = 0").count() == 0


def test_term_spans(spark):
    terms = spark.createDataFrame(
        [("New York", "LOCATION"), ("York", "LOCATION"), ("Ana María López", "PERSON"), ("red widget", "PRODUCT")],
        "term string, entity_type string")
    frame = texts(spark, "In New York, near York; New  York.", "Ana María López and red widget", "New\nYork", None)
    got = sorted((r["id"], r["start"], r["text"]) for r in term_spans(frame, "text", ["id"], terms).collect())
    assert got == [(0, 3, "New York"), (0, 18, "York"), (0, 29, "York"), (1, 0, "Ana María López"), (2, 4, "York")]
    lower = term_spans(frame, "text", ["id"], terms, capitalised=False)
    assert lower.where("entity_type = 'PRODUCT'").first()["start"] == 20


def test_salted_term_join_finds_the_same(spark, docs, monkeypatch):
    from veilframe.plans import span_tables

    frame = docs.select("doc_id", "text").unionByName(
        spark.range(2000).selectExpr("-1 - id as doc_id", "'Hot Hot word Hot' as text"))
    terms = spark.createDataFrame([("Hot", "X"), ("Hot Hot", "X"), ("The", "Y")], "term string, entity_type string")
    broadcast = term_spans(frame, "text", ["doc_id"], terms)
    assert "BroadcastHashJoin" in broadcast._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(span_tables, "BROADCAST_BYTES", -1)
    salted = term_spans(frame, "text", ["doc_id"], terms)
    assert _rows(salted, "doc_id") == _rows(broadcast, "doc_id")
    assert salted.where("text = 'Hot Hot'").count() == 2000


def test_salted_terms_are_not_broadcast(spark, monkeypatch):
    """Spark's estimate does not count the salts' copies: it broadcast a list of 900,000 names sixteen times over."""
    from veilframe.plans import span_tables

    frame = texts(spark, "Bill of Ann, paid", "Bob")
    terms = spark.createDataFrame([("Ann", "PERSON"), ("Bob", "PERSON")], "term string, entity_type string")
    monkeypatch.setattr(span_tables, "BROADCAST_BYTES", -1)
    out = term_spans(frame, "text", ["id"], terms)
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"], r["start"], r["text"]) for r in out.collect()) == [(0, 8, "Ann"), (1, 0, "Bob")]


def test_runs_of_a_span_table_are_settled_once(spark):
    frame = spark.createDataFrame(
        [(1, 0, 4, "A", 0.5, "abcd"), (1, 2, 9, "A", 0.9, "cdefghi"), (1, 9, 12, "B", 0.5, "jkl"), (2, 3, 5, "A", 0.4, "xy"),
         (None, 0, 2, "A", 0.4, "no"), (None, 0, 2, "A", 0.4, "no")],
        "id int, start int, end int, entity_type string, score double, text string")
    kept = resolve_table(frame, ["id"])
    assert kept.columns == frame.columns
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = sorted((r["id"] or 0, r["start"], r["end"]) for r in kept.collect())
    assert got == [(0, 0, 2), (1, 2, 9), (1, 9, 12), (2, 3, 5)]


def test_overlap_query_searches_once(spark, tmp_path, monkeypatch):
    """Also where ids repeat, and where key columns are null, the rows are those of a join of all spans with those kept."""
    from catalog import detection
    from catalog.tables import cases

    calls, plain = [], detection.with_spans
    monkeypatch.setattr(detection, "with_spans", lambda *a, **k: calls.append(1) or plain(*a, **k))
    keys = [(i, i * 7) for i in range(30)] + [(3, 21), (3, 21), (4, 29), (None, 5), (None, 5), (6, None), (6, 42)]
    spark.createDataFrame(keys, "o_orderkey bigint, o_custkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    got = detection.d1_resolve_overlaps(spark, str(tmp_path))
    assert len(calls) == 1
    texts_in = cases(spark, str(tmp_path), "MIXED")
    kept = detection._span_rows(plain(texts_in, entities=detection._OVERLAPPING), "id").withColumn("kept", F.lit(True))
    seen = detection._span_rows(plain(texts_in, entities=detection._OVERLAPPING, resolve=False), "id")
    want = seen.join(kept, seen.columns, "left").fillna(False, ["kept"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r["kept"] for r in got.collect()} == {True, False}


def test_term_spans_brute_force(spark, docs):
    import re

    words = [r[0] for r in docs.select(F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).where(
        "length(w) > 2").groupBy("w").count().where("count between 2 and 20").orderBy("w").limit(60).collect()]
    terms = spark.createDataFrame([(w, "WORD") for w in words], "term string, entity_type string")
    got = {}
    for r in term_spans(docs, "text", ["doc_id"], terms, capitalised=False).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["text"]))
    token = re.compile(r"[^\W]+(?:[\w#'-]*)", re.UNICODE)
    token = re.compile(r"[\w#'-]+", re.UNICODE)
    for r in docs.collect():
        want = [(m.start(), m.group()) for m in token.finditer(r["text"]) if m.group() in set(words)]
        assert sorted(got.get(r["doc_id"], [])) == want


def test_readers(spark, docs, tmp_path):
    from pyspark.sql import DataFrame

    sample: DataFrame = docs.select("doc_id", "text").limit(20)
    for fmt in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / fmt)
        writer = sample.write.option("header", True).option("quoteAll", True).option("escape", '"')
        writer.format(fmt).save(path)
        options = {"header": "true", "multiLine": "true", "escape": '"'} if fmt == "csv" else {}
        out = read_texts(spark, path, id_cols=["doc_id"], fmt=fmt, schema="doc_id bigint, text string", **options)
        assert out.columns == ["doc_id", "text"] and out.count() == 20
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo")
    assert read_texts(spark, str(tmp_path / "t"), fmt="text").count() == 2
    assert read_texts(spark, str(tmp_path / "t"), fmt="text", wholetext="true").first()["text"] == "one\ntwo"
    with pytest.raises(ValueError):
        read_texts(spark, "x", fmt="xml")


def test_scan_reads_needed_columns_only(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = scan_and_protect(frame, "text", ["doc_id"]).where("lang = 'en'").select("doc_id", "protected_text")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
    assert "EqualTo(lang,en)" in plan and "Exchange" not in plan


def test_profile_and_dashboard(spark):
    frame = spark.createDataFrame([(1, "a@b.co", "c@d.org e@f.org"), (2, None, "x")], "id int, one string, two string")
    rows = {r["column_name"]: (r["values_affected"], r["entities"]) for r in jobs.column_profile(frame).collect()}
    assert rows == {"one": (1, 1), "two": (1, 2)}
    board = jobs.dashboard(frame.withColumn("g", F.lit("s")), "two", "g").collect()
    assert {(r["g"], r["entity_type"], r["level"]): (r["entities"], r["rows_affected"]) for r in board} == {
        ("s", "EMAIL_ADDRESS", 0): (2, 1), ("s", None, 1): (2, 1), (None, None, 2): (2, 1)}


def _run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_stream_equals_batch(spark, docs):
    source, out = shared_folder(spark, "src"), shared_folder(spark, "out")
    docs.select("doc_id", "text").write.parquet(source)
    stream = streams.read_stream(spark, source, "doc_id bigint, text string", maxFilesPerTrigger=3)
    kept = streams.protect_stream(stream, "text", ["doc_id"], batch_ts=TS).select("doc_id", "audit_id", "protected_text")
    checkpoint = shared_folder(spark, "ck")
    _run(streams.to_files(kept, out, checkpoint))
    _run(streams.to_files(kept, out, checkpoint))  # a second run finds nothing new
    batch = scan_and_protect(docs.select("doc_id", "text"), "text", ["doc_id"], batch_ts=TS).select(kept.columns)
    streamed = spark.read.parquet(out)
    assert streamed.count() == batch.count() and streamed.exceptAll(batch).count() == 0


def test_late_rows_are_dropped(spark):
    source = shared_folder(spark, "late")
    row = lambda ts: spark.sql(f"select timestamp '{ts}' as ts, 'analyze' as action, 'PUBLIC' as classification, 1 as entities_found")
    out, checkpoint = shared_folder(spark, "late-out"), shared_folder(spark, "late-ck")
    for ts in ("2026-01-01 00:30:00", "2026-01-01 05:00:00", "2026-01-01 00:40:00", "2026-01-01 09:00:00"):
        row(ts).write.mode("append").parquet(source)
        stream = streams.read_stream(spark, source, "ts timestamp, action string, classification string, entities_found int")
        _run(streams.to_files(streams.windowed_counts(stream), out, checkpoint))
    got = sorted((str(r["window_start"]), r["records"]) for r in spark.read.parquet(out).collect())
    assert got == [("2026-01-01 00:00:00", 1), ("2026-01-01 05:00:00", 1)]


def test_hot_swap_and_retry(spark):
    frame = texts(spark, "a@b.co", "none")
    strict = GovernancePolicy(name="strict", version="2", entity_sensitivity={"HIGH": ("EMAIL_ADDRESS",)})
    served = itertools.chain([GovernancePolicy()], itertools.repeat(strict))
    out, audit = shared_folder(spark, "swap"), shared_folder(spark, "swap-audit")
    run = streams.hot_swap(lambda: next(served), "text", ["id"], out, audit, lambda i: TS)
    for batch_id in (0, 1, 1, 2):
        run(frame, batch_id)
    rows = spark.read.parquet(out).groupBy("batch", "classification").count().collect()
    assert {(r["batch"], r["classification"]): r["count"] for r in rows} == {
        (0, "CONFIDENTIAL"): 1, (0, "PUBLIC"): 1, (1, "RESTRICTED"): 1, (1, "PUBLIC"): 1,
        (2, "RESTRICTED"): 1, (2, "PUBLIC"): 1}
    assert spark.read.parquet(audit).count() == 1
    later = streams.hot_swap(lambda: strict, "text", ["id"], out, audit, lambda i: TS, initial=GovernancePolicy())
    later(frame, 3)
    assert spark.read.parquet(audit).count() == 2


@pytest.mark.parametrize("parts", [0, 3])
def test_stream_of_a_table_in_a_file_or_a_folder(spark, tmp_path, parts):
    """m1 and m3 read `documents.parquet` as a file or as a folder of part files; other tables lie beside it."""
    from catalog.jobs import m1_stream_protect, m3_alert_stream
    from pyarrow import Table
    from pyarrow import parquet as pq

    values = [f"Mail user{i}@mail.com of John Smith, SSN 123-45-{6000 + i}" for i in range(6)]
    table = Table.from_pydict({"doc_id": list(range(6)), "text": values, "lang": ["en"] * 6, "source": ["web"] * 6, "n_chars": [len(v) for v in values]})
    pq.write_table(Table.from_pydict({"doc_id": [99]}), tmp_path / "labels.parquet")
    at = tmp_path / "documents.parquet"
    if parts:
        at.mkdir()
        for i in range(parts):
            pq.write_table(table.slice(i * 2, 2), at / f"part-{i}.parquet")
    else:
        pq.write_table(table, at)
    rows = m1_stream_protect(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(6))
    assert all(r["entities_found"] == 3 for r in rows)
    alerts = m3_alert_stream(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in alerts} == set(range(6))
    assert len(alerts) == len({(r["doc_id"], r["rule"]) for r in alerts})
