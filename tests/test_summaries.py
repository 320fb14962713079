"""Stored summaries against a full recomputation."""

from pyspark.sql import functions as F

from veilframe import with_spans
from veilframe.plans import jobs, summaries


def table(spark, n=6000):
    return spark.range(n).select(
        F.expr("date_add(date'2026-01-01', int(id % 40))").alias("day"), F.expr("if(id % 11 = 0, null, concat('s', id % 3))").alias("source"),
        F.expr("case id % 4 when 0 then 'nothing' when 1 then concat('u', id, '@x.org and u', id, '@x.org') when 2 then concat('10.0.', id % 200, '.', id % 7, ' a@b.co') end").alias("text"))


def test_merged_days_equal_the_dashboard(spark, tmp_path):
    rows, path = table(spark), str(tmp_path / "s")
    for month in ("2026-01", "2026-02"):
        part = rows.where(F.date_format("day", "yyyy-MM") == month)
        assert summaries.store(summaries.summarized(part, "text", "source", "day"), path, month)
        assert not summaries.store(summaries.summarized(part, "text", "source", "day"), path, month)
    got = summaries.merged(summaries.stored(spark, path)).collect()
    board = {(r["source"], r["entity_type"]): (r["rows_affected"], r["entities"]) for r in jobs.dashboard(rows, "text", "source", totals=False).collect()}
    assert {(r["grp"], r["entity_type"]): (r["rows_affected"], r["entities"]) for r in got if r["entity_type"]} == board
    texts = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
    assert {r["grp"]: r["texts"] for r in got if not r["entity_type"]} == texts
    exact = with_spans(rows, "text").select("source", F.explode("spans").alias("s")).groupBy("source", "s.entity_type").agg(F.count_distinct("s.text").alias("n"))
    for r in exact.collect():
        estimate = next(g["distinct_values"] for g in got if (g["grp"], g["entity_type"]) == (r["source"], r["entity_type"]))
        assert abs(estimate - r["n"]) <= 0.05 * r["n"]


def test_any_span_of_days_without_texts(spark, tmp_path):
    rows, path = table(spark, 800), str(tmp_path / "s")
    summaries.store(summaries.summarized(rows, "text", "source", "day"), path, "all")
    part = summaries.merged(summaries.stored(spark, path, "2026-01-10", "2026-01-20"), ["entity_type"]).collect()
    want = rows.where("day >= '2026-01-10' and day < '2026-01-20'")
    assert {r["entity_type"]: r["texts"] for r in part}[None] == want.count()
    emails = with_spans(want, "text", entities=["EMAIL_ADDRESS"]).agg(F.sum(F.size("spans"))).first()[0]
    assert {r["entity_type"]: r["entities"] for r in part}["EMAIL_ADDRESS"] == emails


def test_no_values_in_the_store(spark):
    out = summaries.summarized(table(spark, 8), "text", "source", "day")
    assert all(b"@x.org" not in r["sketch"] for r in out.collect())
    assert summaries.summarized(table(spark, 0), "text", "source", "day").collect() == []
    assert summaries.merged(summaries.summarized(table(spark, 0), "text", "source", "day")).collect() == []
