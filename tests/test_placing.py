"""Where matches stand: texts that occur once are looked up, all others are placed by the text between matches."""

import pytest
from pyspark.sql import functions as F

from catalog.tables import cases
from conftest import texts
from veilframe import RecognizerRegistry
from veilframe.plans.protect import with_spans

ODD = [
    "x555-123-4567 then 555-123-4567", "555-123-4567 555-123-4567", "10.0.0.1 10.0.0.10 10.0.0.1", "é😀 10.0.0.1",
    "a\u0001b 10.0.0.1 and 110.0.0.1 10.0.0.1", "\u0001", "", "Mary Maryland Mary", "0911/12/2001 11/12/2001",
    "a@b.co, xa@b.co, a@b.co", "1 10.0.0.1 2 10.0.0.2 3 10.0.0.3 4 10.0.0.4 5 10.0.0.5", "line 10.0.0.1\n" * 3 + "Ship to Paris.\n" + "word " * 200,
    "4111111111111111 bank 4111-1111-1111-1111, AB1234563 permit D1234567 C12345678",
]


def found(spark, gated, registry=None):
    rows = with_spans(texts(spark, *ODD), resolve=False, gated=gated, registry=registry, score_threshold=0.0).orderBy("id").collect()
    return [[tuple(s) for s in r["spans"]] for r in rows]


@pytest.mark.parametrize("custom", [False, True])
def test_matches_stand_where_they_are_found(spark, custom):
    registry = RecognizerRegistry().with_pattern("pair", "PAIR", ["aba", "(?<=b )[0-9]+", "10[.]0"]) if custom else None
    gated = found(spark, True, registry)
    assert gated == found(spark, False, registry)
    for text, spans in zip(ODD, gated, strict=True):
        assert all(text[s[0]:s[1]] == s[4] for s in spans)
    if not custom:
        assert [s[:2] for s in gated[0] if s[2] == "PHONE_NUMBER"] == [(19, 31)]
        assert [s[:2] for s in gated[1] if s[2] == "PHONE_NUMBER"] == [(0, 12), (13, 25)]
        assert [s[:2] for s in gated[4] if s[2] == "IP_ADDRESS"] == [(4, 12), (17, 26), (27, 35)]
        assert len([s for s in gated[10] if s[2] == "IP_ADDRESS"]) == 5


def test_one_test_for_recognizers_that_need_the_same(spark):
    plan = with_spans(texts(spark, "x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[0-9]{7})") == 1


def test_one_row_group_is_dealt_over_the_cores(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id as o_orderkey", "id % 7 as o_custkey").unionByName(
        spark.sql("select cast(null as bigint) as o_orderkey, 1L as o_custkey from range(4000)"))
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    texts_in = cases(spark, str(tmp_path), "MIXED")
    sizes = [r["count"] for r in texts_in.groupBy(F.spark_partition_id()).count().collect()]
    assert texts_in.count() == 8000 and len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 8000 // 2
