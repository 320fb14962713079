"""The newest N records, exactly, by narrowing counts."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.plans import audit as au


def kept(spark, rows, n, within):
    frame = spark.createDataFrame([(k, t, i) for k, (t, i) in enumerate(rows)], "row int, t bigint, audit_id string").select(
        "row", F.expr("timestamp_micros(t)").alias("ts"), "audit_id")
    return sorted(((r["t"], r["audit_id"]) for r in au.retain_newest(frame, n, within).select(
        F.unix_micros("ts").alias("t"), "audit_id").collect()), key=order, reverse=True)


def order(row):
    return (row[0] is not None, row[0] or 0, row[1] is not None, (row[1] or "").encode())


_row = st.tuples(st.one_of(st.none(), st.integers(0, 5), st.integers(0, 10**15)), st.one_of(st.none(), st.text("abé", max_size=4)))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_row, min_size=1, max_size=60), st.integers(1, 70), st.integers(0, 5))
def test_like_sorting(spark, rows, n, within):
    assert kept(spark, rows, n, min(within, n - 1)) == sorted(rows, key=order, reverse=True)[:n]


@pytest.mark.parametrize("n", [1, 9, 20])
def test_one_key_for_all(spark, n):
    assert kept(spark, [(7, "same")] * 20, n, 0) == [(7, "same")] * n


def test_many_records_of_one_time(spark):
    n = 2_000_000
    frame = spark.range(0, n, numPartitions=8).select(F.lit("2026-01-01").cast("timestamp").alias("ts"), F.sha2(F.col("id").cast("string"), 256).substr(1, 12).alias("audit_id"))
    out = au.retain_newest(frame, 1_500_000, 100_000)
    got = out.agg(F.count(F.lit(1)).alias("n"), F.min("audit_id").alias("low")).first()
    want = frame.orderBy(F.desc("audit_id")).limit(1_500_000).agg(F.min("audit_id")).first()[0]
    assert got["n"] == 1_500_000 and got["low"] == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "TakeOrdered" not in plan
