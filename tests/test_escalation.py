"""Escalation on a stream against the window query and a plain version; restart from the checkpoint."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veilframe.streaming import escalation as es

BASE = 1_700_000_000_000_000
MINUTE = 60_000_000


@pytest.fixture
def store(spark):
    # With batches without data a query that may set timers would never be done with what is available.
    keys = {"spark.sql.streaming.stateStore.providerClass": es.PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def frame(spark, rows):
    return spark.createDataFrame(rows, "source string, at bigint, audit_id string, classification string").select(
        "source", F.timestamp_micros("at").alias("ts"), "audit_id", "classification")


def run(spark, tmp, out, **settings):
    stream = spark.readStream.schema("source string, ts timestamp, audit_id string, classification string").option("maxFilesPerTrigger", 1).parquet(str(tmp / "in"))
    query = es.escalations(stream, "source", **settings).writeStream.format("parquet").option("checkpointLocation", str(tmp / "check")).option(
        "path", str(tmp / out)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(es.OUTPUT).parquet(str(tmp / out)).select(
        "source", "kind", F.unix_micros("ts").alias("at"), "record_id", "restricted").collect())


def write(spark, tmp, rows):
    frame(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp / "in"))


def test_stream_equals_the_table_and_survives_a_restart(spark, store, tmp_path):
    draw, rows = random.Random(6), []
    for k in range(400):
        at = BASE + k * MINUTE // 2 + draw.randrange(-3, 4) * 20_000_000  # in disorder, by less than the delay
        rows.append((draw.choice("ab"), at, f"r{k:03d}", "RESTRICTED" if draw.random() < 0.4 else "PUBLIC"))
    end = [(s, BASE + 10**12, f"end{s}", "PUBLIC") for s in "ab"]
    want = sorted(tuple(r) for r in es.escalations_in_table(frame(spark, rows), "source").select(
        "source", "kind", F.unix_micros("ts").alias("at"), "record_id", "restricted").collect())
    assert len(want) > 40
    for k in range(0, 200, 50):
        write(spark, tmp_path, rows[k:k + 50])
    first = run(spark, tmp_path, "out")
    assert first and set(first) < set(want)
    for k in range(200, 400, 100):
        write(spark, tmp_path, rows[k:k + 100])
    write(spark, tmp_path, end)
    assert run(spark, tmp_path, "out") == want


def test_late_records_are_given_out(spark, store, tmp_path):
    write(spark, tmp_path, [("a", BASE + 60 * MINUTE, "new", "PUBLIC")])
    run(spark, tmp_path, "out")
    write(spark, tmp_path, [("a", BASE, "old", "RESTRICTED"), ("a", BASE + 56 * MINUTE, "in time", "RESTRICTED"), (None, BASE, "other source", "RESTRICTED")])
    run(spark, tmp_path, "out")
    write(spark, tmp_path, [("a", BASE + 90 * MINUTE, "end", "PUBLIC"), (None, BASE + 90 * MINUTE, "end", "PUBLIC")])
    out = run(spark, tmp_path, "out")
    assert ("a", "late", BASE, "old", None) in out
    assert not any(r[3] == "in time" and r[1] == "late" for r in out)


def test_a_silent_source_is_judged_by_its_timer(spark, store, tmp_path):
    write(spark, tmp_path, [("a", BASE + k, f"r{k}", "RESTRICTED") for k in range(3)])
    run(spark, tmp_path, "out", idle="1 second", ttl="1 hour")
    time.sleep(1.5)
    write(spark, tmp_path, [("b", BASE, "other", "PUBLIC")])  # a batch has to run for timers to fire
    out = run(spark, tmp_path, "out", idle="1 second", ttl="1 hour")
    assert out == [("a", "escalation", BASE + 2, "r2", 3)]


def test_peers_and_span_borders(spark):
    rows = [("a", BASE, "1", "RESTRICTED"), ("a", BASE + 10 * MINUTE, "2", "RESTRICTED"), ("a", BASE + 10 * MINUTE, "3", "RESTRICTED"),
            ("a", BASE + 10 * MINUTE + 1, "4", "RESTRICTED"), ("a", BASE + 30 * MINUTE, "5", None)]
    out = es.escalations_in_table(frame(spark, rows), "source").orderBy("record_id").collect()
    assert [(r["record_id"], r["restricted"]) for r in out] == [("2", 3), ("3", 3), ("4", 3)]


def test_settings(spark):
    with pytest.raises(ValueError):
        es.Escalation(0, "1 minute", "1 minute", "1 minute", None)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(ValueError, match="providerClass"):
        es.escalations(frame(spark, []), "source")
