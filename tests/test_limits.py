"""Cases at the edges: long junk, many matches, numbers in a row, time zones, odd input columns, bad policies."""

import time

import pytest
from pyspark.sql import functions as F

from conftest import texts
from veilframe import AlertRule, GovernancePolicy, RecognizerRegistry, scan_and_protect
from veilframe.operators.recognizers import term_pattern
from veilframe.plans import audit as au
from veilframe.plans import jobs
from veilframe.plans.protect import analyze, with_spans
from veilframe.sources.sinks import ConsoleSink
from veilframe.streaming import streams


def spans_of(spark, *values, **settings):
    rows = with_spans(texts(spark, *values), **settings).orderBy("id").collect()
    return [[(s["entity_type"], s["text"]) for s in r["spans"]] for r in rows]


def test_long_junk_does_not_overflow(spark):
    junk = ["x a@" + "b." * 500_000 + "co y", "a@" + "b-" * 500_000, "1" * 1_000_000, "A" * 1_000_000,
            ":1" * 500_000, "http://" + "x." * 500_000, "AB12 " * 2_000, "+1 (2" * 2_000, "a@b." * 2_000]
    assert len(spans_of(spark, *junk)) == len(junk)


@pytest.mark.parametrize("text, want", [
    ("a@b.co.", "a@b.co"), ("a@b.1.com", "a@b.1.com"), ("a@b.co-x", "a@b.co"), ("a@b..com", None), ("a@.b.com", None),
    ("a@b.c", None), ("a@b.co..x@y.com", "a@b.co"), ("x.y+z@q-r.example.org,", "x.y+z@q-r.example.org"), ("a@" + "b." * 3000 + "co", "a@" + "b." * 3000 + "co"),
])
def test_addresses(spark, text, want):
    assert spans_of(spark, text, entities=["EMAIL_ADDRESS"])[0] == ([("EMAIL_ADDRESS", want)] if want else [])


@pytest.mark.parametrize("text, want", [
    ("Pay BE68 5390 0754 7034 NOW", ["BE68 5390 0754 7034"]), ("Pay BE68 5390 0754 7034 now", ["BE68 5390 0754 7034"]),
    ("AT61 1904 3002 3457 3201 SEND EUR", ["AT61 1904 3002 3457 3201"]),
    ("AT61 1904 3002 3457 3201 BE68 5390 0754 7034", ["AT61 1904 3002 3457 3201", "BE68 5390 0754 7034"]),
    ("GB82WEST12345698765432 and GB82WEST12345698765431", ["GB82WEST12345698765432"]),
])
def test_account_numbers(spark, text, want):
    assert [v for _, v in spans_of(spark, text, entities=["IBAN_CODE"])[0]] == want


def test_many_matches_take_linear_time(spark):
    text = "ip 10.0.0.1 " * 40_000
    spans_of(spark, "ip 10.0.0.1", entities=["IP_ADDRESS"])
    start = time.time()
    out = with_spans(texts(spark, text), entities=["IP_ADDRESS"]).select(F.size("spans").alias("n"), F.expr("spans[39999].start").alias("s")).first()
    assert (out["n"], out["s"]) == (40_000, 12 * 39_999 + 3) and time.time() - start < 20


def test_empty_matches_are_dropped(spark):
    for bad in (r"\b", "(?=a)"):
        with pytest.raises(ValueError):
            RecognizerRegistry().with_pattern("x", "X", [bad])
    kept = RecognizerRegistry().with_pattern("x", "X", ["(?=q)"])
    assert spans_of(spark, "qq", registry=kept, entities=["X"]) == [[]]


def test_large_term_lists(spark):
    import re

    terms = [f"name{i:05d}" for i in range(3000)] + ["name", "na", "new york", "new"]
    pattern = term_pattern(terms).regex
    for text, want in (("name00007 x", "name00007"), ("name x", "name"), ("na", "na"), ("new york", "new york"), ("new yo", "new"), ("nam", None)):
        m = re.search(pattern, text)
        assert (m.group() if m else None) == want


def test_long_texts_in_reports(spark, docs):
    long = "word " * 30_000 + "a@b.co"
    frame = spark.createDataFrame([(1, long, "g"), (2, "c@d.org", None)], "id int, text string, grp string")
    board = {(r["grp"], r["entity_type"], r["level"]): (r["entities"], r["rows_affected"]) for r in jobs.dashboard(frame, "text", "grp").collect()}
    assert board == {("g", "EMAIL_ADDRESS", 0): (1, 1), (None, "EMAIL_ADDRESS", 0): (1, 1), ("g", None, 1): (1, 1),
                     (None, None, 1): (1, 1), (None, None, 2): (2, 2)}
    limited = jobs.dashboard(frame, "text", "grp", max_chars=1000).where("level = 3").collect()
    assert [(r["grp"], r["rows_affected"]) for r in limited] == [("g", 1)]
    profile = jobs.column_profile(frame, ["text"]).collect()
    assert [(r["entity_type"], r["values_affected"]) for r in profile] == [("EMAIL_ADDRESS", 2)]
    assert {r["entity_type"] for r in jobs.column_profile(frame, ["text"], max_chars=1000).collect()} == {"EMAIL_ADDRESS", None}


def test_console_lines_come_from_the_tasks(spark, tmp_path):
    frame = spark.range(0, 45, numPartitions=3).selectExpr("cast(id as string) as audit_id", "'a' as action", "if(id = 7, null, 'PUBLIC') as classification",
                                                           "0 as entities_found", "0 as entities_anonymized")

    def emit(rows):
        import os
        import uuid

        (tmp_path / uuid.uuid4().hex).write_text("".join(f"{os.getpid()} {r['line']}\n" for r in rows))

    ConsoleSink("warn", emit).write(frame)
    lines = [line.split(" ", 1) for f in tmp_path.iterdir() for line in f.read_text().splitlines()]
    assert len(list(tmp_path.iterdir())) == 3 and len(lines) == 45
    import os

    assert str(os.getpid()) not in {pid for pid, _ in lines}
    assert "WARN audit_id=7 action=a classification=None entities_found=0 entities_anonymized=0" in {line for _, line in lines}
    ConsoleSink().write(frame)


def test_results_never_hide_input(spark):
    frame = texts(spark, "a@b.co").withColumn("classification", F.lit("mine"))
    with pytest.raises(ValueError, match="classification"):
        scan_and_protect(frame, "text", ["id"])
    with pytest.raises(ValueError, match="id_cols"):
        scan_and_protect(texts(spark, "x"), "text", with_audit=True)


def test_keys_are_told_apart(spark):
    frame = spark.createDataFrame([(None, "x", "t"), ("x", None, "t"), ("x|y", "z", "t"), ("x", "y|z", "t")], "a string, b string, text string")
    assert analyze(frame, "text", ["a", "b"]).select("analysis_id").distinct().count() == 4


def test_time_zones(spark, tmp_path):
    frame, path = texts(spark, "a@b.co"), str(tmp_path / "log")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for n, name in enumerate(("America/Los_Angeles", "Asia/Tokyo", "UTC")):
            spark.conf.set("spark.sql.session.timeZone", name)
            row = scan_and_protect(frame, "text", ["id"], batch_ts="2026-01-01 23:30:00", with_audit=True).selectExpr("unix_micros(audit.ts) as t").first()
            assert row["t"] == 1_767_310_200_000_000
            log = spark.range(1).selectExpr("timestamp_micros(1767310200000000) as ts", f"'{n}' as audit_id", "'analyze' as action", "'PUBLIC' as classification")
            au.write_audit(log, path)
        for name in ("UTC", "Asia/Tokyo", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", name)
            stored = spark.read.parquet(path)
            assert au.filter_audit(stored, since="2026-01-01 23:00:00+00:00").count() == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_event_time_per_row(spark):
    frame = texts(spark, "x", "y").withColumn("at", F.expr("timestamp '2026-01-01 00:00:00+00:00' + make_interval(0,0,0,id)"))
    out = scan_and_protect(frame, "text", ["id"], ts_col="at", with_audit=True)
    assert out.select("audit.ts").distinct().count() == 2 and out.selectExpr("audit.metadata['record_key']").distinct().count() == 2


@pytest.mark.parametrize("raw", [
    {"entity_sensitivity": {"HIGH": "EMAIL_ADDRESS"}}, {"audit": {"enabled": "false"}}, {"detection": {"score_threshold": 4}},
    {"alerts": {"name": "x"}}, {"detection": ["en"]}, {"anonymization": {"HIGH": "redact"}}, {"entity_sensitivity": {"HIGH": [1]}},
])
def test_policy_values_of_a_wrong_kind(raw):
    with pytest.raises(ValueError):
        GovernancePolicy.from_mapping(raw)


def test_null_sections_and_conditions():
    empty = {k: None for k in ("operator_overrides", "alerts", "audit", "detection", "classification", "entity_sensitivity", "anonymization")}
    assert GovernancePolicy.from_mapping(empty) == GovernancePolicy()
    assert AlertRule("a", " classification ==  HIGH ").parsed() == ("classification", "HIGH")
    assert AlertRule("a", "entities_found > 3").parsed() == ("entities_found", 3)
    assert AlertRule("a", "if classification == RESTRICTED").parsed() == ("classification", "RESTRICTED")
    assert AlertRule("a", "when entities_found > +1_0").parsed() == ("entities_found", 10)
    assert AlertRule("a", "classification == A or entities_found > 2").parsed() == ("classification", "A or entities_found > 2")
    assert AlertRule("a", "classification == A == B").parsed() == ("classification", "B")
    assert AlertRule("a", "classification==RESTRICTED").parsed() is None and AlertRule("a", "").parsed() is None
    policy = GovernancePolicy(alerts=(AlertRule("a", "entities_found > 3"),))
    assert GovernancePolicy.from_dict(policy.as_dict()) == policy


def test_swap_survives_restart_and_retry(spark, tmp_path):
    paths = [str(tmp_path / p) for p in ("out", "audit", "history")]
    batch = texts(spark, "a@b.co")
    make = lambda policy: streams.hot_swap(lambda: policy, "text", ["id"], paths[0], paths[1], lambda i: "2026-01-01 00:00:00", history_path=paths[2])
    make(GovernancePolicy(name="one"))(batch, 0)
    make(GovernancePolicy(name="two"))(batch, 1)  # restarted
    make(GovernancePolicy(name="three"))(batch, 1)  # retried: the policy of the first try holds
    assert {r["policy_applied"] for r in spark.read.parquet(f"{paths[0]}/batch=1").collect()} == {"two"}
    change = spark.read.parquet(f"{paths[1]}/batch=1").first()
    assert change["metadata"] == {"previous_policy": "one", "previous_version": "1.0"} and change["policy_name"] == "two"


def test_retention_by_time(spark):
    log = spark.range(5000).selectExpr("cast(id as string) as audit_id", "timestamp_seconds(id div 7 + 1000000) as ts")
    kept = au.retain_newest(log, 1234, within_task=10)
    assert kept.count() == 1234 and kept.agg(F.min("ts")).first()[0] == log.orderBy(F.desc("ts")).limit(1234).agg(F.min("ts")).first()[0]
    assert au.retain_newest(log, 9000, within_task=10).count() == 5000
