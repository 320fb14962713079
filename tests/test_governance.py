"""Policy, classification, rewriting, alerts, the four calls, audit, sinks."""

import hashlib
import json

import pytest
from conftest import texts
from pyspark.sql import functions as F

from veilframe import (
    AlertRule,
    AuditSettings,
    GovernancePolicy,
    OperatorSpec,
    analyze,
    anonymize,
    classify,
    load_policy,
    load_policy_or_default,
    scan_and_protect,
)
from veilframe.operators import classify as cls
from veilframe.plans import audit as au
from veilframe.plans import jobs
from veilframe.plans.protect import classified_columns
from veilframe.session import shared_folder
from veilframe.sources import sinks
from veilframe.sources.policy_file import load_policy_mapping

TS = "2026-01-01 00:00:00"
POLICY = GovernancePolicy()


def test_lookups():
    assert POLICY.sensitivity_of("US_SSN") == "HIGH" and POLICY.sensitivity_of("URL") == "LOW"
    assert POLICY.sensitivity_of("TOTALLY_UNKNOWN") is None
    assert POLICY.operator_for("US_SSN").operator == "redact"
    assert POLICY.operator_for("EMAIL_ADDRESS").params == {"new_value": "[EMAIL_ADDRESS]"}
    assert POLICY.operator_for("URL").params["chars_to_mask"] == 4
    assert POLICY.operator_for("TOTALLY_UNKNOWN") == OperatorSpec("replace", {"new_value": "[TOTALLY_UNKNOWN]"})
    override = POLICY.operator_for("US_SSN", {"US_SSN": {"new_value": "<{entity_type}>"}})
    assert override == OperatorSpec("replace", {"new_value": "<US_SSN>"})
    twice = GovernancePolicy(entity_sensitivity={"LOW": ("A",), "HIGH": ("A", "B")})
    assert twice.sensitivity_of("A") == "LOW" and twice.types_at("HIGH") == ["B"]


@pytest.mark.parametrize("types, scores, level, confidence, reason", [
    ([], None, "PUBLIC", 1.0, "No PII entities detected"),
    (["US_SSN", "CREDIT_CARD"], None, "RESTRICTED", 0.8,
     "Contains 2 HIGH-sensitivity entities (CREDIT_CARD, US_SSN)"),
    (["EMAIL_ADDRESS", "PHONE_NUMBER"], [0.95, 0.85], "CONFIDENTIAL", 0.9,
     "Contains 2 MEDIUM-sensitivity entities (EMAIL_ADDRESS, PHONE_NUMBER)"),
    (["URL", "DATE_TIME"], None, "INTERNAL", 0.8, "Contains 2 LOW-sensitivity entities (DATE_TIME, URL)"),
    (["URL", "EMAIL_ADDRESS", "US_SSN"], None, "RESTRICTED", 0.8,
     "Contains 1 HIGH-sensitivity entity (US_SSN); 1 MEDIUM-sensitivity entity (EMAIL_ADDRESS); "
     "1 LOW-sensitivity entity (URL)"),
    (["UNKNOWN_TYPE"], None, "INTERNAL", 0.8, "Contains "),
])
def test_classification(spark, types, scores, level, confidence, reason):
    frame = spark.createDataFrame([(types, scores)], "entity_types array<string>, scores array<double>")
    row = classified_columns(frame, POLICY, "scores").first()
    assert (row["classification"], row["confidence"], row["reason"]) == (level, confidence, reason)
    assert all(row["entity_summary"].values())
    assert sorted(t for v in row["entity_summary"].values() for t in v) == sorted(types)


def test_empty_policy_levels(spark):
    bare = GovernancePolicy(entity_sensitivity={})
    frame = spark.createDataFrame([(["A"],)], "types array<string>")
    assert frame.select(F.expr(cls.classification("types", bare))).first()[0] == "INTERNAL"
    assert frame.select(F.expr(cls.entity_summary("types", bare))).first()[0] == {"UNKNOWN": ["A"]}


def rewrite(spark, text, spec, **kw):
    out = anonymize(texts(spark, text), "text", ["id"], operators={"EMAIL_ADDRESS": spec}, **kw)
    return out.first()["anonymized_text"]


def test_operators(spark):
    text = "x a@b.co y"
    assert rewrite(spark, text, {"new_value": "HIDDEN"}) == "x HIDDEN y"
    assert rewrite(spark, text, {"type": "replace"}) == "x [EMAIL_ADDRESS] y"
    assert rewrite(spark, text, {"type": "redact"}) == "x  y"
    assert rewrite(spark, text, {"type": "mask", "chars_to_mask": 4, "masking_char": "#"}) == "x ####co y"
    assert rewrite(spark, text, {"type": "mask", "chars_to_mask": 4, "from_end": True}) == "x a@**** y"
    assert rewrite(spark, text, {"type": "mask", "chars_to_mask": 99}) == "x ****** y"
    assert rewrite(spark, text, {"type": "hash"}) == f"x {hashlib.sha256(b'a@b.co').hexdigest()} y"
    assert rewrite(spark, text, {"type": "hash", "hash_type": "sha512", "salt": "s"}) == (
        f"x {hashlib.sha512(b'sa@b.co').hexdigest()} y")
    assert rewrite(spark, "it's a@b.co \\ 'q'", {"new_value": "'\\"}) == "it's '\\ \\ 'q'"


def test_encrypt_round_trip(spark):
    key = "0123456789abcdef"
    value = "a" * 60 + "@example.com"  # long enough for base64 to break its output into lines
    token = rewrite(spark, value, {"type": "encrypt", "key": key})
    assert value not in token and "\n" not in token and "\r" not in token
    back = spark.createDataFrame([(token,)], "t string").selectExpr(
        f"cast(aes_decrypt(unbase64(t), '{key}', 'CBC', 'PKCS') as string)").first()[0]
    assert back == value


@pytest.mark.parametrize("spec", [
    {"type": "shred"}, {"type": "mask", "masking_char": "ab"}, {"type": "mask", "chars_to_mask": -1},
    {"type": "hash", "hash_type": "md5"}, {"type": "encrypt", "key": "short"},
])
def test_bad_operators(spark, spec):
    with pytest.raises(ValueError):
        rewrite(spark, "a@b.co", spec)


def test_anonymize(spark):
    rows = anonymize(texts(spark, "Hello world", "SSN 219-09-9999, a@b.co on 03/15/1985", None), "text", ["id"]).orderBy("id").collect()
    assert rows[0]["anonymized_text"] == "Hello world" and rows[0]["operators_applied"] == {}
    assert rows[1]["anonymized_text"] == "SSN , [EMAIL_ADDRESS] on ****5/1985"
    assert rows[1]["operators_applied"] == {"US_SSN": "redact", "EMAIL_ADDRESS": "replace", "DATE_TIME": "mask"}
    assert rows[1]["entities_found"] == rows[1]["entities_anonymized"] == 3
    assert rows[2]["anonymized_text"] is None and rows[2]["entities_found"] == 0


def test_rewritten_documents_hold_no_found_value(docs):
    out = scan_and_protect(docs, "text", ["doc_id"], with_spans_col=True)
    redacted = out.select("protected_text", F.explode("spans").alias("s")).where("s.entity_type <> 'DATE_TIME'")
    assert redacted.count() > 0
    assert redacted.where("contains(protected_text, s.text)").count() == 0


def test_analyze_returns_no_raw_value(spark):
    row = analyze(texts(spark, "My SSN is 219-09-9999 and email is test@example.com"), "text", ["id"], with_audit=True).first()
    dumped = json.dumps(row.asDict(True), default=str)
    assert row["entities_found"] == 2 and "219-09-9999" not in dumped and "test@example.com" not in dumped


def test_size_limit_everywhere(spark):
    frame = texts(spark, "A" * 200, "ok a@b.co")
    for call in (analyze, anonymize, classify, scan_and_protect):
        out = call(frame, "text", ["id"], max_chars=100, with_audit=True)
        big, small = out.orderBy("id").collect()
        assert "too large" in big["error"] and big["audit"] is None
        assert small["error"] is None and small["audit"]["action"] == call.__name__
        assert au.audit_rows(out).count() == 1


RULES = (
    AlertRule("restricted", "classification == RESTRICTED", "webhook", "CRITICAL", "https://h.example.com"),
    AlertRule("many", "entities_found > 2"), AlertRule("odd", "moon is full"),
)


def test_alerts(spark):
    policy = GovernancePolicy(alerts=RULES)
    frame = texts(spark, "SSN 219-09-9999 a@b.co c@d.org", "a@b.co", "none")
    rows = scan_and_protect(frame, "text", ["id"], policy=policy).orderBy("id").collect()
    assert [a["name"] for a in rows[0]["alerts_triggered"]] == ["restricted", "many"]
    assert rows[0]["alerts_triggered"][1]["webhook_url"] == ""
    assert rows[1]["alerts_triggered"] == rows[2]["alerts_triggered"] == []
    plain = scan_and_protect(frame, "text", ["id"]).collect()
    assert all(r["alerts_triggered"] == [] for r in plain)
    box = sinks.outbox_rows(scan_and_protect(frame, "text", ["id"], policy=policy), ["id"]).collect()
    assert [(r["id"], r["rule"], r["webhook_url"]) for r in box] == [(0, "restricted", "https://h.example.com")]


@pytest.mark.parametrize("condition", ["entities_found >= 5", "entities_found > five", "entities_found >"])
def test_bad_alert_rules(condition):
    with pytest.raises(ValueError):
        AlertRule("x", condition)


def test_audit_record(spark):
    out = scan_and_protect(texts(spark, "a@b.co"), "text", ["id"], batch_ts=TS, with_audit=True)
    record = au.audit_rows(out).first()
    assert len(record["audit_id"]) == 12 and int(record["audit_id"], 16) >= 0
    assert record["audit_id"] == out.first()["audit_id"]
    assert record["operators_used"] == {"EMAIL_ADDRESS": "replace"} and record["text_length"] == 6
    assert record["anonymized_text"] == "[EMAIL_ADDRESS]"
    assert "anonymized_text" not in au.export_columns(au.audit_rows(out)).columns
    for settings, n, text in ((AuditSettings(log_anonymized_text=False), 1, None), (AuditSettings(enabled=False), 0, None)):
        rows = au.audit_rows(scan_and_protect(
            texts(spark, "a@b.co"), "text", ["id"], policy=GovernancePolicy(audit=settings), with_audit=True)).collect()
        assert len(rows) == n and all(r["anonymized_text"] is text for r in rows)


def _log(spark):
    rows = [(f"{i:012x}", f"2026-01-0{i + 1} 00:00:00", a, c, n) for i, (a, c, n) in enumerate([
        ("analyze", "PUBLIC", 0), ("analyze", "CONFIDENTIAL", 1), ("anonymize", "CONFIDENTIAL", 1),
        ("analyze", "RESTRICTED", 1)])]
    frame = spark.createDataFrame(rows, "audit_id string, ts string, action string, classification string, entities_found int")
    return frame.withColumn("ts", F.col("ts").cast("timestamp")).withColumns({
        "entity_types": F.expr("cast(array() as array<string>)"), "entities_anonymized": F.lit(0),
        "operators_used": F.expr("cast(map() as map<string,string>)"), "policy_name": F.lit("default"),
        "policy_version": F.lit("1.0"), "text_length": F.lit(1), "anonymized_text": F.lit(None).cast("string"),
        "metadata": F.expr("cast(map() as map<string,string>)")})


def test_audit_queries(spark):
    log = _log(spark)
    ids = [r["audit_id"][-1] for r in au.query_audit(log).collect()]
    assert ids == ["3", "2", "1", "0"]
    assert au.query_audit(log, action_type="anonymize").count() == 1
    assert au.query_audit(log, classification="CONFIDENTIAL", action_type="analyze").count() == 1
    assert au.query_audit(log, since="2026-01-03 00:00:00").count() == 2
    assert au.query_audit(log, action_type="", classification="", since="").count() == 4
    assert [r["audit_id"][-1] for r in au.retain_newest(log, 2).collect()] == ["3", "2"]
    assert tuple(au.audit_totals(log, 2, action_type="analyze").first()) == (4, 2)


def test_stored_audit_prunes_partitions(spark):
    path = shared_folder(spark, "stored")
    au.write_audit(_log(spark), path)
    query = au.filter_audit(au.read_audit(spark, path), "2026-01-02 00:00:00", "analyze")
    assert query.count() == 2
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "action" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_policy_set(spark):
    config = {"name": "strict", "version": "2.0", "detection": {"score_threshold": 0.9}}
    new, change = au.set_policy(spark, POLICY, config, TS)
    row = change.first()
    assert (row["action"], row["classification"], row["entity_types"]) == ("policy_change", "RESTRICTED", [])
    assert row["metadata"] == {"previous_policy": "default", "previous_version": "1.0"}
    assert new.detection.score_threshold == 0.9 and new.entity_sensitivity == POLICY.entity_sensitivity
    with pytest.raises(ValueError):
        au.set_policy(spark, POLICY, {})
    assert POLICY.entities_df(spark).count() == 18
    assert POLICY.summary_df(spark).first()["score_threshold"] == 0.4


def test_policy_files(spark, tmp_path):
    file = tmp_path / "p.json"
    file.write_text(json.dumps({
        "name": "j", "alerts": [{"name": "a", "condition": "entities_found > 1"}],
        "operator_overrides": {"URL": {"operator": "hash"}}, "audit": {"exporters": [{"type": "stdout"}]},
        "anonymization": {"HIGH": {"operator": "mask"}}, "something_else": 1}))
    policy = load_policy(spark, file)
    assert policy.name == "j" and policy.alerts[0].level == "WARNING"
    assert policy.operator_for("URL").operator == "hash" and policy.operator_for("US_SSN").operator == "mask"
    assert policy.operator_for("EMAIL_ADDRESS").params == {"new_value": "[EMAIL_ADDRESS]"}  # no MEDIUM default
    assert load_policy_or_default(spark, tmp_path / "none.json") == GovernancePolicy()
    yaml = pytest.importorskip("yaml")
    other = tmp_path / "p.yml"
    other.write_text(yaml.safe_dump({"name": "y", "entity_sensitivity": {"HIGH": ["SALARY"]}}))
    assert load_policy(spark, other).sensitivity_of("SALARY") == "HIGH"
    with pytest.raises(FileNotFoundError):
        load_policy_mapping(spark, tmp_path / "none.yaml")
    for name, text in (("p.toml", "a = 1"), ("l.json", "[1]")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            load_policy_mapping(spark, tmp_path / name)
    for raw in ({"entity_sensitivity": {"TOP": ["A"]}}, {"name": 3}, {"anonymization": {"LOW": {"operator": "x"}}}):
        with pytest.raises(ValueError):
            GovernancePolicy.from_mapping(raw)


def test_sinks(spark, capsys):
    path, box = shared_folder(spark, "json"), shared_folder(spark, "box")
    made = sinks.sinks_from_policy([
        {"type": "file", "path": path}, {"type": "stdout"}, {"type": "webhook"},
        {"type": "outbox", "url": "https://h.example.com", "path": box}])
    assert [type(s).__name__ for s in made] == ["JsonLinesSink", "ConsoleSink", "OutboxSink"]

    class Down:
        def write(self, audit):
            raise OSError

    log = _log(spark)
    assert sinks.fan_out(log, [Down(), *made]) == ["Down"]
    assert made[0].query(log).count() == 4 and spark.read.parquet(box).count() == 4
    lines = spark.read.text(path).collect()
    assert all("anonymized_text" not in json.loads(r[0]) for r in lines)
    assert "duration" not in capsys.readouterr().out


def test_routing_and_gate(spark):
    frame = texts(spark, "SSN 219-09-9999", "a@b.co", "on 2026-01-01", "plain", "x" * 50)
    routed = {r["id"]: r for r in jobs.tiered_route(frame, "text", ["id"], max_chars=40).collect()}
    assert [routed[i]["route"] for i in range(5)] == ["BLOCKED", "ANONYMIZED", "PASSED", "PASSED", "BLOCKED"]
    assert [routed[i]["released_text"] for i in range(5)] == [None, "[EMAIL_ADDRESS]", "on 2026-01-01", "plain", None]
    assert routed[0]["entity_types"] == ["US_SSN"]
    verdicts = jobs.leak_gate(frame, "text")
    assert jobs.gate_summary(verdicts).first()["verdict"] == "BLOCKED"
    assert jobs.gate_summary(verdicts.where("id = 3")).first()["verdict"] == "CLEAN"
    assert jobs.gate_summary(verdicts.where("id > 99")).first()["verdict"] == "CLEAN"
