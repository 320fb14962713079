"""Keyed hashes and joinable tokens; policies by event time and what a change of policy changes."""

import hashlib
import hmac

import pytest
from conftest import texts
from pyspark.sql import functions as F

from veilframe import GovernancePolicy, OperatorSpec, anonymize
from veilframe.operators.anonymize import operator_sql
from veilframe.operators.tokens import KeyRing, hmac_sha256
from veilframe.plans import policy_table as pt

# RFC 4231, test cases 1 to 4, 6 and 7: key, data, digest.
VECTORS = [
    (b"\x0b" * 20, b"Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
    (b"Jefe", b"what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    (b"\xaa" * 20, b"\xdd" * 50, "773ea91e36800e46854db8ebd09181a72959098b3ef8c122d9635514ced565fe"),
    (bytes(range(1, 26)), b"\xcd" * 50, "82558a389a443c0ea4cc819899f2083a85f0faa3e578f8077a2e3ff46729665b"),
    (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
    (b"\xaa" * 131, b"This is a test using a larger than block-size key and a larger than block-size data. The key needs to be hashed before being used by the HMAC algorithm.",
     "9b09ffa71b942fcb27635fbcd5b0e944bfdc63644f0713938a7f51535c3a35e2"),
]


@pytest.mark.parametrize("key, data, digest", VECTORS)
def test_hmac_vectors(spark, key, data, digest):
    assert hmac.new(key, data, hashlib.sha256).hexdigest() == digest
    frame = spark.createDataFrame([(bytearray(data),)], "v binary")
    assert frame.select(F.expr(hmac_sha256("v", key))).first()[0] == digest


KEYS = {"a": "0123456789abcdef", "b": "0123456789abcdef01234567", "c": "0123456789abcdef0123456789abcdef"}


def test_tokens_join_rotate_and_come_back(spark):
    values = ["Zoë", "", "same", "same", None, "x" * 5000]
    one, two = KeyRing(KEYS, "a"), KeyRing(KEYS, "c")
    frame = texts(spark, *values).withColumn("token", F.expr(one.token("text"))).withColumn("later", F.expr(two.token("text")))
    moved = two.rotated(frame.withColumn("moved", F.col("token")), ["moved"])
    moved = moved.withColumn("back", F.expr(two.value("moved"))).orderBy("id")
    rows = moved.collect()
    assert [r["back"] for r in rows] == values and [r["moved"] for r in rows] == [r["later"] for r in rows]
    tokens = [r["token"] for r in rows]
    assert tokens[2] == tokens[3] and len(set(tokens)) == 5 and tokens[4] is None
    assert all(t.startswith("a:") and "\n" not in t for t in tokens if t) and all(r["moved"].startswith("c:") for r in rows if r["moved"])
    assert two.rotated(moved, ["moved"]).orderBy("id").select("moved").collect() == moved.select("moved").collect()
    odd = texts(spark, "no token", "z:AAAA", "a:!!", "a:AAAA", None)
    assert [r[0] for r in odd.select(F.expr(two.value("text"))).collect()] == [None] * 5
    assert [r["text"] for r in two.rotated(odd, ["text"]).collect()] == ["no token", "z:AAAA", "a:!!", "a:AAAA", None]


def test_tokens_in_rewritten_texts(spark):
    ring = KeyRing(KEYS, "b")
    frame = texts(spark, "to a@b.co and a@b.co", "a@b.co")
    out = anonymize(frame, "text", ["id"], operators={"EMAIL_ADDRESS": {"type": "encrypt", **ring.params()}}).orderBy("id").collect()
    token = out[1]["anonymized_text"]
    assert out[0]["anonymized_text"] == f"to {token} and {token}"
    hashed = anonymize(frame, "text", ["id"], operators={"EMAIL_ADDRESS": {"type": "hash", "hash_type": "hmac_sha256", "key": "k"}}).orderBy("id").collect()
    assert hashed[1]["anonymized_text"] == hmac.new(b"k", b"a@b.co", hashlib.sha256).hexdigest()
    plain = anonymize(frame, "text", ["id"], operators={"EMAIL_ADDRESS": {"type": "encrypt", "key": KEYS["a"]}}).where("id = 0").first()[1]
    assert plain.split(" ")[1] != plain.split(" ")[3]  # without joinable, a fresh IV for each value


@pytest.mark.parametrize("bad", [lambda: KeyRing(KEYS, "z"), lambda: KeyRing({"a": "short"}, "a"), lambda: KeyRing({"a:b": KEYS["a"]}, "a:b"),
                                 lambda: operator_sql(OperatorSpec("hash", {"hash_type": "hmac_sha256"}), "v"),
                                 lambda: operator_sql(OperatorSpec("encrypt", {"key": KEYS["a"], "key_id": "a:b"}), "v")])
def test_bad_keys(bad):
    with pytest.raises(ValueError):
        bad()


def test_keys_are_not_shown():
    assert KEYS["a"] not in repr(KeyRing(KEYS, "a"))


OLD = GovernancePolicy()
NEW = GovernancePolicy(name="new", version="2", entity_sensitivity={"HIGH": ("EMAIL_ADDRESS",), "LOW": ("US_SSN", "URL")})


def test_versions_by_time(spark):
    table = pt.version_row(spark, NEW, "2024-02-01 00:00:00").unionByName(pt.version_row(spark, OLD, "2024-01-01 00:00:00")).unionByName(
        pt.version_row(spark, GovernancePolicy(name="x", version="1.5"), "2024-02-01 00:00:00"))
    listed = pt.versions(table)
    assert [(v.valid_from[:19], v.policy.name) for v in listed] == [("2024-01-01 00:00:00", "default"), ("2024-02-01 00:00:00", "new")]
    rows = spark.createDataFrame(
        [(0, "2023-12-31 23:59:59", ["URL"]), (1, "2024-01-01 00:00:00", ["EMAIL_ADDRESS"]), (2, "2024-01-31 23:59:59.999999", ["US_SSN"]),
         (3, "2024-02-01 00:00:00", ["US_SSN"]), (4, "2024-03-01 00:00:00", ["EMAIL_ADDRESS"]), (5, None, ["URL"]), (6, "2024-03-01 00:00:00", [])],
        "id int, at string, entity_types array<string>").withColumn("ts", F.expr("cast(at as timestamp)"))
    got = pt.with_policy_as_of(rows, listed).orderBy("id").select("policy_version", "classification").collect()
    assert [tuple(r) for r in got] == [(None, None), ("1.0", "CONFIDENTIAL"), ("1.0", "RESTRICTED"), ("2", "INTERNAL"), ("2", "RESTRICTED"), (None, None), ("2", "PUBLIC")]
    with pytest.raises(ValueError, match="empty"):
        pt.with_policy_as_of(rows, [])
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [v.valid_from for v in pt.versions(table)] == [v.valid_from for v in listed]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_only_rows_that_change(spark):
    audit = spark.createDataFrame(
        [(0, ["EMAIL_ADDRESS"], "CONFIDENTIAL"), (1, ["URL"], "INTERNAL"), (2, ["US_SSN", "URL"], "RESTRICTED"), (3, [], "PUBLIC"),
         (4, ["EMAIL_ADDRESS", "US_SSN"], "RESTRICTED"), (5, None, None)], "id int, entity_types array<string>, classification string"
    ).withColumns({"policy_name": F.lit("default"), "policy_version": F.lit("1.0")})
    out = pt.reclassified(audit, OLD, NEW).orderBy("id")
    assert [(r["id"], r["previous_classification"], r["classification"], r["policy_version"]) for r in out.collect()] == [
        (0, "CONFIDENTIAL", "RESTRICTED", "2"), (2, "RESTRICTED", "INTERNAL", "2")]
    assert "EMAIL_ADDRESS" in pt.changed_types(OLD, NEW) and "URL" not in pt.changed_types(OLD, NEW)
    assert pt.reclassified(audit, OLD, OLD).collect() == []
