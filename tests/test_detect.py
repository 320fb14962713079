"""Detection on the fixture strings, edge cases, and properties over all documents."""

import re

import pytest
from conftest import found, texts
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe import RecognizerRegistry, with_spans
from veilframe.functions.spans import SPAN_ARRAY, match_offsets, resolve_overlaps
from veilframe.operators.custom_detectors import arrow_detector
from veilframe.operators.recognizers import Recognizer, any_of, builtin_recognizers, term_pattern

MIXED = (
    "John Smith (test@example.com) called from 555-123-4567. His SSN is 123-45-6789 and he paid "
    "with card 4111-1111-1111-1111."
)


def one(spark, text, **kw):
    return found(with_spans(texts(spark, text), **kw))[0]


def test_fixture_strings(spark):
    frame = with_spans(texts(
        spark, "Contact us at test@example.com for more info.",
        "My SSN is 219-09-9999 and my name is John Smith.", "Payment card: 4111-1111-1111-1111", MIXED,
        "The weather is sunny with clear skies and warm temperatures.", "Hello world",
    ))
    got = found(frame)
    assert got[0] == [("EMAIL_ADDRESS", "test@example.com")]
    assert got[1] == [("US_SSN", "219-09-9999"), ("PERSON", "John Smith")]
    assert got[2] == [("CREDIT_CARD", "4111-1111-1111-1111")]
    assert [t for t, _ in got[3]] == ["PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "US_SSN", "CREDIT_CARD"]
    assert got[4] == [] and got[5] == []


def test_result_shape(spark):
    row = with_spans(texts(spark, MIXED)).first()
    assert row["error"] is None
    for s in row["spans"]:
        assert set(s.asDict()) == {"start", "end", "entity_type", "score", "text"}
        assert MIXED[s["start"]:s["end"]] == s["text"]
        assert s["score"] == round(s["score"], 4)


def test_entity_filter_and_threshold(spark):
    assert [t for t, _ in one(spark, MIXED, entities=["EMAIL_ADDRESS"])] == ["EMAIL_ADDRESS"]
    assert {t for t, _ in one(spark, MIXED, score_threshold=0.99)} == {"EMAIL_ADDRESS", "CREDIT_CARD"}
    assert one(spark, MIXED, entities=["NO_SUCH_TYPE"]) == []


def test_supported_entities():
    listed = RecognizerRegistry().supported_entities("en")
    assert len(listed) == 18 and listed == sorted(listed) and "US_SSN" in listed
    assert "US_SSN" not in RecognizerRegistry().supported_entities("fr")


@pytest.mark.parametrize("text, expected", [
    ("", []),
    (None, []),
    ("a@b.co", ["a@b.co"]),
    ("😀 a@b.co", ["a@b.co"]),
    ("éa@b.co", ["a@b.co"]),
    ("a@b.co,c@d.org", ["a@b.co", "c@d.org"]),
    ("a@b.co\x01c@d.org", ["a@b.co", "c@d.org"]),
    ("\x01a@b.co", ["a@b.co"]),
    ("a@b a@ @b.co", []),
    ("card 4111-1111-1111-1112", []),
    ("card 378282246310005 and 3782 822463 10005", ["378282246310005", "3782 822463 10005"]),
    ("card 4111 1111 1111 1111 123", ["4111 1111 1111 1111"]),
    ("GB82WEST12345698765432", ["GB82WEST12345698765432"]),
    ("GB82 WEST 1234 5698 7654 32", ["GB82 WEST 1234 5698 7654 32"]),
    ("GB82WEST12345698765431", []),
    ("NHS 9434765919, 943 476 5919", ["9434765919", "943 476 5919"]),
    ("NHS 9434765918", []),
    ("AB1234563 AB1234564", ["AB1234563"]),
    ("666-12-3456 000-12-3456 912-12-3456 123-00-4567 123-45-0000", []),
    ("70.23.22.57", ["70.23.22.57"]),
    ("999.1.1.1 1.2.3", []),
    ("fe80:ab:ab:ab:ab:ab:ab:cd", ["fe80:ab:ab:ab:ab:ab:ab:cd"]),
    ("abcd:abcd:abcd:abcd:abcd:abcd:abcd:abcd", ["abcd:abcd:abcd:abcd:abcd:abcd:abcd:abcd"]),
    ("(555) 867-5309 +1 (743) 555-3824 +447911123456", ["(555) 867-5309", "+1 (743) 555-3824", "+447911123456"]),
    ("1555-123-4567", []),
    ("born 03/15/1985, seen 2026-02-28T10:15, 1.2.2024", ["03/15/1985", "2026-02-28T10:15", "1.2.2024"]),
    ("13/45/1985", []),
    ("see https://x.org/a?b=1. Or ftp://x.org", ["https://x.org/a?b=1"]),
    ("Mr. Xu met Dr. No", ["Mr.", "Dr."]),
    ("Parish and New York in France", ["New York", "France"]),
    ("a German and a Sikh", ["German", "Sikh"]),
    ("1BoatSLRHtKNngkdXEeobR76b53LETtpyT", ["1BoatSLRHtKNngkdXEeobR76b53LETtpyT"]),
    ("1BoatSLRHtKNngkdXEeobR76b53LETt0yT", []),
])
def test_values(spark, text, expected):
    assert [v for _, v in one(spark, text)] == expected


@pytest.mark.parametrize("text, kind", [
    ("my bank account 123456789012", "US_BANK_NUMBER"), ("Passport C12345678", "US_PASSPORT"),
    ("driving licence D1234567", "US_DRIVER_LICENSE"),
])
def test_low_scores_need_context(spark, text, kind):
    assert [t for t, _ in one(spark, text)] == [kind]
    assert one(spark, text.split(" ")[-1]) == []
    far = text.rsplit(" ", 1)
    assert one(spark, far[0] + " x" * 30 + " " + far[1]) == []


def test_custom_pattern_lifecycle(spark):
    base = RecognizerRegistry()
    made = base.with_pattern("employee", "EMPLOYEE_ID", [r"EMP-\d{6}", r"E#\d+"], score=0.9)
    assert one(spark, "EMP-123456 and E#7", registry=made) == [("EMPLOYEE_ID", "EMP-123456"), ("EMPLOYEE_ID", "E#7")]
    assert one(spark, "EMP-123456", registry=base) == []
    assert made.custom_df(spark).collect() == [("employee", "EMPLOYEE_ID", 2)]
    gone, removed = made.remove("employee")
    assert removed and not gone.has("employee") and gone.remove("employee")[1] is False
    assert made.without("email_address").supported_entities() == made.supported_entities()
    boosted = base.with_pattern("member", "MEMBER_ID", ["HX-[0-9]{7}"], score=0.3, context_words=["Member"])
    assert one(spark, "the MEMBER id HX-8827431", registry=boosted) == [("MEMBER_ID", "HX-8827431")]
    assert one(spark, "the id HX-8827431", registry=boosted) == []


@pytest.mark.parametrize("bad", [["a*"], [""], []])
def test_bad_patterns(bad):
    with pytest.raises(ValueError):
        RecognizerRegistry().with_pattern("x", "X", bad)


def test_bad_recognizers():
    with pytest.raises(ValueError):
        Recognizer("x", "X", ("a",), 1.5)
    with pytest.raises(ValueError):
        Recognizer("x", "X", ("a",), 0.5, gate="nope")
    with pytest.raises(ValueError):
        term_pattern([])


def test_size_limit(spark):
    row = with_spans(texts(spark, "A" * 200), max_chars=100).first()
    assert "too large: 200 characters" in row["error"] and row["spans"] is None
    assert with_spans(texts(spark, "A" * 100), max_chars=100).first()["error"] is None
    assert with_spans(texts(spark, "A" * 200), max_chars=0).first()["error"] is None


def test_language_per_row(spark):
    frame = spark.createDataFrame([(0, MIXED, "en"), (1, MIXED, "fr"), (2, MIXED, None)], "id int, text string, lang string")
    got = found(with_spans(frame, language_col="lang"))
    assert ("US_SSN", "123-45-6789") in got[0]
    assert {t for t, _ in got[1]} == {t for t, _ in got[2]} == {"EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD"}


def test_documents_properties(docs):
    gated = with_spans(docs).select("doc_id", "text", "spans")
    plain = with_spans(docs, gated=False).select("doc_id", F.col("spans").alias("plain"))
    rows = gated.join(plain, "doc_id").collect()
    assert sum(len(r["spans"]) for r in rows) > 0
    for r in rows:
        assert r["spans"] == r["plain"]
        end = 0
        for s in r["spans"]:
            assert r["text"][s["start"]:s["end"]] == s["text"] and s["start"] >= end
            end = s["end"]


def test_shared_scan_is_exact(docs, spark):
    """A text matches the union exactly when it matches one of the patterns."""
    headed = [p for r in builtin_recognizers() for p in r.patterns]
    one_by_one = " or ".join(f"text rlike '{p.regex}'".replace("\\", "\\\\").replace("\"'", "\"\\'") for p in headed
                             if "'" not in p.regex)
    union = any_of(p for p in headed if "'" not in p.regex).replace("\\", "\\\\")
    extra = texts(spark, MIXED, "70.23.22.57", "x", "Mr. X", "+447911123456").selectExpr(
        "cast(id as bigint) as doc_id", "text", "'en' as lang")
    differing = docs.unionByName(extra).where(f"({one_by_one}) <> (text rlike '{union}')")
    assert differing.count() == 0


def test_regex_runs_once_per_recognizer(docs):
    from veilframe import scan_and_protect

    out = scan_and_protect(docs, "text", ["doc_id"]).where("classification = 'RESTRICTED'")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == len(builtin_recognizers())


def test_reports_scan_once(docs):
    from veilframe.plans import jobs

    for out in (jobs.dashboard(docs, "text", "lang", max_chars=10_000), jobs.column_profile(docs)):
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("regexp_extract_all") == len(builtin_recognizers())


def _brute_force(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (-s[3], s[0] - s[1], s[0], s[2])):
        if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
            kept.append(s)
    return sorted(kept)


_span = st.tuples(st.integers(0, 30), st.integers(1, 8), st.sampled_from("ABC"), st.sampled_from([0.4, 0.5, 1.0]))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(_span, max_size=14), min_size=20, max_size=40))
def test_resolve_overlaps_is_greedy(spark, sets):
    rows = [(i, [(s, s + n, t, p, "x") for s, n, t, p in spans]) for i, spans in enumerate(sets)]
    frame = spark.createDataFrame(rows, f"id int, spans {SPAN_ARRAY}")
    out = frame.selectExpr("id", f"{resolve_overlaps('spans')} as kept").collect()
    for r in out:
        assert [tuple(s) for s in r["kept"]] == _brute_force({s for s in rows[r["id"]][1]}) or \
            [tuple(s)[:4] for s in r["kept"]] == [s[:4] for s in _brute_force(rows[r["id"]][1])]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("a1 \x01😀é\n", max_size=30), min_size=20, max_size=40))
def test_offsets_match_python(spark, values):
    frame = texts(spark, *values)
    out = frame.selectExpr("id", f"{match_offsets('text', 'a+1?|[0-9]+')} as hits").collect()
    for r in out:
        want = [(m.start(), m.end(), m.group()) for m in re.finditer("a+1?|[0-9]+", values[r["id"]])]
        assert [tuple(h) for h in r["hits"]] == want


def test_arrow_detector(spark):
    def find(series):
        return series.map(lambda t: [
            {"start": 0, "end": 2, "entity_type": "HEAD", "score": 0.45678, "text": t[:2]},
            {"start": 0, "end": 1, "entity_type": "LOW", "score": 0.1, "text": t[:1]},
        ] if t else None)

    got = with_spans(texts(spark, "abc a@b.co", None), detectors=[arrow_detector(find)]).orderBy("id").collect()
    assert [(s["entity_type"], s["score"]) for s in got[0]["spans"]] == [("HEAD", 0.4568), ("EMAIL_ADDRESS", 1.0)]
    assert got[1]["spans"] == []
