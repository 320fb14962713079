"""Cuts read off patterns: what is found in the parts is what is found in the whole."""

import re

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe import RecognizerRegistry, with_spans
from veilframe.functions.cuts import safe_cut
from veilframe.operators.recognizers import builtin_recognizers
from veilframe.plans.protect import explode_spans
from veilframe.plans.span_tables import cut_for, detect_long, term_spans

_atom = st.sampled_from(["a", "b", " ", "-", ".", ",", "[ab]", "[^a]", "[a-c ]", r"\d", r"\w", r"\s", "é", "[^ ,]", r"\."])
_piece = st.recursive(_atom, lambda inner: st.one_of(
    st.lists(inner, min_size=1, max_size=3).map("".join),
    st.tuples(inner, inner).map(lambda p: f"(?:{p[0]}|{p[1]})"),
    st.tuples(inner, st.sampled_from(["*", "+", "?", "{2}", "{0,2}", "*?"])).map(lambda p: f"(?:{p[0]}){p[1]}"),
    inner.map(lambda p: f"(?!{p})"), inner.map(lambda p: f"(?={p})"), inner.map(lambda p: f"(?>{p})"),
    st.sampled_from(["(?<!a)", "(?<! )", "(?<=b)", "(?<!-a)", r"\b"])), max_leaves=6)


def found(patterns, text, base=0):
    return [(i, base + m.start(), m.group()) for i, p in enumerate(patterns) for m in re.finditer(p, text) if m.group()]


@settings(max_examples=600, deadline=None)
@given(st.lists(_piece, min_size=1, max_size=3), st.text("ab -.,1é", max_size=40), st.integers(1, 6))
@example(["a(?! b)"], "a bb", 1)
@example([r"(?:a|b )+"], "a b b ab", 1)
def test_parts_hold_the_matches_of_the_whole(patterns, text, size):
    cut = safe_cut(patterns)
    if cut is None:
        return
    parts, at, got = re.findall(rf"(?s).{{{size}}}.*?(?:{cut})|.+", text), 0, []
    assert "".join(parts) == text
    for part in parts:
        got += found(patterns, part, at)
        at += len(part)
    assert sorted(got) == sorted(found(patterns, text))


@pytest.mark.parametrize("pattern", ["^a", "a$", r"(a)\1", "(?i)a", "(?s:.)a", "(", r"a\zb", "(?!.)a"])
def test_patterns_that_leave_no_cut(pattern):
    assert safe_cut([pattern]) is None and safe_cut(["b", pattern]) is None


def test_what_the_built_in_patterns_leave():
    cut = re.compile(cut_for(builtin_recognizers()))
    for before, after, safe in [(" ", "a", True), (" ", "A", False), (" ", "1", False), (" ", "é", True), ("\n", "A", True),
                                ('"', "A", True), (".", "a", False), ("-", "1", False), ("a", "b", False), (" ", "(", False)]:
        assert (cut.match(before + after) is not None) == safe


def spans(frame):
    return sorted(tuple(r) for r in frame.select("id", "start", "end", "entity_type", "score", "text").collect())


def test_lines_of_any_length(spark, docs):
    """All documents as one line each, in small sections, with custom patterns over blanks."""
    registry = RecognizerRegistry().with_pattern("pair", "PAIR", [r"the [a-z]+ of", r"[a-z]+;"]).with_pattern("q", "QUOTED", ['"[^"\\n]*"'])
    lines = docs.select(F.col("doc_id").alias("id"), F.expr("concat_ws(' ', translate(text, '\\n', ' '), 'ring \"a b\" 555-123-4567 to John Smith')").alias("text"))
    whole = explode_spans(with_spans(lines, registry=registry), ["id"])
    parts = detect_long(lines, "text", ["id"], section_chars=60, registry=registry)
    assert spans(parts) == spans(whole) and parts.count() > lines.count()


def test_one_huge_line_is_spread(spark):
    line = "from John Smith (a@b.co) at 10.0.0.1 on 2026-01-02, see https://x.org/a and call 555-123-4567 or "
    n = 500_000
    frame = spark.range(1).select("id", F.expr(f"repeat('{line}', {n} + int(id))").alias("text"))
    out = detect_long(frame, "text", ["id"], spread=16)
    assert n * len(line) > 48_000_000
    got = out.groupBy("entity_type", F.expr(f"start % {len(line)}").alias("at"), "text").count().collect()
    want = explode_spans(with_spans(frame.select("id", F.lit(line * 3).alias("text"))), ["id"]).where(f"start >= {len(line)} and start < {2 * len(line)}")
    assert {(r["entity_type"], r["at"], r["text"], r["count"]) for r in got} == {
        (r["entity_type"], r["start"] - len(line), r["text"], n) for r in want.collect()}
    tasks = detect_long(frame, "text", ["id"], spread=16).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_terms_in_one_long_line(spark):
    frame = spark.createDataFrame([(1, "New York, and Paris. " * 3000)], "id int, text string")
    terms = spark.createDataFrame([("New York", "LOCATION"), ("Paris", "LOCATION")], "term string, entity_type string")
    rows = term_spans(frame, "text", ["id"], terms).groupBy("text", F.expr("start % 21").alias("at")).count().collect()
    assert {(r["text"], r["at"], r["count"]) for r in rows} == {("New York", 0, 3000), ("Paris", 14, 3000)}
