"""Fill-in-the-middle against a plain version, and odd tables."""

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from veilframe.llm import fill_in_middle as fim


def plain_version(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def run(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, n int, form string, output string, h1 long, id string, _bytes binary")
    made = fim.fill_in_middle(frame)
    return [tuple(r) for r in fim.restored(made).collect()]


def check(spark, texts):
    rows = [(i, t, 0, "", "", 0, "", b"") for i, t in enumerate(texts)]
    got = sorted(run(spark, rows))
    assert got == sorted((i, *plain_version(i, t), t or "") for i, t in enumerate(texts))


def test_odd_texts(spark):
    check(spark, ["", None, "a", "ab cd", "<P>", "x<S>y", "<M", "<P <S <M", "é😀 \x00\n a", "<" * 50, "P>" * 40, "ab" * 40_000, "<P" * 20, " " * 30] * 5)


def test_empty_table_null_ids_and_repeats(spark):
    assert run(spark, []) == []
    rows = [(None, "one two", 0, "", "", 0, "", b"")] * 2 + [(7, "same words", 0, "", "", 0, "", b"")] * 2
    got = run(spark, rows)
    assert sorted(got, key=repr) == sorted([(None, *plain_version(None, "one two"), "one two")] * 2 + [(7, *plain_version(7, "same words"), "same words")] * 2, key=repr)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab<>PSM é😀\n", max_size=25), min_size=30, max_size=60))
def test_made_texts(spark, texts):
    check(spark, texts)


def test_a_broken_output_is_refused(spark):
    bad = spark.createDataFrame([("<P>a<M>b", "psm")], "output string, form string")
    with pytest.raises(Exception, match="markers"):
        fim.restored(bad).collect()
    with pytest.raises(ValueError):
        fim.restored(bad.selectExpr("*", "1 as restored"))
