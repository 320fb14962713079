"""The name trie against the term join and against a plain search."""

import random
import re
import time

import pytest
from conftest import found, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe import RecognizerRegistry, scan_and_protect, with_spans
from veilframe.operators import gazetteer as gz
from veilframe.plans import protect
from veilframe.plans.span_tables import term_spans


def plain_version(terms, text, capitalised=True):
    """Every occurrence of every term at word borders, found by a regex for each term."""
    out = []
    for number, term in enumerate(terms):
        if not re.fullmatch(r"[\w#'-]+(?: [\w#'-]+)*", term):
            continue
        for m in re.finditer(rf"(?<![\w#'-])(?={re.escape(term)}(?![\w#'-]))", text):
            if not capitalised or text[m.start()].isupper():
                out.append((m.start(), m.start() + len(term), number))
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("AbÉ -1.", min_size=1, max_size=7), max_size=8, unique=True), st.lists(st.text("AbÉ -1.\n", max_size=30), max_size=6), st.booleans())
def test_hits_are_those_of_a_plain_search(terms, values, capitalised):
    trie = gz.Gazetteer.of(terms, ["X"] * len(terms), capitalised=capitalised)
    got = [[] for _ in values]
    for text, a, b, number in trie.hits(values, gz._Kinds()):
        got[text].append((a, b, trie.terms[number]))
    for value, hits in zip(values, got):
        assert sorted(hits) == sorted((a, b, terms[n]) for a, b, n in plain_version(terms, value, capitalised))


def test_equal_hashes_make_no_span():
    trie = gz.Gazetteer.of(["New York"], ["LOCATION"])
    trie.terms[0] = "New Pork"
    assert trie.hits(["in New York"], gz._Kinds()) == []


def test_types_scores_and_following_words(spark):
    names = spark.createDataFrame([("John", "PERSON"), ("York", "PERSON"), ("New York", "LOCATION"), (None, "PERSON"), ("x", None)], "term string, entity_type string")
    trie = gz.load(names, score=0.7, follow={"PERSON": 2})
    frame = texts(spark, "John Smith Doe Ray met York's John in New York", None, "")
    got = with_spans(frame, registry=RecognizerRegistry(()), detectors=[gz.detector(names, trie)])
    assert found(got) == {0: [("PERSON", "John Smith Doe"), ("PERSON", "John"), ("LOCATION", "New York")], 1: [], 2: []}
    assert {s["score"] for r in got.collect() for s in r["spans"]} == {0.7}


def test_built_in_lists_give_way_to_the_table(spark):
    frame = texts(spark, "Alice of Paris, mail a@b.co, and Zorba of Knossos")
    names = spark.createDataFrame([("Zorba", "PERSON"), ("Knossos", "LOCATION")], "term string, entity_type string")
    assert found(with_spans(frame, names=names))[0] == [("EMAIL_ADDRESS", "a@b.co"), ("PERSON", "Zorba"), ("LOCATION", "Knossos")]
    only = names.where("entity_type = 'PERSON'")
    assert found(with_spans(frame, names=only))[0] == [("LOCATION", "Paris"), ("EMAIL_ADDRESS", "a@b.co"), ("PERSON", "Zorba")]
    assert scan_and_protect(frame, "text", ["id"], names=names).first()["protected_text"] == "Alice of Paris, mail [EMAIL_ADDRESS], and [PERSON] of [LOCATION]"


def document_phrases(docs):
    """One to three neighbouring words from every document, as a list of terms."""
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_#'-]+(?: [\p{L}\p{N}_#'-]+){0,2}"), F.lit(0))
    return docs.select(F.explode(words).alias("term")).withColumn("entity_type", F.expr(
        "case when length(term) % 2 = 0 then 'PERSON' else 'LOCATION' end")).distinct()


def test_equal_to_the_term_join_on_all_documents(spark, docs, monkeypatch):
    names = document_phrases(docs).where("xxhash64(term) % 3 = 0").cache()
    joined = term_spans(docs, "text", ["doc_id"], names)
    by_trie = with_spans(docs, names=names, registry=RecognizerRegistry(())).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    assert joined.count() > 1000
    assert joined.exceptAll(by_trie).isEmpty() and by_trie.exceptAll(joined).isEmpty()
    # A list that is too large to broadcast is joined, with the same result.
    monkeypatch.setattr(protect.gazetteer, "load", lambda _: None)
    large = with_spans(docs, names=names, registry=RecognizerRegistry(()), id_cols=["doc_id"])
    assert large.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*").exceptAll(by_trie).isEmpty()
    with pytest.raises(ValueError, match="id_cols"):
        with_spans(docs, names=names)
    names.unpersist()


def test_size_is_measured(spark):
    names = spark.createDataFrame([("Ab" * 50, "PERSON")], "term string, entity_type string")
    assert gz.load(names, most_bytes=50) is None and gz.load(names) is not None
    assert gz.load(names.where("false")).hits(["Ab"], gz._Kinds()) == []


def test_a_million_terms():
    draw = random.Random(7)
    words = ["".join(draw.choices("abcdefghij", k=8)).capitalize() for _ in range(120_000)]
    terms = list({" ".join(draw.choices(words, k=draw.randint(2, 4))) for _ in range(1_000_000)})
    start = time.time()
    trie = gz.Gazetteer.of(terms, ["PERSON"] * len(terms))
    values = [f"seen {t} and {t.lower()}" for t in terms[:20_000]]
    hits = trie.hits(values, gz._Kinds())
    assert {(h[0], h[1], h[2]) for h in hits} >= {(i, 5, 5 + len(t)) for i, t in enumerate(terms[:20_000])}
    assert len(hits) < 30_000 and time.time() - start < 60
