"""Suffix and substring removal against brute force."""

import hashlib
import random

import numpy as np
import pytest

from veilframe.llm.induced_sort import sorted_suffixes
from veilframe.llm.substring_dedup import SuffixAutomaton, remove_later_copies
from veilframe.llm.suffix_dedup import remove_repeats

SCHEMA = "doc_id long, text string, row long, spans string"


def corpus(seed, n=60):
    """Texts with shared passages, copies, self-repeats, long and empty texts, nulls, repeated rows."""
    rng = random.Random(seed)
    words = ["alpha", "bé", "c", "delta", "eps", "zéta", "eta", "thêta", "i", "kappa"]
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [make(rng.randint(15, 60)) for _ in range(5)]
    texts = [None, "", "   ", "c", make(400)]
    for _ in range(n):
        parts = [make(rng.randint(0, 40)) for _ in range(rng.randint(1, 3))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    texts += texts[5:12] + ["a" * 700, "a" * 450, "ab " * 90]
    rows = [(i * 3 % 997, t, i, "clash") for i, t in enumerate(texts)]
    return rows + [rows[8], (None, rows[9][1], 1, "x")]


def brute_bytes(rows, length):
    seen = {}
    data = [(t or "").encode() for _, t, *_ in rows]
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i:i + length]] = seen.get(d[i:i + length], 0) + 1
    out = []
    for (key, *_), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        starts = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((key, len(d), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, window):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        words = (rows[i][1] or "").encode().split()
        gone = [False] * len(words)
        for j in range(len(words) - window + 1):
            w = tuple(words[j:j + window])
            if w in seen:
                gone[j:j + window] = [True] * window
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((rows[i][0], len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def same(frame, want):
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("most_classes", [2000, 1])
def test_bytes_against_brute_force(spark, most_classes):
    rows = corpus(1)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    same(remove_repeats(docs, length=60, most_classes=most_classes, shard_bytes=2000), brute_bytes(rows, 60))


@pytest.mark.parametrize("most_classes", [2000, 1])
def test_words_against_brute_force(spark, most_classes):
    rows = corpus(2)
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    same(remove_later_copies(docs, window=12, most_classes=most_classes, shard_words=300), brute_words(rows, 12))


def test_texts_and_empty_tables(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text), (2, f"x {text} y")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in remove_later_copies(docs, window=10, with_text=True).collect()}
    assert got[1]["kept"] == text and got[2]["kept"] == "x y" and got[2]["removed"][0]["a"] == 1
    cut = {r["doc_id"]: r for r in remove_repeats(docs, length=40, with_text=True).collect()}
    assert bytes(cut[1]["kept"]) == b"" and bytes(cut[2]["kept"]) == b"x  y"
    none = docs.where("doc_id < 0")
    assert remove_later_copies(none).count() == 0 and remove_repeats(none).count() == 0


@pytest.mark.parametrize("limit,base", [(1 << 20, 1 << 20), (5, 2)])
def test_induced_sorting(limit, base):
    rng = np.random.default_rng(3)
    for trial in range(60):
        text = np.append(rng.integers(1, 4, int(rng.integers(1, 60))), 0)
        if trial % 3 == 0:
            text = np.append(np.tile(text[:4] + 1, 9), 0)
        want, before = [], None
        for i in sorted(range(len(text) - 1), key=lambda i: text[i:].tolist(), reverse=True):
            k = 0
            while before is not None and k < 10 and max(i, before) + k < len(text) and text[i + k] == text[before + k]:
                k += 1
            want.append((i, k))
            before = i
        assert [tuple(r) for p in sorted_suffixes(text, 10, limit, base) for r in p.tolist()] == want


def test_matching_statistics():
    rng = random.Random(4)
    for _ in range(40):
        known = [[rng.randint(0, 2) for _ in range(rng.randint(0, 14))] for _ in range(3)]
        asked = [rng.randint(0, 2) for _ in range(20)]
        automaton = SuffixAutomaton()
        for k in known:
            automaton.add(k)
        parts = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i, len(k) + 1)} | {()}
        want = [max(n for n in range(e + 1) if tuple(asked[e - n:e]) in parts) for e in range(1, 21)]
        assert automaton.matching_statistics(asked) == want
