"""Mined url rules against a plain miner that tries every set of tokens."""

import math
import random
import time
from itertools import combinations

import pytest

from veilframe.llm import url_filter


def plain_rules(rows, min_support, min_confidence):
    """Every set of tokens with a label that reaches support and confidence, without those that a part of them makes idle."""
    least, found = math.ceil(min_support * len(rows)), {}
    tokens = sorted({t for ts, _ in rows for t in ts})
    for size in range(1, max(len(ts) for ts, _ in rows) + 1):
        for part in combinations(tokens, size):
            covered = [label for ts, label in rows if set(part) <= ts]
            for label in set(covered):
                n = covered.count(label)
                if n >= least and n / len(covered) >= min_confidence:
                    found[frozenset(part), label] = (n / len(covered), n / len(rows))
    return {(part, label): v for (part, label), v in found.items()
            if not any(p < part and l == label and found[p, l][0] >= v[0] for p, l in found)}


def plain_verdict(rules, tokens):
    hits = [(conf, support, len(part), label) for (part, label), (conf, support) in rules.items() if part <= tokens]
    return max(hits)[3] if hits else None


@pytest.mark.parametrize("seed", range(4))
def test_like_a_plain_miner(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        bad = rng.random() < 0.4
        tokens = {f"host={rng.choice('ab')}", f"path0={rng.choice('xy')}", "scheme=http"}
        if rng.random() < 0.5:
            tokens |= {"pair=1", "pair=2"}  # these two always come together
        if bad and rng.random() < 0.8:
            tokens.add("field=ad")
        rows.append((frozenset(tokens), "block" if bad else "allow"))
    labelled = spark.createDataFrame([(sorted(ts), label) for ts, label in rows], "tokens array<string>, label string").repartition(3)
    support, confidence = rng.choice([(0.05, 0.6), (0.1, 0.75)])
    mined = url_filter.mine_rules(labelled, support, confidence)
    want = plain_rules(rows, support, confidence)
    # Rules over classes are the plain rules with one member of each class.
    got = {}
    for r in mined.collect():
        spread = [frozenset()]
        for members in r["classes"]:
            spread = [s | {m} for s in spread for m in members]
        for part in spread:
            got[part, r["verdict"]] = (r["confidence"], r["support"])
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    asked = [sorted(rng.sample(sorted({t for ts, _ in rows for t in ts}), rng.randint(0, 6))) for _ in range(80)]
    urls = spark.createDataFrame(list(enumerate(asked)), "row long, tokens array<string>")
    found = {r["row"]: r["verdict"] for r in url_filter.matched(urls, mined).collect()}
    assert found == {k: v for k, ts in enumerate(asked) if (v := plain_verdict(want, set(ts)))}


def test_thirty_tokens_that_always_come_together(spark):
    path = "/".join(f"step{k}x" for k in "abcdefghijklmnopqrstuvwxyzABCD")
    made = [(f"http://one.net/{path}/{i}", "block") for i in range(150)] + [(f"http://two.net/p/{i}", "allow") for i in range(150)]
    labels = spark.createDataFrame(made, "url string, label string")
    start = time.time()
    pages = spark.createDataFrame([(1, f"https://other.org/{path}/q"), (2, "http://two.net/r"), (3, "http://third.net/x"), (4, f"http://one.net/{'y' * 200_000}")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, [], labels, default="open").collect()}
    assert time.time() - start < 60
    assert got == {1: "block", 2: "allow", 3: got[3], 4: "block"}


def test_long_labels_and_endings(spark):
    label = "x" * 3000
    labels = spark.createDataFrame([(f"http://a.net/f{i}.{'longending' * 3}", label) for i in range(20)] + [(f"http://b.net/{i}.html", "allow") for i in range(20)], "url string, label string")
    pages = spark.createDataFrame([(1, f"http://c.net/z.{'longending' * 3}")], "page_id long, url string")
    assert url_filter.filter_urls(pages, [], labels).first()["verdict"] == label
