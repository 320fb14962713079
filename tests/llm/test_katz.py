"""The Katz model against a plain version with dictionaries, and its distributions' sums."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from veilframe.llm import katz
from veilframe.llm.queries import op12_katz_scores

SF = "/root/testdata/sf0.001"
START, END = 1, 2  # no words


class Plain:
    """Contexts are tuples of words; START stands before a text, END is its end."""

    def __init__(self, texts, order):
        self.order = order
        self.count = [None] + [defaultdict(Counter) for _ in range(order)]
        for words in texts:
            padded = [START] * (order - 1) + words
            for t in range(order - 1, len(padded)):
                for k in range(1, order + 1):
                    self.count[k][tuple(padded[t - k + 1:t])][padded[t]] += 1
        self.kept, self.n = [None], [None]
        for k in range(1, order + 1):
            of = Counter(c for words in self.count[k].values() for c in words.values())
            d = katz.discounts([float(of[r]) for r in range(1, katz.COUNTS_OF_COUNTS + 1)])
            self.kept.append(lambda c, d=d: c * d[c - 1] if c <= len(d) else c)
        self.cache = {}

    def rest(self, k, context):
        if (k, context) not in self.cache:
            words = self.count[k][context]
            total, kept = sum(words.values()), sum(map(self.kept[k], words.values()))
            total, left = (total + 1, 1.0) if total - kept < 1e-9 else (total, total - kept)
            lower = sum(self.p(w, context[1:]) for w in words) if k > 1 else 0.0
            self.cache[k, context] = total, left / total / (1 - lower)
        return self.cache[k, context]

    def p(self, word, context):
        k = len(context) + 1
        words = self.count[k].get(context, {})
        if k > 1 and not words:
            return self.p(word, context[1:])
        total, weight = self.rest(k, context)
        if words.get(word):
            return self.kept[k](words[word]) / total
        return weight * (self.p(word, context[1:]) if k > 1 else 1.0)

    def score(self, words):
        padded = [START] * (self.order - 1) + words
        return sum(math.log10(self.p(padded[t], tuple(padded[t - self.order + 1:t]))) for t in range(self.order - 1, len(padded)))


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lower) if w] + [END]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def plain_version(rows, order):
    model = Plain([words_of(t) for i, t in rows if not held(i)], order)
    single = model.count[1][()]
    n, v = sum(single.values()), len(single)
    out = []
    for i, t in rows:
        words = words_of(t)
        base = sum(math.log10((single[w] + 1) / (n + v + 1)) for w in words)
        out.append((i, held(i), len(words), sum(w in single and single[w] > 0 for w in words), n, base, model.score(words)))
    return sorted(out, key=repr), model


def same(got, want):
    got = sorted((tuple(r) for r in got), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_query_equals_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want, _ = plain_version(rows, katz.ORDER)
    same(op12_katz_scores(spark, SF).collect(), want)
    out = [r for r in want if r[1]]
    assert sum(r[6] for r in out) > sum(r[5] for r in out)  # better than the base on texts it has not seen


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders_with_many_blocks_and_shards(spark, order, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows = [(i, (t or "")[:1500]) for i, t in rows]
    monkeypatch.setattr(katz, "BLOCK_BYTES", 9000)
    monkeypatch.setattr(katz.ex, "shard_count", lambda entries: 5)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(katz.katz_scores(frame, katz.bucket_of("doc_id", 7) == 2, order=order).collect(), plain_version(rows, order)[0])


def test_distributions_add_up_to_one():
    texts = [["a", "b", "a", "c", END], ["b", "b", "a", END], ["a", "c", END]]
    model = Plain(texts, 3)
    known = [*model.count[1][()], "unknown"]
    for context in [(START, START), (START, "a"), ("a", "b"), ("b", "zzz"), ("zzz", "a"), ("a", "c")]:
        assert sum(model.p(w, context) for w in known) == pytest.approx(1)


ODD = [(1, ""), (2, None), (3, "  \t\n "), (4, "A a a A"), (4, "A a a A"), (None, "x y   z"), (5, "word " * 30_000), (6, "É é"), (7, "</s> <s>")]


def test_odd_rows_and_clashing_columns(spark):
    rows = ODD + [(i, f"a b c{i}") for i in range(10, 40)]
    frame = spark.createDataFrame([(i, t, True, 1, b"") for i, t in rows], "doc_id long, text string, held_out boolean, block long, tokens binary")
    same(katz.katz_scores(frame, katz.bucket_of("doc_id", 7) == 2).collect(), plain_version(rows, 2)[0])


def test_empty_table_and_no_training_rows(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([], "doc_id long, text string")
    assert katz.katz_scores(frame, F.lit(True)).collect() == []
    one = katz.katz_scores(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).first()
    assert one["n_known"] == one["train_tokens"] == 0 and one["score"] == 0


def test_model_tables(spark):
    from pyspark.sql import functions as F

    tables = []
    frame = spark.createDataFrame([(1, "a b a b"), (2, "a c")], "doc_id long, text string")
    katz.katz_scores(frame, F.lit(False), tables=tables)
    rows = katz.model_tables(tables).groupBy("table").agg(F.count("*").alias("n"), F.sum("value").alias("v")).collect()
    assert {r["table"]: (r["n"], r["v"]) for r in rows if r["table"].startswith("count")} == {"count 1": (4, 8.0), "count 2": (6, 8.0)}
    assert {r["table"]: r["n"] for r in rows}["weight 2"] == 4


@pytest.mark.parametrize("n", [[0] * 12, [5] + [0] * 11, [10, 50, 3, 2, 1, 1] + [0] * 6, [100, 40, 20, 12, 8, 6] + [1] * 6, [1, 1, 1, 1, 1, 1] + [0] * 6])
def test_discounts_are_shares(n):
    assert all(0 < d < 1 for d in katz.discounts([float(x) for x in n]))
