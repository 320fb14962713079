"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights, tables in shards.

Training counts the n-grams of every order, and each order is discounted by its own counts of counts.  The
probability of a word after a context is the discounted share of the n-gram if training has it; else the
context's weight times the probability after the shorter context, down to single words, where one class
stands for all unknown words.  A context's weight is what its discounts leave over, divided by the shorter
order's probability of all words not seen after it, so every distribution adds up to one.

The tables are sharded by the hashed n-gram (:mod:`veilframe.llm.exchange`): documents become blocks, a block asks
for each of its distinct n-grams once and gets their counts, and one of the blocks that hold an n-gram adds it to
its context's sums.  So a frequent word or context is spread over all blocks and comes to a shard once
from each.  The shards' tables are written: :func:`model_tables` gives them.

Words are known by 64-bit hashes, n-grams by hashes of these.  Null texts count as empty: their one token is the
end.  A null id is hashed as the empty text when rows are dealt to training.  Repeated rows and ids count and
score each for itself; other columns stay out.  Texts are never cut; one above the block size is a block of its own.  Without
training rows every word is unknown, with probability one.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm import exchange as ex
from veilframe.llm.common import written
from veilframe.llm.words import mixed, slices, word_hashes

BLOCK_BYTES, ORDER, DISCOUNTED = 8 << 20, 2, 5
#: Counts of counts are kept up to this count; the discounts' fallback fits a line to them.
COUNTS_OF_COUNTS = 12
END, START = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
_BLOCK = "block long, entries long, ids array<long>, held array<boolean>, begins binary, tokens binary, words binary"
_WEIGHTS = 100  # kinds of asks: k for the counts of order k, this and k for the context weights of order k


def bucket_of(id_col: str, modulus: int) -> Column:
    """The id's CRC-32, as text, modulo a number; decides which rows train."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % modulus


@dataclass
class Block:
    """The tokens of a run of documents, as numbers of the block's ascending distinct word hashes."""

    begins: np.ndarray
    held: np.ndarray
    tokens: np.ndarray
    words: np.ndarray

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(ascending distinct hashes of the block's n-grams, and for each token which is that of the last ``order`` tokens)."""
        if order == 1:
            return self.words, self.tokens
        ending = word = self.words[self.tokens]
        for k in range(2, order + 1):
            before = np.empty_like(ending)
            before[1:] = ending[:-1]
            before[self.begins[:-1]] = START + np.uint64(k)
            ending = mixed(before * np.uint64(0xD6E8FEB86659FD93) + word + np.uint64(k))
        return np.unique(ending, return_inverse=True)

    def contexts(self, order: int, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for the ``order - 1`` tokens before each token, from the n-grams one shorter; what stands before a
        text is one more."""
        start = START + np.uint64(order)
        place = int(np.searchsorted(keys, start))
        of = np.empty(len(at), np.int64)
        of[1:] = at[:-1]
        of[1:] += of[1:] >= place
        of[self.begins[:-1]] = place
        return np.insert(keys, place, start), of

    def training(self) -> np.ndarray:
        return np.repeat(~self.held, np.diff(self.begins))


def read_block(row: dict) -> Block:
    return Block(ex.from_planes(row["begins"], np.int64), np.array(row["held"], bool),
                 ex.from_planes(row["tokens"], np.int32), ex.from_sorted_planes(row["words"]))


def make_block(texts: pa.Array, held: np.ndarray) -> Block:
    """Words are runs without white space, A-Z lower-cased; every text ends with one more token."""
    hashes, begins = word_hashes(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    n = len(held)
    all_ = np.full(len(hashes) + n, END)
    ends = begins + np.arange(n + 1)
    all_[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(begins))] = hashes
    words, tokens = np.unique(all_, return_inverse=True)
    return Block(ends.astype(np.int64), held, tokens.astype(np.int32), words)


def _blocks(order: int):
    schema = pa.schema([
        ("block", pa.int64()), ("entries", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
        ("begins", pa.binary()), ("tokens", pa.binary()), ("words", pa.binary())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for whole in batches:
            for batch in slices(whole, 2, BLOCK_BYTES):
                b = make_block(batch.column(2), batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
                yield pa.RecordBatch.from_pylist([{
                    "block": ex.block_number(turn), "entries": order * len(b.tokens), "ids": batch.column(0).to_pylist(), "held": b.held.tolist(),
                    "begins": ex.planes(b.begins), "tokens": ex.planes(b.tokens), "words": ex.sorted_planes(b.words)}], schema)
                turn += 1
                ex.give_back()

    return blocks


def _ask_counts(order: int, shards: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = read_block(row)
                training = block.training()
                for level in range(1, order + 1):
                    keys, at = block.grams(level)
                    n = np.bincount(at[training], minlength=len(keys))
                    yield ex.ask_batch(list(ex.asks(level, row["block"], keys, [n.astype(np.uint32)], shards)))
                ex.give_back()

    return ask


def _answer_counts(_: int, shard: ex.Shard):
    """Training count of every entry, twice, plus one where the entry's block is the first to train on it."""
    own = shard.column(0, np.uint32).astype(np.int64)
    total = np.zeros(len(shard.keys), np.int64)
    np.add.at(total, shard.at, own)
    trains = np.flatnonzero(own > 0)
    _, first = np.unique(shard.at[trains], return_index=True)
    owner = np.zeros(len(own), np.int64)
    owner[trains[first]] = 1
    seen = total > 0
    few = np.bincount(total[seen & (total <= COUNTS_OF_COUNTS)], minlength=COUNTS_OF_COUNTS + 1)[1:]
    table = [ex.sorted_planes(shard.keys[seen]), ex.planes(total[seen])]
    return [2 * total[shard.at] + owner], [float(total.sum()), float(seen.sum()), *few.astype(float).tolist()], table


def _answer_weights(_: int, shard: ex.Shard):
    """Denominator and log10 weight of every context; one and zero where training has not seen it.

    A block that has no unseen n-gram after a context needs no weight of it and gets zero.
    """
    count, kept, lower = (np.zeros(len(shard.keys)) for _ in range(3))
    for number, into in enumerate((count, kept, lower)):
        np.add.at(into, shard.at, shard.column(number, np.float64))
    seen = count > 0
    total, left = _left_over(count, kept)
    weight = np.zeros(len(count))
    weight[seen] = np.log10(left[seen] / total[seen] / np.maximum(1 - lower[seen], 1e-15))
    total[~seen] = 1
    table = [ex.sorted_planes(shard.keys[seen]), ex.planes(total[seen]), ex.planes(weight[seen])]
    return [total[shard.at], weight[shard.at] * shard.column(3, np.uint8)], [float(seen.sum())], table


def _left_over(count, kept):
    """(denominator, left over) of contexts; where no count was discounted one more count is set aside."""
    full = count - kept < 1e-9
    return np.where(full, count + 1, count), np.where(full, 1.0, count - kept)


def discounts(counts_of_counts: list[float], discounted: int = DISCOUNTED) -> list[float]:
    """Katz's discounts of the counts 1 to ``discounted`` from n_1, n_2 and so on.

    Where the raw counts of counts give a discount outside 0 to 1 (small or much copied corpora), all are taken
    from a line through log n_r against log r, steep enough to discount.
    """
    n, k = counts_of_counts, discounted
    if all(x > 0 for x in n[:k + 1]):
        common = (k + 1) * n[k] / n[0]
        raw = [((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) for r in range(1, k + 1)] if common < 1 else [0.0]
        if all(0 < d < 1 for d in raw):
            return raw
    points = [(math.log(r), math.log(x)) for r, x in enumerate(n, 1) if x > 0]
    slope = -2.0
    if len(points) > 1:
        x, y = np.array(points).T
        slope = min(-1.05, float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()))
    common = (k + 1) ** (slope + 1)
    return [((1 + 1 / r) ** (slope + 1) - common) / (1 - common) for r in range(1, k + 1)]


@dataclass
class Totals:
    """What is known of an order as a whole: a handful of numbers."""

    tokens: int
    types: int
    discount: list[float]
    denominator: float
    unknown: float  # probability of the class of unknown words (order 1)

    @classmethod
    def of(cls, stats: list[float]) -> Totals:
        tokens, types, few = int(stats[0]), int(stats[1]), stats[2:]
        discount = discounts(few)
        kept = tokens - sum((1 - d) * r * n for r, (d, n) in enumerate(zip(discount, few, strict=False), 1))
        denominator, left = _left_over(np.array(float(tokens)), np.array(kept))
        return cls(tokens, types, discount, float(denominator), float(left / denominator))

    def kept(self, count: np.ndarray) -> np.ndarray:
        """Counts after the discount."""
        table = np.ones(len(self.discount) + 2)
        table[1:-1] = self.discount
        return count * table[np.minimum(count, len(self.discount) + 1)]


def _log_probabilities(block: Block, replies: list[dict], totals: list[Totals], order: int):
    """Per token its log10 probability by the model of ``order``, and its word's training count; the n-grams of that order."""
    count = ex.reply_column(replies, 1, 0, np.int64) >> 1
    first = totals[0]
    with np.errstate(divide="ignore"):
        by_word = np.log10(np.where(count > 0, first.kept(count) / first.denominator, first.unknown))
    keys, at = block.grams(1)
    score, known = by_word[at], count[at]
    for level in range(2, order + 1):
        _, of = block.contexts(level, keys, at)
        keys, at = block.grams(level)
        seen = (ex.reply_column(replies, level, 0, np.int64) >> 1)[at]
        total, weight = (ex.reply_column(replies, _WEIGHTS + level, k, np.float64)[of] for k in (0, 1))
        with np.errstate(divide="ignore"):
            direct = np.log10(totals[level - 1].kept(seen) / total)
        score = np.where(seen > 0, direct, weight + score)
    return score, known, keys, at


def _ask_weights(level: int, totals, shards: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block, replies = read_block(row), row["replies"]
                score, _, keys, at = _log_probabilities(block, replies, totals.value, level - 1)
                contexts, of = block.contexts(level, keys, at)
                keys, at = block.grams(level)
                first = np.empty(len(keys), np.int64)
                first[at] = np.arange(len(at))  # any place of the n-gram will do
                reply = ex.reply_column(replies, level, 0, np.int64)
                own = reply & 1 == 1
                count, place = reply[own] >> 1, first[own]
                sums = [np.bincount(of[place], weights=w, minlength=len(contexts)) for w in (
                    count, totals.value[level - 1].kept(count), 10.0 ** score[place])]
                backs_off = np.zeros(len(contexts), np.uint8)
                backs_off[of[first[reply >> 1 == 0]]] = 1
                yield ex.ask_batch(list(ex.asks(_WEIGHTS + level, row["block"], contexts, [*sums, backs_off], shards)))
                ex.give_back()

    return ask


def _scores(order: int, totals):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block, first = read_block(row), totals.value[0]
                score, known, _, _ = _log_probabilities(block, row["replies"], totals.value, order)
                base = np.log10((known + 1) / (first.tokens + first.types + 1))
                starts, n = block.begins[:-1], len(row["ids"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(np.diff(block.begins)),
                    pa.array(np.add.reduceat((known > 0).astype(np.int64), starts)), pa.array(np.full(n, first.tokens, np.int64)),
                    pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(score, starts))], names)
                ex.give_back()

    return scores


def katz_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
                tables: list | None = None) -> DataFrame:
    """Per row: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Rows where ``held_out`` (a condition on ``docs``) is false or null train the model; all rows are scored.  ``tables``, a list, gets the
    written replies, for :func:`model_tables`.
    """
    if order < 1:
        raise ValueError("the order is one at least")
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    blocks = written(rows.mapInArrow(_blocks(order), _BLOCK), "lm-blocks")
    shards = ex.shard_count(int((blocks.agg(F.sum("entries").alias("n")).first()["n"] or 0) // order))
    known = [ex.answered(blocks.drop("entries").mapInArrow(_ask_counts(order, shards), ex.ASK), _answer_counts, "lm-counts")]
    totals = [Totals.of(ex.sums(known[0], level, COUNTS_OF_COUNTS + 2)) for level in range(1, order + 1)]
    sent = spark.sparkContext.broadcast(totals)
    for level in range(2, order + 1):
        asking = ex.with_replies(blocks, *known).mapInArrow(_ask_weights(level, sent, shards), ex.ASK)
        known.append(ex.answered(asking, _answer_weights, f"lm-weights-{level}"))
    if tables is not None:
        tables += known
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = ex.with_replies(blocks, *known).mapInArrow(_scores(order, sent), schema)
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def model_tables(tables: list[DataFrame]) -> DataFrame:
    """The model as rows (table, gram, value, weight): counts of n-grams under ``count k``, and under ``weight k`` the
    denominators and log10 weights of the contexts of order k; grams by their hash."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = ex.from_sorted_planes(row["values"][0]).view(np.int64)
                weights = row["kind"] > _WEIGHTS
                value = ex.from_planes(row["values"][1], np.float64 if weights else np.int64).astype(np.float64)
                weight = ex.from_planes(row["values"][2], np.float64) if weights else np.zeros(len(keys))
                name = f"weight {row['kind'] - _WEIGHTS}" if weights else f"count {row['kind']}"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(value), pa.array(weight, mask=np.full(len(keys), not weights))],
                    ["table", "gram", "value", "weight"])

    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    return every.where("block is null").select("kind", "values").mapInArrow(rows, "table string, gram long, value double, weight double")
