"""N-gram Jaccard join with Bayesian candidate pruning.

1. Texts with the same words are one node; copies are never paired.
2. MinHash signatures are cut into bands; texts that agree in a band meet in a bucket.
3. In a bucket, signatures are compared piece by piece.  A pair goes as soon as the posterior probability
   that its similarity reaches the threshold falls below a tolerance.  What a bucket hands on is a
   spanning forest of the surviving pairs, not the pairs.
4. Forests join into candidate groups.  Inside a group every pair is verified exactly on its
   shingle sets, and what comes out are counts of links and again a forest.

Large buckets and groups are cut into blocks, each pair of blocks being a task of bounded size, so
a group of near copies with a third of all rows is spread and emits rows in proportion to its blocks.
A pair at the threshold misses all bands with probability 3e-6 at the default settings.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import components, discard, keyed_rows, written
from veilframe.llm.words import shingle_set, slices, word_hashes

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, BAND_ROWS, PIECE, BLOCK = 32, 5, 32, 256
_HASHES = BANDS * BAND_ROWS
_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 2**32, _HASHES, dtype=np.uint32)
_TIMES = _RNG.integers(0, 2**31, _HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FOLD = _RNG.integers(0, 2**63, BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of the shingles' hashes under each of the permutations."""
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    least = np.full(_HASHES, 2**32 - 1, np.uint32)
    for a in range(0, len(low), 2048):
        np.minimum(least, ((low[a:a + 2048, None] ^ _XOR) * _TIMES).min(0), out=least)
    return least


def needed_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on): with fewer, the posterior probability of reaching the
    threshold is below the tolerance.  Prior: uniform.  Signatures are compared by their low 8 bits."""
    s = threshold + (1 - threshold) / 256
    out = []
    for n in range(PIECE, _HASHES + 1, PIECE):
        below = 0.0  # P(similarity >= s | m of n) = P(Binomial(n + 1, s) <= m)
        for m in range(n + 1):
            below += comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
            if below >= tolerance:
                break
        out.append((n, m))
    return out


def _sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(row, id, text, key, size, sketch, bands); ``key`` is equal for equal word sequences, null for no words."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                hashes, begins = word_hashes(pc.utf8_lower(batch.column(2)))
                keys, sizes, low, bands = [], [], [], []
                for a, b in zip(begins, begins[1:], strict=False):
                    if a == b:
                        keys.append(None), sizes.append(0), low.append(None), bands.append(None)
                        continue
                    own = hashes[a:b]
                    shingles = shingle_set(own, width)
                    least = signature(shingles)
                    keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                    sizes.append(len(shingles))
                    low.append(least.astype(np.uint8).tobytes())
                    folded = (least.reshape(BANDS, BAND_ROWS).astype(np.uint64) * _FOLD).sum(1, dtype=np.uint64)
                    bands.append(((folded >> np.uint64(6)) * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(low, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64()))], ["row", "id", "text", "key", "size", "sketch", "bands"])

    rows = written(keyed_rows(docs, id_col, text_col), "join-rows")
    made = written(rows.mapInArrow(
        sketch, "row long, id long, text string, key binary, size int, sketch binary, bands array<long>"), "sketches")
    discard(docs.sparkSession, rows.scratch)
    return made


def _blocked(members: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """``members`` with ``part`` and ``left``: groups of at most ``block`` members are one part; of larger ones every
    pair of blocks is a part, where rows of the first and the second block are told apart by ``left``."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    mine = F.when(blocks > 1, F.pmod(F.xxhash64("row", F.lit(3)), blocks).cast("int")).otherwise(0)
    spread = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return spread.withColumn("part", F.struct(group, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))).withColumn(
        "left", F.col("mine") <= F.col("other"))


def _collected(members: DataFrame, *columns: str | Column) -> DataFrame:
    return members.groupBy("part").agg(F.collect_list(F.struct("row", "left", *columns)).alias("m"), F.first(F.col("part.i") == F.col("part.j")).alias("same"))


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def bucket_forest(rows: np.ndarray, sketches: np.ndarray, left: np.ndarray, same: bool, needed) -> list[tuple[int, int]]:
    """Edges of a forest over the pairs (all if ``same``, else left with right) that pruning leaves.

    Pairs already connected are not looked at again.
    """
    forest, edges = _Forest(len(rows)), []
    for x in range(len(rows) - 1):
        if not same and not left[x]:
            continue
        others = np.arange(x + 1, len(rows)) if same else np.flatnonzero(~left)
        if len(others) > 8:
            mine = forest.root(x)
            others = others[[forest.root(o) != mine for o in others.tolist()]]
        matches, at = np.zeros(len(others), np.int64), 0
        for n, least in needed:
            if not len(others):
                break
            matches += (sketches[others, at:n] == sketches[x, at:n]).sum(1)
            stay = matches >= least
            others, matches, at = others[stay], matches[stay], n
        edges += [(int(rows[x]), int(rows[o])) for o in others.tolist() if forest.join(x, o)]
    return edges


def verified(sets: list[np.ndarray], copies: np.ndarray, left: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, list[int]]:
    """For each member the documents it is linked with here (copies counted), and its tree's root."""
    n = len(sets)
    links, forest = np.zeros(n, np.int64), _Forest(n)
    sizes = np.array([len(s) for s in sets])
    if n <= 6:
        common = np.zeros((n, n), np.int64)
        for a in range(n):
            for b in range(a + 1, n):
                if min(sizes[a], sizes[b]) >= threshold * max(sizes[a], sizes[b]):
                    common[a, b] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        common += common.T
    else:
        owner = np.repeat(np.arange(n), sizes)
        values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        owner, column = owner[shared], np.cumsum(count > 1)[column[shared]] - 1
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common, width = np.zeros((n, n), np.float32), 2048
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, [a, a + width])
            block = np.zeros((n, width), np.float32)
            block[owner[lo:hi], column[lo:hi] - a] = 1
            common += block @ block.T
    total = sizes[:, None] + sizes[None, :] - common
    linked = common >= threshold * total - 1e-6
    np.fill_diagonal(linked, False)
    if not same:
        linked &= left[:, None] != left[None, :]
    links += linked @ copies
    for a, b in zip(*np.nonzero(np.triu(linked)), strict=True):
        forest.join(int(a), int(b))
    return links, [forest.root(x) for x in range(n)]


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS,
                    threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row per input row: row (a number of our own), ``id_col``, class_row, class_id, n_links.

    Words are runs without white space, lower-cased; shingles are ``width`` words; a text of fewer words is one
    shingle.  ``class_id`` is the least id of all documents connected by links (similarity of at least
    ``threshold``), ``n_links`` the number of other documents this one is linked with directly, copies
    included.  Null and empty texts have no shingle, no link and a class of their own.  Null ids and
    repeated rows are documents like others; a class of null ids only has a null id.  Other columns are not read.
    Texts are read whole, however long; an empty table gives an empty result.
    """
    sketches = _sketches(docs, id_col, text_col, width)
    nodes = written(sketches.where("key is not null").groupBy("key").agg(
        F.min("row").alias("row"), F.min("id").alias("least_id"), F.count("*").alias("copies"), F.first("size").alias("size"),
        F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "join-nodes")
    # Buckets of two and more.
    places = nodes.select("row", F.explode("bands").alias("bucket"))
    full = written(places.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "join-buckets")
    members = places.join(full, "bucket").join(nodes.select("row", "sketch"), "row")
    needed = needed_matches(threshold, tolerance)

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lists, same in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                m = lists.values
                sketch = np.frombuffer(b"".join(m.field("sketch").to_pylist()), np.uint8).reshape(len(m), _HASHES)
                out += bucket_forest(m.field("row").to_numpy(), sketch, m.field("left").to_numpy(zero_copy_only=False), same, needed)
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    edges = _collected(_blocked(members, "bucket", "n", block), "sketch").select("m", "same").mapInArrow(forests, "a long, b long")
    groups = components(edges, "candidates")
    sizes = written(groups.groupBy("component").agg(F.count("*").alias("n")), "candidate-sizes")
    groups = groups.join(sizes, "component").select(F.col("node").alias("row"), F.col("component").alias("group"), "n")
    texts = sketches.select("row", "text").join(groups, "row").join(nodes.select("row", "copies"), "row")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                hashes, begins = word_hashes(pc.utf8_lower(batch.column(1)))
                sets = [shingle_set(hashes[a:b], width).tobytes() for a, b in zip(begins, begins[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (0, 2, 3, 4)], pa.array(sets, pa.binary())],
                                                 ["row", "group", "n", "copies", "shingles"])

    sets = written(texts.select("row", "text", "group", "n", "copies").mapInArrow(
        sets_of, "row long, group long, n long, copies long, shingles binary"), "shingle-sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, links, roots = [], [], []
            for lists, same in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                m = lists.values
                own = m.field("row").to_numpy()
                found, tree = verified([np.frombuffer(s, np.uint64) for s in m.field("shingles").to_pylist()],
                                       m.field("copies").to_numpy(), m.field("left").to_numpy(zero_copy_only=False), same, threshold)
                rows.append(own), links.append(found), roots.append(own[tree])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (rows, links, roots)], ["row", "links", "root"])

    parts = _blocked(sets, "group", "n", block)
    checked = written(_collected(parts, "copies", "shingles").select("m", "same").mapInArrow(
        verify, "row long, links long, root long"), "links")
    discard(docs.sparkSession, sets.scratch)
    links = checked.groupBy("row").agg(F.sum("links").alias("links"))
    classes = components(checked.select(F.col("row").alias("a"), F.col("root").alias("b")), "classes")
    named = nodes.select("key", "row", "least_id", "copies").join(links, "row", "left").join(
        classes.withColumnRenamed("node", "row"), "row", "left").select(
        "key", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "row").alias("class_row"))
    named = written(named, "join-named")
    least = written(named.groupBy("class_row").agg(F.min("least_id").alias("class_id")), "class-ids")
    named = written(named.join(least, "class_row"), "join-classes")
    return sketches.select("row", "id", "key").join(named, "key", "left").select(
        "row", F.col("id").alias(id_col), F.coalesce("class_row", "row").alias("class_row"),
        F.when(F.col("class_row").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are: of every class the row with the least id."""
    key = "__llm_join_key"
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "join-input")
    judged = jaccard_classes(rows, key, text_col, **settings)
    stay = judged.join(rows.select(F.col(key).alias("k"), F.col(f"`{id_col}`").alias("by")), F.col(key) == F.col("k")).groupBy("class_row").agg(
        F.min(F.struct(F.col("by").isNull().alias("none"), "by", "k")).alias("first")).select(F.col("first.k").alias(key))
    return rows.join(stay, key, "left_semi").drop(key)
