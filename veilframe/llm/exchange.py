"""Blocks of documents that ask a partitioned table for values of their own keys.

A block is one written row that stands for a bounded run of documents.  It asks for each of its distinct keys
once, in ascending order; keys are dealt to shards by range of their hashed value, so a block's sorted keys are already
in shard order and the replies, put in shard order, line up with them.  A shard holds an even share of all distinct
(block, key) entries: however frequent a key is, it comes once from each block.  Asks and replies travel as
arrays of bytes, highest bytes together, which compress far better than rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import written

#: Entries of (block, key) that a shard holds on average.
SHARD_ENTRIES = 1 << 18

ASK = "kind int, shard long, block long, keys binary, values array<binary>"
REPLY = "block long, kind int, shard long, values array<binary>, stats array<double>"


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task should not hold its last block's."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


@cache
def _libc() -> ctypes.CDLL:
    return ctypes.CDLL(None)


def block_number(turn: int) -> int:
    """A number that no other block of the job has: the task's and the block's within it."""
    context = TaskContext.get()
    return ((context.partitionId() if context else 0) << 32) + turn


def planes(values: np.ndarray) -> bytes:
    """The values' bytes, all first ones, all second ones and so on, compressed; their length stands before them."""
    if not len(values):
        return b""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return raw.nbytes.to_bytes(8, "little") + pa.compress(raw.reshape(-1), codec="zstd", asbytes=True)


def from_planes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    if not data:
        return np.zeros(0, dtype)
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(dtype)


def sorted_planes(keys: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit keys as the planes of their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)).astype(np.uint64))


def from_sorted_planes(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def shard_count(entries: int, per_shard: int = SHARD_ENTRIES) -> int:
    return max(1, -(-entries // per_shard))


def asks(kind: int, block: int, keys: np.ndarray, values: list[np.ndarray], shards: int) -> Iterator[tuple]:
    """One ask per shard that owns any of the block's ascending keys."""
    width = (1 << 64) // shards + 1
    edges = np.searchsorted(keys, np.array([width * s for s in range(1, shards)], np.uint64)) if shards > 1 else np.zeros(0, np.int64)
    bounds = [0, *edges.tolist(), len(keys)]
    for shard, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if b > a:
            yield kind, shard, block, sorted_planes(keys[a:b]), [planes(v[a:b]) for v in values]


def ask_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["kind", "shard", "block", "keys", "values"])


@dataclass
class Shard:
    """All asks of one shard: the distinct keys ascending, and for each entry, block by block, which key it is."""

    keys: np.ndarray
    at: np.ndarray
    blocks: list[int]  # ascending
    bounds: np.ndarray  # where each block's entries begin, one more than blocks
    values: list[list[bytes]]  # per block

    def column(self, number: int, dtype) -> np.ndarray:
        return np.concatenate([from_planes(v[number], dtype) for v in self.values])


def answered(asked: DataFrame, answer: Callable[[int, Shard], tuple], purpose: str) -> DataFrame:
    """The written replies to the asks.

    ``answer(kind, shard)`` gives the columns of the reply, one value per entry, some sums over the shard's keys, and
    if it likes the shard's table as arrays of bytes; sums and table stand in one more row per shard, whose block is null.
    """
    def reply(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        kind, number = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
        keys = [from_sorted_planes(k) for k in table.column("keys").to_pylist()]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        shard = Shard(distinct, at, table.column("block").to_pylist(), bounds, table.column("values").to_pylist())
        columns, stats, *own = answer(kind, shard)
        rows = [(block, kind, number, [planes(c[a:b]) for c in columns], None)
                for block, a, b in zip(shard.blocks, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        rows.append((None, kind, number, own[0] if own else None, stats))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.float64())]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                        names=["block", "kind", "shard", "values", "stats"])

    return written_once(asked.groupBy("kind", "shard").applyInArrow(reply, REPLY), purpose)


def written_once(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written like :func:`written`, its shuffle files deleted as soon as it is; they are not read again."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return written(df, purpose)
    finally:
        conf.set(key, before)


def sums(replies: DataFrame, kind: int, length: int) -> list[float]:
    """The shards' sums added up; a fixed handful of numbers."""
    row = replies.where((F.col("kind") == kind) & F.col("block").isNull()).agg(
        *[F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(length)]).first()
    return [row[k] or 0.0 for k in range(length)]


def with_replies(blocks: DataFrame, *replies: DataFrame) -> DataFrame:
    """Every block with all replies to it, as ``replies`` (array of kind, shard, values)."""
    every = replies[0]
    for more in replies[1:]:
        every = every.unionByName(more)
    own = every.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "values")).alias("replies"))
    return blocks.join(own, "block", "left")


def reply_column(replies: list[dict] | None, kind: int, number: int, dtype) -> np.ndarray:
    """One column of the replies of a kind, in the order of the block's ascending keys."""
    own = sorted((r["shard"], r["values"][number]) for r in replies or [] if r["kind"] == kind)
    return np.concatenate([from_planes(v, dtype) for _, v in own]) if own else np.zeros(0, dtype)
