"""Candidate runs for finding repeated windows: which starts can repeat at all, and which belong together.

A window is ``length`` consecutive symbols (bytes or words).  Each window has an anchor: the place of the
least hash of ``gram`` symbols among its first ``width`` places.  Equal windows have equal anchors, and the
symbols from the anchor on that all windows of an anchor share make its key.  Neighbouring starts with one
anchor are a run.  Only runs whose key occurs elsewhere can hold repeated windows, and equal windows always
share their key, so each key is a problem of its own.

Runs that are equal symbol for symbol (their context: all windows of the run) are one class and are counted, not
paired.  Where a key has but one class, there is nothing to compare.  The classes of all other keys
go to a caller's matcher (suffix order, automaton) that says which starts of a class repeat.  Keys with very
many different classes - a passage in front of ever new texts - are split by start instead, and counted by
Spark: a window is then a key of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import bounded_broadcast, keyed_rows, written
from veilframe.llm.words import mixed, slices, word_hashes

_RNG = np.random.default_rng(11)
_BASES = [int(b) | 1 for b in _RNG.integers(2**40, 2**62, 2)]
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_TEXT_BYTES = 2 << 20
MOST_CLASSES = 8000


@dataclass(frozen=True)
class Windows:
    unit: str  # "byte" or "word"
    length: int
    width: int
    gram: int

    @property
    def shared(self) -> int:
        return self.length - self.width + 1


def symbols(texts: pa.Array, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit number per symbol of all texts, and where each text begins (one entry more)."""
    if unit == "word":
        return word_hashes(texts)
    texts = pc.fill_null(texts, "").cast(pa.binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    return _BYTE[raw], offsets - offsets[0]


class _Powers:
    """Prefix sums of symbols times powers, so that the hash of any stretch is a difference."""

    _known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int):
        n = len(values) + 1
        if len(self._known.get(base, ((),))[0]) < n:
            size = max(n, 1 << 20)
            make = lambda b: np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64)))
            self._known[base] = (make(np.uint64(base)), make(np.uint64(pow(base, -1, 2**64))))
        self.up, self.down = self._known[base]
        self.sums = np.append(np.uint64(0), np.cumsum(values * self.up[:n - 1], dtype=np.uint64))

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.down[start] + np.uint64(0x9E37) * np.asarray(length).astype(np.uint64))


def find_runs(values: np.ndarray, begins: np.ndarray, w: Windows, keys_only: bool = False) -> tuple[np.ndarray, ...]:
    """(text, start, starts in the run, key[, context, context]) for all runs; start counts from the text's begin."""
    empty = np.zeros(0, np.int64)
    if len(values) < w.length:
        return (empty,) * (4 if keys_only else 6)
    one = _Powers(values, _BASES[0])
    n = len(values) - w.gram + 1
    least = (one.of(np.arange(n), w.gram) >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    done = 1
    while done < w.width:  # windows of 1, 2, 4, ... places
        step = min(done, w.width - done)
        least = np.minimum(least[:len(least) - step], least[step:])
        done += step
    counts = np.maximum(np.diff(begins) - w.length + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    if not len(text):
        return (empty,) * (4 if keys_only else 6)
    place = np.arange(len(text)) + np.repeat(begins[:-1] - np.append(0, np.cumsum(counts)[:-1]), counts)
    anchor = (least[place] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    size = np.diff(np.append(first, len(text)))
    text, place, anchor = text[first], place[first], anchor[first]
    key = one.of(anchor, w.shared).view(np.int64)
    out = (text, place - begins[text], size, key)
    if keys_only:
        return out
    span = size - 1 + w.length
    return (*out, one.of(place, span).view(np.int64), _Powers(values, _BASES[1]).of(place, span).view(np.int64))


def _scan(base: DataFrame, w: Windows, keys_only: bool) -> DataFrame:
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, _TEXT_BYTES):
                text, start, size, key, *context = find_runs(*symbols(batch.column(2), w.unit), w, keys_only)
                if keys_only:
                    yield pa.RecordBatch.from_arrays([pa.array(key)], ["key"])
                else:
                    at = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), pa.array(start.astype(np.int32)),
                         pa.array(size.astype(np.int32)), pa.array(key), *map(pa.array, context)],
                        ["row", "id", "start", "size", "key", "c1", "c2"])

    return base.mapInArrow(runs, "key long" if keys_only else "row long, id long, start int, size int, key long, c1 long, c2 long")


#: (contexts of a few whole keys as (class, size, copies, symbols), in order) -> (class, first start, end start) that repeat
Matcher = Callable[[list[tuple]], Iterator[tuple[int, int, int]]]


def repeated_starts(docs: DataFrame, id_col: str, text_col: str, w: Windows, matcher: Callable, earlier_only: bool,
                    most_classes: int = MOST_CLASSES) -> tuple[DataFrame, DataFrame]:
    """(base, spans): base (row, id, text) written, spans (row, spans array<struct<a, b>>) with the stretches of symbols,
    in no order, that repeated windows cover.

    A window counts as repeated if it starts anywhere else as well, or with ``earlier_only`` if it starts earlier:
    in a row with a smaller id (then smaller row number), or earlier in the same row.  Null ids come first.
    """
    base = written(keyed_rows(docs, id_col, text_col), "window-rows")
    keys = written(_scan(base, w, True).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "window-keys")
    runs = written(_scan(base, w, False).join(keys, "key", "left_semi"), "window-runs")
    order = F.struct("id", "row", "start")
    classes = written(runs.groupBy("key", "c1", "c2").agg(
        F.count("*").alias("copies"), F.min(order).alias("first"), F.first("size").alias("size"))
        .withColumn("class", F.monotonically_increasing_id()), "window-classes")
    groups = written(classes.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "window-groups")
    open_ = written(classes.join(groups, "key").select("class", "key", "m", "copies", "size", "first"), "window-open")
    contexts = written(_contexts(base, open_, w), "window-contexts")
    few = contexts.where(F.col("m") <= most_classes)
    # Whole keys in a task, in the order of first occurrence.
    tasks = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = few.repartition(tasks, "key").sortWithinPartitions("key", "first")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        out = []
        for found in matcher(rows):
            out.append(found)
            if len(out) >= 50_000:
                yield _marks(out)
                out = []
        if out:
            yield _marks(out)

    marks = dealt.select("key", "class", "size", "copies", "symbols").mapInArrow(match, "class long, a int, b int")
    many = contexts.where(F.col("m") > most_classes)
    if not many.isEmpty():
        marks = marks.unionByName(_by_start(many, w, earlier_only))
    marks = written(marks.groupBy("class").agg(F.collect_list(F.struct("a", "b")).alias("marks")), "window-marks")
    known = written(classes.join(marks, "class", "left").select("key", "c1", "c2", "copies", "first", "marks"), "window-known")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("size").alias("b")))
    none = F.coalesce("marks", F.array().cast("array<struct<a:int,b:int>>"))
    is_first = (F.col("row") == F.col("first.row")) & (F.col("start") == F.col("first.start"))
    own = F.when(is_first, none).otherwise(whole) if earlier_only else F.when(F.col("copies") > 1, whole).otherwise(none)
    found = runs.join(known, ["key", "c1", "c2"]).select("row", "start", own.alias("own")).where("size(own) > 0")
    spans = found.groupBy("row").agg(F.flatten(F.collect_list(F.transform("own", lambda x: F.struct(
        (F.col("start") + x["a"]).alias("a"), (F.col("start") + x["b"] - 1 + w.length).alias("b"))))).alias("spans"))
    return base, written(spans, "window-spans")


def _marks(found: list[tuple]) -> pa.RecordBatch:
    c, a, b = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["class", "a", "b"])


def _contexts(base: DataFrame, open_: DataFrame, w: Windows) -> DataFrame:
    """The symbols of one member of each open class: bytes, or word hashes of eight bytes."""
    wanted = open_.groupBy(F.col("first.row").alias("row")).agg(F.collect_list(F.struct(
        "class", "key", "m", "copies", "size", "first")).alias("runs"))
    rows = bounded_broadcast(written(open_.select(F.col("first.row").alias("row")).distinct(), "window-touched"))
    some = base.join(rows, "row", "left_semi").join(wanted, "row").select("text", "runs")
    schema = "class long, key long, m long, copies long, size int, first struct<id: long, row: long, start: int>, symbols binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, _TEXT_BYTES):
                if w.unit == "word":
                    hashes, begins = word_hashes(batch.column(0))
                    raw, scale = hashes.tobytes(), 8
                else:
                    texts = [t.as_buffer().to_pybytes() for t in batch.column(0)]
                    raw, scale = b"".join(texts), 1
                    begins = np.append(0, np.cumsum([len(t) for t in texts]))
                lists = batch.column(1)
                fields = lists.flatten()
                owner = np.repeat(begins[:-1], np.diff(lists.offsets.to_numpy()))
                start = fields.field("first").field("start").to_numpy() + owner
                end = start + fields.field("size").to_numpy() - 1 + w.length
                cuts = [raw[a * scale:b * scale] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[fields.field(c) for c in ("class", "key", "m", "copies", "size", "first")], pa.array(cuts, pa.binary())],
                    ["class", "key", "m", "copies", "size", "first", "symbols"])

    return some.mapInArrow(cut, schema)


def _by_start(many: DataFrame, w: Windows, earlier_only: bool) -> DataFrame:
    """The repeating starts of classes whose key has too many of them: windows are counted one by one."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                stretches = part.column(2).to_pylist()
                values = np.frombuffer(b"".join(stretches), np.uint64 if w.unit == "word" else np.uint8)
                values = values if w.unit == "word" else _BYTE[values]
                size = part.column(1).to_numpy()
                begins = np.append(0, np.cumsum(size - 1 + w.length))[:-1]
                owner = np.repeat(np.arange(len(size)), size)
                shift = np.arange(len(owner)) - np.repeat(np.append(0, np.cumsum(size)[:-1]), size)
                place = begins[owner] + shift
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), pa.array(shift.astype(np.int32)), part.column(3).take(at), part.column(4).take(at),
                     *[pa.array(_Powers(values, b).of(place, w.length).view(np.int64)) for b in _BASES]],
                    ["class", "a", "copies", "first", "w1", "w2"])

    starts = written(many.select("class", "size", "symbols", "copies", "first").mapInArrow(
        spread, "class long, a int, copies long, first struct<id: long, row: long, start: int>, w1 long, w2 long")
        .withColumn("at", F.struct("first.id", "first.row", (F.col("first.start") + F.col("a")).alias("start"))), "window-starts")
    counted = written(starts.groupBy("w1", "w2").agg(F.sum("copies").alias("n"), F.min("at").alias("least")), "window-counted")
    again = F.col("at") > F.col("least") if earlier_only else F.col("n") > 1
    return starts.join(counted, ["w1", "w2"]).where(again).select("class", "a", (F.col("a") + 1).alias("b"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching stretches made one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def with_spans(base: DataFrame, spans: DataFrame) -> DataFrame:
    """``base`` (row, id, text) with its spans, null where a row has none; texts move only for rows with spans, or,
    if these are too many to list, for all."""
    listed = spans.select("row")
    size = listed.count() * 24
    if size > 8 << 20:
        return base.join(spans, "row", "left").select("id", "text", "spans")
    touched = F.broadcast(listed)
    rest = base.join(touched, "row", "left_anti").select("id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return base.join(touched, "row", "left_semi").join(spans, "row").select("id", "text", "spans").unionByName(rest)


__all__ = ["Windows", "repeated_starts", "with_spans", "merged", "bounded_broadcast"]
