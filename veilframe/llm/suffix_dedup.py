"""Removal of byte strings that occur more than once, by external induced suffix sorting.

Candidate runs (see :mod:`runs`) shard the corpus: equal strings always meet in one shard.  In a shard the
contexts are one text with separators; its suffixes come from external induced sorting with common
prefixes, and neighbours that share at least the asked length are repeats.  Everything is judged on the
bytes of the input, matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.induced_sort import sorted_suffixes
from veilframe.llm.runs import MOST_CLASSES, Windows, merged, repeated_starts, with_spans
from veilframe.llm.words import slices

# A shard of this size takes about 150 MB while it is sorted; what the queues hold beyond their limit is on disk.
LENGTH, SHARD_BYTES, SHARD_TUPLES = 200, 1 << 20, 1 << 18


def repeated_in_shard(contexts: list[tuple], length: int, limit: int = SHARD_TUPLES) -> Iterator[tuple[int, int, int]]:
    """(class, a, b): the starts a to b - 1 of a class repeat.  ``contexts``: (class, size, copies, bytes).

    One separator serves all contexts: each start has ``length`` bytes before the next one, so no common prefix
    that counts can hold a separator.
    """
    raw = np.frombuffer(b"".join(c[3] + b"\0" for c in contexts), np.uint8)
    begins = np.append(0, np.cumsum([len(c[3]) + 1 for c in contexts]))
    text = raw.astype(np.int32) + 2
    text[begins[1:] - 1] = 1
    text[-1] = 0
    sizes, copies = np.array([c[1] for c in contexts]), np.array([c[2] for c in contexts])
    marked = np.zeros(len(text), bool)
    for part in sorted_suffixes(text, length, limit):
        owner = np.searchsorted(begins, part[:, 0], "right") - 1
        owned = part[:, 0] - begins[owner] < sizes[owner]
        group = np.cumsum(part[:, 1] < length)
        count = np.bincount(group, np.where(owned, copies[owner], 0))
        marked[part[owned & (count[group] > 1), 0]] = True
    for n, (name, size, _, _) in enumerate(contexts):
        own = marked[begins[n]:begins[n] + size]
        if own.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            for a, b in edge.reshape(-1, 2).tolist():
                yield name, a, b


def _matcher(length: int, shard_bytes: int):
    def match(rows) -> Iterator[tuple[int, int, int]]:
        held, size, last = [], 0, None
        for key, name, n, copies, data in rows:
            if key != last and size >= shard_bytes:
                yield from repeated_in_shard(held, length)
                held, size = [], 0
            held.append((name, n, copies, data))
            size, last = size + len(data), key
        if held:
            yield from repeated_in_shard(held, length)

    return match


def windows(length: int) -> Windows:
    return Windows("byte", length, max(1, length * 55 // 100), max(1, min(16, length * 8 // 100)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   with_text: bool = False, shard_bytes: int = SHARD_BYTES, most_classes: int = MOST_CLASSES) -> DataFrame:
    """One row per document: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256; with ``with_text`` also kept (binary)
    and removed (the spans as byte offsets).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in this or another
    row; repeated rows are copies of each other.  Null texts are empty.  Ids may be null or repeat.  Other columns are
    not read, so their names cannot clash.  Texts of any length are worked on whole; an empty table gives an empty result.
    """
    base, spans = repeated_starts(docs, id_col, text_col, windows(length), _matcher(length, shard_bytes), False, most_classes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                out = []
                for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                    data = text.as_buffer().to_pybytes()
                    gone = merged([(s["a"], s["b"]) for s in found or ()])
                    kept, at = [], 0
                    for a, b in gone:
                        kept.append(data[at:a])
                        at = b
                    kept = b"".join([*kept, data[at:]])
                    out.append((len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest(),
                                *((kept, [{"a": a, "b": b} for a, b in gone]) if with_text else ())))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [
                    "id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"][:1 + len(columns)])

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, removed array<struct<a: int, b: int>>" * with_text
    return with_spans(base, spans).mapInArrow(cut, schema).withColumn("id", F.col("id")).withColumnRenamed("id", id_col)
