"""Removal of repeated word sequences, the first occurrence staying, with suffix automata.

Candidate runs (see :mod:`runs`) say which stretches can repeat and shard them, so each stretch meets only the
reference shard that can hold its match instead of every shard of the corpus.  In a shard the automaton
grows with the stretches in the order of their first occurrence; each is streamed through it before it is
added, and where the matching statistics reach the window length an earlier occurrence exists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilframe.llm.runs import MOST_CLASSES, Windows, merged, repeated_starts, with_spans
from veilframe.llm.words import slices

WINDOW, SHARD_WORDS = 20, 20_000


class SuffixAutomaton:
    """Of all sequences added so far; symbols are any hashables."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def _extend(self, last: int, c) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(c)
        if known is not None:
            if length[known] == length[last] + 1:
                return known
            return self._split(last, c, known)
        new = self._state({}, length[last] + 1)
        at = last
        while at >= 0 and c not in nxt[at]:
            nxt[at][c] = new
            at = link[at]
        if at < 0:
            link[new] = 0
        else:
            other = nxt[at][c]
            link[new] = other if length[other] == length[at] + 1 else self._split(at, c, other)
        return new

    def _state(self, moves: dict, length: int) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, at: int, c, other: int) -> int:
        copy = self._state(dict(self.next[other]), self.length[at] + 1)
        self.link[copy] = self.link[other]
        self.link[other] = copy
        while at >= 0 and self.next[at].get(c) == other:
            self.next[at][c] = copy
            at = self.link[at]
        return copy

    def matching_statistics(self, sequence: list) -> list[int]:
        """For each place, the length of the longest match that ends there."""
        state, size, out = 0, 0, []
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            out.append(size)
        return out


def _matcher(window: int, shard_words: int):
    def match(rows) -> Iterator[tuple[int, int, int]]:
        automaton, size, last = SuffixAutomaton(), 0, None
        for key, name, n, _, data in rows:
            if key != last and size >= shard_words:
                automaton, size = SuffixAutomaton(), 0
            words = np.frombuffer(data, np.uint64).tolist()
            statistics = automaton.matching_statistics(words)
            start = None
            for j in range(n):  # the window that starts at j ends at j + window - 1
                if statistics[j + window - 1] >= window:
                    start = j if start is None else start
                elif start is not None:
                    yield name, start, j
                    start = None
            if start is not None:
                yield name, start, n
            automaton.add(words)
            size, last = size + len(words), key

    return match


def windows(window: int) -> Windows:
    return Windows("word", window, max(1, window * 40 // 100), max(1, min(4, window // 5)))


def remove_later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                        with_text: bool = False, shard_words: int = SHARD_WORDS, most_classes: int = MOST_CLASSES) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_removed, kept_sha256; with ``with_text`` also kept (text) and
    removed (spans of words).

    A word goes if a window of ``window`` words that covers it also starts earlier: in a row with a smaller id,
    or earlier in the same row.  Rows with equal ids are ordered by where they are read; null ids come first.
    Null texts have no words.  Words are runs without ASCII white space, unchanged; kept words are joined by
    one space.  Other columns are not read, so their names cannot clash.  Texts of any length are worked on whole; an
    empty table gives an empty result.
    """
    base, spans = repeated_starts(docs, id_col, text_col, windows(window), _matcher(window, shard_words), True, most_classes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                out = []
                for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                    words = text.as_buffer().to_pybytes().split()
                    gone = merged([(s["a"], s["b"]) for s in found or ()])
                    n = len(words)
                    for a, b in reversed(gone):
                        del words[a:b]
                    kept = b" ".join(words)
                    out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(),
                                *((kept.decode(), [{"a": a, "b": b} for a, b in gone]) if with_text else ())))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [
                    "id", "n_words", "n_removed", "kept_sha256", "kept", "removed"][:1 + len(columns)])

    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, removed array<struct<a: int, b: int>>" * with_text
    return with_spans(base, spans).mapInArrow(cut, schema).withColumnRenamed("id", id_col)
