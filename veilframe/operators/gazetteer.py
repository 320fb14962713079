"""Names from a table: a trie of words, walked from every word of many texts at once.

A term is one or more words with one blank between them.  Every beginning of a term has a 64-bit hash, made word by
word from those of its words; the trie is the sorted hashes of all beginnings by their number of words, and the
terms' own.  A batch of texts is one array of code points: its words and their hashes come from running sums, then
all words step down the trie together, and only those that still stand on a beginning take the next step.
A hit is compared with its term letter by letter, so equal hashes never make a span.

The trie holds about 40 bytes a term; it is made on the driver from a list of checked size and broadcast.  Larger lists go to
:func:`veilframe.plans.span_tables.term_spans`, which joins words to the table by a shuffle and finds the same spans.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.custom_detectors import arrow_detector

#: A list is broadcast up to this many bytes of terms and types.
TRIE_BYTES = 64 << 20
#: Code points that are worked on at once.
BATCH_CHARS = 1 << 20
#: Besides letters and digits of any script, these belong to words.
WORD_MARKS = "_#'-"

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_OTHER, _WORD, _UPPER = 1, 2, 3


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Kinds:
    """The kind of every code point met so far: part of a word, a capital letter, or neither."""

    def __init__(self) -> None:
        self.table = np.zeros(0x110000, np.uint8)

    def of(self, points: np.ndarray) -> np.ndarray:
        kinds = self.table[points]
        if not kinds.all():
            for point in np.unique(points[kinds == 0]).tolist():
                group = unicodedata.category(chr(point))
                word = group[0] in "LN" or chr(point) in WORD_MARKS
                self.table[point] = _UPPER if group == "Lu" else _WORD if word else _OTHER
            kinds = self.table[points]
        return kinds


@dataclass
class Words:
    """The words of a run of texts that are joined by line feeds."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    capital: np.ndarray  # the first letter is one
    follows: np.ndarray  # one blank stands between the word before and this one
    name: np.ndarray  # a capital A-Z and small letters a-z


def words_of(points: np.ndarray, kinds: _Kinds) -> Words:
    kind = kinds.of(points)
    inside = kind >= _WORD
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    powers = np.ones(len(points) + 1, np.uint64)
    powers[1:] = _BASE
    powers = np.cumprod(powers, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points.astype(np.uint64) * powers[:-1], dtype=np.uint64)])
    back = np.ones(len(points) + 1, np.uint64)
    back[1:] = _INVERSE
    back = np.cumprod(back, dtype=np.uint64)
    each = _mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    follows = np.zeros(len(start), bool)
    if len(start) > 1:
        follows[1:] = (start[1:] == end[:-1] + 1) & (points[end[:-1]] == 0x20)
    small = np.concatenate([[0], np.cumsum((points >= 0x61) & (points <= 0x7A))])
    first = points[start] if len(start) else points[:0]
    name = (first >= 0x41) & (first <= 0x5A) & (end - start > 1) & (small[end] - small[start] == end - start - 1)
    return Words(start, end, each, kind[start] == _UPPER, follows, name)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points with a line feed after each, and where each text begins (one entry more than texts)."""
    points = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])


def _down(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mixed(state * _BASE + word)


def _among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """For each value its place in the ascending list, or -1."""
    if not len(listed):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
    return np.where(listed[at] == values, at, -1)


@dataclass
class Gazetteer:
    """Terms with their types, ready to be looked up."""

    beginnings: list[np.ndarray]  # by number of words, ascending hashes
    hashes: np.ndarray  # ascending, one per distinct (term, type)
    terms: np.ndarray  # of str, in the same order
    kinds: np.ndarray  # the type's number, in the same order
    types: tuple[str, ...]
    score: float
    capitalised: bool
    follow: Mapping[str, int]
    first: np.ndarray = field(repr=False)  # which top 20 bits a first word's hash may have

    @classmethod
    def of(cls, terms: list[str], types: list[str], *, score: float = 0.6, capitalised: bool = True,
           follow: Mapping[str, int] | None = None) -> Gazetteer:
        """From distinct (term, type) pairs.  Terms that are not words with single blanks between them never match."""
        points, begins = code_points(terms)
        words = words_of(points, _Kinds())
        begin, length = begins[:-1], np.diff(begins) - 1
        first = np.searchsorted(words.start, begin)
        count = np.searchsorted(words.start, begins[1:]) - first
        whole = np.concatenate([[0], np.cumsum(np.where(words.follows, words.end - words.start + 1, words.end - words.start))])
        # A term is all words and single blanks: what they cover is its length.
        fits = (count > 0) & (whole[first + count] - whole[first] == length)
        state, beginnings = np.zeros(len(terms), np.uint64), []
        final = np.zeros(len(terms), np.uint64)
        for depth in range(int(count[fits].max(initial=0))):
            own = fits & (count > depth)
            state[own] = _down(state[own], words.hash[first[own] + depth])
            beginnings.append(np.unique(state[own]))
            last = fits & (count == depth + 1)
            final[last] = state[last]
        listed = sorted(set(types))
        number = np.searchsorted(np.array(listed), np.array(types)) if listed else np.zeros(0, np.int64)
        kept = np.flatnonzero(fits)
        order = kept[np.argsort(final[kept], kind="stable")]
        seen = np.zeros(1 << 20, bool)
        if beginnings:
            seen[(beginnings[0] >> np.uint64(44)).astype(np.int64)] = True
        return cls(beginnings, final[order], np.array(terms, object)[order], np.asarray(number)[order].astype(np.int32),
                   tuple(listed), score, capitalised, dict(follow or {}), seen)

    def hits(self, texts: list[str], kinds: _Kinds) -> list[tuple[int, int, int, int]]:
        """(text, start, end, number of the term) of every occurrence, overlapping ones too."""
        points, begins = code_points(texts)
        words = words_of(points, kinds)
        at = np.flatnonzero(self.first[(_down(np.zeros(1, np.uint64), words.hash) >> np.uint64(44)).astype(np.int64)])
        if self.capitalised:
            at = at[words.capital[at]]
        state, found, here = np.zeros(len(at), np.uint64), [], at.copy()
        for listed in self.beginnings:
            state = _down(state, words.hash[here])
            alive = _among(state, listed) >= 0
            at, here, state = at[alive], here[alive], state[alive]
            hit = np.flatnonzero(_among(state, self.hashes) >= 0)
            for k in hit.tolist():
                a, b = int(words.start[at[k]]), int(words.end[here[k]])
                text = int(np.searchsorted(begins, a, "right")) - 1
                base = int(begins[text])
                value = texts[text][a - base:b - base]
                number = int(np.searchsorted(self.hashes, state[k]))
                while number < len(self.hashes) and self.hashes[number] == state[k]:
                    if self.terms[number] == value:
                        found.append((text, a - base, self._end(words, int(here[k]), number) - base, number))
                    number += 1
            more = here + 1 < len(words.start)
            more[more] = words.follows[here[more] + 1]
            at, here, state = at[more], here[more] + 1, state[more]
            if not len(at):
                break
        return sorted(found)

    def _end(self, words: Words, last: int, number: int) -> int:
        """Where the span ends: some types take following capitalised words along."""
        for _ in range(self.follow.get(self.types[self.kinds[number]], 0)):
            if last + 1 >= len(words.start) or not words.follows[last + 1] or not words.name[last + 1]:
                break
            last += 1
        return int(words.end[last])

    def find(self, texts: pd.Series, kinds: _Kinds) -> pd.Series:
        """Per text the list of its spans; NULL has none."""
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        values = texts.tolist()
        some: list[int] = []
        size = 0
        for i, value in enumerate([*values, None]):
            if value and i < len(values):
                some.append(i)
                size += len(value)
            if some and (i == len(values) or size > BATCH_CHARS):
                for text, a, b, number in self.hits([values[k] for k in some], kinds):
                    out[some[text]].append({
                        "start": a, "end": b, "entity_type": self.types[self.kinds[number]], "score": self.score,
                        "text": values[some[text]][a:b]})
                some, size = [], 0
        return pd.Series(out)


def load(terms: DataFrame, *, most_bytes: int = TRIE_BYTES, **settings) -> Gazetteer | None:
    """The gazetteer of ``terms(term, entity_type)``, or None if the list's measured size is above ``most_bytes``."""
    listed = terms.select("term", "entity_type").where("term is not null and entity_type is not null").distinct()
    size = listed.agg(F.sum(F.octet_length("term") + F.octet_length("entity_type")).alias("n")).first()["n"] or 0
    if size > most_bytes:
        return None
    rows = listed.toArrow()
    return Gazetteer.of(rows.column("term").to_pylist(), rows.column("entity_type").to_pylist(), **settings)


def detector(terms: DataFrame, gazetteer: Gazetteer) -> Callable[[Column], Column]:
    """The gazetteer as a detector: a text column in, a span-array column out."""
    sent = terms.sparkSession.sparkContext.broadcast(gazetteer)
    state: dict = {}

    def find(texts: pd.Series) -> pd.Series:
        kinds = state.setdefault("kinds", None) or _Kinds()
        state["kinds"] = kinds
        return sent.value.find(texts, kinds)

    return arrow_detector(find)
