"""Fill-in-the-middle: texts are cut in three and put together anew, and back, by moving all bytes of a batch at once.

A scan finds the token borders; where the cuts fall, difference arrays over the batch's bytes change how far
a byte moves.  Their running sum is every byte's shift: one scatter writes all outputs, and one gather
by the inverse shifts restores the texts.

Null texts count as empty, and a null id as the empty text in its hash.  Empty texts stay plain.  Repeated rows
and ids pass like others; other columns stay out, so their names cannot clash.  Texts of any length are moved
whole (a text above the slice size stands alone); bytes that are no UTF-8 move with the code point before them.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from veilframe.llm.flat import displacement, flat, unflat
from veilframe.llm.words import slices

SLICE_BYTES = 8 << 20
# The three markers and the names of the forms.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_MARKS = np.array([list(PREFIX), list(SUFFIX), list(MIDDLE)], np.uint8)

_MADE = "id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def draws(id_col: str, salt: str = "1:") -> list[Column]:
    """Four whole numbers of a document: the first 8-digit groups of the hex SHA-256 of the salt and its id."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def marks_in(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, which of the markers, number of the text) of every marker that lies within one text."""
    if len(data) < 3:
        none = np.zeros(0, np.int64)
        return none, none, none
    at = np.flatnonzero((data[:-2] == 0x3C) & (data[2:] == 0x3E))
    kinds = np.full(len(at), -1)
    for k, mark in enumerate(_MARKS):
        kinds[data[at + 1] == mark[1]] = k
    texts = np.searchsorted(begins, at, "right") - 1
    real = (kinds >= 0) & (at + 3 <= begins[texts + 1])
    return at[real], kinds[real], texts[real]


def _cuts(data: np.ndarray, begins: np.ndarray, h1: np.ndarray, h2: np.ndarray):
    """Tokens per text, the places of both cuts, and how many code points begin before each byte.

    A token is a run of A-Z and a-z or one other code point.
    """
    letter = ((data | 0x20) - np.uint8(97)) < 26
    first = (data & 0xC0) != 0x80
    after = np.zeros(len(data), bool)
    after[1:] = letter[:-1]
    after[begins[:-1][begins[:-1] < len(data)]] = False
    starts = first & ~(letter & after)
    before = np.concatenate([[0], np.cumsum(starts)])
    places = np.append(np.flatnonzero(starts), len(data))
    n = np.diff(before[begins])
    cuts = []
    for k in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))):
        inner = places[np.minimum(before[begins[:-1]] + k, len(places) - 1)]
        cuts.append(np.where(k < n, np.where(k > 0, inner, begins[:-1]), begins[1:]))
    return n, cuts[0], cuts[1], np.concatenate([[0], np.cumsum(first)])


def scatter(data: np.ndarray, begins: np.ndarray, h: list[np.ndarray], plain_from: int, spm_below: int):
    """(n, form number, prefix and middle code points, output bytes, where outputs begin); forms 0 plain, 1 psm, 2 spm."""
    n, one, two, points = _cuts(data, begins, h[0], h[1])
    starts, ends = begins[:-1], begins[1:]
    marked = np.zeros(len(starts), bool)
    marked[marks_in(data, begins)[2]] = True
    plain = (starts == ends) | marked | (h[2] % 100 >= plain_from)
    form = np.where(plain, 0, np.where(h[3] % 100 < spm_below, 2, 1))
    out_begins = np.concatenate([[0], np.cumsum(ends - starts + np.where(plain, 0, 9))])
    at, prefix, suffix = out_begins[:-1], one - starts, ends - two
    psm = form == 1
    mark_p = np.where(psm, at, at + 3 + suffix)
    mark_s = np.where(psm, at + 3 + prefix, at)
    mark_m = at + 6 + prefix + suffix
    shifts = np.stack([
        np.where(plain, at, mark_p + 3) - starts,
        np.where(plain, at - starts, mark_m + 3 - one),
        np.where(plain, at - starts, mark_s + 3 - two),
    ], 1).ravel()
    shift = displacement(len(data), np.stack([starts, one, two], 1).ravel(), shifts)
    out = np.empty(int(out_begins[-1]), np.uint8)
    out[np.arange(len(data)) + shift] = data
    for mark, place in zip(_MARKS, (mark_p, mark_s, mark_m), strict=True):
        out[place[~plain][:, None] + np.arange(3)] = mark
    return n, form, points[one] - points[starts], points[two] - points[one], out, out_begins


def gather(out: np.ndarray, out_begins: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts from outputs and forms alone: (bytes, where they begin)."""
    cut = form > 0
    at, kinds, texts = marks_in(out, out_begins)
    inside = cut[texts]
    at, kinds, texts = at[inside], kinds[inside], texts[inside]
    order = np.where(form[cut][:, None] == 1, np.array([0, 1, 2]), np.array([1, 0, 2])).ravel()
    if not np.array_equal(texts, np.repeat(np.flatnonzero(cut), 3)) or not np.array_equal(kinds, order):
        raise ValueError("an output does not hold the markers of its form once each and in order")
    at = at.reshape(-1, 3)
    begins = np.concatenate([[0], np.cumsum(np.diff(out_begins) - np.where(cut, 9, 0))])
    starts, ends, out_ends = begins[:-1], begins[1:], out_begins[1:]
    prefix, middle, suffix = (np.zeros(len(form), np.int64) for _ in range(3))
    from_p, from_m, from_s = (out_begins[:-1].copy() for _ in range(3))
    first, second, third = at.T
    psm = form[cut] == 1
    from_p[cut], from_s[cut], from_m[cut] = np.where(psm, first, second) + 3, np.where(psm, second, first) + 3, third + 3
    one, two = second - first - 3, third - second - 3
    prefix[cut], suffix[cut], middle[cut] = np.where(psm, one, two), np.where(psm, two, one), out_ends[cut] - third - 3
    prefix[~cut] = (ends - starts)[~cut]
    borders = np.stack([starts, starts + prefix, starts + prefix + middle], 1)
    shifts = np.stack([from_p, from_m, from_s], 1) - borders
    # Plain texts are all prefix; their empty other parts move nothing.
    shift = displacement(int(begins[-1]), borders.ravel(), shifts.ravel())
    return out[np.arange(int(begins[-1])) + shift], begins


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain_from: int = 90,
                   spm_below: int = 20) -> DataFrame:
    """Per row: ``id_col``, n (tokens), form, prefix_chars, middle_chars (null if plain) and output (string).

    The cuts and the form depend on the id alone: of every hundred draws ``plain_from`` and above stay plain, and
    of the others those below ``spm_below`` put the suffix first.  A text that is empty or holds a marker stays plain.
    """
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([PLAIN, PSM, SPM])
        for whole in batches:
            for batch in slices(whole, 1, SLICE_BYTES):
                data, begins = flat(batch.column(1))
                h = [batch.column(k).to_numpy() for k in range(2, 6)]
                n, form, prefix, middle, out, out_begins = scatter(data, begins, h, plain_from, spm_below)
                plain = form == 0
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(n, pa.int64()), names.take(pa.array(form)), pa.array(prefix, pa.int64(), mask=plain),
                    pa.array(middle, pa.int64(), mask=plain), unflat(out, out_begins),
                ], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    text = F.coalesce(F.col(f"`{text_col}`").cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), *draws(id_col))
    return rows.mapInArrow(made, _MADE).select(
        F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restored(made: DataFrame, output_col: str = "output", form_col: str = "form", to: str = "restored") -> DataFrame:
    """The frame with the text of every output, rebuilt from the output and its form alone.

    The frame's other columns pass through; one named like ``to`` is refused.
    """
    if to in made.columns:
        raise ValueError(f"the frame has a column {to}; choose another name")
    schema, names = made.schema, made.columns
    forms = {PLAIN: 0, PSM: 1, SPM: 2}

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, len(names), SLICE_BYTES):
                out, begins = flat(batch.column(len(names)))
                form = np.array([forms[f] for f in batch.column(names.index(form_col)).to_pylist()], np.int64)
                columns = [*batch.columns[:len(names)], unflat(*gather(out, begins, form))]
                yield pa.RecordBatch.from_arrays(columns, [*names, to])

    with_bytes = made.select("*", F.col(f"`{output_col}`").cast("binary").alias("_bytes"))
    filled = with_bytes.mapInArrow(back, StructType([*schema.fields, StructField(to, BinaryType())]))
    return filled.withColumn(to, F.col(to).cast("string"))
