"""Alignment of two tokenizers over the same bytes, by products of sparse incidence matrices.

Tokens of a byte-level vocabulary (A) and of a piece vocabulary (B) cover the same bytes.  With A and B as token by
byte incidence matrices in compressed sparse rows, the entries of A.Bt, worked out by Gustavson's row product, are the
pairs of tokens that overlap, and their values the bytes they share.  Byte offsets at which tokens of both sides
end cut the bytes into groups; the product of the token by group matrices gives all pairs of one group.

Both vocabularies begin a token at a single space between other characters, so a text is cut there and every
distinct stretch of a block of texts is encoded and aligned once; a text is the sparse row of its stretches.  A text
with a stretch whose tokens do not give its bytes back is aligned as a whole.  How many texts hold a
pair of ids is asked for once per block (:mod:`veilframe.llm.exchange`), so nothing grows with how frequent a pair is
but the blocks that hold it.

Null and empty texts, texts that are no UTF-8, and texts whose joined tokens differ from a space and the text have
no tokens: zeros and an empty ``groups_sha256``.  Repeated rows and ids, and null ids, pass like others and count as texts
of their own.  Other columns stay out.  A text is never cut for its length; a pair is counted in strips, so
one group of many tokens costs time, not memory.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm import exchange as ex
from veilframe.llm.common import written
from veilframe.llm.csr import Csr, from_entries, incidence, product, times_vector
from veilframe.llm.flat import flat, stretches, unflat
from veilframe.llm.words import mixed, slices

BLOCK_BYTES, ENCODE_BATCH, STRIP = 4 << 20, 64, 1 << 18
#: Chunks that are encoded as one text where the cut between them is sound.
TOGETHER = 64
#: Ids of either side fit in this many bits, which leaves 16 to deal pairs to shards evenly.
ID_BITS = 24
SPACE = "▁"  # a space as the piece vocabulary writes it

_FACTS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps"]
_BLOCK = (
    "block long, n_pairs long, ids array<long>, sha array<string>, facts array<array<long>>, doc_begins binary, "
    "doc_chunks binary, chunk_begins binary, chunk_pairs binary, chunk_links binary, pairs binary, pair_docs binary"
)


def byte_level_table() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others,
    in order, for 256, 257 and so on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Sides:
    """Both tokenizers, the bytes of every id, and whether texts may be cut at single spaces."""

    def __init__(self, byte_json: str, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        rules, table = json.loads(byte_json), byte_level_table()
        added = {t["id"] for t in rules.get("added_tokens", [])}
        a_bytes: dict[int, bytes] = {}
        for token, number in self.a.get_vocab().items():
            known = number not in added and all(c in table for c in token)
            a_bytes[number] = bytes(table[c] for c in token) if known else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.a_size = max(a_bytes) + 1
        self.a_bytes = self._table([a_bytes.get(k, b"") for k in range(self.a_size)])
        self.b_bytes = self._table([
            bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)])
        if max(self.a_size, len(pieces)) >= 1 << ID_BITS:
            raise ValueError("a vocabulary is too large for its ids to be paired")
        split = rules.get("pre_tokenizer") or {}
        self.cuts = (
            rules.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
            and not split.get("add_prefix_space") and not any(SPACE in p.lstrip(SPACE) for p in pieces))

    @staticmethod
    def _table(each: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        begins = np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return np.frombuffer(b"".join(each), np.uint8), begins

    def encoded(self, chunks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both sides the ids of chunks that begin with the space which B adds by itself, and where each chunk's begin.

        Chunks between which a text would be cut are encoded in one call and their ids told apart by their bytes.
        """
        joins = np.flatnonzero([self.cuts and _PLAIN_CHUNK.match(c) is not None for c in chunks])
        alone = np.setdiff1d(np.arange(len(chunks)), joins)
        calls: list[tuple[Callable, np.ndarray]] = [
            (lambda texts: [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.a_bytes[1]),
            (lambda texts: self.b.encode([t[1:] for t in texts], num_threads=1), self.b_bytes[1]),
        ]
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        out = []
        for call, table in calls:
            widths = np.diff(table)
            ids, first, length = array("i"), np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
            left = [alone]
            for group in _parts(joins, TOGETHER * ENCODE_BATCH):
                texts = [b"".join(chunks[i] for i in part).decode("utf-8", "replace") for part in _parts(group, TOGETHER)]
                encoded = call(texts)
                for part, own in zip(_parts(group, TOGETHER), encoded, strict=True):
                    ends, borders = np.cumsum(widths[own]), np.cumsum(sizes[part])
                    at = np.searchsorted(ends, borders)
                    if at[-1] + 1 != len(own) or not np.array_equal(ends[at], borders):
                        left.append(part)
                        continue
                    length[part] = np.diff(at, prepend=-1)
                    first[part] = len(ids) + at + 1 - length[part]
                    ids.extend(own)
            for part in _parts(np.concatenate(left), TOGETHER * ENCODE_BATCH):
                for i, own in zip(part.tolist(), call([chunks[i].decode("utf-8", "replace") for i in part]), strict=True):
                    first[i], length[i] = len(ids), len(own)
                    ids.extend(own)
            flat_ids = np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32)
            out.append((flat_ids[stretches(first, length)].astype(np.int64), np.concatenate([[0], np.cumsum(length)])))
        return out


#: A space, then characters that no rule takes for white space first and last.
_PLAIN_CHUNK = re.compile(rb" (?=[\x21-\x7e\xc3])(?s:.*)(?:[\x21-\x7e]|\xc3[\x80-\xbf])\Z")


def _parts(numbers: np.ndarray, most: int) -> list[np.ndarray]:
    return [numbers[k:k + most] for k in range(0, len(numbers), most)]


@dataclass
class Side:
    """The tokens of many chunks in a row: ids, and where they end in the bytes of all chunks."""

    ids: np.ndarray
    begins: np.ndarray  # of each chunk's tokens
    ends: np.ndarray


def _gives_back(ids: np.ndarray, begins: np.ndarray, table: tuple[np.ndarray, np.ndarray], data: np.ndarray,
                starts: np.ndarray) -> np.ndarray:
    """Which chunks the joined bytes of their tokens equal."""
    lengths = np.diff(table[1])[ids]
    ends = np.concatenate([[0], np.cumsum(lengths)])[begins]
    same = np.diff(ends) == np.diff(starts)
    joined = table[0][stretches(table[1][ids], lengths)]
    wanted = np.flatnonzero(same)
    sizes = np.diff(starts)[wanted]
    equal = joined[stretches(ends[wanted], sizes)] == data[stretches(starts[wanted], sizes)]
    wrong = np.bincount(np.repeat(np.arange(len(wanted)), sizes)[~equal], minlength=len(wanted))
    same[wanted[wrong > 0]] = False
    return same


@dataclass
class Aligned:
    """Per chunk: whether its tokens give its bytes, the facts, the groups as text, and its id pairs."""

    good: np.ndarray
    facts: np.ndarray  # one row per fact
    groups: pa.Array
    chunk: np.ndarray  # of each entry
    pair: np.ndarray
    links: np.ndarray


def _joined(values: pa.Array, begins: np.ndarray, mark: str) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(begins, pa.int64()), values).cast(pa.list_(values.type)), mark)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number per pair of ids that keeps both, under 16 bits that deal pairs out evenly."""
    both = (a.astype(np.uint64) << np.uint64(ID_BITS)) | b.astype(np.uint64)
    return (mixed(both) >> np.uint64(48) << np.uint64(48)) | both


def a_of(keys: np.ndarray) -> np.ndarray:
    return ((keys >> np.uint64(ID_BITS)) & np.uint64((1 << ID_BITS) - 1)).astype(np.int64)


def align(sides: Sides, chunks: pa.Array) -> Aligned:
    """Encode and align chunks of bytes, each beginning with a space."""
    data, starts = flat(chunks)
    (a_ids, a_begins), (b_ids, b_begins) = sides.encoded(chunks.to_pylist())
    good = _gives_back(a_ids, a_begins, sides.a_bytes, data, starts) & _gives_back(b_ids, b_begins, sides.b_bytes, data, starts)
    a, b = (
        Side(ids[stretches(begins[:-1][good], np.diff(begins)[good])],
             np.concatenate([[0], np.cumsum(np.where(good, np.diff(begins), 0))]), np.zeros(0))
        for ids, begins in ((a_ids, a_begins), (b_ids, b_begins)))
    a.ends, b.ends = np.cumsum(np.diff(sides.a_bytes[1])[a.ids]), np.cumsum(np.diff(sides.b_bytes[1])[b.ids])
    size, n = int(a.ends[-1]) if len(a.ends) else 0, len(good)
    chunk_of_a = np.repeat(np.arange(n), np.diff(a.begins))
    # Tokens by bytes; every byte has one token of B, so the transposed matrix has one entry a row.
    by_byte = incidence(np.concatenate([[0], a.ends]), np.arange(size), size)
    b_of_byte = incidence(np.arange(size + 1), np.repeat(np.arange(len(b.ids)), np.diff(b.ends, prepend=0)), len(b.ids))
    overlaps = np.zeros(n, np.int64)
    for rows, _, _ in product(by_byte, b_of_byte, STRIP):
        overlaps += np.bincount(chunk_of_a[rows], minlength=n)
    # Groups end where tokens of both sides do.
    borders = np.intersect1d(a.ends, b.ends, assume_unique=True)
    group_a, group_b = np.searchsorted(borders, a.ends), np.searchsorted(borders, b.ends)
    in_group = incidence(np.arange(len(a.ids) + 1), group_a, len(borders))
    of_group = incidence(np.searchsorted(group_b, np.arange(len(borders) + 1)), np.arange(len(b.ids)), len(b.ids))
    parts = []
    for rows, columns, _ in product(in_group, of_group, STRIP):
        order, keys = chunk_of_a[rows], pair_key(a.ids[rows], b.ids[columns])
        parts.append(_counted(order, keys, np.ones(len(keys), np.int64)))
    chunk, pair, links = _counted(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    # The groups as text: ids joined by commas, sides by a bar, groups by semicolons.
    group_chunk = np.searchsorted(np.cumsum(np.where(good, np.diff(starts), 0)), borders)
    n_groups = np.bincount(group_chunk, minlength=n)
    left = _joined(pa.array(a.ids).cast(pa.string()), np.searchsorted(group_a, np.arange(len(borders) + 1)), ",")
    right = _joined(pa.array(b.ids).cast(pa.string()), of_group.begins, ",")
    groups = _joined(pc.binary_join_element_wise(left, right, "|"), np.concatenate([[0], np.cumsum(n_groups)]), ";")
    n_links = np.zeros(n, np.int64)
    np.add.at(n_links, chunk, links)
    return Aligned(good, np.stack([np.diff(a.begins), np.diff(b.begins), n_groups, n_links, overlaps]), groups, chunk, pair, links)


def _counted(chunk: np.ndarray, pair: np.ndarray, links: np.ndarray):
    """Entries of one chunk and pair added up, in chunk and pair order."""
    order = np.lexsort((pair, chunk))
    chunk, pair, links = chunk[order], pair[order], links[order]
    if not len(chunk):
        return chunk, pair, links
    first = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (pair[1:] != pair[:-1])]))
    return chunk[first], pair[first], np.add.reduceat(links, first)


def cut_texts(texts: pa.Array, cuts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, where chunks begin, first chunk of each text): a space and the text, cut before every space that stands
    between characters which no rule of a vocabulary can take for white space."""
    data, begins = flat(texts)
    spaced = np.insert(data, begins[:-1], np.uint8(0x20))
    own = begins[:-1] + np.arange(len(texts))
    border = np.zeros(len(spaced), bool)
    if cuts and len(spaced) > 2:
        plain = (spaced > 0x20) & (spaced < 0x7F)
        latin = np.zeros(len(spaced), bool)  # second byte of a Latin letter
        latin[1:] = (spaced[:-1] == 0xC3) & (spaced[1:] >= 0x80)
        border[1:-1] = (spaced[1:-1] == 0x20) & (plain | latin)[:-2] & (plain | (spaced == 0xC3))[2:]
    border[own] = True
    chunk_begins = np.append(np.flatnonzero(border), len(spaced))
    return spaced, chunk_begins, np.searchsorted(chunk_begins, np.append(own, len(spaced)))


def _block(sides: Sides, ids: list, texts: pa.Array) -> dict:
    """All facts of a block of texts and the pairs it holds."""
    spaced, chunk_begins, first = cut_texts(texts, sides.cuts)
    coded = unflat(spaced, chunk_begins).dictionary_encode()
    aligned = align(sides, coded.dictionary)
    at = coded.indices.to_numpy().astype(np.int64)
    empty = np.diff(flat(texts)[1]) == 0
    odd = np.bincount(np.repeat(np.arange(len(ids)), np.diff(first)), weights=~aligned.good[at], minlength=len(ids)) > 0
    whole = np.flatnonzero(odd & ~empty)
    facts, groups = aligned.facts, aligned.groups
    chunk, pair, links, n = aligned.chunk, aligned.pair, aligned.links, len(aligned.good)
    lone = np.full(len(ids), -1)
    if len(whole):
        bounds = np.concatenate([[0], np.cumsum(chunk_begins[first[whole + 1]] - chunk_begins[first[whole]])])
        data = spaced[stretches(chunk_begins[first[whole]], np.diff(bounds))]
        more = align(sides, unflat(data, bounds))
        lone[whole[more.good]] = n + np.flatnonzero(more.good)
        facts = np.concatenate([facts, more.facts], 1)
        groups = pa.concat_arrays([groups, more.groups])
        chunk, pair, links = np.concatenate([chunk, more.chunk + n]), np.concatenate([pair, more.pair]), np.concatenate([links, more.links])
        n += len(more.good)
    # Texts by chunks: all of a text's chunks, its one whole chunk, or none.
    sizes = np.where(empty | odd, (lone >= 0).astype(np.int64), np.diff(first))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    chunks = np.empty(int(begins[-1]), np.int64)
    usual = ~(empty | odd)
    chunks[stretches(begins[:-1][usual], sizes[usual])] = at[stretches(first[:-1][usual], sizes[usual])]
    chunks[begins[:-1][lone >= 0]] = lone[lone >= 0]
    text_groups = _joined(groups.take(pa.array(chunks)), begins, ";").to_pylist()
    sha = [hashlib.sha256(g.encode()).hexdigest() if k else "" for g, k in zip(text_groups, sizes.tolist(), strict=True)]
    by_chunk = incidence(begins, chunks, n)
    pairs, number = np.unique(pair, return_inverse=True)
    by_pair = Csr(np.searchsorted(chunk, np.arange(n + 1)), number, links, len(pairs))
    once = from_entries(by_chunk.row_numbers(), chunks, np.ones(len(chunks), np.int64), len(ids), n)
    docs = np.zeros(len(pairs), np.int64)
    for _, columns, _ in product(once, by_pair, STRIP):
        docs += np.bincount(columns, minlength=len(pairs))
    return {
        "n_pairs": len(pairs), "ids": ids, "sha": sha, "facts": [times_vector(by_chunk, f).tolist() for f in facts],
        "doc_begins": ex.planes(begins), "doc_chunks": ex.planes(chunks.astype(np.int32)),
        "chunk_begins": ex.planes(by_pair.begins.astype(np.int64)), "chunk_pairs": ex.planes(number.astype(np.int32)),
        "chunk_links": ex.planes(links.astype(np.int32)), "pairs": ex.sorted_planes(pairs), "pair_docs": ex.planes(docs),
    }


def _blocks(byte_json, piece_model):
    schema = pa.schema([
        ("block", pa.int64()), ("n_pairs", pa.int64()), ("ids", pa.list_(pa.int64())), ("sha", pa.list_(pa.string())),
        ("facts", pa.list_(pa.list_(pa.int64()))), *((n, pa.binary()) for n in (
            "doc_begins", "doc_chunks", "chunk_begins", "chunk_pairs", "chunk_links", "pairs", "pair_docs"))])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, turn = None, 0
        for whole in batches:
            for batch in slices(whole, 1, BLOCK_BYTES):
                sides = sides or Sides(byte_json.value, piece_model.value)
                row = _block(sides, batch.column(0).to_pylist(), batch.column(1)) | {"block": ex.block_number(turn)}
                turn += 1
                yield pa.RecordBatch.from_pylist([row], schema)
                del row
                ex.give_back()

    return blocks


def _ask(shards: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs = ex.from_planes(row["pair_docs"], np.int64)
                yield ex.ask_batch(list(ex.asks(0, row["block"], ex.from_sorted_planes(row["pairs"]), [docs], shards)))

    return ask


def _total(kind: int, shard: ex.Shard):
    """Texts per pair; for the shard's own use the largest count under each id of A."""
    total = np.zeros(len(shard.keys), np.int64)
    np.add.at(total, shard.at, shard.column(0, np.int64))
    owner = a_of(shard.keys)
    order = np.lexsort((total, owner))
    last = np.flatnonzero(np.append(owner[order][1:] != owner[order][:-1], True)) if len(order) else order
    top = [x for pair in zip(owner[order][last].tolist(), total[order][last].tolist(), strict=True) for x in pair]
    return [total[shard.at]], top


def _facts(highest):
    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", *_FACTS, "n_best", "count_sum", "groups_sha256"]
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                pairs, top = ex.from_sorted_planes(row["pairs"]), highest.value
                count = ex.reply_column(row["replies"], 0, 0, np.int64)
                if len(count) != len(pairs):
                    raise ValueError("a block did not get an answer for each of its pairs")
                by_pair = Csr(ex.from_planes(row["chunk_begins"], np.int64), ex.from_planes(row["chunk_pairs"], np.int32),
                              ex.from_planes(row["chunk_links"], np.int32).astype(np.int64), len(pairs))
                begins, chunks = ex.from_planes(row["doc_begins"], np.int64), ex.from_planes(row["doc_chunks"], np.int32)
                by_chunk = incidence(begins, chunks, by_pair.rows)
                best = times_vector(by_chunk, times_vector(by_pair, (count == top[a_of(pairs)]).astype(np.int64)))
                total = times_vector(by_chunk, times_vector(by_pair, count))
                columns = [row["ids"], *row["facts"], best, total]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in columns), pa.array(row["sha"], pa.string())], names)
            ex.give_back()

    return facts


def aligned_tokens(docs: DataFrame, byte_json: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: ``id_col``, n_a, n_b, n_groups, n_links, n_overlaps (pairs that share a byte), n_best, count_sum, groups_sha256.

    ``byte_json`` and ``piece_model`` are paths of the tokenizer files on the driver; their size is fixed, so they are
    sent to the executors.  So is the highest count under each id of A, whose number is bounded by the vocabulary.
    """
    spark = docs.sparkSession
    with open(byte_json, encoding="utf-8") as file:
        rules = file.read()
    with open(piece_model, "rb") as file:
        model = file.read()
    sent = spark.sparkContext.broadcast(rules), spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string").cast("binary"), F.lit(b"")).alias("text"))
    blocks = written(rows.mapInArrow(_blocks(*sent), _BLOCK), "aligned-blocks")
    entries = blocks.agg(F.sum("n_pairs").alias("n")).first()["n"] or 0
    replies = ex.answered(
        blocks.select("block", "pairs", "pair_docs").mapInArrow(_ask(ex.shard_count(entries)), ex.ASK), _total, "pair-counts")
    tops = replies.where("block is null").select(F.explode(F.expr(
        "transform(sequence(0, size(stats) div 2 - 1), i -> struct(stats[2 * i] as a, stats[2 * i + 1] as n))")).alias("t"))
    highest = np.zeros(1 << ID_BITS if not entries else Sides(rules, model).a_size, np.int64)
    for row in tops.groupBy(F.col("t.a").cast("long").alias("a")).agg(F.max("t.n").cast("long").alias("n")).collect():
        highest[row["a"]] = row["n"]
    schema = "id long, " + ", ".join(f"{n} long" for n in (*_FACTS, "n_best", "count_sum")) + ", groups_sha256 string"
    out = ex.with_replies(blocks, replies).mapInArrow(_facts(spark.sparkContext.broadcast(highest)), schema)
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out
