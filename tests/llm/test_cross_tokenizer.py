"""Cross-tokenizer alignment against a plain version over whole texts, and the sparse product against numpy's."""

import hashlib
import json
from collections import Counter

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veilframe.llm import cross_tokenizer as ct
from veilframe.llm.csr import Csr, from_entries, product
from veilframe.llm.queries import op11_cross_tokenizer, tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def plain_version(rows):
    """Whole texts, every pair of every group in a loop."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    back = ct.byte_level_table()
    docs, count = [], Counter()
    for doc_id, text in rows:
        want = (" " + (text or "")).encode()
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        groups, links = [], Counter()
        if text and b"".join(bytes_a) == want == b"".join(bytes_b):
            ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
            last = 0
            for end in sorted(set(ends_a) & set(ends_b)):
                in_a = [i for i, e in zip(ids_a, ends_a) if last < e <= end]
                in_b = [i for i, e in zip(ids_b, ends_b) if last < e <= end]
                groups.append((in_a, in_b))
                links.update((x, y) for x in in_a for y in in_b)
                last = end
        count.update(links.keys())
        docs.append((doc_id, groups, links))
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for doc_id, groups, links in docs:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()),
            sum(n for p, n in links.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in links.items()),
            hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=repr)


def test_query_equals_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got(op11_cross_tokenizer(spark, "/root/testdata/sf0.001")) == plain_version(rows)


ODD = ["", None, " ", "  two  blanks  ", "a b c", "▁ x", "x ▁y z", "<|endoftext|> <s> </s>", "a\n\nb\tc d", "你好 世界",
       "😀 é à ñ", "é x", "don't it's I'll", "\x00 a", " lead", "trail ", "same words here", "same words here", "ab " * 20_000, "x" * 3000, "﻿ a", "<0x41> b"]


def test_odd_texts_repeats_and_clashing_columns(spark):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(ODD)]
    frame = spark.createDataFrame([(i, t, 1, b"", "") for i, t in rows], "doc_id long, text string, block int, pairs binary, sha string")
    assert got(ct.aligned_tokens(frame.repartition(3), A, B)) == plain_version(rows)


def test_whole_texts_where_cuts_are_not_sound(spark, tmp_path):
    """Another tokenizer file, one that adds a space, is applied to whole texts."""
    rules = json.load(open(A))
    rules["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(rules))
    assert not ct.Sides(path.read_text(), open(B, "rb").read()).cuts
    frame = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    assert got(ct.aligned_tokens(frame, str(path), B)) == plain_version([(1, "one two three")])


def test_empty_table(spark):
    assert ct.aligned_tokens(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_overlaps(spark):
    frame = spark.createDataFrame([(1, "internationalisation of things")], "doc_id long, text string")
    row = ct.aligned_tokens(frame, A, B).first()
    assert max(row["n_a"], row["n_b"]) <= row["n_overlaps"] <= row["n_links"]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(1, 12), st.integers(0, 2**32 - 1), st.integers(1, 40))
def test_product_is_the_matrix_product(n, m, k, seed, strip):
    draw = np.random.default_rng(seed)
    x, y = draw.integers(0, 3, (n, m)), draw.integers(0, 3, (m, k))
    out = np.zeros((n, k), np.int64)
    a, b = (from_entries(*np.nonzero(z), z[np.nonzero(z)], *z.shape) for z in (x, y))
    for rows, columns, values in product(a, b, strip):
        out[rows, columns] += values
    assert np.array_equal(out, x @ y)


def test_product_of_nothing():
    empty = Csr(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
    assert list(product(empty, empty)) == []
    for values in (np.zeros(0, np.int64), np.array([5, -1, 2**62]), np.arange(70_000, dtype=np.uint32)):
        assert np.array_equal(ct.ex.from_planes(ct.ex.planes(values), values.dtype), values)
