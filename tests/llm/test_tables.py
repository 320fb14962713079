"""Exact dedup, Jaccard join, decontamination, URL rules, WARC, packing, toxicity, HTML and the pipeline on odd
tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns named like results."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilframe.llm import decontaminate, exact_dedup, html_text, jaccard_join, packing, toxicity, url_filter, warc
from veilframe.llm.common import components, written
from veilframe.llm.queries import URL_RULES, tokenizer_path

SCHEMA = "doc_id long, text string, row long, id long, kept string, key string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in rows], SCHEMA).repartition(3)


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_groups(spark):
    long = "é" * 700
    rows = [(1, "Ab"), (5, "aB"), (3, "ab"), (7, "É"), (8, "é"), (9, None), (2, ""), (4, long), (6, long + "x"), (10, long),
            (11, "x" * 256), (12, "X" * 256), (13, "x" * 257), (5, "aB"), (None, "ab"), (None, None)]
    got = sorted(tuple(r) for r in exact_dedup.exact_groups(table(spark, rows), first_run=4, growth=2).fillna(-1).collect())
    want = []
    for i, t in rows:
        same = [j for j, u in rows if low(u) == low(t)]
        want.append((-1 if i is None else i, max(j if j is not None else -1 for j in same), len(same), hashlib.sha256(low(t).encode()).hexdigest()))
    assert sorted((a, b, c, e) for a, b, c, _, e in got) == sorted(want)
    assert sum(g[3] for g in got) == len({low(t) for _, t in rows})
    left = exact_dedup.drop_copies(table(spark, rows))
    assert left.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(low(r["text"]) for r in left.collect()) == sorted({low(t) for _, t in rows})
    assert exact_dedup.exact_groups(table(spark, rows).where("false")).count() == 0


def brute_classes(rows, width=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(n)]
    group = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in links[i]:
                group[i] = group[j] = min(group[i], group[j])
    return sorted((rows[i][0], min(rows[j][0] for j in range(n) if group[j] == group[i]), len(links[i])) for i in range(n))


@pytest.mark.parametrize("block", [256, 4])
def test_jaccard_classes(spark, block):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(4))
    rows, bases = [(900, None), (901, ""), (902, "  "), (903, "one two"), (904, "ONE  two"), (905, "one two three")], []
    for k in range(12):
        base = [word() for _ in range(rng.choice([7, 40, 120, 600]))]
        bases.append(base)
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(500 + n, r[1]) for n, r in enumerate(rows[6:14])]
    docs = table(spark, rows)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_classes(docs, block=block).collect())
    assert got == brute_classes(rows)
    if block == 256:
        stay = jaccard_join.drop_near_copies(docs)
        assert stay.columns == docs.columns and sorted(r["doc_id"] for r in stay.collect()) == sorted({c for _, c, _ in got})
        assert jaccard_join.jaccard_classes(docs.where("false")).count() == 0


def test_pruning_never_asks_too_much():
    for n, least in jaccard_join.needed_matches(0.8, 1e-6):
        assert 0 < least < 0.8 * n


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7), (300, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[102] == 100 and got[300] == 200


def test_contamination(spark):
    item = "Alpha beta, GAMMA delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, "x " + item.lower() + " y"), (2, "alpha beta gamma delta"), (3, None), (4, ""), (5, "see a-b c. end"), (6, item + ". " + item),
            (6, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (None, "été été A b C"), (8, "beta gamma delta epsilon zeta eta theta iota kappa ñ lambda")]
    bench = [(10, item), (9, "a b c"), (2, None), (3, "..."), (4, "ÉTÉ été"), (9, "a b c")]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = {}
    for i, t in bench:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(str(i))
    want = []
    for i, t in rows:
        w, hit, items = words(t), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    items |= ids
        want.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    docs, tests = table(spark, rows), spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.contamination(docs, tests)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    left = decontaminate.drop_contaminated(docs, tests)
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(w[0]) for w in want if not w[-1])
    assert decontaminate.contamination(docs, tests.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.where("false"), tests).count() == 0
    near = decontaminate.proximity_matches(decontaminate.corpus_words(docs), decontaminate.test_windows(tests, 10), slack=2)
    assert near.select("row").distinct().count() == 6  # three exact ones, one with a word between, two of the short item


def test_url_filter(spark):
    rows = [(1, "http://a.Example.ORG/en/1x?q=1"), (2, "https://example.org/es/"), (3, "http://org/x"), (4, "http://x.com/de/1#a"), (5, "http://com/fr/"),
            (6, None), (7, "no scheme"), (8, "http://xorg/"), (9, "http://org"), (10, "http://a.org?x://b.com/de/"), (1, "http://notexample.org/es/"), (None, "")]
    docs = spark.createDataFrame([(i, u, "a", "b") for i, u in rows], "page_id long, url string, host string, rule string")
    got = {(r["page_id"], r["host"]): (r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(docs, URL_RULES).collect()}
    assert got[1, "a.example.org"] == ("/en/1x", "example.org/en/1", "block") and got[2, "example.org"][1:] == ("example.org/es/", "block")
    assert got[3, "org"] == ("/x", "org/", "allow") and got[4, "x.com"] == ("/de/1", "com/de/", "block") and got[5, "com"][1] == "com/fr/"
    assert got[6, ""] == ("", None, "allow") and got[7, ""] == ("", None, "allow") and got[8, "xorg"][1] is None
    assert got[9, "org"] == ("", None, "allow") and got[10, "a.org"][0] == "" and got[1, "notexample.org"][1] == "org/"
    assert url_filter.filter_urls(docs.where("false"), URL_RULES).count() == 0


def test_mined_rules(spark):
    made = [(f"http://{'bad' if i % 3 == 0 else 'good'}.net/{"xy"[i % 2]}/{i}", "block" if i % 3 == 0 and i % 2 else "allow") for i in range(300)]
    labels = spark.createDataFrame(made, "url string, label string")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(made)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, [], labels, min_support=0.05).collect()}
    assert all(got[i] == verdict for i, (u, verdict) in enumerate(made))


def test_archives(spark, tmp_path):
    rows = [(3, "http://a\r\nb", "x" * 300), (1, None, "x" * 300), (2, "u", ""), (9, "u", None), (4, "é", "WARC/1.1\r\nContent-Length: 3\r\n\r\nñ"), (None, "u", "y" * 50)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, payload string").repartition(2)
    got = {r["page_id"]: tuple(r)[1:] for r in warc.archive_round_trip(pages, segment_bytes=64, chunk_bytes=7).collect()}
    import base64

    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert got[1] == (300, digest("x" * 300), "response", None) and got[3] == (300, digest("x" * 300), "revisit", 1)
    assert got[2][2:] == ("response", None) and got[9] == (0, digest(""), "revisit", 2) and got[4][:2] == (len(rows[4][2].encode()), digest(rows[4][2]))
    assert warc.archive_round_trip(pages.where("false")).count() == 0
    plan = warc.plan_records(pages, "page_id", "url", "html")
    warc.write_archives(plan, str(tmp_path / "w"), segment_bytes=64)
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert records.where("record_type = 'continuation'").count() > 3
    broken = warc.payloads(warc.reassembled(records.where("segment is null or segment <> 2")))
    assert broken.where("error is not null and payload is null").count() > 0
    assert [r[-1] for r in warc.parse_records("f", b"WARC/1.1\r\nContent-Length: 99\r\n\r\nabc")] == ["the record at byte 0 breaks off"]
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3;x=1\r\nabc\r\n0\r\n\r\n", None) == (b"abc", None)
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n9\r\nabc\r\n", None)[1] == "a chunk breaks off"


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["Hello", "wörld,", "it's", "ABC!!", "x1y2", "日本", "<|endoftext|>"]) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "word " * 700), (3, rows[3][1]), (None, "a b")]
    tokens = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_pieces(packing.token_pieces(table(spark, rows), tokenizer_path(), capacity=100), capacity=100, slack=1, carry=8, fan_in=2).collect()
    want = []
    for i, t in rows:
        ids = tokens.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, k, a, len(ids[a:a + 100]), zlib.crc32(np.array(ids[a:a + 100], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 100))]
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert ends[-1] <= 100 and [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()]
    assert len(bins) <= -(-sum(w[3] for w in want) // 100) + 3
    with_ids = packing.token_pieces(table(spark, rows[:3]), tokenizer_path(), with_ids=True).first()
    assert zlib.crc32(bytes(with_ids["ids"])) == with_ids["ids_crc32"]
    assert packing.pack_documents(table(spark, rows).where("false"), tokenizer_path()).count() == 0


def brute_edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_lexicon_automaton():
    rng = random.Random(1)
    terms = ["abcde", "abcdeabcd", "bcd", "ccccc", "abced"]
    automaton = toxicity.LexiconAutomaton(terms)
    for _ in range(3000):
        word = "".join(rng.choice("abcdex") for _ in range(rng.randint(0, 11)))
        near = [(brute_edits(word, t), t) for t in terms if brute_edits(word, t) <= toxicity.edits_allowed(t)]
        found = automaton.find(word)
        assert (found is None) == (not near) and (not near or (found[1], found[0]) == min(near))


def test_toxicity(spark):
    rng = random.Random(6)
    words = ["the", "house", "green", "walks", "river", "stone", "music"]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(1, 80))]
        bad = i % 5 == 0
        for _ in range(3 * bad):
            text.insert(rng.randrange(len(text) + 1), rng.choice(["Grumbler", "blockhead", "nitwit"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(2000, None), (2001, ""), (2002, "grumblr you blockheat nitwitt"), (2003, 'she said "nitwit" is a term'), (None, "stone"), (2002, "grumblr you blockheat nitwitt")]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(table(spark, rows), marks).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["predicted"] == y for i, y in labels) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert by[2002]["predicted"] == 1 and by[2003]["predicted"] == by[2000]["predicted"] == by[2001]["predicted"] == 0
    left = toxicity.drop_toxic(table(spark, rows), marks)
    assert left.count() == sum(r["predicted"] == 0 for r in got) and len(left.columns) == 6
    assert toxicity.toxicity(table(spark, rows), marks.where("false")).where("predicted = 1").count() == 0


def test_misspelt_stems():
    rng = random.Random(2)
    stems = ["abcde*", "bcdab*", "abcdeabc*", "ccd*"]
    automaton = toxicity.LexiconAutomaton(stems)
    for _ in range(3000):
        word = "".join(rng.choice("abcdex") for _ in range(rng.randint(0, 11)))
        # Edits are allowed before the last letter of the stem; what follows it is free.
        least = {s: min((brute_edits(word[:i], s[:-2]) for i, c in enumerate(word) if c == s[-2]), default=99) for s in stems}
        near = [(e, -len(s), s) for s, e in least.items() if e <= toxicity.edits_allowed(s)]
        assert automaton.find(word) == ((min(near)[2], min(near)[0]) if near else None)
    of = toxicity.Featurizer(("abscheul*",))
    assert of.hit("abschulicher") == ("abscheul*", 1) and of.hit("absolut") is None
    edited = toxicity._misspelt("wie Abscheuliches hier", of)
    assert edited != "wie abscheuliches hier" and of.hit(edited.split()[1]) == ("abscheul*", 1)


def toxic_table(spark, bad, clean=400):
    """Rows and labels: every text of ``bad`` is toxic, the clean ones are of harmless words only."""
    rng = random.Random(7)
    plain = [f"{a}{b}" for a in ("wa", "ne", "ti", "ro", "lu", "mi") for b in ("ber", "gel", "nost", "fan", "duk", "zim")]
    filler = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    texts = [f"{filler(9)} {t} {filler(9)}" for t in bad] + [filler(20) for _ in range(clean)]
    labels = [(i, int(i < len(bad))) for i in range(len(texts))]
    return table(spark, list(enumerate(texts))), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_lexicon_keeps_every_term(spark):
    docs, marks = toxic_table(spark, ["grumbler zwackel"] * 14 + ["grumbler"] * 200)
    model = toxicity.fit(docs, marks)
    assert {"grumbler", "zwackel"} <= set(model.terms)
    # The words of one much copied text are no terms.
    rng = random.Random(8)
    body = [f"copy{rng.randrange(10**6)}" for _ in range(150)]
    copies = [" ".join([*body[:k], "other", *body[k + 1:]]) for k in range(0, 150, 5)]
    docs, marks = toxic_table(spark, ["grumbler"] * 60 + copies)
    assert set(t for t in toxicity.fit(docs, marks).terms if not t.endswith("*")) == {"grumbler"}


def test_lexicon_keeps_rare_terms(spark):
    docs, marks = toxic_table(spark, ["zwackel"] * 14 + ["grumbler"] * 800)
    assert {"grumbler", "zwackel"} <= set(toxicity.fit(docs, marks).terms)


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
    <div class="ad">Buy this now.</div><article><h1>Head &amp; line</h1><p>First <b>para</b>graph&nbsp;of the\n page, long enough to read.<script>var x = "</p>";</script>
    <p>Second one &#233; &lt;b&gt; here, also with some words in it.</article><footer>&copy; Footer</footer></body></html>"""
    found = html_text.blocks(page)
    assert [b.text for b in found] == ["Home", "Buy this now.", "Head & line", "First paragraph of the page, long enough to read.",
                                       "Second one é <b> here, also with some words in it.", "© Footer"]
    assert found[0].linked == 4 and found[3].place.role == 1 and found[4].place.name == "p"
    labeller = html_text.fit_labeller([page] * 4, layouts=200, steps=120)
    rows = [(1, page, "u"), (2, None, "u"), (3, "", None), (None, "<p>", "u"), (1, page, "u")]
    pages = spark.createDataFrame([(i, u, h, "x") for i, h, u in rows], "page_id long, url string, html string, text string")
    got = html_text.extract(pages, labeller).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 5 and texts[1] == "\n".join(b.text for b in found[2:5]) and texts[2] == texts[3] == texts[None] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in got) and html_text.extract(pages.where("false"), labeller).count() == 0


def test_labeller_gradients():
    rng = np.random.default_rng(2)
    model = html_text.BlockLabeller(hidden=3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, mask = rng.normal(size=(4, 2, html_text.SIZE)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float)
    y = rng.integers(0, 2, (4, 2)).astype(float)
    loss = lambda: -(mask * (y * np.log(p := model.scores(x, mask)) + (1 - y) * np.log(1 - p))).sum() / mask.sum()
    grads = model.gradients(x, mask, y)
    for name in ("wf", "ub", "cf", "o", "k"):
        at = tuple(rng.integers(0, n) for n in model.weights[name].shape)
        model.weights[name][at] += 1e-4
        up = loss()
        model.weights[name][at] -= 2e-4
        slope = (up - loss()) / 2e-4
        model.weights[name][at] += 1e-4
        assert abs(slope - grads[name][at]) < 1e-3 + 0.05 * abs(slope)


def test_pipeline(spark):
    import corpus_pipeline as cp

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, folder), "test-stage")
        assert docs.columns == before.columns and 0 < docs.count() <= before.count(), name
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len({low(t) for _, t in left}) == len(left) and all(n == 0 for _, _, n in brute_classes(left))
    packed = cp.run(spark, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {i for i, _ in left}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096
