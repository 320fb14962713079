"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks.  Each block is described by hashed vectors of its tag path
(with class and id words) and of its words, and by a few figures.  A bidirectional LSTM in numpy reads the
sequence in both directions and labels every block, so the whole page is the context of each.

It is trained on a bounded sample of pages: those whose containers name their role teach by it, and the
texts of the sample are set anew into pages of many layouts whose roles are known because they
were made.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.words import slices

SAMPLE_PAGES, LAYOUTS, STEPS, BATCH, HIDDEN = 400, 600, 240, 32, 20
PATH_SIZE, WORD_SIZE = 64, 32
#: Blocks times pages that a training step or a reading of pages takes together.
CELLS = 20_000

# A quotation mark counts at the start of an attribute's value only, as browsers read it.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/<>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>=]+|=)*+)>|<|[^<]+", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
# Tags within a line of text; all others begin a new block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is text to the parser, whatever it looks like, up to their end tag.
RAW = frozenset("script style textarea title iframe".split())
SILENT = frozenset("noscript template select datalist option optgroup object svg math canvas".split())
# Blocks end these where their end tags are missing.
LEFT_BY_BLOCKS = frozenset("svg math select datalist option optgroup".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "optgroup": {"option", "optgroup"}}
_NO_P_INSIDE = frozenset("article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


# Words by which containers tell their role, for the made layouts and for reading roles off real ones.
MAIN_TAGS, OTHER_TAGS = frozenset(("article", "main")), frozenset("nav footer aside header form".split())
MAIN_WORDS = "content article post entry story body text main".split()
OTHER_WORDS = {
    "menu": "nav menu navbar navigation topnav breadcrumb".split(), "header": "header masthead banner top logo".split(),
    "footer": "footer foot bottom copyright legal".split(), "sidebar": "sidebar aside widget related recommended rail".split(),
    "notice": "cookie consent notice gdpr alert modal popup".split(), "ad": "ad ads advert sponsor promo sponsored".split(),
    "form": "form newsletter signup subscribe login search".split(), "comments": "comments comment replies discussion respond disqus".split()}
_OTHER_MARKS = frozenset(w for words in OTHER_WORDS.values() for w in words)


@lru_cache(1 << 16)
def _own_vector(name: str, marks: tuple[str, ...]) -> np.ndarray:
    """The hashed vector of an element's tag and its class and id words; many words share the weight of six."""
    v = np.zeros(PATH_SIZE, np.float32)
    weight = min(1.0, (6 / len(marks)) ** 0.5) if marks else 0.0
    for step, share in ((name, 1.0), *(("." + w, weight) for w in marks)):
        h = zlib.crc32(step.encode("utf-8", "replace"))
        v[h % PATH_SIZE] += (1 if h >> 16 & 1 else -1) * share
    return v


class Place:
    """An open element, described by all its ancestors: each adds itself to what its parent knows, so paths are never cut.

    The element and its parent count fully, older ancestors by half.  ``role`` is what the innermost element says
    that names one (1 main text, 0 other, None unknown); ``silent`` content is not shown.
    """

    __slots__ = ("name", "own", "vector", "total", "role", "silent")

    def __init__(self, parent: Place | None, name: str, marks: tuple[str, ...] = ()):
        self.name, self.own = name, _own_vector(name, marks) if name else np.zeros(PATH_SIZE, np.float32)
        self.vector = self.own if parent is None else self.own + parent.own + 0.5 * (parent.total - parent.own)
        self.total = self.own if parent is None else parent.total + self.own
        self.role = None if parent is None else parent.role
        if name in MAIN_TAGS:
            self.role = 1
        if name in OTHER_TAGS or not _OTHER_MARKS.isdisjoint(marks):
            self.role = 0
        self.silent = name in SILENT or parent is not None and parent.silent


@dataclass
class Block:
    place: Place
    text: str
    linked: int


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order: character references decoded, white space made one space."""
    out: list[Block] = []
    open_: list[Place] = [Place(None, "")]
    pieces: list[str] = []
    linked = anchors = 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.append(Block(open_[-1], text, linked))
        linked = 0

    while at < end:
        m = _TAG.match(page, at)
        at = m.end()
        name = m.group(2)
        if not name:
            piece = m.group()
            if (piece[0] != "<" or piece == "<") and not open_[-1].silent:
                pieces.append(piece)
                if anchors:
                    linked += len(piece)
            continue
        name = name.lower()
        closing = m.group(1)
        if name in INLINE:
            if name == "a":
                anchors = max(0, anchors - 1) if closing else anchors + 1
            elif name == "br" and not open_[-1].silent:
                pieces.append(" ")
            continue
        flush()
        anchors = 0
        if closing:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].name == name:
                    del open_[k:]
                    break
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in VOID or m.group(3).endswith("/"):
            continue
        if name in _NO_P_INSIDE:
            while open_[-1].silent and any(o.name in LEFT_BY_BLOCKS for o in open_):
                open_.pop()
        while len(open_) > 1 and (open_[-1].name in CLOSES.get(name, ()) or open_[-1].name == "p" and name in _NO_P_INSIDE):
            open_.pop()
        marks = tuple(w for v in _NAMES.findall(m.group(3)) for w in _WORD.findall("".join(v).lower())) if m.group(3) else ()
        open_.append(Place(open_[-1], name, marks))
    flush()
    return out


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = n = zlib.crc32(word.lower().encode("utf-8", "replace")) % WORD_SIZE
        return n


_BUCKETS = _Buckets()
SIZE = PATH_SIZE + WORD_SIZE + 5


def vectors(page: list[Block]) -> np.ndarray:
    x = np.zeros((len(page), SIZE), np.float32)
    for i, b in enumerate(page):
        words = b.text.split()
        x[i, :PATH_SIZE] = b.place.vector
        x[i, PATH_SIZE:PATH_SIZE + WORD_SIZE] = np.bincount([_BUCKETS[w] for w in words], minlength=WORD_SIZE) / np.sqrt(len(words)) / 4
        n = len(b.text)
        x[i, -5:] = (np.log1p(n) / 5, min(1.0, b.linked / n), np.log1p(len(words)) / 4, n > 0 and b.text[-1] in ".!?…\"”", i / len(page))
    return x


class BlockLabeller:
    """Bidirectional LSTM with one output per step."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, hidden: int = HIDDEN, seed: int = 5):
        if weights is None:
            rng = np.random.default_rng(seed)
            weights = {}
            for d in "fb":
                weights["w" + d] = rng.normal(0, 1 / np.sqrt(SIZE), (SIZE, 4 * hidden)).astype(np.float32)
                weights["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
                weights["c" + d] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
            weights["o"] = rng.normal(0, 0.3, 2 * hidden).astype(np.float32)
            weights["k"] = np.zeros(1, np.float32)
        self.weights = weights

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        u = self.weights["u" + d]
        size = u.shape[0]
        drive = x @ self.weights["w" + d] + self.weights["c" + d]
        h = np.zeros((x.shape[1], size), np.float32)
        c = np.zeros_like(h)
        out, steps = np.zeros((*x.shape[:2], size), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = drive[t] + h @ u
            gates = 1 / (1 + np.exp(-np.clip(z[:, :3 * size], -30, 30)))
            i, f, o = gates[:, :size], gates[:, size:2 * size], gates[:, 2 * size:]
            g = np.tanh(z[:, 3 * size:])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep:
                steps.append((t, h, c, i, f, o, g, tanh, m))
            c = m * new + (1 - m) * c
            h = m * (o * tanh) + (1 - m) * h
            out[t] = h
        return out, steps

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], 2)
        return 1 / (1 + np.exp(-np.clip(both @ self.weights["o"] + self.weights["k"], -30, 30)))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], 2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.weights["o"] + self.weights["k"], -30, 30)))
        error = (p - y) * mask / mask.sum()
        grads = {"o": np.einsum("tb,tbh->h", error, both), "k": error.sum(keepdims=True).reshape(1)}
        back = error[..., None] * self.weights["o"]
        size = back.shape[2] // 2
        for d, part in (("f", back[..., :size]), ("b", back[..., size:])):
            u = self.weights["u" + d]
            dz_all = np.zeros((*x.shape[:2], 4 * size), np.float32)
            du = np.zeros_like(u)
            dh, dc = np.zeros((x.shape[1], size), np.float32), np.zeros((x.shape[1], size), np.float32)
            for t, h, c, i, f, o, g, tanh, m in reversed(runs[d][1]):
                dh = dh + part[t]
                through = dh * m
                inner = dc * m + through * o * (1 - tanh**2)
                dz = np.concatenate([inner * g * i * (1 - i), inner * c * f * (1 - f), through * tanh * o * (1 - o), inner * i * (1 - g**2)], 1)
                dz_all[t] = dz
                du += h.T @ dz
                dh = dh * (1 - m) + dz @ u.T
                dc = dc * (1 - m) + inner * f
            grads["u" + d] = du
            grads["w" + d] = np.einsum("tbs,tbz->sz", x, dz_all, optimize=True)
            grads["c" + d] = dz_all.sum((0, 1))
        return grads

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, batch: int = BATCH, rate: float = 0.01, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        # A batch is drawn from all pages of usual length; longer ones learn among their like, as many as there is room for.
        pages = sorted(pages, key=lambda p: len(p[0]))
        usual = sum(len(x) <= CELLS // batch for x, _ in pages)
        for step in range(1, steps + 1):
            first = int(rng.integers(0, len(pages)))
            if first < usual:
                chosen = [pages[i] for i in (first, *rng.integers(0, usual, batch - 1))]
            else:
                chosen = pages[first:first + max(1, CELLS // len(pages[min(first + batch, len(pages)) - 1][0]))][:batch]
            x, mask = _padded([x for x, _ in chosen])
            y = np.zeros_like(mask)
            for n, (_, labels) in enumerate(chosen):
                y[:len(labels), n] = labels
            for k, g in self.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                self.weights[k] = (self.weights[k] - rate * (0.3 if step > steps * 0.7 else 1) * (mean[k] / (1 - 0.9**step))
                                   / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def main_text(self, pages: list[list[Block]]) -> list[list[Block]]:
        """Of each page the blocks labelled as main text; pages of like length are read together."""
        out: list[list[Block]] = [[] for _ in pages]
        order = sorted((n for n in range(len(pages)) if pages[n]), key=lambda n: len(pages[n]))
        while order:
            longest = len(pages[order[-1]])
            some = order[-max(1, min(256, CELLS // longest)):]
            del order[-len(some):]
            p = self.scores(*_padded([vectors(pages[n]) for n in some]))
            for k, n in enumerate(some):
                out[n] = [b for b, v in zip(pages[n], p[:, k], strict=False) if v >= 0.5]
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask = np.zeros((longest, len(pages), SIZE), np.float32), np.zeros((longest, len(pages)), np.float32)
    for n, p in enumerate(pages):
        x[:len(p), n], mask[:len(p), n] = p, 1
    return x, mask


def roles(page: list[Block]) -> list[int] | None:
    """1 and 0 by the containers that name a role; None if a page names no main part or leaves blocks open."""
    out = [b.place.role for b in page]
    return out if 1 in out and None not in out else None


def made_page(rng: np.random.Generator, long: list[str], short: list[str]) -> tuple[str, list[int]]:
    """A page of a random layout from texts of the sample, and the labels of its blocks."""
    pick = lambda texts: html.escape(texts[rng.integers(len(texts))], quote=False)
    parts: list[tuple[str, list[int]]] = []

    def wrap(role: str, inner: str) -> str:
        tags = {"menu": "nav", "footer": "footer", "sidebar": "aside", "header": "header", "form": "form"}
        words = OTHER_WORDS[role]
        word = words[rng.integers(len(words))]
        if role in tags and rng.random() < 0.5:
            return f"<{tags[role]}>{inner}</{tags[role]}>"
        tag = ("div", "section", "ul" if "<li>" in inner else "div")[rng.integers(3)]
        return f'<{tag} {"class" if rng.random() < 0.7 else "id"}="{word}">{inner}</{tag}>'

    def other(role: str) -> tuple[str, list[int]]:
        n = int(rng.integers(1, 7))
        if role in ("menu", "footer") and rng.random() < 0.8:
            inner = "<ul>" + "".join(f'<li><a href="#">{pick(short)}</a></li>' for _ in range(n)) + "</ul>"
        elif role == "form":
            inner = "".join(f"<p><label>{pick(short)}</label><input></p>" for _ in range(n))
        elif role == "comments":
            inner = "".join(f'<div class="comment"><p>{pick(long)}</p></div>' for _ in range(n))
        elif role == "header":
            n, inner = 1, f"<h1>{pick(short)}</h1>" if rng.random() < 0.3 else f"<div>{pick(short)}</div>"
        else:
            n = 1 if rng.random() < 0.6 else n
            inner = pick(long if rng.random() < 0.5 else short) if n == 1 else "".join(f"<p>{pick(long)}</p>" for _ in range(n))
        return wrap(role, inner), [0] * n

    before = [r for r in ("notice", "header", "menu", "ad", "sidebar", "form") if rng.random() < 0.45]
    after = [r for r in ("ad", "sidebar", "comments", "form", "footer", "notice") if rng.random() < 0.45]
    parts += [other(r) for r in before]
    inner, n = "", 0
    if rng.random() < 0.8:
        inner, n = f"<h{(k := int(rng.integers(1, 3)))}>{pick(short)}</h{k}>", 1
    for _ in range(int(rng.integers(1, 9))):
        body = pick(long) if rng.random() < 0.85 else pick(short)
        if rng.random() < 0.03:  # articles hold odd paragraphs too: one word over and over
            body = " ".join([body.split()[0] if body.split() else "word"] * int(rng.integers(5, 200)))
        kind = rng.random()
        inner += f"<p>{body}</p>" if kind < 0.8 else f"<blockquote>{body}</blockquote>" if kind < 0.85 else f"<ul><li>{body}</li></ul>" if kind < 0.92 else f"<p><b>{body}<br>"
        n += 1
    plain = rng.random()
    tag = "article" if plain < 0.45 else "main" if plain < 0.6 else "div"
    mark = f' class="{MAIN_WORDS[rng.integers(len(MAIN_WORDS))]}"' if tag == "div" or rng.random() < 0.3 else ""
    labels = [1] * n
    if rng.random() < 0.15:  # an advert within
        more, zero = other("ad")
        inner, labels = inner + more, labels + zero
    parts.append((f"<{tag}{mark}>{inner}</{tag}>", labels))
    parts += [other(r) for r in after]
    return "<html><body>" + "".join(p for p, _ in parts) + "</body></html>", [y for _, labels in parts for y in labels]


def fit_labeller(sample: list[str], layouts: int = LAYOUTS, steps: int = STEPS, seed: int = 8) -> BlockLabeller:
    """Train on pages (html) of a bounded sample; with none, on made pages of fixed filler."""
    rng = np.random.default_rng(seed)
    known, long, short = [], [], []
    for page in sample:
        found = blocks(page)
        labels = roles(found)
        if labels:
            known.append((vectors(found), np.array(labels, np.float32)))
        for b in found:
            (long if len(b.text) >= 60 else short).append(b.text)
    long = long or ["A sentence of some length that stands for a paragraph of a page, and ends with a stop."]
    short = short or ["Home", "About us", "Contact"]
    made = []
    for _ in range(layouts):
        page, labels = made_page(rng, long, short)
        found = blocks(page)
        if len(found) == len(labels):
            made.append((vectors(found), np.array(labels, np.float32)))
    pages = made + [known[i] for i in rng.integers(0, len(known), len(made) // 2)] if known else made
    labeller = BlockLabeller()
    labeller.train(pages, steps)
    return labeller


def sample_pages(pages: DataFrame, html_col: str, most: int = SAMPLE_PAGES) -> list[str]:
    """At most ``most`` different pages, chosen by a hash of their content.

    Tasks send the driver their least hashes only; then the pages up to the last of these.
    """
    rows = pages.select(F.col(f"`{html_col}`").cast("string").alias("h")).where("h is not null").withColumn("by", F.xxhash64("h"))
    last = rows.select("by").distinct().orderBy("by").limit(most).agg(F.max("by").alias("m")).first()["m"]
    if last is None:
        return []
    return [r["h"] for r in rows.where(F.col("by") <= last).groupBy("by").agg(F.min("h").alias("h")).orderBy("by").collect()]


def extract(pages: DataFrame, labeller: BlockLabeller | None = None, html_col: str = "html",
            keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per page: the columns of ``keep``, text, n_chars (code points).

    ``text`` is the blocks labelled as main text, in page order, joined by line feeds; null or empty html gives
    an empty text, as does a page without such a block.  Rows are judged one by one, so ids may repeat
    or be null; other columns are dropped.  Pages are read whole, however long or deep; one that is larger than a slice stands alone.
    """
    labeller = labeller or fit_labeller(sample_pages(pages, html_col))
    weights = labeller.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = BlockLabeller(weights)
        for whole in batches:
            for batch in slices(whole, 0, 4 << 20):
                found = model.main_text([blocks(h or "") for h in batch.column(0).to_pylist()])
                texts = pa.array(["\n".join(b.text for b in page) for page in found], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts, pc.utf8_length(texts).cast(pa.int64())],
                                                 [*names, "text", "n_chars"])

    kept = pages.select(F.col(f"`{html_col}`").cast("string").alias("html"), *[F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)])
    names = kept.columns[1:]
    schema = ", ".join(f"{n} {kept.schema[n].dataType.simpleString()}" for n in names) + ", text string, n_chars long"
    out = kept.mapInArrow(run, schema.lstrip(", "))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "text", "n_chars")
