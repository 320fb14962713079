"""Toxicity scores from a learned lexicon, misspellings included.

The lexicon is learned from labelled texts: words, and stems (written ``stem*``) whose endings vary.  Its trie is intersected with Levenshtein automata: a state is
the set of trie nodes reachable with so many edits, transitions are worked out when first asked for, and
words that can no longer reach a term leave at once.  Hits are seen in their context window: inside
quotation marks after a word of reporting they count apart from direct use.  A logistic model
over a few sums per text, also learned from labels, gives the score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import discard, written
from veilframe.llm.jaccard_join import THRESHOLD, TOLERANCE, WORDS, _Forest, _sketches, bucket_forest, needed_matches

SAMPLE_ROWS = 20_000
# A term is in so many positive texts, which are so large a share of all texts with it; near copies count as one text, as
# words of a few near copies of a wrongly labelled text would pass a bare count.  At the least, 8 of 8 texts, the precision
# is above 0.67 with 97.5 % confidence (Wilson), so rare words need no further test.
MIN_SUPPORT, MIN_PRECISION = 8, 0.9
STEM_LETTERS = (4, 8)
MISSPELT_WEIGHT = 0.1
NEAR_WORDS = 12
TOKEN = re.compile(r"[\w@$*]+")
EDGE = "@$*_"
OPENERS, CLOSERS = "\"“„«", "\"”“»"
# Words that report speech, in the four languages of the corpus.
REPORTING = frozenset(
    "said says say wrote writes called calls quote quotes quoted quoting term word words sagte sagt schrieb nannte zitat wort "
    "dit disait écrit appelé citation mot dijo dice escribió llamó cita palabra".split())


def edits_allowed(term: str) -> int:
    """By the letters a term has itself; what follows a stem is free in any case."""
    letters = len(term.removesuffix("*"))
    return 0 if letters < 5 else 1 if letters < 9 else 2


class LexiconAutomaton:
    """The Levenshtein automata of all words, intersected with the trie of the lexicon, determinised lazily."""

    def __init__(self, terms: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most = [0]  # edits allowed to any term below a node
        # A stem ends in a node of its own, where whatever follows belongs to it.  Only its last letter, as it is, leads there:
        # with an edit there any word with the letters before it would do.
        self.open = [False]
        self.stem: list[dict[str, int]] = [{}]
        for term in terms:
            node, allowed = 0, edits_allowed(term)
            self.most[0] = max(self.most[0], allowed)
            for c in term[:-2] if term.endswith("*") else term:
                if c not in self.child[node]:
                    self.child[node][c] = self._node()
                node = self.child[node][c]
                self.most[node] = max(self.most[node], allowed)
            if term.endswith("*"):
                node = self.stem[node].setdefault(term[-2], self._node())
                self.most[node], self.open[node] = allowed, True
            self.term[node] = term
        self.letters = {c for below in [*self.child, *self.stem] for c in below}
        self.sets: list[dict[int, int]] = [self._closed({0: 0})]
        self.numbers = {frozenset(self.sets[0].items()): 0}
        self.moves: list[dict[str, int]] = [{}]
        self.accepted: list[tuple[str, int] | None] = [self._best(self.sets[0])]

    def _node(self) -> int:
        for column, empty in ((self.child, {}), (self.term, None), (self.most, 0), (self.open, False), (self.stem, {})):
            column.append(empty)
        return len(self.child) - 1

    def _closed(self, state: dict[int, int]) -> dict[int, int]:
        """With the nodes that letters missing from the word lead to."""
        todo = list(state.items())
        while todo:
            node, edits = todo.pop()
            if edits > state[node]:
                continue
            for below in self.child[node].values():
                if edits < self.most[below] and edits + 1 < state.get(below, 99):
                    state[below] = edits + 1
                    todo.append((below, edits + 1))
        return state

    def _best(self, state: dict[int, int]) -> tuple[str, int] | None:
        # Of equally near terms a word comes before a stem and a longer stem before a shorter.
        ends = [(e, t.endswith("*") and 99 - len(t), t) for n, e in state.items() if (t := self.term[n]) and e <= edits_allowed(t)]
        return (min(ends)[2], min(ends)[0]) if ends else None

    def _move(self, at: int, letter: str) -> int:
        out: dict[int, int] = {}
        for node, edits in self.sets[at].items():
            if self.open[node]:
                out[node] = min(out.get(node, 99), edits)
                continue
            below = self.stem[node].get(letter)
            if below is not None and edits <= self.most[below]:
                out[below] = min(out.get(below, 99), edits)
            if edits < self.most[node]:  # a letter too many
                out[node] = min(out.get(node, 99), edits + 1)
            for c, below in self.child[node].items():
                cost = edits + (c != letter)
                if cost <= self.most[below]:
                    out[below] = min(out.get(below, 99), cost)
        if not out:
            return -1
        out = self._closed(out)
        key = frozenset(out.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(out)
            self.moves.append({})
            self.accepted.append(self._best(out))
        return self.numbers[key]

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowed edits, and the edits."""
        at, moves, letters = 0, self.moves, self.letters
        for c in word:
            if c not in letters:
                c = "\0"
            after = moves[at].get(c)
            if after is None:
                after = moves[at][c] = self._move(at, c)
            if after < 0:
                return None
            at = after
        return self.accepted[at]


@dataclass(frozen=True)
class ToxicityModel:
    terms: tuple[str, ...]
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]


FEATURES = ("exact", "misspelt", "stems", "misspelt stems", "quoted", "density", "kinds", "closest")


class Featurizer:
    def __init__(self, terms: tuple[str, ...]):
        self.automaton = LexiconAutomaton(list(terms))
        self.seen: dict[str, tuple[str, int] | None] = {}

    def hit(self, word: str) -> tuple[str, int] | None:
        found = self.seen.get(word, 0)
        if found == 0:
            if len(self.seen) > 200_000:
                self.seen.clear()
            found = self.seen[word] = self.automaton.find(word.strip(EDGE))
        return found

    def row(self, text: str | None) -> list[float]:
        """The features of a text; all zero without a hit, as for null and empty texts."""
        low = (text or "").lower()
        words = TOKEN.findall(low)
        hit = self.hit
        terms = {w: h for w in set(words) if (h := hit(w))}
        if not terms:
            return [0.0] * len(FEATURES)
        exact = misspelt = stems = misspelt_stems = quoted = 0
        places, kinds = [], set()
        for number, m in enumerate(TOKEN.finditer(low)):
            h = terms.get(m.group())
            if not h:
                continue
            if self._reported(low, words, number, m.start(), m.end()):
                quoted += 1
                continue
            stem = h[0].endswith("*")
            stems += h[1] == 0 and stem
            exact += h[1] == 0 and not stem
            misspelt += h[1] > 0 and not stem
            misspelt_stems += h[1] > 0 and stem
            kinds.add(h[0])
            places.append(number)
        gap = min((b - a for a, b in zip(places, places[1:], strict=False)), default=10**6)
        hits = exact + misspelt + stems + misspelt_stems
        return [np.log1p(exact), np.log1p(misspelt), np.log1p(stems), np.log1p(misspelt_stems), np.log1p(quoted),
                hits * 50 / (len(words) + 50), np.log1p(len(kinds)), 1 / np.log(2 + gap)]

    @staticmethod
    def _reported(low: str, words: list[str], number: int, start: int, end: int) -> bool:
        """Inside quotation marks that open and close nearby, with a reporting word in the window before."""
        before, after = low[max(0, start - 80):start], low[end:end + 80]
        if not any(c in before for c in OPENERS) or not any(c in after for c in CLOSERS):
            return False
        return not REPORTING.isdisjoint(words[max(0, number - NEAR_WORDS):number])


def held_out(id_: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn lexicon and weights from about ``sample_rows`` labelled rows that are not held out, chosen by a hash
    of the id; equal texts teach once.  Without positive labels the lexicon is empty and every score low."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(
        "id is not null and label is not null").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    share = min(1.0, sample_rows / max(1, known.count()))
    if share < 1:
        known = known.where(F.shiftrightunsigned(F.xxhash64("id"), 1) < int(share * 2**63))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sample = written(texts.join(known, "id").groupBy(F.sha2("text", 256).alias("key")).agg(
        F.first("text").alias("text"), F.max("label").alias("label")).withColumn("number", F.monotonically_increasing_id()), "toxic-sample")
    classes = F.broadcast(near_copies(sample))
    sample_classes = sample.join(classes, "number", "left").select(
        F.coalesce("class_label", "label").alias("label"), F.coalesce("class", "number").alias("class"), F.col("class").isNotNull().alias("copied"), "text")
    every = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    least, most = STEM_LETTERS
    stems = F.array_distinct(F.flatten(F.transform(F.filter(every, lambda w: F.length(w) >= least), lambda w: F.transform(
        F.sequence(F.lit(least), F.least(F.length(w), F.lit(most))), lambda k: F.concat(F.substring(w, 1, k), F.lit("*"))))))
    words = sample_classes.select("class", "label", "copied", F.explode(F.concat(every, stems)).alias("word"))
    words = words.where("not copied").union(words.where("copied").distinct())
    counts = words.groupBy("word").agg(F.sum("label").alias("yes"), F.count("*").alias("all")).where(
        (F.col("yes") >= MIN_SUPPORT) & (F.col("yes") >= MIN_PRECISION * F.col("all")) & (F.length("word") > 2))
    terms = tuple(sorted(r["word"] for r in counts.collect()))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Featurizer(terms)
        for batch in batches:
            made = [(of.row(t), y, 1.0) for t, y in zip(batch["text"], batch["label"], strict=True)]
            made += [(of.row(_misspelt(t, of)), y, MISSPELT_WEIGHT) for t, y in zip(batch["text"], batch["label"], strict=True) if y]
            yield pd.DataFrame({"x": [m[0] for m in made], "y": [float(m[1]) for m in made], "w": [m[2] for m in made]})

    table = sample.mapInPandas(features, "x array<double>, y double, w double").toPandas()
    if table.empty:
        zero = (0.0,) * len(FEATURES)
        return ToxicityModel(terms, (*zero, -3.0), zero, (1.0,) * len(FEATURES))
    x, y = np.array(table["x"].tolist()), table["y"].to_numpy()
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    return ToxicityModel(terms, tuple(_logistic((x - mean) / scale, y, table["w"].to_numpy())), tuple(mean), tuple(scale))


def near_copies(sample: DataFrame) -> DataFrame:
    """(number, class, class_label) of the texts of ``sample`` (number, text, label) that are near copies of others.

    A class has the label of most of its texts.  The driver gets a MinHash sketch of each text; the sample is bounded.
    """
    spark = sample.sparkSession
    sketches = _sketches(sample, "number", "text", WORDS)
    found = sketches.where("key is not null").selectExpr("id", "sketch", "bands").join(
        sample.select(F.col("number").alias("id"), "label"), "id").toPandas()
    discard(spark, sketches.scratch)
    classes, needed = _Forest(len(found)), needed_matches(THRESHOLD, TOLERANCE)
    if len(found):
        sketch = np.frombuffer(b"".join(found["sketch"]), np.uint8).reshape(len(found), -1)
        for band in np.stack(found["bands"].to_numpy()).T:
            order = np.argsort(band, kind="stable")
            for run in np.split(order, np.flatnonzero(np.diff(band[order])) + 1):
                if len(run) > 1 and len({classes.root(x) for x in run.tolist()}) > 1:
                    for a, b in bucket_forest(run, sketch[run], np.ones(len(run), bool), True, needed):
                        classes.join(int(a), int(b))
    found["class"] = found["id"].to_numpy()[[classes.root(x) for x in range(len(found))]] if len(found) else found["id"]
    by = found.groupby("class")["label"]
    found["class_label"] = (by.transform("mean") >= 0.5).astype(int)
    rows = found[by.transform("size") > 1][["id", "class", "class_label"]]
    return spark.createDataFrame([tuple(map(int, r)) for r in rows.to_numpy()], "number long, class long, class_label int")


def _misspelt(text: str, of: Featurizer) -> str:
    """The text with an edit in every word that is a term and allows one, so that misspellings get a weight."""
    def edited(m: re.Match) -> str:
        word = m.group()
        found = of.hit(word)
        if not found or found[1] or not edits_allowed(found[0]):
            return word
        n = zlib.crc32(found[0].encode())
        k = word.index(word.strip(EDGE)) + 1 + n % (len(found[0].removesuffix("*")) - 2)
        return word[:k] + ("" if n % 2 else "*") + word[k + 1:]

    return TOKEN.sub(edited, (text or "").lower())


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, turns: int = 50) -> list[float]:
    """Ridge-penalised logistic regression by Newton steps; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * len(x) / 100 * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "toxicity_score") -> DataFrame:
    """``docs`` with a column ``score_col`` (0 to 1); only the text is looked at, all of it.

    Null and empty texts are scored as texts without a hit.  A frame that has a column of that name is refused.
    """
    if score_col in docs.columns:
        raise ValueError(f"the frame has a column {score_col}; choose another name")

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Featurizer(model.terms)
        weights, mean, scale = np.array(model.weights), np.array(model.mean), np.array(model.scale)
        for texts in batches:
            x = np.array([of.row(t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pd.Series(1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ weights[:-1] + weights[-1], -30, 30))))

    return docs.withColumn(score_col, scores(F.col(f"`{text_col}`").cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: ``id_col``, held_out, score, predicted.

    A null id counts as the text ''.  Repeated rows are scored alike.  Empty tables give an empty result.  Other columns
    stay out, whatever their names.
    """
    model = fit(docs, labels, id_col, text_col, label_col, sample_rows)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    scored = score(slim, model).select("id", F.col("toxicity_score").alias("score"))
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that score below one half, with their columns as they are."""
    model = fit(docs, labels, id_col, text_col, label_col, sample_rows)
    # A name that no column of the frame has.
    own = max((c for c in docs.columns), key=len, default="") + "_toxicity"
    return score(docs, model, text_col, own).where(F.col(f"`{own}`") < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
