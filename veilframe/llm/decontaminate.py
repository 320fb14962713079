"""Benchmark decontamination by a positional inverted index, on built-in Spark functions alone.

A window is a run of consecutive words of a test item.  The corpus is split into words once and written
with row numbers.  Counting the test words in it gives each window its rarest terms.  A window with a
word the corpus lacks cannot occur.  For the rest, postings (term, row, position) of the rarest terms are
stored; lists are shifted by the term's place in the window and intersected from the rarest term on, so
common words never make lists of candidates.  What is left is compared word by word with the words
that the rarest term's posting carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import ascii_lower, bounded_broadcast, keyed_rows, written

WINDOW, LISTS = 10, 3
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, then runs of 0-9, a-z and everything beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def test_windows(benchmark: DataFrame, size: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, words, items): the distinct windows of all items with the ids (as strings) that have them.

    An item of fewer words than ``size``, but not none, is one window; null and empty items have none.
    """
    w = F.col("words")
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), words_of(F.col(f"`{text_col}`").cast("string")).alias("words"))
    each = items.where("size(words) > 0").select(
        "item", F.explode(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))).alias("at"), "words"
    ).select("item", F.slice(w, F.col("at"), F.lit(size)).alias("words"))
    grouped = each.groupBy("words").agg(F.collect_set("item").alias("items"))
    return written(grouped.withColumn("window", F.monotonically_increasing_id()), "test-windows")


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, words) of every document, written once."""
    return written(keyed_rows(docs, id_col, text_col).select("row", "id", words_of(F.col("text")).alias("words")), "corpus-words")


def _ranked(corpus: DataFrame, windows: DataFrame) -> DataFrame:
    """The windows whose words all occur in the corpus, with their (term, place) from the rarest on."""
    terms = windows.select("window", F.posexplode("words").alias("place", "term"))
    vocabulary = written(terms.select("term").distinct(), "test-terms")
    counts = (
        corpus.select(F.explode("words").alias("term")).join(bounded_broadcast(vocabulary), "term")
        .groupBy("term").agg(F.count("*").alias("n")))
    ranks = terms.join(counts, "term", "left").groupBy("window").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "term"))).alias("terms"))
    return written(windows.join(ranks.where("terms[0].n > 0"), "window"), "test-ranked")


def phrase_matches(corpus: DataFrame, windows: DataFrame, lists: int = LISTS) -> DataFrame:
    """(row, start, window, items, length) for every place where a window occurs; ``start`` counts from 0."""
    ranked = _ranked(corpus, windows).withColumn("width", F.size("words"))
    longest = ranked.select(F.max("width")).first()[0] or 0
    wanted = ranked.select(F.explode(F.slice("terms", 1, lists)).alias("t")).select("t.term").distinct()
    rarest = written(
        wanted.join(ranked.select(F.col("terms")[0]["term"].alias("term")).distinct().withColumn("first", F.lit(True)), "term", "left"),
        "test-rarest")
    words = F.col("words")
    stored = written(
        corpus.select("row", "words", F.posexplode("words").alias("at", "term")).join(bounded_broadcast(rarest), "term")
        .select("term", "row", "at", F.greatest(F.col("at") - longest + 1, F.lit(0)).alias("from"), F.when(
            F.col("first"), F.slice(words, F.greatest(F.col("at") - longest + 2, F.lit(1)), F.lit(2 * longest))
        ).alias("near")), "postings")
    found = stored.where("near is not null").join(
        bounded_broadcast(written(ranked.select(F.col("terms")[0]["term"].alias("term"), F.col("terms")[0]["place"].alias("place"),
                                               "window", F.col("words").alias("asked"), "width", "terms"), "test-lookup")), "term"
    ).select("row", (F.col("at") - F.col("place")).alias("start"), "window", "asked", "width", "terms", "from", "near").where("start >= 0")
    for k in range(1, lists):
        other = stored.select(F.col("term").alias("next"), F.col("row"), F.col("at").alias("next_at"))
        term = F.col("terms")[k]
        found = found.withColumn("next", F.get("terms", F.lit(k))["term"]).withColumn(
            "next_at", F.col("start") + F.get("terms", F.lit(k))["place"])
        alone, rest = found.where("next is null"), found.where("next is not null")
        found = rest.join(other, ["row", "next", "next_at"], "left_semi").unionByName(alone).drop("next", "next_at")
    same = F.slice("near", F.col("start") - F.col("from") + 1, F.col("width")) == F.col("asked")
    found = found.where(same).select("row", "start", "window", F.col("width").alias("length"))
    return found.join(windows.select("window", "items"), "window")


def proximity_matches(corpus: DataFrame, windows: DataFrame, slack: int = 5, lists: int = LISTS) -> DataFrame:
    """(row, window, start, end): stretches of at most window length + ``slack`` words that hold every word of
    the window (as often as it does), in any order, around an occurrence of its rarest term.

    The postings of the rarest term carry the words around them, which decide.
    """
    ranked = _ranked(corpus, windows).withColumn("width", F.size("words"))
    longest = (ranked.select(F.max("width")).first()[0] or 0) + slack
    lookup = bounded_broadcast(written(ranked.select(
        F.col("terms")[0]["term"].alias("term"), "window", F.array_sort("words").alias("asked"), "width"), "test-lookup"))
    near = corpus.select("row", "words", F.posexplode("words").alias("at", "term")).join(lookup, "term")
    first = F.greatest(F.col("at") - F.col("width") - slack + 1, F.lit(0))
    each = near.select("row", "window", "asked", "width", "words", "at", F.explode(F.sequence(first, F.col("at"))).alias("start"))
    stretch = F.slice("words", F.col("start") + 1, F.col("width") + slack)
    left = F.aggregate(F.col("asked"), stretch, lambda have, word: F.when(
        F.array_position(have, word) > 0,
        F.concat(F.slice(have, F.lit(1), (F.array_position(have, word) - 1).cast("int")),
                 F.slice(have, (F.array_position(have, word) + 1).cast("int"), F.size(have)))))
    return each.where(left.isNotNull()).select(
        "row", "window", "start", F.least(F.col("start") + F.col("width") + slack, F.size("words")).alias("end")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  lists: int = LISTS) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window is hit, once however many windows cover it.  Null and empty
    texts have no words and no hits; repeated rows and null ids are judged row by row; an empty
    benchmark hits nothing; a null item id never shows in the list.  Other columns are not read.  Texts are read whole, however long;
    equal items each count by their id.
    """
    corpus = corpus_words(docs, id_col, text_col)
    windows = test_windows(benchmark, window, item_col, item_text_col)
    found = written(phrase_matches(corpus, windows, lists), "phrases")
    hit = (
        found.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at"))
        .distinct().groupBy("row").agg(F.count("*").alias("n_hit")))
    items = (
        found.select("row", F.explode("items").alias("item")).distinct()
        .groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items")))
    # Rows without a match need no join.
    hits = hit.join(items, "row", "left")
    none = F.coalesce("items", F.array().cast("array<string>"))
    return corpus.select("row", "id", F.size("words").cast("long").alias("n_words")).join(hits, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(none).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", none), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      window: int = WINDOW, lists: int = LISTS) -> DataFrame:
    """The rows of ``docs`` without a hit, with their columns as they are."""
    key = "__llm_leak_key"
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "leak-rows")
    judged = contamination(rows, benchmark, key, text_col, window=window, lists=lists)
    return rows.join(judged.where("contaminated").select(key), key, "left_anti").drop(key)
