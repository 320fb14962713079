"""Exact dedup by distributed MSD radix partitioning.

Texts are split by successive runs of bytes.  A group is finished when one row is left in it or when its
texts have ended; texts of a group that ended are equal byte by byte, so no digest decides anything.
The byte length is the first digit, so texts of a group end together.  Runs grow by a factor, so a text
of n bytes needs about log(n) rounds; a round shuffles only the bytes of its own run, and only of rows
whose group is not finished.  Groups are counted with partial aggregation and joined back to the rows, a
join Spark may split, so a group that holds a third of all rows loads no single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import ascii_lower, keyed_rows, written

FIRST_RUN, GROWTH = 256, 4


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 normalise=ascii_lower, first_run: int = FIRST_RUN, growth: int = GROWTH) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after ``normalise`` (A-Z lower-cased); a null text counts as empty.
    Of equal texts the row with the largest id stays, a null id being least; of repeated rows with that id
    exactly one has kept = true.  An empty table gives an empty result.  Other columns are not read.
    Texts of any length are compared whole.
    """
    rows = keyed_rows(docs, id_col, text_col).select(F.lit(0).cast("long").alias("key"), "id", normalise(F.col("text")).alias("text"))
    return _partition(rows, first_run, growth).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                normalise=ascii_lower, first_run: int = FIRST_RUN, growth: int = GROWTH) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are; of fully repeated rows one stays."""
    rows = written(docs.withColumn(_KEY, F.monotonically_increasing_id()), "exact-rows")
    text = normalise(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    keyed = rows.select(F.col(_KEY).alias("key"), F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
    stay = _partition(keyed, first_run, growth).where("kept").select(F.col("key").alias(_KEY))
    return rows.join(stay, _KEY, "left_semi").drop(_KEY)


_KEY = "__llm_exact_key"


def _run(text: Column, start: int, length: int = 2**31 - 1) -> Column:
    return F.substring(text.cast("binary"), start, length)


def _partition(rows: DataFrame, first_run: int, growth: int) -> DataFrame:
    """(key, id, text) to (key, id, keep_id, group_size, kept, sha)."""
    base = rows.select("*", F.octet_length("text").cast("long").alias("group"),
                       _run(F.col("text"), 1, first_run).alias("run"))
    # Written, so that both sides of the join are plain exchanges, which Spark can split where a key is hot.
    shared = written(base.groupBy("group", "run").agg(F.count("*").alias("n")).where("n > 1"), "exact-shared")
    start = written(
        base.join(shared, ["group", "run"], "left").select(
            F.monotonically_increasing_id().alias("row"), "key", "id", F.sha2("text", 256).alias("sha"), "group",
            F.when(F.col("n") > 1, F.col("run")).alias("run"),
            F.when(F.col("n") > 1, _run(F.col("text"), first_run + 1)).alias("rest")), "exact-start")
    done = [start.where("run is null").select(
        "key", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "sha")]
    live, width = start.where("run is not null"), first_run
    while not live.isEmpty():
        # A group of the last round and the run of bytes that follows make a group of this round.
        counted = written(live.groupBy("group", "run").agg(
            F.count("*").alias("n"), F.min("row").alias("next"), F.max(F.struct("id", "row")).alias("top")), "exact-counted")
        width *= growth
        more = (F.col("n") > 1) & (F.length("rest") > 0)
        step = written(
            live.join(counted, ["group", "run"]).select(
                "row", "key", "id", "sha", "n", F.col("next").alias("group"), "top",
                F.when(more, F.substring("rest", 1, width)).alias("run"),
                F.when(more, F.substring("rest", width + 1, 2**31 - 1)).alias("rest")),
            "exact-round")
        done.append(step.where("run is null").select(
            "key", "id", F.col("top.id").alias("keep_id"), F.col("n").alias("group_size"),
            (F.col("row") == F.col("top.row")).alias("kept"), "sha"))
        live = step.where("run is not null").select("row", "key", "id", "sha", "group", "run", "rest")
    return reduce(DataFrame.unionByName, done)
