"""What the corpus operators share: written tables, text normalisation, bounded broadcasts, components."""

from __future__ import annotations

import threading
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.session import remove_folder, shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side is broadcast only if its measured size stays below this; else the join shuffles.
BROADCAST_BYTES = 8 << 20


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read back: lineage ends here, and every later reader
    sees the same rows in the same files even after executors were lost."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    SCRATCH.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


class _Scratch(threading.local):
    """Folders in the order in which they were made; every thread of the driver, and so every run, has its own."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __iter__(self) -> Iterator[str]:
        return iter(tuple(self.paths))

    def __contains__(self, path: str) -> bool:
        return path in self.paths

    def append(self, path: str) -> None:
        self.paths.append(path)

    def remove(self, path: str) -> None:
        self.paths.remove(path)


#: The folders that :func:`written` made in this thread and nobody has removed, oldest first.
SCRATCH = _Scratch()


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove written tables that no later plan reads any more."""
    for path in paths:
        if path in SCRATCH:
            SCRATCH.remove(path)
            remove_folder(spark, path)


def keyed_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text) under names of our own: ids need not be unique or non-null, other columns stay out.

    Row numbers only hold if the frame is written before it is used twice.
    """
    return df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def bounded_broadcast(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast if its measured size allows it; else leave the join to a shuffle.

    Measured on the values themselves (JSON length), not on an estimate.
    """
    size = table.select(F.sum(F.length(F.to_json(F.struct("*")))).alias("n")).first()["n"] or 0
    return F.broadcast(table) if size <= limit else table


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, component) for the nodes of undirected ``edges`` (a, b); component is the least node in it.

    Contraction in rounds: every node moves to the neighbour (or itself) that comes first in a hashed
    order, edges are renamed and loops go.  Each round writes its (small) tables; nothing comes to the
    driver but row counts.  Hashed order keeps the number of rounds near log(n) even on long chains.
    """
    spark = edges.sparkSession
    edges = written(edges.select("a", "b").where("a <> b").distinct(), f"{purpose}-edges")
    names = written(
        edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        .withColumn("at", F.col("node")), f"{purpose}-names")
    turn = -1
    while not edges.isEmpty():  # every round joins two nodes at least
        turn += 1
        both = edges.union(edges.select("b", "a"))
        first = F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b")))
        moves = written(
            both.groupBy("a").agg(first.alias("m")).select(
                "a", F.when(F.col("m.h") < F.xxhash64("a", F.lit(turn)), F.col("m.b"))
                .otherwise(F.col("a")).alias("to")),
            f"{purpose}-moves")
        old = [names.scratch, edges.scratch]
        names = written(
            names.join(moves, names["at"] == moves["a"], "left")
            .select("node", F.coalesce("to", "at").alias("at")), f"{purpose}-names")
        left, right = moves.select(F.col("a"), F.col("to").alias("x")), moves.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = written(
            edges.join(left, "a").join(right, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            f"{purpose}-edges")
        discard(spark, *old, moves.scratch)
    least = written(names.groupBy("at").agg(F.min("node").alias("component")), f"{purpose}-least")
    return written(names.join(least, "at").select("node", "component"), purpose)
