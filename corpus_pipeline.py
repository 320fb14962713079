"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

Null and empty texts pass every filter as empty texts (of several, exact dedup keeps one) and become sequences'
closing marks; null ids and repeated rows are rows like others; an empty table gives an empty result.  Columns of
documents pass through the filters as they are, whatever their names.  Texts of any length are worked on whole.
"""

from __future__ import annotations

import threading
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import decontaminate, exact_dedup, jaccard_join, packing, toxicity
from veilframe.llm.common import SCRATCH, discard, written
from veilframe.llm.queries import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Run(threading.local):
    """What the last stage of this thread's run left behind; runs in other threads keep theirs."""

    def __init__(self) -> None:
        self.left: list[str] = []


_run = _Run()


def _stage(work):
    """A stage gets documents that have been written, so what the one before left behind is read no more."""
    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, *_run.left)
        known = set(SCRATCH)
        out = work(spark, docs, sf_dir)
        _run.left = [path for path in SCRATCH if path not in known]
        return out

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score one half or more go."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingle similarity of 0.8 or more the row with the least doc_id stays."""
    return jaccard_join.drop_near_copies(docs)


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of all documents left, packed into sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: SQL cannot say what the learned scores and the packing are; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
