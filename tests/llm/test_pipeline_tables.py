"""The pipeline on odd tables, and runs that do not disturb each other."""

import threading

from veilframe.llm.common import SCRATCH, discard, written

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def through(spark, docs):
    kept = []
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        kept.append((name, docs))
    return kept


def test_nulls_empties_repeats_and_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "one two three", "y"), (3, "one two three", "y"), (3, "one two three", "y"), (4, "word " * 40_000, "z"), (5, "ONE two three", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr(
        "*", "'s' as source", "cast(1 as bigint) as n_chars", "0.5D as toxicity_score", "1 as row", "'k' as key")
    kept = through(spark, docs)
    for _, frame in kept[:-1]:
        assert frame.columns == docs.columns
    assert kept[0][1].count() == len(rows)
    last = {(r["doc_id"], r["text"]) for r in kept[3][1].collect()}
    assert len([1 for _, t in last if not t]) == 1 and len([1 for _, t in last if t and t.lower() == "one two three"]) == 1
    assert any(i == 4 and len(t) == 200_000 for i, t in last)
    packed = kept[4][1]
    assert {r["doc_id"] for r in packed.collect()} == {i for i, _ in last}


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    assert [frame.count() for _, frame in through(spark, docs)] == [0] * 5


def test_runs_of_two_threads_keep_their_tables(spark):
    mine = written(spark.range(5), "mine")
    seen = {}

    def other():
        seen["before"] = list(SCRATCH)
        table = written(spark.range(3), "other")
        discard(spark, *SCRATCH)
        seen["after"] = list(SCRATCH)
        seen["path"] = table.scratch

    thread = threading.Thread(target=other)
    thread.start()
    thread.join()
    assert seen["before"] == seen["after"] == [] and mine.scratch in SCRATCH and mine.count() == 5
    discard(spark, mine.scratch)
    assert mine.scratch not in SCRATCH
