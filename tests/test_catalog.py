"""Every query beside its SQL, and checks that the comparisons are not empty."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry
import compare
from catalog import detection, governance, jobs
from pyspark.sql import functions as F
from veilframe import RecognizerRegistry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


def test_every_core_query_has_sql():
    core = {**detection.ENTRIES, **governance.ENTRIES, **jobs.ENTRIES}
    assert set(core) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    ok, _, message, _, _ = compare.compare(spark, con, name, SF_DIR)
    assert ok, message


TYPES = {t.lower() for t in RecognizerRegistry().supported_entities(None)}


@pytest.mark.parametrize("name", [n for n in entry.queries() if re.match(r"c[0-9]+_", n) and n.partition("_")[2] in TYPES])
def test_each_type_is_found_and_not_found(spark, name):
    rows = entry.queries()[name](spark, SF_DIR)
    hit, miss = rows.agg(F.expr("count_if(n > 0)"), F.expr("count_if(n = 0)")).first()
    assert hit > 0
    if name not in ("c11_person", "c16_date_time", "c10_phone_number"):  # texts that always hold one
        assert miss > 0


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["doc_id", "classification", "entities_found", "protected_text"]
    assert out.count() > 0
