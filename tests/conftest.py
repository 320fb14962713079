import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from veilframe.session import local_session

    session = local_session(4, shuffle_partitions=4)
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def docs(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    return frame.repartition(8, "doc_id")


def texts(spark, *values, schema="id int, text string"):
    return spark.createDataFrame(list(enumerate(values)), schema)


def found(frame):
    """Per id: the list of (entity_type, text)."""
    return {r["id"]: [(s["entity_type"], s["text"]) for s in r["spans"]] for r in frame.collect()}
