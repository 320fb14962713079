"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice in full (all rows and all output columns, to a no-op sink); the second, warm
run counts.  The files hold one row group each, so texts are spread over the cores by key, and that
shuffle is part of the measured time.
"""

from __future__ import annotations

import json
import os
import time
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from catalog.governance import ALERTING, event_audit
from catalog.tables import cases
from veilframe import RecognizerRegistry, read_texts
from veilframe.plans import protect
from veilframe.plans import audit, jobs
from veilframe.plans.span_tables import detect_long, term_spans
from veilframe.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
BATCH_TS = "2026-01-01 00:00:00"

# Every text is processed in full, however long.
analyze, anonymize, classify, scan_and_protect = (
    partial(call, max_chars=0)
    for call in (protect.analyze, protect.anonymize, protect.classify, protect.scan_and_protect)
)


def _docs(spark: SparkSession, keep=()) -> DataFrame:
    return read_texts(
        spark, f"{SF_DIR}/documents.parquet", id_cols=["doc_id"], keep=keep, spread=4 * CPUS
    )


def queries(spark: SparkSession) -> dict:
    token = RecognizerRegistry().with_pattern(
        "token", "SECRET_TOKEN", ['token = "[0-9a-f]{40}"'], line_bounded=True
    )
    customers = spark.read.parquet(f"{SF_DIR}/customer.parquet").selectExpr(
        "c_name as term", "'PERSON' as entity_type")
    bills = spark.read.parquet(f"{SF_DIR}/orders.parquet").repartition(4 * CPUS, "o_orderkey").selectExpr(
        "o_orderkey as id", "'Bill of Customer#' || lpad(cast(o_custkey * 2 as string), 9, '0') as text")
    return {
        "i1_analyze": lambda: analyze(_docs(spark), "text", ["doc_id"], batch_ts=BATCH_TS),
        "i2_anonymize": lambda: anonymize(_docs(spark), "text", ["doc_id"], batch_ts=BATCH_TS),
        "i3_classify": lambda: classify(_docs(spark), "text", ["doc_id"], batch_ts=BATCH_TS),
        "i4_scan_and_protect": lambda: scan_and_protect(
            _docs(spark), "text", ["doc_id"], policy=ALERTING, batch_ts=BATCH_TS, with_audit=True),
        "b2_seven_types": lambda: analyze(
            _docs(spark), "text", ["doc_id"], batch_ts=BATCH_TS,
            entities=["US_SSN", "CREDIT_CARD", "EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS", "URL",
                      "DATE_TIME"]),
        "b11_custom_pattern": lambda: analyze(
            _docs(spark), "text", ["doc_id"], batch_ts=BATCH_TS, registry=token),
        "k3_long_texts": lambda: detect_long(_docs(spark), "text", ["doc_id"]),
        "c11_term_table": lambda: term_spans(bills, "text", ["id"], customers, max_words=1),
        "g8_dense_short_texts": lambda: anonymize(
            cases(spark, SF_DIR, "MIXED").repartition(4 * CPUS, "id"), "text", ["id"],
            batch_ts=BATCH_TS),
        "l1_tiered_routing": lambda: jobs.tiered_route(_docs(spark), "text", ["doc_id"], max_chars=0),
        "l4_dashboard": lambda: jobs.dashboard(_docs(spark, ["source"]), "text", "source", max_chars=0),
        "l7_column_profile": lambda: jobs.column_profile(
            spark.read.parquet(f"{SF_DIR}/pages.parquet").repartition(4 * CPUS, "page_id"), max_chars=0),
        "j4_newest_audit": lambda: audit.query_audit(event_audit(spark, SF_DIR), 50, action_type="classify"),
        "l3_evidence": lambda: jobs.compliance_evidence(event_audit(spark, SF_DIR)),
    }


def seconds(make) -> float:
    start = time.time()
    make().write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=2 * CPUS)
    took = {}
    for name, make in queries(spark).items():
        seconds(make)
        took[name] = round(seconds(make), 3)
    print(json.dumps({
        "metric": "total warm time of the headline queries", "value": round(sum(took.values()), 3),
        "unit": "sec", "queries": took, "sf": Path(SF_DIR).name.removeprefix("sf"), "cpus": CPUS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
