"""Runs that break off and are repeated: every record once, nothing half done to be seen."""

import pytest
from pyspark.sql import functions as F

from veilframe import scan_and_protect
from veilframe.plans import audit as au
from veilframe.plans import jobs
from veilframe.sources import sinks
from veilframe.sources.commits import CommitLog, read_committed, write_once


@pytest.fixture
def records(spark):
    frame = spark.range(20).select(F.col("id"), F.concat(F.lit("mail u"), "id", F.lit("@x.org")).alias("text"))
    return au.audit_rows(scan_and_protect(frame, "text", ["id"], batch_ts="2026-01-01 00:00:00", with_audit=True))


class Killed(BaseException):
    pass


class Kill:
    """A sink at which the job dies."""

    def write(self, audit):
        raise Killed


def counts(frame):
    rows = frame.groupBy("audit_id").count().collect()
    return len(rows), {r["count"] for r in rows}


def test_job_killed_between_two_sinks(spark, records, tmp_path):
    one, two = sinks.JsonLinesSink(str(tmp_path / "a")), sinks.OutboxSink("https://h.example.com", str(tmp_path / "b"))
    with pytest.raises(Killed):
        sinks.fan_out(records, [one, Kill(), two], run_id="2026-01-01 / daily")
    assert counts(one.query(records)) == (20, {1}) and two.query(records).isEmpty()
    assert sinks.fan_out(records, [one, two], run_id="2026-01-01 / daily") == []
    assert counts(one.query(records)) == counts(two.query(records)) == (20, {1})
    assert sinks.fan_out(records, [one, two], run_id="2026-01-02 / daily") == []
    assert counts(one.query(records)) == (20, {2})


def test_a_finished_run_computes_nothing(spark, records, tmp_path):
    sink = sinks.JsonLinesSink(str(tmp_path / "a"))
    sinks.fan_out(records, [sink], run_id="r")
    broken = records.withColumn("action", F.raise_error(F.lit("computed again")).cast("string"))
    assert sinks.fan_out(broken, [sink], run_id="r") == []


@pytest.mark.parametrize("step", ["write", "commit"])
def test_broken_attempts_are_not_seen(spark, records, tmp_path, monkeypatch, step):
    path = str(tmp_path / "audit")
    if step == "commit":
        monkeypatch.setattr(CommitLog, "commit", lambda *a: (_ for _ in ()).throw(Killed()))
        with pytest.raises(Killed):
            au.write_audit(records, path, "run")
    else:
        def half(rows, folder):
            rows.limit(3).write.parquet(folder)
            raise Killed

        with pytest.raises(Killed):
            write_once(records, path, "run", half)
    assert au.read_audit(spark, path).isEmpty()
    monkeypatch.undo()
    assert au.write_audit(records, path, "run") and not au.write_audit(records, path, "run")
    assert counts(au.read_audit(spark, path)) == (20, {1})
    assert CommitLog(spark, path).clean() == 1 and counts(au.read_audit(spark, path)) == (20, {1})
    assert CommitLog(spark, path).clean() == 0


def test_two_writers_of_one_run(spark, records, tmp_path):
    path = str(tmp_path / "t")

    def slow(rows, folder):
        rows.write.parquet(folder)
        if not CommitLog(spark, path).committed("run"):  # another writer is faster
            assert write_once(records, path, "run", lambda r, f: r.write.parquet(f))

    assert not write_once(records, path, "run", slow)
    assert counts(read_committed(spark, path, records.schema)) == (20, {1})
    assert len(CommitLog(spark, path).entries()) == 1 and CommitLog(spark, path).clean() == 0


def test_appended_rows_and_runs_side_by_side(spark, records, tmp_path):
    path = str(tmp_path / "t")
    au.write_audit(records.limit(5), path)
    au.write_audit(records, path, "run/with:odd 'name'")
    stored = au.read_audit(spark, path)
    assert stored.count() == 25 and set(records.columns) < set(stored.columns)
    assert spark.read.parquet(path).count() == 5  # a reader that knows no runs sees no attempt
    plan = au.filter_audit(stored, since="2026-01-01", action_type="analyze")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(") == 2
    assert CommitLog(spark, path).entries()[0]["run_id"] == "run/with:odd 'name'"


def test_routes_and_empty_tables(spark, tmp_path):
    frame = spark.createDataFrame([(1, "plain"), (2, "SSN 219-09-9999")], "id int, text string")
    routed = jobs.tiered_route(frame, "text", ["id"], batch_ts="2026-01-01")
    path = str(tmp_path / "routes")
    assert jobs.write_routed(routed, path, "r") and not jobs.write_routed(routed, path, "r")
    assert {(r["id"], r["route"]) for r in read_committed(spark, path, routed.schema).collect()} == {(1, "PASSED"), (2, "BLOCKED")}
    assert read_committed(spark, str(tmp_path / "none"), routed.schema).collect() == []
    assert jobs.write_routed(routed.where("false"), str(tmp_path / "empty"), "r")
    assert read_committed(spark, str(tmp_path / "empty"), routed.schema).collect() == []
