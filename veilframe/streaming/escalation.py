"""Escalation on a stream: a source with several RESTRICTED records within a span of event time.

Records of a source are put in order of event time before they are judged: they wait until the source's newest time is
``delay`` past theirs.  A record that comes later than that is not judged but given out as late, so nothing vanishes.
A source that falls silent is judged to the end by a timer, and after ``ttl`` its state goes.

A record escalates if, counting itself and its peers of the same time, at least ``least`` RESTRICTED records of its source lie
in the ``span`` up to its time.  On a table the same is a window query, :func:`escalations_in_table`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

OUTPUT = "source string, kind string, ts timestamp, record_id string, restricted int"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ESCALATION, LATE = "escalation", "late"
_NEVER = -(1 << 62)


def _micros(span: str) -> int:
    return int(pd.Timedelta(span) / pd.Timedelta(microseconds=1))


class Escalation(StatefulProcessor):
    """The state of one source: records that wait, RESTRICTED times still in reach, and how far it has been judged."""

    def __init__(self, least: int, span: str, delay: str, idle: str, ttl: str | None) -> None:
        if least < 1:
            raise ValueError("the number of records is one at least")
        self.least, self.span, self.delay = least, _micros(span), _micros(delay)
        self.idle_ms = _micros(idle) // 1000
        self.ttl_ms = _micros(ttl) // 1000 if ttl else None

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, id string", self.ttl_ms)
        self.reach = handle.getListState("reach", "at bigint", self.ttl_ms)
        self.line = handle.getValueState("line", "newest bigint, judged bigint, timer bigint", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest, judged, timer = self.line.get() if self.line.exists() else (_NEVER, _NEVER, 0)
        waiting, late = [tuple(r) for r in self.waiting.get()], []
        for frame in rows:
            for at, id_, restricted in zip(frame["at"].tolist(), frame["record_id"].tolist(), frame["restricted"].tolist(), strict=True):
                if at <= judged:
                    late.append((at, id_))
                elif restricted:
                    waiting.append((at, id_))
                newest = max(newest, at)
        out = [(LATE, at, id_, None) for at, id_ in late]
        found, waiting = self._judge(waiting, newest - self.delay)
        judged = max(judged, newest - self.delay)
        timer = self._restart(timerValues, timer) if waiting else timer
        self._keep(waiting, newest, judged, timer)
        yield self._frame(key, out + found)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.line.exists():
            return
        newest, _, timer = self.line.get()
        if expiredTimerInfo.getExpiryTimeInMs() < timer:  # the source has spoken since
            return
        found, _ = self._judge([tuple(r) for r in self.waiting.get()], newest)
        self._keep([], newest, newest, timer)
        yield self._frame(key, found)

    def _restart(self, timers: Any, timer: int) -> int:
        """Silence is counted anew: only the last timer set does something."""
        expiry = max(timer + 1, timers.getCurrentProcessingTimeInMs() + self.idle_ms)
        self.handle.registerTimer(expiry)
        return expiry

    def _judge(self, waiting: list[tuple[int, str]], until: int) -> tuple[list[tuple], list[tuple[int, str]]]:
        """Escalations among the waiting records up to a time, and the records that wait on."""
        ready = sorted((w for w in waiting if w[0] <= until), key=lambda w: (w[0], w[1] or ""))
        reach, out, k = [r[0] for r in self.reach.get()], [], 0
        while k < len(ready):
            at, peers = ready[k][0], []
            while k < len(ready) and ready[k][0] == at:
                peers.append(ready[k][1])
                k += 1
            reach = [r for r in reach if r >= at - self.span] + [at] * len(peers)
            if len(reach) >= self.least:
                out += [(ESCALATION, at, id_, len(reach)) for id_ in peers]
        self._put(self.reach, [(r,) for r in reach if r >= until - self.span])
        return out, [w for w in waiting if w[0] > until]

    def _keep(self, waiting: list[tuple[int, str]], newest: int, judged: int, timer: int) -> None:
        self._put(self.waiting, waiting)
        self.line.update((newest, judged, timer))

    @staticmethod
    def _put(state: Any, values: list[tuple]) -> None:
        if values:
            state.put(values)
        else:
            state.clear()

    def _frame(self, key: Any, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({
            "source": pd.Series([key[0]] * len(rows), dtype=object), "kind": pd.Series([r[0] for r in rows], dtype=object),
            "ts": pd.to_datetime(pd.Series([r[1] for r in rows], dtype="int64"), unit="us"),
            "record_id": pd.Series([r[2] for r in rows], dtype=object), "restricted": pd.Series([r[3] for r in rows], dtype="Int32")})

    def close(self) -> None:
        pass


def _records(audit: DataFrame, source_col: str, ts_col: str, id_col: str) -> DataFrame:
    """Records with a time; NULL sources are one source."""
    return audit.where(F.col(ts_col).isNotNull()).select(
        F.col(source_col).cast("string").alias("source"), F.unix_micros(F.col(ts_col).cast("timestamp")).alias("at"),
        F.col(id_col).cast("string").alias("record_id"), F.coalesce(F.col("classification") == "RESTRICTED", F.lit(False)).alias("restricted"))


def escalations(
    audit: DataFrame, source_col: str, *, ts_col: str = "ts", id_col: str = "audit_id", least: int = 3, span: str = "10 minutes",
    delay: str = "5 minutes", idle: str = "10 minutes", ttl: str | None = None,
) -> DataFrame:
    """Escalations and late records of a stream of audit records: source, kind, ts, record_id, restricted.

    The session's state store must be RocksDB (``spark.sql.streaming.stateStore.providerClass``).  ``ttl`` must be longer than ``span``
    and ``delay`` together; it is counted in processing time.
    """
    spark = audit.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    processor = Escalation(least, span, delay, idle, ttl)
    return _records(audit, source_col, ts_col, id_col).groupBy("source").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime")


def escalations_in_table(
    audit: DataFrame, source_col: str, *, ts_col: str = "ts", id_col: str = "audit_id", least: int = 3, span: str = "10 minutes",
) -> DataFrame:
    """The same on a table, where no record is late."""
    rows = _records(audit, source_col, ts_col, id_col).where("restricted")
    reach = Window.partitionBy("source").orderBy("at").rangeBetween(-_micros(span), Window.currentRow)
    counted = rows.withColumn("n", F.count(F.lit(1)).over(reach).cast("int")).where(F.col("n") >= least)
    return counted.select("source", F.lit(ESCALATION).alias("kind"), F.timestamp_micros("at").alias("ts"), "record_id", F.col("n").alias("restricted"))
