"""Batches of events per table that close by size or by timeout.

A table's rows are dealt over shards, so a busy table is not one key. A shard's batch closes once it has `size` rows, or `timeout` seconds after
its first row, whichever is first; rows keep the order in which they were put in. Two clocks: `batched` goes by the
events' own time, so its batches do not depend on how the input is cut up and equal a batch computation; `batched_now` goes by the
wall clock, with rows in order of arrival, for a sink that has to write within a bounded time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.dialect import Dialect, Tables
from .jobs import folder
from .stateful import BUCKETS, InOrder, _alarm, advance, heartbeat, in_order, replay

SCHEMA = "table string, shard int, batch_no long, reason string, t long, seq long, row string"
SIZE, TIMEOUT = 500, 2


class Batches(InOrder):
    """By event time. State per shard: the number of the next batch, the time of its first row, and how many rows it has. Rows themselves go out as
    they ripen, under the number of their batch; a row of its own tells why a batch closed (its t is when, its seq is null)."""

    def __init__(self, size: int, timeout: int):
        self.size, self.timeout = size, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getMapState("open", "table string, shard int", "batch_no long, first_t long, rows long")

    def handled(self, rows: list[tuple]) -> pd.DataFrame:
        out: list[tuple] = []
        known: dict[tuple, list] = {}

        def close(key: tuple, reason: str, at: int) -> None:
            out.append((*key, known[key][0], reason, at, None, None))
            known[key] = [known[key][0] + 1, None, 0]

        for t, seq, r in rows:
            key = (r["table"], r["shard"])
            if key not in known:
                known[key] = list(self.open.getValue(key)) if self.open.containsKey(key) else [0, None, 0]
            if known[key][2] and t - known[key][1] >= self.timeout:
                close(key, "timeout", known[key][1] + self.timeout)
            one = known[key]
            one[1], one[2] = t if one[1] is None else one[1], one[2] + 1
            out.append((*key, one[0], None, t, seq, r["row"]))
            if one[2] >= self.size:
                close(key, "size", t)
        for key, value in known.items():
            self.open.updateValue(key, tuple(value))
        return pd.DataFrame(out, columns=["table", "shard", "batch_no", "reason", "t", "seq", "row"]).astype({"shard": "int32", "batch_no": "int64", "t": "int64", "seq": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        now = timerValues.getCurrentWatermarkInMs() / 1000
        late, wake = [], []
        for (table, shard), (batch_no, first_t, n) in list(self.open.iterator()):
            if n and first_t + self.timeout < now:
                late.append((table, shard, batch_no, "timeout", first_t + self.timeout, None, None))
                self.open.updateValue((table, shard), (batch_no + 1, None, 0))
            elif n:
                wake.append(first_t + self.timeout + 1)
        # the one timer is for whichever is first: a row that ripens, or a batch that is due
        wake += [ms // 1000 for ms in self.handle.listTimers()]
        _alarm(self.handle, min(wake, default=None))
        yield pd.DataFrame(late, columns=["table", "shard", "batch_no", "reason", "t", "seq", "row"]).astype({"shard": "int32", "batch_no": "int64", "t": "int64", "seq": "Int64"})


def batched(rows: DataFrame, size: int = SIZE, timeout: int = TIMEOUT, **how) -> DataFrame:
    """Rows of SCHEMA by a stream (table, shard, row, t in seconds, seq, at: the event time under a watermark)."""
    return in_order(rows, Batches(size, timeout), SCHEMA, ["table", "shard"], ["table", "shard", "row"], **how)


class BatchesNow(StatefulProcessor):
    """By the wall clock: whole batches as JSON arrays, in order of arrival (rows of one micro-batch by t and seq). A timer fires
    `timeout` seconds after the first row that waits."""

    SCHEMA = "table string, shard int, batch_no long, reason string, rows array<string>"

    def __init__(self, size: int, timeout: float):
        self.size, self.timeout = size, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "row string")
        self.open = handle.getValueState("open", "batch_no long, due long")

    def _made(self, key, batch_no: int, reason: str, rows: list[str]) -> tuple:
        return (key[0], key[1], batch_no, reason, rows)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["table", "shard", "batch_no", "reason", "rows"]).astype({"shard": "int32", "batch_no": "int64"})

    def _keep(self, batch_no: int, rest: list[str], due: int | None) -> None:
        self.waiting.put([(r,) for r in rest]) if rest else self.waiting.clear()
        self.open.update((batch_no, due))
        _alarm(self.handle, due / 1000 if due is not None else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        batch_no, due = self.open.get() if self.open.exists() else (0, None)
        waiting = [r[0] for r in self.waiting.get()] if due is not None else []
        new = pd.concat(list(rows)).sort_values(["t", "seq"])["row"].tolist()
        fresh, out, all_rows = due is None, [], waiting + new
        while len(all_rows) >= self.size:
            out.append(self._made(key, batch_no, "size", all_rows[: self.size]))
            all_rows, batch_no, fresh = all_rows[self.size :], batch_no + 1, True
        if not all_rows:
            due = None
        elif fresh:  # what waits now came with this micro-batch
            due = int(now + 1000 * self.timeout)
        self._keep(batch_no, all_rows, due)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        batch_no, due = self.open.get() if self.open.exists() else (0, None)
        out = []
        if due is not None and due <= timerValues.getCurrentProcessingTimeInMs():
            out = [self._made(key, batch_no, "timeout", [r[0] for r in self.waiting.get()])]
            self._keep(batch_no + 1, [], None)
        yield self._frame(out)


def batched_now(rows: DataFrame, size: int = SIZE, timeout: float = TIMEOUT) -> DataFrame:
    """Closed batches of a stream (table, shard, row, t, seq) by the wall clock; every table and shard is a key of its own, and holds fewer than `size` rows."""
    keyed = rows.select("table", "shard", "row", "t", "seq").groupBy("table", "shard")
    return keyed.transformWithStateInPandas(BatchesNow(size, timeout), BatchesNow.SCHEMA, "append", "processingtime")


# the events, by the table that they go to

LATE, QUERY_SIZE, QUERY_TIMEOUT, SHARDS = 600, 20, 40 * 86_400, 16
_TABLE = "CASE event_type WHEN 'purchase' THEN 'swaps' WHEN 'signup' THEN 'transfers' WHEN 'error' THEN 'holder_snapshots' ELSE 'pool_events' END"


def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch of every table and shard: rows, first and last of them, and why it closed (null: it is still open)."""
    at = folder(spark, "batches")
    events = Tables(spark, sf_dir)("events").withColumn("at", F.col("ts").cast("timestamp"))
    rows = events.selectExpr(f"{_TABLE} AS table", f"CAST(user_id % {SHARDS} AS INT) AS shard", "unix_timestamp(at) AS t", "event_id AS seq", "at", "to_json(struct(user_id, value)) AS row")
    replay(rows, at, 2)
    heartbeat(spark, at, 4_102_444_800)
    log = advance(spark, at, lambda s: batched(s, QUERY_SIZE, QUERY_TIMEOUT, buckets=BUCKETS), f"{LATE} seconds")
    made = log.groupBy("table", "shard", "batch_no").agg(F.count("seq").alias("n"), F.min(F.when(F.col("seq").isNotNull(), F.col("t"))).alias("first_t"), F.max_by("seq", F.when(F.col("seq").isNotNull(), F.struct("t", "seq"))).alias("last_seq"), F.max("reason").alias("reason"))
    return made.withColumnRenamed("table", "table_name")


def event_batches_text(d: Dialect) -> str:
    """A recursion over the rows of every shard in turn."""
    return f"""
    WITH RECURSIVE e AS (SELECT {_TABLE} AS table_name, CAST(user_id % {SHARDS} AS INT) AS shard, {d.epoch("ts")} AS t, event_id AS seq FROM {{events}}),
    o AS (SELECT *, row_number() OVER (PARTITION BY table_name, shard ORDER BY t, seq) AS nth FROM e),
    r AS (SELECT table_name, shard, t, seq, nth, CAST(0 AS BIGINT) AS batch_no, t AS first_t, 1 AS n FROM o WHERE nth = 1
      UNION ALL SELECT o.table_name, o.shard, o.t, o.seq, o.nth, CASE WHEN r.n = {QUERY_SIZE} OR o.t - r.first_t >= {QUERY_TIMEOUT} THEN r.batch_no + 1 ELSE r.batch_no END,
        CASE WHEN r.n = {QUERY_SIZE} OR o.t - r.first_t >= {QUERY_TIMEOUT} THEN o.t ELSE r.first_t END, CASE WHEN r.n = {QUERY_SIZE} OR o.t - r.first_t >= {QUERY_TIMEOUT} THEN 1 ELSE r.n + 1 END
        FROM r JOIN o ON o.table_name = r.table_name AND o.shard = r.shard AND o.nth = r.nth + 1)
    SELECT table_name, shard, batch_no, count(*) AS n, min(t) AS first_t, arg_max(seq, nth) AS last_seq, CASE WHEN count(*) = {QUERY_SIZE} THEN 'size' ELSE 'timeout' END AS reason FROM r GROUP BY table_name, shard, batch_no"""


STREAMS = {"t02_event_batches": (event_batches, event_batches_text)}
