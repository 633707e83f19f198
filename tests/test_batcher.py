"""Batches by size or timeout, by the events' time and by the wall clock."""

import random
import time

from pyspark.sql import functions as F

from tests.test_stateful import fed
from tidewatch.streaming import batcher, stateful


def stream_rows(spark, rows):
    made = spark.createDataFrame(rows, "table string, shard int, t long, seq long")
    return made.select("*", F.timestamp_seconds("t").alias("at"), F.col("seq").cast("string").alias("row"))


def by_hand(rows, size, timeout):
    out, state = {}, {}
    for table, shard, t, seq in sorted(rows, key=lambda r: (r[2], r[3])):
        no, first, held = state.get((table, shard), (0, None, []))
        if held and t - first >= timeout:
            out[table, shard, no] = (tuple(held), "timeout")
            no, first, held = no + 1, None, []
        first, held = t if first is None else first, [*held, seq]
        if len(held) == size:
            out[table, shard, no] = (tuple(held), "size")
            no, first, held = no + 1, None, []
        state[table, shard] = (no, first, held)
    for (table, shard), (no, _, held) in state.items():
        if held:
            out[table, shard, no] = (tuple(held), "timeout")
    return out


def told(log):
    out, why = {}, {}
    for r in sorted(log.collect(), key=lambda r: (r.t, r.seq if r.seq is not None and r.seq == r.seq else 0)):
        key = (r.table, r.shard, r.batch_no)
        if r.reason:
            assert key not in why  # a batch closes once
            why[key] = r.reason
        else:
            out.setdefault(key, []).append(int(r.seq))
    return {k: (tuple(v), why.get(k)) for k, v in out.items()}


def test_both_triggers_by_event_time(spark, tmp_path):
    """Any cut into micro-batches and restarts gives the batches of a scan in order; equal times go by seq."""
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(2), 1000 + 5 * k // 2 + rng.choice((0, 0, 0, 40)), k) for k in range(200)]
    want = by_hand(rows, 7, 30)
    assert {reason for _, reason in want.values()} == {"size", "timeout"}
    for name, cuts in (("cut", (60, 61, 130)), ("whole", ())):
        parts = [rows[a:z] for a, z in zip((0, *cuts), (*cuts, 200), strict=True)]
        log = fed(spark, str(tmp_path / name), lambda s: batcher.batched(s, 7, 30, buckets=2), [stream_rows(spark, p) for p in parts], "60 seconds", 10**7)
        assert told(log) == want


def test_both_triggers_by_the_clock(spark, tmp_path):
    source, rows = f"{tmp_path}/in", [("a", 0, k, k) for k in range(5)] + [("b", 1, k, k) for k in range(2)]
    stream_rows(spark, rows).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(stream_rows(spark, rows).schema).parquet(source)
    with stateful.rocks(spark):
        made = batcher.batched_now(stream, 3, 4).writeStream.format("memory").queryName("clocked").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
        try:
            end = time.time() + 90
            while time.time() < end and spark.table("clocked").count() < 3:
                time.sleep(0.5)
            stream_rows(spark, [("a", 0, 9, 9)]).coalesce(1).write.mode("append").parquet(source)
            while time.time() < end and spark.table("clocked").count() < 4:
                time.sleep(0.5)
        finally:
            made.stop()
    got = sorted((r.table, r.batch_no, r.reason, list(r.rows)) for r in spark.table("clocked").collect())
    assert got == [("a", 0, "size", ["0", "1", "2"]), ("a", 1, "timeout", ["3", "4"]), ("a", 2, "timeout", ["9"]), ("b", 0, "timeout", ["0", "1"])]
