"""Keyed streaming state: equal to batch forms, however the input is cut into batches and restarted from checkpoints."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import sequences
from tidewatch.streaming import stateful


def fed(spark, at, made, batches, late, beat):
    """The rows of a stream over batches of rows, with a restart from the checkpoint before each, and after a heartbeat."""
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(f"{at}/input")
        out = stateful.advance(spark, at, made, late)
    stateful.heartbeat(spark, at, beat)
    out = stateful.advance(spark, at, made, late)
    return out


def events(spark, rows):
    """Rows (token, kind, t, seq) as a stream's."""
    made = spark.createDataFrame(rows, "token string, kind string, t long, seq long")
    return made.select(F.lit("solana").alias("chain"), "token", "kind", "t", "seq", F.timestamp_seconds("t").alias("at"))


def registry_by_hand(rows, now, idle, most):
    tokens = {}
    for token, kind, t, _ in sorted(rows, key=lambda r: (r[2], r[3])):
        one = tokens.setdefault(token, [None, 0])
        if kind == "event":
            one[0] = t
        else:
            one[1] = max(0, one[1] + (1 if kind == "subscribe" else -1))
    live = [(t, last, n) for t, (last, n) in tokens.items() if n or (last is not None and last > now - idle)]
    return sorted(live, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[:most]


@pytest.mark.parametrize("most", [4, 100])
def test_registry_restarts(spark, tmp_path, most):
    rng = random.Random(most)
    kinds = ("event", "event", "subscribe", "unsubscribe") if most == 100 else ("event",)
    rows = [(f"t{rng.randrange(30)}", rng.choice(kinds), 1000 * k + rng.randrange(900), k) for k in range(200)]
    now, idle = 200_000, 20_000
    parts = [rows[:70], rows[70:71], rows[71:200]]
    logs = []
    for name, batches in (("cut", parts), ("whole", [rows])):
        log = fed(spark, str(tmp_path / name), lambda s: stateful.registry_log(s, idle, most, buckets=3), [events(spark, b) for b in batches], "10 seconds", now + 10)
        logs.append([(r.token, r.last_t, r.subscribers) for r in stateful.registry(log, most).collect()])
    assert logs[0] == logs[1] == registry_by_hand(rows, now, idle, most)
    assert {r.token for r in stateful.due(log, now, 5000, most).collect()} == {t for t, last, _ in logs[0] if last is not None and last > now - 5000}


def test_registry_bounds(spark, tmp_path):
    """A bucket keeps the latest tokens; idle tokens go, subscribed ones stay, and unsubscribing frees them."""
    rows = [("a", "event", 100, 1), ("b", "event", 200, 2), ("c", "event", 300, 3), ("d", "subscribe", 310, 4), ("a", "event", 50, 5)]
    at = str(tmp_path / "r")
    make = lambda s: stateful.registry_log(s, 1000, 2, buckets=1)
    events(spark, rows).coalesce(1).write.parquet(f"{at}/input")
    log = stateful.advance(spark, at, make, "0 seconds")
    assert Counter((r.token, r.active) for r in log.collect()) == Counter([("b", True), ("c", True), ("a", False), ("d", False)])
    events(spark, [("c", "subscribe", 400, 6), ("e", "unsubscribe", 401, 7)]).write.mode("append").parquet(f"{at}/input")
    stateful.heartbeat(spark, at, 5000)
    assert [(r.token, r.last_t, r.subscribers) for r in stateful.registry(stateful.advance(spark, at, make, "0 seconds"), 2).collect()] == [("c", 300, 1)]
    events(spark, [("c", "unsubscribe", 5001, 8)]).write.mode("append").parquet(f"{at}/input")
    stateful.heartbeat(spark, at, 6000)
    assert stateful.registry(stateful.advance(spark, at, make, "0 seconds"), 2).count() == 0


def test_moved_scores_of_shuffled_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"t{rng.randrange(5)}", f"d{rng.randrange(2)}", k, round(rng.random() * 0.2, 3), 10 * k + rng.randrange(10)) for k in range(300)]
    shuffled = rows[:]
    for k in range(0, 300, 60):  # batches overlap in time, within the watermark's delay
        part = shuffled[k : k + 60]
        rng.shuffle(part)
        shuffled[k : k + 60] = part
    schema = "token string, detector_id string, id long, confidence double, t long"
    make = lambda some: spark.createDataFrame(some, schema).withColumn("seq", F.col("id")).withColumn("at", F.timestamp_seconds("t"))
    got = fed(spark, str(tmp_path / "s"), lambda s: stateful.moved(s, 0.05, buckets=3), [make(shuffled[k : k + 25]) for k in (0, 25, 50)] + [make(shuffled[75:])], "1000 seconds", 10**9)
    before, want = {}, set()
    for token, detector, k, x, _ in rows:
        old = before.get((token, detector))
        if old is None or abs(x - old) >= 0.05:
            want.add((token, detector, k, x, old))
        before[token, detector] = x
    found = [(r.token, r.detector_id, r.id, r.confidence, None if r.before is None or r.before != r.before else r.before) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


def test_watched_deployers_restart(spark, tmp_path):
    """The stream of launches gives the batch result, with a restart between any two batches."""
    rng = random.Random(6)
    rows, t = [], 0
    for k in range(120):
        t += rng.randrange(1, 50_000)
        total = rng.randrange(1, 100)
        rows.append((f"d{rng.randrange(3)}", f"t{k}", t, rng.randrange(total + 1), total, rng.randrange(10**6), rng.randrange(300)))
    schema = "deployer string, token string, t long, lp_deployer long, lp_total long, liquidity_cents long, holders long"
    make = lambda some: spark.createDataFrame(some, schema).withColumn("seq", F.col("t")).withColumn("at", F.timestamp_seconds("t"))
    rows_in = [rows[:50], rows[50:51], rows[51:]]
    got = fed(spark, str(tmp_path / "l"), lambda s: stateful.watched(s, most=16, buckets=2), [make(b) for b in rows_in], "10 seconds", 10**9)
    scores, state, want = {}, {}, {}
    for d, token, t, mine, total, cents, holders in rows:
        last, n, rugs = state.get(d, (None, 0, 0))
        x = stateful.WatchedDeployers.score(30 * 86_400 if last is None else t - last, 1 - mine / total, cents, holders, rugs / n if n else 0)
        state[d] = (t, n + 1, rugs + (2 * mine > total))
        scores.setdefault(d, []).append((token, n + 1, x))
    features = spark.createDataFrame([(d, *r) for d, rs in scores.items() for r in rs], "deployer string, token string, nth long, score double")
    want = {(r.deployer, r.token, r.nth, r.run_mode, r.run_drop): (r.score, r.p_short, r.lost) for r in sequences.change_points(features, most=16).collect()}
    found = {(r.deployer, r.token, r.nth, r.run_mode, r.run_drop): (r.score, r.p_short, r.lost) for r in got.collect()}
    assert found.keys() == want.keys() and len(found) == 120
    assert all(found[k] == pytest.approx(want[k]) for k in want)


def test_run_lengths_equal_the_full_model():
    rng = np.random.default_rng(1)
    series = [np.concatenate([rng.normal(0.3, 0.05, 150), rng.normal(0.7, 0.02, 150)]) for _ in range(3)]
    full = [[model.step(float(x)) for x in s] for s, model in zip(series, [sequences.ChangePoints() for _ in series], strict=True)]
    for most in (400, 40):
        model = sequences.RunLengths(most=most)
        model.grow(3)
        for k in range(300):
            if k == 100:  # a restart
                kept = [model.dumps(j) for j in range(3)]
                model = sequences.RunLengths(most=most)
                for state in kept:
                    model.loads(state)
            got = model.step(np.arange(3), np.array([s[k] for s in series]))
            for j in range(3):
                cp, short, mode = full[j][k]
                assert got[2][j] == mode
                assert abs(got[0][j] - cp) <= model.lost[j] + 1e-12 and abs(got[1][j] - short) <= model.lost[j] + 1e-12
        assert model.run.shape[1] <= most and (most == 40) == bool(model.lost.any()) and model.lost.max() < 0.5


def test_change_points_of_many_batches(spark):
    """Rows of a partition come in several Arrow batches."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.createDataFrame([(f"d{k % 3}", f"t{k}", k // 3 + 1, (k * 37 % 100) / 100) for k in range(150)], "deployer string, token string, nth long, score double")
    whole = {(r.deployer, r.nth): (r.p_short, r.run_mode) for r in sequences.change_points(rows).collect()}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert {(r.deployer, r.nth): (r.p_short, r.run_mode) for r in sequences.change_points(rows).collect()} == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(whole) == 150 and sequences.change_points(rows.limit(0)).count() == 0


def test_run_lengths_of_whole_sequences():
    """The closed form of a block gives what the full model gives step by step, for sequences of any lengths together."""
    rng = np.random.default_rng(3)
    many = [np.round(np.concatenate([rng.normal(0.3, 0.05, n), rng.normal(0.6, 0.02, n // 3), np.full(n // 4, 0.5)]), 6) for n in (1, 2, 3, 60, 150, 90, 4)] * 10
    for x, (short, mode) in zip(many, sequences.run_lengths(many), strict=True):
        model = sequences.ChangePoints()
        want = [model.step(float(v)) for v in x]
        assert mode.tolist() == [w[2] for w in want] and np.allclose(short, [w[1] for w in want], rtol=0, atol=1e-12)
    assert sequences.run_lengths([]) == []


def test_change_points_stream_one_deployer_after_another(spark, monkeypatch):
    """Deployers below, at and beyond the most run lengths, cut anywhere; planning runs no job, as a count of the deployers did."""
    monkeypatch.setattr(sequences, "AT_ONCE", 10)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    long = {"a": 40, "b": 5, "c": 16, "d": 17, "e": 1, "f": 33, None: 3}
    rows = [(d, f"t{k}", k + 1, (k * 37 % 100) / 100 if k % 3 else 0.2) for d, n in long.items() for k in range(n)]
    features = spark.createDataFrame(rows, "deployer string, token string, nth long, score double").repartition(3)
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        points = sequences.change_points(features, most=16)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
        got = {(r.deployer, r.nth): r for r in points.collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(rows)
    for d, n in long.items():
        model, likely = sequences.RunLengths(most=16), 0
        model.grow(1)
        for _, _, nth, x in (r for r in rows if r[0] == d):
            cp, short, mode = model.step(np.zeros(1, np.int64), np.array([x]))
            r = got[d, nth]
            assert (r.cp_prob, r.p_short, r.lost) == pytest.approx((cp[0], short[0], model.lost[0])) and (r.run_mode, r.run_drop) == (mode[0], max(0, likely + 1 - mode[0]))
            likely = mode[0]
        assert bool(model.lost[0]) == (n >= 16)


class Held(list):
    """A list state in memory."""

    def appendList(self, rows):
        self.extend(rows)

    def put(self, rows):
        self[:] = rows

    def get(self):
        return iter(list(self))


def test_pending_rows_are_held_by_the_chunk():
    """Calls of the state follow the chunks, not the rows, and buckets follow the rows, so a worker's memory does not grow with the input."""

    class Handle:
        timers: list = []

        def getListState(self, *_):
            return Held()

        def listTimers(self):
            return iter(self.timers)

        def registerTimer(self, at):
            self.timers.append(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class Same(stateful.InOrder):
        def handled(self, rows):
            return pd.DataFrame(rows, columns=["t", "seq", "body"])

    class Now:
        def getCurrentWatermarkInMs(self):
            return 1_500_000

    one = Same()
    one.init(Handle())
    times = random.Random(2).sample(range(3000), 3000)
    batches = [pd.DataFrame({"t": times[k : k + 1500], "seq": 0, "body": [f'{{"x": "é,[{t}"}}' for t in times[k : k + 1500]]}) for k in (0, 1500)]
    list(one.handleInputRows(None, iter(batches), None))
    assert len(one.pending) <= 4
    out = pd.concat(one.handleExpiredTimer(None, Now(), None))
    assert out["t"].tolist() == list(range(1500)) and out["body"].tolist() == [{"x": f"é,[{t}"} for t in range(1500)]
    assert len(one.pending) == 2 and one.handle.timers == [1_501_000]
    assert stateful.buckets_of(0) == stateful.BUCKETS and 6_000_000 / stateful.buckets_of(6_000_000) <= stateful.BUCKET_ROWS
