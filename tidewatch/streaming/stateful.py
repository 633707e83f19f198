"""Keyed streaming state: the registry of active tokens (T7), moved scores (T10) and deployers watched from their launches.

Keys of the state are buckets of tokens or deployers, so a micro-batch costs one call per bucket, whatever the number of keys in it. Time is
the events' own: what a stream has seen is told by its watermark, and timers fire when that passes. Rows that arrive out of order
within the watermark's delay are held in the state and handled in order. Each sink writes a batch to its own folder, so a restart from
the checkpoint repeats the last batch without repeating its rows.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.sequences import HAZARD, MOST_RUNS, PRIOR, RunLengths
from ..plans.dialect import Dialect, Tables
from ..plans.views import SWAPS_AS_OF
from ..sources.files import discard, settings, shuffles_dropped
from .jobs import drain, folder, parquet_batches

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys of the state at least; some multiple of the cores of a cluster.
BUCKETS = 32
#: Rows that a bucket may hold back: a Python worker has those of one bucket in memory.
BUCKET_ROWS = 20_000
#: Memory of all RocksDB stores of an executor, however many partitions it holds.
ROCKS_MB = 1000


def rocks(spark: SparkSession):
    """transformWithState needs the RocksDB state store, here with one bound of memory an executor, and files packed so that texts in base 64 cost no more
    than their bytes; the session's own settings come back after it."""
    store = "spark.sql.streaming.stateStore"
    return settings(spark, {f"{store}.providerClass": ROCKS, f"{store}.rocksdb.boundedMemoryUsage": "true", f"{store}.rocksdb.maxMemoryUsageMB": str(ROCKS_MB), f"{store}.rocksdb.compression": "zstd"})


def packed(numbers: bytes) -> str:
    """Bytes of numbers of eight bytes each as a text: packed by the place of a byte in its number, as exponents are much alike."""
    by_place = np.frombuffer(numbers, np.uint8).reshape(-1, 8).T.tobytes()
    return "z:" + base64.b64encode(zlib.compress(by_place, 1)).decode()


def unpacked(text: str) -> bytes:
    """The bytes again; a text without the mark is plain, of a checkpoint from before."""
    if not text.startswith("z:"):
        return base64.b64decode(text)
    return np.frombuffer(zlib.decompress(base64.b64decode(text[2:])), np.uint8).reshape(8, -1).T.tobytes()


def buckets_of(rows: int) -> int:
    """The number of buckets for so many rows that wait at once."""
    return max(BUCKETS, -(-rows // BUCKET_ROWS))


def stateful(rows: DataFrame, processor: StatefulProcessor, schema: str, *key: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows that a processor makes of a stream with an event time `at`, keyed by buckets of `key`. The number of buckets
    belongs to the checkpoint: a restart must give the same."""
    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    return keyed.groupBy("bucket").transformWithStateInPandas(processor, schema, "append", "eventtime")


def _alarm(handle: StatefulProcessorHandle, seconds: float | None) -> None:
    """One timer at that event time, instead of any before."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    if seconds is not None:
        handle.registerTimer(int(seconds * 1000))


# the registry of active tokens


class ActiveTokens(StatefulProcessor):
    """Tokens with an event in the last `idle` seconds or with a subscriber. An event moves a token's last time forward only; the count of
    subscribers does not fall below none. A bucket holds at most `most` tokens: beyond, the one whose last event is oldest goes (a
    token that has subscribers only counts as oldest). Reports every token that changed, with step 0 after a batch and 1 after a timer."""

    SCHEMA = "chain string, token string, last_t long, subscribers int, active boolean, step int"

    def __init__(self, idle: int, most: int):
        self.idle, self.most = idle, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tokens", "chain array<string>, token array<string>, last_t array<long>, subscribers array<int>")

    def _load(self) -> dict:
        held = self.state.get()
        return {} if held is None else {(c, t): [last, n] for c, t, last, n in zip(*held, strict=True)}

    def _save(self, tokens: dict) -> None:
        if tokens:
            self.state.update((*map(list, zip(*tokens, strict=True)), [v[0] for v in tokens.values()], [v[1] for v in tokens.values()]))
        else:
            self.state.clear()
        idle = [v[0] + self.idle for v in tokens.values() if not v[1] and v[0] is not None]
        _alarm(self.handle, min(idle, default=None))

    @staticmethod
    def _report(rows: list[tuple], step: int) -> pd.DataFrame:
        made = pd.DataFrame([(*r, step) for r in rows], columns=["chain", "token", "last_t", "subscribers", "active", "step"])
        return made.astype({"last_t": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tokens, touched = self._load(), {}
        batch = pd.concat(list(rows))
        batch = batch[batch["kind"].isin(("event", "subscribe", "unsubscribe"))].astype({"t": "int64", "seq": "int64"}).sort_values(["t", "seq"])
        for chain, token, kind, t in zip(batch["chain"], batch["token"], batch["kind"], batch["t"], strict=True):
            if kind == "unsubscribe" and (chain, token) not in tokens:
                continue
            one = tokens.setdefault((chain, token), [None, 0])
            touched[chain, token] = one
            if kind == "event":
                one[0] = t if one[0] is None else max(one[0], t)
            else:
                one[1] = max(0, one[1] + (1 if kind == "subscribe" else -1))
        by_age = sorted(tokens, key=lambda k: (tokens[k][0] is not None, tokens[k][0] or 0, k))
        gone = by_age[: max(0, len(tokens) - self.most)]
        # without events and subscribers there is nothing to wait for
        gone += [k for k in by_age[len(gone) :] if tokens[k] == [None, 0]]
        dropped = [(*k, *tokens.pop(k), False) for k in gone]
        self._save(tokens)
        yield self._report([(*k, *v, True) for k, v in touched.items() if k in tokens] + dropped, 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        tokens = self._load()
        gone = [k for k, (last, n) in tokens.items() if not n and last is not None and now - last >= self.idle]
        dropped = [(*k, *tokens.pop(k), False) for k in gone]
        self._save(tokens)
        yield self._report(dropped, 1)


def registry_log(events: DataFrame, idle: int = 3600, most: int = 5000, **how) -> DataFrame:
    """The changes of the registry by a stream (chain, token, kind, t in seconds, seq, at: the event time under a watermark)."""
    return stateful(events.select("chain", "token", "kind", "t", "seq", "at"), ActiveTokens(idle, most), ActiveTokens.SCHEMA, "chain", "token", **how)


def registry(log: DataFrame, most: int = 5000) -> DataFrame:
    """(chain, token, last_t, subscribers) of the active tokens after the last batch of a log: the `most` latest. What falls out of a bucket is never among them."""
    last = F.max_by(F.struct("last_t", "subscribers", "active"), F.struct("batch", "step")).alias("s")
    now = log.groupBy("chain", "token").agg(last).where("s.active").select("chain", "token", "s.last_t", "s.subscribers")
    return now.orderBy(F.col("last_t").desc_nulls_last(), "chain", "token").limit(most)


def due(log: DataFrame, now: int, period: int = 300, most: int = 5000) -> DataFrame:
    """Active tokens with an event in the last `period` seconds, which the periodic scan scores again."""
    return registry(log, most).where(F.col("last_t") > now - period)


# rows in order


class InOrder(StatefulProcessor):
    """Holds rows until the watermark passes their time, then hands them on in the order of (t, seq), whatever batches they came in.

    The state keeps rows by the chunk, as one text of `CHUNK` rows at most: each element of a list state costs a call. A text is packed, as it
    lies on disk in the store and in its checkpoints; one that begins with a bracket is plain, of a checkpoint from before."""

    PENDING = "rows string"
    CHUNK = 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.PENDING)

    def _chunks(self, rows: list[tuple[int, int, str]]) -> list[tuple[str]]:
        """Rows with their bodies as they are, which are JSON already."""
        texts = (f"[{','.join(f'[{t},{seq},{body}]' for t, seq, body in rows[k : k + self.CHUNK])}]" for k in range(0, len(rows), self.CHUNK))
        return [(base64.b64encode(zlib.compress(text.encode(), 1)).decode(),) for text in texts]

    @staticmethod
    def _rows(chunk: str) -> list:
        return json.loads(chunk if chunk.startswith("[") else zlib.decompress(base64.b64decode(chunk)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            batch = batch[batch["body"].notna()].astype({"t": "int64", "seq": "int64"})  # a heartbeat made them floats
            if len(batch):
                self.pending.appendList(self._chunks(list(zip(batch["t"].tolist(), batch["seq"].tolist(), batch["body"].tolist(), strict=True))))
                first = min(first, int(batch["t"].min())) if first is not None else int(batch["t"].min())
        if first is not None and not list(self.handle.listTimers()):
            _alarm(self.handle, first + 1)
        yield self.handled([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        held = [row for (chunk,) in self.pending.get() for row in self._rows(chunk)]
        held.sort(key=lambda r: (r[0], r[1]))
        ripe = [r for r in held if r[0] < now]
        rest = held[len(ripe) :]
        self.pending.put(self._chunks([(t, seq, json.dumps(body)) for t, seq, body in rest])) if rest else self.pending.clear()
        _alarm(self.handle, rest[0][0] + 1 if rest else None)
        yield self.handled([tuple(r) for r in ripe])

    def handled(self, rows: list[tuple]) -> pd.DataFrame:
        raise TypeError("a kind of InOrder says what it makes of its rows")


def in_order(rows: DataFrame, processor: InOrder, schema: str, key: list[str], body: list[str], **how) -> DataFrame:
    """A stream of (t, seq, at and others) through a kind of InOrder, which gets the columns of `body`."""
    packed = F.when(F.col(key[0]).isNotNull(), F.to_json(F.struct(*body), {"ignoreNullFields": "false"}))
    return stateful(rows.select(*key, "t", "seq", "at", packed.alias("body")), processor, schema, *key, **how)


class Grouped:
    """Values by key out of a map state that holds the keys of a bucket in `PARTS` entries, as each entry costs several calls. For one call
    of a processor: parts are read when asked for, and `save` writes them back."""

    PARTS = 16
    KEY, VALUE = "part int", "body string"

    def __init__(self, state):
        self.state, self.parts = state, {}

    def of(self, *key) -> dict:
        """The values of the part of that key, by key."""
        part = zlib.crc32(json.dumps(key).encode()) % self.PARTS
        if part not in self.parts:
            held = json.loads(self.state.getValue((part,))[0]) if self.state.containsKey((part,)) else []
            self.parts[part] = {tuple(k): v for k, v in held}
        return self.parts[part]

    def save(self) -> None:
        for part, values in self.parts.items():
            self.state.updateValue((part,), (json.dumps(list(values.items())),))


class MovedScores(InOrder):
    """Scores that moved by `least` or more since the one before of their token and detector, or are its first."""

    SCHEMA = "token string, detector_id string, id long, confidence double, before double"

    def __init__(self, least: float):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.scores = handle.getMapState("scores", Grouped.KEY, Grouped.VALUE)

    def handled(self, rows: list[tuple]) -> pd.DataFrame:
        out, known = [], Grouped(self.scores)
        for _, _, r in rows:
            key, now = (r["token"], r["detector_id"]), r["confidence"]
            scores = known.of(*key)
            before = scores.get(key)
            if before is None or abs(now - before) >= self.least:
                out.append((*key, r["id"], now, before))
            scores[key] = now
        known.save()
        return pd.DataFrame(out, columns=["token", "detector_id", "id", "confidence", "before"]).astype({"id": "int64", "confidence": float, "before": float})


def moved(scores: DataFrame, least: float = 0.05, **how) -> DataFrame:
    """T10 over a stream of (token, detector_id, id, confidence, t, seq, at)."""
    return in_order(scores, MovedScores(least), MovedScores.SCHEMA, ["token", "detector_id"], ["token", "detector_id", "id", "confidence"], **how)


class WatchedDeployers(InOrder):
    """A launch updates its deployer's features and change-point posterior, the state of one deployer being a few numbers (last time, launches,
    rugs, most likely run) and the bytes of its run lengths."""

    SCHEMA = "deployer string, token string, nth long, score double, cp_prob double, p_short double, run_mode int, run_drop int, lost double"
    MONTH = 30 * 86_400

    def __init__(self, prior: tuple[float, float, float, float], hazard: float, most: int):
        self.prior, self.hazard, self.most = prior, hazard, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.deployers = handle.getMapState("deployers", Grouped.KEY, Grouped.VALUE)

    @staticmethod
    def score(gap: int, locked: float, liquidity: int, holders: int, rug_rate: float) -> float:
        """The composite of a launch, as in d09_deployer_features."""
        within = lambda x: min(max(x, 0.0), 1.0)
        return round(0.25 * within(1 - float(np.log(gap + 1.0)) / 16) + 0.25 * (1 - locked) + 0.20 * within(1 - float(np.log(liquidity / 100.0 + 1)) / 14) + 0.15 * within(1 - holders / 200.0) + 0.15 * rug_rate, 6)

    def handled(self, rows: list[tuple]) -> pd.DataFrame:
        out: list[tuple] = []
        model, known, kept = RunLengths(self.prior, self.hazard, self.most), {}, Grouped(self.deployers)
        waves: list[list] = []  # the first launches of the batch of every deployer, the second ones, ...
        for _, _, r in rows:
            d = r["deployer"]
            if d not in known:
                last, launches, rugs, likely, runs = kept.of(d).get((d,), (None, 0, 0, 0, None))
                known[d] = [last, launches, rugs, likely, len(known), 0]
                model.loads(unpacked(runs)) if runs is not None else model.grow(1)
            one = known[d]
            if one[5] == len(waves):
                waves.append([])
            waves[one[5]].append((one, r))
            one[5] += 1
        for wave in waves:
            scores = []
            for one, r in wave:
                gap = self.MONTH if one[0] is None else r["t"] - one[0]
                scores.append(self.score(gap, 1 - r["lp_deployer"] / r["lp_total"], r["liquidity_cents"], r["holders"], one[2] / one[1] if one[1] else 0.0))
                one[0], one[1], one[2] = r["t"], one[1] + 1, one[2] + int(r["lp_deployer"] * 2 > r["lp_total"])
            places = np.array([one[4] for one, _ in wave])
            for (one, r), x, cp, short, mode, lost in zip(wave, scores, *model.step(places, np.array(scores)), model.lost[places], strict=True):
                out.append((r["deployer"], r["token"], one[1], x, cp, short, int(mode), int(max(0, one[3] + 1 - mode)), lost))
                one[3] = int(mode)
        for d, (last, launches, rugs, likely, place, _) in known.items():
            kept.of(d)[(d,)] = (last, launches, rugs, likely, packed(model.dumps(place)))
        kept.save()
        kinds = {"nth": "int64", "score": float, "cp_prob": float, "p_short": float, "run_mode": "int32", "run_drop": "int32", "lost": float}
        return pd.DataFrame(out, columns=["deployer", "token", *kinds]).astype(kinds)


def watched(launches: DataFrame, prior: tuple[float, float, float, float] = PRIOR, hazard: float = HAZARD, most: int = MOST_RUNS, **how) -> DataFrame:
    """T15 into D09 over a stream of launches (deployer, token, t, lp_deployer, lp_total, liquidity_cents, holders, seq, at)."""
    return in_order(launches, WatchedDeployers(prior, hazard, most), WatchedDeployers.SCHEMA, ["deployer"], ["deployer", "token", "t", "lp_deployer", "lp_total", "liquidity_cents", "holders"], **how)


# running


def replay(rows: DataFrame, at: str, batches: int = 3) -> int:
    """Rows with a time `at` as files of a stream's folder, one after the other in time; their number. They are worked out once, and lie on
    disk twice only while they are dealt out."""
    rows.write.parquet(f"{at}/rows")
    rows = rows.sparkSession.read.schema(rows.schema).parquet(f"{at}/rows")
    lo, hi, n = rows.agg(F.min(F.unix_timestamp("at")), F.max(F.unix_timestamp("at")), F.count(F.lit(1))).first()
    step = (max(0, (hi or 0) - (lo or 0)) // batches) + 1
    for k in range(batches):
        part = F.floor((F.unix_timestamp("at") - F.lit(lo or 0)) / step) == k
        rows.where(part).write.mode("append").parquet(f"{at}/input")
    discard(rows.sparkSession, f"{at}/rows")
    return n


def heartbeat(spark: SparkSession, at: str, now: int) -> None:
    """A row with nothing but a time, as a live stream's next event would bring it."""
    schema = spark.read.parquet(f"{at}/input").schema
    row = [F.timestamp_seconds(F.lit(now)).cast(f.dataType).alias(f.name) if f.name == "at" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1).select(*row).write.mode("append").parquet(f"{at}/input")


def advance(spark: SparkSession, at: str, made: Callable[[DataFrame], DataFrame], late: str) -> DataFrame:
    """Runs a stateful stream over what is new in its folder, from its checkpoint, and gives all rows so far, with their batch."""
    schema = spark.read.parquet(f"{at}/input").schema
    rows = spark.readStream.schema(schema).parquet(f"{at}/input").withWatermark("at", late)
    with rocks(spark):
        drain(made(rows), parquet_batches(at), at)
    return spark.read.parquet(f"{at}/data")


IDLE, LATE = 86_400, 600


def _kinds(swaps_like: str) -> str:
    return f"CASE {swaps_like} WHEN 'click' THEN 'subscribe' WHEN 'view' THEN 'unsubscribe' ELSE 'event' END"


def active_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after all events, as of SWAPS_AS_OF."""
    at = folder(spark, "registry")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp")).where(F.unix_timestamp("at") <= SWAPS_AS_OF)
    rows = events.selectExpr("'solana' AS chain", "concat('tok', CAST(user_id AS STRING)) AS token", f"{_kinds('event_type')} AS kind", "unix_timestamp(at) AS t", "event_id AS seq", "at")
    replay(rows, at, 2)
    heartbeat(spark, at, SWAPS_AS_OF + LATE)
    return registry(advance(spark, at, lambda s: registry_log(s, IDLE), f"{LATE} seconds"))


def _active_text(d: Dialect) -> str:
    delta = "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END"
    over = "OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
    WITH e AS (SELECT user_id, event_id, event_type, {d.epoch("ts")} AS t FROM {{events}} WHERE {d.epoch("ts")} <= {SWAPS_AS_OF}),
    s AS (SELECT user_id, event_id, event_type, t, sum({delta}) {over} AS run FROM e),
    m AS (SELECT *, least(0, min(run) OVER (PARTITION BY user_id)) AS floor_, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS nth FROM s),
    g AS (SELECT user_id, max(CASE WHEN event_type NOT IN ('click', 'view') THEN t END) AS last_t, CAST(max(CASE WHEN nth = 1 THEN run - floor_ END) AS INT) AS subscribers FROM m GROUP BY user_id)
    SELECT 'solana' AS chain, concat('tok', CAST(user_id AS STRING)) AS token, last_t, subscribers FROM g WHERE subscribers > 0 OR last_t > {SWAPS_AS_OF - IDLE} ORDER BY last_t DESC NULLS LAST, token LIMIT 5000"""


def streamed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores that moved, as a stream."""
    at = folder(spark, "scores")
    a = Tables(spark, sf_dir)("anomalies").select("token", "detector_id", "id", "confidence", "t", F.col("id").alias("seq"), F.timestamp_seconds("t").alias("at"))
    buckets = buckets_of(replay(a, at, 2))
    heartbeat(spark, at, 4_102_444_800)
    return advance(spark, at, lambda s: moved(s, buckets=buckets), f"{LATE} seconds").select("token", "detector_id", "id")


def watched_deployers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change-points of deployers from the stream of their launches."""
    at = folder(spark, "launches")
    tables = Tables(spark, sf_dir)
    holders = tables("transfers").groupBy("token").agg(F.countDistinct("to_address").alias("holders"))
    ordered = F.row_number().over(Window.partitionBy("deployer").orderBy("t", "token")).cast("long").alias("seq")
    launches = tables("launches").join(holders, "token", "left").select("deployer", "token", "t", "lp_deployer", "lp_total", "liquidity_cents", F.coalesce("holders", F.lit(0)).alias("holders"), ordered, F.timestamp_seconds("t").alias("at"))
    with shuffles_dropped(spark):
        buckets = buckets_of(replay(launches, at, 2))
        heartbeat(spark, at, 4_102_444_800)
        changes = advance(spark, at, lambda s: watched(s, buckets=buckets), f"{LATE} seconds")
    discard(spark, f"{at}/input", f"{at}/_checkpoint")
    return changes.select("deployer", "token", "nth", "score", *[F.round(c, 6).alias(c) for c in ("cp_prob", "p_short")], "run_mode", "run_drop", F.round("lost", 6).alias("lost"))


def _queries() -> dict:
    from ..operators.sequences import change_points_text

    return {
        "t07_registry": (active_tokens, _active_text),
        "t10_score_stream": (streamed_scores, lambda d: "SELECT token, detector_id, id FROM (SELECT token, detector_id, id, confidence, lag(confidence) OVER (PARTITION BY token, detector_id ORDER BY t, id) AS before FROM {anomalies}) AS x WHERE before IS NULL OR abs(confidence - before) >= 0.05"),
        "t15_watched_deployers": (watched_deployers, change_points_text),
    }


STREAMS = _queries()
