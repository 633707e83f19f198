"""Streaming operators (T) on Structured Streaming; each can run to the end of its input and equals its batch form."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.dialect import Dialect, Tables
from ..plans.views import DAY, SWAPS_AS_OF

KINDS = {"purchase": "swap", "signup": "swap", "click": "swap", "view": "pool_event", "error": "reorg_marker"}


def folder(spark: SparkSession, name: str) -> str:
    from ..sources.files import shared_folder

    return f"{shared_folder(spark)}/tidewatch/stream-{name}-{uuid.uuid4().hex}"


def source(spark: SparkSession, sf_dir: str, files: int = 2) -> DataFrame:
    """The event table as a stream of its files; a glob takes a single file as well as a folder."""
    name = "events"
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name}.parque[t]")


def drain(stream: DataFrame, batch: Callable[[DataFrame, int], None], at: str, mode: str = "append") -> None:
    """Runs to the end of the input. The checkpoint makes each batch count once after a restart."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/_checkpoint").trigger(availableNow=True).foreachBatch(batch)
    writer.start().awaitTermination()


def parquet_batches(at: str, *partition: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to its own folder, so a batch that is repeated replaces itself."""

    def write(df: DataFrame, number: int) -> None:
        out = df.write.mode("overwrite")
        (out.partitionBy(*partition) if partition else out).parquet(f"{at}/data/batch={number}")

    return write


def closed(stream: Callable[[DataFrame], DataFrame], spark: SparkSession, sf_dir: str, at: str, late: str) -> DataFrame:
    """Rows of a windowed stream in append mode: each is written once, when the watermark passes its end and its state goes.

    At the end of the input one heartbeat far ahead closes what is still open. It comes as a file of a second folder, in a restart from
    the checkpoint of the first run, as a new batch of a live stream would."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    beats = f"{at}/beats"
    events.limit(0).write.parquet(beats)
    both = source(spark, sf_dir).unionByName(spark.readStream.schema(events.schema).parquet(beats))
    timed = both.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    write = parquet_batches(at)
    drain(stream(timed), write, at)
    beat = [F.lit("2200-01-01").cast("timestamp").cast(f.dataType).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]
    spark.range(1).select(*beat).write.mode("append").parquet(beats)
    drain(stream(timed), write, at)
    return spark.read.parquet(f"{at}/data")


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind, in micro-batches, to one table per kind."""
    at = folder(spark, "routed")
    kind = F.lit("other")
    for k, v in KINDS.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    drain(source(spark, sf_dir).select("event_id", "value", kind.alias("kind")), parquet_batches(at, "kind"), at)
    return spark.read.parquet(f"{at}/data").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once, though the stream holds each twice; state is bounded by the watermark."""
    at = folder(spark, "deduplicated")
    twice = source(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("ts", F.col("ts").cast("timestamp"))
    once = twice.withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["event_id"])
    drain(once.select("event_id", "user_id"), parquet_batches(at), at)
    return spark.read.parquet(f"{at}/data").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalidations of a token within half an hour are one, with the latest time and the number of distinct blocks."""

    def slots(e: DataFrame) -> DataFrame:
        e = e.withColumn("token", F.concat(F.lit("tok"), (F.col("event_id") % 4).cast("string"))).withColumn("t", F.unix_timestamp("ts"))
        return e.groupBy("token", F.window("ts", "30 minutes").alias("w")).agg(F.max("t").alias("latest"), F.collect_set(F.floor(F.col("t") / 60)).alias("blocks"))

    slot = F.floor(F.unix_timestamp("w.start") / 1800).alias("slot")
    return closed(slots, spark, sf_dir, folder(spark, "debounced"), "1 day").select("token", slot, "latest", F.size("blocks").cast("long").alias("blocks"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing windows of six hours every two, with a watermark."""

    def sums(e: DataFrame) -> DataFrame:
        return e.groupBy(F.window("ts", "6 hours", "2 hours"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))

    return closed(sums, spark, sf_dir, folder(spark, "windows"), "1 day").select(F.unix_timestamp("window.end").alias("window_end"), "event_type", "n", "cents")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, closed by two hours of silence."""

    def lengths(e: DataFrame) -> DataFrame:
        return e.groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))

    return closed(lengths, spark, sf_dir, folder(spark, "sessions"), "1 day").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def first_launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hook on pool initialisation. Each batch writes its own counts per deployer and they add up when read, so no state is kept."""
    at = folder(spark, "launches")
    made = source(spark, sf_dir).where("event_type = 'signup'").select("user_id", F.unix_timestamp("ts").alias("t"))
    write = parquet_batches(at)
    drain(made, lambda df, n: write(df.groupBy("user_id").agg(F.count(F.lit(1)).alias("launches"), F.min("t").alias("first_t")), n), at)
    return spark.read.parquet(f"{at}/data").groupBy("user_id").agg(F.sum("launches").alias("launches"), F.min("first_t").alias("first_t"))


def changed(scores: DataFrame, key: list[str], order: Column, value: str, least: float = 0.05) -> DataFrame:
    """Rows whose value moved by `least` or more since the row before."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(order))
    return scores.withColumn("__before", before).where(F.col("__before").isNull() | (F.abs(F.col(value) - F.col("__before")) >= least)).drop("__before")


def moved_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Tables(spark, sf_dir)("anomalies").select("token", "detector_id", "id", "confidence")
    return changed(a, ["token", "detector_id"], F.col("id"), "confidence").select("token", "detector_id", "id")


def multi_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of several chains merged into one."""
    at = folder(spark, "merged")
    parts = [source(spark, sf_dir).where(F.col("event_id") % 3 == k).select("event_id", F.lit(c).alias("chain")) for k, c in enumerate(("solana", "ethereum", "base"))]
    drain(parts[0].unionByName(parts[1]).unionByName(parts[2]), parquet_batches(at), at)
    return spark.read.parquet(f"{at}/data").groupBy("chain").agg(F.count(F.lit(1)).alias("n"))


def _windows_text(d: Dialect) -> str:
    t = d.epoch("ts")
    return f"SELECT end_t AS window_end, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM (SELECT event_type, value, ({d.idiv(t, '7200')} + k) * 7200 AS end_t FROM {{events}} CROSS JOIN {d.rows('(1), (2), (3)', 'k')}) AS x GROUP BY end_t, event_type"


def _sessions_text(d: Dialect) -> str:
    micros = "unix_micros(CAST(ts AS TIMESTAMP))" if d.spark else "epoch_us(ts)"
    return f"""
    WITH g AS (SELECT user_id, m, CASE WHEN lag(m) OVER (PARTITION BY user_id ORDER BY m) > m - 7200000000 THEN 0 ELSE 1 END AS begins FROM (SELECT user_id, {micros} AS m FROM {{events}}) AS e),
    s AS (SELECT user_id, sum(begins) OVER (PARTITION BY user_id ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM g)
    SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, no, count(*) AS n FROM s GROUP BY user_id, no) AS x GROUP BY user_id"""


def _routed_text(d: Dialect) -> str:
    return "SELECT kind, count(*) AS n, count(DISTINCT event_id) AS ids FROM (SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN 'swap' WHEN event_type = 'view' THEN 'pool_event' WHEN event_type = 'error' THEN 'reorg_marker' ELSE 'other' END AS kind FROM {events}) AS x GROUP BY kind"


STREAMS = {
    "t01_router": (routed, _routed_text),
    "t03_exactly_once": (deduplicated, lambda d: "SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id"),
    "t06_debounce": (debounced, lambda d: f"SELECT token, slot, max(t) AS latest, count(DISTINCT CAST(floor(t / CAST(60 AS DOUBLE)) AS BIGINT)) AS blocks FROM (SELECT concat('tok', CAST(event_id % 4 AS STRING)) AS token, {d.epoch('ts')} AS t, {d.idiv(d.epoch('ts'), '1800')} AS slot FROM {{events}}) AS x GROUP BY token, slot"),
    "t08_windows": (windows, _windows_text),
    "t14_sessions": (sessions, _sessions_text),
    "t15_launch_hook": (first_launches, lambda d: f"SELECT user_id, count(*) AS launches, min({d.epoch('ts')}) AS first_t FROM {{events}} WHERE event_type = 'signup' GROUP BY user_id"),
    "t10_moved_scores": (moved_scores, lambda d: "SELECT token, detector_id, id FROM (SELECT token, detector_id, id, confidence, lag(confidence) OVER (PARTITION BY token, detector_id ORDER BY id) AS before FROM {anomalies}) AS x WHERE before IS NULL OR abs(confidence - before) >= 0.05"),
    "t12_multi_chain": (multi_chain, lambda d: "SELECT CASE event_id % 3 WHEN 0 THEN 'solana' WHEN 1 THEN 'ethereum' ELSE 'base' END AS chain, count(*) AS n FROM {events} GROUP BY CASE event_id % 3 WHEN 0 THEN 'solana' WHEN 1 THEN 'ethereum' ELSE 'base' END"),
}

TEXTS = {
    "t04_reorg_rewind": lambda d: f"SELECT chain, count(*) AS kept, max(block_height) AS tip FROM {{swaps}} WHERE block_height < {(SWAPS_AS_OF - DAY) // 60} GROUP BY chain",
    "t05_forks": lambda d: "SELECT h.chain, h.height FROM {headers} AS h JOIN {headers} AS p ON p.chain = h.chain AND p.height = h.height - 1 WHERE h.parent_hash <> p.hash",
    "t07_active_tokens": lambda d, most=5000: f"SELECT token, last_t FROM (SELECT token, max(t) AS last_t FROM {{anomalies}} GROUP BY token ORDER BY max(t) DESC, token LIMIT {most}) AS x WHERE last_t > {SWAPS_AS_OF - 60 * 60}",
    "t11_watchlist": lambda d: "SELECT id, token FROM {anomalies} WHERE chain IN ('solana', 'base') AND token IN ('tok1', 'tok7', 'tok42') AND confidence >= 0.3",
    "t16_rescore_scan": lambda d: f"SELECT token, count(*) AS due FROM {{anomalies}} WHERE t BETWEEN {SWAPS_AS_OF - 300} AND {SWAPS_AS_OF + 3600} GROUP BY token",
}
