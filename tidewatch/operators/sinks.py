"""Sinks and upserts (W): each as a merge of old and new rows, and as idempotent partition overwrites on Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.dialect import Dialect, Tables
from ..plans.views import DAY, SWAPS_AS_OF
from ..sources.files import discard, scratch, settings, shuffles_dropped

FACT_KEY = ["chain", "tx_hash", "log_index"]


def first_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in `order`, whatever order rows arrive in."""
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__nth = 1").drop("__nth")


def least_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """first_wins for ascending columns, as an aggregate: copies of a key within a task are one row before they are shuffled."""
    rest = [c for c in rows.columns if c not in key]
    least = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("__row")
    return rows.groupBy(*key).agg(least).select(*[c if c in key else F.col(f"__row.{c}").alias(c) for c in rows.columns])


def newest_wins(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """A new row replaces an old one only if its version is strictly higher."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return first_wins(both, key, [F.col(version).desc(), F.col("__new")]).drop("__new")


def confident_wins(old: DataFrame, new: DataFrame, key: list[str], confidence: str, expired: Column | None = None) -> DataFrame:
    """A new row replaces an old one of no higher confidence, or one that has expired."""
    held = F.col(confidence) if expired is None else F.when(expired, F.lit(-1.0)).otherwise(F.col(confidence))
    both = old.withColumn("__new", F.lit(0)).withColumn("__c", held).unionByName(new.withColumn("__new", F.lit(1)).withColumn("__c", F.col(confidence)))
    return first_wins(both, key, [F.col("__c").desc(), F.col("__new").desc()]).drop("__new", "__c")


def additive(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Sums and counts add up, the times widen; the first time is a true minimum."""
    return old.unionByName(new).groupBy(*key).agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"))


VERDICT_KEY = ["chain", "token", "detector_id"]


def cached_verdicts(cache: DataFrame, asked: DataFrame) -> DataFrame:
    """Stored verdicts of the keys that are asked for, expired ones too: their `expires_at` tells the caller."""
    return cache.join(asked.select(*VERDICT_KEY), VERDICT_KEY, "left_semi")


def with_verdicts(cache: DataFrame, new: DataFrame) -> DataFrame:
    """A new verdict replaces the stored one of its key, whatever its confidence; of several new ones the last cached stays."""
    last = first_wins(new, VERDICT_KEY, [F.col("cached_at").desc(), F.col("expires_at").desc(), F.col("confidence").desc()])
    return cache.join(last.select(*VERDICT_KEY), VERDICT_KEY, "left_anti").unionByName(last)


def without_expired(cache: DataFrame, now: Column) -> DataFrame:
    """The cache after a purge; a verdict goes once `now` is past its time, and one without a time stays."""
    return cache.where(~F.coalesce(F.col("expires_at") < now, F.lit(False)))


#: Heights of a bucket in which rows meet the reorgs that could undo them.
HEIGHTS = 4096


def reorg_steps(reorgs: DataFrame, buckets: DataFrame) -> DataFrame:
    """(chain, bucket, carried, steps): when the last reorg from below the bucket was seen, and the reorgs that begin within it, at most one per
    height. `buckets` are those (chain, bucket) that are asked for; the running maximum goes over one row per bucket."""
    latest = reorgs.where("reorg_at IS NOT NULL").groupBy("chain", "from_height").agg(F.max("reorg_at").alias("reorg_at"))
    within = latest.groupBy("chain", F.floor(F.col("from_height") / HEIGHTS).alias("bucket")).agg(F.max("reorg_at").alias("top"), F.collect_list(F.struct("from_height", "reorg_at")).alias("steps"))
    every = buckets.join(within, ["chain", "bucket"], "full")
    before = Window.partitionBy("chain").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return every.select("chain", "bucket", F.max("top").over(before).alias("carried"), "steps").where("carried IS NOT NULL OR steps IS NOT NULL")


def without_reorged(rows: DataFrame, reorgs: DataFrame, seen: str = "seen_at") -> DataFrame:
    """Rows that no later reorg at or below their height has undone; rows without a chain, height or time stay.

    Reorgs of a chain are a step function: the later a height, the more of them void it, so only the last that was seen counts. Rows
    meet it by chain and bucket of heights, never by the chain alone."""
    named = rows.withColumn("__bucket", F.floor(F.col("block_height") / HEIGHTS))
    asked = named.select("chain", F.col("__bucket").alias("bucket")).where("bucket IS NOT NULL").distinct()
    steps = reorg_steps(reorgs, asked).select(F.col("chain").alias("__chain"), F.col("bucket").alias("__at"), F.col("carried").alias("__carried"), F.col("steps").alias("__steps"))
    met = named.join(steps, (F.col("chain") == F.col("__chain")) & (F.col("__bucket") == F.col("__at")), "left")
    inside = F.array_max(F.transform(F.filter("__steps", lambda s: s["from_height"] <= F.col("block_height")), lambda s: s["reorg_at"]))
    undone = F.coalesce(F.greatest("__carried", inside) > F.col(seen), F.lit(False))
    return met.where(~undone).select(*rows.columns)


def clustered(df: DataFrame, partition: list[str], files: int = 8) -> DataFrame:
    """df so that a partition value is written by at most `files` tasks: a hot chain-day is not one task's, and a small one is few files."""
    told = [f.name for f in df.schema if f.name not in partition and f.dataType.typeName() != "map"]
    return df.repartition(*partition, F.pmod(F.xxhash64(*told), F.lit(files)) if told else F.lit(0))


def append(df: DataFrame, path: str, partition: list[str], files: int = 8) -> None:
    """Appends to a table partitioned by chain and day."""
    clustered(df, partition, files).write.mode("append").partitionBy(*partition).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition: list[str], files: int = 8) -> None:
    """Replaces only the partitions that df holds, so a repeated batch changes nothing."""
    clustered(df, partition, files).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def replace_as_it_lies(df: DataFrame, path: str, partition: list[str]) -> None:
    """overwrite_partitions for rows of a folder that is clustered by `partition` already: a task writes the files that it reads, without a shuffle, and
    without a sort as long as they are of a few partitions."""
    with settings(df.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": "32"}):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def inserted_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batch twice, once in other partitions: every key is there once.

    Disk holds the shuffles of one step at a time: rows are deduplicated by one job and clustered by another. The batch lies in the table's
    partitions, so both inserts write it as it lies."""
    order, partition = ["t", "token", "from_address", "to_address", "amount", "cents", "flag", "status"], ["chain", "year"]
    single, batch, path = (scratch(spark, name) for name in ("single", "batch", "transfers"))
    with shuffles_dropped(spark):
        rows = Tables(spark, sf_dir)("transfers")
        both = rows.withColumn("__copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("__copy")
        once = least_wins(both, FACT_KEY, order).withColumn("year", F.floor(F.col("block_height") / 365))
        once.write.option("compression", "zstd").parquet(single)
        overwrite_partitions(spark.read.schema(once.schema).parquet(single), batch, partition)
        discard(spark, single)
        for _ in range(2):
            replace_as_it_lies(spark.read.schema(once.schema).parquet(batch), path, partition)
        discard(spark, batch)
    return spark.read.parquet(path).select("chain", "tx_hash", "log_index", "token", "from_address", "amount", F.col("t"))


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "anomalies")
    append(Tables(spark, sf_dir)("anomalies").withColumn("emitted_by", F.lit("batch")), path, ["detector_id"])
    return spark.read.parquet(path).groupBy("detector_id", "emitted_by").agg(F.count(F.lit(1)).alias("n"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    new = t("balances").select("chain", "token", "holder", "block_height", F.col("balance").alias("amount"))
    old = t("balances").select("chain", "token", "holder", (F.col("block_height") + F.when(F.col("balance") % 2 == 0, 1).otherwise(-1)).alias("block_height"), F.col("prior_balance").alias("amount"))
    return newest_wins(old, new, ["chain", "token", "holder"], "block_height")


def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir)("sol_edges").select("chain", "funder", "wallet", "total", "n", "first_t", "last_t")
    return additive(e.where("first_t % 2 = 0"), e, ["chain", "funder", "wallet"])


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir)("classes").select("address", "kind", F.round("confidence", 4).alias("confidence"), "age_days")
    new = c.select("address", F.lit("liquid").alias("kind"), F.lit(0.75).alias("confidence"), F.lit(0).cast("long").alias("age_days"))
    return confident_wins(c, new, ["address"], "confidence", F.col("age_days") > 30)


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir)("classes").select("address", "kind", F.round("confidence", 4).alias("confidence"))
    return confident_wins(c, c.select("address", F.lit("vesting_contract").alias("kind"), F.lit(0.9).alias("confidence")), ["address"], "confidence")


def reorged(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Tables(spark, sf_dir)("swaps").withColumn("seen_at", F.col("t"))
    reorgs = spark.createDataFrame([("solana", (SWAPS_AS_OF - 5 * DAY) // 60, SWAPS_AS_OF - 4 * DAY), ("ethereum", 0, SWAPS_AS_OF)], "chain string, from_height long, reorg_at long")
    return without_reorged(s, reorgs).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


W_QUERIES = {
    "w01_idempotent_insert": (inserted_twice, lambda d: "SELECT chain, tx_hash, log_index, token, from_address, amount, t FROM (SELECT *, row_number() OVER (PARTITION BY chain, tx_hash, log_index ORDER BY t, token, from_address, to_address, amount, cents, flag, status) AS nth FROM {transfers}) AS x WHERE nth = 1"),
    "w02_snapshot_upsert": (snapshots, lambda d: "SELECT chain, token, holder, CASE WHEN balance % 2 = 0 THEN block_height + 1 ELSE block_height END AS block_height, CASE WHEN balance % 2 = 0 THEN prior_balance ELSE balance END AS amount FROM {balances}"),
    "w03_append": (appended, lambda d: "SELECT detector_id, 'batch' AS emitted_by, count(*) AS n FROM {anomalies} GROUP BY detector_id"),
    "w04_additive_edges": (merged_edges, lambda d: "SELECT chain, funder, wallet, CAST(CASE WHEN first_t % 2 = 0 THEN 2 * total ELSE total END AS BIGINT) AS total, CAST(CASE WHEN first_t % 2 = 0 THEN 2 * n ELSE n END AS BIGINT) AS n, first_t, last_t FROM {sol_edges}"),
    "w05_label_upsert": (labels, lambda d: "SELECT address, CASE WHEN age_days > 30 OR round(confidence, 4) <= 0.75 THEN 'liquid' ELSE kind END AS kind, CAST(CASE WHEN age_days > 30 OR round(confidence, 4) <= 0.75 THEN 0.75 ELSE round(confidence, 4) END AS DOUBLE) AS confidence, CASE WHEN age_days > 30 OR round(confidence, 4) <= 0.75 THEN 0 ELSE age_days END AS age_days FROM {classes}"),
    "w06_class_upsert": (classifications, lambda d: "SELECT address, CASE WHEN round(confidence, 4) <= 0.9 THEN 'vesting_contract' ELSE kind END AS kind, CAST(CASE WHEN round(confidence, 4) <= 0.9 THEN 0.9 ELSE round(confidence, 4) END AS DOUBLE) AS confidence FROM {classes}"),
    "w12_reorg": (reorged, lambda d: f"SELECT token, count(*) AS n FROM {{swaps}} WHERE NOT (block_height >= {(SWAPS_AS_OF - 5 * DAY) // 60} AND t < {SWAPS_AS_OF - 4 * DAY}) GROUP BY token"),
}


def latest(d: Dialect, keys: str, order: str, table: str, columns: str) -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS nth FROM {{{table}}}) AS x WHERE nth = 1"


TEXTS = {
    "w07_typed_edges": lambda d: "SELECT DISTINCT authority AS src, mint AS dst, kind FROM {instructions} WHERE kind <> 'harvest'",
    "w08_cluster_upsert": lambda d: latest(d, "chain, wallet, cluster_id", "confidence DESC, size DESC", "members", "chain, wallet, cluster_id, confidence"),
    "w09_latest_report": lambda d: latest(d, "chain, token", "t DESC, id DESC", "anomalies", "chain, token, id, t"),
    "w10_verdict_cache": lambda d: f"SELECT token, detector_id, count(*) AS live FROM {{anomalies}} WHERE t <= {SWAPS_AS_OF} AND t + 86400 > {SWAPS_AS_OF} GROUP BY token, detector_id",
    "w11_corpus_upsert": lambda d: latest(d, "wallet, token", "sell_t DESC, sell_seq DESC, buy_t DESC", "trips", "wallet, token, sell_t, sell_seq"),
    "w13_json_merge": lambda d: f"SELECT user_id, max({d.json_int('props', 'k')}) AS k_max, count(*) AS merged FROM {{events}} GROUP BY user_id",
}
