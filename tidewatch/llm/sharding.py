"""Sharding by jump consistent hashing, with DataFrame functions only.

A key's shard is found by jumping: from shard b the next jump goes to floor((b + 1) / u), u uniform in (0, 1] and
drawn from the key and the number of the jump, until it passes the last shard. Each jump goes up, so as many steps as
there are shards always suffice and no ring table is kept. One more shard takes only rows whose next jump lands on it.

Slots are gapless ranks made in two levels: a rank in one of many even parts of a shard, plus the sizes of the
parts before it. Rows are dealt into parts by their number, so even rows that repeat one id are spread.

Null text has no bytes; null ids all go to one shard; repeated rows and rows that tie in everything get slots of their own, in
reading order; a very long text only counts by its size and checksum; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime as rt

SHARDS = 40
ROW_BYTES = 16


def _draw(key: Column, step: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(key, step), 11) + 1) / F.lit(float(1 << 53))


def jump(key: Column, shards: int) -> Column:
    """struct(b: the shard among `shards`, j: where the next jump would go, at least `shards`)."""
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    step = lambda acc, i: F.when(acc["j"] < shards, F.struct(acc["j"].alias("b"), F.floor((acc["j"] + 1) / _draw(key, i)).cast("long").alias("j"))).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    parts = max(16, rt.partitions(spark))
    text = rt.text_of(F.col(text_col))
    rows = docs.select(rt.named(id_col).cast("long").alias("doc_id"), rt.text_of(rt.named(text_col)).alias("text"), F.monotonically_increasing_id().alias("no"))
    rows = rows.select("no", "doc_id", (F.octet_length("text").cast("long") + ROW_BYTES).alias("size"), F.crc32("text").alias("text_crc32"), jump(F.col("doc_id"), shards).alias("to"))
    grown = F.when(F.col("to.j") == shards, F.lit(shards)).otherwise(F.col("to.b")).cast("int")
    part = F.pmod(F.xxhash64("no"), F.lit(parts)).cast("int")
    rows = rt.materialise(rows.select("no", "doc_id", "size", "text_crc32", F.col("to.b").cast("int").alias("shard"), grown.alias("grown_shard"), part.alias("part")), "sharded")
    sizes = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("shard", "part", before.cast("long").alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "no"))
    rows = rows.withColumn("rank", rank - 1).join(sizes, ["shard", "part"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("rank")).cast("long").alias("slot"), "grown_shard")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(rt.read_table(spark, sf_dir, "documents"))
