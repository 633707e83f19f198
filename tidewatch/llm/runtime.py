"""Shared plumbing of the training-data operators: shared storage, row numbers, skew-safe joins, components, Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than a quarter of an even partition, or more than one row in HOT_KEYS where there are few partitions.
HOT_KEYS = 1000

_WRITTEN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only a local master, as in tests, gets a temporary one where none is set."""
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch_"))
    return sc.getCheckpointDir().rstrip("/")


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the application's own folder in the shared one, which goes when the application ends."""
    root = f"{shared_dir(spark)}/tidewatch/{spark.sparkContext.applicationId}"
    fs, at = _store(spark, root)
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that nothing will read again."""
    for df in frames:
        path = _WRITTEN.pop(df, None)
        if path:
            fs, at = _store(df.sparkSession, path)
            fs.delete(at, True)


def text_of(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def named(column: str) -> Column:
    """The column of that very name, whatever characters are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text (never null) and row, a struct of all columns of docs: no name of theirs can meet one of an operator's."""
    return docs.select(named(id_col).cast("long").alias("id"), text_of(named(text_col)).alias("text"), F.struct(*[named(c) for c in docs.columns]).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from `row`, in their order."""
    return rows.select("row.*") if docs.columns else rows


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_rows(spark: SparkSession, total: int) -> int:
    """A key with more of `total` rows than this is hot; max(HOT_KEYS, 4 * partitions) keys at most can be."""
    return max(1, total // max(HOT_KEYS, 4 * partitions(spark)))


def lookup(left: DataFrame, right: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """left joined to right, which has one row per key and in `size` how many rows of left have it. Hot keys, whose number is
    bounded by hot_rows(), are broadcast; no other key can fill a task. Keys that right does not have get nulls."""
    cols = [c for c in right.columns if c != key]
    hot = F.col(size) > hot_rows(left.sparkSession, total)
    few = right.where(hot).select(F.col(key), F.struct(*cols).alias("__hot"))
    cold = right.where(~hot).select(F.col(key).cast("string").alias("__key"), F.struct(*cols).alias("__cold"))
    spread = F.concat(F.lit("~"), F.xxhash64(*left.columns).cast("string"))
    out = left.join(F.broadcast(few), key, "left").withColumn("__key", F.when(F.col("__hot").isNull(), F.col(key).cast("string")).otherwise(spread))
    out = out.join(cold, "__key", "left").withColumn("__got", F.coalesce("__hot", "__cold"))
    return out.select(*left.columns, *[F.col("__got")[c].alias(c) for c in cols])


def meet(left: DataFrame, right: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """The inner join of a materialised left with right, which has one row per key and in `size` how many rows of left have it:
    hot keys, whose number is bounded, against a broadcast, the others by a shuffle on the bare keys."""
    hot = F.col(size) > hot_rows(left.sparkSession, total)
    few = F.broadcast(right.where(hot))
    return left.join(few, keys).unionByName(left.join(few.select(*keys), keys, "left_anti").join(right.where(~hot), keys))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of connected components over (a, b) edges; the label is the least node. Alternating large and small stars: each
    round rewrites edges towards the least neighbour and is written to the shared folder, never collected; graphs of any size
    go the same way. Hubs hold many edges: their few rows are broadcast by lookup(), and their edges stay spread."""
    now = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        got = now.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if (got.n, got.h) == mark or not got.n:
            return now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
        mark = (got.n, got.h)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = materialise(lookup(both, least, "a", "n", 2 * got.n).where("b > a").select(F.col("m").alias("a"), F.col("b").alias("b")).where("a <> b").distinct(), "edges")
        small = large.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = lookup(large, small, "b", "n", got.n)
        old, now = now, materialise(joined.select(F.array(F.struct("m", "a"), F.struct("m", F.col("b").alias("a"))).alias("e")).select(F.inline("e")).select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").distinct(), "edges")
        discard(old, large)
    raise RuntimeError("components did not settle")


def local_path(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def open_store(uri: str):
    """(filesystem, path) by pyarrow for a folder of the shared store."""
    from pyarrow import fs

    at = local_path(uri)
    if at is not None:
        return fs.LocalFileSystem(), at
    return fs.FileSystem.from_uri(uri)


def task_key() -> str:
    """A name that no other attempt of any task has."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    part = ctx.partitionId() if ctx else 0
    return f"{part:06d}-{os.getpid()}-{uuid.uuid4().hex[:12]}"


class Memo(dict):
    """word bytes -> 64-bit hash, bounded: cleared when it holds too many words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: bytes, memo: Memo):
    """(words, their hashes): bytes.split() splits at exactly [\\x20\\x09-\\x0D]."""
    import numpy as np

    words = text.split()
    return words, np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix(h):
    """Finaliser of splitmix64 over an array."""
    import numpy as np

    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(h, k: int):
    """Hash of every run of k consecutive word hashes, by doubling: O(log k) passes."""
    import numpy as np

    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, at, part, width = None, 0, k, h, 1
    while at:
        if at & 1:
            piece = part[done : done + n]
            out = mix(piece) if out is None else mix(out * np.uint64(0x9E3779B97F4A7C15) + piece + np.uint64(width))
            done += width
        at >>= 1
        if at:
            part = mix(part[:-width] * np.uint64(0xD6E8FEB86659FD93) + part[width:] + np.uint64(width))
            width *= 2
    return out
