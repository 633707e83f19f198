"""File sources with explicit schemas, and small registries that are broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = [("chain", "string"), ("block_time", "timestamp"), ("block_height", "bigint"), ("tx_hash", "string"), ("log_index", "int")]
#: Canonical tables: name -> columns.
SCHEMAS = {
    "transfers": [*KEY, ("token", "string"), ("from_address", "string"), ("to_address", "string"), ("amount_raw", "decimal(38,0)"), ("decimals", "smallint"), ("is_mint", "boolean"), ("is_burn", "boolean")],
    "swaps": [*KEY, ("pool", "string"), ("dex", "string"), ("sender", "string"), ("token_in", "string"), ("token_out", "string"), ("amount_in_raw", "decimal(38,0)"), ("amount_out_raw", "decimal(38,0)"), ("usd_value", "decimal(20,6)")],
    "pool_events": [*KEY, ("pool", "string"), ("dex", "string"), ("event_kind", "string"), ("actor", "string"), ("amount0_raw", "decimal(38,0)"), ("amount1_raw", "decimal(38,0)"), ("lp_tokens", "decimal(38,0)"), ("token0", "string"), ("token1", "string")],
    "permit2_events": [*KEY, ("event_kind", "string"), ("owner", "string"), ("token", "string"), ("spender", "string"), ("amount_raw", "string"), ("is_max_approval", "boolean")],
    "anomaly_events": [("chain", "string"), ("token", "string"), ("detector_id", "string"), ("observed_at", "timestamp"), ("confidence", "double"), ("severity", "string"), ("metrics", "map<string,double>"), ("emitted_by", "string")],
}

#: The longest list that is broadcast.
REGISTRY_ROWS = 100_000


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in SCHEMAS[name]))


def read_events(spark: SparkSession, path: str, name: str, **where) -> DataFrame:
    """A table with its schema given; chain and day predicates prune partitions."""
    df = spark.read.schema(schema(name)).parquet(path)
    for column, value in where.items():
        df = df.where(F.col(column) == value)
    return df


def stream_events(spark: SparkSession, path: str, name: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema(name)).option("maxFilesPerTrigger", files).parquet(path)


def registry(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A list (known bridges, drainers, lockers, exchange wallets), to be broadcast unless it is long."""
    known = spark.createDataFrame(rows, columns)
    return F.broadcast(known) if len(rows) <= REGISTRY_ROWS else known


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only on a local master."""
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="tidewatch_")
    return there.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_folder(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that nothing will read again."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def settings(spark: SparkSession, new: dict[str, str]) -> Iterator[None]:
    """Settings of the session while something runs; its own come back after it."""
    old = {name: spark.conf.get(name, None) for name in new}
    for name, value in new.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def shuffles_dropped(spark: SparkSession):
    """What is planned and run within drops its shuffle files once it ends, not when the driver happens to collect garbage, so disk holds those of
    the jobs that run."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


#: Adapters by name: how a chain's events are read; new ones are added with `adapter`.
ADAPTERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def adapter(name: str):
    def add(f):
        ADAPTERS[name] = f
        return f

    return add


@adapter("parquet")
def parquet_transfers(spark: SparkSession, path: str) -> DataFrame:
    return read_events(spark, path, "transfers")
