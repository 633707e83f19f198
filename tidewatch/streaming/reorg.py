"""Reorgs in a stream (T4): flush, delete at or above a height, and rewind, as one commit per micro-batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sinks import without_reorged
from ..plans.dialect import Dialect
from ..sources.chain import FOREVER, backfill, publish, subscribe
from ..sources.commits import CommitTable
from .jobs import KINDS, drain, folder

MARKER = "reorg"


def apply_batch(table: CommitTable, writer: str, batch: DataFrame, number: int) -> None:
    """Brings a micro-batch of events and reorg markers (kind `reorg`, with the height from which blocks are void) into the table.

    Events of the batch that a later marker voids are left out, the others are flushed to a folder. Folders of the table with a
    height at or above a chain's lowest marker are written anew without those rows. Both, with the position that is reached and
    the height to which each chain is rewound, become visible by one commit, which also names the batch: a batch that is
    repeated after a restart changes nothing, and one that was interrupted begins again from the state before it."""
    state = table.state()
    if state.batches.get(writer, -1) >= number:
        return
    spark = table.spark
    batch = batch.persist()
    try:
        each = batch.groupBy("chain").agg(F.max("position").alias("position"), F.max("block_height").alias("height"), F.min(F.when(F.col("kind") == MARKER, F.col("block_height"))).alias("void")).collect()  # one row per chain
        markers = batch.where(F.col("kind") == MARKER).select("chain", F.col("block_height").alias("from_height"), F.col("position").alias("reorg_at"))
        fresh = table.stage(without_reorged(batch.where(F.col("kind") != MARKER), markers, "position"))
    finally:
        batch.unpersist()
    void = {r.chain: r.void for r in each if r.void is not None}
    hit = [p.folder for p in state.parts.values() if any(c in p.heights and p.heights[c][1] >= h for c, h in void.items())]
    rewritten = None
    if hit:
        undone = spark.createDataFrame(list(void.items()), "chain string, from_height long")
        rows = table.read(state, hit)
        kept = rows.join(F.broadcast(undone), "chain", "left").where(F.coalesce(F.col("block_height") < F.col("from_height"), F.lit(True)))
        rewritten = table.stage(kept.select(*rows.columns))
    reached = {r.chain: {"position": r.position, "height": r.void - 1 if r.void is not None else r.height} for r in each}
    table.commit(state, [fresh, rewritten], hit, {writer: number}, reached)


def follow(spark: SparkSession, events: DataFrame, table: CommitTable, at: str) -> None:
    """Runs a stream of events into the table, from its checkpoint, to the end of what there is."""
    drain(events, lambda df, n: apply_batch(table, at, df, n), at)


def archived(spark: SparkSession, sf_dir: str, at: str) -> CommitTable:
    """The event table as the archive of three chains; some errors are markers of reorgs, up to an hour and a half deep."""
    kind = F.lit("pool_event")
    for event, name in KINDS.items():
        kind = F.when(F.col("event_type") == event, MARKER if name == "reorg_marker" else name).otherwise(kind)
    chain = F.element_at(F.array(*[F.lit(c) for c in ("solana", "ethereum", "base")]), (F.col("event_id") % 3 + 1).cast("int"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value", kind.alias("kind"), chain.alias("chain"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    e = e.where((F.col("kind") != MARKER) | (F.col("event_id") % 50 == 0))
    height = F.floor(F.col("t") / 60) - F.when(F.col("kind") == MARKER, F.col("event_id") % 90).otherwise(0)
    e = e.select("chain", height.cast("long").alias("block_height"), F.col("event_id").alias("position"), "kind", F.concat(F.lit("tx"), F.col("event_id")).alias("tx_hash"), F.concat(F.lit("tok"), F.col("event_id") % 4).alias("token"), F.concat(F.lit("u"), F.col("user_id")).alias("address"), "t", F.round(F.col("value") * 100).cast("long").alias("cents"))
    archive = CommitTable(spark, f"{at}/archive")
    half = e.agg(F.expr("percentile_approx(position, 0.5)")).first()[0] or 0
    for part in (e.where(F.col("position") <= half), e.where(F.col("position") > half)):
        publish(archive, part)
    return archive


def reorged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: what a stream with reorgs leaves, by chain and token."""
    at = folder(spark, "reorg")
    archive, table = archived(spark, sf_dir, at), CommitTable(spark, f"{at}/table")
    follow(spark, subscribe(spark, archive.path), table, f"{at}/run")
    rows = table.read()
    return rows.groupBy("chain", "token").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.max("block_height").alias("tip"), F.max("position").alias("last"))


def chain_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backfill of the first commit's blocks by batch, then the tail behind it as a stream: every event once."""
    at = folder(spark, "chain")
    archive = archived(spark, sf_dir, at)
    first = min(archive.state().parts.values(), key=lambda p: p.first)
    old = backfill(spark, archive.path, -FOREVER, FOREVER).where(F.col("position") <= first.last).where("kind IN ('swap', 'pool_event')")
    out = f"{at}/tail-{uuid.uuid4().hex}"
    tail = subscribe(spark, archive.path, first.last, ("swap", "pool_event"))
    drain(tail, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), f"{at}/run")
    rows = old.unionByName(spark.read.schema(old.schema).parquet(f"{out}/*"))
    return rows.groupBy("chain", "kind", "token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("ids"), F.sum("cents").alias("cents"), F.max("block_height").alias("tip"))


def _archive_text(d: Dialect) -> str:
    t = d.epoch("ts")
    kind = "CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN 'swap' WHEN event_type = 'error' THEN 'reorg' ELSE 'pool_event' END"
    return f"""SELECT CASE event_id % 3 WHEN 0 THEN 'solana' WHEN 1 THEN 'ethereum' ELSE 'base' END AS chain, event_id AS position, {kind} AS kind, concat('tok', CAST(event_id % 4 AS STRING)) AS token, CAST(round(value * 100) AS BIGINT) AS cents,
      {d.idiv(t, "60")} - CASE WHEN event_type = 'error' THEN event_id % 90 ELSE 0 END AS block_height FROM {{events}} WHERE event_type <> 'error' OR event_id % 50 = 0"""


STREAMS = {
    "s01_chain_source": (chain_source, lambda d: f"SELECT chain, kind, token, count(*) AS n, count(DISTINCT position) AS ids, CAST(sum(cents) AS BIGINT) AS cents, max(block_height) AS tip FROM ({_archive_text(d)}) AS a WHERE kind <> 'reorg' GROUP BY chain, kind, token"),
    "t04_reorg_stream": (
        reorged_stream,
        lambda d: f"""WITH a AS ({_archive_text(d)}) SELECT chain, token, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, max(block_height) AS tip, max(position) AS last FROM a
      WHERE kind <> 'reorg' AND NOT EXISTS (SELECT 1 FROM a AS r WHERE r.kind = 'reorg' AND r.chain = a.chain AND r.block_height <= a.block_height AND r.position > a.position) GROUP BY chain, token""",
    ),
}
