"""Transfer rings at scale (G7): edges are trimmed, cycles start at their busiest wallet, and components can cap them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.dialect import Tables

GROUP = ["token", "bucket"]
#: Rounds of trimming before cycles are looked for; each only saves work.
TRIMS = 3


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder."""
    from ..sources.files import shared_folder

    path = f"{shared_folder(df.sparkSession)}/tidewatch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trimmed(edges: DataFrame, group: list[str], rounds: int = TRIMS) -> DataFrame:
    """Edges without those that begin where none ends or end where none begins: they are on no cycle."""
    for _ in range(rounds):
        begins = edges.select(*group, F.col("src").alias("dst")).distinct()
        ends = edges.select(*group, F.col("dst").alias("src")).distinct()
        edges = edges.join(begins, [*group, "dst"], "left_semi").join(ends, [*group, "src"], "left_semi").select(*edges.columns)
    return edges


def by_degree(edges: DataFrame, group: list[str]) -> DataFrame:
    """Edges with the places of both ends in the order of degrees, the busiest first: from and to, structs that compare."""
    ends = edges.select(*group, F.explode(F.array("src", "dst")).alias("node"))
    degree = ends.groupBy(*group, "node").agg((-F.count(F.lit(1))).alias("busy"))
    for side, name in (("src", "from"), ("dst", "to")):
        edges = edges.join(degree.withColumnRenamed("node", side), [*group, side]).withColumn(name, F.struct("busy", side)).drop("busy")
    return edges


def rings(edges: DataFrame, longest: int = 5, shortest: int = 3, cap: int | None = None) -> DataFrame:
    """token, bucket, size, ring, bottleneck, span of the elementary cycles of `shortest` to `longest` wallets, as `graph.rings` has them.

    A cycle is found once, from its busiest wallet, along paths of less busy ones: a wallet with many edges is joined through only by
    paths that come from a still busier one, and closes them by a look-up. A path of k wallets makes the one of k + 1, so all
    sizes share their joins. With `cap`, at most so many cycles stay of a strongly connected component, the first by size and name."""
    known = kept(by_degree(trimmed(edges, GROUP), GROUP).select(*GROUP, "src", "dst", "from", "to", "cents", "first_t", "last_t"), "ring-edges")
    step = known.select(*GROUP, F.col("src").alias("at"), F.col("dst").alias("next"), F.col("to").alias("next_to"), *[F.col(c).alias(f"n_{c}") for c in ("cents", "first_t", "last_t")])
    totals = ["cents", "first_t", "last_t"]
    wider: list[Column] = [F.least("cents", "n_cents").alias("cents"), F.least("first_t", "n_first_t").alias("first_t"), F.greatest("last_t", "n_last_t").alias("last_t")]
    paths = known.where("from < to").select(*GROUP, F.col("from").alias("start"), F.array("src", "dst").alias("nodes"), F.col("dst").alias("at"), *totals)
    found = None
    for size in range(2, longest + 1):
        if size >= shortest:
            closing = step.withColumnRenamed("next", "first").drop("next_to")
            closed = paths.withColumn("first", F.col("nodes")[0]).join(closing, [*GROUP, "at", "first"]).select(*GROUP, F.lit(size).alias("size"), "nodes", *wider)
            found = closed if found is None else found.unionByName(closed)
        if size < longest:
            grown = paths.join(step, [*GROUP, "at"]).where((F.col("next_to") > F.col("start")) & ~F.array_contains("nodes", F.col("next")))
            paths = grown.select(*GROUP, "start", F.concat("nodes", F.array("next")).alias("nodes"), F.col("next").alias("at"), *wider)
            if size >= 3:  # also read by the next size
                paths = kept(paths, "ring-paths")
    place = F.array_position("nodes", F.array_min("nodes")).cast("int")
    turned = F.concat(F.slice("nodes", place, F.col("size")), F.slice("nodes", F.lit(1), place - 1))
    rows = found.select(*GROUP, "size", F.concat_ws(">", turned).alias("ring"), F.col("cents").alias("bottleneck"), (F.col("last_t") - F.col("first_t")).alias("span"), F.col("nodes")[0].alias("node"))
    if cap is not None:
        rows = rows.join(strong_components(known, GROUP), [*GROUP, "node"])
        nth = F.row_number().over(Window.partitionBy(*GROUP, "component").orderBy("size", "ring"))
        rows = rows.withColumn("nth", nth).where(F.col("nth") <= cap)
    return rows.select(*GROUP, "size", "ring", "bottleneck", "span")


def strong_components(edges: DataFrame, group: list[str], rounds: int = 200) -> DataFrame:
    """(group, node, component) of strongly connected components of two nodes or more; a component is named by its greatest node.

    Forward-backward colouring: the greatest name that reaches a node is its colour, and what reaches that name within its colour is
    its component. Components leave the graph, the rest is trimmed, and so on. Each round is written, never collected."""
    left = kept(trimmed(edges.where("src <> dst").select(*group, "src", "dst").distinct(), group), "scc")
    out = left.select(*group, F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    for _ in range(rounds):
        if left.isEmpty():
            return out
        colours = left.select(*group, F.col("dst").alias("node"), F.col("dst").alias("colour")).distinct()
        colours = _settled(colours, lambda c, some=left: c.unionByName(some.join(c.withColumnRenamed("node", "src"), [*group, "src"]).select(*group, F.col("dst").alias("node"), "colour")).groupBy(*group, "node").agg(F.max("colour").alias("colour")), "colour", rounds)
        own = left.join(colours.withColumnRenamed("node", "src"), [*group, "src"]).join(colours.select(*group, F.col("node").alias("dst"), F.col("colour").alias("to")), [*group, "dst"]).where("colour = to")
        own = kept(own.select(*group, "src", "dst", "colour"), "scc")
        reached = colours.where("node = colour")
        reached = _settled(reached, lambda r, some=own: r.unionByName(some.join(r.select(*group, F.col("node").alias("dst"), "colour"), [*group, "dst", "colour"]).select(*group, F.col("src").alias("node"), "colour")).distinct(), "node", rounds)
        sizes = Window.partitionBy(*group, "colour")
        some = reached.withColumn("n", F.count(F.lit(1)).over(sizes)).where("n > 1").select(*group, "node", F.col("colour").alias("component"))
        out = kept(out.unionByName(some), "scc")
        gone = reached.select(*group, "node")
        left = left.join(gone.withColumnRenamed("node", "src"), [*group, "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), [*group, "dst"], "left_anti")
        left = kept(trimmed(left.select(*group, "src", "dst"), group), "scc")
    raise RuntimeError("components did not settle")


def _settled(rows: DataFrame, step, column: str, rounds: int) -> DataFrame:
    """rows after as many steps as change them; two steps a round."""
    mark = None
    for _ in range(rounds):
        rows = kept(step(step(rows)), "scc")
        now = tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first())
        if now == mark:
            return rows
        mark = now
    raise RuntimeError(f"{column} did not settle")


def busiest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rings(Tables(spark, sf_dir)("trade_edges"))
