"""Exact deduplication by skew-safe combining.

Every row is numbered and its digest taken once. Rows are combined in each map task; those of digests that hold more than
rt.hot_rows() rows are merged in salted groups first, and the salt winners are then combined globally. Every stage groups by
digest *and* full content, so two texts that share a digest are never taken for one.

Null or empty text counts as the empty text; a null id loses every tie, and of rows that repeat an id and a text length the
first in reading order stays. A very long text is one row and must fit a task. An empty table gives an empty result. Other
columns, whatever their names, are ignored, or kept by keep_first().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime as rt

#: Characters that do not count, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def sha256(col: Column) -> Column:
    return F.sha2(col, 256)


def _plain(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def _rank() -> Column:
    """The row with the most code points, then the smallest id (null ones last), then the first row has the least of these."""
    return F.struct((-F.col("n")).alias("less"), F.col("id").isNull().alias("none"), "id", "no").alias("best")


def _combined(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("best").alias("best"), F.sum("size").alias("size"))


def _numbered(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], keep: str) -> DataFrame:
    """no, id, n, d (digest), x (a second hash of the content) and the column `keep`, written once."""
    rows = rt.packed(docs, id_col, text_col)
    plain = rows.select("id", "text", "row", _plain(F.col("text")).alias("plain"), F.monotonically_increasing_id().alias("no"))
    told = plain.select("no", "id", F.char_length("text").cast("long").alias("n"), digest(F.col("plain")).alias("d"), F.xxhash64("plain").alias("x"), keep)
    return rt.materialise(told, "numbered")


def winners(rows: DataFrame, plain: Column) -> DataFrame:
    """(d, x, best, size) of every content among rows (no, id, n, d, x); `plain` is its content."""
    spark = rows.sparkSession
    total = rows.count()
    hot = rows.groupBy("d").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > max(1, rt.hot_rows(spark, total))).select("d", F.lit(True).alias("hot"))
    marked = rows.select("no", "id", "n", "d", "x", plain.alias("plain")).join(F.broadcast(hot), "d", "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("no"), F.lit(rt.partitions(spark)))).otherwise(F.lit(0)).alias("salt")
    each = marked.select("d", "x", "plain", "hot", salt, _rank(), F.lit(1).cast("long").alias("size"))
    # winners of cold digests are final and go on without their content; those of hot ones meet once more
    salted = _combined(each, "d", "x", "plain", "hot", "salt").select("d", "x", "hot", F.when(F.col("hot"), F.col("plain")).alias("plain"), "best", "size")
    salted = rt.materialise(salted, "salted")
    last = _combined(salted.where("hot"), "d", "x", "plain").select("d", "x", "best", "size")
    return rt.materialise(salted.where("hot IS NULL").select("d", "x", "best", "size").unionByName(last), "winners")


def _met(rows: DataFrame, plain: Column) -> DataFrame:
    """no, id, d, and best and size of the content of each row."""
    won = winners(rows, plain)
    shared = rt.materialise(won.groupBy("d", "x").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("d", "x"), "shared")
    slim = rows.select("no", "id", "d", F.concat_ws(":", "d", F.hex("x")).alias("key"), "x")
    single = won.join(shared, ["d", "x"], "left_anti").select(F.concat_ws(":", "d", F.hex("x")).alias("key"), "best", "size")
    out = rt.lookup(slim, single, "key", "size", rows.count()).select("no", "id", "d", "best", "size")
    if shared.isEmpty():
        return out
    # contents that share both hashes: their rows, and only theirs, meet by the content itself
    odd = rt.materialise(rows.select("no", "id", "n", "d", "x", plain.alias("plain")).join(shared, ["d", "x"], "left_semi"), "odd")
    best = _combined(odd.select("d", "x", "plain", _rank(), F.lit(1).cast("long").alias("size")), "d", "x", "plain")
    odd = rt.meet(odd, best, ["d", "x", "plain"], "size", odd.count())
    return out.where("best IS NOT NULL").unionByName(odd.select("no", "id", "d", "best", "size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _numbered(docs, id_col, text_col, digest, "plain")
    met = _met(rows, F.col("plain"))
    if digest is not sha256:
        met = met.drop("d").join(rows.select("no", sha256(F.col("plain")).alias("d")), "no")
    return met.select(F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("no") == F.col("best.no")).alias("kept"), F.col("d").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with only the row that stays of each group of equal texts; all columns are kept."""
    rows = _numbered(docs, id_col, text_col, sha256, "row")
    won = winners(rows, _plain(rt.text_of(F.col("row")[text_col])))
    # every content has one winner, whatever its digest
    return rt.unpacked(rows.join(won.select(F.col("best.no").alias("no")), "no", "left_semi").select("row"), docs)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(rt.read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
