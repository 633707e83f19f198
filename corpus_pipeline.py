"""Corpus pipeline: documents pass five stages, each made by one of the training-data operators.

A stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs. All but the
last return the columns of docs, whatever their names.

Null and empty texts pass as empty ones: the classifier judges them like any text without features, one of them stays of the exact
copies, and packing gives it its end id. Null ids lose ties and rows that repeat an id are rows of their own in every stage. A very
long text is one row, which must fit a task. Ties go to the longer text (exact copies), then to the least id, then to the first
row. Empty tables pass through. Stage results go to the shared folder, so a lost executor repeats only its own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import exact_dedup, near_dup, packing, secret_scan, toxicity
from tidewatch.llm import runtime as rt


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; its labels are those of sf_dir."""
    return toxicity.keep_clean(docs, rt.read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dup.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are masked; widely copied examples and clean texts stay as they are."""
    return secret_scan.mask_live(docs, owner=F.col("source"), repo=F.concat_ws("/", "source", "lang"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram jaccard", drop_near_copies), ("secret scans", mask_secrets), ("packing", pack)]

#: Training, MinHash and token ids are not for SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rt.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = rt.materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
