"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct words, word stems (the first four and five letters), pairs of neighbouring words and
pairs of words one or two apart, all hashed into 2 ** BITS places; a feature counts once however often it occurs. Each
place has its own learning rate, and L1 keeps most weights at zero, so the model is a short list of places and
weights that is broadcast (at most 2 ** BITS of them, whatever the corpus size). Scoring is one pass over the texts.

The model learns from at most MAX_SAMPLE labelled rows, those with the smallest hashes of their ids (a documented bound;
they are read in one task, whose size therefore does not follow the corpus). Nothing but the text enters a score.

Null and empty texts have the score of a text without features; without a labelled row of each class every score is 0. Of
contradicting labels of one id, toxic wins; null labels are not used; rows that repeat an id, or tie in their score, are each scored
and judged alike; texts are hashed some words at a time and scored one Arrow batch at a time, so a very long text must only fit a
task; an empty table gives an empty result; other columns, whatever their names, are ignored, or kept by keep_clean().
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime as rt

BITS = 22
MAX_SAMPLE = 16_384
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.08, 1.0, 1.5, 0.5
THRESHOLD = 0.3
#: Words of texts that are hashed at a time.
GROUP = 100_000

_SPACED = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


class _Words(dict):
    """word -> row of (hash, hash of 4 letters, hash of 5 letters), bounded."""

    LIMIT = 150_000

    def __init__(self):
        super().__init__()
        self.table = np.zeros((1024, 3), np.uint64)

    def __missing__(self, word: bytes) -> int:
        import xxhash

        k = len(self)
        if k >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        text = word.decode("utf-8", "replace")
        h = xxhash.xxh3_64_intdigest
        self.table[k] = h(word), h(b"4" + text[:4].encode()), h(b"5" + text[:5].encode())
        self[word] = k
        return k


class Features:
    """Distinct feature places of texts, many texts at a time."""

    def __init__(self, bits: int = BITS):
        self.bits, self.words = bits, _Words()

    def groups(self, texts: list[str]):
        """(first text, number of texts, text of each feature, place of each feature); features may repeat."""
        start, held, counts = 0, [], []
        for k, t in enumerate(texts):
            own = t.lower().encode().translate(_SPACED).split()
            held += own
            counts.append(len(own))
            if len(held) >= GROUP or k == len(texts) - 1:
                yield start, len(counts), *self._places(held, counts)
                start, held, counts = k + 1, [], []

    def _places(self, held: list[bytes], counts: list[int]):
        if len(self.words) > self.words.LIMIT:
            self.words = _Words()
        ids = np.fromiter(map(self.words.__getitem__, held), np.int64, len(held))
        table = self.words.table[ids]
        of = np.repeat(np.arange(len(counts)), counts)
        h, made, texts = table[:, 0], [table[:, 0], table[:, 1], table[:, 2]], [of, of, of]
        for gap in (1, 2, 3):
            same = of[:-gap] == of[gap:]
            made.append((h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * gap))[same])
            texts.append(of[gap:][same])
        places = np.concatenate([rt.mix(m) >> np.uint64(64 - self.bits) for m in made]).astype(np.int64)
        return np.concatenate(texts), places


class Ftrl:
    """FTRL-proximal: z and n per coordinate; weights are zero until |z| passes L1."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.z0 = self.n0 = 0.0

    def weights(self, places) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def bias(self) -> float:
        return -self.z0 / ((BETA + self.n0**0.5) / ALPHA)

    def learn(self, places: np.ndarray, label: float) -> None:
        w, b = self.weights(places), self.bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        grown = np.sqrt(self.n[places] + g * g)
        self.z[places] += g - (grown - np.sqrt(self.n[places])) / ALPHA * w
        self.n[places] += g * g
        self.z0 += g - ((self.n0 + g * g) ** 0.5 - self.n0**0.5) / ALPHA * b
        self.n0 += g * g


def train(rows: Iterator[tuple[np.ndarray, float]], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(places, weights, bias) from (distinct places, label) rows, read once and not kept; None if a class is missing."""
    model, seen = Ftrl(1 << bits), set()
    for places, label in rows:
        model.learn(places, label)
        seen.add(label)
    found = np.flatnonzero(np.abs(model.z) > L1)
    return (found, model.weights(found), model.bias()) if len(seen) > 1 else None


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_sample: int = MAX_SAMPLE):
    """The weights, learned in one executor task from a bounded sample; None if a class is missing."""
    known = labels.select(rt.named(id_col).cast("long").alias("__id"), rt.named(label_col).cast("double").alias("__y")).dropna().where(~held_out(F.col("__id")))
    order = [F.xxhash64("__id"), F.col("__id")]
    known = known.orderBy(*order).limit(max_sample).groupBy("__id").agg(F.max("__y").alias("__y"))
    sample = docs.select(rt.named(id_col).cast("long").alias("__id"), rt.text_of(rt.named(text_col)).alias("__text")).join(F.broadcast(known), "__id")
    sample = rt.materialise(sample.orderBy(*order, "__text").limit(max_sample), "labelled").coalesce(1).sortWithinPartitions(*order, "__text").select("__text", "__y")
    # an epoch is one more reading of the sample, so the task holds the model and one batch, however long the texts are
    epochs = functools.reduce(DataFrame.union, [sample] * EPOCHS)

    def rows(batches):
        features = Features()
        for b in batches:
            ys, texts = b.column("__y").to_pylist(), b.column("__text").to_pylist()
            for start, count, of, places in features.groups(texts):
                order = np.argsort(of, kind="stable")
                parts = np.split(places[order], np.cumsum(np.bincount(of, minlength=count))[:-1])
                for k, p in enumerate(parts):
                    yield np.unique(p), ys[start + k]

    def learn(batches):
        made = train(rows(batches))
        if made:
            yield pa.record_batch({"places": pa.array([made[0].astype("<i8").tobytes()]), "weights": pa.array([made[1].astype("<f8").tobytes()]), "bias": pa.array([made[2]])})

    got = epochs.coalesce(1).mapInArrow(learn, "places binary, weights binary, bias double").collect()
    return (np.frombuffer(got[0][0], "<i8"), np.frombuffer(got[0][1], "<f8"), got[0][2]) if got else None


def score(spark: SparkSession, model, text: Column) -> Column:
    """A Column: the score of a text that is never null."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if held.value:
            dense = np.zeros(1 << BITS)
            dense[held.value[0]] = held.value[1]
            features, bias = Features(), held.value[2]
        for texts in batches:
            out = np.zeros(len(texts))
            if held.value:
                for start, count, of, places in features.groups(list(texts)):
                    w = dense[places]
                    some = np.flatnonzero(w)
                    key = np.unique((of[some] << BITS) | places[some])
                    total = np.bincount(key >> BITS, dense[key & ((1 << BITS) - 1)], count) + bias
                    out[start : start + count] = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pd.Series(out)

    return scored(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, id_col, text_col, label_col)
    rows = docs.select(rt.named(id_col).cast("long").alias("doc_id"), rt.text_of(rt.named(text_col)).alias("text"))
    rows = rows.select("doc_id", score(docs.sparkSession, model, F.col("text")).alias("score"))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score reaches the threshold; all columns are kept."""
    model = fit(docs, labels, id_col, text_col)
    scored = rt.packed(docs, id_col, text_col).select("row", score(docs.sparkSession, model, F.col("text")).alias("score"))
    return rt.unpacked(scored.where(F.col("score") < threshold).select("row"), docs)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(rt.read_table(spark, sf_dir, "documents"), rt.read_table(spark, sf_dir, "labels"))
