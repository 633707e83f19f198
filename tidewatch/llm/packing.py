"""Sequence packing by non-negative least squares over the histogram of lengths.

Documents are tokenised once and cut at multiples of the window, so all pieces but the last of a document fill a
window alone. Shallow combinations of two or three lengths that fill a window exactly are enumerated; their repeat
counts are solved by non-negative least squares against the histogram of lengths and rounded to the nearest whole, as far as the
histogram reaches; what is left is packed greedily, longest first, on the histogram too. Only that histogram (a window's worth
of counts) reaches the driver. Pieces then find their place by their rank among the pieces of their length; ranks
are made in salted groups.

Null text is the empty text, whose only id is the end id. Rows that repeat an id, or tie in everything, are each packed, in reading
order. A very long text is one row and must fit a task; its pieces are cut there. An empty table gives an empty result; other
columns, whatever their names, are ignored. Sequences whose length is a power of two need no padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from . import runtime as rt

WINDOW = 2048
END_ID = 1
#: First members of triples are multiples of this: that bounds the combinations to some thousands.
STRIDE = 16
STEPS = 200
#: Times that the remaining histogram is solved again.
ROUNDS = 8
#: Ranks of one length stay below this.
_RANKS = 1 << 44


def combinations(histogram: np.ndarray, stride: int = STRIDE) -> np.ndarray:
    """Rows of three lengths (0: none) that fill the window; all lengths occur."""
    window = len(histogram) - 1
    there = histogram > 0
    low = np.arange(1, window // 2 + 1)
    pairs = np.stack([window - low, low, np.zeros_like(low)], 1)
    a = np.arange(stride, window, stride)[:, None]
    b = np.arange(1, window)[None, :]
    c = window - a - b
    fits = (c >= 1) & (c <= b)
    triples = np.stack([np.broadcast_to(a, fits.shape)[fits], np.broadcast_to(b, fits.shape)[fits], c[fits]], 1)
    made = np.concatenate([pairs, triples])
    ok = (there[made] | (made == 0)).all(axis=1)
    return made[ok]


def solve(made: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 with the least squares of (uses of each length) - histogram: accelerated projected gradients."""
    target = histogram.astype(float)
    if not len(made):
        return np.zeros(0)
    used = made > 0

    def uses(x):
        out = np.zeros(len(target))
        for k in range(made.shape[1]):
            out += np.bincount(made[:, k][used[:, k]], x[used[:, k]], len(target))
        return out

    def back(r):
        return sum(np.where(used[:, k], r[made[:, k]], 0.0) for k in range(made.shape[1]))

    v = np.ones(len(made))
    for _ in range(20):
        v = back(uses(v))
        norm = np.linalg.norm(v)
        v /= norm
    x, y, t = np.zeros(len(made)), np.zeros(len(made)), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(uses(y) - target) / (1.05 * norm))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = new + (old - 1) / t * (new - x), new
    return x


def _greedy(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each gap filled with the longest that fits; equal sequences are made together."""
    out = []
    window = len(left) - 1
    while left.any():
        members: dict[int, int] = defaultdict(int)
        gap, bound = window, window
        while gap > 0:
            fit = np.flatnonzero(left[: min(gap, bound) + 1])
            fit = fit[fit > 0]
            if not len(fit):
                break
            length = int(fit[-1])
            n = min(gap // length, int(left[length]) - members[length])
            if n <= 0:
                bound = length - 1
                continue
            members[length] += n
            gap -= n * length
            bound = length - 1
        times = max(1, min(int(left[k]) // n for k, n in members.items()))
        for k, n in members.items():
            left[k] -= n * times
        out.append((tuple(k for k, n in sorted(members.items(), reverse=True) for _ in range(n)), times))
    return out


def _round(made: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Solutions in whole sequences, largest counts first, taken from `left`: the least squares spread thinly over all
    combinations, so they are solved again over those that weigh most, and over what is left, until nothing rounds to one."""
    out: list[tuple[tuple[int, ...], int]] = []
    for _ in range(ROUNDS):
        made = made[((left[made] > 0) | (made == 0)).all(axis=1)]
        some = made[np.argsort(-solve(made, left), kind="stable")[: np.count_nonzero(left)]]
        times = np.rint(solve(some, left)).astype(np.int64)
        before = len(out)
        for k in np.argsort(-times, kind="stable"):
            if times[k] <= 0:
                break
            members = tuple(int(v) for v in some[k] if v)
            need: dict[int, int] = defaultdict(int)
            for v in members:
                need[v] += 1
            n = min(int(times[k]), *(int(left[v]) // c for v, c in need.items()))
            if n > 0:
                for v, c in need.items():
                    left[v] -= c * n
                out.append((members, n))
        if len(out) == before:
            break
    return out


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, how many such sequences); together they use each length as often as it occurs."""
    left = histogram.astype(np.int64).copy()
    window = len(left) - 1
    out = [((window,), int(left[window]))] if left[window] else []
    left[window] = 0
    return out + _round(combinations(left), left) + _greedy(left)


def places(combos: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys length * _RANKS + first rank, with the first sequence and the offset of each run of ranks."""
    seen: dict[int, int] = defaultdict(int)
    keys, first, offset, base = [], [], [], 0
    for members, times in combos:
        at = 0
        for v in members:
            keys.append(v * _RANKS + seen[v])
            first.append(base)
            offset.append(at)
            seen[v] += times
            at += v
        base += times
    order = np.argsort(np.array(keys, np.int64)) if keys else np.zeros(0, np.int64)
    return tuple(np.array(x, np.int64)[order] for x in (keys, first, offset))


def nnls_share(histogram: np.ndarray) -> float:
    """Share of the pieces shorter than a window that the rounded solution places; the rest is packed greedily."""
    left = histogram.astype(np.int64).copy()
    left[-1] = 0
    rest = left.copy()
    _round(combinations(left), rest)
    return 1 - rest.sum() / max(1, left.sum())


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenised pieces, cut at multiples of the window."""

    def cut(batches):
        coder = bpe.vocabulary(path)
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = coder.encode(t).tobytes() + END_ID.to_bytes(4, "little")
                n = len(raw) // 4
                rows += [(i, s, min(window, n - s), zlib.crc32(raw[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, schema=schema)

    return docs.select(rt.named(id_col).cast("long"), rt.text_of(rt.named(text_col))).mapInArrow(cut, PIECE)


def pack(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    parts = max(16, rt.partitions(spark))
    salt = F.pmod(F.xxhash64("no"), F.lit(parts)).cast("int").alias("salt")
    cut = pieces(docs, path, window, id_col, text_col).withColumn("no", F.monotonically_increasing_id())
    cut = rt.materialise(cut.select("*", salt), "pieces")
    histogram = np.zeros(window + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # window rows at most
        histogram[r["length"]] = r["n"]
    held = spark.sparkContext.broadcast(places(plan(histogram)))

    sizes = cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "salt", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("no"))
    ranked = cut.withColumn("nth", nth - 1).join(sizes, ["length", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).cast("long").alias("rank"))

    def place(batches):
        keys, first, offset = held.value
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            want = length * _RANKS + rank
            k = np.searchsorted(keys, want, "right") - 1
            out = b.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.append_column("sequence_id", pa.array(first[k] + want - keys[k])).append_column("offset", pa.array(offset[k]))

    return ranked.mapInArrow(place, PIECE + ", sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(rt.read_table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
