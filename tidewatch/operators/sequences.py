"""Order-dependent detectors, one pass per group in pandas: Bayesian change-points of deployers, and synchronised buyers."""

from __future__ import annotations

import functools
import itertools
import math
from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import severity_col
from ..plans.dialect import Dialect, Tables, query, run
from .detectors import deployer_features

HAZARD, SHORT = 1 / 300, 2
#: Priors of mean and precision (mean, its weight, shape and rate): of the original scores, and of those of the derived tables.
DEFAULT_PRIOR = (0.2, 1.0, 3.0, 1.0)
PRIOR = (0.3, 1.0, 2.0, 0.05)
#: Run lengths that are kept of a sequence.
MOST_RUNS = 1000


@functools.lru_cache(maxsize=8)
def _by_run(n: int, prior: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of k < n observations only mean and rate depend on the data; weight, shape and the predictive's constant do not."""
    runs = np.arange(n)
    shape = prior[2] + 0.5 * runs
    return prior[1] + runs, shape, np.array([math.lgamma(a + 0.5) - math.lgamma(a) - 0.5 * math.log(2 * a * math.pi) for a in shape])


@functools.lru_cache(maxsize=8)
def _marginal(n: int, prior: tuple[float, float, float, float], hazard: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By how many observations a run had: its weight before the next one, its shape after it, and the constant of its marginal likelihood
    then, times the chance of its going on."""
    runs = np.arange(n)
    weight, shape = prior[1] + runs, prior[2] + 0.5 * (runs + 1)
    constant = np.array([math.lgamma(a) for a in shape]) - math.lgamma(prior[2]) - 0.5 * (runs + 1) * math.log(2 * math.pi) - 0.5 * np.log((weight + 1) / prior[1])
    return weight, shape, constant + (runs + 1) * math.log(1 - hazard)


class ChangePoints:
    """Run-length posterior of a sequence: Normal-Gamma conjugate updates, Student-t predictive, in log space. All run lengths are
    kept, so a step takes as long as the sequence so far."""

    def __init__(self, prior: tuple[float, float, float, float] = PRIOR, hazard: float = HAZARD):
        self.prior, self.hazard, self.log_mass = prior, hazard, np.zeros(1)
        self.mean, self.rate = np.array([prior[0]]), np.array([prior[3]])

    def step(self, x: float) -> tuple[float, float, int]:
        """(P(run is 0), P(run is short), most likely run) after x."""
        n = len(self.mean)
        weight, shape, constant = (a[:n] for a in _by_run(max(512, 1 << (n - 1).bit_length()), self.prior))
        spread = self.rate * (weight + 1) / (shape * weight)
        gap = (x - self.mean) ** 2
        joint = self.log_mass + constant - 0.5 * np.log(spread) - (shape + 0.5) * np.log1p(gap / (2 * shape * spread))
        top = joint.max()
        fresh = math.log(self.hazard) + top + math.log(np.exp(joint - top).sum())
        mass = np.concatenate([[fresh], math.log(1 - self.hazard) + joint])
        peak = mass.max()
        self.log_mass = mass - peak - math.log(np.exp(mass - peak).sum())
        self.rate = np.concatenate([[self.prior[3]], self.rate + weight * gap / (2 * (weight + 1))])
        self.mean = np.concatenate([[self.prior[0]], (weight * self.mean + x) / (weight + 1)])
        p = np.exp(self.log_mass)
        return float(p[0]), float(p[: SHORT + 1].sum()), int(p.argmax())


class RunLengths:
    """Run-length posteriors of many sequences at once, at most `most` run lengths of each. A step takes no longer for a later
    observation, as the run length with the least probability makes way for the new one.

    What is dropped is accounted for: the kept posterior is the full model's, given that no run went through a dropped run length.
    `lost` sums the probabilities at which run lengths were dropped. Under the model the probability of the opposite, which bounds
    the difference of any reported probability, is `lost` on average, and exceeds a bound at any time with a chance of at most
    `lost` divided by that bound. With fewer than `most` observations nothing is dropped and the result is the full model's."""

    def __init__(self, prior: tuple[float, float, float, float] = PRIOR, hazard: float = HAZARD, most: int = MOST_RUNS):
        self.prior, self.hazard, self.most = prior, hazard, most
        self.run, self.lost = np.zeros((0, 1), np.int64), np.zeros(0)
        self.p, self.mean, self.rate = (np.zeros((0, 1)) for _ in range(3))

    def grow(self, sequences: int) -> None:
        """Room for that many more sequences without observations."""
        for name, fresh in (("run", 0), ("p", 0.0), ("mean", self.prior[0]), ("rate", self.prior[3])):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.full((sequences, old.shape[1]), fresh, old.dtype)]))
        self.p[len(self.lost) :, 0] = 1
        self.lost = np.concatenate([self.lost, np.zeros(sequences)])

    def step(self, rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One observation of each of those sequences: (P(run is 0), P(run is short), most likely run) after it."""
        run, p, mean, rate, x = self.run[rows], self.p[rows], self.mean[rows], self.rate[rows], x[:, None]
        weight, shape, constant = (a[run] for a in _by_run(max(512, 1 << int(run.max()).bit_length()), self.prior))
        spread, gap = rate * (weight + 1) / (shape * weight), (x - mean) ** 2
        with np.errstate(divide="ignore"):
            joint = np.log(p) + constant - 0.5 * np.log(spread) - (shape + 0.5) * np.log1p(gap / (2 * shape * spread))
        share = np.exp(joint - joint.max(axis=1, keepdims=True))
        p = (1 - self.hazard) * share / share.sum(axis=1, keepdims=True)
        rate, mean, run = rate + weight * gap / (2 * (weight + 1)), (weight * mean + x) / (weight + 1), run + 1
        least, each = p.argmin(axis=1), np.arange(len(rows))
        if p[each, least].any() and p.shape[1] < self.most:  # no sequence here has room left
            self._widen()
            wide = self.run.shape[1] - p.shape[1]
            run, p, mean, rate = (np.pad(a, ((0, 0), (0, wide)), constant_values=v) for a, v in ((run, 0), (p, 0), (mean, 0), (rate, 1)))
            least = p.argmin(axis=1)
        dropped = p[each, least]
        self.lost[rows] += dropped
        p /= (1 - dropped)[:, None]
        run[each, least], p[each, least], mean[each, least], rate[each, least] = 0, self.hazard / (1 - dropped), self.prior[0], self.prior[3]
        self.run[rows], self.p[rows], self.mean[rows], self.rate[rows] = run, p, mean, rate
        likely = np.where(p == p.max(axis=1, keepdims=True), run, np.iinfo(np.int64).max).min(axis=1)
        return p[each, least], np.where(run <= SHORT, p, 0).sum(axis=1), likely

    def _widen(self) -> None:
        wide = min(self.most, 2 * self.run.shape[1]) - self.run.shape[1]
        for name, empty in (("run", 0), ("p", 0), ("mean", 0), ("rate", 1)):
            setattr(self, name, np.pad(getattr(self, name), ((0, 0), (0, wide)), constant_values=empty))

    def dumps(self, row: int) -> bytes:
        used = self.p[row] > 0
        return np.concatenate([[self.lost[row]], self.run[row, used], self.p[row, used], self.mean[row, used], self.rate[row, used]]).astype("<f8").tobytes()

    def loads(self, state: bytes) -> None:
        """Take on one more sequence from dumps()."""
        flat = np.frombuffer(state, "<f8")
        run, p, mean, rate = flat[1:].reshape(4, -1)
        self.grow(1)
        while self.run.shape[1] < len(run):
            self._widen()
        self.lost[-1] = flat[0]
        self.p[-1] = 0
        for name, values in (("run", run), ("p", p), ("mean", mean), ("rate", rate)):
            getattr(self, name)[-1, : len(values)] = values


#: Sequences of a block, whose arrays stay in a core's cache, and rows that a task holds.
BLOCK, AT_ONCE = 64, 200_000
#: A logarithm whose exponential no sum of doubles shows beside 1; smaller ones are slow to raise and count as this in sums of one step only.
LEAST = -700.0


def run_lengths(sequences: list[np.ndarray], prior: tuple[float, float, float, float] = PRIOR, hazard: float = HAZARD) -> list[tuple[np.ndarray, np.ndarray]]:
    """The full model of whole sequences: (P(run is short), most likely run) after each observation.

    The predictives of a run multiply to its marginal likelihood, so its log probability is a constant of its length, less its shape
    times log(rate), plus what it began with: one logarithm and one exponential for a run and step. The newest run is in front."""
    made: list = [None] * len(sequences)
    order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
    for at in range(0, len(order), BLOCK):
        block = order[at : at + BLOCK]
        size = np.array([len(sequences[k]) for k in block])
        n, few = int(size[0]), len(block)
        weight, shape, constant = _marginal(1 << max(9, (n - 1).bit_length()), prior, hazard)
        to_mean, to_rate = 1 / (weight + 1), weight / (2 * (weight + 1))
        x = np.zeros((n, few))
        for j, k in enumerate(block):
            x[: size[j], j] = sequences[k]
        mean, rate, begun = np.full((few, n), prior[0]), np.full((few, n), prior[3]), np.zeros((few, n))
        one, two, short, likely = np.empty(few * n), np.empty(few * n), np.empty((n, few)), np.empty((n, few), np.int64)
        began = prior[2] * math.log(prior[3])
        begun[:, n - 1] = began
        for t in range(n):
            m, front = int(np.searchsorted(-size, -t)), n - 1 - t  # sequences that are so long come first
            u, b, at_first, gap, p = mean[:m, front:], rate[:m, front:], begun[:m, front:], one[: m * (t + 1)].reshape(m, t + 1), two[: m * (t + 1)].reshape(m, t + 1)
            np.subtract(x[t, :m, None], u, out=gap)
            np.multiply(gap, gap, out=p)
            p *= to_rate[: t + 1]
            b += p
            gap *= to_mean[: t + 1]
            u += gap
            np.log(b, out=p)
            p *= shape[: t + 1]
            np.subtract(constant[: t + 1], p, out=p)
            p += at_first
            best = p.argmax(axis=1)
            top = p[np.arange(m), best]
            p -= top[:, None]
            np.exp(np.maximum(p, LEAST, out=p), out=p)
            total = p.sum(axis=1)
            short[t, :m] = hazard + (1 - hazard) * p[:, :SHORT].sum(axis=1) / total
            likely[t, :m] = np.where(hazard * total >= 1 - hazard, 0, best + 1)
            if front:
                begun[:m, front - 1] = began + math.log(hazard / (1 - hazard)) + top + np.log(total)
        for j, k in enumerate(block):
            made[k] = short[: size[j], j], likely[: size[j], j]
    return made


POINTS = "deployer string, token string, nth long, score double, cp_prob double, p_short double, run_mode int, run_drop int, lost double"


def change_points(features: DataFrame, prior: tuple[float, float, float, float] = PRIOR, hazard: float = HAZARD, most: int = MOST_RUNS) -> DataFrame:
    """deployer, token, nth, score, cp_prob (P(run is 0), which equals the hazard by its algebra), p_short, run_mode, run_drop, lost.

    A partition streams the launches of one deployer after another. Those with fewer than `most` launches go through the full model,
    some at once; a longer one goes on in RunLengths, so that a task holds AT_ONCE rows and one posterior, however long it is."""

    def gone_on(state: list, x: np.ndarray) -> list[np.ndarray]:
        model, out = state[0], []
        for one in x[:, None]:
            cp, short, mode = model.step(np.zeros(1, np.int64), one)
            out.append((cp[0], short[0], mode[0], max(0, state[1] + 1 - mode[0]), model.lost[0]))
            state[1] = mode[0]
        return [np.array(c) for c in zip(*out, strict=True)]

    def steps(batches):
        held, goes_on = [], None  # goes_on: deployer, and [posterior, most likely run], of a sequence that is not at its end
        for g in itertools.chain(batches, [None]):
            held += [] if g is None or g.empty else [g]
            if not held or g is not None and sum(map(len, held)) < AT_ONCE:
                continue
            rows = pd.concat(held, ignore_index=True)
            codes = pd.factorize(rows["deployer"], use_na_sentinel=False)[0]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(rows)]])
            same = goes_on is not None and goes_on[0] == rows["deployer"][0]
            # the last deployer waits for the rest of its launches, unless it has too many
            waits = g is not None and starts[-1] - starts[-2] < most and not (same and len(starts) == 2)
            whole = starts[:-1] if waits else starts
            held, rows = [rows[whole[-1] :]] if waits else [], rows[: whole[-1]]
            if not len(rows):
                continue
            scores = np.split(rows["score"].to_numpy(), whole[1:-1])
            short_ones = [k for k, x in enumerate(scores) if len(x) < most and not (same and k == 0)]
            made = {}
            for k, (short, mode) in zip(short_ones, run_lengths([scores[k] for k in short_ones], prior, hazard), strict=True):
                made[k] = [np.full(len(mode), hazard), short, mode, np.maximum(0, np.concatenate([[0], mode[:-1]]) + 1 - mode), np.zeros(len(mode))]
            for k in sorted(set(range(len(scores))) - set(short_ones)):
                if not (same and k == 0):
                    goes_on = rows["deployer"][whole[k]], [RunLengths(prior, hazard, most), 0]
                    goes_on[1][0].grow(1)
                made[k] = gone_on(goes_on[1], scores[k])
            columns = [np.concatenate([made[k][c] for k in range(len(scores))]) for c in range(5)]
            yield rows.assign(**dict(zip(("cp_prob", "p_short", "run_mode", "run_drop", "lost"), columns, strict=True)))

    rows = features.select("deployer", "token", F.col("nth").cast("long").alias("nth"), F.col("score").cast("double").alias("score"))
    parts = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "deployer").sortWithinPartitions("deployer", "nth").mapInPandas(steps, POINTS)


def change_point_anomalies(points: DataFrame, least_prob: float = 0.5, least_history: int = 5) -> DataFrame:
    """Signal `changepoint` at P(run is 0) >= least_prob. That probability equals the hazard, so `run_reset` also tells a launch at
    which the most likely run becomes short, with the probability of a short run as its confidence."""
    sure = F.when(F.col("cp_prob") >= least_prob, F.col("cp_prob")).when((F.col("run_drop") >= least_history) & (F.col("p_short") >= least_prob), F.col("p_short"))
    fired = points.where(F.col("nth") > least_history).withColumn("confidence", F.round(sure, 6)).where("confidence IS NOT NULL")
    signal = F.when(F.col("cp_prob") >= least_prob, "changepoint").otherwise("run_reset").alias("signal")
    return fired.select(F.col("deployer").alias("subject"), F.lit("deployer_changepoint").alias("detector_id"), signal, "confidence", severity_col(F.col("confidence")).alias("severity"), "token", "nth")


EPS, MIN_SAMPLES, BUCKET_S = 0.30, 3, 1800


@dataclass(frozen=True)
class Synchrony:
    """Parameters of synchronised buying, by default those for seconds on a live chain. A window with fewer than `least_events` buys, or
    whose token has fewer than `least_baseline` in the `baseline_s` before it, is skipped; `baseline_s` of 0 takes the window's own rate."""

    window_s: int = 600
    bucket_s: int = 30
    eps: float = EPS
    least_wallets: int = 5
    least_events: int = 5
    baseline_s: int = 7 * 86_400
    least_baseline: int = 10
    least_tightness: float = 0.5
    most_chance: float = 1e-6


#: For the derived tables, whose events are hours apart.
SCALED = Synchrony(6 * 3600, BUCKET_S, EPS, MIN_SAMPLES, 1, 0, 0, 0.5, 1.0)


def dbscan(presence: list[frozenset], eps: float = EPS, least: int = MIN_SAMPLES, counts: list[int] | None = None) -> list[int]:
    """Cluster numbers (-1: noise) by 1 - Jaccard; border points go to the cluster that reaches them first in the given order.
    Equal sets are neighbours with the same neighbours, so they can be given once, at their first place, with counts."""
    n = len(presence)
    if not n:
        return []
    places = {b: k for k, b in enumerate(sorted(set().union(*presence)))}
    has = np.zeros((n, len(places)), np.float32)
    for i, own in enumerate(presence):
        has[i, [places[b] for b in own]] = 1
    size, weight = has.sum(axis=1), np.ones(n, np.int64) if counts is None else np.array(counts, np.int64)

    def near(i: int) -> np.ndarray:
        shared = (has @ has[i]).astype(np.float64)
        return np.flatnonzero(1 - shared / np.maximum(1, size + size[i] - shared) <= eps)

    label, found = [None] * n, 0
    for i in range(n):
        if label[i] is not None:
            continue
        around = near(i)
        if weight[around].sum() < least:
            label[i] = -1
            continue
        label[i], todo = found, deque(around.tolist())
        while todo:
            j = todo.popleft()
            if label[j] == -1:
                label[j] = found
            if label[j] is None:
                label[j] = found
                around = near(j)
                if weight[around].sum() >= least:
                    todo += [k for k in around.tolist() if label[k] is None or label[k] == -1]
        found += 1
    return label


def synchronised(legs: DataFrame, p: Synchrony = SCALED) -> DataFrame:
    """Groups of wallets that buy a token in the same time buckets, per token and window: size, tightness, chance, confidence.

    All wallets are clustered. Those that buy in the same buckets have the same neighbours and are one weighted point, so the
    clustering of a window of k buckets has at most 2^k - 1 points, however many wallets buy."""
    window = ["token", "window_no"]
    buys = legs.where("leg = 'buy'").withColumn("window_no", F.floor(F.col("t") / p.window_s)).select(*window, "wallet", "t", "tx_hash")
    begun = buys.groupBy(*window).agg(F.min("t").alias("start"), F.count(F.lit(1)).alias("n_buys"))
    if p.baseline_s:
        past = Window.partitionBy("token").orderBy("window_no").rangeBetween(-(p.baseline_s // p.window_s), -1)
        begun = begun.withColumn("n_before", F.coalesce(F.sum("n_buys").over(past), F.lit(0))).where(F.col("n_before") >= p.least_baseline).withColumn("rate", F.col("n_before") / p.baseline_s)
    else:
        begun = begun.withColumn("rate", F.col("n_buys") / p.window_s)
    begun = begun.where(F.col("n_buys") >= p.least_events)
    bucket = F.floor((F.col("t") - F.col("start")) / p.bucket_s).alias("bucket")
    wallets = buys.join(begun, window).groupBy(*window, "wallet").agg(F.array_sort(F.collect_set(bucket)).alias("buckets"), F.min("t").alias("first_t"), F.min(F.struct("t", "tx_hash", "wallet")).alias("place"))
    points = wallets.groupBy(*window, "buckets").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    points = points.select(*window, "buckets", "n", F.col("place.t").alias("t"), F.col("place.tx_hash").alias("tx_hash"), F.col("place.wallet").alias("wallet"))

    def per_window(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["t", "tx_hash", "wallet"])
        return g[[*window, "buckets"]].assign(cluster=dbscan([frozenset(b) for b in g.buckets], p.eps, p.least_wallets, g.n.tolist()))

    labels = points.groupBy(*window).applyInPandas(per_window, "token string, window_no long, buckets array<long>, cluster int").where("cluster >= 0")
    clusters = wallets.join(labels, [*window, "buckets"]).groupBy(*window, "cluster").agg(
        F.count(F.lit(1)).cast("int").alias("size"),
        F.greatest(F.lit(0.0), 1 - (F.max("first_t") - F.min("first_t")) / p.bucket_s).alias("tightness"),
        F.concat_ws(",", F.array_sort(F.collect_list("wallet"))).alias("wallets"),
    )
    chance = F.pow(1 - F.exp(-F.col("rate") * p.bucket_s), F.col("size"))
    sure = F.least(F.lit(0.90), 0.4 / (1 + F.exp((5 - F.col("size")) / 5)) + 0.3 * F.col("tightness") + 0.3 * (1 - F.least(F.lit(1.0), F.col("chance") / p.most_chance)))
    kept = clusters.where(F.col("tightness") >= p.least_tightness).join(begun, window).withColumn("chance", chance).where(F.col("chance") <= p.most_chance)
    return kept.select(*window, "size", "tightness", "chance", sure.alias("confidence"), "wallets")


def synchrony_anomalies(clusters: DataFrame) -> DataFrame:
    sure = F.round("confidence", 6).alias("confidence")
    return clusters.select(F.col("token").alias("subject"), F.lit("synchronized_activity_v1").alias("detector_id"), F.lit("synchronised_buys").alias("signal"), sure, severity_col(F.round("confidence", 6)).alias("severity"), "window_no", "size")


def deployer_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = change_points(run(spark, deployer_features, Tables(spark, sf_dir)))
    return points.select("deployer", "token", "nth", "score", *[F.round(c, 6).alias(c) for c in ("cp_prob", "p_short")], "run_mode", "run_drop", F.round("lost", 6).alias("lost"))


def change_points_text(d: Dialect) -> str:
    """The full model, one observation of every deployer per step of a recursion; its state is a list by run length."""
    mean, weight, shape, rate = PRIOR
    w, a = f"({weight} + i - 1)", f"({shape} + 0.5 * (i - 1))"
    spread, gap = f"(r.b * ({w} + 1) / ({a} * {w}))", "((x - r.u) ** 2)"
    density = f"r.m + lgamma({a} + 0.5) - lgamma({a}) - 0.5 * ln(2 * {a} * pi()) - 0.5 * ln({spread}) - ({a} + 0.5) * ln(1 + {gap} / (2 * {a} * {spread}))"
    one = lambda m, u, b: f"struct_pack(m := CAST({m} AS DOUBLE), u := CAST({u} AS DOUBLE), b := CAST({b} AS DOUBLE))"
    moved = f"list_transform(runs, lambda r, i: {one(density, f'({w} * r.u + x) / ({w} + 1)', f'r.b + {w} * {gap} / (2 * ({w} + 1))')})"
    return f"""
    WITH RECURSIVE f AS ({deployer_features(d)}),
    s AS (
      SELECT DISTINCT deployer, CAST('' AS VARCHAR) AS token, CAST(0 AS BIGINT) AS nth, CAST(0 AS DOUBLE) AS score, [{one(0, mean, rate)}] AS runs, CAST(0 AS BIGINT) AS likely, CAST(0 AS BIGINT) AS before FROM f
      UNION ALL
      SELECT deployer, token, nth, x, runs, list_position(list_transform(runs, lambda r: r.m), list_max(list_transform(runs, lambda r: r.m))) - 1, likely FROM (
        SELECT deployer, token, nth, x, likely, list_prepend({one(f"ln({HAZARD})", mean, rate)}, list_transform(moved, lambda r: {one("r.m + shift", "r.u", "r.b")})) AS runs FROM (
          SELECT *, ln(1 - {HAZARD}) - top - ln(list_sum(list_transform(moved, lambda r: exp(r.m - top)))) AS shift FROM (
            SELECT *, list_max(list_transform(moved, lambda r: r.m)) AS top FROM (
              SELECT s.deployer, f.token, f.nth, f.score AS x, likely, {moved} AS moved FROM s JOIN f ON s.deployer = f.deployer AND f.nth = s.nth + 1) AS j) AS k) AS l) AS m)
    SELECT deployer, token, nth, score, round(exp(runs[1].m), 6) AS cp_prob, round(list_sum(list_transform(runs[1:{SHORT + 1}], lambda r: exp(r.m))), 6) AS p_short,
      likely AS run_mode, greatest(0, before + 1 - likely) AS run_drop, CAST(0 AS DOUBLE) AS lost FROM s WHERE nth > 0"""


def synchronised_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synchronised(Tables(spark, sf_dir)("legs"))


def bucket_pairs(d: Dialect) -> str:
    """Wallet pairs of a token that share a bucket, with their Jaccard similarity: the neighbours that the clustering sees."""
    b = f"SELECT DISTINCT token, wallet, {d.idiv('t', '21600')} AS window_no, {d.idiv('t', str(BUCKET_S))} AS bucket FROM {{legs}} WHERE leg = 'buy'"
    return f"""
    WITH b AS ({b}), n AS (SELECT token, window_no, wallet, count(*) AS n FROM b GROUP BY token, window_no, wallet),
    s AS (SELECT x.token, x.window_no, x.wallet AS a, y.wallet AS z, count(*) AS shared FROM b x JOIN b y ON x.token = y.token AND x.window_no = y.window_no AND x.bucket = y.bucket AND x.wallet < y.wallet GROUP BY x.token, x.window_no, x.wallet, y.wallet)
    SELECT s.token, s.window_no, s.a, s.z, round(shared / CAST(p.n + q.n - shared AS DOUBLE), 6) AS jaccard FROM s JOIN n p ON s.token = p.token AND s.window_no = p.window_no AND s.a = p.wallet JOIN n q ON s.token = q.token AND s.window_no = q.window_no AND s.z = q.wallet
    WHERE shared >= 0.7 * (p.n + q.n - shared)"""


def neighbour_pairs(spark: SparkSession, sf_dir: str, window_s: int = 21_600, least: float = 0.7) -> DataFrame:
    """The pairs of `bucket_pairs` from sets of buckets: a wallet's set within a window is one number, as a window has few buckets, and
    wallets with the same set are alike. Sets that are near are found among the distinct ones, and only the wallets of those meet, so no
    row but a result is ever a pair of wallets, and pairs are not shuffled."""
    window = ["token", "window_no"]
    bought = Tables(spark, sf_dir)("legs").where("leg = 'buy'").withColumn("window_no", F.floor(F.col("t") / window_s))
    bit = F.call_function("shiftleft", F.lit(1), (F.floor(F.col("t") / BUCKET_S) - F.col("window_no") * (window_s // BUCKET_S)).cast("int"))
    wallets = bought.groupBy(*window, "wallet").agg(F.bit_or(bit).alias("buckets"))
    sets = wallets.select(*window, "buckets").distinct()
    other = sets.withColumnRenamed("buckets", "others")
    shared, either = F.bit_count(F.col("buckets").bitwiseAND(F.col("others"))), F.bit_count(F.col("buckets").bitwiseOR(F.col("others")))
    near = sets.join(other, window).where((shared > 0) & (shared >= least * either)).select(*window, "buckets", "others", F.round(shared / either.cast("double"), 6).alias("jaccard"))
    a = wallets.withColumnRenamed("wallet", "a").join(near, [*window, "buckets"])
    z = wallets.select(*window, F.col("wallet").alias("z"), F.col("buckets").alias("others"))
    return a.join(z, [*window, "others"]).where("a < z").select(*window, "a", "z", "jaccard")


QUERIES = {"d11_neighbour_pairs": (neighbour_pairs, query(bucket_pairs)[1]), "d09_change_points": (deployer_change_points, query(change_points_text)[1]), "d11_synchronised": (synchronised_buyers, None)}
