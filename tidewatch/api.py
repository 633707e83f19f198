"""Python API with the semantics of the service's endpoints."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import detectors, scoring, sequences
from .plans.dialect import KEPT_SPLITS, SPARK, Tables, run
from .sources import files

ANOMALY = "subject string, signal string, confidence double, severity string, detector_id string"
COMMON = ["subject", "detector_id", "signal", "confidence", "severity"]
#: detector id -> (text, the column that names what it is about).
DETECTORS = {
    "honeypot_sim": (detectors.honeypot, "token"), "rug_pull_lp_drain": (detectors.rug_pull, "pool"), "holder_concentration": (detectors.concentration, "token"), "pump_dump": (detectors.pump_dump, "token"),
    "wash_trading_h1": (detectors.wash_trading, "subject"), "mint_burn_anomaly": (detectors.mint_burn, "token"), "withdraw_withheld_drain": (detectors.withheld, "mint"), "sybil_detection": (detectors.sybil, "token"),
    "launch_audit": (detectors.launch_audit, "token"), "permit2_drainer_v1": (detectors.permit_drainer, "token"), "sandwich_mev_v1": (detectors.sandwich, "pool"), "bridge_drain_v1": (detectors.bridge_drain, "address"),
}
#: Detectors of sequences, which are no SQL text.
SEQUENCES: dict[str, Callable[[Tables], DataFrame]] = {
    "deployer_changepoint": lambda t: sequences.change_point_anomalies(sequences.change_points(run(t.spark, detectors.deployer_features, t))),
    "synchronized_activity_v1": lambda t: sequences.synchrony_anomalies(sequences.synchronised(t("legs"))),
}
#: Derived tables that are written once, with the detectors that read them; of those, several must be asked for.
SHARED = {
    "transfers": {"honeypot_sim", "rug_pull_lp_drain", "holder_concentration", "mint_burn_anomaly", "withdraw_withheld_drain", "sybil_detection", "permit2_drainer_v1", "bridge_drain_v1", "deployer_changepoint"},
    "smart_wallets": {"pump_dump", "sybil_detection"},
}
#: Detectors that begin first, so that the largest shuffles (theirs and those of permit2_drainer_v1) do not lie on disk at once.
FIRST = {"sybil_detection"}
_EXTRA: dict[str, Callable[[Tables], DataFrame]] = {}


def register_detector(detector_id: str, made: Callable[[Tables], DataFrame]) -> None:
    """Adds a detector: a function of the tables that returns the columns of COMMON."""
    _EXTRA[detector_id] = made


def list_detectors() -> list[str]:
    return sorted([*DETECTORS, *SEQUENCES, *_EXTRA])


def _made(spark: SparkSession, sf_dir: str, only: Iterable[str] | None = None, params: dict[str, dict] | None = None) -> tuple[dict[str, Callable[[], DataFrame]], list[str]]:
    """The plans of the detectors by id, all on the same tables, and the folders of what several of them derive at length, which is written once."""
    tables, params = Tables(spark, sf_dir), detectors.SCALED if params is None else params
    kept = [tables.keep(name) for name, users in SHARED.items() if only is None or len(users & set(only)) > 1]
    made = {k: (lambda text=partial(text, **params.get(k, {})), key=key: run(spark, text, tables).withColumn("subject", F.col(key))) for k, (text, key) in DETECTORS.items()}
    made |= {k: (lambda f=f: f(tables)) for k, f in (SEQUENCES | _EXTRA).items()}
    return (made if only is None else {k: made[k] for k in only}), kept


def analyze(spark: SparkSession, sf_dir: str, subjects: list[str] | None = None, only: Iterable[str] | None = None, params: dict[str, dict] | None = None, timeout_s: float = 3600) -> DataFrame:
    """Anomalies of all detectors (or `only` some) over all subjects, or some of them (a pushed filter). Each detector is a job of its own,
    whose anomalies go to the shared folder: one that fails is skipped and named in the result's `skipped`. `params` gives
    thresholds, windows and `as_of` by detector id, over defaults for live chains ({} for these alone); without it those of
    the derived tables hold."""
    at = f"{files.shared_folder(spark)}/tidewatch/analyze-{uuid.uuid4().hex}"
    told = sweep(spark, sf_dir, at, timeout_s, only=only, subjects=subjects, params=params).collect()
    if any(r.status == "ok" for r in told):
        out = spark.read.schema(ANOMALY).option("basePath", at).parquet(*[f"{at}/detector_id={r.detector_id}" for r in told if r.status == "ok"]).select(*COMMON)
    else:
        out = spark.createDataFrame([], ANOMALY).select(*COMMON)
    out.skipped = [r.detector_id for r in told if r.status != "ok"]
    return out


def sweep(spark: SparkSession, sf_dir: str, at: str, timeout_s: float = 3600, at_once: int = 4, only: Iterable[str] | None = None, subjects: list[str] | None = None, params: dict[str, dict] | None = None) -> DataFrame:
    """Runs each detector as a job of its own and writes its anomalies below `at`, in a partition that a later run replaces. One that
    fails or takes longer than `timeout_s` is cancelled; the others go on. Returns detector_id, status (ok, failed, late), error, seconds."""
    number = f"sweep-{time.time_ns()}"

    def one(name: str, made: Callable[[], DataFrame]) -> None:
        spark.addTag(f"{number}-{name}")
        df = made().select("subject", "signal", F.col("confidence").cast("double").alias("confidence"), "severity")
        (df.where(F.col("subject").isin(subjects)) if subjects else df).write.mode("overwrite").parquet(f"{at}/detector_id={name}")

    def watched(name: str, made: Callable[[], DataFrame]) -> tuple[str, str, str | None, float]:
        begun, inner = time.monotonic(), ThreadPoolExecutor(1)
        try:
            inner.submit(inheritable_thread_target(spark)(one), name, made).result(timeout_s)
            status, error = "ok", None
        except Late:
            spark.interruptTag(f"{number}-{name}")
            status, error = "late", None
        except Exception as e:  # noqa: BLE001  (a detector of any kind may be registered)
            status, error = "failed", type(e).__name__
        inner.shutdown(wait=False, cancel_futures=True)
        return name, status, error, time.monotonic() - begun

    with files.shuffles_dropped(spark), files.settings(spark, KEPT_SPLITS):
        detectors_of, kept = _made(spark, sf_dir, only, params)
        with ThreadPoolExecutor(at_once) as pool:
            rows = list(pool.map(lambda x: watched(*x), sorted(detectors_of.items(), key=lambda x: x[0] not in FIRST)))
    files.discard(spark, *kept)
    return spark.createDataFrame(rows, "detector_id string, status string, error string, seconds double")


def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of every token."""
    return run(spark, scoring.TEXTS["r10_report"], Tables(spark, sf_dir))


def risk(spark: SparkSession, sf_dir: str, chain: str, token: str) -> DataFrame:
    return score(spark, sf_dir).where((F.col("chain") == chain) & (F.col("token") == token))


def events_page(spark: SparkSession, sf_dir: str, size: int = 50, cursor: tuple[int, int] | None = None, token: str | None = None, detector_id: str | None = None, least: float | None = None) -> tuple[list, tuple[int, int] | None]:
    """(rows, next cursor) of anomaly events, newest first; a cursor is the (time, id) of the last row of a page."""
    df = Tables(spark, sf_dir)("anomalies")
    for column, value in (("token", token), ("detector_id", detector_id)):
        if value is not None:
            df = df.where(F.col(column) == value)
    if least is not None:
        df = df.where(F.col("confidence") >= least)
    if cursor:
        t, i = cursor
        df = df.where((F.col("t") < t) | ((F.col("t") == t) & (F.col("id") < i)))
    rows = df.orderBy(F.col("t").desc(), F.col("id").desc()).limit(size + 1).collect()
    page = rows[:size]
    return page, ((page[-1].t, page[-1].id) if len(rows) > size else None)


def analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(spark, sf_dir, only=DETECTORS).groupBy("detector_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def analyzed_text(d=SPARK) -> str:
    parts = " UNION ALL ".join(f"SELECT detector_id, severity FROM ({text(d, **detectors.SCALED.get(k, {}))}) AS {k}" for k, (text, _) in DETECTORS.items())
    return f"SELECT detector_id, severity, count(*) AS n FROM ({parts}) AS x GROUP BY detector_id, severity"
