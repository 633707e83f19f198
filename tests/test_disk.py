"""What queries leave on disk: in the shared folder, and of their shuffles."""

import base64
import json
import os

import numpy as np
from pyspark.sql import functions as F

from tidewatch import api
from tidewatch.operators import sinks
from tidewatch.operators.sequences import RunLengths
from tidewatch.plans.dialect import Tables
from tidewatch.sources import files
from tidewatch.streaming import stateful

DATA = "/root/testdata/sf0.001"


def shuffled(spark):
    """Data files of shuffles that lie on the local disks."""
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {name for top in local for _, _, names in os.walk(str(top)) for name in names if name.startswith("shuffle_") and name.endswith(".data")}


def kept(spark):
    """Folders below the shared one."""
    at = f"{files.shared_folder(spark)}/tidewatch".removeprefix("file://")
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def test_insert_leaves_the_table_only(spark):
    folders, before = kept(spark), shuffled(spark)
    got = sinks.inserted_twice(spark, DATA)
    assert [name.split("-")[0] for name in kept(spark) - folders] == ["transfers"]
    assert shuffled(spark) <= before
    want = Tables(spark, DATA)("transfers").select(*sinks.FACT_KEY).distinct()
    assert got.select(*sinks.FACT_KEY).exceptAll(want).count() == want.exceptAll(got.select(*sinks.FACT_KEY)).count() == 0


def test_clustered_batch_is_inserted_as_it_lies(spark, tmp_path):
    """No shuffle, no more files than the batch has, rows of other partitions stay; null partition values too."""
    rows = spark.range(3000).select(F.when(F.col("id") % 5 != 0, (F.col("id") % 5).cast("string")).alias("part"), "id")
    batch, path = str(tmp_path / "batch"), str(tmp_path / "table")
    sinks.overwrite_partitions(rows, batch, ["part"], 3)
    sinks.overwrite_partitions(spark.createDataFrame([("1", -1), ("9", -9)], "part string, id long"), path, ["part"])
    before = shuffled(spark)
    for _ in range(2):
        sinks.replace_as_it_lies(spark.read.schema("id long, part string").parquet(batch), path, ["part"])
    assert shuffled(spark) <= before
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    got = spark.read.schema("id long, part string").parquet(path)
    assert got.count() == 3001 and got.where("part = '9'").first().id == -9
    assert rows.select("id", "part").exceptAll(got).count() == 0
    parts = [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len(parts) <= 5 * 3 + 1


def test_analyze_leaves_the_anomalies_only(spark, monkeypatch):
    """What detectors share is written once and deleted, and their shuffles go with them, those of one that fails too."""
    monkeypatch.setattr(api, "_EXTRA", {})
    api.register_detector("breaks", lambda t: t("transfers").groupBy("token").count().selectExpr("token AS subject", "'x' AS signal", "0.5 AS confidence", "CAST(raise_error('no') AS STRING) AS severity"))
    made = []
    keep = Tables.keep
    monkeypatch.setattr(Tables, "keep", lambda self, name: made.append(name) or keep(self, name))
    folders, before = kept(spark), shuffled(spark)
    got = api.analyze(spark, DATA, only=["pump_dump", "sybil_detection", "honeypot_sim", "permit2_drainer_v1", "breaks"])
    assert shuffled(spark) <= before
    assert got.skipped == ["breaks"] and got.count() > 0
    assert made == ["transfers", "smart_wallets"]
    assert [name.split("-")[0] for name in kept(spark) - folders] == ["analyze"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    made.clear()
    api.analyze(spark, DATA, only=["honeypot_sim"])
    assert made == []


def test_state_is_packed():
    """Numbers and waiting rows come back as they were, in less space than they took as JSON and base 64; states of before are read."""
    model = RunLengths()
    model.grow(1)
    for k in range(300):
        model.step(np.array([0]), np.array([0.3 + 0.2 * (k % 7) / 7]))
    plain = model.dumps(0)
    text = stateful.packed(plain)
    assert stateful.unpacked(text) == stateful.unpacked(base64.b64encode(plain).decode()) == plain
    assert len(text) < 0.85 * len(base64.b64encode(plain))
    rows = [(1000 + k, k, json.dumps({"deployer": f"s{k % 9}", "token": f"é{k}", "lp_total": 7 * k, "n": None}, ensure_ascii=False)) for k in range(2500)]
    chunks = [c for (c,) in stateful.InOrder()._chunks(rows)]
    want = [[t, seq, json.loads(body)] for t, seq, body in rows]
    old = f"[{','.join(f'[{t},{seq},{body}]' for t, seq, body in rows)}]"
    assert [r for c in chunks for r in stateful.InOrder._rows(c)] == stateful.InOrder._rows(old) == want
    assert sum(map(len, chunks)) < len(old) / 2


def test_replayed_stream_leaves_its_changes_only(spark):
    folders = kept(spark)
    got = stateful.watched_deployers(spark, DATA)
    (name,) = kept(spark) - folders
    assert os.listdir(f"{files.shared_folder(spark)}/tidewatch/{name}".removeprefix("file://")) == ["data"]
    assert got.count() == Tables(spark, DATA)("launches").count()
