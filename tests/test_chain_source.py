"""The chain source and the commit log: every event once over restarts, kills between steps, and injected reorgs."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import sinks
from tidewatch.sources import chain, commits
from tidewatch.streaming import reorg


def events(spark, rows):
    """(chain, height, position, kind) as events."""
    made = spark.createDataFrame(rows, "chain string, block_height long, position long, kind string")
    return made.select("*", F.concat(F.lit("x"), "position").alias("tx_hash"), F.lit("tok").alias("token"), F.concat(F.lit("a"), F.col("position") % 3).alias("address"), F.col("position").alias("t"), F.lit(1).cast("long").alias("cents"))


def random_events(seed, n):
    """Two chains that grow by blocks and now and then go back by some."""
    rng, heights, rows = random.Random(seed), {"a": 0, "b": 100}, []
    for position in range(n):
        c = rng.choice("ab")
        if rng.random() < 0.08:
            heights[c] -= rng.randrange(1, 12)
            rows.append((c, heights[c], position, "reorg"))
        else:
            heights[c] += rng.random() < 0.5
            rows.append((c, heights[c], position, rng.choice(("swap", "transfer"))))
    return rows


def survivors(rows):
    live = []
    for c, h, p, kind in rows:
        if kind == "reorg":
            live = [r for r in live if r[0] != c or r[1] < h]
        else:
            live.append((c, h, p, kind))
    return sorted(r[2] for r in live)


def positions(df):
    return sorted(r.position for r in df.select("position").collect())


def test_backfill_and_filters(spark, tmp_path):
    archive = commits.CommitTable(spark, f"file://{tmp_path}/archive")
    rows = [("a", k // 4, k, "swap" if k % 2 else "transfer") for k in range(200)]
    for k in (0, 100):
        chain.publish(archive, events(spark, rows[k : k + 100]).repartition(3))
    assert chain.tip(archive.path) == {"a": 49}
    assert positions(chain.backfill(spark, archive.path, 10, 12)) == list(range(40, 52))
    some = chain.backfill(spark, archive.path, 10, 40, kinds="swap").where("address IN ('a1', 'a2') AND block_height < 30 AND block_height >= 11 AND position > 50 AND cents = 1")
    assert positions(some) == [k for k in range(200) if k % 2 and k % 3 and 11 <= k // 4 < 30 and k > 50]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "= 1)" in plan and "< 30" not in plan and "> 50" not in plan  # only the filter on cents is left to Spark
    assert chain.backfill(spark, archive.path, 0, 49, chains="b").count() == 0
    reader = chain.Backfill(archive.path, chain.Wanted(from_block=40))
    assert len(reader.partitions()) == 1  # the first commit ends below
    with pytest.raises(ValueError, match="grow"):
        chain.publish(archive, events(spark, rows[:5]))


def test_tail_resumes(spark, tmp_path):
    """Backfill plus tail of one archive, with a restart after each commit and one without news: each event once."""
    archive = commits.CommitTable(spark, f"file://{tmp_path}/archive")
    rows, out = [(f"c{k % 2}", k, k, "swap") for k in range(90)], f"{tmp_path}/out"
    chain.publish(archive, events(spark, rows[:30]))
    old = positions(chain.backfill(spark, archive.path, 0, 10**9))

    def tail():
        reorg.drain(chain.subscribe(spark, archive.path, after=29), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "run"))

    tail()
    for k in (30, 60):
        chain.publish(archive, events(spark, rows[k : k + 30]))
        tail()
        tail()
    assert old + positions(spark.read.parquet(out)) == list(range(90))


def test_commits(spark, tmp_path):
    table = commits.CommitTable(spark, f"file://{tmp_path}/t")
    assert table.state().version == -1
    with pytest.raises(LookupError):
        table.read()
    state = table.state()
    for k in range(2 * commits.SNAPSHOT + 3):
        add = [table.stage(events(spark, [("a", k, k, "swap")]))] if k % 20 == 0 else []
        state = table.commit(state, add, batches={"w": k}, reached={"a": {"position": k}})
        assert commits.load(table.path) == state
    assert len(state.parts) == 4 and state.batches == {"w": k} and positions(table.read()) == [0, 20, 40, 60]
    with pytest.raises(RuntimeError, match="another writer"):
        table.commit(commits.State(3), [])
    table.stage(events(spark, [("a", 1, 1, "swap")]))
    assert table.stage(events(spark, [("a", 1, 1, "swap")]).limit(0)) is None
    assert table.vacuum() == 2 and table.read().count() == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_reorgs_over_batches_and_kills(spark, tmp_path, monkeypatch, seed):
    """Injected reorgs, batches of any cut, and a kill before, within or after a commit: what is left is the batch result."""
    rows = random_events(seed, 160)
    archive, table = (commits.CommitTable(spark, f"file://{tmp_path}/{n}") for n in ("archive", "table"))
    cuts = [0, 50, 51, 110, 160]
    steps = {1: "stage", 2: "commit", 3: "after"}
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        chain.publish(archive, events(spark, rows[lo:hi]))
        run = lambda: reorg.follow(spark, chain.subscribe(spark, archive.path), table, str(tmp_path / "run"))
        if k in steps:
            with monkeypatch.context() as m:
                real_stage, real_commit = commits.CommitTable.stage, commits.CommitTable.commit

                def dies(self, *a, _real=real_stage if steps[k] == "stage" else real_commit, _at=steps[k], **b):
                    if _at == "after":
                        _real(self, *a, **b)
                    raise OSError("killed")

                m.setattr(commits.CommitTable, "stage" if steps[k] == "stage" else "commit", dies)
                with pytest.raises(Exception, match="killed"):
                    run()
        run()
        assert positions(table.read()) == survivors(rows[:hi])
    reached = table.state().reached
    assert {c: r["position"] for c, r in reached.items()} == {c: max(p for d, _, p, _ in rows if d == c) for c in "ab"}
    before = positions(table.read())
    table.vacuum()
    assert positions(table.read()) == before


def test_rewound_height(spark, tmp_path):
    table = commits.CommitTable(spark, f"file://{tmp_path}/t")
    reorg.apply_batch(table, "w", events(spark, [("a", 5, 0, "swap"), ("a", 6, 1, "swap"), ("b", 9, 2, "swap")]), 0)
    reorg.apply_batch(table, "w", events(spark, [("a", 6, 3, "reorg")]), 1)
    assert positions(table.read()) == [0, 2] and table.state().reached["a"] == {"position": 3, "height": 5}
    reorg.apply_batch(table, "w", events(spark, [("a", 5, 4, "swap")]), 1)  # a batch that is done
    assert positions(table.read()) == [0, 2]


def test_without_reorged_by_hand(spark):
    rng = random.Random(9)
    rows = [(rng.choice(("a", "b", None)), rng.choice((None, rng.randrange(-20_000, 20_000))), rng.choice((None, rng.randrange(100))), k) for k in range(800)]
    cuts = [(rng.choice(("a", "b", "c", None)), rng.randrange(-20_000, 20_000), rng.choice((None, rng.randrange(100)))) for _ in range(25)]
    got = sinks.without_reorged(spark.createDataFrame(rows, "chain string, block_height long, seen_at long, k long"), spark.createDataFrame(cuts, "chain string, from_height long, reorg_at long"))
    void = lambda c, h, s: any(c is not None and c == d and h is not None and s is not None and at is not None and h >= low and s < at for d, low, at in cuts)
    assert got.columns == ["chain", "block_height", "seen_at", "k"]
    assert sorted(r.k for r in got.collect()) == [k for c, h, s, k in rows if not void(c, h, s)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__bucket" in [line for line in plan.split("\n") if "Join LeftOuter" in line][0]
