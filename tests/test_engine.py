"""Unit tests of what SQL does not express, and invariances of what it does."""

import itertools
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch import api, catalog
from tidewatch.functions import exprs
from tidewatch.operators import detectors, graph, sequences, sinks, smart_money
from tidewatch.plans.dialect import Tables, run
from tidewatch.sources import evm, files, solana
from tidewatch.streaming import jobs

DATA = "/root/testdata/sf0.001"


def test_selectors_and_checksums():
    assert evm.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert evm.selector("Transfer(address,address,uint256)") == "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    assert evm.checksum_address("0x5aaeb6053f3e94c9b9a09f33669435e7ef1beaed") == "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed"
    assert solana.discriminator("swap_base_input") == "8fbe5adac41e33de"


def test_words(spark):
    values = [0, 1, 10**20, 10**37, 2**128, 2**256 - 1]
    rows = [(str(v), f"{v:064x}") for v in values]
    got = {r.v: r for r in spark.createDataFrame(rows, "v string, w string").select("v", evm.as_signed(F.col("w"), F.lit(False)).alias("u"), evm.as_signed(F.col("w"), F.lit(True)).alias("s")).collect()}
    assert [int(got[str(v)].u) for v in values[:4]] == values[:4]
    assert got[str(2**128)].u is None and got[str(2**256 - 1)].u is None
    assert int(got[str(2**256 - 1)].s) == -1


def test_words_of_any_size(spark):
    rng = random.Random(3)
    values = [0, 1, 10**18 - 1, 10**18, 2**128, 2**255, 2**256 - 1] + [rng.randrange(1 << rng.randrange(1, 257)) for _ in range(40)]
    got = spark.createDataFrame([(str(v), f"{v:064x}") for v in values], "v string, w string").select("v", evm.as_text(F.col("w")).alias("t")).collect()
    assert all(r.v == r.t for r in got)


def test_every_event_at_zero_and_negative_amounts(spark):
    """Words of all 19 kinds, encoded here by Python's integers."""
    rows, want = [], {}
    for k, (kind, (signature, fields)) in enumerate(evm.EVENTS.items()):
        for amount in (0, 7, 10**20):
            words, places = [0] * 5, dict(fields.values())
            for n in range(5):
                words[n] = {"address": 0xABC0 + n, "int": -amount - n if amount else 0}.get(places.get(f"d{n}", ""), amount + n)
            name = f"{kind}-{amount}"
            rows.append((name, [evm.selector(signature)] + ["0x" + f"{0xDEF0 + t:064x}" for t in (1, 2, 3)], "0x" + "".join(f"{w % 2**256:064x}" for w in words)))
            for field, (place, type_) in fields.items():
                n = int(place[1:])
                value = words[n] if place[0] == "d" else 0xDEF0 + n
                want[name, field] = "0x" + f"{value:040x}" if type_ == "address" else value
    got = {r.k: r for r in evm.decode_logs(spark.createDataFrame(rows, "k string, topics array<string>, data string")).collect()}
    names = {"from": "from_address", "to": "to_address"}
    for (name, field), value in want.items():
        assert got[name][names.get(field, field)] == value, (name, field)
        assert got[name].event == name.rsplit("-", 1)[0]
    cut = evm.decode_logs(spark.createDataFrame([("k", rows[0][1], rows[0][2][:-1])], "k string, topics array<string>, data string")).first()
    assert cut.event == "transfer" and cut.amount is None and cut.amount_text is None


def test_dynamic_abi_that_is_cut_off(spark):
    word = lambda n: f"{n:064x}"
    text = word(2) + b"hi".hex().ljust(64, "0")
    rows = [("good", "0x" + word(64) + word(1) + text), ("empty", "0x" + word(64) + word(0) + word(0)), ("offset", "0x" + word(9999) + word(1) + text), ("length", "0x" + word(64) + word(1) + word(200)), ("huge", "0x" + word(2**200) + word(7)), ("none", "0x"), (None, None)]
    df = spark.createDataFrame(rows, "k string, data string")
    got = {r.k: (r.s, r.f) for r in df.select("k", *[c.alias(n) for n, c in zip("sf", evm.decode_abi(F.col("data"), ["string", "bool"]), strict=True)]).collect()}
    assert got == {"good": ("hi", True), "empty": ("", False), "offset": (None, True), "length": (None, True), "huge": (None, None), "none": (None, None), None: (None, None)}


def test_age_attenuation_is_linear(spark):
    from tidewatch.operators import scoring

    df = spark.createDataFrame([(a,) for a in (0, 7, 48, 90, 400)], "age_days int").selectExpr("*", "false AS jup_strict", "false AS jup_verified")
    text = scoring.attenuation(1.2, 0.4).replace(scoring.established(), "false")
    assert [round(r[0], 6) for r in df.selectExpr(text).collect()] == [1.2, 1.2, round(1.2 - 41 / 83 * 0.8, 6), 0.4, 0.4]


def test_unknown_and_short_logs(spark):
    rows = [(["0x" + "11" * 32], "0x"), (None, None), ([evm.selector(evm.EVENTS["transfer"][0])], "0x12")]
    got = evm.decode_logs(spark.createDataFrame(rows, "topics array<string>, data string")).collect()
    assert [r.event for r in got] == [None, None, "transfer"] and all(r.amount is None for r in got)


def test_extensions_of_damaged_streams(spark):
    head = "00" * solana.TLV_OFFSET
    rows = [("empty", head), ("short", "00" * 10), ("cut", head + "0900" + "ff00" + "00"), ("two", head + "09000000" + "0e000100" + "aa" + "00" * 8)]
    got = {r.k: r for r in solana.decode_extensions(spark.createDataFrame(rows, "k string, data string")).collect()}
    assert got["two"].non_transferable and got["two"].transfer_hook
    assert not any(got[k].non_transferable for k in ("empty", "short", "cut"))


def test_extensions_are_walked_once(spark):
    """Null data have no extensions, and the flags share one walk over data that are worked out once."""
    made = spark.createDataFrame([("two", "09000000" + "0e000100" + "aa" + "00" * 8), ("null", None)], "k string, tail string")
    df = solana.decode_extensions(made.select("k", F.concat(F.lit("00" * solana.TLV_OFFSET), "tail").alias("data")))
    got = {r.k: [r[name] for name in solana.EXTENSIONS.values()] for r in df.collect()}
    assert got == {"two": [False, False, True, False, True], "null": [False] * 5}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and plan.count("00" * solana.TLV_OFFSET) <= 1


def test_neighbour_pairs_by_sets_equal_sql(spark):
    """Wallets meet by their sets of buckets: pairs are never grouped, so they are not shuffled."""
    want = run(spark, sequences.bucket_pairs, Tables(spark, DATA.replace("0.001", "0.01")))
    got = sequences.neighbour_pairs(spark, DATA.replace("0.001", "0.01"))
    assert want.count() == got.count() > 0 and not want.exceptAll(got).count()
    last = got._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
    assert "Aggregate" not in last


def test_components_of_a_long_chain():
    """Linear in the edges: a chain of 100,000 nodes has as many components, and one ring at its end."""
    n = 100_000
    out = {k: {k + 1} for k in range(n)}
    out[n] = {n - 2}
    parts = graph.components(set(range(n + 1)), out)
    assert len(parts) == n - 1 and [sorted(p) for p in parts if len(p) > 1] == [[n - 2, n - 1, n]]


def test_scalar_columns_equal_sql(spark):
    df = spark.range(50).select((F.col("id") / 40).alias("x"))
    got = df.select("x", exprs.severity_col(F.col("x")).alias("a"), F.expr(exprs.severity("x")).alias("b"), exprs.sigmoid_col(F.col("x")).alias("c"), F.expr(exprs.sigmoid("x")).alias("d"), exprs.clamp_col(F.col("x"), 0.2, 0.9).alias("e"), exprs.decay_col(F.col("x") - 0.1, 72).alias("f")).collect()
    for r in got:
        assert r.a == r.b and math.isclose(r.c, r.d) and 0.2 <= r.e <= 0.9 and r.f == (0 if r.x < 0.1 else pytest.approx(math.exp(-(r.x - 0.1) * math.log(2) / 72)))
    assert [r.a for r in got if r.x in (0.0, 0.2, 0.4, 0.6, 0.8)] == ["info", "low", "medium", "high", "critical"]


def test_cycles_by_brute_force():
    rng = random.Random(1)
    for _ in range(30):
        edges = {(a, b): 1 for a, b in itertools.permutations(range(7), 2) if rng.random() < 0.25}
        big = {x for part in graph.components({v for e in edges for v in e}, {a: {b for x, b in edges if x == a} for a, _ in edges}) if len(part) > 2 for x in part}
        want = {p for k in range(2, 6) for p in itertools.permutations(range(7), k) if p[0] == min(p) and set(p) <= big and all((a, b) in edges for a, b in zip(p, (*p[1:], p[0]), strict=True))}
        assert set(graph.elementary(edges)) == want
    ring = {(1, 2): 1, (2, 3): 1, (3, 1): 1}
    assert graph.elementary(ring) == [(1, 2, 3)] and graph.elementary(ring, cap=0) == []
    assert graph.elementary({(1, 2): 1, (2, 1): 1}) == []


def test_dbscan():
    same, other = frozenset({1, 2, 3, 4}), frozenset({9})
    assert sequences.dbscan([same] * 4 + [other], 0.3, 3) == [0, 0, 0, 0, -1]
    assert sequences.dbscan([], 0.3, 3) == []


def clusters_by_hand(near, least):
    label, found = {}, 0
    for i in range(len(near)):
        if i in label or len(near[i]) < least:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = found
                todo += near[j] if len(near[j]) >= least else []
        found += 1
    return [label.get(i, -1) for i in range(len(near))]


def test_dbscan_of_weighted_sets():
    rng = random.Random(4)
    for _ in range(40):
        sets = [frozenset(rng.sample(range(5), rng.randrange(1, 5))) for _ in range(rng.randrange(1, 40))]
        near = [[j for j, y in enumerate(sets) if 1 - len(x & y) / len(x | y) <= 0.3] for x in sets]
        want = clusters_by_hand(near, 4)
        assert sequences.dbscan(sets, 0.3, 4) == want
        distinct = list(dict.fromkeys(sets))
        label = dict(zip(distinct, sequences.dbscan(distinct, 0.3, 4, [sets.count(x) for x in distinct]), strict=True))
        assert [label[x] for x in sets] == want


def test_synchronised_clusters_all_buyers(spark):
    """Three clusters, 1,300 wallets: the last of them buys after more than 500 others."""
    rows = [("tok", f"w{k:04}", "buy", 21600 + 3600 * (k // 500) + k % 7, f"x{k:04}") for k in range(1300)]
    rows += [("tok", "late", "buy", 21600 + 21000, "y"), ("tok", "sells", "sell", 21600, "z")]
    legs = spark.createDataFrame(rows, "token string, wallet string, leg string, t long, tx_hash string")
    got = sorted(sequences.synchronised(legs).collect(), key=lambda r: r.wallets)
    assert [r["size"] for r in got] == [500, 500, 300]
    assert [r.wallets for r in got] == [",".join(f"w{k:04}" for k in range(a, min(a + 500, 1300))) for a in (0, 500, 1000)]
    for r in got:
        chance = (1 - math.exp(-1301 / 21600 * 1800)) ** r["size"]
        assert r.window_no == 1 and r.tightness == pytest.approx(1 - 6 / 1800) and r.chance == pytest.approx(chance)
        assert r.confidence == pytest.approx(min(0.9, 0.4 / (1 + math.exp(-(r["size"] - 5) / 5)) + 0.3 * r.tightness + 0.3 * (1 - chance)))


def test_synchronised_by_the_default_parameters(spark):
    """Six wallets within 3 s, in the third of three busy windows; the same burst in a token without history is skipped."""
    at = 600 * 3000
    burst = [(token, f"w{k}", "buy", at + k // 2, f"x{k}") for token in ("old", "new") for k in range(6)]
    before = [("old", f"b{k}", "buy", at - 600 * 100 * (1 + k % 2) + k, f"y{k}") for k in range(12)] + [("old", "b", "buy", at - 8 * 86_400, "z")]
    legs = spark.createDataFrame(burst + before, "token string, wallet string, leg string, t long, tx_hash string")
    (r,) = sequences.synchronised(legs, sequences.Synchrony()).where(f"window_no = {at // 600}").collect()
    chance = (1 - math.exp(-12 / 604_800 * 30)) ** 6
    assert (r.token, r["size"], r.wallets) == ("old", 6, "w0,w1,w2,w3,w4,w5")
    assert r.tightness == pytest.approx(1 - 2 / 30) and r.chance == pytest.approx(chance) and chance < 1e-6
    assert r.confidence == pytest.approx(0.4 / (1 + math.exp(-1 / 5)) + 0.3 * r.tightness + 0.3 * (1 - chance / 1e-6))
    (a,) = sequences.synchrony_anomalies(sequences.synchronised(legs, sequences.Synchrony()).where(f"window_no = {at // 600}")).collect()
    assert (a.subject, a.severity) == ("old", "critical" if r.confidence >= 0.8 else "high")


def test_change_point_anomalies(spark):
    rows = [("d", "a", 6, 0.1, 0.6, 0.7, 0, 9), ("d", "b", 7, 0.1, 0.0033, 0.75, 1, 6), ("d", "c", 8, 0.1, 0.0033, 0.75, 1, 2), ("d", "e", 5, 0.1, 0.9, 0.9, 1, 9), ("d", "f", 9, 0.1, 0.0033, 0.4, 1, 9)]
    points = spark.createDataFrame(rows, "deployer string, token string, nth long, score double, cp_prob double, p_short double, run_mode int, run_drop int")
    got = [(r.token, r.signal, r.confidence, r.severity) for r in sequences.change_point_anomalies(points).orderBy("nth").collect()]
    assert got == [("a", "changepoint", 0.6, "high"), ("b", "run_reset", 0.75, "high")]


def test_change_points_mass():
    rng = np.random.default_rng(2)
    model = sequences.ChangePoints()
    for x in rng.normal(0.2, 0.02, 60):
        cp, _, mode = model.step(float(x))
        assert cp == pytest.approx(sequences.HAZARD, rel=1e-6)  # by its algebra, whatever the input
    assert mode > 40
    for x in rng.normal(0.9, 0.02, 6):
        _, short, mode = model.step(float(x))
    assert mode < 10
    assert np.exp(model.log_mass).sum() == pytest.approx(1)


def test_change_points_of_a_long_steady_run(spark):
    """The longest run keeps its mass, however long it becomes."""
    model, before = sequences.ChangePoints(), 0
    scores = np.random.default_rng(5).normal(0.3, 0.05, 900)
    for k, x in enumerate(scores, 1):
        cp, _, mode = model.step(float(x))
        assert cp == pytest.approx(sequences.HAZARD, rel=1e-6)
        assert mode == before + 1 or k < 20
        before = mode
    assert mode > 880
    rows = spark.createDataFrame([("d", f"t{k}", k, float(x)) for k, x in enumerate(scores)], "deployer string, token string, nth long, score double")
    assert all(r.run_drop == 0 for r in sequences.change_points(rows).where("nth >= 20").collect())


def test_fifo_drops_sells_without_inventory(spark):
    rows = [("w", "t", "sell", 1, 0, "a", 100, 2), ("w", "t", "buy", 2, 1, "b", 300, 3), ("w", "t", "sell", 3, 2, "c", 500, 2), ("w", "t", "sell", 4, 3, "d", 500, 5), ("w", "t", "buy", 5, 4, "e", 100, 1), ("w", "t", "sell", 6, 5, "f", 400, 1)]
    legs = spark.createDataFrame(rows, "wallet string, token string, leg string, t long, seq long, tx_hash string, cents long, qty long")
    exact = sorted((r.buy_t, r.sell_t, r.qty) for r in smart_money.fifo(legs).collect())
    assert exact == [(2, 3, 2), (2, 4, 1), (5, 6, 1)]
    text = run(spark, smart_money.fifo_summary, Tables(spark, DATA, {"legs": legs}))
    assert sorted((r.buy_t, r.sell_t, r.qty) for r in text.collect()) == exact


def test_upserts(spark):
    old = spark.createDataFrame([("a", 5, 1.0), ("b", 5, 1.0)], "k string, v long, x double")
    new = spark.createDataFrame([("a", 5, 2.0), ("b", 6, 2.0), ("c", 1, 2.0)], "k string, v long, x double")
    assert {r.k: r.x for r in sinks.newest_wins(old, new, ["k"], "v").collect()} == {"a": 1.0, "b": 2.0, "c": 2.0}
    old = spark.createDataFrame([("a", 0.9, 40), ("b", 0.9, 1), ("c", 0.5, 1)], "k string, c double, age int")
    new = spark.createDataFrame([("a", 0.1, 0), ("b", 0.8, 0), ("c", 0.5, 0)], "k string, c double, age int")
    assert {r.k: r.age for r in sinks.confident_wins(old, new, ["k"], "c", F.col("age") > 30).collect()} == {"a": 0, "b": 1, "c": 0}


def test_verdict_cache(spark):
    kind = "chain string, token string, detector_id string, confidence double, cached_at long, expires_at long"
    cache = spark.createDataFrame([("s", "a", "d", 0.9, 1, 5), ("s", "b", "d", 0.5, 1, 9), ("e", "a", "d", 0.2, 1, None)], kind)
    new = spark.createDataFrame([("s", "a", "d", 0.1, 2, 8), ("s", "a", "d", 0.3, 3, 7), ("s", "c", "d", 0.4, 2, 4)], kind)
    after = sinks.with_verdicts(cache, new)
    assert sorted((r.chain, r.token, r.confidence) for r in after.collect()) == [("e", "a", 0.2), ("s", "a", 0.3), ("s", "b", 0.5), ("s", "c", 0.4)]
    assert [r.confidence for r in sinks.cached_verdicts(after, spark.createDataFrame([("s", "c", "d"), ("s", "x", "d")], "chain string, token string, detector_id string")).collect()] == [0.4]
    assert sorted((r.chain, r.token) for r in sinks.without_expired(after, F.lit(7)).collect()) == [("e", "a"), ("s", "a"), ("s", "b")]
    assert sinks.with_verdicts(after, new.limit(0)).count() == 4


def test_repeated_batches_change_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 10), (2, "y", 20)], "id int, part string, v int")
    for _ in range(2):
        sinks.overwrite_partitions(df, str(tmp_path / "t"), ["part"])
    sinks.overwrite_partitions(df.where("part = 'x'").withColumn("v", F.lit(11)), str(tmp_path / "t"), ["part"])
    assert {(r.id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, 11), (2, 20)}


def test_one_token_equals_whole_table(spark):
    whole = run(spark, detectors.concentration, Tables(spark, DATA))
    tables = Tables(spark, DATA)
    some = Tables(spark, DATA, {"balances": tables("balances").where("token IN ('t1', 't2', 't3')")})
    few = run(spark, detectors.concentration, some)
    assert sorted(map(tuple, whole.where("token IN ('t1', 't2', 't3')").collect())) == sorted(map(tuple, few.collect()))


def test_order_and_partitions_do_not_matter(spark):
    text = detectors.TEXTS["d04_pump_dump"]
    plain = run(spark, text, Tables(spark, DATA)).collect()
    events = spark.read.parquet(f"{DATA}/events.parquet").orderBy(F.rand(3)).repartition(7)
    assert sorted(map(tuple, run(spark, text, Tables(spark, DATA, {"events": events})).collect())) == sorted(map(tuple, plain))


def test_events_page(spark):
    seen, cursor = [], None
    for _ in range(40):
        page, cursor = api.events_page(spark, DATA, 150, cursor, least=0.2)
        seen += [(r.t, r.id) for r in page]
        if cursor is None:
            break
    assert seen == sorted(seen, reverse=True) and len(seen) == len(set(seen)) == Tables(spark, DATA)("anomalies").where("confidence >= 0.2").count()


def test_detectors_are_isolated_and_can_be_added(spark, monkeypatch):
    monkeypatch.setattr(api, "_EXTRA", {})

    def broken(tables):
        raise ValueError("no")

    api.register_detector("broken", broken)
    api.register_detector("own", lambda t: t("tokens").selectExpr("token AS subject", "'own' AS detector_id", "'x' AS signal", "CAST(0.5 AS DOUBLE) AS confidence", "'medium' AS severity"))
    got = api.analyze(spark, DATA, ["t1"])
    assert {"own"} <= {r.detector_id for r in got.collect()} and "own" in api.list_detectors()


def test_sweep_goes_on_after_failures(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(api, "_EXTRA", {})
    rows = "token AS subject", "'own' AS detector_id", "'x' AS signal", "CAST(0.5 AS DOUBLE) AS confidence"
    api.register_detector("own", lambda t: t("tokens").selectExpr(*rows, "'medium' AS severity"))
    api.register_detector("breaks", lambda t: t("tokens").selectExpr(*rows, "CAST(raise_error('no') AS STRING) AS severity"))
    api.register_detector("stalls", lambda t: t("tokens").selectExpr(*rows, "CAST(reflect('java.lang.Thread', 'sleep', 40000L) AS STRING) AS severity"))
    for names in (["breaks", "own", "stalls"], ["own"]):
        got = {r.detector_id: r.status for r in api.sweep(spark, DATA, str(tmp_path / "out"), 20, only=names).collect()}
        assert got == {k: {"own": "ok", "breaks": "failed", "stalls": "late"}[k] for k in names}
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.where("detector_id = 'own'").count() == Tables(spark, DATA)("tokens").count()


def test_windows_are_written_once_and_closed_by_the_watermark(spark, tmp_path):
    """Two files a week apart: the first run closes what the watermark has passed, the restarted one the rest, none twice."""
    events = spark.read.parquet(f"{DATA}/events.parquet")
    early = events.selectExpr("min(ts) AS t").first().t
    for k in range(2):
        events.limit(40).withColumn("ts", F.lit(early) + F.expr(f"make_dt_interval({7 * k})")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    seen = jobs.closed(lambda e: e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")), spark, str(tmp_path), str(tmp_path / "at"), "1 day")
    assert seen.groupBy("window", "event_type").count().where("count > 1").count() == 0
    assert seen.agg(F.sum("n")).first()[0] == 80 and seen.select("window").distinct().count() == 2


def test_filters_and_columns_reach_the_scan(spark):
    plan = run(spark, lambda d: "SELECT token, count(*) AS n FROM {swaps} GROUP BY token", Tables(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    assert "props" not in re.search(r"ReadSchema: (.*)", plan)[1]
    assert "event_type" in re.search(r"PushedFilters: \[(.*?)\]", plan)[1]


def test_schemas(spark, tmp_path):
    for name in files.SCHEMAS:
        assert len(files.schema(name)) == len(files.SCHEMAS[name])
    spark.createDataFrame([], files.schema("swaps")).write.parquet(str(tmp_path / "s"))
    assert files.read_events(spark, str(tmp_path / "s"), "swaps", chain="solana").count() == 0


def test_names_are_unique_and_oracles_parse():
    assert len(catalog.QUERIES) > 150
    assert all(made and (sql is None or "{" not in sql) for made, sql in catalog.QUERIES.values())
    assert pd.Series(list(catalog.QUERIES)).is_unique


AS_OF = 1000 * 86_400


def swap(token, sender, side, t, seq, cents, pool="p", height=0):
    return ("solana", pool, token, side, t, height, seq, f"x{seq}", sender, cents)


def swaps_of(spark, rows):
    return spark.createDataFrame(rows, "chain string, pool string, token string, side string, t long, block_height long, seq long, tx_hash string, sender string, cents long")


def test_pump_and_dump_by_hand(spark):
    """Six days of 100 dollars and one of 10, then 300 and 390 dollars in the last hour: A by 7.918 times the average day and 30 %."""
    past = [swap("k", "w1", "buy", AS_OF - n * 86_400 - 9, n, 10_000) for n in range(1, 7)]
    hour = [swap("k", "u1", "buy", AS_OF - 900, 50, 30_000), swap("k", "w1", "sell", AS_OF - 300, 51, 39_000)]
    early = [swap("k", "smart", "buy", AS_OF - 5400, 40, 1_000)]
    quiet = [swap("q", "u2", "buy", AS_OF - n * 86_400 - 9, 100 + n, 10_000) for n in range(7)]

    def found(wallets, graduated):
        tables = {
            "swaps": swaps_of(spark, past + hour + early + quiet),
            "smart_wallets": spark.createDataFrame(wallets, "wallet string, tier int"),
            "graduations": spark.createDataFrame(graduated, "token string, graduated_t long"),
        }
        made = run(spark, lambda d: detectors.pump_dump(d, as_of=AS_OF), Tables(spark, DATA, tables))
        return {r.token: r for r in made.collect()}

    plain = found([("other", 1)], [("k", AS_OF - 200 * 3600)])
    assert plain["k"].signal == "A" and plain["k"].volume_ratio == pytest.approx(69_000 / (61_000 / 7), abs=1e-6) and plain["k"].price_change == pytest.approx(0.3)
    # clamped to 0.60; the only insider sold 390 of 600 dollars: 0.15 more
    assert plain["k"].confidence == pytest.approx(0.75) and plain["k"].severity == "high"
    assert plain["q"].signal == "B" and plain["q"].confidence == pytest.approx(0.5 + 0.30 / 0.10 * 0.25, abs=0.01) or plain["q"].signal == "none"
    assert found([("smart", 1)], [("x", 0)])["k"].confidence == pytest.approx(0.87)
    assert found([("smart", 2)], [("x", 0)])["k"].confidence == pytest.approx(0.75)
    assert found([("smart", 1)], [("k", AS_OF - 100 * 3600)])["k"].confidence == pytest.approx(0.87 * 1.05)
    assert found([("smart", 1)], [("k", AS_OF - 60)])["k"].confidence == pytest.approx(0.95)
    assert found([("smart", 1)], [("k", AS_OF + 60)])["k"].confidence == pytest.approx(0.87)


def test_round_trips_by_hand(spark):
    """Legs at most 25 blocks apart, over the borders of the spans, each pair once."""
    rng = __import__("random").Random(5)
    rows = [swap("k", f"w{rng.randrange(3)}", rng.choice(["buy", "sell"]), 0, i, rng.choice([1000, 1009, 1020, 5000]), f"p{rng.randrange(2)}", rng.randrange(200)) for i in range(300)]
    want = sorted(
        (a[7], b[7]) for a in rows for b in rows
        if a[1] == b[1] and a[8] == b[8] and a[3] != b[3] and 0 < b[5] - a[5] <= 25 and abs(a[9] - b[9]) <= 0.01 * max(a[9], b[9])
    )
    got = run(spark, detectors.round_trips, Tables(spark, DATA, {"swaps": swaps_of(spark, rows)}))
    assert want and sorted((r.first_tx, r.second_tx) for r in got.collect()) == want


def test_wash_trading_by_hand(spark):
    """Three round trips of 1000 dollars each side, by one wallet that makes all the volume of its pool; a ring of 2000 dollars."""
    rows = [swap("k", "w", side, 0, 2 * n + (side == "sell"), 100_000, "p", 1000 * n + (5 if side == "sell" else 0)) for n in range(3) for side in ("buy", "sell")]
    edges = [("k", 0, "a", "b", 200_000, 10, 20), ("k", 0, "b", "c", 300_000, 15, 25), ("k", 0, "c", "a", 250_000, 30, 40), ("k", 0, "c", "d", 250_000, 30, 40)]
    tables = {"swaps": swaps_of(spark, rows), "trade_edges": spark.createDataFrame(edges, "token string, bucket long, src string, dst string, cents long, first_t long, last_t long")}
    a, b = sorted(run(spark, detectors.wash_trading, Tables(spark, DATA, tables)).collect(), key=lambda r: r.signal)
    assert (a.subject, a.sender, a.trips, a.wash_usd, a.usual_gap, a.share) == ("p", "w", 3, 6000.0, 5, 1.0)
    assert a.confidence == pytest.approx(0.60 + 0.10 * math.log(12), abs=1e-6) and a.severity == "critical"
    assert (b.subject, b.trips, b.wash_usd) == ("k", 1, 2000.0) and b.confidence == pytest.approx(0.48)


def test_sybil_by_hand(spark):
    """Three of the four members of a cluster hold the token; one of them is a smart wallet of the first tier."""
    tables = {
        "balances": spark.createDataFrame([("solana", "k", f"c{n}", 10 + n) for n in range(1, 4)], "chain string, token string, holder string, balance long"),
        "members": spark.createDataFrame([("solana", f"c{n}", "x", 4, 0.8) for n in range(1, 5)], "chain string, wallet string, cluster_id string, size long, confidence double"),
    }
    base = (0.40 + 0.40 * 0.75) * (0.50 + 0.50 * 0.8)
    for tiers, more in (([("u1", 1)], 0.10), ([("u1", 2)], 0.0), ([("u1", 2), ("u4", 2)], 0.05), ([("u9", 1)], 0.0)):
        tables["smart_wallets"] = spark.createDataFrame(tiers, "wallet string, tier int")
        (r,) = run(spark, detectors.sybil, Tables(spark, DATA, tables)).collect()
        assert (r.held, r.size) == (3, 4) and r.confidence == pytest.approx(base + more, abs=1e-6)


def test_withheld_composite_by_hand(spark):
    """Fees drawn with and without a change of authority; an established token that drew little of its volume is spared, if asked."""
    hour = 3600

    def draw(mint, n, cents, authority="a"):
        return [("solana", mint, f"{mint}{k}", k, AS_OF - (k + 1) * hour, "withdraw_withheld", authority, "x", cents, cents, "x") for k in range(n)]

    def turn(mint, ago, to):
        return ("solana", mint, f"{mint}r{ago}", 9, AS_OF - ago, "set_authority", "a", to, 1, 1, to)

    rows = draw("plain", 3, 100_000) + draw("both", 3, 100_000) + draw("most", 9, 10_000_000) + draw("known", 2, 50_000) + draw("dry", 2, 50_000) + draw("new", 2, 50_000)
    rows += [turn("both", hour, "old"), turn("most", hour, "fresh"), turn("most", 5 * hour, "old"), turn("known", hour, "old"), turn("late", -hour, "old")]
    tables = {
        "instructions": spark.createDataFrame(rows, "chain string, mint string, tx_hash string, log_index int, t long, kind string, authority string, destination string, amount long, cents long, new_authority string"),
        "funding": spark.createDataFrame([("fresh", AS_OF - 2 * hour), ("old", AS_OF - 900 * hour)], "wallet string, first_t long"),
        "tokens": spark.createDataFrame([("known", True, False, 50.0), ("dry", True, False, 50.0), ("new", False, False, 50.0)], "token string, jup_strict boolean, jup_verified boolean, rugcheck double"),
        "pool_volumes": spark.createDataFrame([("known", 10_000.0), ("new", 10_000.0)], "mint string, usd double"),
    }

    def found(**how):
        return {(r.mint, r.signal): r.confidence for r in run(spark, lambda d: detectors.withheld(d, as_of=AS_OF, **how), Tables(spark, DATA, tables)).collect()}

    a = 0.60 + 0.10 * math.log(3)
    want = {("plain", "A"): a, ("both", "A"): a + 0.10, ("both", "B"): 0.40, ("most", "A"): 0.95, ("most", "B"): 0.75, ("known", "A"): 0.70, ("known", "B"): 0.40, ("dry", "A"): 0.60, ("new", "A"): 0.60}
    assert found() == pytest.approx(want, abs=1e-6)
    # 1,000 of 10,000 dollars: spared at a tenth, not at less; a token without volume, or that is not established, is not
    assert found(allowed=0.1) == pytest.approx({k: v for k, v in want.items() if k != ("known", "A")}, abs=1e-6)
    assert found(allowed=0.09) == pytest.approx(want, abs=1e-6)


def test_first_sandwich_is_an_aggregate(spark):
    """Candidates of a block are combined as they are joined; the one window gives places to swaps."""
    df = run(spark, detectors.sandwich, Tables(spark, DATA))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("row_number()") <= 3
    assert "nth" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_least_wins_equals_first_wins(spark):
    """Nulls come first in both, and copies of a key within a task are one row before the shuffle."""
    rng = random.Random(8)
    pick = lambda n: rng.choice([None, *range(n)])
    df = spark.createDataFrame([(pick(20), pick(3), pick(4), k) for k in range(300)], "k int, t int, token int, body int").repartition(5)
    want = sinks.first_wins(df, ["k"], [F.col(c) for c in ("t", "token", "body")])
    got = sinks.least_wins(df, ["k"], ["t", "token", "body"])
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got._jdf.queryExecution().sparkPlan().toString().count("partial_min") >= 1


def test_clusters_and_members_take_edges_once(spark):
    """Buckets are windows over the edges: no distinct count per bucket, and members are not joined to what was worked out a second time."""
    plan = lambda name: Tables(spark, DATA)(name)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("members").count("Join ") == 1 and "distinct" not in plan("clusters")
    edges = [("solana", "s1", f"c{k}", 10 + k % 2, 1, 1000 * k, 1000 * k) for k in range(4)] + [("solana", "s1", "c9", 500, 1, 0, 0), ("ethereum", "s1", "c1", 10, 1, 0, 0), ("solana", "s2", "c1", 10, 1, None, 0), ("solana", "s2", "c2", 10, 1, None, 0), ("solana", "s2", "c3", 10, 1, None, 0)]
    t = Tables(spark, DATA, {"sol_edges": spark.createDataFrame(edges, "chain string, funder string, wallet string, total long, n long, first_t long, last_t long")})
    assert sorted((r.funder, r.time_bucket, r.n, r.first_wallet) for r in t("clusters").where("funder = 's1'").collect()) == []
    edges = [(*e[:3], 10, *e[4:]) if e[3] == 11 else e for e in edges]
    t = Tables(spark, DATA, {"sol_edges": spark.createDataFrame(edges, "chain string, funder string, wallet string, total long, n long, first_t long, last_t long")})
    (c,) = t("clusters").where("funder = 's1'").collect()
    assert (c.time_bucket, c.n, c.first_wallet, c.spread) == (0, 4, "c0", round(np.std([0, 1000, 2000, 3000]), 4))
    assert sorted((r.wallet, r.cluster_id, r.size) for r in t("members").collect()) == [(f"c{k}", c.cluster_id, 4) for k in range(4)]


def test_fifo_streams_keys_across_batches(spark):
    """Lots are matched in one ordered stream, whose batches cut keys anywhere; no group is a pandas frame of its own."""
    rng = random.Random(5)
    legs = [(f"u{rng.randrange(3)}", rng.choice(["a", None]), rng.choice(["buy", "sell"]), rng.randrange(50), k, f"tx{k}", rng.randrange(1, 900), rng.randrange(1, 6)) for k in range(400)]
    df = spark.createDataFrame(legs, "wallet string, token string, leg string, t long, seq long, tx_hash string, cents long, qty long").repartition(3)
    want, lots = [], {}
    for w, k, leg, t, seq, _, cents, qty in sorted(legs, key=lambda r: (r[3], r[5], r[2])):
        units = lots.setdefault((w, k), [])
        if leg == "buy":
            units += [(t, cents / qty)] * qty
        else:
            sold, lots[w, k] = units[:qty], units[qty:]
            want += [(w, str(k), t, seq, bought, round((cents / qty - price) / 100, 6)) for bought, price in sold]
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = smart_money.fifo(df)
        assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
        units = [(r.wallet, str(r.token), r.sell_t, r.sell_seq, r.buy_t, round(r.pnl / r.qty, 6)) for r in got.collect() for _ in range(r.qty)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert sorted(units) == sorted(want)


def test_sybil_counts_holders_without_distinct(spark):
    plan = run(spark, detectors.sybil, Tables(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct holder" not in plan and "count(holder" in plan


def test_probe_verdict_takes_balances_and_counts_once(spark):
    """Concentration ranks both balances of a holder in one pass, and dormant tokens and bursts share one count; each is what its SQL says."""
    import duckdb

    from tidewatch.operators import probes
    from tidewatch.plans import dialect

    rng = random.Random(4)
    names = ["t1", "t2", "t3", "t4", "t6", None]
    some = {
        "balances": ("chain string, token string, holder string, balance long, prior_balance long, block_height long", [("solana", t, f"c{k}", rng.choice([0, 0, -3, 5, 5, 40, rng.randrange(1, 900)]) if t != "t4" else 0, rng.choice([0, 0, -1, 7, rng.randrange(1, 90)]) if t != "t3" else 0, 1) for t in names for k in range(40)]),
        "classes": ("address string, kind string, confidence double, age_days long", [(f"c{k}", "liquid" if k % 5 else "dex_pool", 0.5, 1) for k in range(30)]),
        "tokens": ("token string, age_days long", [("t1", 3), ("t2", 10), ("t3", 50), ("t5", 50), (None, 8)]),
        "transfers": ("token string, block_height long", [(t, h) for t in ("t1", "t3", "t6", None) for h in [1] * 60 + list(range(2, 40))] + [("t2", 4)]),
    }
    frames = {k: spark.createDataFrame(rows, schema) for k, (schema, rows) in some.items()}
    con = duckdb.connect()
    for k, df in frames.items():
        con.register(k, df.toPandas())
    exact = lambda rows: sorted(((*r,) for r in rows), key=repr)
    sql = lambda text: con.sql(re.sub(r"\{(\w+)\}", r"\1", text)).fetchall()
    here = dialect.run(spark, detectors.concentration, frames.__getitem__)
    assert exact(here.collect()) == exact(sql(detectors.concentration(dialect.DUCK))) and here.count() > 3
    got = dialect.run(spark, probes.counted, frames.__getitem__).where("confidence IS NOT NULL").collect()
    want = [(t, p, c) for p, text in (("d03_dormant_token", "c03_dormant"), ("d11_synchronized", "c05_block_burst")) for t, c in sql(f"SELECT token, confidence FROM ({probes.TEXTS[text](dialect.DUCK)})")]
    assert exact(got) == exact(want) and len({c for *_, c in want}) > 3
    import __spark_entry__

    plan = __spark_entry__.queries()["r12_probe_verdict"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[l_orderkey", plan)) == 8  # one less for each of the two
