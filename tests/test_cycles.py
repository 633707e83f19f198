"""Rings from their busiest wallet, strongly connected components, and swaps read from transfers."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import cycles, graph
from tidewatch.sources import solana

EDGES = "token string, bucket long, src string, dst string, cents long, first_t long, last_t long"


def edges(spark, pairs, token="t"):
    return spark.createDataFrame([(token, 0, a, b, k + 1, 10 * k, 10 * k + 5) for k, (a, b) in enumerate(pairs)], EDGES)


def found(df):
    return sorted((r.token, r["size"], r.ring, r.bottleneck, r.span) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rings_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(a, b) for a, b in ((f"w{rng.randrange(14)}", f"w{rng.randrange(14)}") for _ in range(45)) if a != b})
    both = edges(spark, pairs).unionByName(edges(spark, pairs[: len(pairs) // 2], "u"))
    want = found(graph.rings_exact(both).where("size > 2"))
    assert want and found(cycles.rings(both)) == want


def test_caps_and_components(spark):
    rng = random.Random(8)
    pairs = sorted({(f"{g}{rng.randrange(9)}", f"{g}{rng.randrange(9)}") for g in "abc" for _ in range(24)} | {("a0", "b0"), ("b1", "c1")})
    pairs = [(a, b) for a, b in pairs if a != b]
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    want = {(n, max(part)) for part in graph.components({x for p in pairs for x in p}, out) if len(part) > 1 for n in part}
    assert {(r.node, r.component) for r in cycles.strong_components(edges(spark, pairs), cycles.GROUP).collect()} == want
    name = dict(want)
    every, capped = found(cycles.rings(edges(spark, pairs))), found(cycles.rings(edges(spark, pairs), cap=3))
    per = {}
    for r in every:
        per.setdefault(name[r[2].split(">")[0]], []).append(r)
    assert capped == sorted(r for rs in per.values() for r in sorted(rs, key=lambda r: r[1:3])[:3]) and len(capped) < len(every)


def test_a_wallet_with_100000_edges(spark):
    """A hub that everyone pays and that pays everyone, and a few rings through it and beside it."""
    n = 50_000
    hub = spark.range(n).selectExpr("'t' AS token", "0L AS bucket", "concat('w', id) AS w")
    both = hub.selectExpr("token", "bucket", "w AS src", "'hub' AS dst", "5L AS cents", "1L AS first_t", "2L AS last_t").unionByName(hub.selectExpr("token", "bucket", "'hub' AS src", "w AS dst", "5L AS cents", "1L AS first_t", "2L AS last_t"))
    both = both.unionByName(edges(spark, [("w1", "w2"), ("w2", "w3"), ("w3", "w1"), ("w7", "w8")]))
    start = time.time()
    rings = {r.ring for r in cycles.rings(both, longest=4).collect()}
    assert rings == {"w1>w2>w3", "hub>w1>w2", "hub>w2>w3", "hub>w3>w1", "hub>w7>w8", "hub>w1>w2>w3", "hub>w2>w3>w1", "hub>w3>w1>w2"}
    assert time.time() - start < 120


def test_no_edges(spark):
    assert cycles.rings(edges(spark, [("a", "b")])).count() == 0 and cycles.rings(edges(spark, [("a", "b")]).limit(0), cap=2).count() == 0


TRANSFERS = "chain string, tx_hash string, log_index int, token string, from_address string, to_address string, amount long"


def test_inferred_swaps(spark):
    rows = [
        ("s", "1", 0, "SOL", "me", "pool", 70), ("s", "1", 1, "FEE", "me", "pool", 5), ("s", "1", 2, "TOK", "pool", "me", 900),  # a swap with a fee
        ("s", "2", 0, "SOL", "me", "pool", 70), ("s", "2", 1, "SOL", "pool", "me", 60),  # one token only
        ("s", "3", 0, "SOL", "me", "you", 70), ("s", "3", 1, "TOK", "you", "me", 900),  # no exchange
        ("s", "4", 0, "SOL", "me", "pool", 70), ("s", "4", 1, "TOK", "pool", "me", 900),  # decoded already
        ("s", "5", 0, "SOL", "me", "pool", 70), ("s", "5", 1, "MID", "pool", "me", 9), ("s", "5", 2, "MID", "me", "pool2", 9), ("s", "5", 3, "TOK", "pool2", "me", 3),  # by way of another token
        ("s", "6", 0, "SOL", "pool", "pool2", 1), ("s", "6", 1, "TOK", "pool2", "pool", 1),  # within the exchange
    ]
    dex = spark.createDataFrame([("pool", "orca"), ("pool2", "meteora")], "address string, dex string")
    got = solana.infer_swaps(spark.createDataFrame(rows, TRANSFERS), dex, spark.createDataFrame([("s", "4")], "chain string, tx_hash string"))
    assert sorted((r.tx_hash, r.pool, r.dex, r.sender, r.token_in, r.token_out, r.amount_in, r.amount_out) for r in got.collect()) == [("1", "pool", "orca", "me", "SOL", "TOK", 70, 900), ("5", "pool", "orca", "me", "SOL", "TOK", 70, 3)]
    assert solana.infer_swaps(spark.createDataFrame([], TRANSFERS), dex).count() == 0


def test_inferred_swaps_sort_once(spark):
    """No table of groups is held, and the rows of the last stage are sorted by one order only; nulls mark nothing."""
    rows = [("s", "1", 0, "SOL", "me", "pool", 70), ("s", "1", 1, "TOK", "pool", "me", 900), ("s", "1", 2, "TOK", "pool", "me", 1), ("s", "2", 0, "SOL", None, "pool", 7), ("s", "2", 1, "TOK", "pool", None, 9), (None, "3", 0, "SOL", "me", "pool", 5), (None, "3", 1, "TOK", "pool", "me", 6), ("s", "4", 0, "SOL", "me", "pool", 70), ("s", "4", 1, "TOK", "pool", "me", 900)]
    dex = spark.createDataFrame([("pool", "orca")], "address string, dex string")
    decoded = spark.createDataFrame([("s", "4"), ("s", "4"), (None, "3"), ("s", None)], "chain string, tx_hash string")
    got = solana.infer_swaps(spark.createDataFrame(rows, TRANSFERS), F.broadcast(dex), decoded)
    want = [("1", "me", "SOL", "TOK", 70, 901), ("2", None, "SOL", "TOK", 7, 9), ("3", "me", "SOL", "TOK", 5, 6)]
    assert sorted(((r.tx_hash, r.sender, r.token_in, r.token_out, r.amount_in, r.amount_out) for r in got.collect()), key=lambda r: r[0]) == want
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "HashAggregate" not in plan and "SortMergeJoin" not in plan and plan.count("Sort [") == 1
