"""Substring dedup, the Jaccard join, and toxicity: against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import near_dup, substring_dedup, toxicity
from tidewatch.llm import runtime as rt

from texts import groups_by_hand, prose, shingle_sets


def windows_by_hand(rows, window):
    """rows: (id, words); earlier is a smaller id, then an earlier start."""
    seen, out = set(), {}
    for k in sorted(range(len(rows)), key=lambda k: rows[k][0]):
        words = rows[k][1]
        gone = [False] * len(words)
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            if key in seen:
                gone[a : a + window] = [True] * window
            seen.add(key)
        out[k] = gone
    return out


def check_substrings(got, rows, window):
    gone = windows_by_hand(rows, window)
    want = Counter()
    for k, (i, words) in enumerate(rows):
        kept = [w for w, g in zip(words, gone[k], strict=True) if not g]
        want[(i, len(words), sum(gone[k]), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want


@pytest.mark.parametrize(("window", "base"), [(20, 10), (20, 5), (20, 20), (12, 5)])
def test_substrings(docs, window, base):
    distinct = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in distinct.collect()]
    check_substrings(substring_dedup.substring_dedup(distinct, window, base).collect(), rows, window)


@pytest.mark.parametrize("hot", [1, 2, 4, 99])
def test_substrings_over_many_blocks(spark, monkeypatch, hot):
    """Whatever counts as frequent, and so goes another way, the result is the same."""
    rng = random.Random(2)
    passages = [prose(rng, 70).split() for _ in range(5)]
    rows = []
    for i in range(60):
        words = prose(rng, 40).split() + rng.choice(passages)[rng.randrange(20) :] + prose(rng, 10).split()
        rows.append((i * 3 % 61, " ".join(words)))
    monkeypatch.setattr(substring_dedup, "BLOCK_DOCS", 7)
    monkeypatch.setattr(substring_dedup, "HOT_BLOCKS", hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup.substring_dedup(docs).collect()
    check_substrings(got, [(i, t.encode().split()) for i, t in rows], 20)
    assert sum(r.n_removed for r in got) > 1000


def test_substrings_of_repeated_and_null_ids(docs, no_docs, plain):
    """Rows that tie in their id count in the order of the blocks; null ids count last."""
    got = substring_dedup.substring_dedup(docs.coalesce(1)).collect()
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in docs.coalesce(1).collect()]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    gone = windows_by_hand([(n, rows[k][1]) for n, k in enumerate(order)], 20)
    assert Counter((r.doc_id, r.n_removed) for r in got) == Counter((rows[k][0], sum(gone[n])) for n, k in enumerate(order))
    assert len(plain) == len(got) and substring_dedup.substring_dedup(no_docs).count() == 0


def test_substrings_when_hashes_collide(spark, monkeypatch):
    """Runs of a level may share hashes: that adds candidates and removes nothing more. Whole windows have a second hash."""
    rng = random.Random(12)
    passage = prose(rng, 30)
    rows = [(i, f"{prose(rng, 60)} {passage if i % 3 else ''} {prose(rng, 25)}") for i in range(30)]
    real = rt.window_hashes
    monkeypatch.setattr(substring_dedup.rt, "window_hashes", lambda h, k: real(h, k) % np.uint64(50) if k < 20 else real(h, k))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_substrings(substring_dedup.substring_dedup(docs).collect(), [(i, t.encode().split()) for i, t in rows], 20)
    first = real(np.arange(100, dtype=np.uint64), 20)
    block = substring_dedup.Block(next(iter(substring_dedup.blocks(docs.limit(1)).collect())).blob)
    monkeypatch.setattr(substring_dedup.rt, "window_hashes", lambda h, k: real(h, k) * np.uint64(0) if (h == block.h).all() else real(h, k))
    starts = block.windows(20)
    assert len(first) and len({tuple(x) for x in block.whole(starts, 20).tolist()}) == len(starts)


def test_distinct_rows_are_ordered_by_one_hash(monkeypatch):
    """The second hash takes part in the order only of rows that differ and begin alike; places are the first ones."""
    rng = np.random.default_rng(8)
    for n, most, other in ((0, 9, 9), (300, 40, 9), (300, 1 << 62, 9)):
        head = rng.integers(0, most, n).astype(np.uint64)
        for second in (head * np.uint64(7), rng.integers(0, other, n).astype(np.uint64)):
            rows = np.stack([head, second], axis=1)
            keys, first, inverse = substring_dedup._distinct(rows)
            want = sorted(set(map(tuple, rows.tolist())))
            assert list(map(tuple, keys.tolist())) == want and first.tolist() == [rows.tolist().index(list(k)) for k in want]
            assert (keys[inverse] == rows).all()
    monkeypatch.setattr(np, "lexsort", None)
    assert substring_dedup._distinct(np.array([[5, 1], [3, 2], [5, 1]], np.uint64))[1].tolist() == [1, 0]


def test_substrings_stop_without_candidates(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(rng.randrange(90)))) for i in range(20)]
    seen = []
    real = substring_dedup._ask
    monkeypatch.setattr(substring_dedup, "_ask", lambda sent, last: (seen.append(last), real(sent, last))[1])
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_substrings(got, [(i, t.encode().split()) for i, t in rows], 20)
    assert seen == [False]


def test_near_dup(docs, plain):
    got = near_dup.near_dup(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == Counter(groups_by_hand(plain))


def test_near_dup_splits_large_groups(spark, monkeypatch):
    """Groups over the chunk size are compared in pairs of chunks; no link is lost and none counted twice."""
    rng = random.Random(9)
    rows = []
    for g in range(3):
        base = prose(rng, 120).split()
        for k in range(25):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"w{g}x{k}"
            rows.append((len(rows), " ".join(words)))
    monkeypatch.setattr(near_dup, "CHUNK", 6)
    got = near_dup.near_dup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = {i: (c, n) for i, c, n in groups_by_hand(rows)}
    assert sum((r.class_id, r.n_links) != want[r.doc_id] for r in got) <= 2  # two in 75 may miss a link by chance at the threshold
    assert [r.class_id for r in got] and sum(r.n_links for r in got) > 300


def test_keep_one(docs, no_docs, plain):
    got = near_dup.keep_one(docs)
    assert got.columns == docs.columns
    assert got.count() == len({c for _, c, _ in groups_by_hand(plain)})
    assert near_dup.near_dup(no_docs).count() == 0


def test_intersections_by_either_way(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 900, 300).astype(np.uint64)) for _ in range(30)]
    left, right = np.triu_indices(30, 1)
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(left, right, strict=True)]
    assert near_dup._intersections(sets, left, right).tolist() == want
    monkeypatch.setattr(near_dup, "FEW", 1)
    assert near_dup._intersections(sets, left, right).tolist() == want


def test_pruning_keeps_likely_pairs():
    least = near_dup.least_matches()
    assert all(0 < m < n for n, m in least.items())
    rng = np.random.default_rng(1)
    lost = 0
    for _ in range(2000):
        hits = rng.random(near_dup.HASHES) < 0.8
        lost += any(hits[:n].sum() < m for n, m in least.items())
    assert lost < 10
    assert least[128] > 128 * 0.6


def test_components(spark):
    rng = random.Random(8)
    edges = [(f"n{a:03d}", f"n{b:03d}") for a, b in [(1, 2), (2, 3), (9, 3), (20, 21), (22, 21), (5, 5)] + [(40 + i, 41 + i) for i in range(30)]]
    got = {r.node: r.label for r in rt.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"n{k:03d}"] for k in (1, 2, 3, 9)} == {"n001"} and {got[f"n{k:03d}"] for k in (20, 21, 22)} == {"n020"}
    assert {got[f"n{40 + i:03d}"] for i in range(31)} == {"n040"} and "n005" not in got
    hub = [(rng.randrange(3), 10 + k) for k in range(5000)] + [(0, 1), (1, 2)]  # hubs with most of the edges
    got = rt.components(spark.createDataFrame(hub, "a long, b long")).collect()
    assert len(got) == 5003 and {r.label for r in got} == {0}
    assert rt.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chained_collisions_stay_cheap(spark, monkeypatch):
    """Two thousand texts of which neighbours collide and are likely, far ones are not: a group that is only chained
    together is not compared as a whole, and no link is lost."""
    rng = random.Random(6)
    words = prose(rng, 4200).split()
    rows = [(i, " ".join(words[2 * i : 2 * i + 80])) for i in range(2000)]
    monkeypatch.setattr(near_dup, "CHUNK", 16)
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in near_dup.near_dup(texts).collect()}
    sets = {i: s for (i, _), s in zip(rows, shingle_sets(rows), strict=True)}
    lost = 0
    for i in range(2000):
        want = sum(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(max(0, i - 8), min(2000, i + 9)) if j != i)
        assert got[i].n_links <= want
        lost += want - got[i].n_links
    assert lost <= 20 and sum(got[i].class_id == 0 for i in range(2000)) > 1900
    signs = near_dup.signed(texts.selectExpr("doc_id AS row", "doc_id AS id", "text"))
    classes = rt.materialise(signs.selectExpr("set", "named_struct('none', false, 'id', id, 'row', row) AS best", "1L AS copies", "shingles", "sig"), "classes")
    shared, groups = near_dup.candidate_groups(classes)
    plan = near_dup.planned(shared, classes, groups).collect()
    dealt = Counter((r.group, r.lo, r.hi, r.part) for r in plan)
    work = sum(n * dealt[g, a, b, b] if a != b else n * n / 2 for (g, a, b, k), n in dealt.items() if k == a)
    assert max(dealt.values()) <= 60 and work < 2000 * 2000 / 2 / 3


def test_toxicity_learns_words(spark, docs, no_docs):
    rng = random.Random(1)
    rows = [(i, prose(rng, 80) + (" you idiot scum " if i % 5 == 0 else " friend ") + prose(rng, 10), int(i % 5 == 0)) for i in range(800)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.toxicity(table.drop("toxic"), table.drop("text")).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out]
    assert 100 < len(held) < 300
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    odd = toxicity.toxicity(docs, table.drop("text"))
    assert odd.count() == docs.count()
    assert toxicity.toxicity(no_docs, table.drop("text")).count() == 0
    none = toxicity.toxicity(docs, table.drop("text").where("doc_id < 0")).collect()
    assert all(r.score == 0 and r.predicted == 0 for r in none)
    kept = toxicity.keep_clean(table.drop("toxic"), table.drop("text"))
    assert 600 <= kept.count() <= 660


def test_ftrl_by_hand():
    """Weights against a plain per-coordinate loop after its definition."""
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 64, rng.integers(1, 9))), float(rng.random() < 0.4)) for _ in range(400)]
    rows = [(np.union1d(p, [63]) if y else p, y) for p, y in rows]
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    z, n = [0.0] * 64, [0.0] * 64
    z0 = n0 = 0.0

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((b + n[i] ** 0.5) / a + l2)

    for places, y in rows:
        w = {int(i): weight(int(i)) for i in places}
        bias = -z0 / ((b + n0**0.5) / a)
        g = 1 / (1 + np.exp(-(sum(w.values()) + bias))) - y
        for i in w:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a * w[i]
            n[i] += g * g
        z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / a * bias
        n0 += g * g
    places, weights, bias = toxicity.train(iter(rows), bits=6)
    want = {i: weight(i) for i in range(64) if weight(i)}
    assert want and dict(zip(places.tolist(), weights.tolist(), strict=True)) == pytest.approx(want) and bias == pytest.approx(-z0 / ((b + n0**0.5) / a))
    assert len(want) < 64 and toxicity.train(iter(rows[:1])) is None
