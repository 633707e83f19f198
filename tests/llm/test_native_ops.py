"""Exact dedup, secret scan, sharding: against brute force, on odd rows, and without Python in their plans."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import exact_dedup, secret_scan, sharding


def bare(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t)


def check_dedup(got, plain):
    groups = defaultdict(list)
    for i, t in plain:
        groups[bare(t)].append((-len(t), i is None, i))
    assert len(got) == len(plain)
    want = Counter()
    for i, t in plain:
        g = groups[bare(t)]
        want[(i, min(g)[2], len(g), hashlib.sha256(bare(t).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(k.encode()).hexdigest() for k in groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup(docs, plain):
    check_dedup(exact_dedup.exact_dedup(docs).collect(), plain)


def test_exact_dedup_compares_content(docs, plain):
    """With a digest that nearly all texts share, texts still decide."""
    check_dedup(exact_dedup.exact_dedup(docs, digest=lambda c: F.substring(F.sha2(c, 256), 1, 1)).collect(), plain)


def test_exact_dedup_of_one_content_hash(docs, plain, monkeypatch):
    """Even where both hashes are shared."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    check_dedup(exact_dedup.exact_dedup(docs, digest=lambda c: F.substring(F.sha2(c, 256), 1, 1)).collect(), plain)


def test_exact_dedup_of_odd_ids(spark):
    """Ids at both ends of the range, thousands of null ids, and columns with names that operators use."""
    rows = [(None, "same", 1, 2, 3)] * 2500 + [(-(2**63), "a", 1, 2, 3), (2**63 - 1, "a", 1, 2, 3), (None, "a", 1, 2, 3), (5, "sam e", 1, 2, 3), (2**63 - 1, "b", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id long, no long, best long")
    check_dedup(exact_dedup.exact_dedup(docs).collect(), [r[:2] for r in rows])
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted((r.text, r.doc_id) for r in kept.collect()) == [("a", -(2**63)), ("b", 2**63 - 1), ("sam e", 5)]


def test_exact_dedup_of_shared_ids(spark):
    """Repeated texts whose winners share an id, null or not, are groups of their own."""
    rows = [(None, "a"), (None, "a"), (None, "bb"), (None, "bb"), (1, "ccc"), (1, "ccc"), (1, "d"), (1, "d"), (2, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_dedup(exact_dedup.exact_dedup(docs).collect(), rows)
    assert sorted(r.text for r in exact_dedup.keep_first(docs).collect()) == ["a", "bb", "ccc", "d"]


def test_exact_dedup_empty(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert exact_dedup.keep_first(no_docs).count() == 0


def test_keep_first(docs, plain):
    got = exact_dedup.keep_first(docs)
    assert got.columns == docs.columns
    assert got.count() == len({bare(t) for _, t in plain})


def jump_by_hand(key, n):
    seed = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42) if key is not None else 42
    b, j, i = -1, 0, 1
    while j < n:
        b = j
        u = ((xxhash.xxh64_intdigest(struct.pack("<i", i), seed=seed) >> 11) + 1) / 2**53
        j, i = math.floor((b + 1) / u), i + 1
    return b


def test_sharding(docs, plain):
    got = sharding.shard_rows(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in plain)
    for r in got:
        assert r.law == "key" and r.shard == jump_by_hand(r.doc_id, 40) and r.grown_shard == jump_by_hand(r.doc_id, 41)
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_sharding_moves_only_to_new_shard(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.shard_rows(docs).collect()
    assert all(r.grown_shard in (r.shard, 40) for r in got)
    moved = sum(r.grown_shard == 40 for r in got)
    assert 70 < moved < 180
    assert max(Counter(r.shard for r in got).values()) < 180


def test_sharding_of_one_id(spark):
    docs = spark.createDataFrame([(None, "x")] * 3000 + [(7, "x")] * 3000, "doc_id long, text string")
    got = sharding.shard_rows(docs).collect()
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_sharding_empty(no_docs):
    assert sharding.shard_rows(no_docs).count() == 0


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(t):
    out = []
    for k, (name, pattern) in enumerate((("assign", ASSIGN), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+")))):
        for m in pattern.finditer(t):
            long = len(m[2]) >= 6 if name == "assign" else len(m[0]) >= (20 if name == "access" else 24)
            if long:
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_secret_scan(docs, plain):
    got = secret_scan.secret_scan(docs, owner=F.col("source")).collect()
    want = Counter((i, hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()) for i, t in plain)
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    of = {i: t for i, t in plain}
    for r in got:
        own = base_spans(of[r.doc_id])
        assert [s for s in r.spans.split(",") if s and not s.startswith("owned")] == own
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in own) for k in ("assign", "access", "hex"))
    assert sum(r.n_assign for r in got) >= 2 and sum(r.n_access for r in got) == 1


def test_ownership_separates_examples(spark):
    copied, own = "password=EXAMPLEexample1234567890", "password=OWNERowner0987654321"
    rows = [(k, f"see {copied} here", f"s{k}") for k in range(6)] + [(10, f"see {own} here", "s1"), (11, f"more {own}", "s1"), (12, "nothing here", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secret_scan.secret_scan(docs, owner=F.col("source")).collect()}
    assert all(got[k].n_live == 0 and got[k].n_examples == 1 for k in range(6))
    assert got[10].n_live == got[11].n_live == 1
    masked = {r.doc_id: r.text for r in secret_scan.mask_live(docs, owner=F.col("source")).collect()}
    assert masked[10] == "see [SECRET] here" and masked[11] == "more [SECRET]" and masked[12] == "nothing here"
    assert all(copied in masked[k] for k in range(6))


def test_every_outcome_by_brute_force(spark):
    """Planted values: copied by many owners, through many repositories of one owner, by two owners, by one, and not assigned."""
    rng = random.Random(3)
    value = lambda n: "".join(rng.choice("ghkmnpXYZ012345") for _ in range(n)) + "aB3"
    rows, values = [], [(kind, value(30)) for kind in ("many", "repos", "two", "one") for _ in range(5)]
    for k, (kind, v) in enumerate(values):
        holders = {"many": [(f"o{j}", "en") for j in range(5)], "repos": [("hot", f"l{j}") for j in range(4)], "two": [("o1", "en"), ("o2", "en"), ("o2", "fr")], "one": [("o3", "en")] * 3}[kind]
        for owner, lang in holders:
            text = f"see {v} here é {v}" if k % 2 else f"🙂 token = '{v}'; "
            rows.append((len(rows), text, owner, lang))
    rows += [(len(rows), "nothing to see", None, None), (None, None, "o1", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    got = {r.doc_id: r for r in secret_scan.secret_scan(docs, owner=F.col("source"), repo=F.concat_ws("/", "source", "lang")).collect()}
    found = defaultdict(list)  # value -> (row, owner, repository, span)
    for i, t, owner, lang in rows:
        for m in re.finditer(r"[A-Za-z0-9]{16,}", t or ""):
            found[m[0]].append((i, owner, f"{owner}/{lang}", m.span()))
    want = {i: [0, 0, 0, set()] for i, *_ in rows}
    for places in found.values():
        owners, repos = {p[1] for p in places}, {p[2] for p in places}
        live = len(owners) <= 2 and len(repos) <= 3
        for i, _, _, (a, z) in places:
            text = rows[i][1]
            owned = live and "token" not in text
            want[i][0] += live
            want[i][1] += not live
            want[i][2] += owned
            if owned or "token" in text:
                want[i][3].add(f"owned:{a}:{z}" if owned else f"assign:{text.index('token')}:{z}")
    for i, (live, example, owned, spans) in want.items():
        assert (got[i].n_live, got[i].n_examples, got[i].n_owned, set(got[i].spans.split(",")) - {""}) == (live, example, owned, spans)
    assert sum(r.n_owned for r in got.values()) >= 20 and sum(r.n_examples for r in got.values()) >= 30 and max(r.repos for r in got.values()) == 5


def test_long_texts_are_scanned_and_masked_in_time(spark):
    """Twelve thousand spans in a text of several pieces; the time would be minutes if it grew with their square."""
    rng = random.Random(4)
    parts = [f"é token={rng.getrandbits(80):020x}" for _ in range(12_000)]
    text = " ; ".join(parts) + " password=" + "q9" * 20_000
    docs = spark.createDataFrame([(1, text, "s"), (2, "x", "s"), (3, parts[7], "s2")], "doc_id long, text string, source string")
    start = time.time()
    got = {r.doc_id: r for r in secret_scan.secret_scan(docs, owner=F.col("source")).collect()}
    masked = {r.doc_id: r.text for r in secret_scan.mask_live(docs, owner=F.col("source")).collect()}
    assert time.time() - start < 60
    assert got[1].base_sha256 == hashlib.sha256(",".join(base_spans(text)).encode()).hexdigest() and got[1].n_assign == 12_001
    assert masked == {1: " ; ".join(["é [SECRET]"] * 12_000) + " [SECRET]", 2: "x", 3: "é [SECRET]"}


def test_time_grows_with_the_spans(spark):
    """Texts of hashes, each a base span and a candidate: four times the spans take less than six times the time."""
    rng, took = random.Random(5), []
    for n in (1000, 16_000, 64_000):
        text = " ".join(f"{rng.getrandbits(128):032x}" for _ in range(n))
        docs = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
        start = time.time()
        got = secret_scan.secret_scan(docs, owner=F.col("source")).first()
        assert got.n_hex == n and got.n_owned == 0
        assert secret_scan.mask_live(docs, owner=F.col("source")).first().text == " ".join(["[SECRET]"] * n)
        took.append(time.time() - start)
    assert took[2] < 6 * took[1] and took[2] < 60


def test_candidates_apart_from_base_spans(spark):
    """By hand: spans that touch are apart, one common code point is an overlap."""
    rng = random.Random(7)
    spans = lambda n, kind: sorted((a, a + rng.randrange(1, 6)) for a in rng.sample(range(200), n)) if kind else []
    rows = []
    for k in range(40):
        wide, end = [], 0
        for _ in range(rng.randrange(12)):
            start = end + rng.randrange(9)
            end = start + rng.randrange(1, 9)
            wide.append((start, end))
        rows.append((k, wide, spans(rng.randrange(40), k % 5)))
    kind = "array<struct<start:bigint,end:bigint>>"
    full = lambda name, order: F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), s["end"].alias("end"), F.lit("k").alias("kind"), F.lit("v").alias("value")))
    got = spark.createDataFrame(rows, f"k int, wide {kind}, base {kind}").select("k", secret_scan._apart(full("wide", 3), full("base", 1)).alias("left"))
    want = {k: [w for w in wide if not any(b[0] < w[1] and w[0] < b[1] for b in base)] for k, wide, base in rows}
    assert {r.k: [(s["start"], s["end"]) for s in r.left] for r in got.collect()} == want


@pytest.mark.parametrize("piece", [5, 16, 1 << 14])
def test_masks_across_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(secret_scan, "PIECE", piece)
    rng = random.Random(piece)
    rows = []
    for _ in range(60):
        text = "".join(rng.choice("abcdé🙂") for _ in range(rng.randrange(1, 60)))
        spans = sorted((a, a + rng.randrange(1, 20)) for a in (rng.randrange(len(text)) for _ in range(rng.randrange(1, 5))))
        spans = [(a, min(z, len(text))) for a, z in spans]
        out, pos = "", 0
        for a, z in spans:
            if a >= pos:
                out += text[pos:a] + secret_scan.MASK
            pos = max(pos, z)
        rows.append((text, spans, out + text[pos:]))
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:bigint,end:bigint>>, want string")
    got = df.select("want", secret_scan._masked(F.col("text"), F.col("spans")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_clashing_names_stay(spark):
    rows = [(1, "token = abcdef123456", "a", "x", 1.0, 2, 3, "b"), (2, "token = abcdef123456", "a", "x", 1.0, 2, 3, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row string, __score double, __n long, no long, `id.x y` string")
    got = secret_scan.mask_live(docs, owner=F.col("source"))
    assert got.columns == docs.columns and {tuple(r)[2:] for r in got.collect()} == {r[2:] for r in rows}


def test_secret_scan_empty(no_docs, docs):
    assert secret_scan.secret_scan(no_docs).count() == 0
    assert secret_scan.mask_live(docs, owner=F.col("source")).columns == docs.columns


def test_native_plans_have_no_python(docs):
    for df in (secret_scan.secret_scan(docs, owner=F.col("source")), sharding.shard_rows(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
