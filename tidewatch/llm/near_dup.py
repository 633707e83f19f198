r"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of five-word shingles (words are runs of [^\x20\x09-\x0D], unchanged; a shorter text is one shingle). Two
texts are linked if the Jaccard similarity of their sets is THRESHOLD or more.

1. Texts with equal sets form a class and go on as one.
2. Classes that share a band of ROWS MinHash values meet in that band's bucket (BANDS bands: a pair at the threshold is missed
   with probability (1 - THRESHOLD ** ROWS) ** BANDS, 7e-5). There MinHash values are compared STEP at a time; under a
   uniform prior the similarity has a Beta posterior, and a pair is dropped once its probability of reaching the threshold is
   below TOLERANCE. A bucket gives a spanning forest of the pairs that survive, so only likely pairs connect texts.
   Buckets over CHUNK members are split into pairs of chunks, each its own task.
3. What those forests connect is a candidate group. Its members are compared again, pruned, and verified exactly on the
   shingle sets. A group over CHUNK members (or CHUNK_BYTES of shingles) is dealt into parts, and a member goes only to those
   pairs of parts in which it shares a bucket with someone, so the work follows the links and not the square of a group
   that is only chained together. Links are counted where they are found: pairs are never rows, and only the edges of
   a spanning forest leave a task.
4. Verified edges are joined into groups of near-duplicates.

Null and empty texts have the empty set: copies of each other, without links. Ids may be null (they come last) or repeated; each row
is reported. Rows that tie in id are told apart by a row number. Very long texts are single rows, one of which must fit a
task; their shingles count towards the size of a chunk. An empty table gives an empty result; other columns, whatever
their names, are ignored, or kept by keep_one().
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime as rt

THRESHOLD, SHINGLE = 0.8, 5
BANDS, ROWS, HASHES, STEP = 24, 5, 128, 16
TOLERANCE = 1e-4
#: Members of a part, and bytes of their shingles.
CHUNK, CHUNK_BYTES = 512, 64_000_000
#: Fewer pairs than this are verified one by one, more by products of incidence matrices.
FEW = 1500
#: In buckets up to this all pairs are compared at once, in larger ones one member with all that are not yet connected.
SMALL = 8


@functools.cache
def _multipliers() -> np.ndarray:
    return rt.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


@functools.cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """n -> the fewest of n equal MinHash values with which P(similarity >= threshold) >= tolerance.

    The posterior is Beta(m + 1, n - m + 1), and P(Beta(a, b) >= t) = P(Binomial(a + b - 1, t) <= a - 1).
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def shingles(text: str, memo: rt.Memo, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    _, h = rt.word_hashes(text.encode(), memo)
    return np.unique(rt.window_hashes(h, min(k, len(h)))) if len(h) else np.empty(0, np.uint64)


def min_hashes(s: np.ndarray) -> np.ndarray:
    """HASHES values of 16 bits: of different least elements one pair in 65,536 looks equal."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(least, (s[i : i + 1024, None] * _multipliers()).min(axis=0), out=least)
    return (rt.mix(least) >> np.uint64(48)).astype("<u2")


def band_keys(mh: np.ndarray) -> np.ndarray:
    """Keys of the bands of one signature, or of each row of several."""
    rows = mh[..., : BANDS * ROWS].reshape(*mh.shape[:-1], BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:-1])
    for r in range(ROWS):
        key = rt.mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[..., r])
    return key.astype(np.int64)


def set_key(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.astype("<u8").tobytes())


SIGNED = "row long, id long, set binary, shingles long, sig binary"


def signed(rows: DataFrame) -> DataFrame:
    """rows: (row, id, text)."""

    def made(batches):
        memo = rt.Memo()
        for b in batches:
            sets = [shingles(t, memo) for t in b.column("text").to_pylist()]
            sigs = [min_hashes(s).tobytes() if len(s) else b"" for s in sets]
            yield pa.record_batch([b.column("row"), b.column("id"), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary())], names=["row", "id", "set", "shingles", "sig"])

    return rows.select("row", "id", "text").mapInArrow(made, SIGNED)


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def banded(classes: DataFrame) -> DataFrame:
    """(set, band): a row for each band of each class that has one."""

    def made(batches):
        for b in batches:
            keys = band_keys(_signatures(b.column("sig")))
            yield pa.record_batch([b.column("set").take(pa.array(np.repeat(np.arange(len(keys)), BANDS))), pa.array(keys.ravel())], names=["set", "band"])

    return classes.where("shingles > 0").select("set", "sig").mapInArrow(made, "set binary, band long")


def likely(mh: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which of the pairs (left, right) survive the pruning."""
    at, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for n, least in least_matches(threshold).items():
        matches += (mh[left[at], n - STEP : n] == mh[right[at], n - STEP : n]).sum(axis=1)
        ok = matches >= least
        at, matches = at[ok], matches[ok]
    return at


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    if len(left) < FEW:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left.tolist(), right.tolist(), strict=True)], np.int64)
    used = np.unique(np.concatenate([left, right]))
    row = np.zeros(len(sets), np.int64)
    row[used] = np.arange(len(used))
    values, column = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    of = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    both = np.zeros((len(used), len(used)), np.float32)
    for start in range(0, len(values), 4096):
        a, z = np.searchsorted(column, [start, start + 4096])
        part = np.zeros((len(used), 4096), np.float32)
        part[of[a:z], column[a:z] - start] = 1
        both += part @ part.T
    return both[row[left], row[right]].astype(np.int64)


def verified(sets: list[np.ndarray], mh: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (left, right), those that survive the pruning and reach the threshold exactly."""
    ok = likely(mh, left, right, threshold)
    left, right = left[ok], right[ok]
    sizes = np.array([len(s) for s in sets], np.int64)
    shared = _intersections(sets, left, right)
    ok = shared >= threshold * (sizes[left] + sizes[right] - shared) - 1e-9
    return left[ok], right[ok]


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            out.append((i, j))
    return out


def _grouped(*keys: np.ndarray) -> list[np.ndarray]:
    """Row numbers of each group of equal keys."""
    order = np.lexsort(keys)
    new = np.any([np.diff(k[order]) != 0 for k in keys], axis=0)
    return np.split(order, np.flatnonzero(new) + 1)


def _sift(table: pa.Table) -> pa.Table:
    """(a, b) edges that connect what likely pairs connect, in each bucket or pair of chunks of one."""
    names, mh = table["set"].to_pylist(), _signatures(table["sig"])
    edges: list[tuple[int, int]] = []
    left, right = [], []
    for members in _grouped(*[table[c].to_numpy() for c in ("hi", "lo", "band")]):
        if len(members) <= SMALL:
            i, j = np.triu_indices(len(members), 1)
            left.append(members[i])
            right.append(members[j])
            continue
        while len(members) > 1:
            todo, members = [members[0]], members[1:]
            while todo and len(members):
                x = todo.pop()
                hit = likely(mh, np.full(len(members), x), members)
                near = members[hit]
                edges += [(int(x), y) for y in near.tolist()]
                todo += near.tolist()
                members = np.delete(members, hit)
    if left:
        left, right = np.concatenate(left), np.concatenate(right)
        ok = likely(mh, left, right)
        edges += zip(left[ok].tolist(), right[ok].tolist(), strict=True)
    pairs = {(min(names[i], names[j]), max(names[i], names[j])) for i, j in edges}
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.binary()), "b": pa.array([b for _, b in pairs], pa.binary())})


LINKED = pa.schema([("set", pa.binary()), ("links", pa.int64()), ("peer", pa.binary())])


def _compare(table: pa.Table) -> pa.Table:
    """Rows of LINKED: link counts of the members (peer null), and forest edges (links 0)."""
    names, part, mh = table["set"].to_pylist(), table["part"].to_numpy(), _signatures(table["sig"])
    lo, hi = table["lo"].to_numpy(), table["hi"].to_numpy()
    sets = [np.frombuffer(x, "<u8") for x in table["hashes"].to_pylist()]
    out: list[tuple] = []
    _, of = np.unique(np.array([x.hex() for x in table["group"].to_pylist()]), return_inverse=True)
    for members in _grouped(hi, lo, of):
        a, b = lo[members[0]], hi[members[0]]
        if a == b:
            i, j = np.triu_indices(len(members), 1)
            left, right = members[i], members[j]
        else:
            one, two = members[part[members] == a], members[part[members] == b]
            left, right = np.repeat(one, len(two)), np.tile(two, len(one))
        left, right = verified(sets, mh, left, right)
        counts = np.bincount(np.concatenate([left, right]), minlength=len(names))
        out += [(names[k], int(counts[k]), None) for k in np.flatnonzero(counts)]
        out += [(names[i], 0, names[j]) for i, j in _forest(len(names), left, right)]
    return pa.table([pa.array([r[k] for r in out], f.type) for k, f in enumerate(LINKED)], schema=LINKED)


def _dealt(rows: DataFrame, name: str, tasks: int) -> DataFrame:
    """Rows with `parts` and `part`, once for each pair of parts that has the row's: columns lo and hi, and the key `task`."""
    paired = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    paired = paired.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
    return paired.withColumn("task", _task(name, tasks))


def _task(name: str, tasks: int):
    """Groups of one part share tasks, a pair of parts has its own."""
    return F.when(F.col("parts") == 1, F.pmod(F.xxhash64(name), F.lit(tasks)).cast("string")).otherwise(F.concat_ws(":", F.xxhash64(name).cast("string"), "lo", "hi"))


def _part(parts):
    return F.pmod(F.xxhash64("set"), parts).cast("int").alias("part")


def candidate_groups(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set, band) of the classes that are not alone in their bucket, and (set, group) of those that a likely pair connects."""
    bands = rt.materialise(banded(classes), "bands")
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = rt.materialise(rt.meet(bands, sizes, ["band"], "n", bands.count()), "shared")
    rt.discard(bands)
    parts = F.ceil(F.col("n") / CHUNK).cast("int")
    met = shared.join(classes.select("set", "sig"), "set").select("set", "band", "sig", parts.alias("parts"), _part(parts))
    tasks = max(8, shared.count() // CHUNK)
    edges = _dealt(met, "band", tasks).select("task", "set", "band", "lo", "hi", "sig").groupBy("task").applyInArrow(_sift, "a binary, b binary")
    return shared.select("set", "band"), rt.materialise(rt.components(edges), "groups").withColumnRenamed("node", "set").withColumnRenamed("label", "group")


def planned(shared: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(set, group, parts, part, lo, hi): a row for each pair of parts to which a member goes. In a group of one part that is the
    only one; in others those in which a bucket of the member has someone of the other part."""
    weight = classes.select("set", (8 * F.col("shingles")).alias("bytes"))
    sizes = groups.join(weight, "set").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    parts = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("bytes") / CHUNK_BYTES)).cast("int")
    members = rt.lookup(groups, sizes, "group", "n", groups.count()).select("set", "group", parts.alias("parts"))
    members = rt.materialise(members.select("set", "group", "parts", _part(F.col("parts"))), "members")
    one = members.where("parts = 1").select("*", F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    # the parts that a bucket has of a group, and for each member the union over its buckets
    there = rt.materialise(shared.join(members.where("parts > 1"), "set").select("set", F.concat_ws(":", F.hex("group"), "band").alias("bucket"), "group", "parts", "part"), "there")
    of = there.groupBy("bucket").agg(F.collect_set("part").alias("others"), F.count(F.lit(1)).alias("rows"))
    more = rt.meet(there, of, ["bucket"], "rows", there.count())
    more = more.groupBy("set").agg(F.first("group").alias("group"), F.first("parts").alias("parts"), F.first("part").alias("part"), F.array_distinct(F.flatten(F.collect_set("others"))).alias("others"))
    more = more.select("set", "group", "parts", "part", F.explode("others").alias("other"))
    return one.unionByName(more.select("set", "group", "parts", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")))


def links(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(set, links, peer) of the classes that are linked; rows: (row, id, text), of which each class names one."""
    shared, groups = candidate_groups(classes)
    plan = rt.materialise(planned(shared, classes, groups), "plan")
    chosen = plan.select("set").distinct().join(classes.select("set", "sig", F.col("best.row").alias("row")), "set")

    def made(batches):
        memo = rt.Memo()
        for b in batches:
            sets = [shingles(t, memo) for t in b.column("text").to_pylist()]
            yield b.select(["set", "sig"]).append_column("hashes", pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()))

    hashed = rows.select("row", "text").join(chosen, "row").select("set", "sig", "text").mapInArrow(made, "set binary, sig binary, hashes binary")
    weight = classes.join(plan.select("set").distinct(), "set").agg(F.sum("shingles")).first()[0] or 0
    tasks = max(8, plan.count() // CHUNK, 8 * weight // CHUNK_BYTES)
    paired = plan.withColumn("task", _task("group", tasks)).join(hashed, "set").select("task", "set", "group", "part", "lo", "hi", "sig", "hashes")
    return paired.groupBy("task").applyInArrow(_compare, "set binary, links long, peer binary")


def _told(rows: DataFrame) -> DataFrame:
    """One row per row of (row, id, text): row, doc_id, class_id, n_links, rep_id, copies, keep (the row that stays)."""
    signs = rt.materialise(signed(rows), "signed")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    classes = rt.materialise(signs.groupBy("set").agg(best, F.count(F.lit(1)).alias("copies"), F.first("shingles").alias("shingles"), F.first("sig").alias("sig")), "classes")
    found = rt.materialise(links(rows, classes), "links")
    counts = found.groupBy("set").agg(F.sum("links").alias("n_links"))
    labels = rt.components(found.where("peer is not null").select(F.col("set").alias("a"), F.col("peer").alias("b")))
    linked = rt.materialise(labels.select(F.col("node").alias("set"), "label").join(classes.select("set", "best"), "set"), "linked")
    least = linked.groupBy("label").agg(F.min("best").alias("first"), F.count(F.lit(1)).alias("size"))
    linked = rt.lookup(linked.select("set", "label"), least, "label", "size", linked.count()).select("set", "first")
    told = classes.select("set", "best", "copies").join(linked, "set", "left").join(counts, "set", "left")
    told = told.select(F.hex("set").alias("set"), "best", "copies", F.coalesce("first", "best").alias("first"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = rt.lookup(signs.select("row", F.col("id").alias("doc_id"), F.hex("set").alias("set")), told, "set", "copies", signs.count())
    return out.select("row", "doc_id", F.col("first.id").alias("class_id"), "n_links", F.col("best.id").alias("rep_id"), "copies", F.col("first.row").alias("keep"))


def near_dup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id (least id of its group), n_links (other classes of equal sets it is linked
    to), rep_id (least id of its class), copies (rows of its class)."""
    rows = rt.packed(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    return _told(rt.materialise(rows, "texts")).drop("row", "keep")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates, the one with the least id; all columns are kept."""
    rows = rt.packed(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "id", F.col("row").alias("__row"))
    rows = rt.materialise(rows, "texts")
    told = _told(rows.select("row", "id", rt.text_of(F.col("__row")[text_col]).alias("text")))
    kept = rows.join(told.where("row = keep").select("row"), "row", "left_semi")
    return rt.unpacked(kept.select(F.col("__row").alias("row")), docs)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup(rt.read_table(spark, sf_dir, "documents"))


#: Exact similarities of all texts that share a shingle; components by reachability.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(len(ws), 5) - 1], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0) AS x),
d AS (SELECT w.doc_id, coalesce(z.key, '') AS key, coalesce(z.n, 0) AS n FROM w LEFT JOIN (SELECT doc_id, sha256(array_to_string(list_sort(list(k)), chr(10))) AS key, count(*) AS n FROM t GROUP BY doc_id) AS z ON w.doc_id = z.doc_id),
c AS (SELECT key, min(doc_id) AS rep_id, count(*) AS copies, max(n) AS n FROM d GROUP BY key),
m AS (SELECT t.doc_id, t.k FROM t JOIN c ON t.doc_id = c.rep_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM m x JOIN m y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id) AS j JOIN c p ON p.rep_id = a JOIN c q ON q.rep_id = b WHERE shared >= 0.8 * (p.n + q.n - shared) - 1e-9),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a, min(b) AS least_id FROM r GROUP BY a), l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, least(c.rep_id, coalesce(g.least_id, c.rep_id)) AS class_id, coalesce(l.n_links, 0) AS n_links, c.rep_id, c.copies FROM d JOIN c ON d.key = c.key LEFT JOIN g ON g.a = c.rep_id LEFT JOIN l ON l.a = c.rep_id
"""
