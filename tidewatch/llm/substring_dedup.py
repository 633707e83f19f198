r"""Substring deduplication by level-wise doubling.

A window is WINDOW consecutive words of one document, words being runs of [^\x20\x09-\x0D]. Every word that some window
covers whose word sequence also starts earlier (in a document with a smaller id, or earlier in the same) is removed.

Levels: runs of BASE words are tested for being repeated anywhere in the corpus; those repeated alone are extended to twice
that length and tested again, until WINDOW is reached or no candidate survives. A window stands for itself at a level by its
anchor, the run of that length with the least hash inside it, so two equal windows have the same anchor and none is missed,
while neighbouring windows share most of their anchors. At the last level the earliest place of each sequence is found,
and every other occurrence is removed.

Documents are split into words once and travel as blocks: each distinct word of some MB of text once, and the numbers of the
words, compressed, in the shared folder. A level sends the distinct hashes of a block to hash buckets, packed in arrays, and gets
one bit back for each. Hashes that are in HOT_BLOCKS of SAMPLE_BLOCKS blocks are not sent to a bucket, which would get one from
every block: short ones are known to be repeated, and of whole windows the first place is found by a sum with combining in
the map tasks. The sample only picks the way; every hash has its exact answer. Short runs are told apart by 64 bits,
which can only add candidates; whole windows by 128.

Null and empty texts have no words. Null ids count as later than all others; of rows that tie in their id, the one in the earlier
block, then the earlier row counts as earlier. A very long text is a block of its own and must fit a task. An empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime as rt

WINDOW, BASE = 20, 5
#: Raw text of a block, and the most documents in it.
BLOCK_BYTES, BLOCK_DOCS = 2_000_000, 4_000
#: Hashes that a bucket should hold.
BUCKET = 1_000_000
#: Blocks in which frequent hashes are looked for (about), and in how many of them they are.
SAMPLE_BLOCKS, HOT_BLOCKS = 64, 8
_SECOND = np.uint64(0xA0761D6478BD642F)


def levels(window: int, base: int) -> list[int]:
    out = [base]
    while out[-1] < window:
        out.append(min(window, 2 * out[-1]))
    return out


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, blob, words): documents packed in the order in which they are read, as the numbers of their words."""

    def made(batches):
        import zstandard
        from pyspark import TaskContext

        k, ids, held, size = TaskContext.get().partitionId() << 32, [], [], 0
        squeeze = zstandard.ZstdCompressor(level=1)

        def block():
            words, counts = [w for t in held for w in t], [len(t) for t in held]
            number = {w: i for i, w in enumerate(dict.fromkeys(words))}
            of = np.fromiter(map(number.__getitem__, words), np.uint32, len(words))
            table = pa.table({"ids": pa.array([ids], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int64())), "words": pa.array([b" ".join(number)], pa.large_binary()), "of": pa.array([of.tobytes()], pa.large_binary())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            return pa.record_batch({"block": pa.array([k], pa.int64()), "blob": pa.array([squeeze.compress(sink.getvalue())], pa.binary()), "words": pa.array([len(of)], pa.int64())})

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = t.encode()
                if ids and (size + len(raw) > BLOCK_BYTES or len(ids) >= BLOCK_DOCS):
                    yield block()
                    k, ids, held, size = k + 1, [], [], 0
                ids.append(i)
                held.append(raw.split())
                size += len(raw)
        if ids:
            yield block()

    return docs.select(rt.named(id_col).cast("long"), rt.text_of(rt.named(text_col))).mapInArrow(made, "block long, blob binary, words long")


class Block:
    """A block's documents as one run of word hashes; windows never cross documents."""

    def __init__(self, blob: bytes):
        import xxhash
        import zstandard

        table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()
        self.ids, counts = table["ids"][0].as_py(), table["counts"][0].as_py()
        self.vocabulary = table["words"][0].as_py().split()
        self.of = np.frombuffer(table["of"][0].as_py(), np.uint32)
        self.counts = np.array(counts, np.int64)
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.vocabulary)), ">u8").astype(np.uint64).reshape(-1, 2)
        self.h, self.second = both[:, 1][self.of], both[:, 0]
        self.doc = np.repeat(np.arange(len(counts)), self.counts)
        #: of each document whether it has no id, and the id
        self.none, self.id = np.array([i is None for i in self.ids], np.uint8), np.array([i or 0 for i in self.ids], np.int64)
        #: places of documents in the order of their ids
        self.rank = np.empty(len(counts), np.int64)
        self.rank[sorted(range(len(counts)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0, k))] = np.arange(len(counts))

    def windows(self, k: int) -> np.ndarray:
        """Starts of the k-word windows, none of which crosses documents."""
        n = len(self.h) - k + 1
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def anchors(self, starts: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window the hash of its anchor, the least of its runs of `length` words, and where that run (the first of equals) is."""
        h = rt.window_hashes(self.h, length)
        run = np.lib.stride_tricks.sliding_window_view(h, window - length + 1)
        at = np.concatenate([np.argmin(run[part], axis=1) + part for part in np.array_split(starts, max(1, len(starts) // 100_000))])
        return h[at], at

    def whole(self, starts: np.ndarray, window: int) -> np.ndarray:
        """Two 64-bit hashes of each window, from different hashes of its words."""
        second = rt.window_hashes(self.second[self.of] ^ _SECOND, window)
        return np.stack([rt.window_hashes(self.h, window)[starts], second[starts]], axis=1)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of keys (n, 1 or 2) in order, the first place of each, and the number of each place's row."""
    head = np.ascontiguousarray(keys[:, 0])
    order = np.argsort(head)
    new = np.ones(len(order), bool)
    new[1:] = head[order[1:]] != head[order[:-1]]
    if keys.shape[1] > 1 and (~new[1:] & (keys[order[1:], 1] != keys[order[:-1], 1])).any():  # different rows that begin alike
        order = np.lexsort(keys.T[::-1])
        new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    first = np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order
    return keys[first], first, inverse


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which rows of keys are rows of `some`, whose rows are distinct and in order."""
    if not len(some) or not len(keys):
        return np.zeros(len(keys), bool)
    if (some[1:, 0] != some[:-1, 0]).all():
        at = np.minimum(np.searchsorted(some[:, 0], keys[:, 0]), len(some) - 1)
        return (some[at] == keys).all(axis=1)
    _, _, inverse = _distinct(np.concatenate([some, keys]))
    there = np.zeros(len(some) + len(keys), bool)
    there[inverse[: len(some)]] = True
    return there[inverse[len(some) :]]


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys by bucket, and where each bucket ends."""
    to = (rt.mix(keys[:, 0] ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)
    return np.argsort(to, kind="stable"), np.cumsum(np.bincount(to, minlength=buckets))


class Level:
    """What is known of a level: its buckets and frequent keys."""

    def __init__(self, length: int, buckets: int, hot: np.ndarray):
        self.length, self.buckets, self.hot = length, buckets, hot

    def said(self, keys: np.ndarray, parts: list) -> np.ndarray:
        """Answers for distinct keys in order: True for frequent ones, else the bit of their bucket."""
        out = _among(keys, self.hot)
        cold = np.flatnonzero(~out)
        order, ends = _dealt(keys[cold], self.buckets)
        for p in parts or []:
            at = cold[order[(ends[p["bucket"] - 1] if p["bucket"] else 0) : ends[p["bucket"]]]]
            out[at] = np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=len(at)).astype(bool)
        return out


def _keys(block: Block, starts: np.ndarray, length: int, window: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys of a level in order, and what goes with each: whether it has two places in the block; at the last level
    whether its first document has no id, and that id."""
    if length < window:
        h, at = block.anchors(starts, length, window)
        at, first = np.unique(at, return_index=True)  # windows that share an anchor are one place
        keys, _, inverse = _distinct(h[first][:, None])
        return keys, [(np.bincount(inverse, minlength=len(keys)) > 1).astype(np.uint8)]
    order = np.argsort(block.rank[block.doc[starts]], kind="stable")
    keys, first, _ = _distinct(block.whole(starts, window)[order])
    doc = block.doc[starts[order[first]]]
    return keys, [block.none[doc], block.id[doc]]


def _blocks(batches, window: int):
    """(name, block, starts of candidate windows) of each block of a task; no bits: all windows are candidates."""
    for b in batches:
        for name, blob, alive in zip(*(b.column(c).to_pylist() for c in ("block", "blob", "alive")), strict=True):
            block = Block(blob)
            starts = block.windows(window)
            if alive is not None:
                starts = np.flatnonzero(np.unpackbits(np.frombuffer(alive, np.uint8), count=min(len(block.h), 8 * len(alive))))
            yield name, block, starts


def _frequent(state: DataFrame, length: int, window: int, count: int) -> np.ndarray:
    """Keys that are in HOT_BLOCKS or more of the sampled blocks: a bounded number."""

    def send(batches):
        for _, block, starts in _blocks(batches, window):
            if len(starts):
                keys, _ = _keys(block, starts, length, window)
                yield pa.record_batch({"h": pa.array(keys[:, 0].copy().view(np.int64)), "g": pa.array(keys[:, -1].copy().view(np.int64))})

    some = state.where(F.pmod(F.xxhash64("block"), F.lit(max(1, count // SAMPLE_BLOCKS))) == 0)
    found = some.mapInArrow(send, "h long, g long").groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_BLOCKS)
    keys = np.array([(r.h, r.g) for r in found.collect()], np.int64).reshape(-1, 2).view(np.uint64)
    return _distinct(keys if length == window else keys[:, :1])[0]


def _sent(state: DataFrame, level: Level, window: int) -> DataFrame:
    """One row per bucket and block: the keys that belong there, with what goes with them."""

    def send(batches):
        for name, block, starts in _blocks(batches, window):
            if not len(starts):
                continue
            keys, extra = _keys(block, starts, level.length, window)
            cold = np.flatnonzero(~_among(keys, level.hot))
            order, ends = _dealt(keys[cold], level.buckets)
            there = np.flatnonzero(np.diff(np.concatenate([[0], ends]))).tolist()
            places = [cold[order[(ends[b - 1] if b else 0) : ends[b]]] for b in there]
            packed = [[x[p].tobytes() for p in places] for x in (keys, *extra)]
            columns = [pa.array(there, pa.int64()), pa.array([name] * len(there), pa.int64()), *[pa.array(x, pa.binary()) for x in packed]]
            yield pa.record_batch(columns, names=["bucket", "block", "keys", "flag", "id"][: len(columns)])

    return state.mapInArrow(send, "bucket long, block long, keys binary, flag binary" + (", id binary" if level.length == window else ""))


def _kept(state: DataFrame, answer: DataFrame, level: Level, window: int) -> DataFrame:
    """The state with only those candidates whose anchor is repeated."""

    def keep(batches):
        for b in batches:
            parts = b.column("parts").to_pylist()
            bits = []
            for (_, block, starts), said in zip(_blocks([b], window), parts, strict=True):
                left = np.zeros(len(block.h), np.uint8)
                if len(starts):
                    keys, _, inverse = _distinct(block.anchors(starts, level.length, window)[0][:, None])
                    left[starts[level.said(keys, said)[inverse]]] = 1
                bits.append(np.packbits(left).tobytes())
            yield b.select(["block", "blob"]).append_column("alive", pa.array(bits, pa.binary()))

    return state.join(answer.select("block", "parts"), "block", "left").mapInArrow(keep, "block long, blob binary, alive binary")


def _ask(sent: DataFrame, last: bool) -> DataFrame:
    """(block, parts, yes): for each key of a block whether it is repeated (last: whether another place is earlier)."""

    def tested(table: pa.Table) -> pa.Table:
        raw = table["keys"].to_pylist()
        keys = np.frombuffer(b"".join(raw), np.uint64).reshape(-1, 2 if last else 1)
        sizes = np.array([len(x) for x in raw]) // (16 if last else 8)
        flag = np.frombuffer(b"".join(table["flag"].to_pylist()), np.uint8)
        if last:  # the earliest: the least id, none after all others, then the first block
            ids, block = np.frombuffer(b"".join(table["id"].to_pylist()), np.int64), np.repeat(table["block"].to_numpy(), sizes)
            order = np.lexsort((block, ids, flag, keys[:, 1], keys[:, 0]))
            later = np.zeros(len(order), bool)
            later[1:] = (keys[order[1:]] == keys[order[:-1]]).all(axis=1)
            bits = np.empty(len(order), bool)
            bits[order] = later
        else:  # repeated in the block itself (flag), or in several blocks
            _, group = np.unique(keys[:, 0], return_inverse=True)
            bits = (np.bincount(group, 1 + flag) > 1)[group]
        parts = np.split(bits, np.cumsum(sizes)[:-1])
        return pa.table({"block": table["block"], "bucket": table["bucket"], "bits": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary()), "yes": pa.array([int(p.sum()) for p in parts], pa.int64())})

    got = sent.groupBy("bucket").applyInArrow(tested, "block long, bucket long, bits binary, yes long")
    return got.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("parts"), F.sum("yes").alias("yes"))


def _first_places(state: DataFrame, level: Level, window: int) -> dict[tuple[int, int], int]:
    """The block of the first occurrence of each frequent window, of which there is a bounded number."""

    def send(batches):
        for name, block, starts in _blocks(batches, window):
            starts = starts[_among(block.whole(starts, window), level.hot)] if len(starts) else starts
            if len(starts):
                keys, (none, ids) = _keys(block, starts, window, window)
                yield pa.record_batch({"h": pa.array(keys[:, 0].copy().view(np.int64)), "g": pa.array(keys[:, 1].copy().view(np.int64)), "none": pa.array(none.astype(np.int32)), "id": pa.array(ids), "block": pa.array(np.full(len(keys), name))})

    rows = state.mapInArrow(send, "h long, g long, none int, id long, block long")
    first = rows.groupBy("h", "g").agg(F.min(F.struct("none", "id", "block")).alias("first"))
    return {(r.h & _WORD, r.g & _WORD): r.first.block for r in first.collect()}


_WORD = (1 << 64) - 1


def _removed(block: Block, name: int, starts: np.ndarray, later: list, last: Level, owners: dict, window: int) -> np.ndarray:
    """Which words go: those of windows that are not the first of their sequence."""
    gone = np.zeros(len(block.h) + 1, np.int64)
    if len(starts):
        starts = starts[np.argsort(block.rank[block.doc[starts]], kind="stable")]
        keys, first, inverse = _distinct(block.whole(starts, window))
        elsewhere = last.said(keys, later)
        for k in np.flatnonzero(_among(keys, last.hot)).tolist():
            elsewhere[k] = owners[int(keys[k, 0]), int(keys[k, 1])] != name
        bad = elsewhere[inverse]
        own = np.ones(len(starts), bool)
        own[first] = False
        bad = starts[bad | own]
        np.add.at(gone, bad, 1)
        np.add.at(gone, bad + window, -1)
    return np.cumsum(gone)[:-1] > 0


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.string())])


def substring_dedup(docs: DataFrame, window: int = WINDOW, base: int = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, removed (start-end of each removed run of words)."""
    spark = docs.sparkSession
    held = rt.materialise(blocks(docs, id_col, text_col), "blocks", "none")
    told = held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    none = F.array().cast("array<struct<bucket:bigint,bits:binary>>").alias("parts")
    state = held.select("block", "blob", F.lit(None).cast("binary").alias("alive"))
    owners: dict = {}
    for length in levels(window, base):
        level = Level(length, max(8, int(told.words // (8 if length < window else 2) // BUCKET)), _frequent(state, length, window, told.n))
        answer = rt.materialise(_ask(_sent(state, level, window), length == window), f"level{length}")
        if length == window:
            owners = _first_places(state, level, window) if len(level.hot) else {}
            state = state.join(answer.select("block", "parts"), "block", "left")
        elif not len(level.hot) and not (answer.agg(F.sum("yes")).first()[0] or 0):
            level = Level(window, 8, np.zeros((0, 2), np.uint64))
            state = state.select("block", "blob", F.lit(b"").alias("alive"), none)  # no window can be repeated
            break
        else:
            old, state = held, rt.materialise(_kept(state, answer, level, window), "blocks", "none")
            rt.discard(old, answer)
            held = state
    shared = spark.sparkContext.broadcast(owners)

    def finish(batches):
        for b in batches:
            for (name, block, starts), later in zip(_blocks([b], window), b.column("parts").to_pylist(), strict=True):
                gone = _removed(block, name, starts, later, level, shared.value, window)
                ends, words = np.cumsum(block.counts).tolist(), block.vocabulary
                rows = []
                for i, n, end in zip(block.ids, block.counts.tolist(), ends, strict=True):
                    cut, of = gone[end - n : end], block.of[end - n : end]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], cut.astype(np.int8), [0]])))
                    kept = of[~cut].tolist()
                    rows.append((i, n, n - len(kept), hashlib.sha256(b" ".join(map(words.__getitem__, kept))).hexdigest(), ",".join(f"{a}-{z}" for a, z in edges.reshape(-1, 2).tolist())))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RESULT, strict=True)], schema=RESULT)

    return state.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(rt.read_table(spark, sf_dir, "documents")).drop("removed")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20) AS x),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM s),
g AS (SELECT DISTINCT doc_id, i + j AS p FROM f CROSS JOIN (SELECT unnest(range(0, 20)) AS j) AS r WHERE nth > 1),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
k AS (SELECT x.doc_id, count(g.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE g.p IS NULL), '') AS kept FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
