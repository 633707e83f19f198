"""Spelling variants by two-dimensional range reporting with wavelet trees.

Two words are near if they differ by one inserted, deleted or replaced code point. Words are sorted in forward and in reverse
order. For a word and an edit position, words with the same text before it are an interval in forward order, words with the
same text after it an interval in reverse order; the near words are the points of that rectangle, which a wavelet tree over the
reverse ranks, in forward order, reports: one tree for replacements (same length), one for insertions (one more code point). A pair is
reported at exactly one position, the length of what both words begin with.

Spread over Spark, a rectangle needs only the words that share what lies before or behind a range of positions. A word goes once to
the key of its beginning, for edits in its second half, and once to the key of its end, for edits in its first half, in the
class of its length and in that of one less (for insertions). Keys are dealt to buckets by bytes. A key with more bytes than
`limit` is split: its words go to keys of either half of its range of positions, again and again; a key of one position holds no
more words than the alphabet allows. Links are counted and compared where they are found and are never rows.

Words are counted after combining in the map tasks. A word's form is at least `factor` times as frequent as the word, so chains of
forms are no longer than the logarithm of the largest count, and are followed by doubling.

Null and empty texts have no words; a null id stands in the checksum as empty; rows that repeat an id count each, so copies of a
text count; a very long text is one row, read run by run, and very long words are compared at such positions only where words
around them allow an edit. Ties go to the form that comes first in code-point order. An empty table gives an empty result. Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime as rt

#: Fixed values of the result: which runs lose a code point, the fewest code points and occurrences, and how much more frequent a form is.
DROP, SHORTEST, FEWEST, FACTOR = 31, 7, 2, 10
#: Bytes of words that one key may hold before it is split, and that one bucket holds on average.
LIMIT, BUCKET = 1 << 20, 1 << 21
#: Different words that a task counts before it sends its counts on, and rectangles that are reported at a time.
COUNTED, RECTANGLES = 200_000, 1 << 18


def _runs(least: int) -> re.Pattern:
    """Maximal runs of at least `least` code points of A-Z (lower-cased before), a-z and U+00C0 to U+00FF in UTF-8."""
    return re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % least)


def variant(run: bytes, prefix_crc: int, drop: int, least: int) -> bytes | None:
    """The word of a run: without one of its code points if its checksum says so; None if it is too short then."""
    h = zlib.crc32(run, prefix_crc)
    if h % drop:
        return run
    word = run.decode()
    if len(word) <= least:
        return None
    k = h % len(word)
    return (word[:k] + word[k + 1 :]).encode()


def _counts(drop: int, least: int):
    runs = _runs(least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def sent():
            out = pa.record_batch({"word": pa.array(list(seen), pa.binary()).cast(pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return out

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                prefix = zlib.crc32(b"" if i is None else b"%d" % i)
                prefix = zlib.crc32(b":", prefix)
                for m in runs.finditer(t.as_buffer().to_pybytes().lower()):
                    word = variant(m[0], prefix, drop, least)
                    if word is not None:
                        seen[word] = seen.get(word, 0) + 1
                        if len(seen) >= COUNTED:
                            yield sent()
        yield sent()

    return count


def vocabulary(docs: DataFrame, drop: int = DROP, least: int = SHORTEST, fewest: int = FEWEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words that occur at least `fewest` times."""
    rows = docs.select(rt.named(id_col).cast("long").alias("id"), rt.text_of(rt.named(text_col)).alias("text"))
    return rows.mapInArrow(_counts(drop, least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def _key() -> Column:
    """Of a word of class c (length c or c + 1): what lies before position lo and behind the positions below hi."""
    behind = F.greatest(F.col("c") - F.col("hi"), F.lit(0))
    return F.xxhash64("c", "lo", "hi", F.expr("left(word, lo)"), F.when(behind > 0, F.expr("right(word, greatest(c - hi, 0))")).otherwise(F.lit("")))


def _halves(lo: Column, hi: Column) -> Column:
    mid = F.floor((lo + hi) / 2).cast("int")
    return F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi")))


def dealt(words: DataFrame, limit: int) -> DataFrame:
    """(word, n, c, lo, hi, key): words under keys that hold at most `limit` bytes, or one position."""
    size = F.char_length("word").cast("int")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("c"))
    rows = rows.select("word", "n", "c", F.inline(_halves(F.lit(0), F.col("c") + 1)))
    rows = rt.materialise(rows.withColumn("key", _key()), "dealt")
    done = None
    while True:
        # at most bytes / limit keys
        hot = rt.materialise(rows.groupBy("key").agg(F.sum(F.octet_length("word")).alias("bytes"), F.max(F.col("hi") - F.col("lo")).alias("width")).where((F.col("bytes") > limit) & (F.col("width") > 1)).select("key"), "hot")
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        cool = rows.join(hot, "key", "left_anti").select(*rows.columns)
        done = cool if done is None else done.unionByName(cool)
        split = rows.join(hot, "key", "left_semi").select("word", "n", "c", F.inline(_halves(F.col("lo"), F.col("hi")))).where("hi > lo")
        rows = rt.materialise(split.withColumn("key", _key()), "dealt")


class WaveletTree:
    """Over a permutation: for rectangles of places and values, the values in them. Level-wise bit ranks, all rectangles at once."""

    def __init__(self, values: np.ndarray):
        self.levels: list[tuple[np.ndarray, int]] = []
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 0
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit) & 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(1 - ones, out=before[1:])
            self.levels.append((before, int(before[-1])))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def report(self, begin, end, low, high):
        """(number of the rectangle, value) of every value in [low, high) at a place in [begin, end)."""
        q = np.flatnonzero((end > begin) & (high > low))
        left, right, value = begin[q], end[q], np.zeros(len(q), np.int64)
        for (zeros, total), bit in zip(self.levels, range(self.bits - 1, -1, -1), strict=True):
            zl, zr = zeros[left], zeros[right]
            q = np.concatenate([q, q])
            left, right = np.concatenate([zl, total + left - zl]), np.concatenate([zr, total + right - zr])
            value = np.concatenate([value, value + (1 << bit)])
            some = (right > left) & (value < high[q]) & (value + (1 << bit) > low[q])
            q, left, right, value = q[some], left[some], right[some], value[some]
        return q, value


def _shared(rows: np.ndarray) -> np.ndarray:
    """How many leading bytes each row of a sorted matrix shares with the one before (0 for the first)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


class _Order:
    """Words sorted by a matrix of bytes: the intervals of words that share a beginning, also counted among some words only."""

    def __init__(self, matrix: np.ndarray):
        n, width = matrix.shape
        self.order = np.argsort(np.ascontiguousarray(matrix).view(f"S{width}").ravel(), kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = np.arange(n)
        self.shared = _shared(matrix[self.order])
        after = np.append(self.shared[1:], 0)
        self.most = np.maximum(self.shared, after)[self.rank]  # per word, the most that it shares with another

    def interval(self, size: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of all words that begin like each of `words` up to `size`."""
        starts = np.flatnonzero(self.shared < size) if size else np.zeros(1, np.int64)
        if size and (not len(starts) or starts[0] != 0):
            starts = np.concatenate([[0], starts])
        ends = np.append(starts[1:], len(self.order))
        group = np.searchsorted(starts, self.rank[words], side="right") - 1
        return starts[group], ends[group]

    def counted(self, some: np.ndarray) -> np.ndarray:
        """How many of some (a mask over words) come before each place."""
        return np.concatenate([[0], np.cumsum(some[self.order])])


def near_pairs(words: list[bytes], c: int, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) places of near words, in both directions, whose edit lies at a position from lo below hi. All of different words of c or
    c + 1 bytes, one byte per code point; pairs of two words of c + 1 bytes belong to the next class."""
    n = len(words)
    flat = np.array(words, f"S{c + 1}")
    matrix = flat.view(np.uint8).reshape(n, c + 1)
    long = matrix[:, c] != 0
    if n < 2 or long.all():
        return
    backwards = matrix[:, ::-1].copy()
    backwards[~long, :c] = matrix[~long, :c][:, ::-1]
    backwards[~long, c] = 0
    forward, reverse = _Order(matrix), _Order(backwards)
    sides = []
    for some in (~long, long):
        fore, aft = forward.counted(some), reverse.counted(some)
        mine = forward.order[some[forward.order]]  # forward order
        at_value = reverse.order[some[reverse.order]]  # word by its rank in reverse order
        sides.append((fore, aft, at_value, WaveletTree(aft[reverse.rank[mine]])))
    first, last = np.maximum(lo, c - 1 - reverse.most), np.minimum(hi - 1, forward.most)
    able = np.flatnonzero(~long & (first <= last))
    if not len(able):
        return
    turns = np.zeros(c + 3, np.int64)
    np.add.at(turns, first[able], 1)
    np.add.at(turns, last[able] + 1, -1)
    held: list[list] = [[], []]

    def found(side: int):
        fore, aft, at_value, tree = sides[side]
        who, at, *box = (np.concatenate(x) for x in zip(*held[side], strict=True))
        held[side].clear()
        q, value = tree.report(*box)
        a, b, i = who[q], at_value[value], at[q]
        good = a != b if side == 0 else matrix[a, i] != matrix[b, i]
        a, b = a[good], b[good]
        return (a, b) if side == 0 else (np.concatenate([a, b]), np.concatenate([b, a]))

    waiting = [0, 0]
    for i in np.flatnonzero(np.cumsum(turns) > 0).tolist():
        mine = able[(first[able] <= i) & (i <= last[able])]
        begin, end = forward.interval(i, mine)
        for side, size in ((0, c - 1 - i), (1, c - i)):
            if size < 0:
                continue
            low, high = reverse.interval(size, mine)
            fore, aft = sides[side][:2]
            box = fore[begin], fore[end], aft[low], aft[high]
            some = (box[1] - box[0] > 1 - side) & (box[3] - box[2] > 1 - side)
            if some.any():
                held[side].append((mine[some], np.full(int(some.sum()), i, np.int64), *(x[some] for x in box)))
                waiting[side] += int(some.sum())
                if waiting[side] >= RECTANGLES:
                    waiting[side] = 0
                    yield found(side)
    for side in (0, 1):
        if held[side]:
            yield found(side)


_PART = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _bucket(table: pa.Table) -> pa.Table:
    """For each word with near words in the bucket: their number, and the most frequent of them."""
    columns = {k: table[k].to_numpy() for k in ("n", "c", "lo", "hi")}
    text = np.array([w.encode("latin-1") for w in table["word"].to_pylist()], object)
    order = np.lexsort((columns["hi"], columns["lo"], columns["c"]))
    kind = np.stack([columns[k][order] for k in ("c", "lo", "hi")])
    cuts = np.flatnonzero((kind[:, 1:] != kind[:, :-1]).any(axis=0)) + 1
    out = []
    for rows in np.split(order, cuts):
        words = text[rows].tolist()
        counts = columns["n"][rows]
        alphabet = np.empty(len(words), np.int64)
        alphabet[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        near, best = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        for a, b in near_pairs(words, *(int(columns[k][rows[0]]) for k in ("c", "lo", "hi"))):
            if not len(a):
                continue
            near += np.bincount(a, minlength=len(words))
            old = np.flatnonzero(best >= 0)
            a, b = np.concatenate([a, old]), np.concatenate([b, best[old]])
            ranked = np.lexsort((alphabet[b], -counts[b], a))
            heads = ranked[np.flatnonzero(np.diff(a[ranked], prepend=-1))]
            best[a[heads]] = b[heads]
        some = np.flatnonzero(near)
        out.append(pa.table([[words[k].decode("latin-1") for k in some], near[some], counts[best[some]], [words[k].decode("latin-1") for k in best[some]]], schema=_PART))
    return pa.concat_tables(out)


def neighbours(words: DataFrame, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """(word, near, best_n, best) of the words of (word, n) that have near words."""
    rows = dealt(words, limit)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("word") + 24), F.lit(0))).first()[0]
    buckets = max(rt.partitions(words.sparkSession), -(-size // bucket))
    parts = rows.withColumn("bucket", F.pmod("key", F.lit(buckets))).groupBy("bucket").applyInArrow(_bucket, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best")))
    return parts.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b")).select("word", "near", (-F.col("b.m")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of the chain. A form has no more words than one edit can make of it, so no key is hot."""
    now = rt.materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = rt.materialise(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        rt.discard(now)
        now = then.select("word", "root")
        if then.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, factor: int = FACTOR, limit: int = LIMIT, bucket: int = BUCKET, **how) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n. `how` as in vocabulary()."""
    words = rt.materialise(vocabulary(docs, **how), "vocabulary")
    known = words.join(neighbours(words, limit, bucket), "word", "left")
    formed = F.col("best_n") >= factor * F.col("n")
    rows = rt.materialise(known.select("word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n")), "variants")
    chained = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(chained, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(rt.read_table(spark, sf_dir, "documents"))


def _oracle() -> str:
    from .importance import CRC_TABLE, crc_sql

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE crc AS {CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
h AS (SELECT run, {crc_sql("concat(doc_id, ':', run)", "t")} AS h FROM (SELECT * FROM r WHERE length(run) >= {SHORTEST}) CROSS JOIN crc),
o AS (SELECT CASE WHEN h % {DROP} = 0 THEN concat(substr(run, 1, CAST(h % length(run) AS INT)), substr(run, CAST(h % length(run) AS INT) + 2)) ELSE run END AS word FROM h),
w AS (SELECT word, count(*) AS n FROM o WHERE length(word) >= {SHORTEST} GROUP BY word HAVING count(*) >= {FEWEST}),
k AS (SELECT word, i, concat(substr(word, 1, i), substr(word, i + 2)) AS cut FROM (SELECT word, CAST(unnest(range(0, length(word))) AS INT) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b FROM k AS a JOIN k AS b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT k.word, w.word FROM k JOIN w ON k.cut = w.word UNION SELECT w.word, k.word FROM k JOIN w ON k.cut = w.word),
g AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY w.n DESC, encode(b)) AS best, max(w.n) AS best_n FROM p JOIN w ON p.b = w.word GROUP BY a),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {FACTOR} * w.n THEN best END AS form, CASE WHEN best_n >= {FACTOR} * w.n THEN best_n END AS form_n FROM w LEFT JOIN g USING (word)),
c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, last.root, CAST(f.n AS BIGINT) AS n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f
JOIN (SELECT c.word, c.root FROM c JOIN f ON c.root = f.word WHERE f.form IS NULL) AS last ON f.word = last.word
"""


ORACLE = _oracle()
