"""Target-distribution importance resampling over a position table of n-grams.

Words of a text become rows (document, position, word) by posexplode(); for each order above one, lead() over a document's
positions gives the following words, which are concatenated to the feature. Features are hashed into buckets. Counted over all
documents and over all texts of the target, a bucket has a gain: the rounded-down thousandfold log ratio of its smoothed share of
the target and of the corpus. A document weighs the sum of the gains of its features. A Gumbel number drawn from its id is
added to the weight, so that the highest sums are a sample without replacement by importance; that many documents are drawn as
`percent` of those with at least `least` words.

Buckets are counted after combining in the map tasks; gains are one row per bucket, a number that `buckets` bounds, and are
broadcast to the position table; only one sum per document is shuffled. Ranks are the place in a sorted range plus the sizes of the
ranges before it, so no task sorts all documents.

Null and empty texts have no features and weigh 0; they are ranked only if `least` is 0. Null ids draw as the empty id and lose
ties; rows that repeat an id are rows of their own and draw the same number, in reading order if all else ties. A very long text
is one row, whose words are streamed (orders above one sort the words of a text within one task). An empty corpus gives an empty
result, an empty target gains from smoothing alone. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime as rt

#: What a word is once A-Z are lower-cased, the number of buckets, and that of the draw.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SEED = 2024
#: Bits of monotonically_increasing_id() that count rows within a partition.
ROW_BITS = 33


def positions(rows: DataFrame) -> DataFrame:
    """rows (text and others) as one row per word, with pos and word; a text without words gives one row of nulls."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    others = [c for c in rows.columns if c != "text"]
    return rows.select(*others, F.posexplode_outer(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))).alias("pos", "word"))


def features(rows: DataFrame, orders: int, buckets: int) -> DataFrame:
    """rows (no, text and others) as one row per word and order of a feature that begins there: pos, bucket and size (words)."""
    words = positions(rows)
    others = [c for c in words.columns if c not in ("pos", "word")]
    bucket = lambda feature: (F.crc32(feature.cast("binary")) % buckets).cast("int")
    if orders == 1:
        return words.select(*others, "pos", bucket(F.col("word")).alias("bucket"), F.lit(1).alias("size"))
    after = Window.partitionBy("no").orderBy("pos")
    made: list[Column] = [F.col("word")]
    for k in range(1, orders):
        made.append(F.concat(made[-1], F.lit(" "), F.lead("word", k).over(after)))
    grams = words.select(*others, "pos", F.array(*[F.struct(bucket(g).alias("bucket"), F.lit(k + 1).alias("size")) for k, g in enumerate(made)]).alias("g"))
    return grams.select(*others, "pos", F.inline("g")).where(F.col("bucket").isNotNull() | (F.col("size") == 1))


def counted(rows: DataFrame, orders: int, buckets: int) -> DataFrame:
    """(bucket, n) of all features of rows."""
    return features(rows, orders, buckets).where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket, from the counts of both sides."""
    whole = lambda t: F.coalesce(F.sum(t).over(Window.partitionBy()), F.lit(0))
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    real = lambda c: c.cast("double")
    odds = real(F.col("t") + 1) * real(whole("s") + buckets) / (real(F.col("s") + 1) * real(whole("t") + buckets))
    return both.select("bucket", F.floor(1000 * F.log(odds)).cast("long").alias("gain"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """The rounded-down thousandfold Gumbel number of an id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighed(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per row of docs: no, doc_id, n_words, n_features, weight, score."""
    rows = docs.select(rt.named(id_col).cast("long").alias("doc_id"), rt.text_of(rt.named(text_col)).alias("text"))
    wanted = target.select(F.monotonically_increasing_id().alias("no"), rt.text_of(rt.named(target_col)).alias("text"))
    numbered = rows.select(F.monotonically_increasing_id().alias("no"), "doc_id", "text")
    gain = rt.materialise(gains(counted(numbered, orders, buckets), counted(wanted, orders, buckets), buckets).coalesce(1), "gains")
    per = features(numbered, orders, buckets).join(F.broadcast(gain), "bucket", "left").groupBy("no", "doc_id")
    made = per.agg(F.count(F.when(F.col("size") == 1, F.col("bucket"))).alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    return made.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def ranked(rows: DataFrame, first: int, parts: int) -> DataFrame:
    """rows (no, doc_id, score and others) with rank: 1, 2, ... for the `first` highest scores, ties to the smaller id, else null."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("no").asc()]
    sorted_rows = rt.materialise(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ranked")
    at = F.shiftright("place", ROW_BITS)
    sizes = sorted_rows.groupBy(at.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    known = sorted_rows.withColumn("part", at).join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    rank = (F.col("before") + F.col("place").bitwiseAND((1 << ROW_BITS) - 1) + 1).cast("long")
    return known.withColumn("rank", F.when(rank <= first, rank)).select(*rows.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, **how) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank (null where it is not drawn). `how` as in weighed()."""
    spark = docs.sparkSession
    rows = rt.materialise(weighed(docs, target, **how), "weighed")
    fit = F.col("n_words") >= least
    total = rows.where(fit).count()
    drawn = ranked(rows.where(fit), percent * total // 100, rt.partitions(spark))
    out = drawn.unionByName(rows.where(~fit).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(rt.read_table(spark, sf_dir, "documents"), rt.read_table(spark, sf_dir, "benchmark"))


#: crc32 of a string as SQL: the table is worked out from the polynomial.
CRC_TABLE = "(SELECT list(list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM (SELECT unnest(range(0, 256)) AS i))"


def crc_sql(value: str, table: str) -> str:
    """crc32 of the UTF-8 bytes of the SQL string `value`; `table` is CRC_TABLE's column."""
    hexed = f"hex(encode({value}))"
    numbers = f"list_transform(range(0, length({hexed}) // 2), lambda k: CAST('0x' || substr({hexed}, CAST(2 * k + 1 AS INT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {numbers}), lambda c, b: xor(c // 256, {table}[CAST(xor(c % 256, b) + 1 AS INT)])), 4294967295)"


def _oracle() -> str:
    words = lambda text: f"regexp_extract_all(translate(coalesce({text}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH crc AS {CRC_TABLE},
d AS (SELECT row_number() OVER () AS no, doc_id, {words("text")} AS w FROM documents),
b AS (SELECT {words("text")} AS w FROM benchmark),
dw AS (SELECT no, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b),
v AS (SELECT word, {crc_sql("word", "t")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)) CROSS JOIN crc),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN v USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN v USING (word) GROUP BY bucket),
g AS (SELECT r AS bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(0, {BUCKETS})) AS r) LEFT JOIN s ON s.bucket = r LEFT JOIN t ON t.bucket = r),
p AS (SELECT no, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN v USING (word) JOIN g USING (bucket) GROUP BY no),
x AS (SELECT no, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN p USING (no)),
r AS (SELECT no, row_number() OVER (ORDER BY score DESC, doc_id, no) AS rank, count(*) OVER () AS total FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * total // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (no)
"""


ORACLE = _oracle()
