r"""Secret scan with corpus-wide ownership frequency, with DataFrame functions only.

Three base kinds are always reported, with spans in code points, end exclusive:

* assign: a keyword (password, passwd, secret, token, apikey, api_key; letters in either case), a separator and a
  value of 6 or more characters;
* access: AKIA and capitals or digits, 20 or more characters in all;
* hex: 24 or more characters of [0-9a-f].

Besides, strings of 16 or more characters that mix letters and digits are candidates. Every candidate value is hashed and
counted over the whole corpus by distinct owners and distinct repositories. A value is a live-looking credential of
its owner if at most MAX_OWNERS owners and at most MAX_REPOS repositories hold it; beyond either it is a widely copied example.
Live candidates that no base span covers are added as spans of kind `owned`.

Null and empty texts have no spans; a null owner or repository counts as one of its own; rows that repeat an id are
each reported (copies of a text by one owner count once for its owners); spans that tie in their start are listed in the order
of the kinds; the work on a very long text grows in proportion to it and its spans; an empty table gives an empty result;
other columns, whatever their names, are ignored, or kept by mask_live().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime as rt

#: Patterns of the base kinds, in the order in which spans of one start are listed.
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")
#: A run of 16 or more value characters; greedy runs, so a shorter run holds none.
WIDE = r"[A-Za-z0-9+/_=-]{16,}"
#: The fewest different characters of a candidate that has letters of one case only.
VARIETY = 10
#: The most owners and repositories of a value that still counts as owned by them.
MAX_OWNERS, MAX_REPOS = 2, 3
#: Code points that are masked at a time, and numbers that are summed at a time (a power of two).
PIECE, RUN = 1 << 14, 1 << 6

_SPAN = "struct<start:bigint,ord:int,end:bigint,kind:string,value:string>"


def _with(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value) with value worked out once, however often it is used."""
    return F.transform(F.array(value), made)[0]


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)


def _greatest(x: Column) -> Column:
    return F.coalesce(F.array_max(x), F.lit(-1).cast("long"))


def _cumulated(numbers: Column, total: Callable[[Column], Column] = _sum, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """The total (sum, or greatest of numbers from 0 on) of the first 1, 2, ... numbers: by runs, so that the work stays near linear."""

    def all_of(d: Column) -> Column:
        runs = F.sequence(F.lit(0), F.shiftright(F.size(d) - 1, RUN.bit_length() - 1))
        each = F.transform(runs, lambda j: total(F.slice(d, j * RUN + 1, F.lit(RUN))))
        before = _with(each, lambda s: F.transform(runs, lambda j: total(F.slice(s, F.lit(1), j))))
        number = F.sequence(F.lit(0), F.size(d) - 1)
        run = lambda k: F.shiftright(k, RUN.bit_length() - 1)
        return _with(before, lambda b: F.transform(number, lambda k: join(F.get(b, run(k)), total(F.slice(d, run(k) * RUN + 1, k.bitwiseAND(RUN - 1) + 1)))))

    return F.when(F.size(numbers) > 0, _with(numbers, all_of)).otherwise(F.expr("cast(array() as array<bigint>)"))


def _greatest_so_far(numbers: Column) -> Column:
    return _cumulated(numbers, _greatest, F.greatest)


def _below(rising: Column, x: Column) -> Column:
    """How many of rising numbers are less than x, by halving."""
    step = lambda at, bit: F.when(F.get(rising, at + bit - 1) < x, at + bit).otherwise(at)
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), F.lit(0), step)


def _spans(text: Column, kind: str, order: int, pattern: str, value_group: int, least: int) -> Column:
    """array<struct<start,ord,end,kind,value>> of the leftmost non-overlapping matches."""

    def made(matches: Column) -> Column:
        between = F.split(text, pattern, -1)
        gaps = F.zip_with(between, F.concat(F.array(F.lit("")), matches), lambda p, m: (F.char_length(p) + F.coalesce(F.char_length(m), F.lit(0))).cast("long"))

        def span(x: Column) -> Column:
            value = F.regexp_extract(x["m"], pattern, value_group) if value_group else x["m"]
            return F.struct(x["start"].alias("start"), F.lit(order).alias("ord"), (x["start"] + F.char_length(x["m"])).alias("end"), F.lit(kind).alias("kind"), value.alias("value"))

        placed = F.filter(F.arrays_zip(matches.alias("m"), _cumulated(gaps).alias("start")), lambda x: x["m"].isNotNull())
        return F.filter(F.transform(placed, span), lambda s: F.char_length(s["value"]) >= least)

    found = _with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), made)
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))


def _varied(span: Column) -> Column:
    """A value with digits and letters of both cases, or of one case and VARIETY different characters."""
    v = span["value"]
    small, large = v.rlike("[a-z]"), v.rlike("[A-Z]")
    return v.rlike("[0-9]") & (small | large) & ((small & large) | (F.size(F.array_distinct(F.split(v, ""))) >= VARIETY))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def candidates(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of rows (text, owner, repo), with owner, repo and the spans base and wide."""
    text = F.col("text")
    base = F.concat(_spans(text, "assign", 0, ASSIGN, 2, 6), _spans(text, "access", 1, ACCESS, 0, 20), _spans(text, "hex", 2, HEX, 0, 24))
    wide = F.filter(_spans(text, "owned", 3, WIDE, 0, 16), _varied)
    made = rows.select(*keep, F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"), base.alias("base"), wide.alias("wide"))
    return made.withColumn("wide", F.when((F.size("wide") == 0) | (F.size("base") == 0), F.col("wide")).otherwise(_apart(F.col("wide"), F.col("base"))))


def _apart(wide: Column, base: Column) -> Column:
    """The spans of wide that no span of base overlaps, by one pass over both: at a span's end, what begins before it must have ended by its start."""
    event = lambda s, at, order: F.struct(at.alias("at"), order.alias("order"), s.alias("span"))
    both = F.array_sort(F.concat(F.transform(wide, lambda w: event(w, w["end"], F.lit(0))), F.transform(base, lambda b: event(b, b["start"], F.lit(1)))))

    def kept(events: Column) -> Column:
        reach = _greatest_so_far(F.transform(events, lambda e: F.when(e["order"] == 1, e["span"]["end"]).otherwise(F.lit(-1).cast("long"))))
        free = F.filter(F.arrays_zip(events.alias("e"), reach.alias("reach")), lambda z: (z["e"]["order"] == 0) & (z["reach"] <= z["e"]["span"]["start"]))
        return F.transform(free, lambda z: z["e"]["span"])

    return _with(both, kept)


def ownership(spans: DataFrame) -> DataFrame:
    """h, owners, repos, copies of every candidate value of (h, owner, repo) rows; counted after combining in the map tasks
    and by owner, so a value that everyone holds is never gathered."""
    pairs = spans.groupBy("h", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy("h", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("copies"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, whole_rows: bool = False) -> DataFrame:
    """Every row with its spans: id, base, wide and verdicts (array of struct<start,ord,end,live,owners,repos>); with whole_rows
    also text and row, a struct of the columns of docs."""
    told = lambda c: (c if c is not None else F.lit("")).cast("string")
    keep = ["id", "text", "row"] if whole_rows else ["id"]
    rows = docs.select(rt.named(id_col).cast("long").alias("id"), rt.text_of(rt.named(text_col)).alias("text"), F.struct(*[rt.named(c) for c in docs.columns]).alias("row"), told(owner).alias("owner"), told(repo).alias("repo"))
    found = rt.materialise(candidates(rows, keep).withColumn("no", F.monotonically_increasing_id()), "candidates")
    spans = found.select("no", "owner", "repo", F.explode(F.concat("base", "wide")).alias("s"))
    spans = rt.materialise(spans.select("no", "owner", "repo", F.sha2(F.col("s.value"), 256).alias("h"), F.col("s.start").alias("start"), F.col("s.ord").alias("ord"), F.col("s.end").alias("end")), "spans")
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    stats = ownership(spans).select("h", "owners", "repos", "copies", live.alias("live"))
    known = rt.lookup(spans.drop("owner", "repo"), stats, "h", "copies", spans.count())
    verdict = F.struct("start", "ord", "end", "live", "owners", "repos")
    verdicts = known.groupBy("no").agg(F.collect_list(verdict).alias("verdicts"))
    some = F.size("base") + F.size("wide") > 0
    none = F.expr("cast(array() as array<struct<start:bigint,ord:int,end:bigint,live:boolean,owners:bigint,repos:bigint>>)")
    cols = [*keep, "base", "wide", "verdicts"]
    return found.where(some).join(verdicts, "no").select(*cols).unionByName(found.where(~some).withColumn("verdicts", none).select(*cols))


def secret_scan(docs: DataFrame, **how) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples, n_owned, and the most
    owners and repositories of one of its values."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    lives = F.filter("verdicts", lambda v: v["live"])
    owned = F.filter("wide", lambda w: F.exists("verdicts", lambda v: v["live"] & (v["ord"] == 3) & (v["start"] == w["start"])))
    most = lambda name: F.coalesce(F.array_max(F.transform("verdicts", lambda v: v[name])), F.lit(0)).cast("long").alias(name)
    return judged(docs, **how).select(
        F.col("id").alias("doc_id"),
        *[count(k) for k in BASE],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", owned)).alias("spans"),
        F.size(lives).cast("long").alias("n_live"),
        (F.size("verdicts") - F.size(lives)).cast("long").alias("n_examples"),
        F.size(owned).cast("long").alias("n_owned"),
        most("owners"),
        most("repos"),
    )


MASK = "[SECRET]"


def _masked(text: Column, lives: Column) -> Column:
    """text with MASK for each of the sorted spans; one that overlaps the last only extends it. The text is cut into pieces once, as a
    substring is found by counting from the beginning, and the spans of a piece are found by halving."""

    def piece(part: Column, j: Column, spans: Column, starts: Column, reach: Column) -> Column:
        begin = (j * PIECE).cast("long")
        first, last = _below(reach, begin + 1), _below(starts, begin + PIECE)
        mine = F.slice(spans, first + 1, F.greatest(last - first, F.lit(0)))

        def step(acc: Column, v: Column) -> Column:
            start = F.greatest(v["start"], acc["pos"])
            gap = F.substring(part, (acc["pos"] - begin + 1).cast("int"), (start - acc["pos"]).cast("int"))
            out = F.when(v["start"] < acc["pos"], acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(MASK)))
            return F.struct(F.greatest(v["end"], acc["pos"]).alias("pos"), out.alias("out"))

        done = F.aggregate(mine, F.struct(begin.alias("pos"), F.lit("").alias("out")), step)
        return _with(done, lambda a: F.concat(a["out"], F.substring(part, (F.least(a["pos"] - begin, F.lit(PIECE)) + 1).cast("int"), F.lit(PIECE))))

    def all_of(spans: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        ends = _greatest_so_far(F.transform(spans, lambda v: v["end"]))
        return _with(F.transform(spans, lambda v: v["start"]), lambda starts: _with(ends, lambda reach: F.array_join(F.transform(pieces, lambda p, j: piece(p, j, spans, starts, reach)), "")))

    return _with(lives, all_of)


def mask_live(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with every live span replaced by MASK; examples and clean texts stay as they are. All columns are kept."""
    rows = judged(docs, id_col=id_col, text_col=text_col, whole_rows=True, **how)
    lives = F.array_sort(F.filter("verdicts", lambda v: v["live"]))
    fresh = F.when(F.size(lives) > 0, _masked(F.col("text"), lives)).otherwise(F.col("row")[text_col].cast("string"))
    return rows.select(*[fresh.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rt.read_table(spark, sf_dir, "documents")
    return secret_scan(docs, owner=F.col("source"), repo=F.concat_ws("/", "source", "lang"))


def _oracle() -> str:
    kinds = (("assign", 0, ASSIGN), ("access", 1, ACCESS), ("hex", 2, HEX), ("owned", 3, WIDE))
    split = " UNION ALL ".join(f"SELECT doc_id, o, r, '{kind}' AS kind, {k} AS ord, string_split_regex(t, '{p}') AS p, regexp_extract_all(t, '{p}') AS m FROM d" for kind, k, p in ((a, b, c.replace("'", "''")) for a, b, c in kinds))
    value = "CASE kind WHEN 'assign' THEN regexp_extract(m[k], '{}', 2) ELSE m[k] END".format(ASSIGN.replace("'", "''"))
    joined = "coalesce(string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, ord){}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc_no, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS o, concat_ws('/', source, lang) AS r FROM documents),
q AS ({split}),
e AS (SELECT doc_id, o, r, kind, ord, m, p, unnest(range(1, len(m) + 1)) AS k FROM q),
s AS (SELECT doc_id, o, r, kind, ord, CAST(list_sum([length(x) for x in p[1:k]]) + coalesce(list_sum([length(x) for x in m[1:k - 1]]), 0) AS BIGINT) AS start, length(m[k]) AS size, {value} AS v FROM e),
z AS (SELECT doc_id, o, r, kind, ord, start, start + size AS stop, v FROM s WHERE CASE kind WHEN 'assign' THEN length(v) >= 6
  WHEN 'owned' THEN regexp_matches(v, '[0-9]') AND (regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') OR regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= {VARIETY}) ELSE TRUE END),
c AS (SELECT * FROM z WHERE ord < 3 OR NOT EXISTS (SELECT 1 FROM z AS b WHERE b.doc_id = z.doc_id AND b.ord < 3 AND b.start < z.stop AND z.start < b.stop)),
g AS (SELECT v, count(DISTINCT o) AS owners, count(DISTINCT concat(o, chr(10), r)) AS repos FROM c GROUP BY v),
j AS (SELECT c.*, owners, repos, owners <= {MAX_OWNERS} AND repos <= {MAX_REPOS} AS live FROM c JOIN g ON c.v = g.v),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256({joined.format(" FILTER (ord < 3)")}) AS base_sha256, {joined.format(" FILTER (ord < 3 OR live)")} AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_examples, count(*) FILTER (live AND ord = 3) AS n_owned, max(owners) AS owners, max(repos) AS repos FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples, coalesce(n_owned, 0) AS n_owned, coalesce(owners, 0) AS owners, coalesce(repos, 0) AS repos FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""


ORACLE = _oracle()
