"""One declarative text per operator: run by Catalyst over DataFrames, or printed for another SQL engine as its oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Dialect:
    """The few spots where the two engines' SQL differs."""

    def __init__(self, spark: bool):
        self.spark = spark

    def epoch(self, ts: str) -> str:
        return f"unix_timestamp({ts})" if self.spark else f"CAST(floor(epoch({ts})) AS BIGINT)"

    def join_set(self, x: str, where: str = "") -> str:
        cond = f" FILTER (WHERE {where})" if where else ""
        return f"array_join(array_sort(collect_set({x}){cond}), ',')" if self.spark else f"coalesce(string_agg(DISTINCT {x}, ',' ORDER BY {x}){cond}, '')"

    def percent_ranked(self, rows: str, by: str, name: str) -> str:
        """rows with their percent rank by a column. Here ranks come from the counts of its distinct values, so the one
        ordered window runs over those few values and not over all rows; nulls come first."""
        if not self.spark:
            return f"SELECT *, percent_rank() OVER (ORDER BY {by} NULLS FIRST) AS {name} FROM ({rows}) AS pr"
        counts = f"SELECT {by} AS pr_v, count(*) AS pr_n FROM ({rows}) GROUP BY {by}"
        before = f"SELECT pr_v, coalesce(sum(pr_n) OVER (ORDER BY pr_v NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pr_before, sum(pr_n) OVER () AS pr_all FROM ({counts})"
        return f"SELECT pr.*, CASE WHEN pr_all > 1 THEN pr_before / CAST(pr_all - 1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS {name} FROM ({rows}) AS pr JOIN ({before}) AS pb ON pr.{by} <=> pb.pr_v"

    def mode(self, x: str) -> str:
        return f"mode() WITHIN GROUP (ORDER BY {x})"

    def median(self, x: str) -> str:
        return f"percentile_cont(0.5) WITHIN GROUP (ORDER BY {x})"

    def last_known(self, x: str, over: str) -> str:
        """The last value that is not null, in a running window."""
        frame = f"({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        return f"last_value({x}) IGNORE NULLS OVER {frame}" if self.spark else f"last_value({x} IGNORE NULLS) OVER {frame}"

    def json_int(self, x: str, key: str) -> str:
        return f"CAST(get_json_object({x}, '$.{key}') AS BIGINT)" if self.spark else f"CAST(json_extract_string({x}, '$.{key}') AS BIGINT)"

    def rows(self, values: str, names: str) -> str:
        return f"(SELECT * FROM VALUES {values} AS v({names}))" if self.spark else f"(SELECT * FROM (VALUES {values}) AS v({names}))"

    def idiv(self, a: str, b: str) -> str:
        return f"CAST(floor(({a}) / CAST({b} AS DOUBLE)) AS BIGINT)"

    def hash_mod(self, x: str, n: int) -> str:
        """A stable spread of a string over n places, the same in both engines."""
        return f"CAST(conv(substring(md5({x}), 1, 7), 16, 10) AS BIGINT) % {n}" if self.spark else f"CAST(('0x' || substring(md5({x}), 1, 7)) AS BIGINT) % {n}"

    def hex_int(self, x: str) -> str:
        return f"CAST(conv({x}, 16, 10) AS BIGINT)" if self.spark else f"CAST(('0x' || {x}) AS BIGINT)"

    def to_hex(self, x: str) -> str:
        return f"lower(hex({x}))" if self.spark else f"lower(to_hex({x}))"

    def b64(self, x: str) -> str:
        return f"base64(encode({x}, 'UTF-8'))" if self.spark else f"base64(encode({x}))"

    def unb64(self, x: str) -> str:
        return f"decode(unbase64({x}), 'UTF-8')" if self.spark else f"decode(from_base64({x}))"

    def size_split(self, x: str) -> str:
        return f"size(split({x}, ','))" if self.spark else f"len(string_split({x}, ','))"


SPARK, DUCK = Dialect(True), Dialect(False)
Text = Callable[[Dialect], str]
RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Size of the row groups of a table that is kept, and the settings under which a task reads about one of them.
KEPT_BYTES = 16 << 20
KEPT_SPLITS = {"spark.sql.files.maxPartitionBytes": str(KEPT_BYTES)}
#: Derived tables by name, in dependency order.
VIEWS: dict[str, Text] = {}


def view(name: str):
    def add(text: Text) -> Text:
        VIEWS[name] = text
        return text

    return add


def uses(text: str) -> list[str]:
    """Names of tables in braces."""
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def run(spark: SparkSession, text: Text, tables: Callable[[str], DataFrame]) -> DataFrame:
    sql = text(SPARK)
    return spark.sql(sql, **{name: tables(name) for name in uses(sql)})


class Tables:
    """Tables of a folder: raw ones are read, derived ones are planned on top; nothing runs here."""

    def __init__(self, spark: SparkSession, sf_dir: str, replaced: dict[str, DataFrame] | None = None):
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir, self.made = spark, sf_dir, dict(replaced or {})

    def __call__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = run(self.spark, VIEWS[name], self) if name in VIEWS else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]

    def keep(self, name: str) -> str:
        """Writes a derived table once to the shared folder, for plans that would each work it out again; its folder. Row groups are small, so that the
        table is read by as many tasks as `KEPT_SPLITS` ask for, whatever tasks wrote it."""
        from ..sources.files import scratch

        path = scratch(self.spark, name)
        df = self(name)
        df.write.option("compression", "zstd").option("parquet.block.size", KEPT_BYTES).parquet(path)
        self.made[name] = self.spark.read.schema(df.schema).parquet(path)
        return path


def oracle(text: Text) -> str:
    """The text with its derived tables as common table expressions."""
    need: list[str] = []

    def visit(sql: str) -> None:
        for name in uses(sql):
            if name in VIEWS and name not in need:
                visit(VIEWS[name](DUCK))
                need.append(name)

    body = text(DUCK)
    visit(body)
    plain = lambda sql: re.sub(r"\{(\w+)\}", r"\1", sql)
    heads = [f"{name} AS ({plain(VIEWS[name](DUCK))})" for name in need]
    return (f"WITH {', '.join(heads)} " if heads else "") + f"SELECT * FROM ({plain(body)}) AS answer"


def query(text: Text):
    """(callable, oracle SQL) of a text over derived tables."""
    return (lambda spark, sf_dir: run(spark, text, Tables(spark, sf_dir))), oracle(text)
