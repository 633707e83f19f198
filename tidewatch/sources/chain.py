"""A chain as a Spark data source: backfill over block ranges and a resumable tail over positions.

The archive of a chain's events is a table with a log of commits (`commits.py`), so a reader sees whole commits only. A batch
read (`backfill`) is planned from the log: folders outside the asked blocks and chains are not opened, each folder is one partition, and
filters on chain, block_height, position, kind and address are pushed to its files. A stream (`subscribe`) reads positions after those it has
done; its offset is a position, which Spark keeps in the checkpoint, so after a restart every event comes once.

    spark.dataSource.register(ChainSource)
    spark.read.format("tidewatch_chain").option("from_block", 5).option("to_block", 9).load(path)
    spark.readStream.format("tidewatch_chain").option("kinds", "swap,reorg").load(path)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .commits import CommitTable, load, store

EVENT = "chain string, block_height long, position long, kind string, tx_hash string, token string, address string, t long, cents long"
PUSHED = ("chain", "kind", "address")
FOREVER = 1 << 62

#: Kinds that a subscription gets where the caller names none: everything a detector reads, and the markers of reorgs.
DEFAULT_KINDS = ("swap", "pool_event", "transfer", "reorg")


@dataclass
class Wanted:
    """A filter of events: block range (inclusive), positions (after, up to), and values of some columns (none: all)."""

    from_block: int = -FOREVER
    to_block: int = FOREVER
    after: int = -FOREVER
    up_to: int = FOREVER
    chain: tuple[str, ...] = ()
    kind: tuple[str, ...] = ()
    address: tuple[str, ...] = ()

    @classmethod
    def of(cls, options) -> Wanted:
        some = lambda name: tuple(x for x in (options.get(name) or "").split(",") if x)
        return cls(int(options.get("from_block") or -FOREVER), int(options.get("to_block") or FOREVER), chain=some("chains"), kind=some("kinds"), address=some("addresses"))

    def narrowed(self, f: Filter) -> bool:
        """Whether a filter of the query is taken over whole."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name in PUSHED and isinstance(f, EqualTo | In):
            values = (f.value,) if isinstance(f, EqualTo) else tuple(f.value)
            old = getattr(self, name)
            both = tuple(v for v in values if not old or v in old)
            setattr(self, name, both or ("\0",))
        elif name in ("block_height", "position") and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            low, high = f.value + isinstance(f, GreaterThan), f.value - isinstance(f, LessThan)
            low, high = -FOREVER if isinstance(f, LessThan | LessThanOrEqual) else low, FOREVER if isinstance(f, GreaterThan | GreaterThanOrEqual) else high
            if name == "block_height":
                self.from_block, self.to_block = max(self.from_block, low), min(self.to_block, high)
            else:
                self.after, self.up_to = max(self.after, low - 1), min(self.up_to, high)
        else:
            return False
        return True

    def meets(self, part) -> bool:
        """Whether a folder can hold such events."""
        heights = [h for c, h in part.heights.items() if not self.chain or c in self.chain]
        return part.last > self.after and part.first <= self.up_to and any(low <= self.to_block and high >= self.from_block for low, high in heights)

    def expression(self):
        import pyarrow.compute as pc

        out = (pc.field("block_height") >= self.from_block) & (pc.field("block_height") <= self.to_block) & (pc.field("position") > self.after) & (pc.field("position") <= self.up_to)
        for name in PUSHED:
            if getattr(self, name):
                out = out & pc.field(name).isin(list(getattr(self, name)))
        return out


class Folder(InputPartition):
    def __init__(self, path: str, wanted: Wanted):
        self.path, self.wanted = path, wanted


def _read(partition: Folder | None) -> Iterator:
    """The asked events of a folder, in Arrow batches; without folders Spark asks for None."""
    import pyarrow.dataset as ds

    if partition is None:
        return
    files, at = store(partition.path)
    data = ds.dataset(at, filesystem=files, format="parquet", exclude_invalid_files=True)
    names = [c.split()[0] for c in EVENT.split(", ")]
    yield from (b for b in data.to_batches(columns=names, filter=partition.wanted.expression(), batch_size=32_768) if b.num_rows)


class Backfill(DataSourceReader):
    def __init__(self, path: str, wanted: Wanted):
        self.path, self.wanted = path, wanted

    def pushFilters(self, filters):
        return [f for f in filters if not self.wanted.narrowed(f)]

    def partitions(self) -> list[InputPartition]:
        return [Folder(f"{self.path}/{p.folder}", self.wanted) for p in load(self.path).parts.values() if self.wanted.meets(p)]

    def read(self, partition: Folder) -> Iterator:
        yield from _read(partition)


class Tail(DataSourceStreamReader):
    def __init__(self, path: str, wanted: Wanted, start: int):
        self.path, self.wanted, self.start = path, wanted, start

    def initialOffset(self) -> dict:
        return {"position": self.start}

    def latestOffset(self) -> dict:
        return {"position": max((p.last for p in load(self.path).parts.values()), default=self.start)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        from dataclasses import replace

        asked = replace(self.wanted, after=start["position"], up_to=end["position"])
        return [Folder(f"{self.path}/{p.folder}", asked) for p in load(self.path).parts.values() if asked.meets(p)]

    def read(self, partition: Folder) -> Iterator:
        yield from _read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is held for offsets that are done."""


class ChainSource(DataSource):
    """Options: path, from_block, to_block, chains, kinds, addresses (comma-separated), and `after`, the position a new tail begins behind."""

    @classmethod
    def name(cls) -> str:
        return "tidewatch_chain"

    def schema(self) -> str:
        return EVENT

    def reader(self, schema) -> Backfill:
        return Backfill(self.options["path"].rstrip("/"), Wanted.of(self.options))

    def streamReader(self, schema) -> Tail:
        return Tail(self.options["path"].rstrip("/"), Wanted.of(self.options), int(self.options.get("after") or -1))


def publish(archive: CommitTable, events: DataFrame) -> None:
    """Appends events to an archive as one commit; positions must lie behind those it has. Files are cut by position, so a tail reads few."""
    rows = events.selectExpr(*[f"CAST({c} AS {t}) AS {c}" for c, t in (x.split() for x in EVENT.split(", "))])
    state = archive.state()
    part = archive.stage(rows.repartitionByRange("position").sortWithinPartitions("position"))
    if part and state.parts and part.first <= max(p.last for p in state.parts.values()):
        raise ValueError("positions of an archive only grow")
    archive.commit(state, [part])


def tip(path: str) -> dict[str, int]:
    """The greatest height of each chain of an archive."""
    out: dict[str, int] = {}
    for p in load(path).parts.values():
        for chain, (_, high) in p.heights.items():
            out[chain] = max(high, out.get(chain, high))
    return out


def backfill(spark: SparkSession, path: str, from_block: int, to_block: int, **options) -> DataFrame:
    """The events of a block range; filters of the query are pushed, for which the session's setting is turned on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChainSource)
    return spark.read.format(ChainSource.name()).options(from_block=from_block, to_block=to_block, **options).load(path)


def subscribe(spark: SparkSession, path: str, after: int = -1, kinds: tuple[str, ...] = DEFAULT_KINDS, **options) -> DataFrame:
    """The stream of events behind a position. Backfill first, then subscribe behind what it covered: the two never meet."""
    spark.dataSource.register(ChainSource)
    return spark.readStream.format(ChainSource.name()).options(after=after, kinds=",".join(kinds), **options).load(path)
