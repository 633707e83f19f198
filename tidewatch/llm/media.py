"""Media columns: payloads stored losslessly as 8-bit images in archives, read back by a custom Spark data source.

Writing: each text, as UTF-8 padded with blanks to a positive multiple of WIDTH bytes, becomes an 8-bit grayscale PNG of
WIDTH samples a row, and goes as a stored member into a ZIP archive of some ten MB, in a directory of its task in the shared
folder. Only directories that a successful task reports are listed, so retried and speculative tasks do no harm.

Reading: the data source `tidewatch_media` plans partitions as byte ranges over archive directories: the archives of a directory
count as one run of bytes, in the order of their names, and all directories as one more. The driver sees one name and size per
directory, and plans at most MAX_RANGES partitions, however many archives and members there are. A task lists the archives
of its directories, reads their central directories and takes the members whose headers begin in its range. Members are streamed in Arrow batches of bounded size. Each member is fetched by its own offset, checked
against its CRC, and retried on its own; a member that stays bad is reported in `error` (or fails the query, by option).

Null counts as the empty text, whose payload is blanks. Rows that repeat an id, or tie in everything, are each stored. A very long
text is one member and must fit a task. An empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import runtime as rt

WIDTH = 192
#: An archive is closed beyond this, a planned range holds about as much, and an Arrow batch at most that.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 16_000_000, 8_000_000, 4_000_000
#: The most partitions of one reading; ranges grow beyond RANGE_BYTES to stay below it.
MAX_RANGES = 50_000
TRIES = 3

_PNG = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes, width: int = WIDTH) -> bytes:
    return text + b" " * (max(width, -(-len(text) // width) * width) - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """8-bit grayscale, no row filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[int, int, bytes]:
    """(width, height, samples) of an 8-bit grayscale PNG; filters none, sub and up."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, head = 8, [], None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("chunk is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit grayscale")
    width, height = head[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    out = lines[:, 1:].copy()
    if lines[:, 0].any():
        for k, how in enumerate(lines[:, 0].tolist()):
            if how == 1:
                out[k] = np.cumsum(out[k], dtype=np.uint8)
            elif how == 2:
                out[k] += out[k - 1] if k else 0
            elif how:
                raise ValueError("row filter is not supported")
    return width, height, out.tobytes()


def feature(width: int, height: int, samples: bytes) -> str:
    count = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, level = count.sum(), np.arange(256)
    mean = float((count * level).sum()) / n
    spread = (float((count * level * level).sum()) / n - mean * mean) ** 0.5
    share = count[count > 0] / n
    low, high = np.flatnonzero(count)[[0, -1]].tolist()
    return f"gray8:{width}x{height};mean={mean:.4f};std={spread:.4f};min={low};max={high};entropy={float(-(share * np.log2(share)).sum()):.4f}"


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes archives below `folder`; (directory, bytes, archives, members) of each directory that counts."""

    def made(batches):
        fs, at = rt.open_store(folder)
        directory, held, size, row, no, total, members = f"part-{rt.task_key()}", None, 0, 0, 0, 0, 0

        def close() -> int:
            held[1].close()
            data = held[0].getvalue()
            if no == 0:
                fs.create_dir(f"{at}/{directory}", recursive=True)
            with fs.open_output_stream(f"{at}/{directory}/{no:06d}.zip") as out:
                out.write(data)
            return len(data)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = t.encode()
                media = to_png(padded(raw))
                if held is None:
                    buffer = io.BytesIO()
                    held, size = (buffer, zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)), 0
                held[1].writestr(zipfile.ZipInfo(f"{'' if i is None else i}_{len(raw)}_{row}.png"), media)
                members, size, row = members + 1, size + len(media), row + 1
                if size >= ARCHIVE_BYTES:
                    total += close()
                    held, no = None, no + 1
        if held is not None:
            total += close()
            no += 1
        if no:
            yield pa.record_batch({"directory": pa.array([directory]), "bytes": pa.array([total], pa.int64()), "archives": pa.array([no], pa.int64()), "members": pa.array([members], pa.int64())})

    rows = docs.select(rt.named(id_col).cast("long"), rt.text_of(rt.named(text_col)))
    return rows.mapInArrow(made, "directory string, bytes long, archives long, members long")


class _Range(InputPartition):
    """Byte ranges of directories: (directory, start, end)."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        super().__init__(spans)
        self.spans = spans


def plan_ranges(sizes: list[tuple[str, int]], range_bytes: int, most: int = MAX_RANGES) -> list[list[tuple[str, int, int]]]:
    """Even ranges of at most range_bytes, or of which there are at most `most`, over directories laid end to end."""
    total = sum(n for _, n in sizes)
    step = max(1, range_bytes, -(-total // most))
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(-(-total // step))]
    begin = 0
    for name, n in sizes:
        for k in range(begin // step, -(-(begin + n) // step)):
            out[k].append((name, max(0, k * step - begin), min(n, (k + 1) * step - begin)))
        begin += n
    return out


SCHEMA = "archive string, member string, offset long, media binary, tries int, error string"
_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("tries", pa.int32()), ("error", pa.string())])


def fetch(source, info: zipfile.ZipInfo, reopen, tries: int = TRIES) -> tuple[bytes | None, int, str | None]:
    """(bytes, tries, error) of one member, read at its own offset; only this member is read again after a failure."""
    error = None
    for k in range(1, tries + 1):
        try:
            source.seek(info.header_offset)
            head = source.read(30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("no member header")
            skip = sum(struct.unpack("<HH", head[26:30]))
            source.seek(info.header_offset + 30 + skip)
            data = source.read(info.compress_size)
            if info.compress_type == zipfile.ZIP_DEFLATED:
                data = zlib.decompress(data, -15)
            if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                raise ValueError("member is damaged")
            return data, k, None
        except (OSError, ValueError, zlib.error) as e:
            error = f"{type(e).__name__}: {e}"
            if k < tries:
                source = reopen()
    return None, tries, error


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.fail = options.get("onerror", "fail") == "fail"

    def partitions(self):
        import pyarrow.dataset as ds

        fs, at = rt.open_store(self.path)
        listed = ds.dataset(f"{at}/_manifest", filesystem=fs, format="parquet").to_table(["directory", "bytes"])
        sizes = sorted(zip(listed["directory"].to_pylist(), listed["bytes"].to_pylist(), strict=True))
        return [_Range(spans) for spans in plan_ranges(sizes, self.range_bytes)] or [_Range([])]

    def _archives(self, fs, at: str, spans) -> Iterator[tuple[str, int, int]]:
        """(archive, start, end) of what the ranges hold of each archive."""
        from pyarrow.fs import FileSelector

        for directory, start, end in spans:
            begin = 0
            for info in sorted(fs.get_file_info(FileSelector(f"{at}/{directory}")), key=lambda f: f.base_name):
                if info.base_name.endswith(".zip"):
                    if begin < end and begin + info.size > start:
                        yield f"{directory}/{info.base_name}", start - begin, end - begin
                    begin += info.size

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        fs, at = rt.open_store(self.path)
        for archive, start, end in self._archives(fs, at, partition.spans):
            yield from self._members(fs, f"{at}/{archive}", archive, start, end)

    def _members(self, fs, path: str, archive: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
        reopen = lambda: fs.open_input_file(path)
        source = reopen()
        with zipfile.ZipFile(reopen()) as directory:
            mine = [m for m in directory.infolist() if start <= m.header_offset < end]
        rows, size = [], 0
        for m in mine:
            data, tries, error = fetch(source, m, reopen)
            if error and self.fail:
                raise OSError(f"{archive} at {m.header_offset}: {error}")
            rows.append((archive, m.filename, m.header_offset, data, tries, error))
            size += len(data or b"")
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class MediaArchives(DataSource):
    """spark.read.format("tidewatch_media").option("path", folder): one row per member of the archives."""

    @classmethod
    def name(cls):
        return "tidewatch_media"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("tidewatch_media").options(path=folder, **options).load()


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text and reads it back: one row per row of docs, with the columns of RESULT."""
    spark = docs.sparkSession
    folder = rt.scratch(spark, "media")
    write_archives(docs, folder, id_col, text_col).write.parquet(f"{folder}/_manifest")

    def decoded(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
        for b in batches:
            rows = []
            for name, media in zip(b.column("member").to_pylist(), b.column("media").to_pylist(), strict=True):
                width, height, payload = from_png(media)
                i, n, _ = name.split("_")
                rows.append((int(i) if i else None, int(n), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(width, height, payload)))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return read_archives(spark, folder).select("member", "media").mapInArrow(decoded, RESULT)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(rt.read_table(spark, sf_dir, "documents"))
