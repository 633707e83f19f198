"""Zstandard WARC archives: a dictionary in the leading skippable frame, one frame per record.

Writing: the payload of a page is its html as UTF-8. Of equal payloads the one of the least page id is a response, the others are
revisits that name it; equal payloads are found by digest and length before writing, with map-side combining. A dictionary
is trained on a bounded sample of pages (DICT_PAGES, by hash of the id, their first DICT_CHARS characters); it only
affects compression. Archives of some ten MB go to the shared folder; only those that a successful task reports count.

Reading: the dictionary is loaded from the skippable frame, then one frame is decoded per record. Version, mandatory headers,
Content-Length, the HTTP-like payload length and the payload digest are checked; a record that fails raises WarcError.

Null html is an empty payload. Null page ids come last; of rows that repeat an id and a payload one is the response. A very long page
is one record and must fit a task. An empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime as rt

#: Fixed values of the format: the magic number of the skippable frame that holds the dictionary.
DICT_MAGIC = 0x184D2A5D
DICT_PAGES, DICT_CHARS, DICT_BYTES = 400, 20_000, 64_000
ARCHIVE_BYTES = 16_000_000
LEVEL = 3
STEP = 1 << 16
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has no block, and names the response and the length of the full payload."""
    name = "" if page_id is None else page_id
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or "").replace("\r", " ").replace("\n", " ")),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if revisit:
        head += [("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    body = b"" if revisit else payload
    head.append(("Content-Length", str(len(body))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record, validated."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise WarcError("no WARC version line")
    headers = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            raise WarcError(f"bad header line {line[:80]!r}")
        headers[k.strip().lower()] = v.strip()
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in headers:
            raise WarcError(f"no {k}")
    if not headers["content-length"].isdigit():
        raise WarcError("bad content-length")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"content-length is {n}, the block has {len(rest) - 4} bytes")
    block = rest[:n]
    if headers["warc-type"] == "response":
        if headers.get("warc-payload-digest") != f"sha1:{digest(block)}":
            raise WarcError("payload digest does not match")
        if headers.get("x-payload-length", str(n)) != str(n):
            raise WarcError("payload length does not match")
    elif headers["warc-type"] == "revisit" and ("warc-refers-to" not in headers or n):
        raise WarcError("a revisit names its response and has no block")
    return headers, block


def dictionary_frame(data: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(data)) + data


def frames(source) -> Iterator[bytes]:
    """The records of an archive, frame by frame; `source` is read in steps, so an archive need not fit in memory."""
    import zstandard

    head = source.read(8)
    if len(head) < 8:
        raise WarcError("the archive has no dictionary frame")
    magic, size = struct.unpack("<II", head)
    if magic != DICT_MAGIC:
        raise WarcError("the archive does not begin with a dictionary frame")
    data = source.read(size)
    if len(data) != size:
        raise WarcError("the dictionary frame is cut off")
    held = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 24) if data[:4] == b"\x28\xb5\x2f\xfd" else data) if data else None
    opener = zstandard.ZstdDecompressor(dict_data=held)
    left = b""
    while left or (left := source.read(STEP)):
        one, out = opener.decompressobj(), []
        try:
            while not one.eof:
                out.append(one.decompress(left))
                left = one.unused_data if one.eof else source.read(STEP)
                if not one.eof and not left:
                    raise WarcError("the last frame is cut off")
        except zstandard.ZstdError as e:
            raise WarcError(f"bad frame: {e}") from e
        yield b"".join(out)


def train_dictionary(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> bytes:
    """At most DICT_PAGES pages reach the driver; too few give no dictionary."""
    import zstandard

    # ids are picked first, so that no task sends payloads that are not used
    ids = [r[0] for r in pages.select(F.col(id_col).cast("long").alias("i")).where("i is not null").orderBy(F.xxhash64("i"), "i").limit(DICT_PAGES).collect()]
    picked = pages.where(F.col(id_col).cast("long").isin(ids)).select(F.col(id_col).alias("i"), F.substring(rt.text_of(F.col(html_col)), 1, DICT_CHARS).alias("h"))
    samples = [r["h"].encode() for r in picked.dropDuplicates(["i"]).limit(DICT_PAGES).collect() if r["h"]]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write_warcs(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives below `folder`; (archive, records) of each one that counts."""
    spark = pages.sparkSession
    html = rt.text_of(rt.named(html_col))
    rows = pages.select(F.monotonically_increasing_id().alias("no"), rt.named(id_col).cast("long").alias("id"), rt.named(url_col).cast("string").alias("url"), html.alias("html"), F.concat_ws(":", F.sha2(html, 256), F.octet_length(html)).alias("key"))
    rows = rt.materialise(rows, "pages")
    # the response of each payload of more than one row; the rows meet it without moving a payload twice
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "no")).alias("first")
    found = rt.materialise(rows.groupBy("key").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1"), "equal-pages")
    dictionary = spark.sparkContext.broadcast(train_dictionary(pages, id_col, html_col))
    joined = rt.lookup(rows, found, "key", "n", rows.count())
    ready = joined.select("id", "url", "html", F.col("first.id").alias("first"), F.coalesce(F.col("no") != F.col("first.no"), F.lit(False)).alias("revisit"))

    def made(batches):
        import zstandard

        fs, at = rt.open_store(folder)
        fs.create_dir(at, recursive=True)
        data = dictionary.value
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data)) if data else zstandard.ZstdCompressor(level=LEVEL)
        key, no, out, size, records = rt.task_key(), 0, None, 0, 0
        name = ""
        done = []
        for b in batches:
            for i, u, h, first, revisit in zip(*(b.column(c).to_pylist() for c in ("id", "url", "html", "first", "revisit")), strict=True):
                if out is None:
                    name = f"part-{key}-{no:05d}.warc.zst"
                    out, size, records = fs.open_output_stream(f"{at}/{name}"), 0, 0
                    out.write(dictionary_frame(data))
                size += out.write(frame := squeeze.compress(record(i, u, h.encode(), first, revisit))) or len(frame)
                records += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, records))
                    out, no = None, no + 1
        if out is not None:
            out.close()
            done.append((name, records))
        if done:
            yield pa.record_batch({"archive": pa.array([d[0] for d in done]), "records": pa.array([d[1] for d in done], pa.int64())})

    return ready.mapInArrow(made, "archive string, records long")


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warcs(listed: DataFrame, folder: str) -> DataFrame:
    """One row per record of the listed archives."""

    def page(urn: str | None) -> int | None:
        own = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(own) if own else None

    def read(batches):
        fs, at = rt.open_store(folder)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for name, expected in zip(b.column("archive").to_pylist(), b.column("records").to_pylist(), strict=True):
                rows, seen = [], 0
                with fs.open_input_stream(f"{at}/{name}") as source:
                    for raw in frames(source):
                        head, _ = parse(raw)
                        kind = head["warc-type"]
                        rows.append((page(head["warc-record-id"]), int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:"), kind, page(head.get("warc-refers-to")) if kind == "revisit" else None))
                        seen += 1
                        if len(rows) >= 5000:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if seen != expected:
                    raise WarcError(f"{name} has {seen} records instead of {expected}")
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return listed.mapInArrow(read, RESULT)


def warc_round_trip(pages: DataFrame, **cols) -> DataFrame:
    """Writes a record per row of pages and reads the archives back: one row per record."""
    spark = pages.sparkSession
    folder = rt.scratch(spark, "warc")
    listed = rt.materialise(write_warcs(pages, folder, **cols), "warc-list")
    return read_warcs(listed.repartition(rt.partitions(spark)), folder)


#: The digest's letters are cut from the hexadecimal digits, five bits at a time.
ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS lead_id FROM pages)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((((strpos('0123456789abcdef', substr(h, CAST(i * 5 // 4 + 1 AS BIGINT), 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, CAST(i * 5 // 4 + 2 AS BIGINT), 1)) - 1) >> CAST(3 - i * 5 % 4 AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = lead_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lead_id THEN lead_id END AS refers_to FROM p
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(rt.read_table(spark, sf_dir, "pages"))
