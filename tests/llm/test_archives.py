"""Media archives and WARC: exact round trips, damage, retries."""

import base64
import hashlib
import io
import struct
import zipfile
import zlib
from collections import Counter

import pytest
import zstandard

from tidewatch.llm import media, warc
from tidewatch.llm import runtime as rt


def test_media(docs, plain):
    got = media.media_columns(docs).collect()
    want = Counter()
    for i, t in plain:
        p = t.encode() + b" " * (max(192, -(-len(t.encode()) // 192) * 192) - len(t.encode()))
        want[(i, len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.payload_sha256 + str(r.n_bytes), (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_media_empty(no_docs):
    assert media.media_columns(no_docs).count() == 0


def test_ranges_share_members_without_loss(spark, docs):
    folder = rt.scratch(spark, "ranges")
    media.write_archives(docs, folder).write.parquet(f"{folder}/_manifest")
    whole = media.read_archives(spark, folder).select("member").collect()
    small = media.read_archives(spark, folder, rangebytes=700)
    assert small.rdd.getNumPartitions() > 5
    assert Counter(r[0] for r in small.select("member").collect()) == Counter(r[0] for r in whole)
    assert len(whole) == docs.count()


def test_ranges_cover_each_byte_once():
    sizes = [("a", 10), ("b", 1), ("c", 25), ("d", 7)]
    for step, most in ((1, 99), (4, 99), (10, 99), (100, 99), (1, 3)):
        spans = media.plan_ranges(sizes, step, most)
        covered = Counter((name, k) for part in spans for name, a, z in part for k in range(a, z))
        assert set(covered.values()) == {1} and len(covered) == 43 and len(spans) <= most and all(spans)
    assert media.plan_ranges([], 5) == []


def test_png_round_trip_and_damage():
    payload = bytes(range(192)) * 3
    data = media.to_png(payload)
    assert media.from_png(data) == (192, 3, payload)
    with pytest.raises(ValueError, match="damaged"):
        media.from_png(data[:60] + bytes([data[60] ^ 1]) + data[61:])


def test_members_are_retried_on_their_own():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a", b"first")
        z.writestr("b", b"second")
    raw = buffer.getvalue()
    infos = zipfile.ZipFile(io.BytesIO(raw)).infolist()

    class Flaky(io.BytesIO):
        def read(self, *a):
            raise OSError("gone")

    assert media.fetch(Flaky(raw), infos[1], lambda: io.BytesIO(raw)) == (b"second", 2, None)
    bad = raw.replace(b"second", b"sXcond")
    data, tries, error = media.fetch(io.BytesIO(bad), infos[1], lambda: io.BytesIO(bad))
    assert data is None and tries == media.TRIES and "damaged" in error
    assert media.fetch(io.BytesIO(bad), infos[0], lambda: io.BytesIO(bad))[0] == b"first"


PAGES = "page_id long, url string, html string, key string, n long, first long, revisit boolean"


@pytest.fixture(scope="module")
def pages(spark):
    html = [None, "", "<p>one</p>", "<p>one</p>", "<p>two</p>" * 5000, "<p>é🙂</p>", "<p>one</p>", "a\r\n\r\nb"]
    made = [(i, f"http://x/{i}\r\n", h, "k", 1, 2, None) for i, h in enumerate(html)]
    return spark.createDataFrame([*made, made[4], (None, None, "<p>one</p>", "k", 1, 2, None)], PAGES).repartition(3)


def test_warc(pages):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    got = warc.warc_round_trip(pages).collect()
    first = {}
    for i, b in rows:
        if i is not None:
            first[b] = min(first.get(b, i), i)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) for i, b in rows)
    responses = Counter(r.payload_digest for r in got if r.record_type == "response")
    assert set(responses.values()) == {1} and len(responses) == len(first)
    for r in got:
        if r.record_type == "revisit":
            assert r.refers_to == next(f for b, f in first.items() if base64.b32encode(hashlib.sha1(b).digest()).decode() == r.payload_digest)
        else:
            assert r.refers_to is None


def test_warc_empty(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_archives_are_validated():
    record = warc.record(1, "u", b"payload", None, False)
    plain = zstandard.ZstdCompressor()
    good = warc.dictionary_frame(b"") + plain.compress(record) + plain.compress(warc.record(2, "u", b"payload", 1, True))
    assert [warc.parse(r)[0]["warc-type"] for r in warc.frames(io.BytesIO(good))] == ["response", "revisit"]
    with pytest.raises(warc.WarcError, match="dictionary"):
        list(warc.frames(io.BytesIO(plain.compress(record))))
    with pytest.raises(warc.WarcError, match="cut off"):
        list(warc.frames(io.BytesIO(good[:-5])))
    with pytest.raises(warc.WarcError, match="content-length"):
        warc.parse(record[:-6] + b"\r\n\r\n")
    with pytest.raises(warc.WarcError, match="digest"):
        warc.parse(record.replace(b"payload\r\n", b"paYload\r\n"))
    with pytest.raises(warc.WarcError, match="version"):
        warc.parse(b"HTTP/1.1 200\r\n\r\n")


def test_dictionary_is_in_the_leading_frame():
    samples = [f"<html><body>page {i} of many pages with the same words</body></html>".encode() * 20 for i in range(200)]
    data = zstandard.train_dictionary(4000, samples).as_bytes()
    squeeze = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data))
    raw = warc.dictionary_frame(data) + squeeze.compress(warc.record(1, "u", samples[0], None, False))
    assert struct.unpack("<I", raw[:4])[0] == warc.DICT_MAGIC
    assert warc.parse(next(warc.frames(io.BytesIO(raw))))[1] == samples[0]
