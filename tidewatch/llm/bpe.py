"""Byte-level BPE over whole texts: overlapping chunks, stitched where pre-token boundaries meet again.

A text is cut into chunks that overlap. Chunks are split into pre-tokens on their own, in parallel. The split is
memoryless at a boundary, so two chains that share one boundary agree from there on: the chain of a chunk is taken over
at the first boundary it shares with the true chain inside the overlap. If the overlap holds none (one run of
letters longer than it), the true chain is carried on through the next chunk instead, so the result never depends on the
chunk size. The pre-tokens are then encoded, each on its own. A text that is one chunk has nothing to stitch and is split and
encoded in one go. Decoding concatenates the bytes of the ids.

Code points that this Python does not know may be classed otherwise by the library. A run between white space that holds
one stays one piece, which the library splits itself; its ends are boundaries whatever the classes are.

Null counts as the empty text: no ids, and the digests of nothing. Rows that repeat an id, or a text, are each encoded. A very
long text is split in parallel; its pre-tokens are encoded in one task, which must hold it. An empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime as rt

#: Code points of a chunk and of what it shares with the next one.
CHUNK, OVERLAP = 32_768, 512
#: A contraction looks this far ahead; boundaries nearer to the end of a chunk are not settled.
SETTLED = 4


@functools.cache
def _splitter():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


_FAR = re.compile("[^\u0000-\u0557]")


@functools.cache
def _unsure():
    """Runs between white space with code points this Python does not know, and the blank that belongs to them."""
    import regex

    spans, start = [], None
    for c in range(0x558, sys.maxunicode + 2):
        gone = c <= sys.maxunicode and unicodedata.category(chr(c)) in ("Cn", "Cs")
        if gone and start is None:
            start = c
        if not gone and start is not None:
            spans.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    some = "".join(spans)
    return regex.compile(f" ?[^\\s{some}]*+[{some}]\\S*+")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens, but for runs with code points of unsure class, which are one piece each."""
    pieces = _splitter().findall(text)
    if text.isascii() or not _FAR.search(text):
        return pieces
    whole = [m.span() for m in _unsure().finditer(text)]
    if not whole:
        return pieces
    cuts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
    inner = np.zeros(len(text) + 1, bool)
    for a, z in whole:
        inner[a + 1 : z] = True
    cuts = np.union1d(cuts[~inner[cuts]], np.array(whole).ravel()).tolist()
    return [text[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def _byte_of() -> dict[str, int]:
    """The letter that a byte-level vocabulary file writes for each byte: itself if it is printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Ranks:
    """Merge ranks by a path: encodes each pre-token on its own, and decodes."""

    def __init__(self, ranks: dict[bytes, int]):
        import public_tokenizers
        import tiktoken

        self.library = tiktoken.Encoding("tidewatch", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.bytes_of[i] = piece

    def encode(self, text: str) -> np.ndarray:
        """A text in one chunk: split and encoded in one go."""
        return self.library.encode_to_numpy(text, disallowed_special=())

    def encode_all(self, pieces: list[str]) -> np.ndarray:
        """Pre-tokens of several chunks, each encoded on its own; repeated ones once."""
        memo = {p: np.array(self.library.encode_ordinary(p), "<u4").tobytes() for p in set(pieces)}
        return np.frombuffer(b"".join(map(memo.__getitem__, pieces)), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """A tokenizers file. Where its ids are the order of its merges, they serve as ranks, which is several times faster than the
    library and gives the same ids; any other file is left to the library. So are texts that hold the string of an added
    token, such as <|endoftext|>: the library takes it for that token."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.added = [t["content"] for t in told.get("added_tokens") or []]
        vocab, byte_of = model["vocab"], _byte_of()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = None
        if all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges)):
            known = {t: i for t, i in vocab.items() if i < 256 + len(merges)}
            if all(c in byte_of for t in known for c in t):
                self.ranks = Ranks({bytes(byte_of[c] for c in t): i for t, i in known.items()})

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> np.ndarray:
        if self.ranks is not None and not any(a in text for a in self.added):
            return self.ranks.encode(text)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


@functools.cache
def ranks(path: str) -> Ranks:
    return Ranks(read_ranks(path))


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def chunked(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Chunk i begins at i * chunk and reaches `overlap` into the next one."""
    return [text[i : i + chunk + overlap] for i in range(0, max(1, len(text)), chunk)]


def boundaries(text: str) -> np.ndarray:
    """Where pre-tokens begin, and the end."""
    pieces = pre_tokens(text)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return np.concatenate([[0], np.cumsum(lengths)])


def stitch(chunks: list[str], cuts: list[np.ndarray], chunk: int = CHUNK) -> list[str]:
    """The pre-tokens of the whole text from those of its chunks."""
    out: list[str] = []
    text, chain, at = chunks[0], cuts[0], 0  # the true chain, from `at`, over `text`, which begins there
    for i in range(1, len(chunks)):
        begin, settled = i * chunk - at, len(text) - SETTLED
        shared = np.intersect1d(chain[(chain >= begin) & (chain <= settled)], cuts[i] + begin, assume_unique=True)
        if len(shared):
            meet = int(shared[0])
            own = chain[chain <= meet]
            out += [text[a:b] for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
            after = meet - begin
            text, at = chunks[i][after:], i * chunk + after
            chain = cuts[i][cuts[i] >= after] - after
        else:
            sure = chain[chain <= max(0, settled)]
            out += [text[a:b] for a, b in zip(sure[:-1].tolist(), sure[1:].tolist(), strict=True)]
            last = int(sure[-1])
            text, at = text[last:] + chunks[i][len(text) - begin :], at + last
            chain = boundaries(text)
    return out + [text[a:b] for a, b in zip(chain[:-1].tolist(), chain[1:].tolist(), strict=True)]


RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
RESULT_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _row(coder: Ranks, doc_id, ids: np.ndarray, names: list[bytes]) -> tuple:
    digits = b"".join(map(names.__getitem__, ids.tolist()))[:-1]
    return doc_id, len(ids), hashlib.sha256(digits).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()


@functools.cache
def _names(path: str) -> list[bytes]:
    return [b"%d," % i for i in range(len(ranks(path).bytes_of))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(RESULT)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, RESULT, strict=True)], schema=RESULT)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    rows = docs.select(rt.named(id_col).cast("long").alias("id"), rt.text_of(rt.named(text_col)).alias("text"), F.monotonically_increasing_id().alias("row"))
    long = F.char_length("text") > chunk

    def whole(batches):
        coder, names = ranks(path), _names(path)
        for b in batches:
            yield _batch([_row(coder, i, coder.encode(t), names) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])

    def cut(batches):
        for b in batches:
            for i, t, row in zip(*(b.column(c).to_pylist() for c in ("id", "text", "row")), strict=True):
                for k, piece in enumerate(chunked(t, chunk, overlap)):
                    yield pa.record_batch({"row": pa.array([row], pa.int64()), "id": pa.array([i], pa.int64()), "no": pa.array([k], pa.int64()), "piece": pa.array([piece])})

    def split(batches):
        for b in batches:
            yield b.append_column("cuts", pa.array([boundaries(t).astype("<i8").tobytes() for t in b.column("piece").to_pylist()], pa.binary()))

    def join(table: pa.Table) -> pa.Table:
        coder, names = ranks(path), _names(path)
        rows = sorted(zip(table["no"].to_pylist(), table["piece"].to_pylist(), table["cuts"].to_pylist(), strict=True), key=lambda r: r[0])
        ids = coder.encode_all(stitch([r[1] for r in rows], [np.frombuffer(r[2], "<i8") for r in rows], chunk))
        return pa.Table.from_batches([_batch([_row(coder, table["id"][0].as_py(), ids, names)])])

    pieces = rows.where(long).mapInArrow(cut, "row long, id long, no long, piece string")
    spread = pieces.repartition(rt.partitions(docs.sparkSession), "row", "no").mapInArrow(split, "row long, id long, no long, piece string, cuts binary")
    return rows.where(~long).select("id", "text").mapInArrow(whole, RESULT_DDL).unionByName(spread.groupBy("row").applyInArrow(join, RESULT_DDL))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(rt.read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
