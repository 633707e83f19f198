"""Encoding and packing: against the libraries, and chunk sizes that force stitching."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidewatch.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(library, plain):
    out = Counter()
    for i, t in plain:
        ids = library.encode_ordinary(t)
        out[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("chunk", "overlap"), [(bpe.CHUNK, bpe.OVERLAP), (37, 12), (9, 5)])
def test_encode(docs, plain, library, chunk, overlap):
    short = docs if chunk > 100 else docs.where("coalesce(length(text), 0) < 6000")
    rows = [(r.doc_id, r.text or "") for r in short.collect()]
    got = bpe.encode_documents(short, PATH, chunk=chunk, overlap=overlap).collect()
    assert Counter(tuple(r) for r in got) == expected(library, rows)


def test_encode_unknown_code_points_in_chunks(spark, library):
    """Code points without a class here, alone and inside words, at every place of a chunk; and rows that repeat."""
    rng = random.Random(7)
    unknown = ["\U0003fffe", "\u0378", "\U000e0080", "\U0001fbfb"]
    rows = [(k, "".join(rng.choice([*unknown, "a", "é", " ", "  ", "\n", "'s", "12", "!", "東", "xyz"]) for _ in range(rng.randrange(1, 90)))) for k in range(60)]
    rows += [rows[3]] * 3 + [(None, rows[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk, overlap in ((7, 5), (25, 10)):
        got = bpe.encode_documents(docs, PATH, chunk=chunk, overlap=overlap).collect()
        assert Counter(tuple(r) for r in got) == expected(library, rows)


def test_encode_empty(no_docs):
    assert bpe.encode_documents(no_docs, PATH).count() == 0


def test_stitch_never_depends_on_chunks():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "é", " ", "  ", "\n", "'s", "'re", "12", "!", "東", "xyz", "'"]) for _ in range(rng.randrange(1, 120)))
        chunk, overlap = rng.randrange(2, 30), rng.randrange(1, 20)
        parts = bpe.chunked(text, chunk, overlap)
        assert bpe.stitch(parts, [bpe.boundaries(p) for p in parts], chunk) == bpe.pre_tokens(text)


def test_vocabulary_has_the_ids_of_the_library(plain):
    own, library = bpe.vocabulary(JSON), Tokenizer.from_file(JSON)
    assert own.ranks is not None
    for _, t in plain:
        assert own.encode(t[:20000]).tolist() == library.encode(t[:20000], add_special_tokens=False).ids


ADDED = ["abc <|endoftext|> def", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endoftext|", "<|endoftext |>"]


def test_vocabulary_finds_added_tokens():
    own, library = bpe.vocabulary(JSON), Tokenizer.from_file(JSON)
    for t in [*ADDED, "word " * 10_000 + ADDED[0]]:
        assert own.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
    assert own.encode(ADDED[0]).tolist() == [39305, 220, 50256, 825]


def check_packing(got, plain, window):
    library = Tokenizer.from_file(JSON)
    want = Counter()
    for i, t in plain:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), window):
            want[(i, s, len(ids[s : s + window]), zlib.crc32(ids[s : s + window].tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n <= window for n in sequences.values())


@pytest.mark.parametrize("window", [2048, 64])
def test_packing(docs, plain, window):
    check_packing(packing.pack(docs, JSON, window).collect(), plain, window)


def test_packing_of_added_tokens(spark):
    rows = list(enumerate(ADDED))
    check_packing(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), JSON).collect(), rows, 2048)


def test_packing_empty(no_docs):
    assert packing.pack(no_docs, JSON).count() == 0


def test_plan_uses_every_length_and_pads_little():
    rng = np.random.default_rng(1)
    histogram = np.bincount(np.clip(rng.gamma(2, 300, 20000).astype(int), 1, 2048), minlength=2049)
    combos = packing.plan(histogram)
    used = np.zeros_like(histogram)
    for members, times in combos:
        assert sum(members) <= 2048
        for v in members:
            used[v] += times
    assert (used == histogram).all()
    assert packing.nnls_share(histogram) > 0.35
    total = sum(t for _, t in combos) * 2048
    assert 1 - (np.arange(2049) * histogram).sum() / total < 0.01


def test_solution_is_not_negative_and_near():
    histogram = np.zeros(129, np.int64)
    histogram[[40, 48, 88, 80, 100, 28]] = [50, 30, 50, 30, 20, 20]
    made = packing.combinations(histogram, 8)
    x = packing.solve(made, histogram)
    assert (x >= 0).all()
    uses = np.zeros(129)
    for row, n in zip(made, x, strict=True):
        for v in row[row > 0]:
            uses[v] += n
    assert np.abs(uses - histogram).max() < 1
