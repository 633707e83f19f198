"""The pipeline's rows against a brute-force version of each stage on what the stage before it kept."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from texts import groups_by_hand
from tokenizers import Tokenizer

from tidewatch.llm import secret_scan, toxicity
from tidewatch.llm import runtime as rt

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = rt.read_table(spark, DATA, "documents")
    scored = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, rt.read_table(spark, DATA, "labels")).collect()}
    rows = {r.doc_id: r for r in docs.collect() if not scored[r.doc_id]}
    assert len(rows) < docs.count()

    same = defaultdict(list)
    for i, r in rows.items():
        same[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append((-len(r.text), i))
    rows = {min(g)[1]: rows[min(g)[1]] for g in same.values()}

    plain = [(i, r.text) for i, r in sorted(rows.items())]
    rows = {i: rows[i] for i, least, _ in groups_by_hand(plain) if i == least}

    spans = secret_scan.judged(spark.createDataFrame(list(rows.values()), docs.schema), owner=F.col("source"), repo=F.concat_ws("/", "source", "lang")).collect()
    texts = {i: r.text for i, r in rows.items()}
    for r in spans:
        gone = set()
        for v in r.verdicts:
            gone |= set(range(v.start, v.end)) if v.live else set()
        text, out = texts[r["id"]], ""
        for k, c in enumerate(text):
            out += "" if k in gone else c
            starts = any(v.live and v.start == k for v in r.verdicts) and k - 1 not in gone
            out += secret_scan.MASK if starts else ""
        texts[r["id"]] = out

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in texts.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), 2048):
            want[(i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids))] += 1
    got = corpus_pipeline.run(spark, DATA).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want


def test_stages_keep_columns_and_clean_documents(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    out = docs
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, out, DATA)
        assert out.columns == docs.columns
        out = rt.materialise(out, "stage")
    assert toxicity.keep_clean(docs, labels).count() == docs.count()
    assert 0 < out.count() < docs.count()
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, DATA).count() == 0


def test_stages_keep_columns_with_operators_names(spark):
    """Extra columns whose names operators use themselves pass every stage with their values."""
    names = ["__id", "__score", "__n", "row", "id", "no", "best", "set", "score", "size"]
    rows = [(k, f"one two three four five {'six' * (k % 3)} token = abcdef{k % 2}99999", "s", "en", *range(k, k + len(names))) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, " + ", ".join(f"{n} long" for n in names))
    labels = rt.read_table(spark, DATA, "labels")
    kept = toxicity.keep_clean(docs, labels.where("doc_id < 0"))
    assert kept.columns == docs.columns and kept.count() == 12
    out = docs
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = rt.materialise(stage(spark, out, DATA), "stage")
        assert out.columns == docs.columns
    for r in out.collect():
        assert tuple(r)[4:] == rows[r.doc_id][4:]
    assert corpus_pipeline.STAGES[4][1](spark, out, DATA).count() == out.count() > 0
