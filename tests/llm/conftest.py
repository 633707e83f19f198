import random

import pytest
from texts import WORDS, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, shard int, id long, key string, size long, rank int, band long, held_out string"
def rows(texts, first: int = 0):
    """Rows of documents with extra columns whose names clash with those of results."""
    return [(None if t == "NULL_ID" else first + i, "no id" if t == "NULL_ID" else t, "en", f"src{i % 3}", 0, None, 7, 1, "k", 2, 3, 4, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, repeated, long, accented, near-equal texts and secrets."""
    rng = random.Random(5)
    base = prose(rng, 300)
    near = base.split()
    near[100] = "changed"
    passage = prose(rng, 60)
    return [
        None, "", "", " \t\n", "one two", "one two", "one  two", base, base, " ".join(near), "x" * 5000, "é" * 300 + " übung 東京 Ᲊ " + "🙂" * 20,
        passage + " " + prose(rng, 30), prose(rng, 20) + " " + passage, " ".join(WORDS * 40), "token = abc\npassword: 'hunter2hunter2' AKIA" + "A1" * 9 + " " + "0af3" * 8,
        "secret=token: abcdef123", "api_key=\"Zx9" + "qW3e" * 6 + "\"", "NULL_ID", prose(rng, 40_000), "  lead and trail  ", "'s 't   \n\n  don't",
    ]


@pytest.fixture(scope="session")
def docs(spark, odd_texts):
    made = rows(odd_texts)
    return spark.createDataFrame(made + [made[7], made[4]], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def plain(docs):
    """The rows as (doc_id, text) for brute force."""
    return [(r.doc_id, r.text or "") for r in docs.collect()]
