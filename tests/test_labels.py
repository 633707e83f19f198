"""Labels as of a point in time, against brute force."""

import random

from tidewatch.operators import smart_money


def test_labels_as_of(spark):
    rng = random.Random(3)
    labels = [(f"w{rng.randrange(4)}", rng.choice("abc"), round(rng.random(), 1), at := rng.randrange(1000), rng.choice((None, at + rng.randrange(300)))) for _ in range(60)]
    asks = [(f"w{rng.randrange(5)}", rng.randrange(1200), k) for k in range(200)] + [("w1", 500, 500), ("w1", 500, 501), (None, 5, 502)]
    got = smart_money.labels_as_of(spark.createDataFrame(asks, "address string, observed_at long, k long"), spark.createDataFrame(labels, "address string, label string, confidence double, issued_at long, expires_at long"), 100)
    assert got.columns == ["address", "observed_at", "k", "label", "confidence"]

    def best(address, t):
        held = [(-c, -i, n) for a, n, c, i, e in labels if a == address and i < t and (e is None or t < e)]
        return (min(held)[2], -min(held)[0]) if held else (None, None)

    assert {r.k: (r.label, r.confidence) for r in got.collect()} == {k: best(a, t) for a, t, k in asks}
    none = spark.createDataFrame([], "address string, observed_at long, k long")
    assert smart_money.labels_as_of(none, spark.createDataFrame(labels, "address string, label string, confidence double, issued_at long, expires_at long"), 100).count() == 0
