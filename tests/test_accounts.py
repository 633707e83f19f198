"""Account layouts, keys in base 58, and Keccak over columns."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import keccak
from tidewatch.sources import accounts, evm


def base58(data: bytes) -> str:
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = accounts.ALPHABET[r] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out


def test_base58_column(spark):
    rng = random.Random(1)
    keys = [bytes(32), b"\xff" * 32, b"\0" * 31 + b"\x01", b"\0\0" + b"\xff" * 30, b"\x01" + bytes(31)] + [rng.randbytes(32) for _ in range(40)]
    keys += [bytes(rng.randrange(32)) + rng.randbytes(32) for _ in range(20)]
    rows = [(k[:32].hex(), base58(k[:32])) for k in keys]
    df = spark.createDataFrame(rows, "hex string, want string").withColumn("got", accounts.base58(F.col("hex")))
    assert [r for r in df.collect() if r.got != r.want] == []
    odd = spark.createDataFrame([(None,), ("",), ("00" * 31,), ("00" * 33,)], "hex string")
    assert {r[0] for r in odd.select(accounts.base58(F.col("hex"))).collect()} == {None}
    # a key that is known from the chain: the wrapped native coin
    native = "069b8857feab8184fb687f634618c035dac439dc1aeb3b5598a0f00000000001"
    assert spark.createDataFrame([(native,)], "hex string").select(accounts.base58(F.col("hex"))).first()[0] == "So11111111111111111111111111111111111111112"


@pytest.mark.parametrize("name", sorted(accounts.LAYOUTS))
def test_layouts(spark, name):
    """Random bytes are read as by slicing them; short, odd, null and unmarked data give null."""
    layout, rng = accounts.LAYOUTS[name], random.Random(7)
    magic = bytes.fromhex(layout.magic)
    made = [magic + rng.randbytes(layout.size - len(magic) + extra) for extra in (0, 0, 13)]
    rows = [(k, b.hex(), (layout.owners or ("x",))[0]) for k, b in enumerate(made)]
    rows += [(10, made[0][:-1].hex(), rows[0][2]), (11, made[0].hex() + "0", rows[0][2]), (12, None, rows[0][2]), (13, "", rows[0][2]), (14, made[0].hex(), "other"), (15, made[0].hex(), None)]
    if magic:
        rows.append((16, "ff" * layout.size, rows[0][2]))
    df = spark.createDataFrame(rows, "k int, data string, owner string")
    got = {r.k: r.account for r in accounts.decode_account(df, layout, owner="owner").collect()}
    for k, b in enumerate(made):
        for field, (at, kind) in layout.fields.items():
            want = base58(b[at : at + 32]) if kind == "key" else int.from_bytes(b[at : at + accounts.NUMBERS[kind]], "little")
            if kind == "u128" and want >= 10**38:
                want = None
            assert got[k][field] == want, (k, field)
    assert all(got[k] is None for k in got if k in (10, 11, 12, 13, 16))
    assert all((got[k] is None) == bool(layout.owners) for k in (14, 15))


def test_wide_numbers(spark):
    values = [0, 1, 2**64 - 1, 2**64, 10**38 - 1, 10**38, 2**127, 2**128 - 1]
    df = spark.createDataFrame([(v.to_bytes(16, "little").hex(),) for v in values] + [("00" * 15,), (None,)], "data string")
    got = [r[0] for r in df.select(accounts.number(F.col("data"), 0, 16)).collect()]
    assert got == [v if v < 10**38 else None for v in values] + [None, None]


def test_keccak_column(spark):
    rng = random.Random(3)
    texts = [b"", b"abc", b"Transfer(address,address,uint256)"] + [rng.randbytes(n) for n in (1, 134, 135, 136, 137, 271, 272, 273, 1000)]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "data binary").select("data", keccak.keccak(F.col("data")).alias("hash")).collect()
    assert [r.hash for r in rows] == [evm.keccak256(t).hex() for t in texts] + [None]
    assert rows[0].hash == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak.digests([]).shape == (0, 32)


def test_checksum_column(spark):
    # the examples of the standard
    good = ["0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed", "0xfB6916095ca1df60bB79Ce92cE3Ea74c37c5d359", "0xdbF03B407c01E7cD3CBea99509d93f8DDDC8C6FB", "0xD1220A0cf47c7B9Be7A2E6BA89F429762e7b9aDb", "0x52908400098527886E0F7030069857D2E4169EE7"]
    bad = [None, "", "0x", good[0][:-1], good[0] + "0", "0x" + "g" * 40, good[0] + "\n"]
    rows = [(a,) for a in good] + [(a.lower(),) for a in good] + [("0X" + a[2:].upper(),) for a in good] + [(a[2:],) for a in good]
    got = [r[0] for r in spark.createDataFrame(rows + [(b,) for b in bad], "a string").select(keccak.checksum_address(F.col("a"))).collect()]
    assert got == good * 4 + [None] * len(bad)
    flipped = good[0].replace("A", "a", 1)
    checked = spark.createDataFrame([(good[0],), (good[0].lower(),), (flipped,), ("0x12",), (None,)], "a string").select(keccak.is_checksummed(F.col("a")).alias("ok")).collect()
    assert [r.ok for r in checked] == [True, True, False, None, None]
    empty = spark.createDataFrame([], "a string").select(keccak.checksum_address(F.col("a")).alias("a"))
    assert empty.count() == 0 and empty.collect() == []
