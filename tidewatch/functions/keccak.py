"""Keccak-256 of a column and checksummed addresses (S5): the permutation runs over NumPy lanes, for all rows of an Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import Dialect, Tables
from ..sources import evm

#: Bytes that a block takes up.
RATE = 136


def _left(v: np.ndarray, n: int) -> np.ndarray:
    return (v << np.uint64(n)) | (v >> np.uint64(64 - n)) if n else v


def permute(a: np.ndarray) -> np.ndarray:
    """The permutation of states of shape (5, 5, n), first axis x."""
    for c in evm._ROUNDS:
        column = np.bitwise_xor.reduce(a, axis=1)
        a = a ^ (np.roll(column, 1, axis=0) ^ _left(np.roll(column, -1, axis=0), 1))[:, None]
        b = np.empty_like(a)
        for x in range(5):
            for y in range(5):
                b[y, (2 * x + 3 * y) % 5] = _left(a[x, y], evm._TURN[x][y])
        a = b ^ (~np.roll(b, -1, axis=0) & np.roll(b, -2, axis=0))
        a[0, 0] ^= np.uint64(c)
    return a


def digests(data: list[bytes]) -> np.ndarray:
    """Digests of messages as rows of 32 bytes. Messages with the same number of blocks go through together."""
    out = np.zeros((len(data), 32), np.uint8)
    blocks = np.array([len(x) // RATE + 1 for x in data], np.int64)
    for n in np.unique(blocks):
        at = np.flatnonzero(blocks == n)
        size = int(n) * RATE
        padded = np.frombuffer(b"".join((data[i] + b"\x01").ljust(size, b"\0") for i in at), np.uint8).reshape(len(at), size).copy()
        padded[:, -1] |= 0x80
        lanes = padded.view("<u8").reshape(len(at), int(n), RATE // 8).astype(np.uint64)
        state = np.zeros((5, 5, len(at)), np.uint64)
        for k in range(int(n)):
            for j in range(RATE // 8):
                state[j % 5, j // 5] ^= lanes[:, k, j]
            state = permute(state)
        out[at] = np.ascontiguousarray(state[:4, 0].T).astype("<u8").view(np.uint8)
    return out


def checksums(plain: list[str]) -> list[str]:
    """The mixed-case forms of 40 lower-case hex digits each: a letter is a capital where the digest of the digits has 8 or more."""
    if not plain:
        return []
    text = [p.encode() for p in plain]
    digest = digests(text)[:, :20]
    nibble = np.stack([digest >> 4, digest & 15], axis=2).reshape(len(text), 40)
    chars = np.frombuffer(b"".join(text), np.uint8).reshape(len(text), 40)
    mixed = np.where((chars >= 97) & (nibble >= 8), chars - 32, chars).astype(np.uint8)
    return ["0x" + bytes(row).decode() for row in mixed]


def keccak(data: Column) -> Column:
    """Digest of a binary column as 64 lower-case hex digits; null stays null."""

    @F.pandas_udf("string")
    def made(column: pd.Series) -> pd.Series:
        there = column.notna()
        out = pd.Series([None] * len(column), index=column.index, dtype=object)
        out[there] = [bytes(d).hex() for d in digests([bytes(x) for x in column[there]])]
        return out

    return made(data.cast("binary"))


def checksum_address(address: Column) -> Column:
    """The checksummed form of an address of 0x (or 0X, or nothing) and 40 hex digits of any case; null for anything else. What
    is no address does not reach Python."""

    @F.pandas_udf("string")
    def made(column: pd.Series) -> pd.Series:
        there = column.notna()
        out = pd.Series([None] * len(column), index=column.index, dtype=object)
        out[there] = checksums(column[there].tolist())
        return out

    plain = F.regexp_extract(address, "^(?:0[xX])?([0-9a-fA-F]{40})\\z", 1)
    return made(F.when(F.length(plain) == 40, F.lower(plain)))


def is_checksummed(address: Column) -> Column:
    """Whether the letters of an address are those of its checksummed form; an address in one case only has no checksum and passes. Null
    for what is no address."""
    plain, mixed = F.regexp_replace(address, "^0[xX]", ""), checksum_address(address)
    one_case = (F.lower(plain) == plain) | (F.upper(plain) == plain)
    return F.when(mixed.isNotNull(), one_case | (plain == F.substring(mixed, 3, 40)))


# every wallet of the swaps, as an address


def wallet_address(d: Dialect) -> str:
    return "SELECT wallet, concat(md5(wallet), substring(md5(concat('a', wallet)), 1, 8)) AS plain FROM (SELECT DISTINCT sender AS wallet FROM {swaps}) AS w"


def checked_wallets(spark: SparkSession, sf_dir: str) -> DataFrame:
    wallets = Tables(spark, sf_dir)("swaps").select(F.col("sender").alias("wallet")).distinct()
    plain = F.concat(F.md5("wallet"), F.substring(F.md5(F.concat(F.lit("a"), F.col("wallet"))), 1, 8))
    return wallets.select("wallet", checksum_address(F.concat(F.lit("0x"), plain)).alias("address"))


def checked_text(d: Dialect) -> str:
    """The permutation as a recursion over lists of 25 lanes, lane x + 5 y."""
    turned = lambda v, n: f"((({v}) & (18446744073709551615::UBIGINT >> {n})) << {n}) | (({v}) >> (64 - {n}))"
    lane = lambda k: "CAST(" + " + ".join(f"CAST(ascii(substring(plain, {8 * k + j + 1}, 1)) AS UHUGEINT) * {256**j}" for j in range(8)) + " AS UBIGINT)"
    message = [lane(k) for k in range(5)] + ["1::UBIGINT"] + ["0::UBIGINT"] * 10 + ["9223372036854775808::UBIGINT"] + ["0::UBIGINT"] * 8
    column = ", ".join(f"xor(xor(xor(xor(s[{x + 1}], s[{x + 6}]), s[{x + 11}]), s[{x + 16}]), s[{x + 21}])" for x in range(5))
    mixed = ", ".join(f"xor(c[{(x + 4) % 5 + 1}], {turned(f'c[{(x + 1) % 5 + 1}]', 1)})" for x in range(5))
    moved = []
    for place in range(25):
        x, y = (3 * (place // 5) + place % 5) % 5, place % 5  # the lane that goes there
        v = f"xor(s[{x + 5 * y + 1}], d[{x + 1}])"
        n = evm._TURN[x][y]
        moved.append(turned(v, n) if n else v)
    full = "18446744073709551615::UBIGINT"
    after = [f"xor(b[{k + 1}], xor(b[{k // 5 * 5 + (k + 1) % 5 + 1}], {full}) & b[{k // 5 * 5 + (k + 2) % 5 + 1}])" for k in range(25)]
    after[0] = f"xor({after[0]}, ([{', '.join(f'{c}::UBIGINT' for c in evm._ROUNDS)}])[r + 1])"
    nibbles = "[(s[j // 16 + 1] >> (8 * ((j // 2) % 8) + CASE WHEN j % 2 = 0 THEN 4 ELSE 0 END)::UBIGINT) & 15 FOR j IN range(40)]"
    return f"""
    WITH RECURSIVE w AS ({wallet_address(d)}),
    k AS (SELECT wallet, plain, 0 AS r, [{", ".join(message)}] AS s FROM w
      UNION ALL SELECT wallet, plain, r + 1, [{", ".join(after)}] FROM
        (SELECT wallet, plain, r, [{", ".join(moved)}] AS b FROM (SELECT *, [{mixed}] AS d FROM (SELECT *, [{column}] AS c FROM k WHERE r < 24) AS k1) AS k2) AS k3),
    n AS (SELECT wallet, plain, {nibbles} AS nibble FROM k WHERE r = 24)
    SELECT wallet, concat('0x', array_to_string([CASE WHEN nibble[i] >= 8 THEN upper(substring(plain, i, 1)) ELSE substring(plain, i, 1) END FOR i IN range(1, 41)], '')) AS address FROM n"""


QUERIES = {"s05_checksum_addresses": (checked_wallets, checked_text)}
