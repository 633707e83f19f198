"""Solana accounts by declared layouts (S9): fields at fixed places, checks of length and magic, and keys in base 58.

A layout is data. `decode_account` is one projection whatever the layout, without Python rows: numbers by byte swaps, keys by long
division over 32-bit limbs in higher-order functions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import Dialect, Tables
from .solana import little

ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
#: Sizes of the numbers; a key has 32 bytes.
NUMBERS = {"u8": 1, "u16": 2, "u32": 4, "u64": 8, "u128": 16}


@dataclass(frozen=True)
class Layout:
    """`size` bytes at least, beginning with `magic` (hex); fields are name -> (byte, kind), a kind being one of NUMBERS or "key"."""

    size: int
    fields: dict[str, tuple[int, str]]
    magic: str = ""
    owners: tuple[str, ...] = field(default=())


def account_discriminator(name: str) -> str:
    """First eight bytes of the hash of an account type's name."""
    return hashlib.sha256(f"account:{name}".encode()).hexdigest()[:16]


def _run(start: int, kind: str, *names: str) -> dict[str, tuple[int, str]]:
    """Fields of one kind, one after the other."""
    size = NUMBERS.get(kind, 32)
    return {name: (start + k * size, kind) for k, name in enumerate(names)}


#: Programs, and the places of the fields in their accounts.
AMM_V4 = Layout(
    752,
    _run(0, "u64", "status", "nonce")
    | _run(32, "u64", "coin_decimals", "pc_decimals")
    | _run(144, "u64", "trade_fee_numerator", "trade_fee_denominator")
    | _run(176, "u64", "swap_fee_numerator", "swap_fee_denominator", "need_take_pnl_coin", "need_take_pnl_pc")
    | _run(256, "u128", "swap_coin_in_amount", "swap_pc_out_amount")
    | _run(336, "key", "coin_vault", "pc_vault", "coin_vault_mint", "pc_vault_mint", "lp_mint", "open_orders", "market", "market_program", "target_orders", "withdraw_queue", "lp_vault", "owner", "pnl_owner"),
    owners=("675kPX9MHTjS2zt1qfr1NYHuzeLXfQM9H24wFSUt1Mp8",),
)
CPMM = Layout(
    637,
    _run(8, "key", "amm_config", "pool_creator", "token_0_vault", "token_1_vault", "lp_mint", "token_0_mint", "token_1_mint", "token_0_program", "token_1_program", "observation_key") | _run(328, "u8", "auth_bump"),
    magic=account_discriminator("PoolState"),
)
OPENBOOK = Layout(
    349,
    {"own_address": (13, "key"), "vault_signer_nonce": (45, "u64"), "coin_mint": (53, "key"), "pc_mint": (85, "key"), "coin_vault": (117, "key"), "pc_vault": (165, "key")} | _run(221, "key", "request_queue", "event_queue", "bids", "asks"),
    magic=b"serum".hex(),
    owners=("srmqPvymJeFKQ4zGQed1GFppgkRHL9kaELCbyksJtPX", "opnb2LAfJYbRMAHHvqjCwQxanZn7ReEHp1k81EohpZb"),
)
LAYOUTS = {"amm_v4": AMM_V4, "cpmm": CPMM, "openbook": OPENBOOK}


def number(data: Column, at: int, size: int) -> Column:
    """Unsigned little-endian number of up to 16 bytes as DECIMAL(38,0); null beyond the end, or if it has more than 38 digits."""
    if size <= 8:
        return little(data, at, size)
    # the high half first: a number under 10 ** 38 has one under 2 ** 63
    wide = F.lit(str(1 << 64)).cast("decimal(20,0)")
    high, low = (little(data, at + k, 8).cast("decimal(20,0)") for k in (8, 0))
    most = divmod(10**38 - 1, 1 << 64)
    fits = (high < F.lit(str(most[0])).cast("decimal(20,0)")) | ((high == F.lit(str(most[0])).cast("decimal(20,0)")) & (low <= F.lit(str(most[1])).cast("decimal(20,0)")))
    return F.when(fits, ((high.cast("decimal(19,0)") * wide.cast("decimal(20,0)")).cast("decimal(38,0)") + low).cast("decimal(38,0)"))


def base58(digits: Column, size: int = 32) -> Column:
    """`size` bytes in hex (a multiple of four) in base 58; null for another length.

    The limbs are divided by 58 ** 5 again and again, a remainder being five digits; every leading zero byte is one more '1'."""
    chunk, steps = 58**5, -(-size * 1366 // 5000)  # a byte is at most 1.366 digits of base 58
    limbs = F.transform(F.sequence(F.lit(0), F.lit(size // 4 - 1)), lambda k: F.conv(F.substr(digits, k * 8 + 1, F.lit(8)), 16, 10).cast("long"))

    zero = F.expr("named_struct('out', cast(array() as array<bigint>), 'rest', cast(0 as bigint))")
    whole = lambda acc, limb: F.struct(F.concat(acc["out"], F.array(_div(acc["rest"] * F.lit(1 << 32) + limb, chunk))).alias("out"), F.pmod(acc["rest"] * F.lit(1 << 32) + limb, F.lit(chunk)).cast("long").alias("rest"))

    def step(acc: Column, _: Column) -> Column:
        done = F.aggregate(acc["limbs"], zero, whole)
        return F.transform(F.array(done), lambda r: F.struct(r["out"].alias("limbs"), F.concat(F.array(r["rest"]), acc["chunks"]).alias("chunks")))[0]

    start = F.struct(limbs.alias("limbs"), F.expr("cast(array() as array<bigint>)").alias("chunks"))
    chunks = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["chunks"]
    char = lambda v, k: F.substr(F.lit(ALPHABET), F.pmod(_div(v, 58**k), F.lit(58)).cast("int") + 1, F.lit(1))
    text = F.array_join(F.transform(chunks, lambda v: F.concat(*[char(v, k) for k in reversed(range(5))])), "")
    zeros = F.length(F.regexp_extract(digits, "^((?:00)*)", 1)) / 2
    return F.when(F.length(digits) == 2 * size, F.concat(F.repeat(F.lit("1"), zeros.cast("int")), F.regexp_replace(text, "^1+", "")))


def _div(a: Column, b: int) -> Column:
    """Whole quotient of longs."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def decode_account(accounts: DataFrame, layout: Layout, data: str = "data", owner: str | None = None) -> DataFrame:
    """accounts with a struct `account` of the layout's fields: numbers as DECIMAL(38,0), keys in base 58. It is null for data (hex) that are
    null, no whole bytes, too short or without the magic, and, if a column `owner` is named, for accounts that another program owns."""
    owned = F.col(owner).isin(*layout.owners) if owner is not None and layout.owners else F.lit(True)
    keys = [name for name, (_, kind) in layout.fields.items() if kind == "key"]
    first = lambda rows: F.get(rows, F.lit(0))

    def read(d: Column) -> Column:
        good = owned & (F.length(d) >= 2 * layout.size) & (F.length(d) % 2 == 0) & d.startswith(layout.magic)
        cut = F.array(*[F.substring(d, 2 * layout.fields[name][0] + 1, 64) for name in keys])
        named = lambda got: F.struct(*[(F.get(got, F.lit(keys.index(name))) if kind == "key" else number(d, at, NUMBERS[kind])).alias(name) for name, (at, kind) in layout.fields.items()])
        return F.when(good, first(F.transform(F.array(F.transform(cut, lambda key: base58(key))), named)))

    # data and keys are variables of lambdas, worked out once per account; a generator of one row gives the struct, so that columns
    # taken from it later do not each decode the account again
    return accounts.select("*", F.explode(F.transform(F.array(F.lower(F.col(data))), read)).alias("account"))


# accounts made from the pools, and read back


def _made_key(name: str, d: Dialect | None = None) -> str:
    """Hex digits of a key of a pool: now and then its first bytes are zero."""
    return f"CASE WHEN dex_no = 1 THEN concat('0000', substring(sha2(concat('{name}', pool), 256), 5)) ELSE sha2(concat('{name}', pool), 256) END" if d is None or d.spark else f"CASE WHEN dex_no = 1 THEN concat('0000', substring(sha256(concat('{name}', pool)), 5)) ELSE sha256(concat('{name}', pool)) END"


#: What the numbers of a made account hold, as SQL over a pool.
_VALUES = {"status": "6", "nonce": "dex_no", "coin_decimals": "9", "pc_decimals": "6", "auth_bump": "250 + dex_no % 6", "vault_signer_nonce": "providers", "need_take_pnl_coin": "abs(liquidity_cents)", "swap_coin_in_amount": "abs(liquidity_cents)"}


def _encoded(layout: Layout) -> Column:
    """Account data of the layout: numbers of 16 bytes have a 1 in their high half."""
    parts, at = [F.lit(layout.magic)], len(layout.magic) // 2
    for name, (start, kind) in sorted(layout.fields.items(), key=lambda kv: kv[1][0]):
        parts.append(F.lit("00" * (start - at)))
        size = NUMBERS.get(kind, 32)
        if kind == "key":
            parts.append(F.expr(_made_key(name)))
        else:
            digits = F.lpad(F.hex(F.expr(f"CAST({_VALUES.get(name, '0')} AS BIGINT)")), 2 * min(size, 8), "0")
            parts += [F.substring(digits, 2 * k + 1, 2) for k in reversed(range(min(size, 8)))]
            parts += [F.lit("01" + "00" * (size - 9))] * (size > 8)
        at = start + size
    return F.concat(*parts, F.lit("00" * (layout.size - at)))


def decoded_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account of every pool in three layouts, one row per field; every third pool's data lack their last byte."""
    pools = Tables(spark, sf_dir)("pools").select("pool", "dex_no", "providers", "liquidity_cents")
    out = None
    for kind, layout in LAYOUTS.items():
        data = _encoded(layout)
        cut = F.when(F.col("providers") % 3 == 0, F.substring(data, 1, 2 * layout.size - 2)).otherwise(data)
        read = decode_account(pools.select("pool", cut.alias("data")), layout)
        values = F.map_from_arrays(F.array(*[F.lit(n) for n in layout.fields]), F.array(*[F.col("account")[n].cast("string") for n in layout.fields]))
        rows = read.where("account IS NOT NULL").select("pool", F.lit(kind).alias("layout"), F.explode(values).alias("field", "value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def decoded_text(d: Dialect) -> str:
    """Keys in base 58 by 44 divisions of a list of limbs: the rest before a limb is the number above it modulo 58."""
    powers = [pow(1 << 32, k, 58) for k in range(8)]
    rest = lambda n: "(" + (" + ".join(f"v[{j + 1}] * {powers[n - 1 - j]}" for j in range(n)) or "0") + ") % 58"
    limbs = ", ".join(f"CAST(('0x' || substring(hex, {8 * k + 1}, 8)) AS BIGINT)" for k in range(8))
    quotients = ", ".join(f"(({rest(k)}) * 4294967296 + v[{k + 1}]) // 58" for k in range(8))
    keys, numbers = [], []
    for kind, layout in LAYOUTS.items():
        for name, (_, of) in layout.fields.items():
            if of == "key":
                keys.append(f"SELECT pool, '{kind}' AS layout, '{name}' AS field, {_made_key(name, d)} AS hex FROM p")
            else:
                value = f"CAST({_VALUES.get(name, '0')} AS HUGEINT)" + (f" + {1 << 64}" if of == "u128" else "")
                numbers.append(f"SELECT pool, '{kind}' AS layout, '{name}' AS field, CAST({value} AS VARCHAR) AS value FROM p")
    return f"""
    WITH RECURSIVE p AS (SELECT pool, dex_no, providers, liquidity_cents FROM {{pools}} WHERE providers % 3 <> 0),
    k AS ({" UNION ALL ".join(keys)}),
    r AS (SELECT pool, layout, field, hex, [{limbs}] AS v, '' AS text, 0 AS n FROM k
      UNION ALL SELECT pool, layout, field, hex, [{quotients}], concat(substring('{ALPHABET}', CAST({rest(8)} AS INT) + 1, 1), text), n + 1 FROM r WHERE n < 44)
    SELECT pool, layout, field, concat(repeat('1', CASE WHEN substring(hex, 1, 4) = '0000' THEN 2 WHEN substring(hex, 1, 2) = '00' THEN 1 ELSE 0 END), regexp_replace(text, '^1+', '')) AS value FROM r WHERE n = 44
    UNION ALL {" UNION ALL ".join(numbers)}"""


QUERIES = {"s09_accounts": (decoded_accounts, decoded_text)}
