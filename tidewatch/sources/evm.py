"""EVM sources: event selectors, checksummed addresses, ABI words, and logs decoded by one projection."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1


def _constants() -> tuple[list[int], list[list[int]]]:
    """Round constants from the degree-8 shift register, rotation offsets from the triangular walk."""
    rounds, r = [], 1
    for _ in range(24):
        c = 0
        for j in range(7):
            r = (r << 1) ^ ((r >> 7) * 0x171)
            if r & 2:
                c ^= 1 << ((1 << j) - 1)
        rounds.append(c)
    turn = [[0] * 5 for _ in range(5)]
    x, y = 1, 0
    for t in range(24):
        turn[x][y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return rounds, turn


_ROUNDS, _TURN = _constants()


def _left(v: int, n: int) -> int:
    return ((v << n) | (v >> (64 - n))) & _MASK if n else v


def keccak256(data: bytes) -> bytes:
    """Keccak with the original padding, as event selectors use it."""
    rate = 136
    data += b"\x01" + b"\x00" * (-(len(data) + 1) % rate)
    data = data[:-1] + bytes([data[-1] | 0x80])
    a = [[0] * 5 for _ in range(5)]
    for block in range(0, len(data), rate):
        for k in range(rate // 8):
            a[k % 5][k // 5] ^= int.from_bytes(data[block + 8 * k : block + 8 * k + 8], "little")
        for c in _ROUNDS:
            column = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
            mixed = [column[x - 1] ^ _left(column[(x + 1) % 5], 1) for x in range(5)]
            b = [[0] * 5 for _ in range(5)]
            for x in range(5):
                for y in range(5):
                    b[y][(2 * x + 3 * y) % 5] = _left(a[x][y] ^ mixed[x], _TURN[x][y])
            a = [[b[x][y] ^ (~b[(x + 1) % 5][y] & _MASK & b[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
            a[0][0] ^= c
    return b"".join(a[k % 5][k // 5].to_bytes(8, "little") for k in range(4))


@functools.cache
def selector(signature: str) -> str:
    return "0x" + keccak256(signature.encode()).hex()


def checksum_address(address: str) -> str:
    """Mixed-case form whose capitals check the address."""
    plain = address.lower().removeprefix("0x")
    digest = keccak256(plain.encode()).hex()
    return "0x" + "".join(c.upper() if int(d, 16) >= 8 else c for c, d in zip(plain, digest, strict=False))


#: Event name -> (signature, {field: (place, type)}); a place is topic 1-3 or a data word.
EVENTS: dict[str, tuple[str, dict[str, tuple[str, str]]]] = {
    "transfer": ("Transfer(address,address,uint256)", {"from": ("t1", "address"), "to": ("t2", "address"), "amount": ("d0", "uint")}),
    "approval": ("Approval(address,address,uint256)", {"from": ("t1", "address"), "to": ("t2", "address"), "amount": ("d0", "uint")}),
    "v2_swap": ("Swap(address,uint256,uint256,uint256,uint256,address)", {"from": ("t1", "address"), "to": ("t2", "address"), "amount": ("d0", "uint"), "amount1": ("d1", "uint"), "amount2": ("d2", "uint"), "amount3": ("d3", "uint")}),
    "v2_mint": ("Mint(address,uint256,uint256)", {"from": ("t1", "address"), "amount": ("d0", "uint"), "amount1": ("d1", "uint")}),
    "v2_burn": ("Burn(address,uint256,uint256,address)", {"from": ("t1", "address"), "to": ("t2", "address"), "amount": ("d0", "uint"), "amount1": ("d1", "uint")}),
    "v3_swap": ("Swap(address,address,int256,int256,uint160,uint128,int24)", {"from": ("t1", "address"), "to": ("t2", "address"), "amount": ("d0", "int"), "amount1": ("d1", "int"), "amount2": ("d3", "uint"), "amount3": ("d4", "int")}),
    "v3_mint": ("Mint(address,address,int24,int24,uint128,uint256,uint256)", {"from": ("d0", "address"), "to": ("t1", "address"), "amount": ("d1", "uint"), "amount1": ("d2", "uint"), "amount2": ("d3", "uint")}),
    "v3_burn": ("Burn(address,int24,int24,uint128,uint256,uint256)", {"from": ("t1", "address"), "amount": ("d0", "uint"), "amount1": ("d1", "uint"), "amount2": ("d2", "uint")}),
    "pancake_v3_swap": ("Swap(address,address,int256,int256,uint160,uint128,int24,uint128,uint128)", {"from": ("t1", "address"), "to": ("t2", "address"), "amount": ("d0", "int"), "amount1": ("d1", "int"), "amount2": ("d3", "uint"), "amount3": ("d4", "int")}),
    "aerodrome_pool": ("PoolCreated(address,address,bool,address,uint256)", {"from": ("t1", "address"), "to": ("t2", "address"), "pool": ("d0", "address"), "amount": ("d1", "uint")}),
    "aerodrome_swap": ("Swap(address,address,uint256,uint256,uint256,uint256)", {"from": ("t1", "address"), "to": ("t2", "address"), "amount": ("d0", "uint"), "amount1": ("d1", "uint"), "amount2": ("d2", "uint"), "amount3": ("d3", "uint")}),
    "aerodrome_burn": ("Burn(address,address,uint256,uint256)", {"from": ("t1", "address"), "to": ("t2", "address"), "amount": ("d0", "uint"), "amount1": ("d1", "uint")}),
    "pair_created": ("PairCreated(address,address,address,uint256)", {"from": ("t1", "address"), "to": ("t2", "address"), "pool": ("d0", "address"), "amount": ("d1", "uint")}),
    "pool_created": ("PoolCreated(address,address,uint24,int24,address)", {"from": ("t1", "address"), "to": ("t2", "address"), "amount": ("d0", "int"), "pool": ("d1", "address")}),
    "permit": ("Permit(address,address,address,uint160,uint48,uint48)", {"from": ("t1", "address"), "pool": ("t2", "address"), "to": ("t3", "address"), "amount": ("d0", "uint"), "amount1": ("d1", "uint"), "amount2": ("d2", "uint")}),
    "permit_approval": ("Approval(address,address,address,uint160,uint48)", {"from": ("t1", "address"), "pool": ("t2", "address"), "to": ("t3", "address"), "amount": ("d0", "uint"), "amount1": ("d1", "uint")}),
    "lockdown": ("Lockdown(address,address,address)", {"from": ("t1", "address"), "pool": ("d0", "address"), "to": ("d1", "address")}),
    "nonce_invalidation": ("NonceInvalidation(address,address,address,uint48,uint48)", {"from": ("t1", "address"), "pool": ("t2", "address"), "to": ("t3", "address"), "amount": ("d0", "uint"), "amount1": ("d1", "uint")}),
    "unordered_nonce": ("UnorderedNonceInvalidation(address,uint256,uint256)", {"from": ("t1", "address"), "amount": ("d0", "uint"), "amount1": ("d1", "uint")}),
}
FIELDS = ("from", "to", "pool", "amount", "amount1", "amount2", "amount3")
INITIALIZES = ("pair_created", "pool_created", "aerodrome_pool")


def word(topics: Column, data: Column, place: str) -> Column:
    """64 hex digits of a topic or data word; null if it is not there."""
    n = int(place[1:])
    raw = F.substring(F.get(topics, F.lit(n)), 3, 64) if place[0] == "t" else F.substring(data, 3 + 64 * n, 64)
    return F.when(F.length(raw) == 64, F.lower(raw))


def as_address(w: Column) -> Column:
    return F.concat(F.lit("0x"), F.substring(w, 25, 40))


def as_signed(w: Column, signed: Column) -> Column:
    """DECIMAL(38,0) of a word, by limbs of 14 digits; a signed one is negative if its first bit is set. Null beyond 37
    digits (the raw word keeps the value)."""
    negative = signed & (F.substring(w, 1, 1) >= "8")
    digits = F.when(negative, F.translate(w, "0123456789abcdef", "fedcba9876543210")).otherwise(w)
    limb = lambda at, n: F.conv(F.substring(digits, at, n), 16, 10).cast("decimal(38,0)")
    big = F.lit(1 << 56).cast("decimal(38,0)")
    size = F.when(F.substring(digits, 1, 33) == "0" * 33, (limb(34, 3) * big + limb(37, 14)) * big + limb(51, 14))
    return F.when(negative, -size - 1).otherwise(size).cast("decimal(38,0)")


def as_text(w: Column) -> Column:
    """The whole unsigned 256-bit word in decimal digits: limbs of 56 bits times powers of two kept in base 10 ** 18."""
    base = 10**18
    limbs = [F.conv(F.substring(w, a, n), 16, 10).cast("decimal(17,0)") for a, n in ((51, 14), (37, 14), (23, 14), (9, 14), (1, 8))]
    sums = [sum((limb * F.lit((1 << 56 * k) // base**j % base).cast("decimal(18,0)") for k, limb in enumerate(limbs)), F.lit(0).cast("decimal(38,0)")) for j in range(5)]
    out, carry = [], F.lit(0).cast("decimal(38,0)")
    for s in sums:
        total = (s + carry).cast("decimal(38,0)")
        rest = (total % F.lit(base).cast("decimal(38,0)")).cast("decimal(38,0)")
        carry = ((total - rest) / F.lit(base).cast("decimal(38,0)")).cast("decimal(38,0)")
        out.append(F.lpad(rest.cast("string"), 18, "0"))
    return F.regexp_replace(F.concat(*reversed(out)), "^0+(?=.)", "")


def decode_abi(data: Column, types: list[str]) -> list[Column]:
    """A column for each ABI type of a parameter list in `data` (0x and hex digits): address, uintN and intN (DECIMAL(38,0), null
    beyond 37 digits), bool, bytesN, and bytes and string by the offset in their head word. Null where a word or the bytes
    that an offset or length promises are not there, or a bool is neither 0 nor 1."""
    at = lambda k: F.substring(data, k, F.lit(64))
    whole = lambda w: F.when(F.length(w) == 64, F.lower(w))
    small = lambda w: F.when(F.substring(w, 1, 56) == "0" * 56, F.conv(F.substring(w, 57, 8), 16, 10).cast("int"))
    out = []
    for k, kind in enumerate(types):
        head = whole(at(F.lit(3 + 64 * k)))
        if kind in ("bytes", "string"):
            start = 3 + 2 * small(head)
            size = small(whole(at(start)))
            body = F.substring(data, start + 64, 2 * size)
            body = F.when(F.length(body) == 2 * size, F.lower(body))
            out.append(F.decode(F.unhex(body), "UTF-8") if kind == "string" else F.concat(F.lit("0x"), body))
        elif kind == "address":
            out.append(as_address(head))
        elif kind == "bool":
            out.append(F.when(small(head).isin(0, 1), small(head) == 1))
        elif kind.startswith("bytes"):
            out.append(F.concat(F.lit("0x"), F.substring(head, 1, 2 * int(kind[5:]))))
        else:
            out.append(as_signed(head, F.lit(kind.startswith("int"))))
    return out


_PLACES = ("t1", "t2", "t3", "d0", "d1", "d2", "d3", "d4")


def _lookup(key: Column, values: dict[str, object]) -> Column:
    """One literal map and one look-up, however many events there are."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def decode_logs(logs: DataFrame, topics: str = "topics", data: str = "data") -> DataFrame:
    """logs with event, from_address, to_address, pool, amount...: projections only, no shuffle; unknown selectors give a null event.

    The words are cut out once; a literal map per field says which of them an event keeps it in. Data that are not whole words
    give nulls. amount_text holds the first amount of any size (its magnitude as an unsigned word) in decimal digits."""
    event = _lookup(F.lower(F.get(F.col(topics), F.lit(0))), {selector(signature): name for name, (signature, _) in EVENTS.items()})
    whole = F.pmod(F.length(data) - 2, F.lit(64)) == 0
    cut = logs.withColumn("__event", event).withColumn("__words", F.array(*[word(F.col(topics), F.when(whole, F.col(data)), p) for p in _PLACES]))
    out = cut
    for f in FIELDS:
        places = {name: _PLACES.index(fields[f][0]) for name, (_, fields) in EVENTS.items() if f in fields}
        signed = [name for name, (_, fields) in EVENTS.items() if fields.get(f, ("", ""))[1] == "int"]
        out = out.withColumn(f"__{f}", F.get(F.col("__words"), _lookup(F.col("__event"), places))).withColumn(f"__{f}_signed", F.col("__event").isin(*signed) if signed else F.lit(False))
    names = {"from": "from_address", "to": "to_address"}
    made = [as_address(F.col(f"__{f}")) if f in ("from", "to", "pool") else as_signed(F.col(f"__{f}"), F.col(f"__{f}_signed")) for f in FIELDS]
    return out.select(*[F.col(c) for c in logs.columns], F.col("__event").alias("event"), *[c.alias(names.get(f, f)) for f, c in zip(FIELDS, made, strict=True)], as_text(F.col("__amount")).alias("amount_text"))


def initialize_events(decoded: DataFrame) -> DataFrame:
    """Factory events as pool events of kind initialize."""
    return decoded.where(F.col("event").isin(*INITIALIZES)).select("pool", F.lit("initialize").alias("event_kind"), F.col("from_address").alias("token0"), F.col("to_address").alias("token1"), "event")
