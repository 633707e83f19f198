"""Solana sources: instruction data as hex, decoded by projections; little-endian numbers by byte swaps."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Programs, and instruction numbers of the token, system and pool programs.
TOKEN, TOKEN_2022, SYSTEM = "token", "token2022", "system"
TOKEN_TAGS = {3: "transfer", 7: "mint", 8: "burn", 12: "transfer", 14: "mint", 15: "burn"}
TOKEN_2022_TAGS = {27: "withdraw_from_mint", 28: "withdraw_from_accounts", 29: "harvest_to_mint", 6: "set_authority"}
WITHDRAW_AUTHORITY = 4
POOL_TAGS = {1: "initialize", 3: "mint", 4: "burn", 9: "swap_in", 11: "swap_out"}
#: Extension types of a Token-2022 mint, and where its extensions begin.
EXTENSIONS = {1: "transfer_fee", 4: "confidential_transfer", 9: "non_transferable", 12: "permanent_delegate", 14: "transfer_hook"}
TLV_OFFSET = 166


def discriminator(name: str) -> str:
    """First eight bytes of the hash of a global method name."""
    return hashlib.sha256(f"global:{name}".encode()).hexdigest()[:16]


CPMM_METHODS = {"swap_base_input": "swap_in", "swap_base_output": "swap_out", "deposit": "mint", "withdraw": "burn", "initialize": "initialize"}


def byte_at(data: Column, at: int) -> Column:
    return F.conv(F.substring(data, 2 * at + 1, 2), 16, 10).cast("int")


def little(data: Column, at: int | Column, size: int) -> Column:
    """Unsigned little-endian number of `size` bytes at byte `at` of a hex text, as DECIMAL(38,0); null beyond the end."""
    start = 2 * (F.lit(at) if isinstance(at, int) else at) + 1
    swapped = F.concat(*[F.substr(data, start + F.lit(2 * k), F.lit(2)) for k in reversed(range(size))])
    return F.when(F.length(swapped) == 2 * size, F.conv(swapped, 16, 10).cast("decimal(38,0)"))


def flatten_instructions(txs: DataFrame) -> DataFrame:
    """Outer instructions keep their place as log index, inner ones get outer * 1000 + inner."""
    outer = txs.select("*", F.posexplode("instructions").alias("outer_no", "ix"))
    own = outer.select(*[c for c in txs.columns if c != "instructions"], F.col("outer_no").alias("log_index"), "ix.program", "ix.data", "ix.accounts")
    inner = outer.select("*", F.posexplode("ix.inner").alias("inner_no", "sub"))
    return own.unionByName(inner.select(*[c for c in txs.columns if c != "instructions"], (F.col("outer_no") * 1000 + F.col("inner_no")).alias("log_index"), "sub.program", "sub.data", "sub.accounts"))


def _named(tag: Column, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(tag == k, F.lit(v)).otherwise(out)
    return out


def decode_token(ix: DataFrame) -> DataFrame:
    """Token and system instructions to kind, amount, decimals; a system transfer moves the native coin."""
    d = F.col("data")
    tag = byte_at(d, 0)
    native = (F.col("program") == SYSTEM) & (little(d, 0, 4) == 2)
    kind = F.when(F.col("program") == TOKEN, _named(tag, TOKEN_TAGS)).when(native, F.lit("transfer"))
    amount = F.when(F.col("program") == TOKEN, little(d, 1, 8)).when(native, little(d, 4, 8))
    decimals = F.when((F.col("program") == TOKEN) & tag.isin(12, 14, 15), byte_at(d, 9))
    return ix.withColumn("kind", kind).withColumn("amount", amount).withColumn("decimals", decimals).withColumn("native", native).where("kind IS NOT NULL")


def decode_token_2022(ix: DataFrame) -> DataFrame:
    """Fee withdrawals and authority changes; other authorities than that of withheld fees do not count."""
    d = F.col("data")
    kind = _named(byte_at(d, 0), TOKEN_2022_TAGS)
    return ix.where(F.col("program") == TOKEN_2022).withColumn("kind", kind).where((F.col("kind") != "set_authority") | (byte_at(d, 1) == WITHDRAW_AUTHORITY))


def decode_pool(ix: DataFrame) -> DataFrame:
    """Pool instructions of both program versions to kind and two amounts."""
    d = F.col("data")
    v4 = F.col("program") == "raydium_v4"
    kind = F.when(v4, _named(byte_at(d, 0), POOL_TAGS))
    for method, name in CPMM_METHODS.items():
        kind = F.when(~v4 & (F.substring(d, 1, 16) == discriminator(method)), F.lit(name)).otherwise(kind)
    at = F.when(v4, F.lit(1)).otherwise(F.lit(8))
    return ix.where(F.col("program").isin("raydium_v4", "raydium_cpmm")).withColumn("kind", kind).withColumn("amount0", little(d, at, 8)).withColumn("amount1", little(d, at + 8, 8)).where("kind IS NOT NULL")


def infer_swaps(transfers: DataFrame, dex: DataFrame, swapped: DataFrame | None = None) -> DataFrame:
    """Swaps of transactions that touch an account of `dex` (address, dex) and have no decoded swap in `swapped` (chain, tx_hash):
    chain, tx_hash, pool, dex, sender, token_in, token_out, amount_in, amount_out.

    Read from what the transfers (chain, tx_hash, log_index, token, from_address, to_address, amount) leave: an account that gave of one
    token and got of another has swapped the token that it gave most of for the one that it got most of. Of several such accounts
    the one that moved first counts, and accounts of the exchange itself do not.

    Rows meet by transaction once, those of `swapped` as marks among the transfers, and are sorted once by account and token: nets are
    windows, and what follows takes least values in that order, so a task holds one sort, which can spill, and no table of its groups."""
    tx = ["chain", "tx_hash"]
    rows = transfers.select(*tx, "log_index", "token", "from_address", "to_address", "amount", F.lit(False).alias("decoded"))
    if swapped is not None:  # as in a join, nulls mark nothing
        rows = rows.unionByName(swapped.select(*tx, F.lit(True).alias("decoded")).dropna(), allowMissingColumns=True)
    move = lambda account, sign: F.struct(F.col(account).alias("account"), (F.lit(sign) * F.col("amount")).alias("amount"))
    sides = F.when(F.col("decoded"), F.array(move("from_address", -1))).otherwise(F.array(move("from_address", -1), move("to_address", 1)))
    moves = rows.repartition(*tx).select(*tx, "log_index", "token", "decoded", F.inline(sides))
    own = Window.partitionBy(*tx, "account", "token")
    net = moves.select(*tx, "account", "token", "decoded", F.sum("amount").over(own).alias("net"), F.min("log_index").over(own).alias("first"))
    side = lambda sign: F.min(F.when(F.col("net") * sign > 0, F.struct((-sign * F.col("net")).alias("size"), "first", "token")))
    accounts = net.groupBy(*tx, "account").agg(F.max("decoded").alias("decoded"), F.min("first").alias("first"), side(-1).alias("gave"), side(1).alias("got"))
    accounts = accounts.join(dex.select(F.col("address").alias("account"), "dex"), "account", "left")
    trader = F.min(F.when(F.col("dex").isNull() & F.col("gave").isNotNull() & F.col("got").isNotNull(), F.struct("first", "account", "gave", "got"))).alias("t")
    pool = F.min(F.when(F.col("dex").isNotNull(), F.struct("first", "account", "dex"))).alias("p")
    both = accounts.groupBy(*tx).agg(trader, pool, F.max("decoded").alias("decoded")).where("NOT decoded AND t IS NOT NULL AND p IS NOT NULL")
    return both.select(*tx, F.col("p.account").alias("pool"), "p.dex", F.col("t.account").alias("sender"), F.col("t.gave.token").alias("token_in"), F.col("t.got.token").alias("token_out"), (-F.col("t.gave.size")).alias("amount_in"), (-F.col("t.got.size")).alias("amount_out"))


#: Byte offsets of the v4 pool account.
V4_STATE = {"status": 0, "nonce": 8, "coin_decimals": 32, "pc_decimals": 40}


def decode_pool_state(accounts: DataFrame, data: str = "data") -> DataFrame:
    return accounts.select("*", *[little(F.col(data), at, 8).alias(name) for name, at in V4_STATE.items()])


def decode_extensions(mints: DataFrame, data: str = "data") -> DataFrame:
    """Extension types of each mint account, by folding over its type-length-value stream."""
    start = F.expr("named_struct('pos', 0, 'found', cast(array() as array<int>))")
    # data and heads are variables of lambdas, as F.col(data) would be worked out again wherever it is named
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def walk(tlv: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            head = lambda at: F.conv(F.concat(F.substr(tlv, at + 2, F.lit(2)), F.substr(tlv, at, F.lit(2))), 16, 10).cast("int")
            end = 2 * (acc["pos"] + 4)

            def more(h: Column) -> Column:
                goes = ((h["kind"] != 0) | (h["size"] != 0)) & (end + 2 * h["size"] <= F.length(tlv))
                return F.when(goes, F.struct((acc["pos"] + 4 + h["size"]).alias("pos"), F.concat(acc["found"], F.array(h["kind"])).alias("found"))).otherwise(acc)

            # a head is four bytes; without room for it nothing is read
            return F.when(end <= F.length(tlv), let(F.struct(head(end - 7).alias("kind"), head(end - 3).alias("size")), more)).otherwise(acc)

        # an extension takes four bytes at least
        steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.length(tlv) / 8).cast("int")))
        return F.aggregate(steps, start, step)["found"]

    # a generator of one row, so that the columns taken from it do not each walk again
    found = mints.select("*", F.explode(F.transform(F.array(F.substr(F.col(data), F.lit(2 * TLV_OFFSET + 1))), walk)).alias("__found"))
    return found.select("*", *[F.array_contains("__found", k).alias(name) for k, name in EXTENSIONS.items()]).drop("__found")


#: What a graduation leaves in the log.
GRADUATION_MARKS = {"pump_fun": ("Instruction: Migrate", "Instruction: CreatePool")}


def graduations(logs: DataFrame, lines: str = "lines") -> DataFrame:
    marks = GRADUATION_MARKS["pump_fun"]
    return logs.where(F.exists(lines, lambda line: line.contains(marks[0]) | line.contains(marks[1]))).withColumn("launchpad", F.lit("pump_fun"))
