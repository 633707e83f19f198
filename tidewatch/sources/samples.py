"""Raw chain payloads made from the swaps, so that the decoders can be held against what was encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import Dialect, Tables
from . import evm, solana

#: One log in len(KINDS) of each kind.
KINDS = list(evm.EVENTS)


def _address(x: str) -> F.Column:
    return F.concat(F.md5(F.col(x)), F.substring(F.md5(F.concat(F.lit("a"), F.col(x))), 1, 8))


def _word(c) -> F.Column:
    """64 hex digits of a long, in two's complement."""
    return F.when(c < 0, F.concat(F.lit("f" * 48), F.lower(F.hex(c)))).otherwise(F.lpad(F.lower(F.hex(c)), 64, "0"))


def _types(kind: str) -> dict[str, str]:
    return dict(evm.EVENTS[kind][1].values())


def evm_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log per swap: topics are sender, token and pool; data words are the pool, minus cents, or cents plus their number."""
    swaps = Tables(spark, sf_dir)("swaps")
    kind = (F.col("seq") % len(KINDS)).cast("int")
    topic = F.element_at(F.array(*[F.lit(evm.selector(evm.EVENTS[p][0])) for p in KINDS]), kind + 1)
    pad = lambda a: F.concat(F.lit("0x"), F.lit("0" * 24), a)
    words = []
    for k in range(5):
        of = [_types(p).get(f"d{k}", "uint") for p in KINDS]
        addresses, signed = ([i for i, t in enumerate(of) if t == x] for x in ("address", "int"))
        words.append(F.when(kind.isin(addresses), F.concat(F.lit("0" * 24), _address("pool"))).when(kind.isin(signed), _word(-F.col("cents"))).otherwise(_word(F.col("cents") + k)))
    return swaps.select("seq", F.array(topic, pad(_address("sender")), pad(_address("token")), pad(_address("pool"))).alias("topics"), F.concat(F.lit("0x"), *words).alias("data"))


def decoded_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evm.decode_logs(evm_logs(spark, sf_dir))
    amounts = [F.coalesce(F.col(c).cast("long"), F.lit(-(2**62))).alias(c) for c in ("amount", "amount1", "amount2", "amount3")]
    return got.select("seq", "event", *[F.coalesce(c, F.lit("")).alias(c) for c in ("from_address", "to_address", "pool")], *amounts)


def decoded_oracle(d: Dialect) -> str:
    address = lambda x: f"concat('0x', md5({x}), substring(md5(concat('a', {x})), 1, 8))"
    topics = {"t1": "sender", "t2": "token", "t3": "pool"}

    def field(name: str, none: str) -> str:
        whens = []
        for k, kind in enumerate(KINDS):
            place, type_ = evm.EVENTS[kind][1].get(name, ("", ""))
            if place:
                whens.append(f"WHEN {k} THEN " + (address(topics.get(place, "pool")) if type_ == "address" else "-cents" if type_ == "int" else f"cents + {place[1:]}"))
        return f"CASE seq % {len(KINDS)} {' '.join(whens)} ELSE {none} END"

    named = " ".join(f"WHEN {k} THEN '{kind}'" for k, kind in enumerate(KINDS))
    columns = [field(f, "''") + f" AS {n}" for f, n in (("from", "from_address"), ("to", "to_address"), ("pool", "pool"))] + [f"CAST({field(f, str(-(2**62)))} AS BIGINT) AS {f}" for f in ("amount", "amount1", "amount2", "amount3")]
    return f"SELECT seq, CASE seq % {len(KINDS)} {named} END AS event, {', '.join(columns)} FROM {{swaps}}"


def _tail(x) -> F.Column:
    """A length word and the bytes of a string, padded to whole words."""
    raw = F.lower(F.hex(F.encode(x, "UTF-8")))
    return F.concat(_word((F.length(raw) / 2).cast("long")), F.rpad(raw, (F.ceil(F.length(raw) / 64) * 64).cast("int"), F.lit("0")))


ABI = ["address", "string", "uint256", "bytes", "bool", "bytes4", "int256"]


def decoded_abi(spark: SparkSession, sf_dir: str) -> DataFrame:
    swaps = Tables(spark, sf_dir)("swaps")
    one = _tail(F.concat(F.lit("é"), F.col("token")))
    two = F.lit(32 * len(ABI)) + F.length(one) / 2
    flag = (F.col("seq") % 2).cast("long")
    heads = [F.concat(F.lit("0" * 24), _address("pool")), _word(F.lit(32 * len(ABI))), _word(F.col("cents")), _word(two.cast("long")), _word(flag), F.rpad(F.substring(F.md5("sender"), 1, 8), 64, "0"), _word(-F.col("cents"))]
    data = swaps.select("seq", F.concat(F.lit("0x"), *heads, one, _tail(F.col("sender"))).alias("data"))
    names = ["pool", "name", "amount", "payload", "flag", "tag", "change"]
    got = data.select("seq", *[c.alias(n) for n, c in zip(names, evm.decode_abi(F.col("data"), ABI), strict=True)])
    return got.withColumn("amount", F.col("amount").cast("long")).withColumn("change", F.col("change").cast("long"))


def abi_oracle(d: Dialect) -> str:
    return "SELECT seq, concat('0x', md5(pool), substring(md5(concat('a', pool)), 1, 8)) AS pool, concat('é', token) AS name, cents AS amount, concat('0x', lower(hex(sender))) AS payload, seq % 2 = 1 AS flag, concat('0x', substring(md5(sender), 1, 8)) AS tag, -cents AS change FROM {swaps}"


def initialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evm.initialize_events(evm.decode_logs(evm_logs(spark, sf_dir))).groupBy("event_kind", "event").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pool").alias("pools"))


def initialized_oracle(d: Dialect) -> str:
    return " UNION ALL ".join(f"SELECT 'initialize' AS event_kind, '{kind}' AS event, count(*) AS n, count(DISTINCT pool) AS pools FROM {{swaps}} WHERE seq % {len(KINDS)} = {KINDS.index(kind)} HAVING count(*) > 0" for kind in evm.INITIALIZES)


def _little(c, size: int) -> F.Column:
    big = F.lpad(F.lower(F.hex(c)), 2 * size, "0")
    return F.concat(*[F.substring(big, 2 * k - 1, 2) for k in range(size, 0, -1)])


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction per swap: a token transfer with an inner system transfer, and a pool swap."""
    swaps = Tables(spark, sf_dir)("swaps")
    none = F.expr("cast(array() as array<struct<program:string,data:string,accounts:array<string>>>)")
    accounts = F.array("sender", "pool").alias("accounts")
    sub = F.struct(F.lit("system").alias("program"), F.concat(_little(F.lit(2), 4), _little(F.col("cents"), 8)).alias("data"), accounts)
    ix = lambda program, data, inner: F.struct(F.lit(program).alias("program"), data.alias("data"), accounts, inner.alias("inner"))
    token = F.concat(F.lit("0c"), _little(F.col("cents"), 8), F.lit("06"))
    v4 = F.concat(F.lit("09"), _little(F.col("cents"), 8), _little(F.col("cents") + 1, 8))
    cpmm = F.concat(F.lit(solana.discriminator("swap_base_input")), _little(F.col("cents"), 8), _little(F.col("cents") + 1, 8))
    return swaps.select("seq", F.array(ix("token", token, F.array(sub)), ix("raydium_v4", v4, none), ix("raydium_cpmm", cpmm, none), ix("token2022", F.lit("1b00"), none)).alias("instructions"))


def decoded_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = solana.decode_token(solana.flatten_instructions(instructions(spark, sf_dir)))
    return got.select("seq", "log_index", "kind", F.col("amount").cast("long").alias("amount"), F.coalesce("decimals", F.lit(-1)).alias("decimals"), "native")


def transfers_oracle(d: Dialect) -> str:
    return "SELECT seq, 0 AS log_index, 'transfer' AS kind, cents AS amount, 6 AS decimals, FALSE AS native FROM {swaps} UNION ALL SELECT seq, 0, 'transfer', cents, -1, TRUE FROM {swaps}"


def both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers of one transaction per order: returned lines go back from the customer to the supplier."""
    back = F.col("flag") == "R"
    t = Tables(spark, sf_dir)("transfers")
    return t.select("chain", "tx_hash", "log_index", "token", F.when(back, F.col("to_address")).otherwise(F.col("from_address")).alias("from_address"), F.when(back, F.col("from_address")).otherwise(F.col("to_address")).alias("to_address"), "amount")


def inferred_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth transaction counts as decoded by its pool instruction; suppliers of one kind are accounts of an exchange."""
    transfers = both_ways(spark, sf_dir)
    pools = Tables(spark, sf_dir)("pools").where("dex_no = 0").select(F.col("pool").alias("address"), F.lit("orca").alias("dex"))
    return solana.infer_swaps(transfers, pools, transfers.where("CAST(substring(tx_hash, 2) AS BIGINT) % 5 = 0"))


def inferred_oracle(d: Dialect) -> str:
    dex = "SELECT pool FROM {pools} WHERE dex_no = 0"
    number = "CAST(substring(tx_hash, 2) AS BIGINT)"
    return f"""
    WITH m AS (SELECT chain, tx_hash, log_index, token, CASE WHEN flag = 'R' THEN to_address ELSE from_address END AS account, -amount AS amount FROM {{transfers}} WHERE {number} % 5 <> 0
      UNION ALL SELECT chain, tx_hash, log_index, token, CASE WHEN flag = 'R' THEN from_address ELSE to_address END, amount FROM {{transfers}} WHERE {number} % 5 <> 0),
    n AS (SELECT chain, tx_hash, account, token, CAST(sum(amount) AS BIGINT) AS net, min(log_index) AS nth FROM m GROUP BY chain, tx_hash, account, token),
    gave AS (SELECT *, row_number() OVER (PARTITION BY chain, tx_hash, account ORDER BY net, nth, token) AS r FROM n WHERE net < 0), got AS (SELECT *, row_number() OVER (PARTITION BY chain, tx_hash, account ORDER BY net DESC, nth, token) AS r FROM n WHERE net > 0),
    a AS (SELECT chain, tx_hash, account, min(nth) AS nth FROM n GROUP BY chain, tx_hash, account),
    t AS (SELECT a.chain, a.tx_hash, a.account, gave.token AS token_in, got.token AS token_out, -gave.net AS amount_in, got.net AS amount_out, row_number() OVER (PARTITION BY a.chain, a.tx_hash ORDER BY a.nth, a.account) AS r
      FROM a JOIN gave ON a.chain = gave.chain AND a.tx_hash = gave.tx_hash AND a.account = gave.account AND gave.r = 1 JOIN got ON a.chain = got.chain AND a.tx_hash = got.tx_hash AND a.account = got.account AND got.r = 1 WHERE a.account NOT IN ({dex})),
    p AS (SELECT chain, tx_hash, account, row_number() OVER (PARTITION BY chain, tx_hash ORDER BY nth, account) AS r FROM a WHERE account IN ({dex}))
    SELECT t.chain, t.tx_hash, p.account AS pool, 'orca' AS dex, t.account AS sender, token_in, token_out, amount_in, amount_out FROM t JOIN p ON t.chain = p.chain AND t.tx_hash = p.tx_hash AND p.r = 1 WHERE t.r = 1"""


def decoded_withdrawals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solana.decode_token_2022(solana.flatten_instructions(instructions(spark, sf_dir))).groupBy("kind", "log_index").agg(F.count(F.lit(1)).alias("n"))


def decoded_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = solana.decode_pool(solana.flatten_instructions(instructions(spark, sf_dir)))
    return got.select("seq", "program", "kind", F.col("amount0").cast("long").alias("amount0"), F.col("amount1").cast("long").alias("amount1"))


def mints(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the table of parts is few files, so its rows are dealt out before their accounts are made
    t = Tables(spark, sf_dir)("tokens").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "token")
    ext = lambda flag, kind, size: F.when(F.col(flag), F.concat(_little(F.lit(kind), 2), _little(F.lit(size), 2), F.lit("00" * size))).otherwise(F.lit(""))
    return t.select("token", F.concat(F.lit("00" * solana.TLV_OFFSET), ext("fee_authority", 1, 108), ext("non_transferable", 9, 0), ext("permanent_delegate", 12, 32), ext("transfer_hook", 14, 64), F.lit("0000" * 3)).alias("data"))


def decoded_mints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solana.decode_extensions(mints(spark, sf_dir)).drop("data")


def mints_oracle(d: Dialect) -> str:
    return "SELECT token, fee_authority AS transfer_fee, FALSE AS confidential_transfer, non_transferable, permanent_delegate, transfer_hook FROM {tokens}"


def pool_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Tables(spark, sf_dir)("pools")
    data = F.concat(_little(F.lit(6), 8), _little(F.col("dex_no"), 8), F.lit("00" * 16), _little(F.lit(9), 8), _little(F.col("providers"), 8), F.lit("00" * 704))
    return solana.decode_pool_state(p.select("pool", data.alias("data"))).select("pool", *[F.col(c).cast("long").alias(c) for c in solana.V4_STATE])


def graduated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)("tokens")
    logs = t.select("token", F.array(F.lit("Program log: start"), F.when(F.col("age_days") < 3, F.lit("Program log: Instruction: Migrate")).otherwise(F.lit("Program log: Instruction: Buy"))).alias("lines"))
    return solana.graduations(logs).select("token", "launchpad")


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .files import registry

    known = registry(spark, [(f"s{k}", "tier1" if k % 2 else "tier2") for k in range(20)], "address string, tier string")
    return Tables(spark, sf_dir)("transfers").join(known, F.col("from_address") == F.col("address")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "s02_evm_logs": (decoded_logs, decoded_oracle),
    "s03_initialize": (initialized, initialized_oracle),
    "s04_dynamic_abi": (decoded_abi, abi_oracle),
    "s06_solana_transfers": (decoded_transfers, transfers_oracle),
    "s06_inferred_swaps": (inferred_swaps, inferred_oracle),
    "s07_token2022": (decoded_withdrawals, lambda d: "SELECT 'withdraw_from_mint' AS kind, 3 AS log_index, count(*) AS n FROM {swaps}"),
    "s08_pool_swaps": (decoded_pools, lambda d: "SELECT seq, program, 'swap_in' AS kind, cents AS amount0, cents + 1 AS amount1 FROM {swaps} CROSS JOIN " + d.rows("('raydium_v4'), ('raydium_cpmm')", "program")),
    "s09_pool_state": (pool_states, lambda d: "SELECT pool, CAST(6 AS BIGINT) AS status, dex_no AS nonce, CAST(9 AS BIGINT) AS coin_decimals, providers AS pc_decimals FROM {pools}"),
    "s10_extensions": (decoded_mints, mints_oracle),
    "s11_graduations": (graduated, lambda d: "SELECT token, 'pump_fun' AS launchpad FROM {tokens} WHERE age_days < 3"),
    "s13_registry": (listed, lambda d: "SELECT CASE WHEN CAST(substring(from_address, 2) AS BIGINT) % 2 = 1 THEN 'tier1' ELSE 'tier2' END AS tier, count(*) AS n FROM {transfers} WHERE CAST(substring(from_address, 2) AS BIGINT) < 20 GROUP BY CASE WHEN CAST(substring(from_address, 2) AS BIGINT) % 2 = 1 THEN 'tier1' ELSE 'tier2' END"),
}
