"""Canonical chain tables, derived from the generic star schema. Money is kept in whole cents, so sums are exact."""

from __future__ import annotations

from .dialect import Dialect, view

#: The point in time of reports over swaps and over transfers (seconds since 1970).
SWAPS_AS_OF = 1_706_140_800
TRANSFERS_AS_OF = 946_684_800
DAY = 86_400


@view("swaps")
def swaps(d: Dialect) -> str:
    return f"""
    SELECT 'solana' AS chain, concat('pool', CAST(event_id % 8 AS STRING)) AS pool, concat('tok', CAST(event_id % 4 AS STRING)) AS token,
      CASE WHEN event_type IN ('purchase', 'signup') THEN 'buy' ELSE 'sell' END AS side,
      CASE WHEN event_type IN ('purchase', 'signup') THEN 'SOL' ELSE concat('tok', CAST(event_id % 4 AS STRING)) END AS token_in,
      CASE WHEN event_type IN ('purchase', 'signup') THEN concat('tok', CAST(event_id % 4 AS STRING)) ELSE 'SOL' END AS token_out,
      {d.epoch("ts")} AS t, {d.idiv(d.epoch("ts"), "60")} AS block_height, event_id AS seq, concat('tx', CAST(event_id AS STRING)) AS tx_hash,
      concat('u', CAST(user_id AS STRING)) AS sender, CAST(round(value * 100) AS BIGINT) AS cents
    FROM {{events}} WHERE event_type <> 'error'"""


@view("transfers")
def transfers(d: Dialect) -> str:
    return f"""
    SELECT CASE WHEN l_partkey % 2 = 0 THEN 'solana' ELSE 'ethereum' END AS chain, concat('t', CAST(l_partkey AS STRING)) AS token,
      concat('s', CAST(l_suppkey AS STRING)) AS from_address, concat('c', CAST(o_custkey AS STRING)) AS to_address,
      CAST(l_quantity AS BIGINT) AS amount, {d.epoch("l_shipdate")} AS t, {d.idiv(d.epoch("l_shipdate"), str(DAY))} AS block_height,
      concat('o', CAST(l_orderkey AS STRING)) AS tx_hash, l_linenumber AS log_index, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
      l_returnflag = 'A' AND l_linestatus = 'F' AS is_mint, l_returnflag = 'R' AND l_linestatus = 'F' AS is_burn, l_returnflag AS flag, l_linestatus AS status
    FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey"""


@view("graduations")
def graduations(d: Dialect) -> str:
    """When tokens left their launchpad."""
    return f"SELECT token, {SWAPS_AS_OF} - (1 + CAST(substring(token, 4) AS BIGINT)) * 72000 AS graduated_t FROM (SELECT DISTINCT token FROM {{swaps}}) AS x"


@view("lp_events")
def lp_events(d: Dialect) -> str:
    return """
    SELECT chain, from_address AS pool, to_address AS actor, CASE flag WHEN 'R' THEN 'burn' WHEN 'A' THEN 'mint' ELSE 'sync' END AS event_kind,
      t, block_height, tx_hash, log_index, amount AS lp_tokens, cents, token FROM {transfers}"""


@view("pools")
def pools(d: Dialect) -> str:
    return """
    SELECT concat('s', CAST(s_suppkey AS STRING)) AS pool, CAST(round(s_acctbal * 100) AS BIGINT) AS liquidity_cents, s_suppkey % 4 AS dex_no,
      CAST((s_suppkey * 7) % 101 AS DOUBLE) AS lp_burned_pct, CAST((s_suppkey * 13) % 60 AS DOUBLE) AS lp_locked_pct, s_suppkey % 120 AS unlock_days, 1 + s_suppkey % 3 AS providers
    FROM {supplier}"""


@view("tokens")
def tokens(d: Dialect) -> str:
    return """
    SELECT CASE WHEN p_partkey % 2 = 0 THEN 'solana' ELSE 'ethereum' END AS chain, concat('t', CAST(p_partkey AS STRING)) AS token, p_partkey,
      p_size % 3 = 0 AS freeze_authority, p_size % 13 = 0 AS non_transferable, p_size * 100 AS fee_bps, p_size % 5 = 0 AS fee_authority,
      p_size % 7 = 0 AS permanent_delegate, p_size % 11 = 0 AS transfer_hook, p_partkey % 2 = 1 AS mint_authority, p_partkey % 60 AS age_days,
      p_partkey % 17 = 0 AS jup_strict, p_partkey % 5 = 0 AS jup_verified, CAST(p_size AS DOUBLE) AS rugcheck, CAST(round(p_retailprice * 10) AS BIGINT) AS supply, 6 AS decimals
    FROM {part}"""


@view("classes")
def classes(d: Dialect) -> str:
    return """
    SELECT concat('c', CAST(c_custkey AS STRING)) AS address,
      CASE c_mktsegment WHEN 'MACHINERY' THEN 'dex_pool' WHEN 'BUILDING' THEN 'cex_hot_wallet' WHEN 'AUTOMOBILE' THEN 'burn_address' ELSE 'liquid' END AS kind,
      CAST(0.5 AS DOUBLE) + (c_custkey % 50) / CAST(100 AS DOUBLE) AS confidence, c_custkey % 90 AS age_days FROM {customer}"""


@view("balances")
def balances(d: Dialect) -> str:
    return f"""
    SELECT chain, token, to_address AS holder, CAST(sum(amount) AS BIGINT) AS balance, CAST(coalesce(sum(CASE WHEN t <= {TRANSFERS_AS_OF - 365 * DAY} THEN amount END), 0) AS BIGINT) AS prior_balance, max(block_height) AS block_height
    FROM {{transfers}} WHERE t <= {TRANSFERS_AS_OF} GROUP BY chain, token, to_address"""


@view("anomalies")
def anomalies(d: Dialect) -> str:
    return f"""
    SELECT event_id AS id, 'solana' AS chain, concat('tok', CAST(user_id AS STRING)) AS token,
      CASE event_type WHEN 'signup' THEN 'honeypot_sim_static' WHEN 'view' THEN 'rug_pull_lp_drain' WHEN 'click' THEN 'holder_concentration' WHEN 'error' THEN 'pump_dump' ELSE 'wash_trading_h1' END AS detector_id,
      least(value / 250, 1.0) AS confidence, {d.epoch("ts")} AS t, {d.json_int("props", "k")} AS k FROM {{events}}"""


@view("launches")
def launches(d: Dialect) -> str:
    return f"""
    SELECT concat('s', CAST(l_suppkey AS STRING)) AS deployer, concat('t', CAST(l_partkey AS STRING)) AS token, min({d.epoch("l_shipdate")}) AS t,
      CAST(min(round(l_extendedprice * 100)) AS BIGINT) AS liquidity_cents, CAST(sum(l_quantity) AS BIGINT) AS lp_total, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS lp_deployer
    FROM {{lineitem}} GROUP BY l_suppkey, l_partkey"""


@view("instructions")
def instructions(d: Dialect) -> str:
    return """
    SELECT chain, token AS mint, tx_hash, log_index, t, CASE flag WHEN 'A' THEN 'withdraw_withheld' WHEN 'R' THEN 'set_authority' ELSE 'harvest' END AS kind,
      from_address AS authority, to_address AS destination, amount, cents, to_address AS new_authority FROM {transfers}"""


@view("pool_volumes")
def pool_volumes(d: Dialect) -> str:
    """Dollars swapped of a mint in all its pools; swaps name tokens with another prefix."""
    return "SELECT concat('t', substring(token, 4)) AS mint, CAST(sum(cents) AS DOUBLE) / 100 AS usd FROM {swaps} GROUP BY token"


@view("funding")
def funding(d: Dialect) -> str:
    return f"""SELECT concat('c', CAST(o_custkey AS STRING)) AS wallet, min({d.epoch("o_orderdate")}) AS first_t FROM {{orders}} GROUP BY o_custkey"""


@view("permits")
def permits(d: Dialect) -> str:
    return """
    SELECT chain, token, tx_hash, from_address AS owner, to_address AS spender, amount + (amount * log_index) / 40 AS allowed, status = 'O' AS is_max FROM {transfers} WHERE flag <> 'N'"""


@view("sol_edges")
def sol_edges(d: Dialect) -> str:
    return """
    SELECT chain, from_address AS funder, to_address AS wallet, CAST(sum(amount) AS BIGINT) AS total, count(*) AS n, min(t) AS first_t, max(t) AS last_t
    FROM {transfers} WHERE NOT is_mint AND NOT is_burn AND amount >= 10 AND from_address <> to_address GROUP BY chain, from_address, to_address"""


@view("headers")
def headers(d: Dialect) -> str:
    return """
    SELECT 'ethereum' AS chain, event_id AS height, md5(concat('block', CAST(event_id AS STRING))) AS hash,
      md5(concat('block', CAST(event_id - 1 AS STRING), CASE WHEN user_id % 50 = 7 THEN 'x' ELSE '' END)) AS parent_hash FROM {events}"""


@view("shared_buckets")
def shared_buckets(d: Dialect) -> str:
    """Edges of common-funder buckets with three wallets or more, each with what is told of its bucket. An edge is the only one of its
    chain, funder and wallet, so a bucket has as many wallets as edges. Windows need sorts only, which can spill: a task holds no hash
    table of its buckets, most of which have one wallet."""
    return f"""
    WITH e AS (SELECT chain, funder, wallet, total, first_t, min(first_t) OVER (PARTITION BY chain, funder) AS start FROM {{sol_edges}}),
    b AS (SELECT chain, funder, wallet, first_t, {d.idiv("first_t - start", str(30 * DAY))} AS time_bucket, CAST(floor(ln(CAST(total AS DOUBLE)) / ln(1.2) + 1e-9) AS BIGINT) AS amount_bucket FROM e),
    g AS (SELECT chain, funder, wallet, time_bucket, amount_bucket, count(wallet) OVER w AS n, round(stddev_pop(CAST(first_t AS DOUBLE)) OVER w, 4) AS spread, min(wallet) OVER w AS first_wallet FROM b
      WINDOW w AS (PARTITION BY chain, funder, time_bucket, amount_bucket))
    SELECT * FROM g WHERE n >= 3"""


@view("clusters")
def clusters(d: Dialect) -> str:
    """Common-funder buckets with three wallets or more (see graph operators)."""
    if d.spark:
        return """
    SELECT chain, funder, time_bucket, amount_bucket, max(n) AS n, max(spread) AS spread, max(first_wallet) AS first_wallet,
      md5(concat(chain, '|', funder, '|', CAST(time_bucket AS STRING), '|', CAST(amount_bucket AS STRING))) AS cluster_id
    FROM {shared_buckets} GROUP BY chain, funder, time_bucket, amount_bucket"""
    return f"""
    WITH e AS (SELECT chain, funder, wallet, total, first_t, min(first_t) OVER (PARTITION BY chain, funder) AS start FROM {{sol_edges}}),
    b AS (SELECT chain, funder, wallet, first_t, {d.idiv("first_t - start", str(30 * DAY))} AS time_bucket, CAST(floor(ln(CAST(total AS DOUBLE)) / ln(1.2) + 1e-9) AS BIGINT) AS amount_bucket FROM e)
    SELECT chain, funder, time_bucket, amount_bucket, count(DISTINCT wallet) AS n, round(stddev_pop(CAST(first_t AS DOUBLE)), 4) AS spread, min(wallet) AS first_wallet,
      md5(concat(chain, '|', funder, '|', CAST(time_bucket AS STRING), '|', CAST(amount_bucket AS STRING))) AS cluster_id
    FROM b GROUP BY chain, funder, time_bucket, amount_bucket HAVING count(DISTINCT wallet) >= 3"""


@view("members")
def members(d: Dialect) -> str:
    if d.spark:  # every edge knows its bucket, so nothing is worked out again to be joined
        return f"""
    SELECT chain, wallet, md5(concat(chain, '|', funder, '|', CAST(time_bucket AS STRING), '|', CAST(amount_bucket AS STRING))) AS cluster_id, n AS size, funder, round(CAST(0.5 AS DOUBLE) + 0.25 * least(greatest((n - 3) / CAST(7 AS DOUBLE), 0), 1) + 0.1 * (1 - least(spread / {30 * DAY}, 1)), 6) AS confidence
    FROM {{shared_buckets}} WHERE time_bucket IS NOT NULL AND amount_bucket IS NOT NULL"""
    return f"""
    WITH e AS (SELECT chain, funder, wallet, total, first_t, min(first_t) OVER (PARTITION BY chain, funder) AS start FROM {{sol_edges}}),
    b AS (SELECT chain, funder, wallet, {d.idiv("first_t - start", str(30 * DAY))} AS time_bucket, CAST(floor(ln(CAST(total AS DOUBLE)) / ln(1.2) + 1e-9) AS BIGINT) AS amount_bucket FROM e)
    SELECT b.chain, b.wallet, c.cluster_id, c.n AS size, c.funder, round(CAST(0.5 AS DOUBLE) + 0.25 * least(greatest((c.n - 3) / CAST(7 AS DOUBLE), 0), 1) + 0.1 * (1 - least(c.spread / {30 * DAY}, 1)), 6) AS confidence
    FROM b JOIN {{clusters}} c ON b.chain = c.chain AND b.funder = c.funder AND b.time_bucket = c.time_bucket AND b.amount_bucket = c.amount_bucket"""


@view("trade_edges")
def trade_edges(d: Dialect) -> str:
    """Within a pool and five days, from who sells to who buys next: transfers of the token between wallets."""
    return f"""
    WITH x AS (SELECT pool, token, {d.idiv("t", str(5 * DAY))} AS bucket, sender, side, cents, t, lead(sender) OVER w AS next_sender, lead(side) OVER w AS next_side FROM {{swaps}} WINDOW w AS (PARTITION BY pool, {d.idiv("t", str(5 * DAY))} ORDER BY t, seq))
    SELECT token, bucket, sender AS src, next_sender AS dst, CAST(sum(cents) AS BIGINT) AS cents, min(t) AS first_t, max(t) AS last_t FROM x WHERE side = 'sell' AND next_side = 'buy' AND sender <> next_sender GROUP BY token, bucket, sender, next_sender"""


@view("scored")
def scored(d: Dialect) -> str:
    """Anomalies with canonical detector ids, severities and decay towards the report time."""
    from ..functions.exprs import decay, severity, severity_rank

    age = f"(({SWAPS_AS_OF + 6 * DAY} - t) / CAST(3600 AS DOUBLE))"
    return f"""
    SELECT id, chain, token, t, k, confidence AS raw, CASE WHEN detector_id = 'honeypot_sim_static' THEN 'honeypot_sim' WHEN detector_id LIKE 'rug_pull_lp_drain%' THEN 'rug_pull_lp_drain' WHEN detector_id LIKE 'mint_burn_anomaly%' THEN 'mint_burn_anomaly' ELSE detector_id END AS detector_id,
      confidence * CASE WHEN detector_id IN ('honeypot_sim_static', 'rug_pull_lp_drain_latent', 'holder_concentration', 'mint_burn_anomaly_static') THEN CAST(1 AS DOUBLE) ELSE CAST({decay(age, 72)} AS DOUBLE) END AS eff,
      {severity_rank("(" + severity("confidence") + ")")} AS sev FROM {{anomalies}}"""


@view("detector_scores")
def detector_scores(d: Dialect) -> str:
    return """
    SELECT chain, token, detector_id, max(eff) AS max_eff, max(raw) AS max_raw, avg(eff) AS mean_eff, max(sev) AS max_sev, CAST(sum(CASE WHEN eff >= 0.30 THEN 1 ELSE 0 END) AS BIGINT) AS fired,
      CAST(sum(CASE WHEN eff < 0.30 THEN 1 ELSE 0 END) AS BIGINT) AS inconclusive, CAST(sum(CASE WHEN sev = 0 THEN 1 ELSE 0 END) AS BIGINT) AS infos FROM {scored} GROUP BY chain, token, detector_id"""


@view("legs")
def legs(d: Dialect) -> str:
    return """
    SELECT sender AS wallet, token, 'buy' AS leg, t, seq, tx_hash, cents, 1 + seq % 5 AS qty FROM {swaps} WHERE side = 'buy'
    UNION ALL SELECT sender, token, 'sell', t, seq, tx_hash, cents, 1 + seq % 5 FROM {swaps} WHERE side = 'sell'"""


@view("trips")
def trips(d: Dialect) -> str:
    """FIFO lots by cumulated quantities. Sold quantities count only up to the inventory bought before: the running surplus of
    sales over purchases, at its highest so far, is dropped, so no sell meets a later buy. The ends of all lots cut the
    quantity axis into pieces, each of the buy and the sell that end next: one running window, linear in the legs."""
    down = "PARTITION BY wallet, token ORDER BY hi DESC"
    known = ", ".join(f"{d.last_known(x, down)} AS {x}" for x in ("buy_t", "buy_cents", "buy_qty", "sell_t", "sell_cents", "sell_qty", "sell_seq"))
    return f"""
    WITH r AS (SELECT *, sum(CASE WHEN leg = 'buy' THEN qty ELSE 0 END) OVER w AS bought, sum(CASE WHEN leg = 'sell' THEN qty ELSE 0 END) OVER w AS sold FROM {{legs}} WINDOW w AS (PARTITION BY wallet, token ORDER BY t, tx_hash, leg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    o AS (SELECT *, greatest(max(sold - bought) OVER (PARTITION BY wallet, token ORDER BY t, tx_hash, leg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS lost FROM r),
    p AS (SELECT *, coalesce(lag(lost) OVER (PARTITION BY wallet, token ORDER BY t, tx_hash, leg), 0) AS lost_before FROM o),
    e AS (SELECT wallet, token, leg, t, cents, qty, seq, CASE WHEN leg = 'buy' THEN bought ELSE sold - lost END AS hi FROM p WHERE leg = 'buy' OR sold - lost > sold - qty - lost_before),
    g AS (SELECT wallet, token, hi, {", ".join(f"max(CASE WHEN leg = '{leg}' THEN {x} END) AS {leg}_{x}" for leg, x in (("buy", "t"), ("buy", "cents"), ("buy", "qty"), ("sell", "t"), ("sell", "cents"), ("sell", "qty"), ("sell", "seq")))} FROM e GROUP BY wallet, token, hi),
    k AS (SELECT wallet, token, hi, CAST(hi - coalesce(lead(hi) OVER ({down}), 0) AS BIGINT) AS n, {known} FROM g)
    SELECT wallet, token, buy_t, sell_t, sell_seq, n AS qty, (sell_cents / CAST(sell_qty AS DOUBLE) - buy_cents / CAST(buy_qty AS DOUBLE)) * n / 100 AS pnl, sell_t - buy_t AS held FROM k WHERE buy_t IS NOT NULL AND sell_t IS NOT NULL"""


def exact_sum(x: str) -> str:
    """Sum of dollars in whole millionths: the order of rows does not matter."""
    return f"CAST(sum(CAST(round({x} * 1000000) AS BIGINT)) AS DOUBLE) / 1000000"


@view("wallet_stats")
def wallet_stats(d: Dialect) -> str:
    return f"""
    WITH a AS (SELECT wallet, count(*) AS trips, {exact_sum('pnl')} AS pnl, avg(CAST(CASE WHEN pnl > 0 THEN 1 ELSE 0 END AS DOUBLE)) AS win_rate, avg(CAST(held AS DOUBLE)) AS held FROM {{trips}} GROUP BY wallet),
    peaks AS (SELECT token, t AS peak FROM (SELECT token, t, row_number() OVER (PARTITION BY token, {d.idiv("t", str(DAY))} ORDER BY cents DESC, seq) AS nth FROM {{swaps}}) AS x WHERE nth = 1),
    e AS (SELECT l.wallet, count(DISTINCT concat(p.token, ':', CAST(p.peak AS STRING))) AS events, CAST(floor({d.median("p.peak - l.t")}) AS BIGINT) AS lead_s FROM (SELECT *, {d.idiv("t", "3600")} AS hour_no FROM {{legs}} WHERE leg = 'buy') AS l
      JOIN (SELECT token, peak, {d.idiv("peak", "3600")} - o.back AS hour_no FROM peaks CROSS JOIN {d.rows("(0), (1)", "back")} AS o) AS p ON l.token = p.token AND l.hour_no = p.hour_no AND l.t BETWEEN p.peak - 3600 AND p.peak GROUP BY l.wallet),
    r AS ({d.percent_ranked("SELECT wallet, events, lead_s FROM e", "lead_s", "timing")})
    SELECT a.wallet, trips, pnl, win_rate, held, coalesce(events, 0) AS events, lead_s, coalesce(timing, 0) AS timing FROM a LEFT JOIN r ON a.wallet = r.wallet"""


@view("smart_wallets")
def scaled_smart_wallets(d: Dialect) -> str:
    return smart_wallets(d, pnl1=500, events1=2, timing=0.6, pnl2=300, events2=4)


def smart_wallets(d: Dialect, pnl1: float = 10_000, win: float = 0.55, events1: int = 3, timing: float = 0.90, pnl2: float = 1_000, events2: int = 2) -> str:
    """Tiers of wallets with ten round trips or more; the defaults hold for live chains."""
    tier = f"CASE WHEN trips < 10 THEN 0 WHEN pnl >= {pnl1} AND win_rate >= {win} AND events >= {events1} AND timing >= {timing} THEN 1 WHEN pnl >= {pnl2} OR events >= {events2} THEN 2 WHEN pnl > 0 THEN 3 ELSE 0 END"
    return f"""
    SELECT wallet, tier, trips, pnl, win_rate, events, least(CASE tier WHEN 1 THEN CAST(0.65 AS DOUBLE) WHEN 2 THEN CAST(0.50 AS DOUBLE) ELSE CAST(0.35 AS DOUBLE) END + CASE WHEN events > 0 THEN 0.10 ELSE 0 END + least(0.03 * greatest(events - 1, 0), 0.10)
      + CASE WHEN held BETWEEN 300 AND 86400 THEN 0.05 ELSE 0 END + CASE WHEN pnl > 1 THEN least(greatest(0.02 * log10(pnl) - 0.02, 0), 0.05) ELSE 0 END, 0.90) AS confidence
    FROM (SELECT *, {tier} AS tier FROM {{wallet_stats}}) AS x WHERE tier > 0"""
