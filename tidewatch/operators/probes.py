"""One-shot probes (C) and registry enrichment (E)."""

from __future__ import annotations

from ..functions.exprs import clamp
from ..plans.dialect import Dialect
from ..plans.views import SWAPS_AS_OF, TRANSFERS_AS_OF

T = TRANSFERS_AS_OF

FLOWS = "(SELECT token, address, CAST(sum(amount) AS BIGINT) AS net FROM (SELECT token, to_address AS address, amount FROM {transfers} UNION ALL SELECT token, from_address, -amount FROM {transfers}) AS f GROUP BY token, address)"


def real_holders(d: Dialect) -> str:
    return f"""
    WITH n AS (SELECT f.token, f.net, row_number() OVER (PARTITION BY f.token ORDER BY f.net, f.address) AS up, row_number() OVER (PARTITION BY f.token ORDER BY f.net DESC, f.address DESC) AS down FROM {FLOWS} AS f
      WHERE f.net > 0 AND NOT EXISTS (SELECT 1 FROM {{classes}} c WHERE c.address = f.address AND c.kind IN ('dex_pool', 'cex_hot_wallet')))
    SELECT token, count(*) AS holders, round({clamp("2 * CAST(sum(up * net) AS DOUBLE) / (count(*) * CAST(sum(net) AS DOUBLE)) - (count(*) + CAST(1 AS DOUBLE)) / count(*)", 0, 1)}, 6) AS gini, round(sum(CASE WHEN down <= 10 THEN net ELSE 0 END) / CAST(sum(net) AS DOUBLE), 6) AS top10 FROM n GROUP BY token HAVING count(*) >= 10"""


def counted(d: Dialect) -> str:
    """token, probe, confidence of c03_dormant and c05_block_burst from one count of the transfers by token and block (for Spark)."""
    return """
    SELECT token, stack(2, 'd03_dormant_token', dormant, 'd11_synchronized', burst) AS (probe, confidence) FROM
      (SELECT coalesce(k.token, x.token) AS token, CAST(CASE WHEN age_there THEN CASE WHEN coalesce(n, 0) >= 25 THEN 0 WHEN age_days > 30 THEN 0.75 WHEN age_days > 7 THEN 0.55 ELSE 0.25 END END AS DOUBLE) AS dormant,
        CAST(CASE WHEN peak IS NOT NULL THEN CASE WHEN peak / mean >= 15 THEN 0.65 WHEN peak / mean >= 8 THEN 0.50 WHEN peak / mean >= 4 THEN 0.25 ELSE 0.05 END END AS DOUBLE) AS burst
       FROM (SELECT token, age_days, TRUE AS age_there FROM {tokens}) AS k FULL JOIN (SELECT token, sum(n) AS n, max(n) AS peak, avg(CAST(n AS DOUBLE)) AS mean FROM (SELECT token, block_height, count(*) AS n FROM {transfers} GROUP BY token, block_height) AS b GROUP BY token) AS x ON k.token = x.token) AS y"""


TEXTS = {
    "c01_net_flows": lambda d: f"SELECT token, address, net FROM {FLOWS} AS f WHERE net > 0",
    "c02_real_holders": real_holders,
    "c03_dormant": lambda d: "SELECT k.token, CAST(CASE WHEN coalesce(n, 0) >= 25 THEN 0 WHEN age_days > 30 THEN 0.75 WHEN age_days > 7 THEN 0.55 ELSE 0.25 END AS DOUBLE) AS confidence FROM {tokens} k LEFT JOIN (SELECT token, count(*) AS n FROM {transfers} GROUP BY token) AS x ON k.token = x.token",
    "c04_ping_pong": lambda d: """
      WITH p AS (SELECT token, src, dst, count(*) AS n FROM {trade_edges} GROUP BY token, src, dst), q AS (SELECT a.token, count(*) AS pairs, CAST(sum(a.n + b.n) AS BIGINT) AS trips FROM p a JOIN p b ON a.token = b.token AND a.src = b.dst AND a.dst = b.src AND a.src < a.dst GROUP BY a.token)
      SELECT token, pairs, trips, CAST(CASE WHEN share >= 0.07 THEN 0.70 WHEN share >= 0.03 THEN 0.55 WHEN share >= 0.01 THEN 0.30 ELSE 0.05 END AS DOUBLE) AS confidence FROM (SELECT q.*, q.trips / CAST(t.n AS DOUBLE) AS share FROM q JOIN (SELECT token, sum(n) AS n FROM p GROUP BY token) AS t ON q.token = t.token) AS x""",
    "c05_block_burst": lambda d: "SELECT token, peak, round(peak / mean, 6) AS burst, CAST(CASE WHEN peak / mean >= 15 THEN 0.65 WHEN peak / mean >= 8 THEN 0.50 WHEN peak / mean >= 4 THEN 0.25 ELSE 0.05 END AS DOUBLE) AS confidence FROM (SELECT token, max(n) AS peak, avg(CAST(n AS DOUBLE)) AS mean FROM (SELECT token, block_height, count(*) AS n FROM {transfers} GROUP BY token, block_height) AS b GROUP BY token) AS x",
    "c06_swap_spike": lambda d: f"""
      SELECT token, recent, earlier, CAST(CASE WHEN ratio >= 5 THEN 0.70 WHEN ratio >= 2 THEN 0.50 WHEN ratio >= 0.3 THEN 0.10 ELSE 0 END AS DOUBLE) AS confidence FROM (SELECT *, (recent / CAST(60 AS DOUBLE)) / (earlier / CAST(1440 AS DOUBLE)) AS ratio FROM
      (SELECT token, count(*) FILTER (WHERE t >= {SWAPS_AS_OF - 3600}) AS recent, count(*) FILTER (WHERE t < {SWAPS_AS_OF - 3600}) AS earlier FROM {{swaps}} WHERE t >= {SWAPS_AS_OF - 25 * 3600} AND t < {SWAPS_AS_OF} GROUP BY token) AS x WHERE earlier >= 20) AS y""",
    "c07_throwaway_holders": lambda d, nonce=12: f"SELECT b.token, count(*) AS throwaway, CAST(CASE WHEN count(*) >= 7 THEN 0.65 WHEN count(*) >= 4 THEN 0.45 WHEN count(*) >= 2 THEN 0.20 ELSE 0 END AS DOUBLE) AS confidence FROM {{balances}} b JOIN (SELECT to_address, count(DISTINCT tx_hash) AS nonce FROM {{transfers}} GROUP BY to_address) AS n ON b.holder = n.to_address WHERE n.nonce <= {nonce} GROUP BY b.token",
    "c08_contract_age": lambda d: "SELECT token, round(CAST(CASE WHEN age_days < 7 THEN 1 - age_days / CAST(7 AS DOUBLE) WHEN age_days < 30 THEN 0.30 ELSE 0 END AS DOUBLE), 6) AS confidence FROM {tokens}",
    "c09_discovery": lambda d, newest=500: f"SELECT count(*) AS pools, count(*) FILTER (WHERE lp_deployer = 0) AS renounced, count(*) FILTER (WHERE lp_deployer * 2 >= lp_total) AS owned FROM (SELECT * FROM {{launches}} WHERE t <= {T} ORDER BY t DESC, token, deployer LIMIT {newest}) AS x",
    "c10_symbol_search": lambda d: f"SELECT chain, token, liquidity_cents, pools FROM (SELECT e.chain, lower(e.token) AS token, max(p.liquidity_cents) AS liquidity_cents, {d.join_set('p.pool')} AS pools FROM {{lp_events}} e JOIN {{pools}} p ON e.pool = p.pool WHERE p.liquidity_cents >= 800000 GROUP BY e.chain, lower(e.token)) AS x",
    "c11_sync_buckets": lambda d: "SELECT token, count(*) AS buckets, max(n) AS largest, CAST(least(0.45 + 0.05 * (count(*) - 1), 0.80) AS DOUBLE) AS confidence FROM (SELECT token, CAST(floor(t / CAST(1800 AS DOUBLE)) AS BIGINT) AS bucket, count(DISTINCT sender) AS n FROM {swaps} WHERE side = 'buy' GROUP BY token, CAST(floor(t / CAST(1800 AS DOUBLE)) AS BIGINT)) AS x WHERE n >= 3 GROUP BY token",
    "c12_ownership": lambda d: "SELECT mint, new_authority, t FROM (SELECT mint, new_authority, t, row_number() OVER (PARTITION BY mint ORDER BY t DESC, tx_hash DESC, log_index DESC, new_authority DESC) AS nth FROM {instructions} WHERE kind = 'set_authority') AS x WHERE nth = 1",
    "e01_classified": lambda d: """
      SELECT holder, kind, CAST(CASE kind WHEN 'burn_address' THEN 1.0 WHEN 'cex_hot_wallet' THEN 0.85 WHEN 'dex_pool' THEN 0.95 WHEN 'vesting_contract' THEN 0.90 ELSE 0.5 END AS DOUBLE) AS confidence, CASE kind WHEN 'burn_address' THEN -1 WHEN 'dex_pool' THEN -1 WHEN 'vesting_contract' THEN 168 WHEN 'cex_hot_wallet' THEN 720 ELSE 24 END AS ttl_hours FROM
      (SELECT h.holder, coalesce(CASE WHEN c.kind = 'burn_address' THEN c.kind END, CASE WHEN c.kind = 'cex_hot_wallet' THEN c.kind END, CASE WHEN c.kind = 'dex_pool' THEN c.kind END, CASE WHEN c.age_days > 80 THEN 'vesting_contract' END, 'liquid') AS kind FROM (SELECT DISTINCT holder FROM {balances}) AS h LEFT JOIN {classes} c ON h.holder = c.address) AS x""",
    "e02_lp_locks": lambda d: "SELECT e.pool, CAST(sum(CASE WHEN event_kind = 'burn' THEN lp_tokens ELSE 0 END) AS BIGINT) AS burned, round(100 * sum(CASE WHEN event_kind = 'burn' THEN lp_tokens ELSE 0 END) / CAST(sum(lp_tokens) AS DOUBLE), 6) AS burned_pct, " + d.join_set("actor", "event_kind = 'mint' AND lp_tokens >= 48") + " AS lockers FROM {lp_events} e GROUP BY e.pool",
    "e03_enriched": lambda d: "SELECT k.chain, k.token, coalesce(b.holders, 0) AS holders, coalesce(b.held, 0) AS held, coalesce(m.markets, 0) AS markets, coalesce(m.liquidity_cents, 0) AS liquidity_cents FROM {tokens} k LEFT JOIN (SELECT token, count(*) AS holders, CAST(sum(balance) AS BIGINT) AS held FROM {balances} GROUP BY token) AS b ON k.token = b.token LEFT JOIN (SELECT token, count(*) AS markets, CAST(sum(liquidity_cents) AS BIGINT) AS liquidity_cents FROM (SELECT DISTINCT e.token, p.pool, p.liquidity_cents FROM {lp_events} e JOIN {pools} p ON e.pool = p.pool) AS d GROUP BY token) AS m ON k.token = m.token",
    "e04_snapshots": lambda d: f"SELECT chain, token, count(*) AS holders, CAST(sum(balance) AS BIGINT) AS balance, {T} AS snapshot_t FROM {{balances}} GROUP BY chain, token",
    "e05_market_cap": lambda d: "SELECT token, round(supply / power(CAST(10 AS DOUBLE), decimals) * rugcheck, 6) AS cap FROM {tokens}",
}

