"""Joins (J), aggregates (A), windows (WN), ordering (L) and set operations (U) over the chain tables."""

from __future__ import annotations

from ..plans.dialect import Dialect
from ..plans.views import DAY, SWAPS_AS_OF, TRANSFERS_AS_OF

S, T = SWAPS_AS_OF, TRANSFERS_AS_OF

TEXTS = {
    # joins
    "j02_liquid_left_join": lambda d: "SELECT b.chain, b.token, count(*) AS holders, CAST(sum(CASE WHEN c.kind IS NULL OR c.kind = 'liquid' THEN 1 ELSE 0 END) AS BIGINT) AS liquid FROM {balances} b LEFT JOIN {classes} c ON b.holder = c.address GROUP BY b.chain, b.token",
    "j03_first_funding": lambda d: "SELECT r.mint, r.new_authority, r.t, f.first_t FROM (SELECT mint, new_authority, t FROM {instructions} WHERE kind = 'set_authority') AS r LEFT JOIN {funding} f ON r.new_authority = f.wallet",
    "j04_totals_join": lambda d: "SELECT a.token, a.n, round(a.n / CAST(b.n AS DOUBLE), 6) AS share FROM (SELECT token, count(*) AS n FROM {swaps} GROUP BY token) AS a CROSS JOIN (SELECT count(*) AS n FROM {swaps}) AS b",
    "j05_four_aggregates": lambda d: f"""
      SELECT * FROM (SELECT token, count(CASE WHEN t >= {S - 6 * 3600} AND t < {S} THEN 1 END) AS n_hour, count(CASE WHEN t >= {S - DAY} AND t < {S} THEN 1 END) AS n_day, count(CASE WHEN t >= {S - 7 * DAY} AND t < {S} THEN 1 END) AS n_week, count(*) AS n_all
      FROM {{swaps}} GROUP BY token) AS x WHERE n_hour > 0""",
    "j06_nearest_snapshot": lambda d: f"""
      SELECT token, t, n FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY abs(t - {T - 365 * DAY}), t) AS nth FROM (SELECT token, t, count(*) AS n FROM {{transfers}} WHERE t BETWEEN {T - 395 * DAY} AND {T - 335 * DAY} GROUP BY token, t) AS s) AS x WHERE nth = 1""",
    "j07_anomaly_history": lambda d: "SELECT l.deployer, count(*) AS launches, count(DISTINCT l.token) FILTER (WHERE b.n > 10) AS flagged FROM {launches} l LEFT JOIN (SELECT token, count(*) AS n FROM {transfers} WHERE is_burn GROUP BY token) AS b ON l.token = b.token GROUP BY l.deployer",
    "j08_same_transaction": lambda d: "SELECT f.token, f.tx_hash, f.amount, p.allowed, p.is_max FROM {transfers} f JOIN {permits} p ON f.chain = p.chain AND f.token = p.token AND f.tx_hash = p.tx_hash AND f.from_address = p.owner AND f.to_address = p.spender",
    "j10_semi_joins": lambda d: "SELECT f.token, count(*) AS n FROM {transfers} f WHERE EXISTS (SELECT 1 FROM {classes} c WHERE c.address = f.to_address AND c.kind = 'burn_address') GROUP BY f.token",
    "j11_anti_joins": lambda d: "SELECT f.token, count(*) AS n FROM {transfers} f WHERE NOT EXISTS (SELECT 1 FROM {classes} c WHERE c.address = f.to_address AND c.kind IN ('cex_hot_wallet', 'dex_pool', 'burn_address')) GROUP BY f.token",
    "j12_cluster_lookup": lambda d: "SELECT chain, wallet, cluster_id, confidence FROM (SELECT chain, wallet, cluster_id, confidence, row_number() OVER (PARTITION BY chain, wallet ORDER BY confidence DESC, cluster_id) AS nth FROM {members}) AS x WHERE nth = 1",
    "j13_buys_before_peak": lambda d: f"""
      WITH peaks AS (SELECT token, t AS peak FROM (SELECT token, t, row_number() OVER (PARTITION BY token, {d.idiv("t", str(DAY))} ORDER BY cents DESC, seq) AS nth FROM {{swaps}}) AS x WHERE nth = 1)
      SELECT s.sender, count(DISTINCT concat(p.token, ':', CAST(p.peak AS STRING))) AS events, CAST(floor({d.median("p.peak - s.t")}) AS BIGINT) AS median_lead FROM (SELECT *, {d.idiv("t", "3600")} AS hour_no FROM {{swaps}} WHERE side = 'buy') AS s
      JOIN (SELECT token, peak, {d.idiv("peak", "3600")} - o.back AS hour_no FROM peaks CROSS JOIN {d.rows("(0), (1)", "back")} AS o) AS p ON s.token = p.token AND s.hour_no = p.hour_no AND s.t BETWEEN p.peak - 3600 AND p.peak GROUP BY s.sender""",
    "j14_neighbours": lambda d: "SELECT chain, funder, wallet, total FROM (SELECT chain, funder, wallet, total, row_number() OVER (PARTITION BY chain, funder ORDER BY last_t DESC, wallet) AS nth FROM {sol_edges}) AS x WHERE nth <= 5",
    # aggregates
    "a01_having": lambda d: "SELECT pool, actor, count(*) AS n, CAST(sum(lp_tokens) AS BIGINT) AS lp FROM {lp_events} GROUP BY pool, actor HAVING count(*) >= 3 AND sum(lp_tokens) > 60",
    "a02_statistics": lambda d: "SELECT token, round(avg(CAST(cents AS DOUBLE)), 4) AS mean, round(stddev_pop(CAST(cents AS DOUBLE)), 4) AS std, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n, min(cents) AS low, max(cents) AS high FROM {swaps} GROUP BY token",
    "a03_two_levels": lambda d: f"SELECT token, round(avg(volume), 4) AS mean_volume, round(stddev_pop(volume), 4) AS std_volume, count(*) AS days FROM (SELECT token, {d.idiv('t', str(DAY))} AS day_no, CAST(sum(cents) AS DOUBLE) AS volume FROM {{swaps}} GROUP BY token, {d.idiv('t', str(DAY))}) AS x GROUP BY token",
    "a04_distinct_filter": lambda d: "SELECT pool, count(DISTINCT sender) FILTER (WHERE side = 'buy') AS buyers, count(DISTINCT sender) AS wallets FROM {swaps} GROUP BY pool",
    "a05_mode": lambda d: f"SELECT token, {d.mode('amount')} AS usual FROM {{transfers}} GROUP BY token",
    "a06_first_last": lambda d: "SELECT token, max(CASE WHEN up = 1 THEN cents END) AS first_cents, max(CASE WHEN down = 1 THEN cents END) AS last_cents FROM (SELECT token, cents, row_number() OVER (PARTITION BY token ORDER BY t, block_height, seq) AS up, row_number() OVER (PARTITION BY token ORDER BY t DESC, block_height DESC, seq DESC) AS down FROM {swaps}) AS x GROUP BY token",
    "a07_distinct_on": lambda d: "SELECT sender, pool, tx_hash FROM (SELECT sender, pool, tx_hash, row_number() OVER (PARTITION BY sender, pool ORDER BY t DESC, seq DESC) AS nth FROM {swaps}) AS x WHERE nth = 1",
    "a08_median": lambda d: f"SELECT token, CAST(floor({d.median('cents')}) AS BIGINT) AS median_cents FROM {{swaps}} GROUP BY token",
    "a09_histogram": lambda d: f"SELECT token, hour_no, n, round(CASE WHEN std > 0 THEN (n - mean) / std ELSE 0 END, 4) AS z FROM (SELECT *, avg(CAST(n AS DOUBLE)) OVER (PARTITION BY token) AS mean, stddev_pop(CAST(n AS DOUBLE)) OVER (PARTITION BY token) AS std FROM (SELECT token, {d.idiv('t', '3600')} AS hour_no, count(*) AS n FROM {{swaps}} GROUP BY token, {d.idiv('t', '3600')}) AS h) AS z",
    "a10_breakdown": lambda d: "SELECT kind, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM {classes} GROUP BY kind",
    # windows
    "wn1_running_burns": lambda d: "SELECT pool, actor, t, tx_hash, log_index, lp_tokens, CAST(burned AS BIGINT) AS burned FROM (SELECT *, sum(lp_tokens) OVER (PARTITION BY pool, actor ORDER BY t, block_height, tx_hash, log_index, lp_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burned FROM {lp_events} WHERE event_kind = 'burn') AS x WHERE burned >= 60",
    "wn2_rankings": lambda d: "SELECT token, sender, t, nth FROM (SELECT token, sender, t, row_number() OVER (PARTITION BY token, sender ORDER BY t, seq) AS nth FROM {swaps} WHERE side = 'buy') AS x WHERE nth <= 1000",
    "wn3_lag": lambda d: "SELECT deployer, token, t - before AS gap FROM (SELECT deployer, token, t, lag(t) OVER (PARTITION BY deployer ORDER BY t, token) AS before FROM {launches}) AS x WHERE before IS NOT NULL",
    "wn4_percent_rank": lambda d: f"SELECT sender, round(pct, 6) AS pct FROM ({d.percent_ranked('SELECT sender, count(*) AS trades FROM {swaps} GROUP BY sender', 'trades', 'pct')}) AS x",
    # ordering
    "l01_top_holders": lambda d: "SELECT chain, token, holder, balance FROM (SELECT *, row_number() OVER (PARTITION BY chain, token ORDER BY balance DESC, holder) AS nth FROM {balances}) AS x WHERE nth <= 1000",
    "l02_capped_rows": lambda d: "SELECT token, least(count(*), 5000) AS used, CASE WHEN count(*) > 5000 THEN 1 ELSE 0 END AS warned FROM {swaps} GROUP BY token",
    "l03_event_page": lambda d: f"SELECT id, token, detector_id, t, confidence FROM {{anomalies}} WHERE confidence >= 0.4 AND t < {S} ORDER BY t DESC, id DESC LIMIT 101",
    "l04_all_transfers": lambda d: "SELECT chain, count(*) AS n, count(DISTINCT tx_hash) AS txs FROM {transfers} GROUP BY chain",
    # sets
    "u01_legs": lambda d: "SELECT token, leg, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM (SELECT token_out AS token, 'buy' AS leg, cents FROM {swaps} WHERE side = 'buy' UNION ALL SELECT token_in, 'sell', cents FROM {swaps} WHERE side = 'sell') AS x GROUP BY token, leg",
    "u02_distinct_wallets": lambda d: "SELECT DISTINCT sender FROM {swaps}",
    "u03_set_algebra": lambda d: "SELECT token, count(*) AS traders FROM (SELECT DISTINCT token, sender FROM {swaps} WHERE side = 'buy' EXCEPT SELECT DISTINCT token, sender FROM {swaps} WHERE side = 'sell' AND cents > 20000) AS x GROUP BY token",
}
