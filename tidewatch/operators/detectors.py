"""The fourteen detectors, each over all tokens at once: one row per token (or pool, deployer, wallet group) and signal."""

from __future__ import annotations

from functools import partial

from ..functions.exprs import clamp, established, flag, graduation, severity, sigmoid
from ..plans.dialect import Dialect
from ..plans.views import DAY, SWAPS_AS_OF, TRANSFERS_AS_OF
from .graph import rings

S, T = SWAPS_AS_OF, TRANSFERS_AS_OF
#: The defaults of the detectors hold for live chains; these hold for the derived tables, which are slow and cheap.
SCALED: dict[str, dict] = {
    "rug_pull_lp_drain": {"share": 0.0065, "short": 30 * DAY, "long": 365 * DAY},
    "pump_dump": {"window": 6 * 3600, "before": 6 * 3600, "ratio": 0.2, "burst": 0.20, "burst_cents": 500},
    "wash_trading_h1": {"reps": 2, "blocks": 5000, "tolerance": 0.05, "ring_cents": 5000, "ring_span": 5 * DAY},
    "mint_burn_anomaly": {"event_share": 0.003, "sum_share": 0.01, "window": 365 * DAY},
    "withdraw_withheld_drain": {"window": 730 * DAY, "rotated": 365 * DAY, "fresh": 180 * DAY, "tenure": 60 * DAY},
    "bridge_drain_v1": {"window": 30 * DAY, "baseline": 365 * DAY},
}


def _anomaly(inner: str, detector: str, keys: str, metrics: str) -> str:
    return f"SELECT {keys}, '{detector}' AS detector_id, signal, round(confidence, 6) AS confidence, {severity('round(confidence, 6)')} AS severity{', ' + metrics if metrics else ''} FROM ({inner}) AS fired"


def honeypot(d: Dialect) -> str:
    """Buys (to the pool) against sells, and the static score of token permissions; a listed token is capped."""
    return _anomaly(
        f"""
        WITH r AS (SELECT token, sum(CASE WHEN side = 'buy' THEN 1 ELSE 0 END) AS buys, sum(CASE WHEN side = 'sell' THEN 1 ELSE 0 END) AS sells FROM
          (SELECT token, CASE WHEN flag = 'R' THEN 'sell' ELSE 'buy' END AS side FROM {{transfers}} WHERE NOT is_mint AND NOT is_burn) AS x GROUP BY token
          HAVING sum(CASE WHEN side = 'buy' THEN 1 ELSE 0 END) > 0),
        q AS (SELECT token, CAST(buys AS BIGINT) AS buys, CAST(sells AS BIGINT) AS sells, CASE WHEN sells = 0 THEN CAST(999.0 AS DOUBLE) ELSE CAST(buys AS DOUBLE) / sells END AS ratio FROM r),
        s AS (SELECT k.chain, k.token, k.jup_verified, coalesce(q.buys, 0) AS buys, coalesce(q.sells, 0) AS sells, coalesce(q.ratio, 0) AS ratio,
          CASE WHEN freeze_authority THEN CASE WHEN non_transferable THEN 0.10 ELSE 0.25 END ELSE 0 END
          + CASE WHEN fee_bps > 3000 THEN {sigmoid("(fee_bps / 10000.0 - 0.5) / 0.2")} * 0.45 ELSE 0 END + 0.10 * {flag("fee_authority")} + 0.20 * {flag("permanent_delegate")} + 0.20 * {flag("transfer_hook")}
          + CASE WHEN coalesce(q.buys, 0) >= 5 AND coalesce(q.ratio, 0) > 5 THEN least(q.ratio / 50, 1) * 0.20 ELSE 0 END AS raw
          FROM {{tokens}} k LEFT JOIN q ON k.token = q.token)
        SELECT chain, token, 'static' AS signal, CASE WHEN jup_verified THEN least(0.8 * {sigmoid("raw / 0.55 - 1")}, 0.25) ELSE 0.8 * {sigmoid("raw / 0.55 - 1")} END AS confidence, buys, sells, round(ratio, 6) AS ratio FROM s""",
        "honeypot_sim",
        "chain, token",
        "buys, sells, ratio",
    )


def rug_pull(d: Dialect, share: float = 0.65, short: int = 3600, long: int = DAY, least_txs: int = 100, floor_cents: int = 150_000, as_of: int = T) -> str:
    """A: liquidity burned cumulatively by one actor in a short and a long window. B (A silent): too little safe liquidity."""
    part = lambda window, name: f"{name} AS (SELECT pool, max(removed) AS removed FROM (SELECT pool, actor, sum(lp_tokens) OVER (PARTITION BY pool, actor ORDER BY t, block_height, tx_hash, log_index, token, lp_tokens, cents ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS removed FROM {{lp_events}} WHERE event_kind = 'burn' AND t > {as_of - window} AND t <= {as_of}) AS w GROUP BY pool)"
    a = f"CASE WHEN s_share IS NULL OR s_share < {share} THEN 0.75 ELSE {clamp(sigmoid(f'4 * (s_share - {share}) / (1 - {share}) - 1.5'), 0.75, 1)} END"
    drained = f"n >= {least_txs} AND liquidity_cents >= {floor_cents} AND l_share >= {share}"
    b = clamp("0.50 + 0.25 * (70 - safe) / 70 + 0.15 * " + flag("providers = 1") + " + 0.20 * (1 - CAST(least(unlock_days, 90) AS DOUBLE) / 90)", 0.50, 0.75)
    return _anomaly(
        f"""
        WITH supply AS (SELECT pool, CAST(sum(lp_tokens) AS DOUBLE) AS total, count(*) AS n FROM {{lp_events}} GROUP BY pool),
        {part(short, "short_w")}, {part(long, "long_w")},
        p AS (SELECT k.pool, k.providers, k.unlock_days, k.liquidity_cents, k.lp_burned_pct, least(k.lp_burned_pct + CASE WHEN k.unlock_days > 45 THEN k.lp_locked_pct ELSE 0 END, 100) AS safe,
            CAST(s.removed AS DOUBLE) / supply.total AS s_share, CAST(l.removed AS DOUBLE) / supply.total AS l_share, supply.n
          FROM {{pools}} k LEFT JOIN supply ON k.pool = supply.pool LEFT JOIN short_w s ON k.pool = s.pool LEFT JOIN long_w l ON k.pool = l.pool)
        SELECT pool, CASE WHEN {drained} THEN 'A' ELSE 'B' END AS signal, CASE WHEN {drained} THEN {a} ELSE {b} END AS confidence, round(coalesce(l_share, 0), 6) AS removed_share, safe
        FROM p WHERE ({drained}) OR (safe < 70 AND NOT (lp_burned_pct >= 100 AND liquidity_cents < {floor_cents}))""",
        "rug_pull_lp_drain",
        "pool",
        "removed_share, safe",
    )


def concentration(d: Dialect) -> str:
    """Gini and top-10 share of liquid holders now and a year before; three signals, the strongest is told."""
    def measured(balance: str, name: str) -> str:
        return f"""{name} AS (SELECT chain, token, count(*) AS n, CAST(sum(b) AS DOUBLE) AS total, CAST(sum(CASE WHEN r_desc <= 10 THEN b ELSE 0 END) AS DOUBLE) AS top10, CAST(sum(r_asc * b) AS DOUBLE) AS weighted FROM
          (SELECT h.chain, h.token, {balance} AS b, row_number() OVER (PARTITION BY h.chain, h.token ORDER BY {balance} DESC, holder) AS r_desc, row_number() OVER (PARTITION BY h.chain, h.token ORDER BY {balance}, holder DESC) AS r_asc
           FROM {{balances}} h LEFT JOIN {{classes}} c ON h.holder = c.address WHERE (c.kind IS NULL OR c.kind = 'liquid') AND {balance} > 0) AS ranked GROUP BY chain, token)"""

    heads, rows = f"{measured('balance', 'now_h')}, {measured('prior_balance', 'prior_h')}", "SELECT a.chain, a.token, a.n, {}\n          FROM now_h a LEFT JOIN prior_h b ON a.chain = b.chain AND a.token = b.token"
    if d.spark:  # balances are worked out once for both: who holds nothing comes last, and ranks from below are ranks from above turned round
        both = lambda b, r: f"named_struct('n', count_if({b} > 0), 'total', CAST(sum(CASE WHEN {b} > 0 THEN {b} END) AS DOUBLE), 'top10', CAST(sum(CASE WHEN {b} > 0 AND {r} <= 10 THEN {b} WHEN {b} > 0 THEN 0 END) AS DOUBLE), 'weighted', CAST(sum(CASE WHEN {b} > 0 THEN {b} END) * (count_if({b} > 0) + 1) - sum(CASE WHEN {b} > 0 THEN {r} * {b} END) AS DOUBLE))"
        rank = lambda b: f"row_number() OVER (PARTITION BY h.chain, h.token ORDER BY {b} DESC, holder)"
        heads = f"""holders AS (SELECT chain, token, {both("balance", "r")} AS a, {both("prior_balance", "r_before")} AS b FROM
          (SELECT h.chain, h.token, balance, prior_balance, {rank("balance")} AS r, {rank("prior_balance")} AS r_before
           FROM {{balances}} h LEFT JOIN {{classes}} c ON h.holder = c.address WHERE c.kind IS NULL OR c.kind = 'liquid') AS ranked GROUP BY chain, token)"""
        rows = "SELECT chain, token, a.n, {} FROM (SELECT chain, token, a, CASE WHEN token IS NOT NULL THEN b END AS b FROM holders) AS h WHERE a.n > 0"
    gini = lambda x: f"CASE WHEN {x}.n < 2 OR {x}.total = 0 THEN 0 ELSE {clamp(f'2 * {x}.weighted / ({x}.n * {x}.total) - ({x}.n + 1.0) / {x}.n', 0, 1)} END"
    return _anomaly(
        f"""
        WITH {heads},
        m AS ({rows.format(f'{gini("a")} AS gini, a.top10 / a.total AS top10, {gini("b")} AS gini_before, b.top10 / b.total AS top10_before, b.n AS n_before')}),
        s AS (SELECT *, CASE WHEN n >= 5 AND n_before >= 5 AND gini - gini_before >= 0.05 THEN least(0.50 + (gini - gini_before - 0.05) / 0.10 * 0.30, 1) ELSE 0 END AS c1,
          CASE WHEN n >= 5 AND n_before >= 5 AND top10 - top10_before >= 0.10 THEN least(0.50 + (top10 - top10_before - 0.10) / 0.10 * 0.25, 1) ELSE 0 END AS c2,
          CASE WHEN top10 >= 0.80 THEN least(0.65 + (top10 - 0.80) / 0.20 * 0.20, 0.85) ELSE 0 END AS c3 FROM m)
        SELECT chain, token, CASE WHEN round(c1, 9) >= round(c2, 9) AND round(c1, 9) >= round(c3, 9) THEN 'gini' WHEN round(c2, 9) >= round(c3, 9) THEN 'top10_shift' ELSE 'top10_level' END AS signal, greatest(c1, c2, c3) AS confidence,
          n AS liquid_holders, round(gini, 6) AS gini, round(top10, 6) AS top10 FROM s WHERE greatest(c1, c2, c3) > 0""",
        "holder_concentration",
        "chain, token",
        "liquid_holders, gini, top10",
    )


def pump_dump(d: Dialect, window: int = 3600, before: int = 3600, ratio: float = 5.0, change: float = 0.30, burst: float = 0.70, burst_cents: int = 500_000, as_of: int = S) -> str:
    """A: volume of the last window against the average day, with a price rise. B: most of a day's volume in the last window.
    A token with either is raised by sales of insiders (C), then by smart wallets that bought before, then by a recent graduation,
    each up to the signal's cap."""
    a, b = f"ratio >= {ratio} AND change >= {change}", f"v1 / v24 >= {burst} AND v1 >= {burst_cents}"
    return _anomaly(
        f"""
        WITH w AS (SELECT chain, token, t, seq, cents FROM {{swaps}} WHERE cents > 0 AND t >= {as_of - 7 * DAY} AND t < {as_of}),
        last_h AS (SELECT chain, token, sum(cents) AS v1, max(CASE WHEN r_last = 1 THEN cents END) AS last_price, max(CASE WHEN r_first = 1 THEN cents END) AS first_price, count(*) AS n1 FROM
          (SELECT *, row_number() OVER (PARTITION BY chain, token ORDER BY t, seq) AS r_first, row_number() OVER (PARTITION BY chain, token ORDER BY t DESC, seq DESC) AS r_last FROM w WHERE t >= {as_of - window}) AS x GROUP BY chain, token),
        last_d AS (SELECT chain, token, sum(cents) AS v24 FROM w WHERE t >= {as_of - DAY} GROUP BY chain, token),
        daily AS (SELECT chain, token, {d.idiv("t", str(DAY))} AS day_no, CAST(sum(cents) AS DOUBLE) AS volume FROM w WHERE t < {as_of - window} GROUP BY chain, token, {d.idiv("t", str(DAY))}),
        base AS (SELECT chain, token, avg(volume) AS mean_volume, stddev_pop(volume) AS std_volume, count(*) AS days FROM daily GROUP BY chain, token),
        m AS (SELECT h.chain, h.token, CAST(v1 AS DOUBLE) AS v1, CAST(v24 AS DOUBLE) AS v24, mean_volume, v1 / mean_volume AS ratio, (last_price - first_price) / CAST(first_price AS DOUBLE) AS change,
          CASE WHEN std_volume > 0 THEN (v1 - mean_volume) / std_volume ELSE 0 END AS z, days FROM last_h h JOIN last_d e ON h.chain = e.chain AND h.token = e.token JOIN base b ON h.chain = b.chain AND h.token = b.token),
        f AS (SELECT *, CASE WHEN {a} THEN 'A' WHEN {b} THEN 'B' ELSE 'none' END AS signal, CASE WHEN {a} THEN 0.95 WHEN {b} THEN 0.85 ELSE 0.05 END AS cap,
          CAST(CASE WHEN {a} THEN {clamp(sigmoid(f"0.5 * (ratio / {ratio} - 1) + 0.3 * (change / {change} - 1)"), 0.60, 0.95)} WHEN {b} THEN least(0.50 + (v1 / v24 - {burst}) / 0.10 * 0.25, 0.75) ELSE 0.05 END AS DOUBLE) AS conf FROM m),
        i AS (SELECT f.*, coalesce(i.amplifier, 0) AS insiders, coalesce(s.amplifier, 0) AS smart, CAST(CASE WHEN g.graduated_t <= {as_of} THEN {graduation(f"(({as_of} - g.graduated_t) / CAST(3600 AS DOUBLE))")} ELSE 1 END AS DOUBLE) AS graduated
          FROM f LEFT JOIN ({insider_sales(d, as_of)}) AS i ON f.token = i.token LEFT JOIN ({smart_amplifier(d, window, before, as_of)}) AS s ON f.token = s.token LEFT JOIN {{graduations}} g ON f.token = g.token),
        c AS (SELECT *, least(conf + insiders, cap) AS c1 FROM i),
        e AS (SELECT *, CASE WHEN c1 >= 0.50 THEN least(c1 + smart, cap) ELSE c1 END AS c2 FROM c)
        SELECT chain, token, signal, CAST(least(c2 * graduated, cap) AS DOUBLE) AS confidence, round(ratio, 6) AS volume_ratio, round(change, 6) AS price_change, round(z, 4) AS z_score, round(v1 / v24, 6) AS burst, insiders, smart, graduated FROM e""",
        "pump_dump",
        "chain, token",
        "volume_ratio, price_change, z_score, burst, insiders, smart, graduated",
    )


def insider_sales(d: Dialect, as_of: int = S) -> str:
    """Signal C of pump and dump: what the insiders of a token, who hold at least 1 % of what all hold, sold in the last day."""
    return f"""
    WITH held AS (SELECT token, sender, CAST(sum(CASE WHEN side = 'buy' THEN cents ELSE -cents END) AS BIGINT) AS net FROM {{swaps}} WHERE t < {as_of - DAY} GROUP BY token, sender),
    whole AS (SELECT token, CAST(sum(net) AS BIGINT) AS net FROM held WHERE net > 0 GROUP BY token),
    top AS (SELECT held.token, sender, held.net FROM held JOIN whole ON held.token = whole.token WHERE held.net > 0 AND 100 * held.net >= whole.net),
    sold AS (SELECT token, sender, CAST(sum(cents) AS BIGINT) AS cents FROM {{swaps}} WHERE side = 'sell' AND t >= {as_of - DAY} AND t < {as_of} GROUP BY token, sender)
    SELECT top.token, count(*) AS insiders, round(CAST(sum(coalesce(sold.cents, 0)) AS DOUBLE) / CAST(sum(top.net) AS DOUBLE), 6) AS sold_share, CAST(CASE WHEN CAST(sum(coalesce(sold.cents, 0)) AS DOUBLE) >= 0.40 * CAST(sum(top.net) AS DOUBLE) THEN 0.15 ELSE 0 END AS DOUBLE) AS amplifier
    FROM top LEFT JOIN sold ON top.token = sold.token AND top.sender = sold.sender GROUP BY top.token"""


def smart_amplifier(d: Dialect, window: int = 3600, before: int = 3600, as_of: int = S) -> str:
    """Smart wallets that bought a token just before the window: one of the first tier, or two of the second, raise a signal."""
    return f"""
    SELECT token, tier1, tier2, CAST(CASE WHEN tier1 >= 1 THEN 0.12 WHEN tier2 >= 2 THEN 0.07 ELSE 0 END AS DOUBLE) AS amplifier FROM
      (SELECT s.token, count(DISTINCT CASE WHEN w.tier = 1 THEN s.sender END) AS tier1, count(DISTINCT CASE WHEN w.tier = 2 THEN s.sender END) AS tier2 FROM {{swaps}} s LEFT JOIN {{smart_wallets}} w ON s.sender = w.wallet WHERE s.side = 'buy' AND s.t >= {as_of - window - before} AND s.t < {as_of - window} GROUP BY s.token) AS x"""


def round_trips(d: Dialect, blocks: int = 25, tolerance: float = 0.01) -> str:
    """Buys and sells of one sender in one pool within some blocks and of about one value, either side first. Blocks are cut into
    spans of that length, and the later leg looks into its own and the one before, so a busy sender meets only near legs."""
    span = d.idiv("block_height", str(blocks))

    def leg(first: str, second: str) -> str:
        return f"""SELECT a.sender, a.pool, a.token, a.tx_hash AS first_tx, b.tx_hash AS second_tx, b.block_height - a.block_height AS gap, a.cents + b.cents AS cents
          FROM (SELECT *, {span} AS span FROM {{swaps}} WHERE side = '{first}' AND cents > 0) AS a
          JOIN (SELECT x.*, {span} - o.back AS span FROM {{swaps}} x CROSS JOIN {d.rows("(0), (1)", "back")} AS o WHERE side = '{second}' AND cents > 0) AS b
          ON a.sender = b.sender AND a.pool = b.pool AND a.span = b.span WHERE b.block_height > a.block_height AND b.block_height - a.block_height <= {blocks} AND abs(a.cents - b.cents) <= {tolerance} * greatest(a.cents, b.cents)"""

    return f"{leg('buy', 'sell')} UNION ALL {leg('sell', 'buy')}"


def wash_trading(d: Dialect, reps: int = 3, blocks: int = 25, tolerance: float = 0.01, ring_cents: int = 100_000, ring_span: int = 7200) -> str:
    """A: repeated round trips of a sender in a pool. B: rings of wallets that pass a token on. C: the share of A in the pool's volume
    raises the severity by one level. The subject is the pool (A) or the token (B)."""
    return f"""
    WITH trips AS ({round_trips(d, blocks, tolerance)}),
    s AS (SELECT pool, sender, count(*) AS trips, CAST(sum(cents) AS DOUBLE) / 100 AS wash_usd, {d.mode("gap")} AS usual_gap FROM trips GROUP BY pool, sender HAVING count(*) >= {reps}),
    v AS (SELECT pool, CAST(sum(cents) AS DOUBLE) / 100 AS usd FROM {{swaps}} GROUP BY pool),
    c AS (SELECT s.pool, s.sender, trips, wash_usd, usual_gap, wash_usd / usd AS share, round({clamp(f"0.60 + 0.05 * (trips - {reps}) + 0.10 * ln(wash_usd / 500)", 0.60, 0.95)}, 6) AS confidence FROM s JOIN v ON s.pool = v.pool)
    SELECT pool AS subject, sender, 'wash_trading_h1' AS detector_id, 'A' AS signal, CAST(confidence AS DOUBLE) AS confidence, trips, round(wash_usd, 2) AS wash_usd, usual_gap, round(share, 6) AS share,
      CASE WHEN share >= 0.30 THEN {severity('confidence + 0.20')} ELSE {severity('confidence')} END AS severity FROM c
    UNION ALL SELECT token, NULL, 'wash_trading_h1', 'B', CAST(confidence AS DOUBLE), rings, round(usd, 2), NULL, NULL, {severity('confidence')} FROM ({ring_signal(d, ring_cents, ring_span)}) AS r"""


def ring_signal(d: Dialect, ring_cents: int = 100_000, ring_span: int = 7200) -> str:
    """Wash trading by rings: enough value at the bottleneck, in a short time."""
    return f"""
    SELECT token, count(*) AS rings, CAST(sum(bottleneck) AS DOUBLE) / 100 AS usd, round(least(0.40 + 0.40 * least(CAST(sum(bottleneck) AS DOUBLE) / 100 / 10000, 1), 0.85), 6) AS confidence
    FROM ({rings(d)}) AS c WHERE bottleneck >= {ring_cents} AND span <= {ring_span} GROUP BY token"""


def mint_burn(d: Dialect, event_share: float = 0.05, sum_share: float = 0.20, window: int = 30 * DAY, as_of: int = T) -> str:
    """A: an old token can still be minted. B: one large mint or burn. C: large mints in sum; B and C spare established tokens."""
    return _anomaly(
        f"""
        WITH ev AS (SELECT f.token, k.supply, k.mint_authority, k.age_days, {established()} AS known, CAST(CASE WHEN is_burn THEN -amount ELSE amount END AS DOUBLE) / k.supply AS share, t, is_mint, tx_hash, log_index
            FROM {{transfers}} f JOIN {{tokens}} k ON f.token = k.token WHERE is_mint OR is_burn),
        b AS (SELECT token, max(abs(share)) AS x FROM ev WHERE NOT known GROUP BY token),
        c AS (SELECT token, sum(share) AS x FROM ev WHERE NOT known AND is_mint AND t > {as_of - window} AND t <= {as_of} GROUP BY token),
        u AS (SELECT k.token, 'A' AS signal, 0.20 * CASE WHEN {established()} THEN 0.5 ELSE 1 END AS confidence, 0.0 AS x FROM {{tokens}} k LEFT JOIN c ON k.token = c.token WHERE mint_authority AND age_days > 7 AND NOT coalesce(c.x >= {sum_share} AND age_days >= 14, FALSE)
          UNION ALL SELECT token, 'B', least(0.55 + 0.30 * (x - {event_share}) / {event_share} + 0.30, 0.85), x FROM b WHERE x >= {event_share}
          UNION ALL SELECT c.token, 'C', least(0.75 + (c.x - {sum_share}), 0.95), c.x FROM c JOIN {{tokens}} k ON c.token = k.token WHERE mint_authority AND age_days >= 14 AND c.x >= {sum_share})
        SELECT token, signal, CAST(confidence AS DOUBLE) AS confidence, CAST(round(x, 6) AS DOUBLE) AS share FROM u""",
        "mint_burn_anomaly",
        "token",
        "share",
    )


def withheld(d: Dialect, window: int = 7 * DAY, rotated: int = 30 * DAY, fresh: int = DAY, tenure: int = 7 * DAY, as_of: int = T, allowed: float | None = None) -> str:
    """A: withheld fees drawn again and again; surer by 0.10 (0.95 at most) if B holds as well. B: the authority changed lately, to a
    fresh wallet, after a short tenure.

    With `allowed`, A spares an established token that drew at most that share of its pools' volume; one without volume is not
    spared, and B never spares. Without it nothing is spared, and volumes are not read."""
    spared = "" if allowed is None else f" AND NOT coalesce(({established()}) AND v.usd > 0 AND a.usd / v.usd <= {allowed}, FALSE)"
    volumes = "" if allowed is None else " LEFT JOIN {tokens} k ON a.mint = k.token LEFT JOIN {pool_volumes} v ON a.mint = v.mint"
    return _anomaly(
        f"""
        WITH a AS (SELECT mint, count(*) AS n, CAST(sum(cents) AS DOUBLE) / 100 AS usd, count(DISTINCT authority) AS authorities FROM {{instructions}} WHERE kind = 'withdraw_withheld' AND t > {as_of - window} AND t <= {as_of} GROUP BY mint),
        r AS (SELECT mint, t, new_authority, lag(t) OVER (PARTITION BY mint ORDER BY t, tx_hash, log_index, new_authority, cents, amount) AS before, row_number() OVER (PARTITION BY mint ORDER BY t DESC, tx_hash DESC, log_index DESC, new_authority DESC, cents DESC, amount DESC) AS nth FROM {{instructions}} WHERE kind = 'set_authority' AND t <= {as_of}),
        b AS (SELECT r.mint, r.t, coalesce(r.t - f.first_t < {fresh} AND r.t >= f.first_t, FALSE) AS fresh, coalesce(r.t - r.before < {tenure}, FALSE) AS short_tenure FROM r LEFT JOIN {{funding}} f ON r.new_authority = f.wallet WHERE nth = 1 AND r.t > {as_of - rotated})
        SELECT a.mint, 'A' AS signal, least(least(CASE WHEN n >= 3 AND a.usd >= 1000 THEN 0.60 + least(0.03 * (n - 3), 0.15) + least(0.10 * ln(a.usd / 1000), 0.15) WHEN n = 2 THEN 0.60 ELSE 0.65 END - CASE WHEN authorities > 1 THEN 0.10 ELSE 0 END, 0.90) + CASE WHEN b.mint IS NOT NULL THEN 0.10 ELSE 0 END, 0.95) AS confidence, n, round(a.usd, 2) AS usd
          FROM a LEFT JOIN b ON a.mint = b.mint{volumes} WHERE ((n >= 3 AND a.usd >= 1000) OR n = 2 OR (n = 1 AND a.usd >= 5000)){spared}
        UNION ALL SELECT mint, 'B', least(0.40 + 0.20 * {flag("fresh")} + 0.15 * {flag("short_tenure")}, 0.75), 1, 0.0 FROM b""",
        "withdraw_withheld_drain",
        "mint",
        "n, usd",
    )


def sybil(d: Dialect, overlap: float = 0.30) -> str:
    """How many of a token's top holders are of one common-funder cluster; smart wallets among its members raise the confidence."""
    # a holder is once among a token's, and a wallet once in a cluster: here no task keeps the pairs to count each once
    held = "count(top.holder)" if d.spark else "count(DISTINCT top.holder)"
    return _anomaly(
        f"""
        WITH top AS (SELECT chain, token, holder FROM (SELECT chain, token, holder, row_number() OVER (PARTITION BY chain, token ORDER BY balance DESC, holder) AS nth FROM {{balances}}) AS x WHERE nth <= 100),
        o AS (SELECT top.chain, top.token, m.cluster_id, m.size, max(m.confidence) AS cluster_conf, {held} AS held FROM top JOIN {{members}} m ON top.holder = m.wallet AND top.chain = m.chain GROUP BY top.chain, top.token, m.cluster_id, m.size),
        b AS (SELECT *, row_number() OVER (PARTITION BY chain, token ORDER BY held DESC, cluster_id DESC) AS nth FROM o WHERE size >= 3),
        f AS (SELECT chain, token, cluster_id, held, size, least(greatest((0.40 + 0.40 * held / CAST(size AS DOUBLE)) * (0.50 + 0.50 * cluster_conf), 0), 0.95) AS conf FROM b WHERE nth = 1 AND held / CAST(size AS DOUBLE) >= {overlap}),
        w AS (SELECT m.chain, m.cluster_id, count(DISTINCT CASE WHEN w.tier = 1 THEN m.wallet END) AS tier1, count(DISTINCT CASE WHEN w.tier = 2 THEN m.wallet END) AS tier2 FROM {{members}} m JOIN {{smart_wallets}} w ON m.wallet = concat('c', substring(w.wallet, 2)) GROUP BY m.chain, m.cluster_id),
        a AS (SELECT f.*, CAST(CASE WHEN conf < 0.30 THEN 0 WHEN tier1 >= 1 THEN 0.10 WHEN tier2 >= 2 THEN 0.05 ELSE 0 END AS DOUBLE) AS smart FROM f LEFT JOIN w ON f.chain = w.chain AND f.cluster_id = w.cluster_id)
        SELECT chain, token, 'overlap' AS signal, CAST(least(conf + smart, 0.95) AS DOUBLE) AS confidence, cluster_id, held, size, smart FROM a""",
        "sybil_detection",
        "chain, token",
        "cluster_id, held, size, smart",
    )


def deployer_features(d: Dialect) -> str:
    """Features of each launch of a deployer, in launch order, and the composite score that the change-point model reads."""
    holders = "(SELECT token, count(DISTINCT to_address) AS holders FROM {transfers} GROUP BY token)"
    return f"""
    WITH o AS (SELECT l.deployer, l.token, l.t, row_number() OVER (PARTITION BY deployer ORDER BY l.t, l.token) AS nth, ln(coalesce(l.t - lag(l.t) OVER (PARTITION BY deployer ORDER BY l.t, l.token), {30 * DAY}) + 1.0) AS log_gap,
        1 - l.lp_deployer / CAST(l.lp_total AS DOUBLE) AS lp_locked, ln(l.liquidity_cents / 100.0 + 1) AS log_liquidity, coalesce(h.holders, 0) AS holders, l.lp_deployer * 2 > l.lp_total AS rugged
      FROM {{launches}} l LEFT JOIN {holders} h ON l.token = h.token),
    r AS (SELECT *, coalesce(avg(CAST(CASE WHEN rugged THEN 1 ELSE 0 END AS DOUBLE)) OVER (PARTITION BY deployer ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rug_rate FROM o)
    SELECT deployer, token, CAST(nth AS BIGINT) AS nth, round(log_gap, 6) AS log_gap, round(lp_locked, 6) AS lp_locked, round(log_liquidity, 6) AS log_liquidity, holders, round(CAST(rug_rate AS DOUBLE), 6) AS rug_rate,
      round(0.25 * least(greatest(1 - log_gap / 16, 0), 1) + 0.25 * (1 - lp_locked) + 0.20 * least(greatest(1 - log_liquidity / 14, 0), 1) + 0.15 * least(greatest(1 - holders / 200.0, 0), 1) + 0.15 * CAST(rug_rate AS DOUBLE), 6) AS score FROM r"""


def launch_audit(d: Dialect) -> str:
    """The first pool of a token: little liquidity, nothing locked."""
    return _anomaly(
        f"""
        WITH f AS (SELECT token, deployer, liquidity_cents, lp_total, lp_deployer, row_number() OVER (PARTITION BY token ORDER BY t, deployer) AS nth FROM {{launches}}),
        s AS (SELECT token, deployer, liquidity_cents, {flag("liquidity_cents > 0 AND liquidity_cents < 500000")} AS a, {flag("lp_deployer >= lp_total")} AS b FROM f WHERE nth = 1)
        SELECT token, CASE WHEN a + b = 2 THEN 'AB' WHEN a = 1 THEN 'A' ELSE 'B' END AS signal, CAST(least(0.45 * a + 0.45 * b + 0.10 * a * b, 0.80) AS DOUBLE) AS confidence, liquidity_cents FROM s WHERE a + b > 0""",
        "launch_audit",
        "token",
        "liquidity_cents",
    )


def permit_drainer(d: Dialect) -> str:
    """A1: to a known drainer. A2: a permit and the transfer it allows in one transaction. The best transaction of a token."""
    return _anomaly(
        f"""
        WITH n AS (SELECT token, tx_hash, count(*) AS batch FROM {{transfers}} GROUP BY token, tx_hash),
        a1 AS (SELECT f.token, f.tx_hash, f.from_address, f.to_address, FALSE AS is_max, 0.70 AS base, 'A1' AS signal FROM {{transfers}} f JOIN {{classes}} c ON f.to_address = c.address WHERE c.kind = 'burn_address' AND c.confidence > 0.9 AND (f.cents = 0 OR f.cents >= 10000)),
        a2 AS (SELECT f.token, f.tx_hash, f.from_address, f.to_address, p.is_max, 0.55, 'A2' FROM {{transfers}} f JOIN {{permits}} p ON f.token = p.token AND f.tx_hash = p.tx_hash AND f.from_address = p.owner AND f.to_address = p.spender
            LEFT JOIN {{classes}} c ON p.spender = c.address WHERE coalesce(c.kind, '') <> 'dex_pool' AND (p.is_max OR abs(p.allowed - f.amount) <= 0.1 * p.allowed)),
        u AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2),
        s AS (SELECT u.token, u.tx_hash, signal, least(base + CASE WHEN batch > 1 THEN 0.10 ELSE 0 END + CASE WHEN is_max THEN 0.05 ELSE 0 END, 0.95) AS confidence, batch FROM u JOIN n ON u.token = n.token AND u.tx_hash = n.tx_hash),
        b AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY confidence DESC, tx_hash, signal) AS nth FROM s)
        SELECT token, signal, CAST(confidence AS DOUBLE) AS confidence, tx_hash, batch FROM b WHERE nth = 1""",
        "permit2_drainer_v1",
        "token",
        "tx_hash, batch",
    )


def sandwich_candidates(d: Dialect, block: int = 21600) -> str:
    """front < victim < back within a block of a pool: one sender around another, the direction turned, a shared token."""
    order = f"row_number() OVER (PARTITION BY pool, {d.idiv('t', str(block))} ORDER BY t, seq) AS pos"
    return f"""
    WITH x AS (SELECT pool, {d.idiv("t", str(block))} AS block_no, sender, side, token, cents, seq, {order} FROM {{swaps}})
    SELECT f.pool, f.block_no, f.pos AS front_pos, v.pos AS victim_pos, b.pos AS back_pos, f.sender AS attacker, v.sender AS victim, f.token, f.cents AS front_cents, v.cents AS victim_cents, b.cents AS back_cents
    FROM x f JOIN x b ON f.pool = b.pool AND f.block_no = b.block_no AND f.sender = b.sender AND f.side <> b.side AND f.token = b.token AND f.pos < b.pos
    JOIN x v ON v.pool = f.pool AND v.block_no = f.block_no AND v.pos > f.pos AND v.pos < b.pos AND v.sender <> f.sender AND v.token = f.token AND v.side = f.side"""


def sandwich(d: Dialect) -> str:
    # here the first is an aggregate, which the tasks of the join combine, so candidates are neither shuffled nor sorted
    best = "SELECT *, row_number() OVER (PARTITION BY pool, block_no ORDER BY confidence DESC, front_pos, victim_pos, back_pos) AS nth FROM r"
    if d.spark:
        best = "SELECT pool, block_no, x.*, 1 AS nth FROM (SELECT pool, block_no, min(struct(-confidence AS less, front_pos, victim_pos, back_pos, confidence, attacker, victim, front_cents, back_cents, slip)) AS x FROM r GROUP BY pool, block_no) AS y"
    conf = "least(0.55 + 0.15 * CASE WHEN back_cents > front_cents THEN 1 ELSE 0 END + 0.15 * CASE WHEN slip >= 0.005 THEN 1 ELSE 0 END, 0.85)"
    return _anomaly(
        f"""
        WITH c AS (SELECT *, front_cents / CAST(front_cents + victim_cents AS DOUBLE) AS slip FROM ({sandwich_candidates(d)}) AS q WHERE victim_cents >= 1000 AND attacker NOT IN ('u0')),
        r AS (SELECT *, {conf} AS confidence FROM c),
        b AS ({best})
        SELECT pool, block_no, 'sandwich' AS signal, CAST(confidence AS DOUBLE) AS confidence, attacker, victim, back_cents - front_cents AS profit_cents, round(slip, 6) AS slippage FROM b WHERE nth = 1""",
        "sandwich_mev_v1",
        "pool, block_no",
        "attacker, victim, profit_cents, slippage",
    )


def bridge_drain(d: Dialect, per_token: bool = False, share: float = 0.20, window: int = 3600, baseline: int = 30 * DAY, as_of: int = T) -> str:
    """Outflow of a custody address in the window against its inflow of the time before; per token, or over all."""
    keys = "address, token" if per_token else "address"
    return _anomaly(
        f"""
        WITH legs AS (SELECT from_address AS address, token, amount AS out_amount, 0 AS in_amount FROM {{transfers}} WHERE t > {as_of - window} AND t <= {as_of}
            UNION ALL SELECT concat('s', substring(to_address, 2)), token, 0, amount FROM {{transfers}} WHERE t > {as_of - window - baseline} AND t <= {as_of - window}),
        g AS (SELECT {keys}, CAST(sum(out_amount) AS DOUBLE) AS out_amount, CAST(sum(in_amount) AS DOUBLE) AS in_amount FROM legs GROUP BY {keys}),
        k AS (SELECT g.*, out_amount / in_amount AS share, CASE WHEN p.dex_no = 0 THEN 0.85 ELSE 0.65 END AS base FROM g JOIN {{pools}} p ON g.address = p.pool WHERE in_amount > 0)
        SELECT {keys}, 'outflow' AS signal, CAST(least(base + CASE WHEN share >= 0.50 THEN 0.10 ELSE 0 END, 0.95) AS DOUBLE) AS confidence, round(share, 6) AS share FROM k WHERE share > {share}""",
        "bridge_drain_v1",
        keys,
        "share",
    )


PUMP = SCALED["pump_dump"]
WASH = SCALED["wash_trading_h1"]
TEXTS = {
    "d01_honeypot": honeypot,
    "d02_rug_pull": partial(rug_pull, **SCALED["rug_pull_lp_drain"]),
    "d03_concentration": concentration,
    "d04_pump_dump": partial(pump_dump, **PUMP),
    "d04_insider_sales": insider_sales,
    "d04_smart_amplifier": partial(smart_amplifier, window=PUMP["window"], before=PUMP["before"]),
    "d05_wash_trading": partial(wash_trading, **WASH),
    "d05_ring_signal": partial(ring_signal, ring_cents=WASH["ring_cents"], ring_span=WASH["ring_span"]),
    "d06_mint_burn": partial(mint_burn, **SCALED["mint_burn_anomaly"]),
    "d07_withheld": partial(withheld, **SCALED["withdraw_withheld_drain"]),
    # the derived tables draw more than they swap
    "d07_withheld_allowed": partial(withheld, **SCALED["withdraw_withheld_drain"], allowed=3.0),
    "d08_sybil": sybil,
    "d09_deployer_features": deployer_features,
    "d10_launch_audit": launch_audit,
    "d12_permit_drainer": permit_drainer,
    "d13_sandwich": sandwich,
    "d14_bridge_drain": partial(bridge_drain, **SCALED["bridge_drain_v1"]),
    "d14_bridge_drain_per_token": partial(bridge_drain, per_token=True, **SCALED["bridge_drain_v1"]),
    "j01_round_trips": partial(round_trips, blocks=WASH["blocks"], tolerance=WASH["tolerance"]),
    "j09_sandwich_candidates": sandwich_candidates,
}
