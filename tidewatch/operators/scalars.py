"""Projections, filters and scalar functions (F), as texts over the chain tables."""

from __future__ import annotations

from ..functions.exprs import clamp, decay, established, severity, severity_rank, sigmoid
from ..plans.dialect import Dialect
from ..plans.views import DAY, SWAPS_AS_OF


def filtered_aggregates(d: Dialect) -> str:
    return "SELECT token, count(*) FILTER (WHERE side = 'buy') AS buys, count(*) FILTER (WHERE side = 'sell') AS sells, CAST(coalesce(sum(cents) FILTER (WHERE side = 'buy'), 0) AS BIGINT) AS buy_cents FROM {swaps} GROUP BY token"


def case_scalars(d: Dialect) -> str:
    return """
    SELECT sender, CASE WHEN sells = 0 THEN CAST(999.0 AS DOUBLE) ELSE buys / CAST(sells AS DOUBLE) END AS ratio, CAST(greatest(buys, sells) AS BIGINT) AS most, CAST(least(buys, sells) AS BIGINT) AS least_n, CAST(abs(buys - sells) AS BIGINT) AS gap,
      round(power(CAST(buys AS DOUBLE), 2), 4) AS squared, round(ln(buys + CAST(1 AS DOUBLE)), 6) AS logged, round(exp(-CAST(sells AS DOUBLE) / 10), 6) AS faded, coalesce(nullif(sells, 0), -1) AS sells_or
    FROM (SELECT sender, CAST(sum(CASE WHEN side = 'buy' THEN 1 ELSE 0 END) AS BIGINT) AS buys, CAST(sum(CASE WHEN side = 'sell' THEN 1 ELSE 0 END) AS BIGINT) AS sells FROM {swaps} GROUP BY sender) AS x"""


def any_all(d: Dialect) -> str:
    """Membership in a list and exclusion by one, as semi and anti joins."""
    return "SELECT count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM {transfers} f WHERE to_address IN (SELECT address FROM {classes} WHERE kind = 'liquid') AND NOT EXISTS (SELECT 1 FROM {pools} p WHERE p.pool = f.from_address AND p.dex_no = 3)"


def optional_predicate(d: Dialect, token: str | None = None, chain: str | None = "solana", least_cents: int | None = 5000) -> str:
    """A predicate that is not given is not in the plan at all."""
    parts = [f"token = '{token}'" if token else "", f"chain = '{chain}'" if chain else "", f"cents >= {least_cents}" if least_cents is not None else ""]
    return "SELECT token, count(*) AS n FROM {swaps} WHERE " + (" AND ".join(p for p in parts if p) or "TRUE") + " GROUP BY token"


def keyset_page(d: Dialect, before: tuple[int, int] = (SWAPS_AS_OF, 1_000_000), size: int = 50) -> str:
    t, i = before
    return f"SELECT id, token, detector_id, t FROM {{anomalies}} WHERE (t < {t} OR (t = {t} AND id < {i})) ORDER BY t DESC, id DESC LIMIT {size + 1}"


def severity_ranks(d: Dialect) -> str:
    return f"SELECT id, confidence, {severity('confidence')} AS severity, {severity_rank('(' + severity('confidence') + ')')} AS severity_no FROM {{anomalies}}"


def time_functions(d: Dialect) -> str:
    return f"SELECT token, {d.idiv('t', str(DAY))} AS day_no, {d.idiv('t', '3600')} % 24 AS hour_no, count(*) AS n, max(t) - min(t) AS span FROM {{swaps}} WHERE t BETWEEN {SWAPS_AS_OF - 7 * DAY} AND {SWAPS_AS_OF} GROUP BY token, {d.idiv('t', str(DAY))}, {d.idiv('t', '3600')} % 24"


def json_fields(d: Dialect) -> str:
    return f"SELECT event_type, count(*) AS n, CAST(sum({d.json_int('props', 'k')}) AS BIGINT) AS k_sum, count({d.json_int('props', 'missing')}) AS missing_n FROM {{events}} GROUP BY event_type"


def sigmoids(d: Dialect) -> str:
    return f"SELECT id, round({sigmoid('confidence / 0.5 - 1')}, 6) AS y FROM {{anomalies}}"


def severities(d: Dialect) -> str:
    return f"SELECT {severity('confidence')} AS severity, count(*) AS n FROM {{anomalies}} GROUP BY {severity('confidence')}"


def gini(d: Dialect) -> str:
    return f"""
    SELECT chain, token, CASE WHEN count(*) < 2 OR sum(balance) = 0 THEN CAST(0 AS DOUBLE) ELSE round({clamp("2 * CAST(sum(r * balance) AS DOUBLE) / (count(*) * CAST(sum(balance) AS DOUBLE)) - (count(*) + CAST(1 AS DOUBLE)) / count(*)", 0, 1)}, 6) END AS gini
    FROM (SELECT chain, token, balance, row_number() OVER (PARTITION BY chain, token ORDER BY balance, holder) AS r FROM {{balances}}) AS x GROUP BY chain, token"""


def top_share(d: Dialect, n: int = 10) -> str:
    return f"""
    SELECT chain, token, round(sum(CASE WHEN r <= {n} THEN balance ELSE 0 END) / CAST(sum(balance) AS DOUBLE), 6) AS share
    FROM (SELECT chain, token, balance, row_number() OVER (PARTITION BY chain, token ORDER BY balance DESC, holder) AS r FROM {{balances}}) AS x GROUP BY chain, token"""


def decays(d: Dialect) -> str:
    age = f"(({SWAPS_AS_OF} - t) / CAST(3600 AS DOUBLE))"
    return f"SELECT id, round(CAST({decay(age, 72)} AS DOUBLE), 6) AS weight FROM {{anomalies}}"


def scaled(d: Dialect) -> str:
    return "SELECT token, round(supply / power(CAST(10 AS DOUBLE), decimals), 9) AS supply_units FROM {tokens}"


def clamps(d: Dialect) -> str:
    return f"SELECT id, round({clamp('confidence * 2 - 0.3', 0, 1)}, 6) AS y FROM {{anomalies}}"


def cursors(d: Dialect) -> str:
    """base64url cursors of (time, id), and back."""
    url = f"replace(replace(replace({d.b64('raw')}, '+', '-'), '/', '_'), '=', '')"
    pad = "concat(replace(replace(cursor_text, '-', '+'), '_', '/'), CASE length(cursor_text) % 4 WHEN 2 THEN '==' WHEN 3 THEN '=' ELSE '' END)"
    return f"SELECT id, cursor_text, {d.unb64(pad)} AS decoded FROM (SELECT id, {url} AS cursor_text FROM (SELECT id, concat(CAST(t AS STRING), '|', CAST(id AS STRING)) AS raw FROM {{anomalies}}) AS a) AS b"


def normalised_addresses(d: Dialect) -> str:
    """EVM addresses are lower-cased, others keep their case."""
    return "SELECT c_name, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE lower(c_name) END AS address FROM {customer}"


def price_proxy(d: Dialect) -> str:
    """Liquidity over supply; without a liquidity of its own, that of the token's best pool."""
    return """
    WITH b AS (SELECT token, pool, liquidity_cents, row_number() OVER (PARTITION BY token ORDER BY liquidity_cents DESC, pool) AS nth FROM (SELECT DISTINCT e.token, p.pool, p.liquidity_cents FROM {lp_events} e JOIN {pools} p ON e.pool = p.pool) AS x)
    SELECT k.token, round(greatest(coalesce(b.liquidity_cents, 0), 0) / CAST(100 AS DOUBLE) / (k.supply / power(CAST(10 AS DOUBLE), k.decimals)), 4) AS price, b.pool FROM {tokens} k LEFT JOIN b ON k.token = b.token AND b.nth = 1"""


def established_tokens(d: Dialect) -> str:
    return f"SELECT token, {established()} AS established FROM {{tokens}}"


def zero_address(d: Dialect) -> str:
    return "SELECT is_mint, is_burn, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM {transfers} GROUP BY is_mint, is_burn"


TEXTS = {
    "f01_filtered_aggregates": filtered_aggregates,
    "f02_case_scalars": case_scalars,
    "f03_any_all": any_all,
    "f04_optional_predicate": optional_predicate,
    "f05_keyset": keyset_page,
    "f06_severity_rank": severity_ranks,
    "f07_time_functions": time_functions,
    "f08_json": json_fields,
    "f09_sigmoid": sigmoids,
    "f10_severity": severities,
    "f11_gini": gini,
    "f12_top_share": top_share,
    "f13_decay": decays,
    "f14_scaling": scaled,
    "f15_clamp": clamps,
    "f16_cursor": cursors,
    "f17_addresses": normalised_addresses,
    "f18_price_proxy": price_proxy,
    "f19_established": established_tokens,
    "f20_zero_address": zero_address,
}
