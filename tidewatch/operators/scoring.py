"""Scoring operators (R): from anomaly events to one explainable score per token."""

from __future__ import annotations

from ..functions.exprs import established, graduation, severity_name
from ..plans.dialect import Dialect
from ..plans.views import SWAPS_AS_OF
from . import detectors, probes

#: Weights of the seven scored detectors.
WEIGHTS = {"holder_concentration": 0.32, "pump_dump": 0.32, "rug_pull_lp_drain": 0.20, "wash_trading_h1": 0.07, "honeypot_sim": 0.015, "mint_burn_anomaly": 0.015, "withdraw_withheld_drain": 0.06}
#: Weights of the quick composite by probe; any other has 0.7.
QUICK_WEIGHTS = {
    "d01_honeypot_static": 1.0,
    "d02_ownable_owner": 1.0,
    "d02_recent_renounce": 1.0,
    "d02_d06_mint_authority": 1.0,
    "d06_mint_burn": 0.9,
    "d03_holder_concentration": 0.7,
    "d03_dormant_token": 0.9,
    "d04_pump_dump": 0.6,
    "d05_wash_trading": 0.85,
    "d11_synchronized": 0.65,
    "d09_deployer_pattern": 0.7,
    "d08_sybil_throwaway": 0.7,
    "d04_pump_dump_proxy": 0.6,
    "d11_synchronized_proxy": 0.6,
    "d10_launch_audit": 0.5,
}
#: The probe that a detector's score counts as.
PROBE_OF = {
    "honeypot_sim": "d01_honeypot_static", "mint_burn_anomaly": "d06_mint_burn", "holder_concentration": "d03_holder_concentration", "pump_dump": "d04_pump_dump", "wash_trading_h1": "d05_wash_trading",
    "synchronized_activity_v1": "d11_synchronized", "deployer_changepoint": "d09_deployer_pattern", "sybil_detection": "d08_sybil_throwaway", "launch_audit": "d10_launch_audit",
}


def weight(x: str, weights: dict, other: float) -> str:
    return "CAST(CASE " + x + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {other} END AS DOUBLE)"


def attenuation(young: float = 1.0, old: float = 1.0) -> str:
    """Factor of listed and established tokens, and of age: `young` up to a week, `old` from 90 days, linear between."""
    age = f"CASE WHEN age_days < 7 THEN {young} WHEN age_days >= 90 THEN {old} ELSE {young} + (age_days - 7) / 83.0 * ({old} - {young}) END"
    return f"CAST(CASE WHEN jup_strict THEN 0.30 WHEN jup_verified THEN 0.60 ELSE 1 END * CASE WHEN {established()} THEN 0.50 ELSE 1 END * {age} AS DOUBLE)"


def base(d: Dialect) -> str:
    return f"SELECT chain, token, least(greatest(sum({weight('detector_id', WEIGHTS, 0)} * max_eff), 0), 1) AS base, CAST(max(CASE WHEN fired > 0 THEN max_sev ELSE 0 END) AS BIGINT) AS sev, CAST(sum(fired) AS BIGINT) AS fired, count(*) AS detectors FROM {{detector_scores}} GROUP BY chain, token"


def evidence(d: Dialect, keep: int = 5) -> str:
    return f"""
    SELECT chain, token, nth, detector_id, metric, sev, round(raw, 6) AS confidence, k AS amount FROM (SELECT *, row_number() OVER (PARTITION BY chain, token ORDER BY sev DESC, raw DESC, metric, detector_id) AS nth FROM
      (SELECT chain, token, detector_id, concat(detector_id, '/k', CAST(k % 3 AS STRING)) AS metric, sev, raw, k, row_number() OVER (PARTITION BY chain, token, detector_id, k % 3 ORDER BY sev DESC, raw DESC, id) AS best FROM {{scored}}) AS x WHERE best = 1) AS y WHERE nth <= {keep}"""


def report_events(d: Dialect) -> str:
    """The events of each report in its order, by detector and time, with what each adds at its detector's weight. One row per event: a token with very
    many of them is not one value."""
    return f"""
    SELECT chain, token, row_number() OVER (PARTITION BY chain, token ORDER BY detector_id, t, id) AS nth, detector_id, id, t AS observed_at, round(raw, 6) AS confidence, {severity_name('sev')} AS severity,
      round({weight('detector_id', WEIGHTS, 0)} * eff, 6) AS weighted FROM {{scored}}"""


def noisy_or(rows: str, key: str, confidence: str, weights: dict) -> str:
    """token, score, label: one minus the product of what each weighted confidence leaves."""
    return f"""
    SELECT token, score, CASE WHEN score >= 0.80 THEN 'CRITICAL' WHEN score >= 0.60 THEN 'HIGH' WHEN score >= 0.40 THEN 'MEDIUM' WHEN score >= 0.20 THEN 'LOW' ELSE 'INFO' END AS label FROM
      (SELECT token, round(1 - exp(sum(ln(1 - least(greatest({weight(key, weights, 0.7)} * {confidence}, 0), 0.95)))), 6) AS score FROM {rows} GROUP BY token) AS x"""


def quick_composite(d: Dialect) -> str:
    """Over the detectors' decayed scores."""
    return noisy_or("{detector_scores}", "detector_id", "mean_eff", {k: QUICK_WEIGHTS[v] for k, v in PROBE_OF.items()})


def probe_verdict(d: Dialect) -> str:
    """Over the one-shot probes of a token, each at its highest confidence."""
    parts = {
        "d01_honeypot_static": detectors.honeypot(d),
        "d03_holder_concentration": detectors.concentration(d),
        "d03_dormant_token": probes.TEXTS["c03_dormant"](d),
        "d06_mint_burn": detectors.TEXTS["d06_mint_burn"](d),
        "d08_sybil_throwaway": probes.TEXTS["c07_throwaway_holders"](d),
        "d10_launch_audit": probes.TEXTS["c08_contract_age"](d),
        "d11_synchronized": probes.TEXTS["c05_block_burst"](d),
    }
    more = []
    if d.spark:  # these two count the same transfers of a token, so they are counted once; neither confidence is ever null
        parts = {k: text for k, text in parts.items() if k not in ("d03_dormant_token", "d11_synchronized")}
        more = [f"SELECT token, probe, CAST(max(confidence) AS DOUBLE) AS confidence FROM ({probes.counted(d)}) AS counted WHERE confidence IS NOT NULL GROUP BY token, probe"]
    union = " UNION ALL ".join([f"SELECT token, '{k}' AS probe, CAST(max(confidence) AS DOUBLE) AS confidence FROM ({text}) AS {k} GROUP BY token" for k, text in parts.items()] + more)
    return noisy_or(f"({union}) AS p", "probe", "confidence", QUICK_WEIGHTS)


TEXTS = {
    "r01_canonical_ids": lambda d: "SELECT detector_id, count(*) AS n FROM {scored} GROUP BY detector_id",
    "r02_decayed": lambda d: "SELECT id, detector_id, round(eff, 6) AS eff FROM {scored}",
    "r03_detector_scores": lambda d: "SELECT chain, token, detector_id, round(max_eff, 6) AS max_eff, round(max_raw, 6) AS max_raw, round(mean_eff, 4) AS mean_eff, max_sev, fired, inconclusive, infos FROM {detector_scores}",
    "r04_base_score": lambda d: f"SELECT chain, token, round(base, 6) AS base FROM ({base(d)}) AS b",
    "r05_overall_severity": lambda d: f"SELECT chain, token, {severity_name('sev')} AS severity FROM ({base(d)}) AS b",
    "r06_attenuation": lambda d: f"SELECT token, round({attenuation()}, 6) AS factor FROM {{tokens}}",
    "r07_top_evidence": evidence,
    "r08_detector_evidence": lambda d: "SELECT token, detector_id, id, nth FROM (SELECT token, detector_id, id, row_number() OVER (PARTITION BY token, detector_id ORDER BY raw DESC, id) AS nth FROM {scored}) AS x WHERE nth <= 3",
    "r09_coverage": lambda d: f"SELECT token, round(count(DISTINCT CASE WHEN detector_id IN ({', '.join(repr(k) for k in WEIGHTS)}) THEN detector_id END) / CAST(7 AS DOUBLE), 6) AS coverage, {d.join_set('detector_id')} AS ran FROM {{scored}} GROUP BY token",
    "r10_report": lambda d: f"SELECT b.chain, b.token, round(b.base * coalesce({attenuation()}, 1), 6) AS score, round(b.base, 6) AS base, {severity_name('b.sev')} AS severity, b.fired, b.detectors, {SWAPS_AS_OF} AS as_of FROM ({base(d)}) AS b LEFT JOIN {{tokens}} k ON substring(b.token, 4) = substring(k.token, 2)",
    "r10_report_events": report_events,
    "r11_graduation": lambda d: f"SELECT token, CAST({graduation('age_days * 24 - 20')} AS DOUBLE) AS factor FROM {{tokens}}",
    "r12_quick_composite": quick_composite,
    "r12_probe_verdict": probe_verdict,
    "r13_verdicts": lambda d: f"SELECT token, detector_id, round(raw, 6) AS confidence, {severity_name('sev')} AS severity, t + CASE detector_id WHEN 'pump_dump' THEN 300 WHEN 'wash_trading_h1' THEN 900 ELSE 3600 END AS expires FROM (SELECT *, row_number() OVER (PARTITION BY token, detector_id ORDER BY raw DESC, t DESC, id) AS nth FROM {{scored}}) AS x WHERE nth = 1",
    "r14_analyze_severity": lambda d: f"SELECT token, CASE WHEN base >= 0.85 THEN 'critical' WHEN base >= 0.65 THEN 'high' WHEN base >= 0.40 THEN 'medium' WHEN base > 0 THEN 'low' ELSE 'info' END AS severity FROM ({base(d)}) AS b",
}
