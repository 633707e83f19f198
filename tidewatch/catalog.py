"""Every query of the engine by name: (query, oracle SQL or None)."""

from __future__ import annotations

from . import api
from .functions import keccak
from .operators import cycles, detectors, graph, probes, relational, scalars, scoring, sequences, sinks, smart_money
from .plans import views  # noqa: F401  (registers the derived tables)
from .plans.dialect import Tables, query
from .sources import accounts, samples
from .streaming import batcher, jobs, reorg, stateful

TEXTS = detectors.TEXTS | scalars.TEXTS | relational.TEXTS | graph.TEXTS | scoring.TEXTS | smart_money.TEXTS | probes.TEXTS | sinks.TEXTS | jobs.TEXTS
QUERIES: dict = {name: query(text) for name, text in TEXTS.items()}

# the same results by ordered passes in pandas, held against the same oracles
QUERIES["m02_fifo_exact"] = (lambda spark, sf_dir: smart_money.fifo(Tables(spark, sf_dir)("legs")).selectExpr("wallet", "token", "buy_t", "sell_t", "sell_seq", "qty", "round(pnl, 4) AS pnl", "held"), query(smart_money.fifo_summary)[1])
QUERIES["g07_rings_exact"] = (lambda spark, sf_dir: graph.rings_exact(Tables(spark, sf_dir)("trade_edges")).where("size > 2"), query(graph.rings)[1])
QUERIES["m08_labelled_buys"] = (smart_money.labelled_buys, query(smart_money.labelled_text)[1])

# and without a bound on a wallet's edges: cycles from their busiest wallet
QUERIES["g07_rings_by_degree"] = (cycles.busiest_first, query(graph.rings)[1])

for _name, (_made, _text) in (samples.QUERIES | accounts.QUERIES | keccak.QUERIES | sinks.W_QUERIES | jobs.STREAMS | stateful.STREAMS | batcher.STREAMS | reorg.STREAMS | {"analyze": (api.analyzed, api.analyzed_text)}).items():
    QUERIES[_name] = (_made, query(_text)[1])
QUERIES |= sequences.QUERIES
