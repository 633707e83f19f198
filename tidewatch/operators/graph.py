"""Graph operators (G): funding edges, common-funder clusters, transfer rings, typed edges and labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from ..plans.dialect import Dialect
from ..plans.views import DAY, TRANSFERS_AS_OF


def rings(d: Dialect, longest: int = 5) -> str:
    """Elementary cycles of 3 to `longest` wallets within a token and time bucket; the least wallet comes first, so each is found once."""
    def of(k: int) -> str:
        joins = "".join(f" JOIN {{trade_edges}} e{i} ON e{i}.token = e1.token AND e{i}.bucket = e1.bucket AND e{i}.src = e{i - 1}.dst" + (f" AND e{i}.src > e1.src" if i > 1 else "") for i in range(2, k + 1))
        distinct = "".join(f" AND e{i}.src <> e{j}.src" for i in range(2, k + 1) for j in range(i + 1, k + 1))
        cents = ", ".join(f"e{i}.cents" for i in range(1, k + 1))
        return f"""SELECT e1.token, e1.bucket, {k} AS size, concat({", '>', ".join(f"e{i}.src" for i in range(1, k + 1))}) AS ring, least({cents}) AS bottleneck, greatest({", ".join(f"e{i}.last_t" for i in range(1, k + 1))}) - least({", ".join(f"e{i}.first_t" for i in range(1, k + 1))}) AS span
          FROM {{trade_edges}} e1{joins} WHERE e{k}.dst = e1.src{distinct}"""

    return " UNION ALL ".join(of(k) for k in range(3, longest + 1))


def components(nodes: set, out: dict) -> list[set]:
    """Strongly connected components in one pass, linear in nodes and links: a node whose lowest reach is itself closes one."""
    order: dict = {}
    low, on, stack, parts = {}, set(), [], []
    for root in sorted(nodes):
        if root in order:
            continue
        todo = [(root, None)]
        while todo:
            node, links = todo.pop()
            if links is None:
                order[node] = low[node] = len(order)
                stack.append(node)
                on.add(node)
                links = iter(out.get(node, ()))
            for b in links:
                if b not in order:
                    todo += [(node, links), (b, None)]
                    break
                if b in on:
                    low[node] = min(low[node], low[b])
            else:
                if todo:  # the node from which this one was reached
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == order[node]:
                    part = set()
                    while node not in part:
                        part.add(stack.pop())
                    on -= part
                    parts.append(part)
    return parts


def elementary(edges: dict, longest: int = 5, cap: int | None = None) -> list[tuple]:
    """Elementary cycles of 2 to `longest` nodes in components of 3 nodes or more; at most `cap` of a component."""
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    back: dict = {}
    for a, bs in out.items():
        for b in bs:
            back.setdefault(b, set()).add(a)
    half, found = longest // 2, []
    for part in components({x for e in edges for x in e}, out):
        if len(part) < 3:
            continue
        n = 0
        for first in sorted(part):
            # what leads back to the first node in a few steps: the last steps of a path go nowhere else
            near, last = {first: 0}, {first}
            for steps in range(1, half + 1):
                last = {a for b in last for a in back.get(b, ()) if a in part and a > first and a not in near}
                near |= dict.fromkeys(last, steps)
            todo = [(first,)]
            while todo and (cap is None or n < cap):
                path = todo.pop()
                for b in sorted(out.get(path[-1], ()), reverse=True):
                    if b == first and len(path) > 1:
                        found.append(path)
                        n += 1
                    elif b in part and b > first and b not in path and len(path) < longest and (longest - len(path) > half or near.get(b, longest) <= longest - len(path)):
                        todo.append((*path, b))
    return found


def rings_exact(edges: DataFrame, longest: int = 5, cap: int | None = None) -> DataFrame:
    """The same per token and time bucket in one task each, with cycles of two inside larger components and an optional cap."""

    def find(g: pd.DataFrame) -> pd.DataFrame:
        known = {(r.src, r.dst): r for r in g.itertuples()}
        rows = []
        for path in elementary(known, longest, cap):
            es = [known[a, b] for a, b in zip(path, (*path[1:], path[0]), strict=True)]
            rows.append((g.token.iloc[0], int(g.bucket.iloc[0]), len(path), ">".join(path), min(e.cents for e in es), max(e.last_t for e in es) - min(e.first_t for e in es)))
        return pd.DataFrame(rows, columns=["token", "bucket", "size", "ring", "bottleneck", "span"])

    return edges.groupBy("token", "bucket").applyInPandas(find, "token string, bucket long, size int, ring string, bottleneck long, span long")


TEXTS = {
    "g01_funding_edges": lambda d: "SELECT chain, funder, wallet, total, n, first_t, last_t FROM {sol_edges}",
    "g02_edge_sums": lambda d: "SELECT from_address, to_address, CAST(sum(amount) AS BIGINT) AS total, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM {transfers} GROUP BY from_address, to_address",
    "g03_common_funders": lambda d: "SELECT chain, funder, time_bucket, amount_bucket, n, spread, first_wallet FROM {clusters}",
    "g04_cluster_ids": lambda d: "SELECT cluster_id, n FROM {clusters}",
    "g05_cluster_confidence": lambda d: "SELECT chain, wallet, cluster_id, confidence FROM {members}",
    "g06_common_funder_run": lambda d: "SELECT m.chain, m.cluster_id, m.funder, count(*) AS members, max(m.confidence) AS confidence FROM {members} m WHERE NOT EXISTS (SELECT 1 FROM {classes} c WHERE c.address = concat('c', substring(m.funder, 2)) AND c.kind = 'cex_hot_wallet') GROUP BY m.chain, m.cluster_id, m.funder",
    "g07_rings": rings,
    "g08_typed_edges": lambda d: """
      SELECT kind, count(*) AS n, count(DISTINCT src) AS sources FROM (SELECT 'funding' AS kind, funder AS src, wallet AS dst FROM {sol_edges} UNION ALL SELECT 'token_transfer', from_address, to_address FROM {transfers}
      UNION ALL SELECT 'deployer_of', deployer, token FROM {launches} UNION ALL SELECT 'authority_of', authority, mint FROM {instructions} WHERE kind = 'set_authority') AS x GROUP BY kind""",
    "g09_derived_edges": lambda d: """
      SELECT DISTINCT deployer AS src, CASE WHEN side = 0 THEN token ELSE concat('base', substring(deployer, 2)) END AS dst, 'deployer_of' AS kind FROM {launches} CROSS JOIN """ + d.rows("(0), (1)", "side"),
    "g10_labels": lambda d: f"""
      SELECT address, label, confidence FROM (SELECT address, kind AS label, confidence, age_days, row_number() OVER (PARTITION BY address ORDER BY confidence DESC, kind) AS nth FROM {{classes}} WHERE age_days <= 30
      UNION ALL SELECT DISTINCT deployer, 'deployer_eoa', CAST(0.8 AS DOUBLE), 0, 1 FROM {{launches}} WHERE t > {TRANSFERS_AS_OF - 900 * DAY}) AS x WHERE nth = 1""",
    "g11_co_clustered": lambda d: "SELECT chain, cluster_id, CAST(sum(n * (total - n)) / 2 AS BIGINT) AS pairs FROM (SELECT chain, cluster_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY chain, cluster_id) AS total FROM {members} GROUP BY chain, cluster_id, wallet) AS x GROUP BY chain, cluster_id HAVING count(*) > 1",
}
