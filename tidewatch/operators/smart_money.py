"""Smart-money pipeline (M): trade legs, FIFO round trips, wallet statistics, tiers and labels."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import Dialect, Tables
from ..plans.views import DAY, SWAPS_AS_OF, exact_sum


FIFO = pa.schema([("wallet", pa.string()), ("token", pa.string()), *[(c, pa.int64()) for c in ("buy_t", "sell_t", "sell_seq", "qty")], ("pnl", pa.float64()), ("held", pa.int64())])


def fifo(legs: DataFrame) -> DataFrame:
    """Exact lot matching per wallet and token in one ordered pass: a sell takes the oldest lots; without inventory it is dropped.

    A partition holds its wallets' legs in order and streams them; only the open lots of one wallet and token are kept."""

    def match(batches):
        key, lots = None, deque()
        for b in batches:
            rows = []
            for wallet, token, leg, t, seq, cents, qty in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (wallet, token) != key:
                    key, lots = (wallet, token), deque()
                if leg == "buy":
                    lots.append([qty, cents / qty, t])
                    continue
                left = qty
                while left and lots:
                    lot = lots[0]
                    n = min(left, lot[0])
                    rows.append((wallet, token, lot[2], t, seq, n, (cents / qty - lot[1]) * n / 100, t - lot[2]))
                    left -= n
                    lot[0] -= n
                    if not lot[0]:
                        lots.popleft()
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FIFO, strict=True)], schema=FIFO)

    keys = ["wallet", "token"]
    ordered = legs.repartition(*keys).sortWithinPartitions(*keys, *[F.col(c).asc_nulls_last() for c in ("t", "tx_hash", "leg")])
    whole = [F.col(c).cast("long").alias(c) for c in ("t", "seq", "cents", "qty")]
    return ordered.select(*keys, "leg", *whole).mapInArrow(match, "wallet string, token string, buy_t long, sell_t long, sell_seq long, qty long, pnl double, held long")


def fifo_summary(d: Dialect) -> str:
    return "SELECT wallet, token, buy_t, sell_t, sell_seq, qty, round(pnl, 4) AS pnl, held FROM {trips}"


#: How long a label counts, in seconds: 720 hours.
LABEL_TTL = 720 * 3600


def labels_as_of(asks: DataFrame, labels: DataFrame, width: int = LABEL_TTL) -> DataFrame:
    """asks (address, observed_at and others) with label and confidence of the surest label that was issued before and had not expired
    then; ties go to the later issued, then to the lesser label, and null says that there was none. labels: address, label,
    confidence, issued_at, expires_at (null: never).

    Both meet by address and time bin. A label lies in the bins from its issue to its end, or to the last time that is asked for."""
    last = asks.agg(F.max("observed_at")).first()[0]
    end = F.least(F.coalesce("expires_at", F.lit(last)), F.lit(last))
    place = lambda t: F.floor(t / width)
    held = labels.where(F.col("issued_at") < end).withColumn("bin", F.explode(F.sequence(place(F.col("issued_at")), place(end))))
    times = asks.select("address", "observed_at").distinct().withColumn("bin", place(F.col("observed_at")))
    met = times.join(held, ["address", "bin"]).where("issued_at < observed_at AND (expires_at IS NULL OR observed_at < expires_at)")
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("issued_at")).alias("i"), "label")).alias("b")
    known = met.groupBy("address", "observed_at").agg(best).select("address", "observed_at", "b.label", (-F.col("b.c")).alias("confidence"))
    return asks.join(known, ["address", "observed_at"], "left").select(*[c for c in asks.columns], "label", "confidence")


#: On the derived tables labels come from sales at a profit and last two days.
SHORT_TTL = 2 * DAY


def labelled_buys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: buys by wallets that had an unexpired label when they bought, by token."""
    t = Tables(spark, sf_dir)
    labels = t("trips").where("pnl > 0").select(F.col("wallet").alias("address"), F.lit("smart_money").alias("label"), (F.lit(50) + F.col("qty") % 50).cast("long").alias("confidence"), F.col("sell_t").alias("issued_at"), (F.col("sell_t") + SHORT_TTL).alias("expires_at"))
    buys = t("legs").where("leg = 'buy'").select(F.col("wallet").alias("address"), F.col("t").alias("observed_at"), "token")
    got = labels_as_of(buys, labels, SHORT_TTL)
    return got.groupBy("token").agg(F.count(F.lit(1)).alias("buys"), F.count("label").alias("labelled"), F.coalesce(F.sum("confidence"), F.lit(0)).alias("points"))


def labelled_text(d: Dialect) -> str:
    return f"""
    WITH s AS (SELECT wallet, sell_t, max(50 + qty % 50) AS confidence FROM {{trips}} WHERE pnl > 0 GROUP BY wallet, sell_t),
    b AS (SELECT row_number() OVER (ORDER BY wallet, token, t) AS no, wallet, token, t FROM {{legs}} WHERE leg = 'buy'),
    m AS (SELECT b.no, max(s.confidence) AS confidence FROM b JOIN s ON b.wallet = s.wallet AND s.sell_t < b.t AND b.t < s.sell_t + {SHORT_TTL} GROUP BY b.no)
    SELECT token, count(*) AS buys, count(confidence) AS labelled, CAST(coalesce(sum(confidence), 0) AS BIGINT) AS points FROM b LEFT JOIN m ON b.no = m.no GROUP BY token"""


def corpus_rows(d: Dialect) -> str:
    """M7: what is kept of a wallet: its ten best tokens and a row `_aggregate_` over all of its tokens, as long as its label lasts."""
    return f"""
    WITH x AS (SELECT wallet, token, count(*) AS trips, {exact_sum("pnl")} AS pnl, max(sell_t) AS last_t FROM {{trips}} GROUP BY wallet, token),
    w AS (SELECT wallet, sum(trips) AS trips, {exact_sum("pnl")} AS pnl, max(last_t) AS last_t FROM x GROUP BY wallet),
    r AS (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY pnl DESC, token) AS nth FROM x)
    SELECT wallet, token, CAST(trips AS BIGINT) AS trips, round(pnl, 4) AS pnl, last_t + {LABEL_TTL} AS expires_t FROM (SELECT wallet, token, trips, pnl, last_t FROM r WHERE nth <= 10 UNION ALL SELECT wallet, '_aggregate_', trips, pnl, last_t FROM w) AS y
    WHERE last_t + {LABEL_TTL} > {SWAPS_AS_OF} AND NOT EXISTS (SELECT 1 FROM {{classes}} c WHERE c.address = concat('c', substring(y.wallet, 2)) AND c.kind IN ('cex_hot_wallet', 'dex_pool'))"""


TEXTS = {
    "m01_legs": lambda d: "SELECT wallet, token, leg, t, tx_hash, cents, qty FROM {legs}",
    "m02_fifo_overlap": fifo_summary,
    "m03_win_rate": lambda d: "SELECT wallet, trips, round(win_rate, 6) AS win_rate, round(held, 2) AS held FROM {wallet_stats}",
    "m04_recurrence": lambda d: "SELECT wallet, events, coalesce(lead_s, -1) AS lead_s, round(timing, 6) AS timing FROM {wallet_stats}",
    "m05_tiers": lambda d: "SELECT wallet, tier, trips FROM {smart_wallets}",
    "m06_label_confidence": lambda d: "SELECT wallet, tier, round(confidence, 5) AS confidence FROM {smart_wallets}",
    "m07_corpus": lambda d: f"""
      SELECT w.wallet, coalesce(s.tier, 0) AS tier, w.trips, round(w.pnl, 4) AS pnl, t.token AS best_token FROM {{wallet_stats}} w LEFT JOIN {{smart_wallets}} s ON w.wallet = s.wallet LEFT JOIN (SELECT wallet, token, row_number() OVER (PARTITION BY wallet ORDER BY pnl DESC, token) AS nth FROM
      (SELECT wallet, token, {exact_sum('pnl')} AS pnl FROM {{trips}} GROUP BY wallet, token) AS x) AS t ON w.wallet = t.wallet AND t.nth = 1 WHERE NOT EXISTS (SELECT 1 FROM {{classes}} c WHERE c.address = concat('c', substring(w.wallet, 2)) AND c.kind IN ('cex_hot_wallet', 'dex_pool'))""",
    "m07_corpus_rows": corpus_rows,
    "m08_smart_buyers": lambda d: "SELECT l.token, sum(CASE WHEN s.tier = 1 THEN 1 ELSE 0 END) > 0 AS any_tier1, count(DISTINCT CASE WHEN s.tier <= 2 THEN l.wallet END) AS smart FROM {legs} l JOIN {smart_wallets} s ON l.wallet = s.wallet WHERE l.leg = 'buy' GROUP BY l.token",
}
