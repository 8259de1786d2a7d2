"""The given tables as the views that the operators work on, and the same views as SQL text for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars by supplier, dates as ISO text: symbol, date, close, high, low, volume, amount, turnover_rate, risk_regime."""
    li = read(spark, sf_dir, "lineitem")
    cents = F.round(100 * F.col("l_extendedprice")).cast("long")
    price = cents / 100.0 / F.col("l_quantity")
    li = li.select(F.col("l_suppkey").alias("symbol"), F.trunc("l_shipdate", "week").alias("day"), cents.alias("cents"), F.col("l_quantity").cast("long").alias("q"), price.alias("p"))
    b = li.groupBy("symbol", "day").agg(F.sum("cents").alias("cents"), F.sum("q").alias("volume"), F.max("p").alias("high"), F.min("p").alias("low"))
    week = li.groupBy("day").agg(F.sum("q").alias("week_volume"))  # one row a week
    b = b.join(F.broadcast(week), "day").withColumns({"date": F.date_format("day", "yyyy-MM-dd"), "amount": F.col("cents") / 100.0, "turnover_rate": 100.0 * F.col("volume") / F.col("week_volume"), "wk": F.floor(F.datediff("day", F.lit("1990-01-01").cast("date")) / 7).cast("long")})
    return b.select("symbol", "date", (F.col("amount") / F.col("volume")).alias("close"), "high", "low", "volume", "amount", "turnover_rate", F.concat(F.lit("r"), (F.col("wk") % 5).cast("string")).alias("risk_regime"))


BARS = """
li AS (SELECT l_suppkey AS symbol, CAST(CAST(date_trunc('week', l_shipdate) AS DATE) AS VARCHAR) AS date, CAST(round(100*l_extendedprice) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS q,
  CAST(round(100*l_extendedprice) AS BIGINT) / 100.0::DOUBLE / l_quantity AS p FROM lineitem),
b0 AS (SELECT symbol, date, sum(cents)::BIGINT AS cents, sum(q)::BIGINT AS volume, max(p) AS high, min(p) AS low FROM li GROUP BY symbol, date),
bars AS (SELECT symbol, date, (cents/100.0::DOUBLE)/volume AS close, high, low, volume, cents/100.0::DOUBLE AS amount, 100.0::DOUBLE*volume/(sum(volume) OVER (PARTITION BY date))::DOUBLE AS turnover_rate,
  'r' || ((datediff('day', DATE '1990-01-01', date::DATE) // 7) % 5)::VARCHAR AS risk_regime FROM b0)"""


def benchmark_series(b: DataFrame) -> DataFrame:
    """date, bench: total amount by total volume of each week."""
    return b.groupBy("date").agg((F.round(F.sum("amount"), 2) / F.sum("volume")).alias("bench"))


BENCH = "bench AS (SELECT date, round(sum(amount), 2) / sum(volume) AS bench FROM bars GROUP BY date)"


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").cast("string").alias("sector"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot per event: symbol, session_id, ts_ms, snap (place in the session), last_price, cumulative_volume and a level table."""
    e = events(spark, sf_dir).withColumns({"session_id": F.to_date("ts"), "ts_ms": F.floor(F.unix_micros("ts") / 1000).cast("long")})
    w = Window.partitionBy("user_id", "session_id").orderBy("ts_ms", "event_id")
    return e.select(
        "event_id", F.col("user_id").alias("symbol"), "session_id", "ts_ms", (F.row_number().over(w) - 1).alias("snap"), (F.round(F.coalesce("value", F.lit(0.0)), 2) + 1).alias("last_price"),
        F.sum(F.col("event_id") % 97).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative_volume"),
    )


BOOK = """
ev AS (SELECT event_id, user_id AS symbol, CAST(ts AS DATE) AS session_id, epoch_us(ts) // 1000 AS ts_ms, value FROM events),
book AS (SELECT event_id, symbol, session_id, ts_ms, row_number() OVER w - 1 AS snap, round(coalesce(value, 0.0), 2) + 1 AS last_price, (sum(event_id % 97) OVER w)::BIGINT AS cumulative_volume
  FROM ev WINDOW w AS (PARTITION BY symbol, session_id ORDER BY ts_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def levels(snapshots: DataFrame) -> DataFrame:
    """Five levels on each side of every snapshot: side (1 bid, 2 ask), level, ticks (price in ticks of 0.01), volume."""
    sides = F.explode(F.array(F.lit(1), F.lit(2)))
    out = snapshots.withColumn("side", sides).withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(5))))
    last = F.round(F.col("last_price") * 100).cast("long")
    return out.withColumns({"ticks": F.when(F.col("side") == 1, last - F.col("level")).otherwise(last + F.col("level")), "volume": (F.col("event_id") * 7919 + F.col("level") * 104729 + F.col("side") * 31) % 5000})


LEVELS = """
levels AS (SELECT b.*, s.side, k.level, round(last_price*100)::BIGINT + CASE WHEN s.side = 1 THEN -k.level ELSE k.level END AS ticks, (event_id*7919 + k.level*104729 + s.side*31) % 5000 AS volume
  FROM book b, (SELECT unnest([1,2])::BIGINT AS side) s, (SELECT unnest(range(1,6)) AS level) k)"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option chain: one contract for each part; spot is the mean strike of the underlying."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    strike = F.round(F.col("p_retailprice") / 5).cast("long") * 5
    side = F.when(F.floor(k / 4) % 2 == 0, "C").otherwise("P")
    out = p.select(
        k.alias("contract_id"), F.col("p_brand").alias("underlying"), F.date_add(F.lit("2024-01-19").cast("date"), (28 * (k % 4)).cast("int")).alias("expiry"), side.alias("side"), strike.cast("double").alias("strike"),
        (10 * F.col("p_size")).cast("long").alias("open_interest"), (F.lit(0.10) + (k % 50) / 100.0).alias("iv"), (F.when(F.floor(k / 4) % 2 == 0, 1.0).otherwise(-1.0) * (k % 20) / 20.0).alias("delta"), (k % 300).alias("volume"),
        (F.lit(0.5) + (k % 80) / 10.0).alias("bid"), (F.lit(0.6) + (k % 80) / 10.0).alias("ask"),
    )
    spot = out.groupBy("underlying").agg(F.avg("strike").alias("spot"))
    return out.join(spot, "underlying")


CHAIN = """
ch0 AS (SELECT p_partkey AS contract_id, p_brand AS underlying, DATE '2024-01-19' + (28 * (p_partkey % 4))::INT AS expiry, CASE WHEN (p_partkey // 4) % 2 = 0 THEN 'C' ELSE 'P' END AS side, (round(p_retailprice/5)::BIGINT*5)::DOUBLE AS strike,
  (10*p_size)::BIGINT AS open_interest, 0.10::DOUBLE + (p_partkey % 50)/100.0::DOUBLE AS iv, (CASE WHEN (p_partkey // 4) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE * (p_partkey % 20) / 20.0::DOUBLE AS delta, (p_partkey % 300) AS volume,
  0.5::DOUBLE + (p_partkey % 80)/10.0::DOUBLE AS bid, 0.6::DOUBLE + (p_partkey % 80)/10.0::DOUBLE AS ask FROM part),
chain AS (SELECT *, avg(strike) OVER (PARTITION BY underlying) AS spot FROM ch0)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    directions = F.array(*[F.lit(x) for x in ("long", "short", "watch", "avoid", "reduce")])
    return o.select(
        F.col("o_orderkey").alias("decision_id"), F.col("o_custkey").alias("symbol"), F.col("o_orderdate").alias("analysis_time"), F.concat(F.lit("L"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("string")).alias("action_level"),
        F.get(directions, (F.col("o_orderkey") % 5).cast("int")).alias("direction"), F.concat(F.lit("m"), (F.month("o_orderdate") % 5).cast("string")).alias("regime"),
        ((F.round(F.col("o_totalprice") * 100).cast("long") % 1000) / 1000.0).alias("predicted"), F.col("o_totalprice").alias("entry_price"),
    )


DECISIONS = """
decisions AS (SELECT o_orderkey AS decision_id, o_custkey AS symbol, o_orderdate AS analysis_time, 'L' || (substr(o_orderpriority, 1, 1)::INT - 1)::VARCHAR AS action_level,
  ['long','short','watch','avoid','reduce'][1 + (o_orderkey % 5)] AS direction, 'm' || (month(o_orderdate) % 5)::VARCHAR AS regime,
  (round(o_totalprice*100)::BIGINT % 1000)/1000.0::DOUBLE AS predicted, o_totalprice AS entry_price FROM orders)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result per decision that has line items: return_pct in basis points of whole numbers, so every engine agrees."""
    li = read(spark, sf_dir, "lineitem")
    bp = lambda c: F.sum(F.round(F.col(c) * 10000).cast("long"))
    return li.groupBy(F.col("l_orderkey").alias("decision_id")).agg(
        ((bp("l_discount") - bp("l_tax")) / 100.0 / F.count("*")).alias("return_pct"), F.max("l_shipdate").alias("validation_time"), F.array_sort(F.collect_set("l_returnflag")).alias("failure_tags")
    )


RESULTS = """
results AS (SELECT l_orderkey AS decision_id, (sum(round(l_discount*10000)::BIGINT) - sum(round(l_tax*10000)::BIGINT))::BIGINT / 100.0::DOUBLE / count(*) AS return_pct,
  max(l_shipdate) AS validation_time, list_sort(list_distinct(list(l_returnflag))) AS failure_tags FROM lineitem GROUP BY l_orderkey)"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade journal per supplier: opens and closes in event order (pos)."""
    li = read(spark, sf_dir, "lineitem")
    cents = F.round(100 * F.col("l_extendedprice")).cast("long")
    order = ("l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "cents", "q")
    j = li.select(F.col("l_suppkey").alias("symbol"), "l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", cents.alias("cents"), F.col("l_quantity").cast("long").alias("q"), F.when(F.col("l_linestatus") == "O", "open").otherwise("close").alias("kind"))
    return j.withColumn("pos", F.row_number().over(Window.partitionBy("symbol").orderBy(*order, "kind"))).select("symbol", "pos", "kind", "q", "cents", F.col("l_shipdate").alias("ts"))


JOURNAL = """
journal AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts, l_orderkey, l_partkey, l_linenumber, cents, q, kind) AS pos, kind, q, cents, ts FROM (
  SELECT l_suppkey AS symbol, l_shipdate AS ts, l_orderkey, l_partkey, l_linenumber, round(100*l_extendedprice)::BIGINT AS cents, l_quantity::BIGINT AS q, CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'close' END AS kind FROM lineitem))"""


#: Columns of a short cycle's checkpoint, made from an order's key in the expressions that Spark and the checks share.
CHECKPOINT = {
    "direction": "CASE WHEN k % 5 < 3 THEN 'long' ELSE 'short' END", "market_scope": "CASE WHEN k % 10 < 8 THEN 'US_only' ELSE 'HK' END",
    "checkpoint": "CASE k % 4 WHEN 0 THEN 'open_0940' WHEN 1 THEN 'pre_open' WHEN 2 THEN 'open_0940' ELSE CASE WHEN k % 8 = 3 THEN 'eod_review' ELSE 'close' END END",
    "action_cap": "CASE k % 6 WHEN 0 THEN 'L0' WHEN 1 THEN 'L1' WHEN 2 THEN 'L2' WHEN 3 THEN 'L3' WHEN 4 THEN 'L3' ELSE 'none' END", "thesis_valid": "k % 7 <> 0", "pre_open_status": "CASE WHEN k % 11 = 0 THEN 'weak' ELSE 'ok' END",
    "spot": "CAST(100 + k % 40 AS DOUBLE)", "put_wall": "CAST(105 + k % 7 AS DOUBLE)", "gamma_flip": "CASE WHEN k % 29 <> 0 THEN CAST(112 + k % 5 AS DOUBLE) END", "call_wall": "CAST(120 + k % 11 - CASE WHEN k % 37 = 0 THEN 30 ELSE 0 END AS DOUBLE)",
    "net_gex": "CAST(k % 9 - 4 AS DOUBLE)", "vrp": "CASE WHEN k % 43 <> 0 THEN CAST(k % 5 - 2 AS DOUBLE) END", "gamma_age": "CASE WHEN k % 47 <> 0 THEN CAST(k % 50 * 30 AS DOUBLE) END",
    "option_session": "CASE WHEN k % 3 <> 0 THEN 'RTH' ELSE 'ETH' END", "expiry_scope": "CASE WHEN k % 2 = 0 THEN '0DTE' ELSE 'far' END",
    "bid": "CAST(k % 20 AS DOUBLE)", "ask": "CAST(k % 20 AS DOUBLE) + CAST(k % 4 AS DOUBLE) / 4 - CASE WHEN k % 53 = 0 THEN 2 ELSE 0 END", "side": "CASE WHEN k % 31 = 0 THEN 'hold' WHEN k % 2 = 0 THEN 'buy' ELSE 'sell' END",
    "order_type": "CASE WHEN k % 59 = 0 THEN 'odd' WHEN k % 3 = 0 THEN 'market' WHEN k % 3 = 1 THEN 'limit' ELSE 'limit_mid' END", "ask_size": "CAST(k % 15 + 2 AS DOUBLE)", "bid_size": "CAST(k % 12 + 3 AS DOUBLE)", "quote_age": "CASE WHEN k % 61 <> 0 THEN CAST(k % 7 AS DOUBLE) END",
    "contracts": "CAST(k % 6 AS DOUBLE)", "expected_edge_bps": "CASE WHEN k % 23 <> 0 THEN CAST(k % 700 AS DOUBLE) END", "slippage_bps": "CAST(k % 5 AS DOUBLE)", "fees_bps": "CASE WHEN k % 3 = 0 THEN 1.5E0 END", "volume": "CAST(k % 10 AS DOUBLE)",
    "last": "CAST(90 + k % 21 AS DOUBLE)", "previous_close": "CASE WHEN k % 17 <> 0 THEN CAST(95 + k % 11 AS DOUBLE) END", "vwap": "CASE WHEN k % 19 <> 0 THEN CAST(93 + k % 13 AS DOUBLE) END", "range_high": "CAST(100 + k % 3 AS DOUBLE)",
    "range_low": "CAST(92 - k % 4 + CASE WHEN k % 41 = 0 THEN 20 ELSE 0 END AS DOUBLE)", "relative_volume": "CAST(k % 20 AS DOUBLE) / 10", "breadth": "k % 2 = 0", "sector": "CASE WHEN k % 13 <> 0 THEN k % 3 <> 0 END",
    "entry_price": "CAST(100 + k % 9 AS DOUBLE)", "open_price": "CAST(101 + k % 8 AS DOUBLE)", "price_0940": "CASE WHEN k % 14 <> 0 THEN CAST(99 + k % 12 AS DOUBLE) END", "close_price": "CAST(98 + k % 15 AS DOUBLE)", "exit_price": "CASE WHEN k % 16 <> 0 THEN CAST(97 + k % 16 AS DOUBLE) END",
    "estimated_cost_bps": "CAST(k % 6 AS DOUBLE)", "realized_cost_bps": "CASE WHEN k % 18 <> 0 THEN CAST(k % 9 AS DOUBLE) END",
}


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One checkpoint of a short cycle for each order."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).select("k", *[F.expr(e).alias(c) for c, e in CHECKPOINT.items()])


CHECKPOINTS = "cpk AS (SELECT o_orderkey AS k FROM orders), cp AS (SELECT k, " + ", ".join(f'{e} AS "{c}"' for c, e in CHECKPOINT.items()) + " FROM cpk)"


#: An order log by supplier: opens and exits in event order, with voids, heals, repeats and closes without evidence among them.
ORDER_LOG = {
    "order_id": "CAST(pos AS STRING)", "side": "CASE WHEN kind = 'open' THEN CASE WHEN pos % 3 = 0 THEN 'BUY' ELSE 'long' END WHEN pos % 17 = 0 THEN NULL WHEN pos % 2 = 0 THEN 'sell' ELSE 'Exit' END",
    "status": "CASE WHEN kind = 'open' THEN CASE WHEN pos % 19 = 0 THEN 'reconciliation_void' WHEN pos % 2 = 0 THEN 'open' ELSE 'Filled_Open' END WHEN pos % 17 = 0 THEN 'closed_unreconciled' WHEN pos % 23 = 0 THEN 'closed' ELSE 'partial_closed' END",
    "voids_order_id": "CASE WHEN kind = 'open' AND pos % 19 = 0 THEN CAST(pos - 1 AS STRING) END", "fill_confirmed": "pos % 38 = 18", "quantity": "CAST(q AS DOUBLE)", "r": "CASE WHEN pos % 7 <> 0 THEN CAST(cents % 500 - 240 AS DOUBLE) / 100 END", "ret": "CAST(cents % 700 - 340 AS DOUBLE) / 100",
}


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = journal(spark, sf_dir)
    return j.select("symbol", F.col("pos").alias("seq"), "ts", F.lit(None).cast("string").alias("lifecycle"), "kind", *[F.expr(e).alias(c) for c, e in ORDER_LOG.items()])
