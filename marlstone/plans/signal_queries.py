"""Smaller signals over the given tables, and the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import signals as sg
from marlstone.sources.bindings import BARS, BOOK, DECISIONS, bars, book, decisions, events, read

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("WITH r AS (SELECT l_orderkey AS k, l_linestatus AS side, l_linenumber AS price, l_quantity AS volume, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_quantity) AS n FROM lineitem), a AS (SELECT k, coalesce(sum(price * volume) FILTER (side = 'O' AND n <= 5), 0) AS b, coalesce(sum(price * volume) FILTER (side = 'F' AND n <= 5), 0) AS s FROM r GROUP BY 1) SELECT k, b + s AS depth, round((b - s) / nullif(b + s, 0), 6) AS imbalance FROM a")
def f14_book_depth(spark, sf_dir):
    """The lines of an order as the levels of its book; the first five of each side count."""
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("l_linestatus") == s, F.struct(F.col("l_linenumber").cast("double").alias("price"), F.col("l_quantity").alias("volume")))))
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(side("O").alias("b"), side("F").alias("s"))
    depth, imbalance = sg.book_depth(F.col("b"), F.col("s"), 5)
    return g.select("k", depth.alias("depth"), F.round(imbalance, 6).alias("imbalance"))


@query("SELECT user_id, CASE WHEN count(*) >= 2 THEN round(arg_max(value, ts) - arg_min(value, ts), 6) END AS delta FROM events WHERE value IS NOT NULL GROUP BY user_id")
def f15_history_delta(spark, sf_dir):
    return sg.change_over(events(spark, sf_dir), "user_id", "ts", "value").select("user_id", F.round("delta", 6).alias("delta"))


@query("SELECT p_partkey, round(1 - CASE WHEN p_size * 50 < 1000 THEN 0.3 ELSE 0 END - CASE WHEN (p_partkey % 10) / 100.0 > 0.05 THEN 0.25 ELSE 0 END - CASE WHEN p_partkey % 40 > 24 THEN 0.25 ELSE 0 END, 6)::DOUBLE AS reliability FROM part")
def f16_reliability(spark, sf_dir):
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", F.round(sg.reliability(F.col("p_size") * 50, (k % 10) / 100.0, k % 40), 6).alias("reliability"))


@query(f"WITH {BARS}, n AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM bars WHERE volume % 5 <> 0) SELECT symbol, round(max(close) FILTER (n = 1) / max(close) FILTER (n = 2) - 1, 6) AS r1, round(max(close) FILTER (n = 1) / max(close) FILTER (n = 5) - 1, 6) AS r4 FROM n WHERE n <= 5 GROUP BY symbol")
def f17_completed_bars(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    x = bars(spark, sf_dir).where("volume % 5 <> 0").withColumn("n", F.row_number().over(w)).where("n <= 5")
    at = lambda k: F.max(F.when(F.col("n") == k, F.col("close")))
    return x.groupBy("symbol").agg(F.round(at(1) / at(2) - 1, 6).alias("r1"), F.round(at(1) / at(5) - 1, 6).alias("r4"))


@query(f"WITH {BOOK}, l AS (SELECT *, round(last_price*100)::BIGINT % 7 AS t, 3 AS lim, event_id % 1000 AS seal FROM book), p AS (SELECT *, lag(t) OVER w AS pt, lag(seal) OVER w AS ps FROM l WINDOW w AS (PARTITION BY symbol, session_id ORDER BY snap)), f AS (SELECT event_id, t, greatest(ps - CASE WHEN t = lim THEN seal ELSE 0 END, 0) / ps::DOUBLE AS fell, t < lim AS opened FROM p WHERE pt = lim AND ps > 0) SELECT event_id, opened OR fell >= 0.5 AS fired, round(greatest(fell, CASE WHEN opened THEN 1.0 ELSE 0.0 END), 6) AS strength FROM f")
def m08_limit_leak(spark, sf_dir):
    b = book(spark, sf_dir)
    x = b.select("symbol", "session_id", "snap", (F.round(F.col("last_price") * 100).cast("long") % 7).alias("ticks"), F.lit(3).cast("long").alias("limit_ticks"), (F.col("event_id") % 1000).alias("seal"))
    return sg.limit_leak(x).join(b.select("symbol", "session_id", "snap", "event_id"), ["symbol", "session_id", "snap"]).select("event_id", "fired", F.round("strength", 6).alias("strength"))


@query(f"WITH {BARS}, b AS (SELECT symbol, date, close, lag(close) OVER w AS p, lead(close) OVER w AS n, row_number() OVER w AS i FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)) SELECT symbol, count(*) AS events, round(median(abs(100 * (CASE WHEN i % 2 = 0 THEN n / close ELSE close / p END - 1))), 5) AS median_move FROM b GROUP BY symbol")
def w18_session_moves(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("date")
    b = bars(spark, sf_dir)
    e = b.select("symbol", "date", F.row_number().over(w).alias("i")).select("symbol", F.col("date").alias("event_date"), F.concat_ws("-", "symbol", "date").alias("event_id"), F.when(F.col("i") % 2 == 0, "after_close").otherwise("before_open").alias("session"))
    return sg.session_moves(e, b).groupBy("symbol").agg(F.count("*").alias("events"), F.round(F.percentile("move_pct", F.lit(0.5)), 5).alias("median_move"))


CROSS = "m AS (SELECT user_id, median(value) AS th FROM events GROUP BY user_id), q AS (SELECT e.user_id, ts, value, event_id, lag(value) OVER (PARTITION BY e.user_id ORDER BY ts, event_id) AS p, th FROM events e JOIN m ON m.user_id = e.user_id), h AS (SELECT user_id, epoch_us(ts) AS t FROM q WHERE p < th AND value >= th)"


@query(f"WITH RECURSIVE {CROSS}, g AS (SELECT user_id, min(t) AS t FROM h GROUP BY user_id UNION ALL SELECT g.user_id, (SELECT min(h.t) FROM h WHERE h.user_id = g.user_id AND h.t - g.t >= 86400000000) FROM g WHERE g.t IS NOT NULL) SELECT user_id AS trigger_id, t::BIGINT AS at_us FROM g WHERE t IS NOT NULL")
def r01_watch_triggers(spark, sf_dir):
    e = events(spark, sf_dir)
    t = e.groupBy("user_id").agg(F.percentile("value", F.lit(0.5)).alias("threshold")).select(F.col("user_id").alias("symbol"), F.col("user_id").alias("trigger_id"), "threshold")
    return sg.crossings(e.select(F.col("user_id").alias("symbol"), "event_id", "ts", F.col("value").alias("price")), t, 86_400)


@query(f"WITH {DECISIONS}, r AS (SELECT * FROM (VALUES ('long', 'trend', 3.0, false), ('long', 'value', 2.0, false), ('long', 'hedge', 1.0, true), ('short', 'trend', 1.0, false), ('short', 'hedge', 2.0, true)) t(direction, method, w, d)), x AS (SELECT decision_id, method, CASE WHEN regime = 'm1' AND d THEN w * 1.5 ELSE w END AS w FROM decisions JOIN r USING (direction)) SELECT decision_id, method, round(w / sum(w) OVER (PARTITION BY decision_id), 6)::DOUBLE AS share FROM x")
def l12_method_weights(spark, sf_dir):
    rules = spark.createDataFrame([("long", "trend", 3.0, False), ("long", "value", 2.0, False), ("long", "hedge", 1.0, True), ("short", "trend", 1.0, False), ("short", "hedge", 2.0, True)], "scenario string, method string, weight double, defensive boolean")
    s = decisions(spark, sf_dir).select(F.col("decision_id").alias("subject"), F.col("direction").alias("scenario"), "regime")
    return sg.method_weights(s, rules, F.col("regime") == "m1").select(F.col("subject").alias("decision_id"), "method", F.round("share", 6).alias("share"))


@query("WITH t AS (SELECT l_orderkey AS id, count(*) AS k, any_value(l_returnflag || l_linestatus) AS p, any_value(round(l_discount*10000)::BIGINT - round(l_tax*10000)::BIGINT - 150) AS r FROM lineitem GROUP BY 1 HAVING count(*) = 1) SELECT p AS pattern, count(*) AS n, round(avg(r), 4) AS mean_r, count(*) FILTER (id % 3 <> 0) AS fresh, CASE WHEN count(*) FILTER (id % 3 <> 0) = 0 THEN 'known' WHEN count(*) FILTER (id % 3 <> 0) = count(*) THEN 'new' ELSE 'extended' END AS novelty FROM t GROUP BY p HAVING avg(r) < 0")
def a24_learning_triage(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    t = li.select(F.col("l_orderkey").alias("trade_id"), F.concat("l_returnflag", "l_linestatus").alias("pattern"), (F.round(F.col("l_discount") * 10000).cast("long") - F.round(F.col("l_tax") * 10000).cast("long") - 150).alias("r"))
    seen = read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("trade_id"))
    seen = seen.unionByName(t.where("trade_id % 3 = 0").select("trade_id"))
    return sg.triage(t, seen).select("pattern", "n", F.round("mean_r", 4).alias("mean_r"), "fresh", "novelty")


@query(f"WITH {DECISIONS}, b AS (SELECT symbol, arg_max(direction, decision_id) AS direction, max(decision_id) AS v FROM decisions WHERE decision_id % 2 = 0 GROUP BY symbol), c AS (SELECT symbol, arg_max(direction, decision_id) AS direction, max(decision_id) AS v FROM decisions WHERE decision_id % 2 = 1 GROUP BY symbol) SELECT * FROM c UNION ALL SELECT * FROM b WHERE symbol NOT IN (SELECT symbol FROM c)")
def x13_keyed_upsert(spark, sf_dir):
    d = decisions(spark, sf_dir).select("symbol", "direction", F.col("decision_id").alias("v"))
    table = d.where("v % 2 = 0").groupBy("symbol").agg(F.max_by("direction", "v").alias("direction"), F.max("v").alias("v"))
    return sg.upsert(table, d.where("v % 2 = 1"), "symbol", "v")


@query("WITH f AS (SELECT l_suppkey AS entity, 'q' || (l_linenumber % 3)::VARCHAR AS field, CASE WHEN l_returnflag = 'A' THEN 'gaap' WHEN l_returnflag = 'N' THEN 'ifrs' ELSE 'other' END AS tag, l_quantity AS value, l_shipdate AS filed FROM lineitem) SELECT entity, field, tag, value, filed::DATE::VARCHAR AS filed FROM f QUALIFY row_number() OVER (PARTITION BY entity, field ORDER BY CASE tag WHEN 'gaap' THEN 0 WHEN 'ifrs' THEN 1 ELSE 99 END, filed DESC, value DESC) = 1")
def s16_latest_facts(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    tag = F.when(F.col("l_returnflag") == "A", "gaap").when(F.col("l_returnflag") == "N", "ifrs").otherwise("other")
    f = li.select(F.col("l_suppkey").alias("entity"), F.concat(F.lit("q"), (F.col("l_linenumber") % 3).cast("string")).alias("field"), tag.alias("tag"), F.col("l_quantity").alias("value"), F.col("l_shipdate").alias("filed"))
    return sg.latest_facts(f, {"gaap": 0, "ifrs": 1}).withColumn("filed", F.date_format("filed", "yyyy-MM-dd"))
