"""Row rules and small grouped jobs over the given tables, and the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import numeric as nm
from marlstone.operators import factors as fx
from marlstone.operators import market as mk
from marlstone.operators import dislocation as ds
from marlstone.operators import rules as rl
from marlstone.sources.bindings import BARS, BENCH, BOOK, DECISIONS, LEVELS, bars, benchmark_series, book, decisions, events, levels, read

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT event_id, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN NULL ELSE round(value, 6) END AS v FROM events")
def p01_finite(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.round(nm.finite(F.col("value")), 6).alias("v"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN p_size::DOUBLE WHEN 2 THEN NULL ELSE p_size + 0.5 END::DOUBLE AS v FROM part")
def p02_parsed_numbers(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 4 == 0, F.concat(s.cast("string"), F.lit(",000"))).when(k % 4 == 1, F.concat(s.cast("string"), F.lit("%"))).when(k % 4 == 2, "-").otherwise(F.concat(F.lit(" "), (s + 0.5).cast("string")))
    return read(spark, sf_dir, "part").select("p_partkey", nm.parse_number(text).alias("v"))


@query("WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 5 = 4 THEN 'blocked' WHEN dayofweek(d) IN (0, 6) THEN 'degraded' ELSE 'pass' END AS state FROM d")
def p05_alignment(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    target = F.when(k % 9 == 0, "soon").when(k % 2 == 0, F.date_format(d, "yyyyMMdd")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    observed = F.date_format(F.date_add(d, F.when(k % 5 == 4, -1).otherwise(0)), "yyyy/MM/dd")
    return read(spark, sf_dir, "orders").select("o_orderkey", rl.alignment(F.date_format(F.date_add(d, 1), "yyyy-MM-dd"), target, observed).alias("state"))


@query(f"WITH {BARS}, x AS (SELECT symbol, date, CASE WHEN volume % 11 = 0 THEN close * 100 WHEN volume % 13 = 0 THEN close / 100 ELSE close END AS close, high, CASE WHEN volume % 17 = 0 THEN -low ELSE low END AS low, volume FROM bars) SELECT symbol, date, 'close_out_of_range' AS code FROM x WHERE close > high + 1e-9 OR close < low - 1e-9 UNION ALL SELECT symbol, date, 'not_positive' FROM x WHERE low <= 0 UNION ALL SELECT symbol, date, 'date_repeats' FROM x WHERE volume % 19 = 0 UNION ALL SELECT symbol, date, 'close_out_of_range' FROM x WHERE volume % 19 = 0 AND (close > high + 1e-9 OR close < low - 1e-9) UNION ALL SELECT symbol, date, 'not_positive' FROM x WHERE volume % 19 = 0 AND low <= 0")
def p08_bar_errors(spark, sf_dir):
    """Bars that break each rule: closes moved out of their range, lows turned negative, rows that repeat."""
    v = F.col("volume")
    x = bars(spark, sf_dir).withColumns({"close": F.when(v % 11 == 0, F.col("close") * 100).when(v % 13 == 0, F.col("close") / 100).otherwise(F.col("close")), "low": F.when(v % 17 == 0, -F.col("low")).otherwise(F.col("low"))})
    return rl.bar_errors(x.unionByName(x.where("volume % 19 = 0")))


@query(f"WITH {BARS}, s AS (SELECT symbol, min(date) AS a, max(date) AS b FROM bars GROUP BY symbol), c AS (SELECT DISTINCT date FROM bars) SELECT s.symbol, c.date FROM s JOIN c ON c.date BETWEEN a AND b ANTI JOIN bars ON bars.symbol = s.symbol AND bars.date = c.date")
def p08_missing_sessions(spark, sf_dir):
    b = bars(spark, sf_dir)
    return rl.missing_sessions(b, b.select("date"))


@query(f"WITH {DECISIONS} SELECT decision_id FROM decisions WHERE direction IN ('long', 'short') AND contains(regime || ' ' || action_level || ' ' || direction, 'm3 L1')")
def p09_status_search(spark, sf_dir):
    d = decisions(spark, sf_dir)
    return d.where(F.col("direction").isin("long", "short") & F.concat_ws(" ", "regime", "action_level", "direction").contains("m3 L1")).select("decision_id")


@query(f"WITH {DECISIONS}, m AS (SELECT max(analysis_time) AS t FROM decisions) SELECT decision_id FROM decisions, m WHERE analysis_time < t - INTERVAL 365 DAY AND direction <> 'avoid'")
def p10_stale_rows(spark, sf_dir):
    d = decisions(spark, sf_dir)
    top = d.agg(F.max("analysis_time")).first()[0]
    return d.where((F.col("analysis_time") < F.lit(top) - F.make_interval(days=F.lit(365))) & (F.col("direction") != "avoid")).select("decision_id")


@query("WITH n AS (SELECT max(ts) - INTERVAL 2 HOUR AS now FROM events), g AS (SELECT user_id, max(ts) AS last, arg_max(value, ts) FILTER (value IS NOT NULL) AS last_good FROM events GROUP BY user_id), a AS (SELECT *, floor(epoch(now))::BIGINT - floor(epoch(last))::BIGINT AS age FROM g, n) SELECT user_id, age, last_good, CASE WHEN age < 0 THEN 'future_clock' WHEN age > 21600 THEN 'stale' ELSE 'ok' END AS state FROM a")
def p11_feed_health(spark, sf_dir):
    e = events(spark, sf_dir)
    now = e.agg(F.max("ts") - F.expr("INTERVAL 2 HOURS")).first()[0]
    return rl.feed_health(e, "user_id", F.lit(now), 21_600)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 5 END AS n FROM events")
def p15_tick_grid(spark, sf_dir):
    k = F.col("event_id")
    return events(spark, sf_dir).select("event_id", rl.ticks((k * 5).cast("decimal(18,6)") * F.lit("0.01").cast("decimal(4,2)") + F.when(k % 3 == 0, F.lit("0.004").cast("decimal(6,4)")).otherwise(F.lit("0").cast("decimal(6,4)")), "0.01").alias("n"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN round(o_totalprice, 2) WHEN 1 THEN round(o_totalprice * 10000, 2) WHEN 2 THEN round(o_totalprice * 100000000, 2) END AS value FROM orders")
def p18_unit_values(spark, sf_dir):
    k = F.col("o_orderkey")
    unit = F.when(k % 4 == 0, "CNY").when(k % 4 == 1, "10k").when(k % 4 == 2, "100M").otherwise("?")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(rl.unit_value(F.col("o_totalprice"), unit, {"CNY": 1.0, "10k": 1e4, "100M": 1e8}), 2).alias("value"))


@query(f"WITH {BARS}, {BENCH} SELECT a.symbol, a.date, a.close AS x, b.close AS y, round(bench, 6) AS z FROM bars a JOIN bars b ON a.date = b.date AND b.symbol = a.symbol + 1 JOIN bench ON bench.date = a.date")
def j04_aligned_series(spark, sf_dir):
    """Every symbol beside the next one and the benchmark, on the dates that all three have."""
    b = bars(spark, sf_dir).select("symbol", "date", F.col("close").alias("x"))
    after = b.select((F.col("symbol") - 1).alias("symbol"), "date", F.col("x").alias("y"))
    return b.join(after, ["symbol", "date"]).join(benchmark_series(bars(spark, sf_dir)).select("date", F.round("bench", 6).alias("z")), "date").select("symbol", "date", "x", "y", "z")


@query(f"WITH {BARS}, g AS (SELECT symbol - i AS first, date FROM bars, (SELECT unnest(range(3)) AS i) WHERE date <= '1999-06-30'), c AS (SELECT first, date FROM g GROUP BY first, date HAVING count(*) = 3) SELECT first, max(date) AS date FROM c GROUP BY first")
def j08_latest_common_date(spark, sf_dir):
    """Of every three neighbouring symbols the last date at or before the as-of that all of them have."""
    g = bars(spark, sf_dir).where("date <= '1999-06-30'").select("symbol", "date", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).select((F.col("symbol") - F.col("i")).alias("first"), "date")
    return g.groupBy("first", "date").count().where("count = 3").groupBy("first").agg(F.max("date").alias("date"))


@query(f"WITH {BARS}, r AS (SELECT date, any_value(risk_regime) AS g FROM bars GROUP BY date), l AS (SELECT date, lag(g) OVER (ORDER BY date) AS known FROM r) SELECT symbol, bars.date, known FROM bars JOIN l USING (date) WHERE known IS NOT NULL")
def j09_lagged_condition(spark, sf_dir):
    b = bars(spark, sf_dir)
    state = b.groupBy("date").agg(F.first("risk_regime").alias("g")).withColumn("known", F.lag("g").over(Window.partitionBy(F.lit(0)).orderBy("date")))
    return b.select("symbol", "date").join(state.select("date", "known"), "date").where("known is not null")


@query(f"WITH {BARS}, e AS (SELECT symbol, date AS entry, close AS c0, (date::DATE + 35)::VARCHAR AS ex FROM bars), s AS (SELECT e.symbol, entry, ex, c0, max(b.date) AS last, arg_max(b.close, b.date) AS c1 FROM e JOIN bars b ON b.symbol = e.symbol AND b.date BETWEEN entry AND ex GROUP BY 1, 2, 3, 4) SELECT symbol, entry, round(c1 / c0 - 1, 6) AS ret, last <> ex AS interrupted FROM s")
def j10_range_settlement(spark, sf_dir):
    """Every bar as an entry, settled at the last price up to five weeks later: a last value by symbol, no range join."""
    b = bars(spark, sf_dir).select("symbol", "date", "close")
    e = b.select("symbol", F.col("date").alias("entry"), F.col("close").alias("c0"), F.date_format(F.date_add(F.col("date").cast("date"), 35), "yyyy-MM-dd").alias("ex"))
    s = mk.as_of(e, b, "ex", True)
    return s.select("symbol", "entry", F.round(F.col("base_close") / F.col("c0") - 1, 6).alias("ret"), (F.col("base_date") != F.col("ex")).alias("interrupted"))


@query("WITH r AS (SELECT o_orderkey AS row_id, o_custkey AS cust, o_orderkey % 400 AS legacy FROM orders), a AS (SELECT c_custkey AS cust, c_custkey AS match_id FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey // 4 AS legacy, c_custkey AS match_id FROM customer WHERE c_custkey % 3 = 0), bg AS (SELECT legacy, min(match_id) AS m, count(*) AS n FROM b GROUP BY legacy) SELECT row_id, CASE WHEN a.match_id IS NOT NULL THEN a.match_id WHEN bg.n = 1 THEN bg.m END AS match_id, CASE WHEN a.match_id IS NOT NULL THEN 'cust' WHEN bg.n > 1 THEN 'ambiguous' WHEN bg.n = 1 THEN 'legacy' ELSE 'none' END AS how FROM r LEFT JOIN a ON a.cust = r.cust LEFT JOIN bg ON bg.legacy = r.legacy")
def j13_prioritised_lookup(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("cust"), (F.col("o_orderkey") % 400).alias("legacy"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("match_id"))
    a = c.where("match_id % 2 = 0").withColumn("cust", F.col("match_id"))
    b = c.where("match_id % 3 = 0").withColumn("legacy", F.floor(F.col("match_id") / 4))
    return rl.prioritised(rows, [("cust", a), ("legacy", b)]).select("row_id", "match_id", "how")


@query("WITH e AS (SELECT o_orderkey AS t FROM orders), r AS (SELECT l_orderkey AS t, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS net, l_returnflag AS cur FROM lineitem), g AS (SELECT t, count(*) AS n, count(DISTINCT cur) AS k, max(net) AS net, count(net) AS c FROM r GROUP BY t) SELECT e.t AS trade_id, CASE WHEN n = 1 AND k = 1 AND c = 1 THEN net END AS net, CASE WHEN n = 1 AND k = 1 AND c = 1 THEN NULL WHEN n IS NULL THEN 'no_receipt' WHEN n > 1 THEN 'many_receipts' ELSE 'net_missing' END AS gap FROM e LEFT JOIN g ON g.t = e.t")
def j15_single_receipt(spark, sf_dir):
    exits = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trade_id"))
    r = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trade_id"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("net"), F.col("l_returnflag").alias("currency"))
    return rl.one_receipt(exits, r)


@query("WITH f AS (SELECT l_suppkey AS symbol, strftime(l_shipdate, '%Y-%m') AS period, l_shipdate AS o, l_quantity AS forecast, l_orderkey, l_linenumber, l_partkey FROM lineitem), r AS (SELECT l_suppkey AS symbol, strftime(l_shipdate, '%Y-%m') AS period, date_trunc('month', l_shipdate) + INTERVAL 7 DAY AS rep, avg(l_quantity) AS actual FROM lineitem GROUP BY 1, 2, 3), j AS (SELECT f.symbol, f.period, actual, arg_min(forecast, strftime(o, '%Y%m%d') || lpad(l_orderkey::VARCHAR, 12, '0') || lpad(l_linenumber::VARCHAR, 3, '0') || lpad(l_partkey::VARCHAR, 12, '0') || lpad(forecast::BIGINT::VARCHAR, 4, '0')) AS forecast FROM f JOIN r USING (symbol, period) WHERE o < rep GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period DESC) AS n FROM j) SELECT symbol, count(*) AS n, round(avg((actual > forecast)::INT), 6) AS beat_rate FROM k WHERE n <= 8 GROUP BY symbol")
def j16_beat_rate(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").withColumn("period", F.date_format("l_shipdate", "yyyy-MM"))
    key = F.concat(F.date_format("l_shipdate", "yyyyMMdd"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lpad(F.col("l_partkey").cast("string"), 12, "0"), F.lpad(F.col("l_quantity").cast("long").cast("string"), 4, "0"))
    f = li.select(F.col("l_suppkey").alias("symbol"), "period", key.alias("observed_at"), F.col("l_quantity").alias("forecast"))
    r = li.groupBy(F.col("l_suppkey").alias("symbol"), "period").agg(F.avg("l_quantity").alias("actual")).withColumn("reported_at", F.concat(F.regexp_replace("period", "-", ""), F.lit("08")))
    return rl.beat_rate(f, r).select("symbol", "n", F.round("beat_rate", 6).alias("beat_rate"))


@query("WITH p AS (SELECT event_id, user_id, ts + INTERVAL 1 HOUR AS due, value, event_id % 2 = 0 AS long FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id, ts, value, event_id FROM events), m AS (SELECT p.event_id, arg_min(q.value, q.ts) AS price FROM p JOIN q ON q.user_id = p.user_id AND q.ts BETWEEN due AND due + INTERVAL 6 HOUR GROUP BY p.event_id) SELECT p.event_id AS prediction_id, CASE WHEN price IS NULL THEN 'pending' ELSE 'settled' END AS status, CASE WHEN price IS NULL THEN NULL WHEN long THEN price > value ELSE NOT price > value END AS \"right\" FROM p LEFT JOIN m ON m.event_id = p.event_id")
def l04_settle_predictions(spark, sf_dir):
    e = events(spark, sf_dir)
    p = e.where("event_type = 'purchase'").select(F.col("event_id").alias("prediction_id"), F.col("user_id").alias("symbol"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("due_ts"), F.col("value").alias("reference_price"), F.when(F.col("event_id") % 2 == 0, "long").otherwise("short").alias("direction"))
    q = e.select(F.col("user_id").alias("symbol"), F.col("ts").alias("quote_ts"), F.col("value").alias("price"))
    return rl.settle(p, q, 21_600)


@query(f"WITH {DECISIONS} SELECT decision_id, round(CASE WHEN symbol % 50 = 0 THEN 0.85 ELSE 1.0 END * CASE direction WHEN 'long' THEN 0.8 ELSE 1.0 END, 6)::DOUBLE AS multiplier, (symbol % 50 = 0)::INT + (direction = 'long')::INT AS applied FROM decisions")
def l07_adjustments(spark, sf_dir):
    base = decisions(spark, sf_dir).select(F.col("decision_id").alias("id"), F.col("symbol").cast("string").alias("symbol"), "direction")
    by_symbol = base.select("symbol").distinct().where("cast(symbol as bigint) % 50 = 0").select(F.lit("symbol").alias("kind"), F.col("symbol").alias("key"), F.lit(0.85).alias("factor"))
    both = by_symbol.unionByName(base.where("direction = 'long'").select("direction").distinct().select(F.lit("direction").alias("kind"), F.col("direction").alias("key"), F.lit(0.8).alias("factor")))
    return rl.adjust(base, both).select(F.col("id").alias("decision_id"), F.round("multiplier", 6).alias("multiplier"), F.col("applied").cast("int").alias("applied"))


@query("WITH f AS (SELECT p_partkey, (p_partkey % 6)::DOUBLE AS a, (p_partkey % 5)::DOUBLE AS b, (p_size % 6)::DOUBLE AS c, (p_partkey % 4)::DOUBLE AS d, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_size % 5)::DOUBLE END AS e FROM part) SELECT p_partkey, (e IS NULL)::INT AS missing, CASE WHEN e IS NOT NULL THEN round(a*.2 + b*.2 + c*.2 + d*.25 + e*.15, 6) END AS score, greatest(a, b, c, d, coalesce(e, a)) - least(a, b, c, d, coalesce(e, a)) > 2.5 AS conflict FROM f")
def l10_entry_score(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    x = read(spark, sf_dir, "part").select("p_partkey", (k % 6).cast("double").alias("a"), (k % 5).cast("double").alias("b"), (s % 6).cast("double").alias("c"), (k % 4).cast("double").alias("d"), F.when(k % 7 != 0, (s % 5).cast("double")).alias("e"))
    return rl.entry_score(x, {"a": 0.2, "b": 0.2, "c": 0.2, "d": 0.25, "e": 0.15}).select("p_partkey", "missing", F.round("score", 6).alias("score"), "conflict")


@query(f"""WITH {BOOK}, {LEVELS}, b AS (SELECT * FROM levels WHERE side = 1), x AS (SELECT a.*, a.volume - coalesce(p.volume, 0) AS added FROM b a LEFT JOIN b p ON p.symbol = a.symbol AND p.session_id = a.session_id AND p.snap = a.snap - 1 AND p.ticks = a.ticks),
y AS (SELECT x.event_id, x.ticks, s.snap AS later, least(x.added, greatest(x.volume - coalesce(l.volume, 0), 0)) / x.added::DOUBLE AS ratio FROM x JOIN book s ON s.symbol = x.symbol AND s.session_id = x.session_id AND s.snap BETWEEN x.snap + 1 AND x.snap + 2 LEFT JOIN b l ON l.symbol = s.symbol AND l.session_id = s.session_id AND l.snap = s.snap AND l.ticks = x.ticks WHERE x.added > 4000)
SELECT event_id, ticks, round(arg_min(ratio, later), 6) AS ratio FROM y WHERE ratio >= 0.8 GROUP BY event_id, ticks""")
def m06_level_lifetimes(spark, sf_dir):
    b = book(spark, sf_dir)
    x = rl.level_lifetimes(levels(b), 1, 2, 4000, 0.8)
    return x.join(b.select("symbol", "session_id", F.col("snap").alias("appeared"), "event_id"), ["symbol", "session_id", "appeared"]).select("event_id", "ticks", F.round("ratio", 6).alias("ratio"))


@query("WITH n AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), d AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM n GROUP BY user_id) SELECT d.user_id, d.day::VARCHAR AS day FROM d ANTI JOIN n ON n.user_id = d.user_id AND n.day = d.day")
def w12_missing_dates(spark, sf_dir):
    n = events(spark, sf_dir).select("user_id", F.to_date("ts").alias("day")).distinct()
    d = n.groupBy("user_id").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return d.join(n, ["user_id", "day"], "left_anti").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, strftime(ts + CASE WHEN user_id % 2 = 0 THEN INTERVAL 8 HOUR ELSE INTERVAL 9 HOUR END, '%Y-%m-%d') AS local_day, strftime(ts + CASE WHEN user_id % 2 = 0 THEN INTERVAL 8 HOUR ELSE INTERVAL 9 HOUR END, '%H:%M') AS hhmm FROM events")
def f04_local_dates(spark, sf_dir):
    zone = F.when(F.col("user_id") % 2 == 0, "Asia/Hong_Kong").otherwise("Asia/Tokyo")
    t = F.from_utc_timestamp("ts", zone)
    return events(spark, sf_dir).select("event_id", F.date_format(t, "yyyy-MM-dd").alias("local_day"), F.date_format(t, "HH:mm").alias("hhmm"))


@query(f"""WITH {BARS}, {BENCH}, c AS (SELECT a.symbol, a.date, ln(a.close) AS t, ln(i.close) AS i, ln(bench) AS b FROM bars a JOIN bars i ON i.symbol = 1 AND i.date = a.date JOIN bench ON bench.date = a.date WHERE a.symbol <> 1),
p AS MATERIALIZED (SELECT symbol, date, t AS lt, i AS li, b AS lb, t - lag(t) OVER w AS t, i - lag(i) OVER w AS i, b - lag(b) OVER w AS b, row_number() OVER w AS pos, count(*) OVER (PARTITION BY symbol) AS last FROM c WINDOW w AS (PARTITION BY symbol ORDER BY date)),
v AS (SELECT symbol, last, greatest(last - 2 - symbol % 9, 1) AS base FROM p GROUP BY symbol, last),
x AS MATERIALIZED (SELECT p.*, v.base, v.last - v.base AS age, pos - v.base + 59 AS k FROM p JOIN v ON v.symbol = p.symbol),
ok AS (SELECT DISTINCT symbol FROM x WHERE base - 1 >= 60 AND age >= 1),
m AS (SELECT symbol, h, count(*) AS n, avg(t) AS mt, avg(i) AS mi, avg(b) AS mb, var_pop(b) AS bb, var_pop(i) AS ii, covar_pop(b, i) AS bi, covar_pop(b, t) AS bt, covar_pop(i, t) AS it FROM (SELECT *, unnest([0, CASE WHEN k < 30 THEN 1 ELSE 2 END]) AS h FROM x WHERE k BETWEEN 0 AND 59) GROUP BY symbol, h),
f AS (SELECT *, (it - bi * bt / bb) / (ii - bi * bi / bb) AS fi, (bt - (it - bi * bt / bb) / (ii - bi * bi / bb) * bi) / bb AS fb FROM m),
fit AS MATERIALIZED (SELECT a.symbol, a.fb, a.fi, a.mt - a.fb * a.mb - a.fi * a.mi AS al, a.mt - a.bt / a.bb * a.mb AS ta, a.bt / a.bb AS tb, a.mi - a.bi / a.bb * a.mb AS ia, a.bi / a.bb AS ib, abs(u.fb - w.fb) AS sb, abs(u.fi - w.fi) AS si FROM f a JOIN f u ON u.symbol = a.symbol AND u.h = 1 JOIN f w ON w.symbol = a.symbol AND w.h = 2 WHERE a.h = 0),
cu AS (SELECT symbol, any_value(age) AS age, max(lt) FILTER (pos = last) - max(lt) FILTER (pos = base) AS ct, max(li) FILTER (pos = last) - max(li) FILTER (pos = base) AS ci, max(lb) FILTER (pos = last) - max(lb) FILTER (pos = base) AS cb FROM x GROUP BY symbol),
re AS (SELECT x.symbol, (59 - k) // age AS block, any_value(age) AS age, sum(t - al - fb * b - fi * i) AS s, sum(pow(t - al - fb * b - fi * i, 2)) AS q FROM x JOIN fit ON fit.symbol = x.symbol WHERE k BETWEEN 0 AND 59 GROUP BY 1, 2),
bl AS (SELECT symbol, count(*) FILTER (block < 60 // age) AS blocks, avg(s) FILTER (block < 60 // age) AS bm, stddev_samp(s) FILTER (block < 60 // age) AS bs, sqrt(sum(q) / 57) AS sigma FROM re GROUP BY symbol),
d AS (SELECT v.symbol, cu.age, fb, fi, sigma, ct - ta * cu.age - tb * cb AS ab, ci - ia * cu.age - ib * cb AS own, blocks, bm, bs, sb, si FROM v JOIN ok ON ok.symbol = v.symbol JOIN cu ON cu.symbol = v.symbol JOIN fit ON fit.symbol = v.symbol JOIN bl ON bl.symbol = v.symbol),
e AS (SELECT *, ab - fi * own AS extra, CASE WHEN blocks >= 3 AND bs > 1e-12 THEN (ab - fi * own - bm) / bs END AS z FROM d)
SELECT v.symbol, CASE WHEN v.base - 1 < 60 THEN 'training:insufficient_pre_event_lookback' END AS gap, age, round(fb, 5) AS beta_benchmark, round(fi, 5) AS beta_issuer, round(sigma, 5) AS sigma, round(ab, 5) AS abnormal, round(own, 5) AS issuer_abnormal, round(fi * own, 5) AS spill_over, round(extra, 5) AS extra, blocks, 60 % age AS discarded, round(bm, 5) AS block_mean, round(bs, 5) AS block_sigma, round(z, 4) AS z, round(sb, 5) AS shift_benchmark, round(si, 5) AS shift_issuer,
  CASE WHEN age IS NULL THEN NULL WHEN greatest(sb, si) > 1.0 THEN 'model_inapplicable_regime_break' WHEN age > 8 OR z IS NULL THEN 'statistical_residual_only' WHEN abs(z) >= 1.5 THEN 'relative_dislocation_candidate' ELSE 'no_threshold_dislocation' END AS classification FROM v LEFT JOIN e ON e.symbol = v.symbol""")
def e02_event_dislocation(spark, sf_dir):
    """Supplier 1 is the issuer, every other one a target; the event lies two to ten of their common weeks before the last."""
    b = bars(spark, sf_dir)
    issuer = b.where("symbol = 1").select("date", F.col("close").alias("issuer"))
    c = b.where("symbol <> 1").join(issuer, "date").join(benchmark_series(b), "date").select(F.col("symbol").alias("case"), "date", F.col("close").alias("target"), "issuer", F.col("bench").alias("benchmark"))
    w = Window.partitionBy("case")
    at = c.withColumns({"pos": F.row_number().over(w.orderBy("date")), "last": F.count("*").over(w)}).where(F.col("pos") == F.greatest(F.col("last") - 2 - F.col("case") % 9, F.lit(1)))
    d = ds.dislocations(c, at.select("case", F.col("date").alias("published")), 60, 8, 1.5, 1.0)
    five = ("beta_benchmark", "beta_issuer", "sigma", "abnormal", "issuer_abnormal", "spill_over", "extra", "block_mean", "block_sigma", "shift_benchmark", "shift_issuer")
    return d.select(F.col("case").alias("symbol"), "gap", "age", "blocks", "discarded", "classification", F.round("z", 4).alias("z"), *[F.round(k, 5).alias(k) for k in five])


@query("""SELECT event_id, CASE WHEN event_id % 8 IN (0, 1, 4, 6) THEN user_id + 0.5 END::DOUBLE AS price, CASE event_id % 8 WHEN 0 THEN 'q' WHEN 1 THEN 'unknown' WHEN 2 THEN 's' WHEN 4 THEN 'pair' WHEN 5 THEN 'pair' WHEN 6 THEN 'stub' WHEN 3 THEN 's' END AS source,
CASE WHEN event_id % 7 = 0 THEN 'GIVEN.X' WHEN event_id % 3 = 0 THEN 'S' || user_id::VARCHAR || '.US' WHEN event_id % 3 = 1 THEN 'S' || user_id::VARCHAR || '.SH' ELSE 'S' || user_id::VARCHAR END AS code FROM events""")
def u03_normalised_quotes(spark, sf_dir):
    """Quotes as objects, pairs and bare numbers, some with prices that are none."""
    k, p = F.col("event_id") % 8, (F.col("user_id") + 0.5).cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit('{"price": '), p, F.lit(', "quote_source": "q", "source": "s"}'))).when(k == 1, F.concat(F.lit('{"price": '), p, F.lit("}"))).when(k == 2, F.lit('{"price": -1, "source": "s"}'))
        .when(k == 3, F.concat(F.lit('{"price": "'), p, F.lit('", "source": "s"}'))).when(k == 4, F.concat(F.lit("["), p, F.lit(', "pair"]'))).when(k == 5, F.lit('[0, "pair"]')).when(k == 6, p)
    )
    x = events(spark, sf_dir).select("event_id", rl.quote(raw).alias("q"), rl.quote_symbol(F.concat(F.lit("S"), F.col("user_id").cast("string")), F.when(F.col("event_id") % 3 == 0, "us").when(F.col("event_id") % 3 == 1, "A").otherwise("?"), F.when(F.col("event_id") % 7 == 0, "GIVEN.X").otherwise("")).alias("code"))
    return x.select("event_id", "q.price", "q.source", "code")
