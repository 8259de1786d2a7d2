"""State rules, lifecycles, source scans and streams over the given tables, and the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import factors as fx
from marlstone.operators import states as sx
from marlstone.sources import scans as sc
from marlstone.plans.ledger_queries import LOTS
from marlstone.sources.bindings import BARS, BENCH, BOOK, bars, benchmark_series, events, journal, read
from marlstone.sources.shared import append_new, fresh_path
from marlstone.streaming import detectors, streams

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


DAILY = "d AS (SELECT l_suppkey AS s, count(*) AS up, sum((l_returnflag='R')::INT) AS down, max(l_linenumber) AS h, avg((l_linestatus='O')::INT) AS br, avg(l_discount) - avg(l_tax) AS pr FROM lineitem GROUP BY l_suppkey)"


@query(f"WITH {DAILY}, e AS (SELECT s, up % 100 AS up, down % 25 AS down, h, br, round(pr, 6) AS pr FROM d) SELECT s AS supplier, CASE WHEN down >= 20 OR (up <= 15 AND h <= 2 AND (pr IS NULL OR pr < 0)) THEN 'ice' WHEN up >= 80 AND br >= 0.35 THEN 'divergence' WHEN up >= 70 AND h >= 4 THEN 'climax' WHEN down >= 10 AND up <= 40 THEN 'retreat' WHEN up BETWEEN 25 AND 70 AND h >= 3 THEN 'ferment' WHEN up >= 15 AND h >= 2 THEN 'start' WHEN up >= 10 THEN 'start' ELSE 'ice' END AS phase FROM e")
def e12_sentiment_phase(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg((F.count("*") % 100).alias("up"), (F.count_if(F.col("l_returnflag") == "R") % 25).alias("down"), F.max("l_linenumber").alias("h"), F.avg((F.col("l_linestatus") == "O").cast("int")).alias("br"), F.round(F.avg("l_discount") - F.avg("l_tax"), 6).alias("pr"))
    return d.select("supplier", sx.sentiment_phase(F.col("up"), F.col("down"), F.col("h"), F.col("br"), F.col("pr")).alias("phase"))


@query(f"WITH {BARS}, f AS (SELECT symbol, date, volume % 1000 - 500 AS net, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM bars), l AS (SELECT symbol, list((net)::DOUBLE ORDER BY date) AS v FROM f WHERE n <= 5 GROUP BY symbol) SELECT symbol, CASE WHEN len(v) < 3 THEN 'unknown' WHEN len(list_filter(v, lambda x: x > 0)) >= 3 AND v[-1] > 0 AND v[-2] > 0 AND v[-3] > 0 THEN 'continuous_inflow' WHEN len(list_filter(v, lambda x: x < 0)) >= 3 AND v[-1] > 0 AND list_sum(v[:-2]) < 0 THEN 'recovery_inflow' WHEN v[-1] > 0 AND list_sum(v[:-2]) <= 0 THEN 'first_inflow' WHEN v[-1] < 0 AND list_sum(v[:-2]) > 0 THEN 'outflow' ELSE 'mixed' END AS state FROM l")
def w14_flow_state(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(-4, 0)
    x = bars(spark, sf_dir).withColumn("v", F.collect_list((F.col("volume") % 1000 - 500).cast("double")).over(w))
    return x.groupBy("symbol").agg(F.max_by("v", "date").alias("v")).select("symbol", sx.flow_state(F.col("v")).alias("state"))


@query(f"WITH {BARS}, {BENCH}, c AS (SELECT date, bench, row_number() OVER (ORDER BY date) AS i, 100*(bench/lag(bench, 1) OVER (ORDER BY date) - 1) AS d1, 100*(bench/lag(bench, 5) OVER (ORDER BY date) - 1) AS d5 FROM bench), p AS (SELECT a.date, avg((b.bench <= a.bench)::INT) AS pc FROM c a JOIN c b ON b.i <= a.i GROUP BY a.date) SELECT date, CASE WHEN coalesce(d1 >= 15, false) OR coalesce(d5 >= 30, false) THEN 'correlation_unwind_active' WHEN pc <= 0.05 THEN 'dispersion_extreme' WHEN pc <= 0.25 THEN 'crowding_building' ELSE 'benign' END AS state FROM c JOIN p USING (date)")
def e10_crowding_state(spark, sf_dir):
    b = benchmark_series(bars(spark, sf_dir))
    w = Window.partitionBy(F.lit(0)).orderBy("date")  # one row a date
    seen = F.collect_list("bench").over(w.rowsBetween(Window.unboundedPreceding, 0))
    c = b.withColumns({"d1": 100 * (F.col("bench") / F.lag("bench", 1).over(w) - 1), "d5": 100 * (F.col("bench") / F.lag("bench", 5).over(w) - 1), "seen": seen})
    pc = F.size(F.filter("seen", lambda x: x <= F.col("bench"))) / F.size("seen")
    return c.select("date", sx.crowding_state(pc, F.col("d1"), F.col("d5"), F.lit(None).cast("double")).alias("state"))


@query("WITH s AS (SELECT user_id, event_type AS layer, count(*) > 15 AS triggered FROM events GROUP BY user_id, event_type), g AS (SELECT user_id, sum(triggered::INT)::BIGINT AS n, count(DISTINCT layer) FILTER (triggered) AS k FROM s GROUP BY user_id) SELECT user_id, n AS triggered, k AS layers, CASE WHEN n <= 1 THEN 'normal' WHEN n = 2 THEN 'stress_building' WHEN n = 3 AND k >= 2 THEN 'deleveraging_watch' WHEN n = 4 AND k >= 3 THEN 'active_deleveraging' WHEN n >= 5 THEN 'forced_liquidation' ELSE 'deleveraging_watch' END AS regime, CASE WHEN n <= 1 THEN 1.0 WHEN n = 2 THEN 0.7 WHEN n = 3 THEN 0.5 WHEN n = 4 AND k >= 3 THEN 0.3 WHEN n >= 5 THEN 0.1 ELSE 0.5 END::DOUBLE AS multiplier FROM g")
def e11_risk_regime(spark, sf_dir):
    s = events(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("layer")).agg((F.count("*") > 15).alias("triggered"))
    return sx.risk_regime(s, "user_id")


@query("WITH r AS (SELECT p_brand, p_size, p_retailprice, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS n FROM part) SELECT p_brand, count(*) AS n, max(p_size) AS max_height, string_agg(p_partkey::VARCHAR, ',' ORDER BY n) FILTER (n <= 3) AS leaders FROM r GROUP BY p_brand")
def a10_sector_ladder(spark, sf_dir):
    return sx.ladder(read(spark, sf_dir, "part"), "p_brand", "p_size", "p_retailprice", "p_partkey")


SAMPLES = "smp AS (SELECT 'c' || (event_id % 3)::VARCHAR AS component, (event_id * 37 % 101) / 100.0::DOUBLE AS prediction, (event_type = 'purchase')::INT::DOUBLE AS outcome FROM events), br AS (SELECT component, count(*) AS n, round(avg(pow(prediction - outcome, 2)), 6) AS brier FROM smp WHERE prediction BETWEEN 0 AND 1 GROUP BY component)"


@query(f"WITH {SAMPLES}, cu AS (SELECT * FROM (VALUES ('c0', 0.6), ('c1', 0.3), ('c2', 0.1)) t(component, weight)), q AS (SELECT component, weight::DOUBLE AS weight, greatest(0.05, 1 - brier) AS q FROM cu JOIN br USING (component)), t AS (SELECT *, q / sum(q) OVER () AS target FROM q), m AS (SELECT *, max(abs(target - weight)) OVER () AS top FROM t) SELECT component, weight, round(weight + least(1.0, 0.15 / top) * (target - weight), 6) AS suggested FROM m")
def a18_bounded_weights(spark, sf_dir):
    k = F.col("event_id")
    s = events(spark, sf_dir).select(F.concat(F.lit("c"), (k % 3).cast("string")).alias("component"), (k * 37 % 101 / 100.0).alias("prediction"), (F.col("event_type") == "purchase").cast("double").alias("outcome"))
    current = s.select("component").distinct().withColumn("weight", F.when(F.col("component") == "c0", 0.6).when(F.col("component") == "c1", 0.3).otherwise(0.1))
    return sx.bounded_weights(sx.component_briers(s), current)


@query(f"WITH {BARS}, {BENCH}, r AS (SELECT symbol, b.date, close/lag(close) OVER s - 1 AS t, bench/lag(bench) OVER s - 1 AS b FROM bars b JOIN bench USING (date) WINDOW s AS (PARTITION BY symbol ORDER BY b.date)), j AS (SELECT a.symbol, a.t, a.b, i.t AS i FROM r a JOIN r i ON i.symbol = 1 AND i.date = a.date WHERE a.symbol <> 1 AND a.t IS NOT NULL AND a.b IS NOT NULL AND i.t IS NOT NULL), g AS (SELECT symbol, count(*) AS n, var_pop(b) AS bb, var_pop(i) AS ii, var_pop(t) AS tt, covar_pop(b, i) AS bi, covar_pop(b, t) AS bt, covar_pop(i, t) AS it FROM j GROUP BY symbol), f AS (SELECT *, (it - bi*bt/bb) / (ii - bi*bi/bb) AS beta_i FROM g WHERE n >= 6), h AS (SELECT *, (bt - beta_i*bi)/bb AS beta_b FROM f) SELECT symbol, n, round(beta_b, 5) AS beta_benchmark, round(beta_i, 5) AS beta_issuer, round(sqrt(n*(tt - beta_b*bt - beta_i*it)/(n-3)), 5) AS sigma FROM h")
def e01_partial_fit(spark, sf_dir):
    b = bars(spark, sf_dir)
    r = b.join(benchmark_series(b), "date").select("symbol", "date", (F.col("close") / F.lag("close").over(fx.series()) - 1).alias("t"), (F.col("bench") / F.lag("bench").over(fx.series()) - 1).alias("b"))
    issuer = r.where("symbol = 1").select("date", F.col("t").alias("i"))
    x = sx.partial_fit(r.where("symbol <> 1").join(issuer, "date").dropna(), "symbol")
    return x.select("symbol", "n", F.round("beta_benchmark", 5).alias("beta_benchmark"), F.round("beta_issuer", 5).alias("beta_issuer"), F.round("sigma", 5).alias("sigma"))


@query(f"WITH {LOTS}, g AS (SELECT symbol, open_pos, sum(quantity)::BIGINT AS xq, count(*) AS exits, sum(100*(cp/op - 1)*quantity/oq) AS ret FROM lots GROUP BY 1, 2) SELECT j.symbol, j.pos AS open_pos, coalesce(xq, 0) AS exit_quantity, coalesce(exits, 0) AS exits, round(ret, 4) AS return_pct, CASE WHEN coalesce(xq, 0) >= q THEN 'closed' WHEN coalesce(xq, 0) > 0 THEN 'partial' ELSE 'open' END AS status FROM journal j LEFT JOIN g ON g.symbol = j.symbol AND g.open_pos = j.pos WHERE kind = 'open'")
def l01_lifecycles(spark, sf_dir):
    return sx.lifecycles(journal(spark, sf_dir)).select("symbol", "open_pos", "exit_quantity", "exits", F.round("return_pct", 4).alias("return_pct"), "status")


@query(f"WITH {BARS}, x AS (SELECT date, lead(date) OVER (ORDER BY date) AS nx FROM (SELECT DISTINCT date FROM bars)), w AS (SELECT symbol, date, volume / (sum(volume) OVER (PARTITION BY date))::DOUBLE AS wt, lead(close) OVER (PARTITION BY symbol ORDER BY date)/close - 1 AS ret FROM bars), o AS (SELECT x.nx AS date, symbol, wt*(1+coalesce(ret, 0)) / sum(wt*(1+coalesce(ret, 0))) OVER (PARTITION BY w.date) AS old FROM w JOIN x USING (date) WHERE nx IS NOT NULL), j AS (SELECT coalesce(o.date, w.date) AS date, coalesce(wt, 0) - coalesce(old, 0) AS d FROM o FULL JOIN w ON o.date = w.date AND o.symbol = w.symbol) SELECT date, round(sum(abs(d)), 6) AS turnover, round(sum(greatest(d, 0)), 6) AS buys, round(sum(greatest(-d, 0)), 6) AS sells FROM j GROUP BY date")
def a20_drift_turnover(spark, sf_dir):
    b = bars(spark, sf_dir)
    nx = b.select("date").distinct().withColumn("nx", F.lead("date").over(Window.partitionBy(F.lit(0)).orderBy("date")))
    wt = b.select("date", F.col("symbol").alias("name"), (F.col("volume") / F.sum("volume").over(Window.partitionBy("date"))).alias("weight"), F.coalesce(F.lead("close").over(fx.series()) / F.col("close") - 1, F.lit(0.0)).alias("ret"))
    old = wt.join(nx, "date").where("nx is not null").select(F.col("nx").alias("date"), "name", "weight", "ret")
    x = sx.drift_turnover(old, wt.select("date", "name", "weight"), "date")
    return x.select("date", *[F.round(c, 6).alias(c) for c in ("turnover", "buys", "sells")])


@query("SELECT (o_orderkey)::BIGINT AS k, 'OPT' AS root, (DATE '2024-01-01' + (o_orderkey % 300)::INT)::VARCHAR AS expiry, CASE WHEN o_orderkey % 2 = 0 THEN 'C' ELSE 'P' END AS side, (o_orderkey % 50000)/1000.0::DOUBLE AS strike FROM orders")
def s14_option_codes(spark, sf_dir):
    k = F.col("o_orderkey")
    code = F.concat(F.lit("OPT"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), "yyMMdd"), F.when(k % 2 == 0, "C").otherwise("P"), F.lpad((k % 50000).cast("string"), 8, "0"))
    c = sc.option_code(code)
    return read(spark, sf_dir, "orders").select(k.alias("k"), c["root"].alias("root"), F.date_format(c["expiry"], "yyyy-MM-dd").alias("expiry"), c["side"].alias("side"), c["strike"].alias("strike"))


@query(f"WITH {BARS} SELECT symbol, CASE WHEN symbol % 3 = 0 THEN 0 WHEN symbol % 2 = 0 THEN 1 END AS source_no, count(*) FILTER (symbol % 3 = 0 OR symbol % 2 = 0) AS n, CASE WHEN symbol % 3 <> 0 AND symbol % 2 <> 0 THEN 'no_source_has_rows' END AS failure FROM bars GROUP BY symbol")
def s08_source_cascade(spark, sf_dir):
    """Two sources that lack symbols; what neither has is told as a failure."""
    b = bars(spark, sf_dir)
    return sc.cascade_status([b.where("symbol % 3 = 0"), b.where("symbol % 2 = 0")], b.select("symbol"), ["symbol"])


@query(f"WITH {BARS} SELECT symbol, date, round(close, 4) AS close, round(100*(round(close, 4)/lag(round(close, 4)) OVER (PARTITION BY symbol ORDER BY date) - 1), 2) AS pct_change FROM bars")
def s07_normalised_bars(spark, sf_dir):
    b = bars(spark, sf_dir)
    raw = b.select("symbol", "date", F.round("close", 4).cast("decimal(20,4)").cast("string").alias("close"), F.col("volume").cast("string").alias("volume"), F.lit(2).alias("ord"))
    # Every row comes twice, an older state of it first, and bad dates with them.
    older = raw.select("symbol", "date", F.lit("1,000.5").alias("close"), "volume", F.lit(1).alias("ord"))
    bad = raw.limit(5).withColumn("date", F.lit("2024-13-45"))
    x = sc.normalise_bars(raw.unionByName(older).unionByName(bad), "ord")
    return x.select("symbol", "date", F.round("close", 4).alias("close"), F.round("pct_change", 2).alias("pct_change"))


@query("SELECT event_id, user_id, event_type FROM events")
def s11_keyed_append(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "event_type")
    table = fresh_path(spark, "append")
    for part in ("event_id % 4 = 0", "event_id % 4 <= 1", "event_id % 4 <= 2", "event_id % 4 >= 1", "event_id is not null"):
        append_new(table, e.where(part), ["event_id"])
    return spark.read.parquet(table)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS files, sum(round(o_totalprice)::BIGINT)::BIGINT AS bytes FROM orders WHERE o_orderdate < TIMESTAMP '2001-06-30' - INTERVAL 365 DAY GROUP BY 1")
def s13_retention_plan(spark, sf_dir):
    f = read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("modified"), F.round("o_totalprice").cast("long").alias("bytes"))
    return sc.retention_plan(f, F.lit("2001-06-30").cast("timestamp"), 365)


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type")
def r03_stream_first_events(spark, sf_dir):
    x = streams.drain(streams.first_events(streams.event_stream(spark, sf_dir)), "first-events")
    return x.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


CLOSED = "cl AS (SELECT max(ts) - INTERVAL 1 DAY AS wm FROM events), dd AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, sum(round(value*100)::BIGINT)::BIGINT AS cents, max(ts) AS last FROM events GROUP BY 1, 2)"


@query(f"WITH {CLOSED} SELECT day::VARCHAR AS day, event_type, n, cents FROM dd, cl WHERE day + INTERVAL 1 DAY <= wm")
def r06_stream_daily_counts(spark, sf_dir):
    return streams.drain(streams.daily_counts(streams.event_stream(spark, sf_dir)), "daily")


@query(f"WITH {CLOSED} SELECT day::VARCHAR AS day, event_type, epoch(day + INTERVAL 1 DAY)::BIGINT - floor(epoch(last))::BIGINT > 3600 AS stale FROM dd, cl WHERE day + INTERVAL 1 DAY <= wm")
def r05_stream_feed_watchdog(spark, sf_dir):
    return streams.drain(streams.feed_ages(streams.event_stream(spark, sf_dir)), "feeds")


@query("WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), g AS (SELECT *, sum((p IS NULL OR ts >= p + INTERVAL 6 HOUR)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM l) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM g GROUP BY user_id, run")
def r07_snapshot_runs(spark, sf_dir):
    return streams.runs(events(spark, sf_dir))


@query("WITH w AS (SELECT user_id, event_type, ts, unnest([0, 1]) AS k FROM events) SELECT epoch_ms(time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE) AS start_ms, user_id, event_type, count(*) AS n FROM w GROUP BY 1, 2, 3")
def r08_repeat_windows(spark, sf_dir):
    return streams.repeats(events(spark, sf_dir))


@query(f"""WITH {BOOK}, d AS (SELECT *, cumulative_volume - lag(cumulative_volume) OVER w AS delta, round(last_price*100)::BIGINT AS t, lag(round(last_price*100)::BIGINT) OVER w AS pt FROM book WINDOW w AS (PARTITION BY symbol, session_id ORDER BY snap)),
m AS (SELECT *, median(delta) OVER w2 AS mid, count(delta) OVER w2 AS n FROM d WINDOW w2 AS (PARTITION BY symbol, session_id ORDER BY snap ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING))
SELECT event_id, delta > greatest(10.0, 1.2 * mid) AND t - pt >= 1 AS fired, round(least(1.0, delta / (2.0 * greatest(10.0, 1.2 * mid))), 6) AS strength FROM m WHERE n = 2""")
def r02_stream_ignition(spark, sf_dir):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, detectors.ROCKS)
    try:
        x = streams.drain(detectors.ignition(detectors.snapshots_of(streams.event_stream(spark, sf_dir)), 1.2, 2, 10.0), "ignition")
    finally:
        spark.conf.set(name, before)
    return x.select("event_id", "fired", F.round("strength", 6).alias("strength"))
