"""Event and path studies, pairs, option chains and the order book over the given tables, and the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import factors as fx
from marlstone.operators import market as mk
from marlstone.operators.skyline import skyline
from marlstone.sources.bindings import BARS, BENCH, BOOK, CHAIN, LEVELS, bars, benchmark_series, book, chain, events, levels

Q, SQL = {}, {}
AS_OF = "2024-01-02"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark, sf_dir):
    """Purchases as events on bars: the event's day is moved to the years of the bars."""
    e = events(spark, sf_dir).where("event_type = 'purchase'")
    symbols = bars(spark, sf_dir).agg(F.max("symbol").alias("m")).first()["m"] + 1
    return e.select("event_id", (F.col("user_id") % symbols).alias("symbol"), F.date_format(F.date_add(F.lit("1996-01-01").cast("date"), (F.col("event_id") % 1500).cast("int")), "yyyy-MM-dd").alias("event_date"))


EVENTS = "sm AS (SELECT max(symbol) + 1 AS m FROM bars), evn AS (SELECT event_id, user_id % m AS symbol, (DATE '1996-01-01' + (event_id % 1500)::INT)::VARCHAR AS event_date FROM events, sm WHERE event_type = 'purchase')"


@query(f"WITH {BARS}, {EVENTS} SELECT event_id, max(b.date) AS base_date, round(arg_max(b.close, b.date), 6) AS base_close FROM evn LEFT JOIN bars b ON b.symbol = evn.symbol AND b.date < event_date GROUP BY event_id")
def j06_previous_close(spark, sf_dir):
    return mk.previous_close(_events(spark, sf_dir), bars(spark, sf_dir)).select("event_id", "base_date", F.round("base_close", 6).alias("base_close"))


@query(f"WITH {BARS}, {EVENTS} SELECT event_id, min(b.date) AS ref_date, round(arg_min(b.close, b.date), 6) AS ref_close FROM evn LEFT JOIN bars b ON b.symbol = evn.symbol AND b.date >= event_date GROUP BY event_id")
def j07_close_on_or_after(spark, sf_dir):
    return mk.close_on_or_after(_events(spark, sf_dir), bars(spark, sf_dir), "event_date").select("event_id", "ref_date", F.round("ref_close", 6).alias("ref_close"))


RET = f"{BENCH}, ret AS (SELECT symbol, b.date, close / lag(close) OVER s - 1 AS y, bench / lag(bench) OVER s - 1 AS x FROM bars b JOIN bench USING (date) WINDOW s AS (PARTITION BY symbol ORDER BY b.date))"
BETAS = "covar_pop(y, x) / nullif(var_pop(x), 0)"


def _returns(spark, sf_dir):
    b = bars(spark, sf_dir)
    return b.join(benchmark_series(b), "date").select("symbol", "date", (F.col("close") / F.lag("close").over(fx.series()) - 1).alias("y"), (F.col("bench") / F.lag("bench").over(fx.series()) - 1).alias("x"))


@query(f"WITH {BARS}, {RET}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM ret WHERE x IS NOT NULL AND y IS NOT NULL) SELECT symbol, count(*) AS n, round({BETAS}, 5) AS beta, round(covar_pop(y, x) / nullif(sqrt(var_pop(x) * var_pop(y)), 0), 6) AS corr, round(pow(covar_pop(y, x), 2) / nullif(var_pop(x) * var_pop(y), 0), 6) AS r2 FROM l WHERE n <= 120 GROUP BY symbol")
def a22_market_betas(spark, sf_dir):
    g = mk.market_betas(_returns(spark, sf_dir), 120)
    return g.select("symbol", "n", F.round("beta", 5).alias("beta"), F.round("corr", 6).alias("corr"), F.round("r2", 6).alias("r2"))


@query(f"WITH {BARS}, {RET}, l AS (SELECT symbol, x, y, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM ret WHERE x IS NOT NULL AND y IS NOT NULL), g AS (SELECT symbol, covar_pop(y, x) FILTER (n <= 60) / nullif(var_pop(x) FILTER (n <= 60), 0) AS fast, covar_pop(y, x) FILTER (n <= 120) / nullif(var_pop(x) FILTER (n <= 120), 0) AS slow FROM l GROUP BY symbol) SELECT symbol, round(fast, 5) AS beta_60, round(slow, 5) AS beta_120, abs(fast - slow) >= greatest(0.35, 0.35 * abs(slow)) AS shifted FROM g")
def x15_relationship_graph(spark, sf_dir):
    r = _returns(spark, sf_dir)
    fast, slow = (mk.market_betas(r, k).select("symbol", F.col("beta").alias(f"beta_{k}")) for k in (60, 120))
    x = fast.join(slow, "symbol")
    return x.select("symbol", F.round("beta_60", 5).alias("beta_60"), F.round("beta_120", 5).alias("beta_120"), mk.regime_shift(F.col("beta_60"), F.col("beta_120")).alias("shifted"))


@query(f"WITH {BARS}, r AS (SELECT symbol, date, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS y FROM bars) SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(covar_pop(a.y, b.y) / nullif(var_pop(b.y), 0), 5) + 0 AS beta, round(covar_pop(a.y, b.y) / nullif(sqrt(var_pop(a.y) * var_pop(b.y)), 0), 5) + 0 AS corr FROM r a JOIN r b ON a.date = b.date AND a.symbol <> b.symbol WHERE a.y IS NOT NULL AND b.y IS NOT NULL GROUP BY a.symbol, b.symbol HAVING count(*) >= 20")
def j05_all_pairs(spark, sf_dir):
    r = bars(spark, sf_dir).select("symbol", "date", F.log(F.col("close") / F.lag("close").over(fx.series())).alias("y"))
    return mk.pair_statistics(r, digits=5)


@query(f"""WITH {BARS}, {EVENTS}, {RET}, h AS (SELECT * FROM (VALUES ('T0', 0), ('T1', 1), ('T3', 3)) AS t(horizon, days)),
b AS (SELECT event_id, evn.symbol, event_date, max(b.date) AS bd, arg_max(b.close, b.date) AS base FROM evn LEFT JOIN bars b ON b.symbol = evn.symbol AND b.date < event_date GROUP BY 1, 2, 3),
t AS (SELECT b.event_id, horizon, b.symbol, event_date, base, min(r.date) AS ref_date, arg_min(r.close, r.date) AS ref FROM b, h LEFT JOIN bars r ON r.symbol = b.symbol AND r.date >= (event_date::DATE + days)::VARCHAR GROUP BY 1, 2, 3, 4, 5),
l AS (SELECT symbol, x, y, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM ret WHERE x IS NOT NULL AND y IS NOT NULL), bt0 AS (SELECT symbol, count(*) AS m, covar_pop(y, x) FILTER (n <= 120) / nullif(var_pop(x) FILTER (n <= 120), 0) AS sl, covar_pop(y, x) FILTER (n <= 60) / nullif(var_pop(x) FILTER (n <= 60), 0) AS fa FROM l GROUP BY symbol),
bt AS (SELECT symbol, CASE WHEN m >= 110 THEN sl WHEN m >= 50 THEN fa END AS beta, CASE WHEN m >= 110 THEN 'beta_120' WHEN m >= 50 THEN 'beta_60' END AS src FROM bt0),
q AS (SELECT t.*, (SELECT arg_max(bench, date) FROM bench WHERE date < event_date) AS b0, (SELECT bench FROM bench WHERE bench.date = t.ref_date) AS b1 FROM t)
SELECT event_id, horizon, ref_date, round((ref / base - 1) * 100, 4) AS raw_return_pct, round((b1 / b0 - 1) * 100, 4) AS benchmark_return_pct, coalesce(src, 'benchmark_fallback') AS beta_source, round(round((ref / base - 1) * 100, 4) - coalesce(beta, 1.0) * round((b1 / b0 - 1) * 100, 4), 2) AS abnormal_return_pct FROM q LEFT JOIN bt ON bt.symbol = q.symbol""")
def e07_event_reactions(spark, sf_dir):
    b = bars(spark, sf_dir)
    e = mk.previous_close(_events(spark, sf_dir), b)
    e = e.withColumn("h", F.explode(F.array(*[F.struct(F.lit(n).alias("horizon"), F.lit(d).alias("days")) for n, d in (("T0", 0), ("T1", 1), ("T3", 3))]))).select("*", "h.*").drop("h")
    e = e.withColumn("target_date", F.date_format(F.date_add(F.col("event_date").cast("date"), F.col("days")), "yyyy-MM-dd"))
    e = mk.close_on_or_after(e.drop("base_date"), b)
    # The benchmark is one series: its last value before the event and its value on the reference date.
    bench = benchmark_series(b)
    series = bench.select(F.lit(0).cast("long").alias("symbol"), "date", F.col("bench").alias("close"))
    before = mk.previous_close(e.select(F.lit(0).cast("long").alias("symbol"), "event_date").distinct(), series).select("event_date", F.col("base_close").alias("b0"))
    e = e.join(before, "event_date", "left").join(bench.select(F.col("date").alias("ref_date"), F.col("bench").alias("b1")), "ref_date", "left")
    e = e.join(mk.beta_lookup(e.select("symbol").distinct(), _returns(spark, sf_dir)), "symbol", "left")
    raw, bm = F.round((F.col("ref_close") / F.col("base_close") - 1) * 100, 4), F.round((F.col("b1") / F.col("b0") - 1) * 100, 4)
    return e.select("event_id", "horizon", "ref_date", raw.alias("raw_return_pct"), bm.alias("benchmark_return_pct"), F.col("source").alias("beta_source"), F.round(raw - F.col("beta") * bm, 2).alias("abnormal_return_pct"))


@query(f"WITH {BARS}, {EVENTS}, h AS (SELECT unnest(['T0','T1','T3']) AS horizon) SELECT event_id, symbol, horizon FROM evn, h WHERE NOT (event_id % 3 = 0 AND horizon = 'T0')")
def j20_pending_reactions(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "symbol", F.explode(F.array(*[F.lit(x) for x in ("T0", "T1", "T3")])).alias("horizon"))
    done = e.where((F.col("event_id") % 3 == 0) & (F.col("horizon") == "T0")).select("event_id", "horizon")
    return e.join(done, ["event_id", "horizon"], "left_anti").select("event_id", "symbol", "horizon")


@query(f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, count(*) OVER (PARTITION BY symbol) AS t FROM bars)
SELECT a.symbol, a.date, count(b.i)::INT AS observed, count(b.i) = 10 AS complete, (min(b.i - a.i) FILTER (b.high >= a.close * 1.3))::INT AS up_step, (min(b.i - a.i) FILTER (b.low <= a.close * 0.7))::INT AS down_step,
  CASE WHEN count(b.i) = 10 THEN round(arg_max(b.close / a.close - 1, b.i), 6) END AS terminal, CASE WHEN count(b.i) = 10 THEN round(greatest(0, max(b.high / a.close - 1)), 6) END AS favourable, CASE WHEN count(b.i) = 10 THEN round(least(0, min(b.low / a.close - 1)), 6) END AS adverse
FROM n a LEFT JOIN n b ON b.symbol = a.symbol AND b.i BETWEEN a.i + 1 AND a.i + 10 GROUP BY a.symbol, a.date, a.close, a.i""")
def w16_first_touch(spark, sf_dir):
    x = mk.first_touch(bars(spark, sf_dir), 10, 0.3, 0.3)
    return x.withColumns({c: F.round(c, 6) for c in ("terminal", "favourable", "adverse")})


TOUCH = f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars), p AS (SELECT a.symbol, a.i, count(b.i) AS obs, min(b.i - a.i) FILTER (b.high >= a.close * 1.3) AS up FROM n a LEFT JOIN n b ON b.symbol = a.symbol AND b.i BETWEEN a.i + 1 AND a.i + 10 GROUP BY a.symbol, a.i)"""


@query(TOUCH + " SELECT symbol, count(*) AS origins, sum((obs = 10)::INT)::BIGINT AS complete_n, (sum((up IS NOT NULL)::INT) FILTER (obs = 10))::BIGINT AS hits, round(sum((up IS NOT NULL)::INT) / count(*)::DOUBLE, 6) AS low_bound, round(sum((up IS NOT NULL OR obs < 10)::INT) / count(*)::DOUBLE, 6) AS high_bound FROM p GROUP BY symbol")
def e04_path_summary(spark, sf_dir):
    x = mk.first_touch(bars(spark, sf_dir), 10, 0.3, 0.3)
    known, open_ = F.col("up_step").isNotNull(), ~F.col("complete") & F.col("up_step").isNull()
    return x.groupBy("symbol").agg(F.count("*").alias("origins"), F.count_if("complete").alias("complete_n"), F.count_if(F.col("complete") & known).alias("hits"), F.round(F.count_if(known) / F.count("*"), 6).alias("low_bound"), F.round(F.count_if(known | open_) / F.count("*"), 6).alias("high_bound"))


@query(f"""WITH {BARS}, r AS (SELECT *, ln(close / lag(close) OVER s) AS r, count(*) OVER w AS n, close / first_value(close) OVER w - 1 AS tr, close / max(high) OVER w - 1 AS dd FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY date), w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
v AS (SELECT *, stddev_samp(r) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252) AS vol FROM r)
SELECT symbol, date, CASE WHEN n = 21 THEN round(tr, 6) END AS trailing_return, CASE WHEN n = 21 THEN round(dd, 6) END AS drawdown, CASE WHEN n = 21 THEN round(vol, 5) END AS realised_vol FROM v""")
def w15_path_features(spark, sf_dir):
    x = mk.path_features(bars(spark, sf_dir), 20)
    return x.select("symbol", "date", F.round("trailing_return", 6).alias("trailing_return"), F.round("drawdown", 6).alias("drawdown"), F.round("realised_vol", 5).alias("realised_vol"))


@query(f"""WITH RECURSIVE {BARS}, n AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS p FROM bars), d AS (SELECT symbol, i FROM n WHERE close < p),
g AS (SELECT symbol, min(i) AS i FROM d GROUP BY symbol UNION ALL SELECT g.symbol, (SELECT min(d.i) FROM d WHERE d.symbol = g.symbol AND d.i > g.i + 10) FROM g WHERE g.i IS NOT NULL) SELECT symbol, i::BIGINT AS i FROM g WHERE i IS NOT NULL""")
def e03_greedy_origins(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("date")
    x = bars(spark, sf_dir).select("symbol", F.row_number().over(w).cast("long").alias("i"), (F.col("close") < F.lag("close").over(w)).alias("down")).where("down")
    return mk.greedy_origins(x.select("symbol", "i"), "symbol", "i", 10)


@query(f"WITH {BARS}, p AS (SELECT a.symbol, a.date, a.close AS a, b.close AS b, c.close AS c FROM bars a JOIN bars b ON b.symbol = a.symbol + 1 AND b.date = a.date JOIN bars c ON c.symbol = a.symbol + 2 AND c.date = a.date), r AS (SELECT symbol, date, 100 * (a / lag(a) OVER w - 1) AS ra, 100 * (b / lag(b) OVER w - 1) AS rb, 100 * (c / lag(c) OVER w - 1) AS rc FROM p WINDOW w AS (PARTITION BY symbol ORDER BY date)) SELECT symbol, date, CASE WHEN ra <= -0.25 AND rb >= 0.25 AND rc >= 0.25 THEN 'diverging_down' WHEN ra >= 0.25 AND rb <= -0.25 AND rc <= -0.25 THEN 'diverging_up' ELSE 'aligned' END AS state, coalesce(ra < 0 AND rb < 0 AND ra / nullif(rb, 0) >= 2.0, false) AS weak_2x FROM r WHERE ra IS NOT NULL")
def e09_divergence(spark, sf_dir):
    """Every symbol against the next two, on the dates that all three have."""
    b = bars(spark, sf_dir)
    at = lambda k, n: b.select((F.col("symbol") - k).alias("symbol"), "date", F.col("close").alias(n))
    p = at(0, "a").join(at(1, "b"), ["symbol", "date"]).join(at(2, "c"), ["symbol", "date"])
    w = fx.series()
    r = p.select("symbol", "date", *[(100 * (F.col(c) / F.lag(c).over(w) - 1)).alias(f"r{c}") for c in "abc"]).where("ra is not null")
    state = F.when((F.col("ra") <= -0.25) & (F.col("rb") >= 0.25) & (F.col("rc") >= 0.25), "diverging_down").when((F.col("ra") >= 0.25) & (F.col("rb") <= -0.25) & (F.col("rc") <= -0.25), "diverging_up").otherwise("aligned")
    return r.select("symbol", "date", state.alias("state"), F.coalesce((F.col("ra") < 0) & (F.col("rb") < 0) & (F.try_divide("ra", "rb") >= 2.0), F.lit(False)).alias("weak_2x"))


@query(f"WITH {CHAIN} SELECT underlying, strike, sum(CASE WHEN side = 'C' THEN open_interest ELSE 0 END)::BIGINT AS call_oi, sum(CASE WHEN side = 'P' THEN open_interest ELSE 0 END)::BIGINT AS put_oi, count(*) AS contracts FROM chain GROUP BY underlying, strike")
def a11_by_strike(spark, sf_dir):
    oi = lambda s: F.sum(F.when(F.col("side") == s, F.col("open_interest")).otherwise(0))
    return chain(spark, sf_dir).groupBy("underlying", "strike").agg(oi("C").alias("call_oi"), oi("P").alias("put_oi"), F.count("*").alias("contracts"))


@query(f"WITH {CHAIN} SELECT underlying, round(sum(volume) FILTER (side = 'P') / sum(volume) FILTER (side = 'C'), 6) AS put_call_volume, round(sum(open_interest) FILTER (side = 'P') / sum(open_interest) FILTER (side = 'C'), 6) AS put_call_oi, sum(open_interest)::BIGINT AS total_oi, min(expiry)::VARCHAR AS nearest_expiry FROM chain GROUP BY underlying")
def a12_positioning(spark, sf_dir):
    x = mk.positioning(chain(spark, sf_dir))
    return x.withColumns({c: F.round(c, 6) for c in ("put_call_volume", "put_call_oi")})


GEX = f"""{CHAIN}, ex0 AS (SELECT *, datediff('day', DATE '{AS_OF}', expiry) / 365.0::DOUBLE AS years, CASE WHEN side = 'C' THEN 1 ELSE -1 END AS sgn FROM chain),
ex1 AS (SELECT *, (ln(spot / strike) + (0.04 + 0.5 * iv * iv) * years) / (iv * sqrt(years)) AS d1 FROM ex0),
ex AS (SELECT *, exp(-0.5 * d1 * d1) / sqrt(6.283185307179586) / (spot * iv * sqrt(years)) * open_interest * 100 * spot * spot * 0.01 * sgn AS gex FROM ex1),
st AS (SELECT underlying, strike, sum(gex) AS net_gex, max(spot) AS spot FROM ex GROUP BY underlying, strike)"""


@query(f"WITH {GEX} SELECT underlying, arg_min(strike, net_gex) FILTER (strike < spot) AS put_wall, arg_max(strike, net_gex) FILTER (strike >= spot) AS call_wall FROM st GROUP BY underlying")
def g02_walls(spark, sf_dir):
    return mk.walls(mk.by_strike(mk.exposure(chain(spark, sf_dir), AS_OF))).select("underlying", "put_wall", "call_wall")


@query(f"WITH {GEX}, t AS (SELECT *, row_number() OVER (PARTITION BY underlying ORDER BY abs(net_gex) DESC, strike) AS rn FROM st) SELECT underlying, strike, round(net_gex, 2) AS net_gex, rn::INT AS rank FROM t WHERE rn <= 8")
def t03_top_strikes(spark, sf_dir):
    st = mk.by_strike(mk.exposure(chain(spark, sf_dir), AS_OF))
    w = Window.partitionBy("underlying").orderBy(F.desc(F.abs("net_gex")), "strike")
    return st.withColumn("rank", F.row_number().over(w)).where("rank <= 8").select("underlying", "strike", F.round("net_gex", 2).alias("net_gex"), "rank")


PROFILE = f"""{GEX}, g AS (SELECT underlying, i, spot, spot * (0.5 + i / 400.0::DOUBLE) AS x, strike, years, iv, open_interest, sgn FROM ex, (SELECT unnest(range(401)) AS i)),
pf AS (SELECT underlying, i, any_value(x) AS x, any_value(spot) AS spot, sum(sgn * exp(-0.5 * pow((ln(x / strike) + (0.04 + 0.5 * iv * iv) * years) / (iv * sqrt(years)), 2)) / sqrt(6.283185307179586) / (x * iv * sqrt(years)) * open_interest * x * x) AS value FROM g GROUP BY underlying, i)"""


@query(f"""WITH {PROFILE}, l AS (SELECT *, lag(x) OVER w AS px, lag(value) OVER w AS pv FROM pf WHERE value <> 0 WINDOW w AS (PARTITION BY underlying ORDER BY i)), br AS (SELECT underlying, spot, i AS bracket, px AS lo, x AS hi FROM l WHERE pv IS NOT NULL AND sign(pv) <> sign(value)),
g2 AS (SELECT ex.underlying, bracket, br.spot, j, lo + (hi - lo) * j / 400.0::DOUBLE AS x, strike, years, iv, open_interest, sgn FROM ex JOIN br ON br.underlying = ex.underlying, (SELECT unnest(range(401)) AS j)),
p2 AS (SELECT underlying, bracket, j, any_value(x) AS x, any_value(spot) AS spot, sum(sgn * exp(-0.5 * pow((ln(x / strike) + (0.04 + 0.5 * iv * iv) * years) / (iv * sqrt(years)), 2)) / sqrt(6.283185307179586) / (x * iv * sqrt(years)) * open_interest * x * x) AS value FROM g2 GROUP BY 1, 2, 3),
l2 AS (SELECT *, lag(x) OVER w AS px, lag(value) OVER w AS pv FROM p2 WHERE value <> 0 WINDOW w AS (PARTITION BY underlying, bracket ORDER BY j)), r AS (SELECT underlying, spot, px - pv * (x - px) / (value - pv) AS root FROM l2 WHERE pv IS NOT NULL AND sign(pv) <> sign(value))
SELECT underlying, count(*) AS roots, round(arg_min(root, abs(root - spot)), 4) AS flip FROM r GROUP BY underlying""")
def g01_exposure_flip(spark, sf_dir):
    c = chain(spark, sf_dir)
    return mk.flip(mk.exposure_roots(c, AS_OF), c.groupBy("underlying").agg(F.max("spot").alias("spot"))).select("underlying", "roots", F.round("flip", 4).alias("flip"))


@query(f"WITH {CHAIN}, n AS (SELECT *, row_number() OVER (PARTITION BY underlying, expiry, side ORDER BY abs(strike - spot), strike, contract_id) AS a, row_number() OVER (PARTITION BY underlying, expiry, side ORDER BY abs(abs(delta) - 0.25), strike, contract_id) AS d FROM chain) SELECT underlying, expiry::VARCHAR AS expiry, round(avg(iv) FILTER (a = 1), 6) AS atm_iv, round(max(iv) FILTER (d = 1 AND side = 'P') - max(iv) FILTER (d = 1 AND side = 'C'), 6) + 0 AS skew_25d FROM n GROUP BY underlying, expiry HAVING count(DISTINCT side) = 2")
def g03_iv_and_skew(spark, sf_dir):
    w = Window.partitionBy("underlying", "expiry", "side")
    x = chain(spark, sf_dir).withColumns({"a": F.row_number().over(w.orderBy(F.abs(F.col("strike") - F.col("spot")), "strike", "contract_id")), "d": F.row_number().over(w.orderBy(F.abs(F.abs("delta") - 0.25), "strike", "contract_id"))})
    at = lambda s: F.max(F.when((F.col("d") == 1) & (F.col("side") == s), F.col("iv")))
    g = x.groupBy("underlying", "expiry").agg(F.round(F.avg(F.when(F.col("a") == 1, F.col("iv"))), 6).alias("atm_iv"), F.round(at("P") - at("C"), 6).alias("skew_25d"), F.count_distinct("side").alias("n")).where("n = 2")
    return g.select("underlying", F.date_format("expiry", "yyyy-MM-dd").alias("expiry"), "atm_iv", "skew_25d")


@query(f"WITH {CHAIN}, n AS (SELECT *, row_number() OVER (PARTITION BY underlying, side ORDER BY abs(strike - spot), contract_id) AS a FROM chain), s AS (SELECT underlying, sum((bid + ask) / 2) AS straddle, max(spot) AS spot FROM n WHERE a = 1 GROUP BY underlying) SELECT underlying, round(100 * straddle / spot, 6) AS implied_move_pct, CASE WHEN 100 * straddle / spot / 1.0 >= 1.25 THEN 'RICH' WHEN 100 * straddle / spot / 1.0 <= 0.95 THEN 'CHEAP' ELSE 'FAIR' END AS label FROM s")
def e08_implied_move(spark, sf_dir):
    w = Window.partitionBy("underlying", "side").orderBy(F.abs(F.col("strike") - F.col("spot")), "contract_id")
    s = chain(spark, sf_dir).withColumn("a", F.row_number().over(w)).where("a = 1").groupBy("underlying").agg((100 * F.sum((F.col("bid") + F.col("ask")) / 2) / F.max("spot")).alias("m"))
    return s.select("underlying", F.round("m", 6).alias("implied_move_pct"), F.when(F.col("m") >= 1.25, "RICH").when(F.col("m") <= 0.95, "CHEAP").otherwise("FAIR").alias("label"))


#: The normal distribution as SQL: the fit that the engine uses, so that both agree to the last rounded digit.
ERFC = "(1 / (1 + {x} / 2)) * exp(-{x} * {x} - 1.26551223 + (1 / (1 + {x} / 2)) * (1.00002368 + (1 / (1 + {x} / 2)) * (0.37409196 + (1 / (1 + {x} / 2)) * (0.09678418 + (1 / (1 + {x} / 2)) * (-0.18628806 + (1 / (1 + {x} / 2)) * (0.27886807 + (1 / (1 + {x} / 2)) * (-1.13520398 + (1 / (1 + {x} / 2)) * (1.48851587 + (1 / (1 + {x} / 2)) * (-0.82215223 + (1 / (1 + {x} / 2)) * 0.17087277)))))))))"


def _cdf(x: str) -> str:
    tail = ERFC.format(x=f"(abs({x}) / sqrt(2.0::DOUBLE))")
    return f"(CASE WHEN {x} < 0 THEN {tail} / 2 ELSE 1 - {tail} / 2 END)"


@query(f"""WITH {CHAIN}, sc AS (SELECT unnest([0.9, 1.0, 1.1])::DOUBLE AS m), l0 AS (SELECT c.*, m, spot * m AS sp1, datediff('day', DATE '{AS_OF}', expiry) / 365.0::DOUBLE / 2 AS yrs, CASE WHEN side = 'C' THEN 1 ELSE -1 END AS sg FROM chain c, sc), l1 AS (SELECT *, (ln(sp1 / strike) + (0.04 + 0.5 * iv * iv) * yrs) / (iv * sqrt(yrs)) AS d1 FROM l0),
l AS (SELECT *, greatest(sg * (sp1 - strike), 0) - (bid + ask) / 2 AS pnl, sg * (sp1 * {_cdf("(sg * d1)")} - strike * exp(-0.04::DOUBLE * yrs) * {_cdf("(sg * (d1 - iv * sqrt(yrs)))")}) - (bid + ask) / 2 AS early FROM l1)
SELECT underlying, m AS scenario, count(*) AS legs, round(sum(pnl), 4) + 0 AS pnl, round(min(pnl), 4) + 0 AS worst_leg, round(sum(early), 3) + 0 AS pnl_half_way FROM l GROUP BY underlying, m""")
def g04_scenario_pnl(spark, sf_dir):
    """Every contract bought at its mid: profit at expiry, and by the model half-way there."""
    c = chain(spark, sf_dir).withColumn("m", F.explode(F.array(*[F.lit(x) for x in (0.9, 1.0, 1.1)])))
    at, mid = F.col("spot") * F.col("m"), (F.col("bid") + F.col("ask")) / 2
    years = F.datediff("expiry", F.lit(AS_OF).cast("date")) / 365.0 / 2
    c = c.withColumns({"pnl": mk.option_payoff(F.col("side"), F.col("strike"), at) - mid, "early": mk.option_value(F.col("side"), at, F.col("strike"), years, F.col("iv"), 0.04) - mid})
    return c.groupBy("underlying", F.col("m").alias("scenario")).agg(F.count("*").alias("legs"), F.round(F.sum("pnl"), 4).alias("pnl"), F.round(F.min("pnl"), 4).alias("worst_leg"), F.round(F.sum("early"), 3).alias("pnl_half_way"))


@query(f"""WITH {CHAIN}, lg AS (SELECT underlying, side, strike, (CASE WHEN contract_id % 3 = 0 THEN -1 ELSE 1 END)::DOUBLE AS qty, (bid + ask) / 2 AS cost FROM chain), kn AS (SELECT DISTINCT underlying, strike AS x FROM lg UNION SELECT DISTINCT underlying, 0.0 FROM lg),
v AS (SELECT kn.underlying, x, sum(qty * (CASE WHEN side = 'C' THEN greatest(x - strike, 0) ELSE greatest(strike - x, 0) END - cost)) AS v FROM kn JOIN lg ON lg.underlying = kn.underlying GROUP BY 1, 2), p AS (SELECT *, lag(x) OVER w AS px, lag(v) OVER w AS pv FROM v WINDOW w AS (PARTITION BY underlying ORDER BY x)),
r AS (SELECT *, CASE WHEN sign(pv) * sign(v) < 0 THEN px - pv * (x - px) / (v - pv) END AS root FROM p) SELECT underlying, round(min(v), 4) AS low, round(max(v), 4) AS high, count(root) AS break_evens, round(min(root), 4) AS first_break_even FROM r GROUP BY underlying""")
def g04_expiry_geometry(spark, sf_dir):
    """Every third contract sold, the others bought: extrema and break-evens of each underlying at expiry."""
    legs = chain(spark, sf_dir).select("underlying", "side", "strike", F.when(F.col("contract_id") % 3 == 0, -1.0).otherwise(1.0).alias("qty"), ((F.col("bid") + F.col("ask")) / 2).alias("cost"))
    x = mk.expiry_geometry(legs, "underlying")
    return x.select("underlying", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "break_evens", F.round("first_break_even", 4).alias("first_break_even"))


@query(f"WITH {CHAIN}, r AS MATERIALIZED (SELECT contract_id, ask, open_interest AS oi, iv FROM chain) SELECT a.contract_id FROM r a WHERE a.ask IS NOT NULL AND a.oi IS NOT NULL AND a.iv IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r b WHERE b.ask <= a.ask AND b.oi >= a.oi AND b.iv <= a.iv AND (b.ask < a.ask OR b.oi > a.oi OR b.iv < a.iv))")
def t08_pareto_front(spark, sf_dir):
    """Contracts that none beats in price, open interest and implied volatility at once."""
    return skyline(chain(spark, sf_dir).select("contract_id", "ask", "open_interest", "iv"), ["ask", "iv"], ["open_interest"]).select("contract_id")


def _levels(spark, sf_dir):
    return levels(book(spark, sf_dir))


def _named(spark, sf_dir, x):
    return x.join(book(spark, sf_dir).select("symbol", "session_id", "snap", "event_id"), ["symbol", "session_id", "snap"])


@query(f"WITH {BOOK}, {LEVELS} SELECT event_id, side, count(*) AS n, min(ticks) AS low_ticks, max(ticks) AS high_ticks, sum(volume)::BIGINT AS depth, median(volume) AS mid_volume FROM levels GROUP BY event_id, side")
def m01_levels(spark, sf_dir):
    return _levels(spark, sf_dir).groupBy("event_id", F.col("side").cast("long").alias("side")).agg(F.count("*").alias("n"), F.min("ticks").alias("low_ticks"), F.max("ticks").alias("high_ticks"), F.sum("volume").alias("depth"), F.percentile("volume", F.lit(0.5)).alias("mid_volume"))


@query(f"WITH {BOOK}, g AS (SELECT event_id, ts_ms - lag(ts_ms) OVER w AS gap_ms, cumulative_volume - lag(cumulative_volume) OVER w AS traded FROM book WINDOW w AS (PARTITION BY symbol, session_id ORDER BY snap)) SELECT event_id, gap_ms, traded, coalesce(gap_ms > 3600000, false) AS gap_too_long, coalesce(traded < 0, false) AS volume_fell FROM g")
def m02_sequence_context(spark, sf_dir):
    w = Window.partitionBy("symbol", "session_id").orderBy("snap")
    g = book(spark, sf_dir).select("event_id", (F.col("ts_ms") - F.lag("ts_ms").over(w)).alias("gap_ms"), (F.col("cumulative_volume") - F.lag("cumulative_volume").over(w)).alias("traded"))
    return g.select("*", F.coalesce(F.col("gap_ms") > 3_600_000, F.lit(False)).alias("gap_too_long"), F.coalesce(F.col("traded") < 0, F.lit(False)).alias("volume_fell"))


@query(f"""WITH {BOOK}, {LEVELS}, b AS (SELECT * FROM levels WHERE side = 1), md AS (SELECT a.event_id, median(o.volume) AS base FROM book a JOIN b o ON o.symbol = a.symbol AND o.session_id = a.session_id AND o.snap BETWEEN a.snap - 2 AND a.snap - 1 AND o.volume > 0 WHERE a.snap >= 2 GROUP BY a.event_id),
x AS (SELECT a.event_id, a.volume - coalesce(p.volume, 0) AS added, base FROM b a JOIN md ON md.event_id = a.event_id LEFT JOIN b p ON p.symbol = a.symbol AND p.session_id = a.session_id AND p.snap = a.snap - 1 AND p.ticks = a.ticks)
SELECT event_id, round(max(least(1.0, added / (2.0 * greatest(base * 1.5, 100.0)))), 6) AS strength FROM x WHERE added > base * 1.5 AND added >= 100 GROUP BY event_id""")
def m03_order_wall(spark, sf_dir):
    x = mk.order_wall(_levels(spark, sf_dir), 1, 1.5, 2, 100.0)
    return _named(spark, sf_dir, x).select("event_id", F.round("strength", 6).alias("strength"))


@query(f"WITH {BOOK}, {LEVELS}, s AS (SELECT event_id, sum(volume) FILTER (side = 1) AS bid, sum(volume) FILTER (side = 2) AS ask FROM levels GROUP BY event_id) SELECT event_id, bid / ask > 1.02 AS fired, round(least(1.0, bid / ask / 2.04), 6) AS strength FROM s WHERE bid > 0 AND ask > 0 AND bid + ask >= 1000")
def m04_imbalance(spark, sf_dir):
    return _named(spark, sf_dir, mk.imbalance(_levels(spark, sf_dir), 1.02)).select("event_id", "fired", F.round("strength", 6).alias("strength"))


@query(f"""WITH {BOOK}, d AS (SELECT *, cumulative_volume - lag(cumulative_volume) OVER w AS delta, round(last_price*100)::BIGINT AS t, lag(round(last_price*100)::BIGINT) OVER w AS pt FROM book WINDOW w AS (PARTITION BY symbol, session_id ORDER BY snap)),
m AS (SELECT *, median(delta) OVER w2 AS mid, count(delta) OVER w2 AS n FROM d WINDOW w2 AS (PARTITION BY symbol, session_id ORDER BY snap ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING))
SELECT event_id, delta > greatest(10.0, 1.2 * mid) AND t - pt >= 1 AND t >= pt + 1 AS fired, round(least(1.0, delta / (2.0 * greatest(10.0, 1.2 * mid))), 6) AS strength FROM m WHERE n = 2""")
def m05_ignition(spark, sf_dir):
    return _named(spark, sf_dir, mk.ignition(book(spark, sf_dir), 1.2, 2, 10.0)).select("event_id", "fired", F.round("strength", 6).alias("strength"))


@query(f"""WITH {BARS}, o AS (SELECT *, row_number() OVER s AS i, coalesce(close < lag(close, 4) OVER s, false) AS ok FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY date)),
r AS (SELECT *, i - coalesce(max(CASE WHEN NOT ok THEN i END) OVER (PARTITION BY symbol ORDER BY date), 0) AS setup FROM o) SELECT symbol, date, setup::INT AS setup, setup = 9 AS fired FROM r""")
def m09_setup(spark, sf_dir):
    return mk.setup_count(bars(spark, sf_dir)).select("symbol", "date", "setup", (F.col("setup") == 9).alias("fired"))


@query(f"""WITH {BARS}, o AS (SELECT *, row_number() OVER s AS i, coalesce(close < lag(close, 4) OVER s, false) AS ok, coalesce(close <= lag(low, 2) OVER s, false)::INT AS hit FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY date)),
r AS (SELECT *, i - coalesce(max(CASE WHEN NOT ok THEN i END) OVER (PARTITION BY symbol ORDER BY date), 0) AS setup FROM o),
d AS (SELECT *, last_value(CASE WHEN setup = 9 THEN i END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM r)
SELECT symbol, date, least(13, sum(hit) OVER (PARTITION BY symbol, since ORDER BY date))::INT AS countdown FROM d WHERE since IS NOT NULL""")
def m09_countdown(spark, sf_dir):
    return mk.countdown(mk.setup_count(bars(spark, sf_dir)))
