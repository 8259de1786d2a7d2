"""Checkpoints, postures, lifecycles, pair graphs and registers of studies over the given tables, and the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import checkpoints as ck
from marlstone.operators import evidence as ev
from marlstone.operators import factors as fx
from marlstone.operators import lifecycles as lc
from marlstone.operators import market as mk
from marlstone.operators import states as sx
from marlstone.plans import market_queries as mq
from marlstone.plans.ledger_queries import LOTS
from marlstone.plans.market_queries import RET
from marlstone.sources.bindings import BARS, CHAIN, CHECKPOINTS, JOURNAL, ORDER_LOG, bars, chain, checkpoints, events, journal, order_log, read
from marlstone.streaming import detectors, streams

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- checkpoint reads -------------------------------------------------------------------------------------------

ZONES = f"""{CHECKPOINTS}, z0 AS (SELECT *, coalesce(put_wall <= gamma_flip AND gamma_flip <= call_wall, false) AS good FROM cp),
z1 AS (SELECT *, CASE WHEN NOT good THEN 'unavailable' WHEN spot < put_wall THEN 'below_put_wall' WHEN spot < gamma_flip THEN 'put_to_flip' WHEN spot <= call_wall THEN 'flip_to_call' ELSE 'above_call_wall' END AS zone,
  CASE WHEN NOT good THEN 'invalid' WHEN option_session = 'RTH' AND expiry_scope = '0DTE' AND gamma_age <= 180 THEN 'confirmed_live' WHEN gamma_age <= 1200 THEN 'delayed_reference' ELSE 'stale_for_checkpoint' END AS gamma_status,
  CASE WHEN net_gex < 0 THEN 'negative' WHEN net_gex > 0 THEN 'positive' ELSE 'unknown' END AS regime FROM z0),
zn AS (SELECT *, CASE WHEN regime = 'negative' AND zone IN ('below_put_wall', 'put_to_flip') THEN CASE WHEN vrp < 0 THEN 'breakdown_amplification' ELSE 'negative_gamma_below_flip' END WHEN regime = 'positive' AND zone = 'flip_to_call' AND vrp >= 0 THEN 'pin_possible_not_directional' ELSE 'neutral' END AS risk_state FROM z1)"""


@query(f"WITH {ZONES} SELECT k, zone, gamma_status, regime, risk_state FROM zn")
def g06_exposure_zone(spark, sf_dir):
    return ck.exposure_zone(checkpoints(spark, sf_dir)).select("k", "zone", "gamma_status", "regime", "risk_state")


EXECUTION = """x0 AS (SELECT *, CASE WHEN bid > 0 AND ask >= bid THEN (bid + ask) / 2 END AS mid, CASE WHEN side = 'buy' THEN ask_size ELSE bid_size END AS size FROM cp),
x1 AS (SELECT *, (ask - bid) / mid AS spread FROM x0),
x2 AS (SELECT *, round(coalesce(spread * 10000, 0) * CASE WHEN order_type = 'market' THEN 1.0 ELSE 0.5 END + coalesce(slippage_bps, 0) + coalesce(fees_bps, 0), 4) AS hurdle FROM x1),
x3 AS (SELECT *, list_filter([CASE WHEN order_type NOT IN ('market','limit_mid','limit') THEN 'unknown_order_type' END, CASE WHEN side NOT IN ('buy','sell') THEN 'unknown_order_side' END, CASE WHEN mid IS NULL THEN 'invalid_or_missing_bbo' END,
  CASE WHEN coalesce(quote_age > 5, true) THEN 'stale_option_quote' END, CASE WHEN contracts <= 0 OR size < contracts THEN 'insufficient_top_of_book_size' END, CASE WHEN coalesce(spread > 0.1, true) THEN 'spread_too_wide' END,
  CASE WHEN expected_edge_bps IS NULL THEN 'cost_edge_unknown' WHEN expected_edge_bps <= hurdle THEN 'cost_edge_negative_after_friction' END], lambda c: c IS NOT NULL) AS fails FROM x2),
xq AS (SELECT *, CASE WHEN len(fails) > 0 THEN 'no_trade' WHEN order_type = 'market' OR volume = 0 THEN 'limit_only' ELSE 'eligible' END AS execution_status FROM x3)"""


@query(f"WITH {CHECKPOINTS}, {EXECUTION} SELECT k, hurdle AS hurdle_bps, array_to_string(fails, ',') AS failures, execution_status FROM xq")
def g06_quote_execution(spark, sf_dir):
    return ck.execution_quality(checkpoints(spark, sf_dir)).select("k", "hurdle_bps", F.array_join("failures", ",").alias("failures"), "execution_status")


CONTINUITY = """c0 AS (SELECT *, CASE WHEN range_high > range_low THEN (last - range_low) / (range_high - range_low) END AS pl FROM cp),
c1 AS (SELECT *, list_filter([CASE WHEN direction = 'short' THEN last <= previous_close ELSE last >= previous_close END::INT, CASE WHEN direction = 'short' THEN last <= vwap ELSE last >= vwap END::INT, (CASE WHEN direction = 'short' THEN 1 - pl ELSE pl END >= 0.5)::INT, (relative_volume >= 0.8)::INT,
  CASE WHEN breadth IS NOT NULL AND sector IS NOT NULL THEN (breadth AND sector)::INT END], lambda c: c IS NOT NULL) AS h FROM c0),
cn AS (SELECT *, 5 - len(h) AS missing, round(list_sum(h) / len(h)::DOUBLE, 4) AS score FROM c1),
ct AS (SELECT *, CASE WHEN missing >= 2 OR score IS NULL THEN 'data_gap' WHEN score >= 0.7 THEN 'pass' WHEN score < 0.4 THEN 'fail' ELSE 'mixed' END AS continuity_status FROM cn)"""


@query(f"WITH {CHECKPOINTS}, {CONTINUITY} SELECT k, score AS continuity_score, missing::INT AS continuity_missing, continuity_status FROM ct")
def g06_continuity(spark, sf_dir):
    return ck.continuity(checkpoints(spark, sf_dir)).select("k", "continuity_score", F.col("continuity_missing").cast("int").alias("continuity_missing"), "continuity_status")


@query(f"""WITH {ZONES}, {EXECUTION}, {CONTINUITY}, o0 AS (SELECT cp.*, zn.gamma_status, zn.risk_state, xq.execution_status, ct.continuity_status, CASE cp.action_cap WHEN 'L1' THEN 1 WHEN 'L2' THEN 2 WHEN 'L3' THEN 3 ELSE 0 END AS up FROM cp JOIN zn ON zn.k = cp.k JOIN xq ON xq.k = cp.k JOIN ct ON ct.k = cp.k),
o1 AS (SELECT *, CASE WHEN checkpoint = 'eod_review' THEN 1 WHEN market_scope <> 'US_only' THEN 2 WHEN up = 0 OR NOT thesis_valid THEN 3 WHEN pre_open_status = 'weak' THEN 4 WHEN checkpoint <> 'open_0940' THEN 5 WHEN continuity_status = 'pass' THEN 6 WHEN continuity_status = 'fail' THEN 7 ELSE 8 END AS n,
  risk_state IN ('breakdown_amplification', 'negative_gamma_below_flip') AND direction = 'long' AS risky, gamma_status = 'confirmed_live' AS live, gamma_status IN ('invalid', 'stale_for_checkpoint') AS old FROM o0),
o2 AS (SELECT *, ['review_only','inapplicable','no_trade','exit_at_open','eligible','recompile_intraday','exit_or_reduce_by_0940','data_gap'][n] AS v0, ['eod_review_only','non_us_scope','upstream_not_executable','pre_open_read_weak','checkpoint_eligible','continuity_pass','continuity_failed','continuity_mixed_or_incomplete'][n] AS reason,
  CASE WHEN n IN (1, 5, 6) THEN up WHEN n = 8 THEN least(up, 1) ELSE 0 END AS base, [1.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.5][n]::DOUBLE AS multiplier, CASE WHEN risky THEN least(CASE WHEN live THEN 0 ELSE 1 END, up) WHEN old THEN least(1, up) END AS gc, CASE execution_status WHEN 'no_trade' THEN 0 WHEN 'limit_only' THEN least(1, up) END AS oc FROM o1)
SELECT k, CASE WHEN n <= 4 THEN v0 WHEN risky AND live THEN 'exit_or_reduce_by_0940' WHEN (risky OR old) AND checkpoint = 'open_0940' THEN 'data_gap' ELSE v0 END AS verdict, reason, multiplier, 'L' || base::VARCHAR AS base_cap, 'L' || gc::VARCHAR AS gamma_cap, 'L' || oc::VARCHAR AS option_cap, 'L' || least(up, base, gc, oc)::VARCHAR AS final_cap FROM o2""")
def l19_checkpoint_overlay(spark, sf_dir):
    x = ck.overlay(ck.continuity(ck.execution_quality(ck.exposure_zone(checkpoints(spark, sf_dir)))))
    return x.select("k", "verdict", "reason", "multiplier", "base_cap", "gamma_cap", "option_cap", "final_cap")


BPS = "round(CASE WHEN direction = 'short' THEN -1 ELSE 1 END * ({b} / {a} - 1.0::DOUBLE) * 10000, 4)"


@query(f"""WITH {CHECKPOINTS}, m AS (SELECT *, coalesce(realized_cost_bps, 0) AS cost, coalesce(estimated_cost_bps, 0) AS guess, {BPS.format(a='entry_price', b='open_price')} AS co, {BPS.format(a='open_price', b='price_0940')} AS o9, {BPS.format(a='price_0940', b='close_price')} AS c9, {BPS.format(a='entry_price', b='exit_price')} AS ex, {BPS.format(a='entry_price', b='price_0940')} AS cf FROM cp),
n AS (SELECT k, round(co - cost, 4) AS close_to_open_net_bps, o9 + 0 AS open_to_0940_bps, c9 + 0 AS to_close_bps, round(ex - cost, 4) AS exit_net_bps, round(cf - cost, 4) AS counterfactual_net_bps, round(cost - guess, 4) AS cost_error_bps FROM m)
SELECT *, array_to_string(list_filter([CASE WHEN cost_error_bps > 0 THEN 'execution_cost_underestimated' END, CASE WHEN exit_net_bps < counterfactual_net_bps THEN 'late_exit_vs_0940' END], lambda c: c IS NOT NULL), ',') AS labels, CASE WHEN open_to_0940_bps IS NULL OR exit_net_bps IS NULL THEN 'partial_data' ELSE 'reviewed' END AS review_status FROM n""")
def l16_eod_review(spark, sf_dir):
    x = ck.review(checkpoints(spark, sf_dir))
    zero = lambda c: (F.col(c) + F.lit(0.0)).alias(c)  # noqa: E731 - no negative zero
    return x.select("k", *[zero(c) for c in ("close_to_open_net_bps", "open_to_0940_bps", "to_close_bps", "exit_net_bps", "counterfactual_net_bps", "cost_error_bps")], F.array_join("labels", ",").alias("labels"), "review_status")


@query(f"WITH {CHECKPOINTS} SELECT k, round(CASE WHEN direction = 'short' THEN -1 ELSE 1 END * (exit_price - entry_price) / entry_price * 100.0::DOUBLE, 6) + 0 AS directional_return, {BPS.format(a='entry_price', b='exit_price')} + 0 AS signed_bps FROM cp")
def f09_directional_return(spark, sf_dir):
    c = F.col
    x = checkpoints(spark, sf_dir)
    return x.select("k", (F.round(ck.directional_return(c("direction"), c("entry_price"), c("exit_price")), 6) + F.lit(0.0)).alias("directional_return"), (ck.signed_bps(c("entry_price"), c("exit_price"), c("direction")) + F.lit(0.0)).alias("signed_bps"))


MODULES = ("account", "macro", "portfolio_risk_budget", "trend")


@query(f"""WITH {CHECKPOINTS}, b AS (SELECT k, k % 13 <> 0 AS contract_ok, k % 11 = 0 AS epi, k % 5 = 0 AS veto, CASE WHEN k % 5 = 0 THEN {list(MODULES)}[1 + k % 4] END AS vm, CASE k % 3 WHEN 0 THEN 'TEST' WHEN 1 THEN 'ADD' ELSE 'HOLD' END AS p, CASE WHEN k % 17 <> 0 THEN (k % 4)::DOUBLE / 4 END AS size, k % 7 = 0 AS un FROM cp)
SELECT k, CASE WHEN NOT contract_ok THEN 'contract_gap' WHEN epi THEN 'data_gap' WHEN vm IN ('account', 'portfolio_risk_budget') THEN 'portfolio_or_permission' WHEN veto THEN 'market_risk' WHEN p <> 'HOLD' AND size IS NULL THEN 'contract_gap' WHEN p <> 'HOLD' AND size > 0 THEN 'ready' WHEN un THEN 'unresolved_conflict' ELSE 'no_edge_or_non_open_intent' END AS blocker FROM b""")
def l17_blockers(spark, sf_dir):
    k = F.col("k")
    names = F.array(*[F.lit(m) for m in MODULES])
    x = checkpoints(spark, sf_dir).select(
        "k", (k % 13 != 0).alias("contract_ok"), (k % 11 == 0).alias("epistemic_veto"), (k % 5 == 0).alias("hard_veto"), F.when(k % 5 == 0, F.array(F.get(names, (k % 4).cast("int")))).otherwise(F.array().cast("array<string>")).alias("veto_modules"),
        F.when(k % 3 == 0, "TEST").when(k % 3 == 1, "ADD").otherwise("HOLD").alias("permission"), F.when(k % 17 != 0, (k % 4) / 4.0).alias("multiplier"), (k % 7 == 0).alias("unresolved"),
    )
    return x.select("k", ck.blocker(x).alias("blocker"))


# An expected posture and two compiled ones for each order: caps by key, vetoes, multipliers and guards.
POSTURE = "po AS (SELECT o_orderkey AS k, o_orderkey % 4 AS ceiling, o_orderkey % 3 = 0 AS eveto, (o_orderkey % 5) / 4.0::DOUBLE AS emult, (o_orderkey // 2) % 4 AS c0, (o_orderkey // 3) % 4 AS c1, o_orderkey % 2 = 0 AS v0, o_orderkey % 6 < 2 AS v1, (o_orderkey % 7) / 6.0::DOUBLE AS m0, (o_orderkey % 8) / 7.0::DOUBLE AS m1, ['risk', 'data'] AS eg, CASE WHEN o_orderkey % 3 = 1 THEN ['risk'] ELSE ['data', 'risk'] END AS g0, CASE WHEN o_orderkey % 4 = 1 THEN ['data'] ELSE ['risk', 'data'] END AS g1 FROM orders)"


def _postures(spark, sf_dir):
    k = F.col("o_orderkey")
    word = lambda *w: F.array(*[F.lit(x) for x in w])
    cap = lambda n: F.concat(F.lit("L"), n.cast("string"))
    s = lambda c, v, m, g, name: F.struct(c.alias(name), v.alias("veto"), m.alias("multiplier"), g.alias("guards"))
    return read(spark, sf_dir, "orders").select(
        k.alias("k"), s(cap(k % 4), k % 3 == 0, (k % 5) / 4.0, word("risk", "data"), "ceiling").alias("expected"), s(cap(F.floor(k / 2) % 4), k % 2 == 0, (k % 7) / 6.0, F.when(k % 3 == 1, word("risk")).otherwise(word("data", "risk")), "cap").alias("before"),
        s(cap(F.floor(k / 3) % 4), k % 6 < 2, (k % 8) / 7.0, F.when(k % 4 == 1, word("data")).otherwise(word("risk", "data")), "cap").alias("after"),
    )


@query(f"""WITH {POSTURE} SELECT k, array_to_string(list_filter([CASE WHEN c1 > ceiling THEN 'action_exceeds_ceiling' END, CASE WHEN eveto <> v1 THEN 'veto_differs' END, CASE WHEN m1 > emult + 1e-9 THEN 'multiplier_too_high' END, CASE WHEN NOT list_contains(g1, 'risk') THEN 'missing_guard:risk' END], lambda c: c IS NOT NULL), ',') AS errors,
  array_to_string(list_filter([CASE WHEN c1 > c0 THEN 'action_loosened' END, CASE WHEN v0 AND NOT v1 THEN 'veto_dropped' END, CASE WHEN m1 > m0 + 1e-9 THEN 'multiplier_raised' END, CASE WHEN list_contains(g0, 'risk') AND NOT list_contains(g1, 'risk') THEN 'guard_dropped:risk' END], lambda c: c IS NOT NULL), ',') AS regressions FROM po""")
def l14_posture_lint(spark, sf_dir):
    return _postures(spark, sf_dir).select("k", F.array_join(ck.posture_errors("expected", "after"), ",").alias("errors"), F.array_join(ck.loosened("before", "after"), ",").alias("regressions"))


@query("""WITH t AS (SELECT c_custkey AS target, CASE c_custkey % 6 WHEN 0 THEN 'deleveraging_watch' WHEN 1 THEN 'forced_liquidation' ELSE 'normal' END AS regime FROM customer), e AS (SELECT o_custkey AS target, CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE 'f' || (o_custkey % 2 * (o_orderkey % 4))::VARCHAR END AS family FROM orders),
g AS (SELECT o_custkey AS target, bool_or(o_orderkey % 13 = 0) AS emp FROM orders GROUP BY 1), f AS (SELECT target, count(DISTINCT family) FILTER (family <> 'unknown') AS n, bool_or(family = 'unknown') AS u FROM e GROUP BY 1),
x AS (SELECT t.target, regime, coalesce(n, 0) AS n, coalesce(u, false) AS u, coalesce(emp, false) AS emp FROM t LEFT JOIN f USING (target) LEFT JOIN g USING (target))
SELECT target, array_to_string(list_filter([CASE WHEN regime <> 'normal' THEN 'risk_regime_override' END, CASE WHEN emp THEN 'fundamental_gap' END, CASE WHEN u THEN 'unknown_source_family' END, CASE WHEN n = 0 THEN 'insufficient_source_families' WHEN n = 1 THEN 'single_source_family' END], lambda c: c IS NOT NULL), ',') AS flags,
  CASE WHEN n = 0 THEN 'L0' WHEN n = 1 OR u THEN 'L1' ELSE 'L3' END AS max_cap, CASE WHEN n = 0 THEN 0.0 WHEN n = 1 OR u THEN 0.5 ELSE 1.0 END::DOUBLE AS multiplier FROM x""")
def l15_red_flags(spark, sf_dir):
    c, o = F.col("c_custkey"), read(spark, sf_dir, "orders")
    targets = read(spark, sf_dir, "customer").select(c.alias("target"), F.when(c % 6 == 0, "deleveraging_watch").when(c % 6 == 1, "forced_liquidation").otherwise("normal").alias("regime"))
    k, t = F.col("o_orderkey"), F.col("o_custkey")
    evidence = o.select(t.alias("target"), F.when(k % 9 == 0, "unknown").otherwise(F.concat(F.lit("f"), (t % 2 * (k % 4)).cast("string"))).alias("family"))
    gaps = o.select(t.alias("target"), F.when(k % 13 == 0, "empty_fundamentals").otherwise("other").alias("error_class"))
    return ck.red_flags(targets, evidence, gaps)


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS study, l_partkey AS symbol FROM lineitem WHERE l_linestatus = 'O'), p AS (SELECT l_suppkey AS study, 'fit' AS c, CASE WHEN l_tax = 0 THEN 'no_tax' END AS gap FROM lineitem UNION ALL SELECT l_suppkey, 'path', CASE WHEN l_discount = 0 THEN 'no_discount' END FROM lineitem WHERE l_returnflag = 'N'),
c AS (SELECT study, array_to_string(list_sort(list_distinct(list(c))), ',') AS components, coalesce(array_to_string(list_sort(list_distinct(list(gap) FILTER (gap IS NOT NULL))), ','), '') AS gaps FROM p GROUP BY study),
a AS (SELECT DISTINCT l_suppkey AS study, l_partkey AS symbol FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT a.study, count(s.symbol) AS i, count(*) - count(s.symbol) AS o FROM a LEFT JOIN s ON s.study = a.study AND s.symbol = a.symbol GROUP BY a.study)
SELECT d.study, coalesce(components, '') AS components, coalesce(gaps, '') AS gaps, coalesce(i, 0) AS in_scope, coalesce(o, 0) AS out_of_scope FROM (SELECT DISTINCT study FROM s) d LEFT JOIN c USING (study) LEFT JOIN n USING (study)""")
def l18_study_bundles(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").withColumns({"study": F.col("l_suppkey"), "symbol": F.col("l_partkey")})
    parts = {"fit": li.select("study", F.when(F.col("l_tax") == 0, "no_tax").alias("gap")), "path": li.where("l_returnflag = 'N'").select("study", F.when(F.col("l_discount") == 0, "no_discount").alias("gap"))}
    return ck.study_bundle(li.where("l_linestatus = 'O'").select("study", "symbol"), parts, li.where("l_returnflag = 'R'").select("study", "symbol"))


# ---- lifecycles -------------------------------------------------------------------------------------------------

LOG = f"{JOURNAL}, lg AS (SELECT symbol, pos AS seq, kind, " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in ORDER_LOG.items()) + " FROM journal)"


@query(f"WITH {LOG} SELECT symbol, seq, lower(status) IN ('open','filled_open') AND lower(coalesce(side, '')) IN ('buy','long','open') AS open_fill, lower(status) IN ('partial_closed','closed','completed') AND lower(coalesce(side, '')) IN ('sell','short','reduce','exit') AS reconciled_exit, lower(status) = 'closed_unreconciled' AS unreconciled_close FROM lg")
def p03_order_states(spark, sf_dir):
    return order_log(spark, sf_dir).select("symbol", "seq", lc.is_open_fill().alias("open_fill"), lc.is_reconciled_exit().alias("reconciled_exit"), lc.is_unreconciled_close().alias("unreconciled_close"))


@query()
def l01_order_log_lifecycles(spark, sf_dir):
    """Voids, heals, forced and unreconciled closes: a fold by symbol that SQL cannot express; tests hold a loop against it."""
    o = order_log(spark, sf_dir)
    own = F.concat_ws(":", F.col("symbol").cast("string"), "order_id")
    named = o.withColumns({"order_id": own, "voids_order_id": F.when(F.col("voids_order_id").isNotNull(), F.concat_ws(":", F.col("symbol").cast("string"), "voids_order_id"))})
    return lc.standing(lc.live_orders(named)).select("symbol", "lifecycle", "entry", "exited", "exits", F.col("r").alias("r_multiple"), "ret", "status", "outcome")


@query(f"WITH {LOTS}, g AS (SELECT symbol, open_pos, sum(quantity)::BIGINT AS xq, count(*) AS exits FROM lots GROUP BY 1, 2) SELECT j.symbol::VARCHAR AS symbol, j.pos AS open_pos, coalesce(xq, 0)::DOUBLE AS exited, coalesce(exits, 0) AS exits, CASE WHEN coalesce(xq, 0) >= q THEN 'closed' WHEN coalesce(xq, 0) > 0 THEN 'partial' ELSE 'open' END AS status FROM journal j LEFT JOIN g ON g.symbol = j.symbol AND g.open_pos = j.pos WHERE kind = 'open'")
def r04_stream_lifecycles(spark, sf_dir):
    j = journal(spark, sf_dir).select("symbol", F.col("pos").alias("seq"), "ts", F.col("pos").cast("string").alias("order_id"), F.lit(None).cast("string").alias("lifecycle"), F.when(F.col("kind") == "open", "open").otherwise("partial_closed").alias("status"), F.when(F.col("kind") == "open", "buy").otherwise("sell").alias("side"), F.col("q").alias("quantity"), F.lit(None).cast("double").alias("r"), F.lit(None).cast("double").alias("ret"))
    log = streams.as_stream(spark, j, "orders")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, detectors.ROCKS)
    try:
        x = lc.latest(streams.drain(lc.stream_lifecycles(log), "lifecycles"))
    finally:
        spark.conf.set(name, before)
    return x.select("symbol", F.substring_index("lifecycle", ":", -1).cast("long").alias("open_pos"), "exited", "exits", "status")


PREDICTED = "CASE WHEN open_pos % 7 <> 0 THEN (open_pos % 100) / 100.0::DOUBLE END"


@query(f"""WITH {LOTS}, g AS (SELECT symbol, open_pos, sum(quantity)::BIGINT AS xq, sum(100*(cp/op - 1)*quantity/oq) AS ret FROM lots GROUP BY 1, 2), l AS (SELECT j.symbol, j.pos AS open_pos, coalesce(xq, 0) >= q AS done, ret FROM journal j LEFT JOIN g ON g.symbol = j.symbol AND g.open_pos = j.pos WHERE kind = 'open'),
p AS (SELECT *, {PREDICTED} AS predicted, CASE WHEN open_pos % 5 <> 0 THEN ret END AS net FROM l)
SELECT CASE WHEN NOT done AND predicted IS NULL THEN 'open_without_prediction' WHEN NOT done THEN 'open_not_closed_yet' WHEN predicted IS NULL THEN 'missing_prediction_contract' WHEN net IS NULL THEN 'missing_verified_net_outcome' ELSE 'paired' END AS reason, count(*) AS n, round(avg(CASE WHEN done AND predicted IS NOT NULL AND net IS NOT NULL THEN pow(predicted - (net > 0)::INT, 2) END), 6) AS brier FROM p GROUP BY 1""")
def l03_prediction_pairs(spark, sf_dir):
    lots = sx.lifecycles(journal(spark, sf_dir))
    k = F.col("open_pos")
    return lc.pair_predictions(lots.select("symbol", "open_pos", (F.col("status") == "closed").alias("done"), F.when(k % 5 != 0, F.col("return_pct")).alias("net"), F.when(k % 7 != 0, (k % 100) / 100.0).alias("predicted")))


# ---- pair graph -------------------------------------------------------------------------------------------------


@query(f"""WITH {BARS}, r AS (SELECT symbol, date, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS y FROM bars),
j AS (SELECT a.symbol AS a, b.symbol AS b, a.y AS ya, b.y AS yb, row_number() OVER (PARTITION BY a.symbol, b.symbol ORDER BY a.date DESC) AS n FROM r a JOIN r b ON a.date = b.date AND a.symbol <> b.symbol WHERE a.y IS NOT NULL AND b.y IS NOT NULL),
g AS (SELECT a, b, count(*) AS aligned, count(*) FILTER (n <= 120) AS n_obs, covar_pop(ya, yb) FILTER (n <= 60) / nullif(var_pop(yb) FILTER (n <= 60), 0) AS f, covar_pop(ya, yb) FILTER (n <= 120) / nullif(var_pop(yb) FILTER (n <= 120), 0) AS s,
  covar_pop(ya, yb) FILTER (n <= 120) / nullif(sqrt(var_pop(ya) FILTER (n <= 120) * var_pop(yb) FILTER (n <= 120)), 0) AS c FROM j GROUP BY a, b)
SELECT a, b, n_obs, aligned, round(f, 5) + 0 AS beta_60, round(s, 5) + 0 AS beta_120, round(c, 5) + 0 AS corr_120, coalesce(abs(f - s) >= greatest(0.35, 0.35 * abs(s)), false) AS shifted, aligned < 110 AS gap FROM g""")
def j05_pair_graph(spark, sf_dir):
    r = bars(spark, sf_dir).select("symbol", "date", F.log(F.col("close") / F.lag("close").over(fx.series())).alias("y"))
    return mk.pair_graph(r, digits=5)


@query(f"""WITH {BARS}, {RET}, l AS (SELECT symbol, x, y, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM ret WHERE x IS NOT NULL AND y IS NOT NULL AND symbol % 5 <> 0),
g AS (SELECT symbol, count(*) AS m, covar_pop(y, x) FILTER (n <= 60) / nullif(var_pop(x) FILTER (n <= 60), 0) AS f, covar_pop(y, x) FILTER (n <= 120) / nullif(var_pop(x) FILTER (n <= 120), 0) AS s FROM (SELECT * FROM l WHERE symbol % 3 <> 0 OR n <= 80) GROUP BY symbol)
SELECT b.symbol, round(CASE WHEN m >= 110 THEN s WHEN m >= 50 THEN f ELSE 1.0 END, 5) AS beta, CASE WHEN m >= 110 THEN 'beta_120' WHEN m >= 50 THEN 'beta_60' ELSE 'benchmark_fallback' END AS source FROM (SELECT DISTINCT symbol FROM bars) b LEFT JOIN g USING (symbol)""")
def j21_beta_lookup(spark, sf_dir):
    from marlstone.plans.market_queries import _returns

    # Every fifth symbol has no history at all, every third a short one.
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    r = _returns(spark, sf_dir).where("symbol % 5 <> 0 and x is not null and y is not null").withColumn("n", F.row_number().over(w)).where("symbol % 3 <> 0 or n <= 80").drop("n")
    x = mk.beta_lookup(bars(spark, sf_dir).select("symbol").distinct(), r)
    return x.select("symbol", F.round("beta", 5).alias("beta"), "source")


# ---- joint scenarios --------------------------------------------------------------------------------------------

HOLDINGS = f"""{CHAIN}, h AS (SELECT underlying, contract_id, side, strike, iv, spot, (CASE WHEN contract_id % 3 = 0 THEN -1 ELSE 1 END) * (1 + contract_id % 4) AS qty, (bid + ask) / 2 AS reference, 0.05::DOUBLE AS fee FROM chain),
sc AS (SELECT * FROM (VALUES ('tail', 0.8, 0.1), ('down', 0.95, 0.3), ('flat', 1.0, 0.3), ('up', 1.1, 0.3)) t(scenario, m, w)),
pl AS (SELECT underlying, scenario, w::DOUBLE AS w, sum(qty * 100 * (CASE WHEN side = 'C' THEN greatest(spot * m::DOUBLE - strike, 0) ELSE greatest(strike - spot * m::DOUBLE, 0) END - reference) - fee) AS base, max(spot) * (m::DOUBLE - 1) * -50 AS hedge FROM h, sc GROUP BY underlying, scenario, m, w),
jt AS (SELECT underlying, min(base) AS worst_base, min(base + hedge) AS worst_joint, max(base + hedge) AS best_joint, sum(w * (base + hedge)) AS expected, sum(w) AS weights, count(*) AS n FROM pl GROUP BY underlying)"""


@query(f"WITH {HOLDINGS} SELECT underlying, n AS scenarios, round(worst_base, 4) AS worst_base, round(worst_joint, 4) AS worst_joint, round(best_joint, 4) AS best_joint, round(expected, 4) AS expected_pnl, round(worst_joint - worst_base, 4) AS hedge_gain, worst_joint > worst_base AS improves FROM jt")
def g05_joint_scenarios(spark, sf_dir):
    k = F.col("contract_id")
    h = chain(spark, sf_dir).select("underlying", "side", "strike", "spot", (F.when(k % 3 == 0, -1).otherwise(1) * (1 + k % 4)).alias("qty"), ((F.col("bid") + F.col("ask")) / 2).alias("reference"), F.lit(0.05).alias("fee"))
    scenarios = [("tail", 0.8, 0.1), ("down", 0.95, 0.3), ("flat", 1.0, 0.3), ("up", 1.1, 0.3)]
    x = mk.joint_scenarios(h, scenarios, hedge=-50.0)
    return x.select("underlying", "scenarios", *[F.round(c, 4).alias(c) for c in ("worst_base", "worst_joint", "best_joint", "expected_pnl", "hedge_gain")], "improves")


# ---- book detectors ---------------------------------------------------------------------------------------------

SWEEPS = """sw AS (SELECT event_id, user_id AS symbol, row_number() OVER w - 1 AS snap, (sum(event_id % 97 * 40) OVER w)::BIGINT AS cum FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sb AS (SELECT *, 1000 + snap - CASE WHEN event_id % 13 = 0 THEN 2 ELSE 0 END AS last FROM sw),
sl AS (SELECT b.symbol, b.snap, b.last + l AS ticks, ((b.last + l) * 7919 % 50) * 100 // (1 + b.snap % 5) AS volume FROM sb b, (SELECT unnest(range(1, 6)) AS l))"""


def _sweeps(spark, sf_dir):
    """A book by user whose price climbs a tick each snapshot, and its ask levels."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    b = events(spark, sf_dir).select("event_id", F.col("user_id").alias("symbol"), F.lit(0).alias("session_id"), (F.row_number().over(w) - 1).cast("long").alias("snap"), F.sum(F.col("event_id") % 97 * 40).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative_volume"))
    b = b.withColumn("ticks", 1000 + F.col("snap") - F.when(F.col("event_id") % 13 == 0, 2).otherwise(0))
    levels = b.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(5)))).select("symbol", "session_id", "snap", (F.col("ticks") + F.col("level")).alias("ticks"))
    return b, levels.withColumn("volume", F.floor(F.col("ticks") * 7919 % 50 * 100 / (1 + F.col("snap") % 5)).cast("long"))


@query(f"""WITH {SWEEPS}, md AS (SELECT a.symbol, a.snap, median(o.volume) AS base FROM sb a JOIN sl o ON o.symbol = a.symbol AND o.snap BETWEEN a.snap - 2 AND a.snap - 1 AND o.volume > 0 WHERE a.snap >= 2 GROUP BY 1, 2),
wl AS (SELECT sl.symbol, sl.snap AS w, sl.ticks, sl.volume AS v0 FROM sl JOIN md ON md.symbol = sl.symbol AND md.snap = sl.snap WHERE sl.volume > greatest(500, 1.2 * base)),
st AS (SELECT wl.*, b.snap, b.last, b.cum, coalesce(q.volume, 0) AS q FROM wl JOIN sb b ON b.symbol = wl.symbol AND b.snap BETWEEN wl.w AND wl.w + 4 LEFT JOIN sl q ON q.symbol = wl.symbol AND q.snap = b.snap AND q.ticks = wl.ticks),
dl AS (SELECT *, q > lag(q) OVER p AS grew, last < lag(last) OVER p AS fell, cum - lag(cum) OVER p AS tr FROM st WINDOW p AS (PARTITION BY symbol, w, ticks ORDER BY snap)),
ru AS (SELECT *, bool_or(coalesce(grew, false) OR coalesce(fell, false)) OVER p AS broken, sum((tr > 0)::INT) OVER p AS steps, coalesce(sum(tr) OVER p, 0) AS done FROM dl WINDOW p AS (PARTITION BY symbol, w, ticks ORDER BY snap)),
ql AS (SELECT *, snap - w >= 2 AND NOT broken AND steps >= 2 AND (v0 - q) / v0::DOUBLE >= 0.6 AND done / v0::DOUBLE >= 0.3 AND last > ticks AS ok FROM ru),
fi AS (SELECT *, coalesce(lag(ok) OVER (PARTITION BY symbol, w, ticks ORDER BY snap), false) AS was FROM ql)
SELECT b.event_id, round(max(least(1.0, ((v0 - q) / v0::DOUBLE + least(1.0, done / v0::DOUBLE / 0.6)) / 2)), 6) AS strength FROM fi JOIN sb b ON b.symbol = fi.symbol AND b.snap = fi.snap WHERE ok AND NOT was GROUP BY b.event_id""")
def m07_wall_breaker(spark, sf_dir):
    b, levels = _sweeps(spark, sf_dir)
    x = mk.wall_breaker(b, levels, lookback=2, factor=1.2, least_volume=500.0, steps=2, most=4, removed=0.6, executed=0.3)
    return x.join(b.select("symbol", "session_id", "snap", "event_id"), ["symbol", "session_id", "snap"]).select("event_id", F.round("strength", 6).alias("strength"))


@query("""WITH d AS (SELECT event_id, event_id % 3 = 0 AS fired, CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 1.5 WHEN 2 THEN -0.25 ELSE (event_id % 10) / 9.0::DOUBLE END AS strength, CASE event_id % 7 WHEN 0 THEN 'guess' WHEN 1 THEN 'tick' ELSE 'snapshot_diff' END AS fidelity, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS refs FROM events)
SELECT event_id, CASE WHEN strength IS NOT NULL THEN round(greatest(0.0, least(1.0, strength)), 12) END AS strength, array_to_string(list_filter([CASE WHEN strength IS NULL THEN 'strength_not_finite' END, CASE WHEN strength < 0 OR strength > 1 THEN 'strength_out_of_range' END, CASE WHEN fidelity = 'guess' THEN 'invalid_input_fidelity' END, CASE WHEN fired AND refs = 0 THEN 'fired_without_evidence' END], lambda c: c IS NOT NULL), ',') AS errors FROM d""")
def m10_detector_contract(spark, sf_dir):
    k = F.col("event_id")
    raw = F.when(k % 11 == 0, None).when(k % 11 == 1, 1.5).when(k % 11 == 2, -0.25).otherwise((k % 10) / 9.0)
    refs = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(k.cast("string")))
    x = events(spark, sf_dir).select("event_id", (k % 3 == 0).alias("fired"), raw.alias("strength"), F.when(k % 7 == 0, "guess").when(k % 7 == 1, "tick").otherwise("snapshot_diff").alias("fidelity"), refs.alias("refs"))
    x = x.withColumn("out", mk.detector_output(F.col("fired"), F.col("strength"), F.col("fidelity"), F.col("refs")))
    return x.select("event_id", F.col("out.strength").alias("strength"), F.array_join(mk.output_errors(F.col("fired"), F.col("strength"), F.col("fidelity"), F.col("refs")), ",").alias("errors"))


FOUND = {"order_wall": "m03_order_wall", "imbalance": "m04_imbalance", "ignition": "m05_ignition"}
OUTPUTS = " UNION ALL ".join(f"SELECT '{n}' AS detector, event_id, {'true AS fired' if n == 'order_wall' else 'fired'}, strength FROM ({mq.SQL[q]})" for n, q in FOUND.items())


@query(f"SELECT detector, event_id, fired, strength, 'snapshot_diff' AS input_fidelity, event_id::VARCHAR AS refs FROM ({OUTPUTS}) WHERE strength IS NOT NULL")
def m10_detector_outputs(spark, sf_dir):
    """What the detectors find, each in the common output with the snapshot that it rests on."""
    every = None
    for name, q in FOUND.items():
        x = mq.Q[q](spark, sf_dir)
        fired = F.lit(True) if name == "order_wall" else F.col("fired")
        x = x.select(F.lit(name).alias("detector"), "event_id", mk.detector_output(fired, F.col("strength"), F.lit("snapshot_diff"), F.array(F.col("event_id").cast("string"))).alias("o"))
        every = x if every is None else every.unionByName(x)
    x = every.where("o.strength is not null")
    return x.select("detector", "event_id", "o.fired", F.col("o.strength").alias("strength"), "o.input_fidelity", F.array_join("o.evidence", ",").alias("refs"))


@query(mq.SQL["m04_imbalance"])
def r02_stream_imbalance(spark, sf_dir):
    """The imbalance of live snapshots, each with its levels as arrays: no state is needed."""
    volume = lambda side: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: (F.col("event_id") * 7919 + k * 104729 + side * 31) % 5000)
    live = streams.event_stream(spark, sf_dir).select("event_id", volume(1).alias("bids"), volume(2).alias("asks"))
    return streams.drain(detectors.imbalance(live, 1.02), "imbalance").select("event_id", "fired", F.round("strength", 6).alias("strength"))


@query("""WITH s(detector, parameter, whole, low, high) AS (VALUES ('order_wall', 'factor', false, 1.0, 100.0), ('order_wall', 'lookback', true, 1.0, 1000.0), ('imbalance', 'ratio', false, 1.0, 100.0)),
e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'wall' WHEN 1 THEN 'imbalance' ELSE 'order_wall' END AS detector, CASE event_id % 5 WHEN 1 THEN 'ratio' WHEN 2 THEN 'factor' WHEN 3 THEN 'lookback' ELSE 'ratio' END AS parameter, CASE WHEN event_id % 11 = 0 THEN 'x' ELSE (event_id % 150 - 10)::VARCHAR || CASE WHEN event_id % 2 = 0 THEN '' ELSE '.5' END END AS v FROM events)
SELECT event_id, CASE WHEN e.detector = 'wall' THEN 'unknown_detector' WHEN low IS NULL THEN 'unknown_parameter' WHEN v = 'x' THEN 'not_a_number' WHEN whole AND v::DOUBLE <> floor(v::DOUBLE) THEN 'not_whole' WHEN v::DOUBLE < low OR v::DOUBLE > high THEN 'out_of_range' END AS error FROM e LEFT JOIN s ON s.detector = e.detector AND s.parameter = e.parameter""")
def u02_detector_parameters(spark, sf_dir):
    """Events as settings of detectors, held against the registry."""
    k = F.col("event_id")
    pick = lambda *names: F.get(F.array(*[F.lit(n) for n in names]), (k % 5).cast("int"))
    value = F.when(k % 11 == 0, "x").otherwise(F.concat((k % 150 - 10).cast("string"), F.when(k % 2 == 0, "").otherwise(".5")))
    x = events(spark, sf_dir).select("event_id", pick("wall", "imbalance", "order_wall", "order_wall", "order_wall").alias("detector"), pick("ratio", "ratio", "factor", "lookback", "ratio").alias("parameter"), value.alias("value"))
    return mk.parameter_errors(x).select("event_id", "error")


# ---- predicates, cards, universes -------------------------------------------------------------------------------


@query("""SELECT event_id, event_id % 5 IN (1, 2) OR event_id % 7 IN (3, 4, 5) AS rejected FROM events""")
def p13_sensitive_keys(spark, sf_dir):
    k = F.col("event_id")
    inner = F.when(k % 5 == 1, F.lit('{"Api-Key": 1}')).when(k % 5 == 2, F.lit('[{"x": {"session_token": "a"}}]')).when(k % 5 == 3, F.lit('{"token_address": "0x", "tokens": 2}')).otherwise(F.lit('{"note": "the token is \\"secret\\": no"}'))
    head = F.when(k % 7 == 3, F.lit('"Auth": true, ')).when(k % 7 == 4, F.lit('"\\u0061pi_key": 1, ')).when(k % 7 == 5, F.lit('"п\u0430роль": 1, ')).when(k % 7 == 6, F.lit('"ｎｏｔｅ": 1, ')).otherwise(F.lit(""))
    payload = F.concat(F.lit("{"), head, F.lit('"props": '), "props", F.lit(', "inner": '), inner, F.lit("}"))
    return events(spark, sf_dir).select("event_id", ev.has_sensitive_key(payload).alias("rejected"))


@query("SELECT event_id FROM events WHERE event_id % 4 <> 0 AND event_id % 6 <> 1")
def p14_live_markets(spark, sf_dir):
    k = F.col("event_id")
    m = events(spark, sf_dir).select("event_id", F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("closed"), F.when(k % 6 == 1, False).when(k % 6 == 2, True).alias("active"), F.col("ts").alias("end_date"))
    return m.where(ev.is_live(F.col("closed"), F.col("active"))).select("event_id")


@query("""WITH l AS (SELECT l_orderkey AS k, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity) AS a, list(l_linestatus ORDER BY l_linenumber, l_partkey, l_quantity) AS b FROM lineitem GROUP BY 1), c AS (SELECT k, list_concat(a, b) AS v FROM l)
SELECT k, array_to_string(list_transform(list_filter(list_zip(v, range(1, len(v) + 1)), lambda x: list_position(v, x[1]) = x[2]), lambda x: x[1]), ',') AS v FROM c""")
def o05_ordered_distinct(spark, sf_dir):
    """Lines that number, part and quantity leave tied keep the table's order: that of their file and of their place in it."""
    li = read(spark, sf_dir, "lineitem").select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    order = [F.when(F.col(c).isNull(), 1).otherwise(0) if missing else F.col(c) for c in ("l_linenumber", "l_partkey", "l_quantity") for missing in (True, False)]  # missing ones last
    lines = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "file", "place", "l_returnflag", "l_linestatus")))
    g = li.groupBy(F.col("l_orderkey").alias("k")).agg(lines.alias("x")).select("k", F.col("x.l_returnflag").alias("a"), F.col("x.l_linestatus").alias("b"))
    return g.select("k", F.array_join(ev.ordered_distinct("a", "b"), ",").alias("v"))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'confirmed_alive' WHEN 1 THEN 'noise' ELSE 'open' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'A' ELSE 'US' END AS market, ['mom_20_1', 'rev_5', 'vol_20', 'other'][1 + o_custkey % 4] AS factor FROM orders)
SELECT factor, max(id) AS id, count(*) AS confirmations FROM r WHERE status = 'confirmed_alive' AND market = 'A' AND factor <> 'other' GROUP BY factor""")
def j22_confirmed_factors(spark, sf_dir):
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(x) for x in ("mom_20_1", "rev_5", "vol_20", "other")])
    r = read(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 4 == 0, "confirmed_alive").when(k % 4 == 1, "noise").otherwise("open").alias("status"), F.array(F.when(k % 3 == 0, "A").otherwise("US"), F.get(names, (F.col("o_custkey") % 4).cast("int"))).alias("tags"))
    return ev.confirmed_factors(r, ["mom_20_1", "rev_5", "vol_20"], "A")


CARDS = """cd AS (SELECT c_custkey AS card, [c_custkey % (SELECT max(doc_id) + 50 FROM documents), c_custkey * 7 % (SELECT max(doc_id) + 50 FROM documents)] AS src, CASE WHEN c_custkey % 3 = 0 THEN [c_custkey % (SELECT max(doc_id) + 50 FROM documents)] ELSE [] END AS cov, c_custkey % 9 <> 0 AS named FROM customer),
dc AS (SELECT doc_id, doc_id % 5 = 0 AS restricted FROM documents), ex AS (SELECT card, unnest(list_distinct(src)) AS doc_id FROM cd), jn AS (SELECT ex.card, bool_or(dc.doc_id IS NULL) AS lost, bool_or(restricted AND NOT list_contains(cov, ex.doc_id)) AS bare FROM ex JOIN cd ON cd.card = ex.card LEFT JOIN dc ON dc.doc_id = ex.doc_id GROUP BY 1)"""


@query(f"WITH {CARDS} SELECT cd.card, array_to_string(list_filter([CASE WHEN NOT named THEN 'card_identity_missing' END, CASE WHEN lost THEN 'card_source_missing' END, CASE WHEN bare THEN 'restricted_source_gap_missing' END], lambda c: c IS NOT NULL), ',') AS errors FROM cd JOIN jn USING (card)")
def j24_card_integrity(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    n = d.agg((F.max("doc_id") + 50).alias("n")).first()["n"]
    k = F.col("c_custkey")
    cards = read(spark, sf_dir, "customer").select(k.alias("card"), F.when(k % 9 != 0, "author").alias("author"), F.array(k % n, k * 7 % n).alias("sources"), F.when(k % 3 == 0, F.array(k % n)).otherwise(F.array().cast("array<bigint>")).alias("covered"))
    docs = d.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "subscriber_only").otherwise("public").alias("access_state"))
    return ev.card_errors(cards, docs).select("card", F.array_join("errors", ",").alias("errors"))


@query(f"WITH {BARS} SELECT symbol, date, date || 'T00:00:00+00:00' AS close_at, date || 'T00:00:00+00:00' AS available_at, close, true AS retrospective_only, 'UNVERIFIED' AS evidence FROM bars")
def e06_retrospective(spark, sf_dir):
    x = mk.retrospective(bars(spark, sf_dir))
    return x.select("symbol", "date", "close_at", "available_at", "close", "retrospective_only", "evidence")


@query("WITH t AS (SELECT unnest(list_distinct(list(l_returnflag))) AS tag, l_orderkey FROM lineitem GROUP BY l_orderkey) SELECT tag, count(*) AS n, CASE tag WHEN 'R' THEN 'guard_reversal' WHEN 'A' THEN 'guard_adverse' ELSE 'manual_review' END AS guard_case FROM t GROUP BY tag")
def u04_guard_cases(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("tags"))
    return ev.guard_cases(li.select(F.explode("tags").alias("tag")), {"R": "guard_reversal", "A": "guard_adverse"})

