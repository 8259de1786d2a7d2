"""Ledgers, calibration, lots and reconciliation over orders and line items, and the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import ledger as lg
from marlstone.sources.bindings import BARS, DECISIONS, JOURNAL, RESULTS, bars, decisions, events, journal, read, results

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


VERIFIED = f"""WITH {DECISIONS}, {RESULTS}, ver AS (SELECT d.*, return_pct, validation_time, failure_tags, CASE
  WHEN direction = 'long' AND return_pct > 0 OR direction IN ('short','reduce') AND return_pct < 0 THEN 'success'
  WHEN direction = 'long' AND return_pct < 0 OR direction IN ('short','reduce') AND return_pct > 0 THEN 'failure'
  WHEN direction IN ('watch','avoid') THEN 'neutral' ELSE 'mixed' END AS outcome FROM decisions d JOIN results USING (decision_id)),
prs AS (SELECT *, (outcome = 'success')::INT::DOUBLE AS actual FROM ver WHERE outcome IN ('success', 'failure'))"""


def _verified(spark, sf_dir):
    return lg.verified(decisions(spark, sf_dir), results(spark, sf_dir))


def _pairs(spark, sf_dir):
    return lg.pairs(_verified(spark, sf_dir))


@query(VERIFIED + " SELECT decision_id, symbol, direction, round(return_pct, 6) AS return_pct, outcome FROM ver ORDER BY validation_time DESC, decision_id DESC LIMIT 200")
def j01_verified_newest(spark, sf_dir):
    return lg.verified(decisions(spark, sf_dir), results(spark, sf_dir), 200).select("decision_id", "symbol", "direction", F.round("return_pct", 6).alias("return_pct"), "outcome")


@query(VERIFIED + " SELECT decision_id, predicted, actual FROM prs")
def j02_prediction_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("decision_id", "predicted", "actual")


@query(f"WITH {DECISIONS}, {RESULTS} SELECT decision_id, symbol, direction FROM decisions WHERE decision_id NOT IN (SELECT decision_id FROM results)")
def j03_due_without_result(spark, sf_dir):
    return lg.due_without_result(decisions(spark, sf_dir), results(spark, sf_dir)).select("decision_id", "symbol", "direction")


GROUP = "count(*) AS n, sum((outcome='success')::INT)::BIGINT AS success, sum((outcome='failure')::INT)::BIGINT AS failure, round(avg((outcome='success')::INT), 3) AS win_rate, round(avg(return_pct), 3) + 0 AS avg_return_pct, round(sum(return_pct), 3) + 0 AS sum_return_pct"


@query(VERIFIED + f" SELECT direction, regime, {GROUP} FROM ver GROUP BY direction, regime")
def a01_group_stats(spark, sf_dir):
    return lg.group_stats(_verified(spark, sf_dir), "direction", "regime")


@query(VERIFIED + ", mx AS (SELECT max(validation_time) AS m FROM ver), w AS (SELECT ver.*, greatest(0.05, pow(0.5, greatest(epoch_ms(m) - epoch_ms(validation_time), 0) / 86400000.0::DOUBLE / 30)) AS w FROM ver, mx) SELECT count(*) AS n, round(sum(CASE WHEN outcome='success' THEN w ELSE 0 END) / sum(w), 6) AS decayed_win_rate, round(sum(w*return_pct)/sum(w), 6) AS decayed_return_pct FROM w")
def a02_decayed_stats(spark, sf_dir):
    x = _verified(spark, sf_dir)
    top = results(spark, sf_dir).agg(F.max("validation_time")).first()[0]
    out = lg.decayed_stats(x, F.lit(top))
    return out.select("n", F.round("decayed_win_rate", 6).alias("decayed_win_rate"), F.round("decayed_return_pct", 6).alias("decayed_return_pct"))


@query(VERIFIED + " SELECT round(avg(pow(predicted - actual, 2)), 4) AS brier, count(*) AS n FROM prs")
def a03_brier(spark, sf_dir):
    return _pairs(spark, sf_dir).agg(lg.brier().alias("brier"), F.count("*").alias("n"))


@query(VERIFIED + " SELECT least(9, floor(round(predicted*10, 9)))::INT AS bin, count(*) AS n, round(avg(predicted), 3) AS mean_predicted, round(avg(actual), 3) AS realised_win_rate FROM prs GROUP BY 1")
def a04_reliability_bins(spark, sf_dir):
    return lg.reliability(_pairs(spark, sf_dir))


CAL = "count(*) AS n, round(avg(predicted), 3) AS mean_predicted, round(avg(actual), 3) AS realised_win_rate, round(avg(predicted) - avg(actual), 3) + 0 AS calibration_gap, round(avg(pow(predicted - actual, 2)), 4) AS brier"


@query(VERIFIED + f" SELECT regime, direction, {CAL} FROM prs GROUP BY regime, direction HAVING count(*) >= 3")
def a05_group_calibration(spark, sf_dir):
    return lg.group_calibration(_pairs(spark, sf_dir), "regime", "direction")


@query(VERIFIED + f", g AS (SELECT symbol, {CAL} FROM prs GROUP BY symbol HAVING count(*) >= 3) SELECT * FROM g WHERE abs(calibration_gap) >= 0.08 ORDER BY abs(calibration_gap) DESC, symbol LIMIT 1")
def a05_worst_group(spark, sf_dir):
    return lg.worst_group(lg.group_calibration(_pairs(spark, sf_dir), "symbol"), "symbol")


@query(VERIFIED + " SELECT CASE WHEN outcome IN ('success','failure') THEN 'scored' WHEN outcome IN ('mixed','neutral') THEN 'outcome_mixed_neutral' ELSE 'other_unscorable' END AS reason, count(*) AS n FROM ver GROUP BY 1")
def a06_abstention(spark, sf_dir):
    reason = F.when(F.col("outcome").isin("success", "failure"), "scored").when(F.col("outcome").isin("mixed", "neutral"), "outcome_mixed_neutral").otherwise("other_unscorable")
    return _verified(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(VERIFIED + ", g AS (SELECT count(*) AS n, avg(predicted) AS mp, avg(actual) AS base, round(avg(pow(predicted - actual, 2)), 4) AS brier FROM prs), h AS (SELECT *, round(base*(1-base), 4) AS base_brier, round(mp - base, 3) AS gap FROM g) SELECT n, round(base, 3) AS base_rate, brier, base_brier, round(1 - brier/base_brier, 3) AS skill, gap AS calibration_gap, CASE WHEN gap >= 0.08 THEN 'overconfident' WHEN gap <= -0.08 THEN 'underconfident' ELSE 'well_calibrated' END AS confidence, CASE WHEN n < 10 THEN 'none' WHEN abs(gap) >= 0.15 THEN 'high' WHEN abs(gap) >= 0.08 THEN 'medium' ELSE 'none' END AS materiality FROM h")
def a07_scorecard(spark, sf_dir):
    return lg.scorecard(_pairs(spark, sf_dir))


@query(VERIFIED + f", k AS (SELECT *, row_number() OVER (PARTITION BY action_level ORDER BY validation_time DESC, decision_id DESC) AS rn FROM prs) SELECT action_level, {CAL} FROM k WHERE rn <= 100 GROUP BY action_level HAVING count(*) >= 3")
def a08_newest_per_horizon(spark, sf_dir):
    x = lg.newest_each(_pairs(spark, sf_dir), "action_level", [F.desc("validation_time"), F.desc("decision_id")], 100)
    return lg.group_calibration(x, "action_level")


@query(VERIFIED + ", t AS (SELECT unnest(failure_tags) AS tag FROM ver WHERE outcome = 'failure'), n AS (SELECT count(*) AS c FROM ver WHERE outcome = 'failure') SELECT tag, count(*) AS n, round(count(*) / any_value(c)::DOUBLE, 6) AS share FROM t, n GROUP BY tag HAVING count(*) >= 3 AND count(*) / any_value(c)::DOUBLE >= 0.2")
def a23_failure_tags(spark, sf_dir):
    x = lg.tag_counts(_verified(spark, sf_dir).where(F.col("outcome") == "failure"), least=3, share=0.2)
    return x.select("tag", "n", F.round("share", 6).alias("share"))


@query(VERIFIED + " SELECT symbol, sum_return_pct, failure FROM (SELECT symbol, round(sum(return_pct), 6) + 0 AS sum_return_pct, sum((outcome='failure')::INT)::BIGINT AS failure FROM ver GROUP BY symbol) ORDER BY sum_return_pct, failure DESC, symbol LIMIT 5")
def t01_biggest_drag(spark, sf_dir):
    g = _verified(spark, sf_dir).groupBy("symbol").agg(F.round(F.sum("return_pct"), 6).alias("sum_return_pct"), F.sum((F.col("outcome") == "failure").cast("long")).alias("failure"))
    return g.orderBy("sum_return_pct", F.desc("failure"), "symbol").limit(5)


@query(VERIFIED + ", i AS (SELECT symbol, outcome, row_number() OVER (PARTITION BY symbol ORDER BY validation_time, decision_id) AS i FROM ver) SELECT symbol, (max(i) - coalesce(max(i) FILTER (outcome <> 'failure'), 0))::BIGINT AS streak FROM i GROUP BY symbol")
def w12_failure_streak(spark, sf_dir):
    return lg.tail_streak(_verified(spark, sf_dir), "symbol", ["validation_time", "decision_id"], F.col("outcome") == "failure")


@query(VERIFIED + ", i AS (SELECT symbol, outcome, row_number() OVER (PARTITION BY symbol ORDER BY validation_time DESC, decision_id DESC) AS i FROM ver) SELECT symbol, bool_and(outcome = 'failure') AS all_failed FROM i WHERE i <= 3 GROUP BY symbol HAVING count(*) = 3")
def w13_newest_all_failed(spark, sf_dir):
    x = lg.newest_each(_verified(spark, sf_dir), "symbol", [F.desc("validation_time"), F.desc("decision_id")], 3)
    return x.groupBy("symbol").agg(F.every(F.col("outcome") == "failure").alias("all_failed"), F.count("*").alias("n")).where("n = 3").drop("n")


@query(VERIFIED + ", b AS (SELECT CASE WHEN direction IN ('short','reduce') THEN 'sell_reduce_short' WHEN direction = 'long' THEN 'buy_build_add' ELSE 'watch_avoid' END AS bucket, * FROM ver) SELECT bucket, " + GROUP + " FROM b GROUP BY bucket")
def p17_action_buckets(spark, sf_dir):
    x = _verified(spark, sf_dir).withColumn("bucket", lg.action_bucket(F.col("direction"), F.col("action_level")))
    return lg.group_stats(x, "bucket")


@query(VERIFIED + " SELECT decision_id, outcome FROM ver")
def p16_outcomes(spark, sf_dir):
    return _verified(spark, sf_dir).select("decision_id", "outcome")


@query(f"WITH {DECISIONS}, {RESULTS} SELECT decision_id, CASE WHEN direction = 'long' THEN round(return_pct, 6) WHEN direction IN ('short', 'reduce') THEN round(-return_pct, 6) + 0 END AS directional_return, CASE WHEN abs(return_pct) < 0.5 THEN 'flat' WHEN return_pct > 0 THEN 'up' ELSE 'down' END AS move FROM decisions JOIN results USING (decision_id)")
def l05_due_outcomes(spark, sf_dir):
    x = decisions(spark, sf_dir).join(results(spark, sf_dir), "decision_id")
    signed = F.when(F.col("direction").isin(*lg.LONG), F.col("return_pct")).when(F.col("direction").isin(*lg.SHORT), -F.col("return_pct"))
    return x.select("decision_id", F.round(signed, 6).alias("directional_return"), F.when(F.abs("return_pct") < 0.5, "flat").when(F.col("return_pct") > 0, "up").otherwise("down").alias("move"))


@query(VERIFIED + """, c AS (SELECT decision_id, 'direction' AS relation, direction AS value, 'asserted' AS polarity FROM ver UNION ALL SELECT decision_id, 'outcome', outcome, CASE WHEN outcome = 'success' THEN 'positive' ELSE 'negative' END FROM ver UNION ALL SELECT decision_id, 'failure_tag', unnest(failure_tags), 'negative' FROM ver WHERE outcome = 'failure') SELECT * FROM c""")
def l06_claims(spark, sf_dir):
    x = _verified(spark, sf_dir)
    claim = lambda r, v, p: F.struct(F.lit(r).alias("relation"), v.alias("value"), p.alias("polarity"))
    two = F.array(claim("direction", F.col("direction"), F.lit("asserted")), claim("outcome", F.col("outcome"), F.when(F.col("outcome") == "success", "positive").otherwise("negative")))
    tags = F.when(F.col("outcome") == "failure", F.transform("failure_tags", lambda t: claim("failure_tag", t, F.lit("negative")))).otherwise(F.array())
    return x.select("decision_id", F.explode(F.concat(two, tags)).alias("c")).select("decision_id", "c.*")


@query(f"WITH {RESULTS} SELECT decision_id, count(*) AS n FROM results GROUP BY decision_id HAVING count(*) > 1 UNION ALL SELECT l_orderkey, count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 3")
def s06_duplicate_keys(spark, sf_dir):
    r = results(spark, sf_dir).groupBy("decision_id").agg(F.count("*").alias("n")).where("n > 1")
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("decision_id"), "l_linenumber").agg(F.count("*").alias("n")).where("n > 3")
    return r.unionByName(li.drop("l_linenumber"))


LOTS = f"""{JOURNAL}, c AS MATERIALIZED (SELECT *, sum(CASE WHEN kind='open' THEN q ELSE 0 END) OVER w AS o, sum(CASE WHEN kind='close' THEN q ELSE 0 END) OVER w AS x FROM journal WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
d AS (SELECT *, greatest(0, max(x - o) OVER (PARTITION BY symbol ORDER BY pos)) AS u FROM c), e AS (SELECT *, x - u AS xe, coalesce(lag(x - u) OVER (PARTITION BY symbol ORDER BY pos), 0) AS xb FROM d),
ends AS MATERIALIZED (SELECT symbol, o AS p, pos AS op, q AS oq, cents AS oc, NULL AS cl, NULL AS cq, NULL AS cc FROM e WHERE kind = 'open' AND q > 0 UNION ALL SELECT symbol, xe, NULL, NULL, NULL, pos, q, cents FROM e WHERE kind = 'close' AND xe > xb),
pc AS MATERIALIZED (SELECT symbol, p - coalesce(lead(p) OVER o, 0) AS quantity, last_value(op IGNORE NULLS) OVER w AS open_pos, last_value(oq IGNORE NULLS) OVER w AS oq, last_value(oc IGNORE NULLS) OVER w AS oc, last_value(cl IGNORE NULLS) OVER w AS close_pos, last_value(cq IGNORE NULLS) OVER w AS cq, last_value(cc IGNORE NULLS) OVER w AS cc
  FROM ends WINDOW o AS (PARTITION BY symbol ORDER BY p DESC, op IS NULL, op, cl), w AS (PARTITION BY symbol ORDER BY p DESC, op IS NULL, op, cl ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lots AS MATERIALIZED (SELECT symbol, open_pos, close_pos, quantity::BIGINT AS quantity, oc / oq::DOUBLE AS op, cc / cq::DOUBLE AS cp, oq FROM pc WHERE quantity > 0 AND open_pos IS NOT NULL AND close_pos IS NOT NULL)"""


@query(f"WITH {LOTS} SELECT symbol, open_pos, close_pos, quantity FROM lots")
def j11_fifo_lots(spark, sf_dir):
    return lg.match_lots(journal(spark, sf_dir)).select("symbol", "open_pos", "close_pos", "quantity")


RECON = "a AS (SELECT l_partkey AS part, sum(l_quantity::BIGINT)::BIGINT AS v FROM lineitem WHERE l_partkey % 11 <> 0 GROUP BY 1), b AS (SELECT l_partkey AS part, sum(l_quantity::BIGINT)::BIGINT AS v FROM lineitem WHERE l_tax < 0.08 AND l_partkey % 13 <> 0 GROUP BY 1)"


@query(f"WITH {RECON} SELECT coalesce(a.part, b.part) AS part, a.v AS left_value, b.v AS right_value, CASE WHEN b.v IS NULL THEN 'only_left' WHEN a.v IS NULL THEN 'only_right' WHEN abs(a.v - b.v) > 5 THEN 'mismatch' ELSE 'equal' END AS status FROM a FULL JOIN b ON a.part = b.part")
def j12_reconcile(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("q"), "l_tax")
    venue = li.where(F.col("part") % 11 != 0).groupBy("part").agg(F.sum("q").alias("v"))
    local = li.where((F.col("l_tax") < 0.08) & (F.col("part") % 13 != 0)).groupBy("part").agg(F.sum("q").alias("v"))
    return lg.reconcile(venue, local, "part", "v", 5)


@query(f"WITH {RECON} SELECT part FROM a WHERE part NOT IN (SELECT part FROM b)")
def o03_except_ids(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    a = li.where(F.col("l_partkey") % 11 != 0).select(F.col("l_partkey").alias("part"))
    b = li.where((F.col("l_tax") < 0.08) & (F.col("l_partkey") % 13 != 0)).select(F.col("l_partkey").alias("part"))
    return a.subtract(b)


@query(f"WITH {BARS} SELECT symbol, date FROM bars INTERSECT SELECT symbol - 1, date FROM bars")
def o02_common_dates(spark, sf_dir):
    """The dates that each symbol shares with the next one."""
    b = bars(spark, sf_dir).select("symbol", "date")
    return b.intersect(b.select((F.col("symbol") - 1).alias("symbol"), "date"))


@query("""WITH v AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'), h AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'A') SELECT id FROM v EXCEPT SELECT id FROM h""")
def o04_voided_not_healed(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_returnflag")
    return li.where("l_returnflag = 'R'").select("id").subtract(li.where("l_returnflag = 'A'").select("id"))


@query(f"WITH {BARS}, n AS (SELECT symbol, count(*) AS rows_, max(date) AS latest, min(date) AS first_date, sum((turnover_rate IS NULL)::INT)::BIGINT AS missing FROM bars GROUP BY symbol), m AS (SELECT max(date) AS top FROM bars) SELECT symbol, rows_, latest, first_date, missing, datediff('day', latest::DATE, top::DATE) > 21 AS stale FROM n, m")
def s09_panel_status(spark, sf_dir):
    b = bars(spark, sf_dir)
    top = b.agg(F.max("date").alias("top"))
    g = b.groupBy("symbol").agg(F.count("*").alias("rows_"), F.max("date").alias("latest"), F.min("date").alias("first_date"), F.count_if(F.col("turnover_rate").isNull()).alias("missing"))
    return g.join(F.broadcast(top)).withColumn("stale", F.datediff(F.col("top").cast("date"), F.col("latest").cast("date")) > 21).drop("top")


@query(f"WITH {DECISIONS}, s AS (SELECT regime, direction, count(*) AS w FROM decisions GROUP BY 1, 2), e AS (SELECT *, w * 100 / (sum(w) OVER (PARTITION BY regime))::DOUBLE AS x FROM s), f AS (SELECT *, floor(x)::BIGINT AS fl, round(x - floor(x), 9) AS r FROM e) SELECT regime, direction, fl + CASE WHEN row_number() OVER (PARTITION BY regime ORDER BY r DESC, direction) <= 100 - sum(fl) OVER (PARTITION BY regime) THEN 1 ELSE 0 END AS points FROM f")
def f11_largest_remainder(spark, sf_dir):
    x = decisions(spark, sf_dir).groupBy("regime", "direction").agg(F.count("*").alias("w"))
    return lg.largest_remainder(x, ["regime"], "w", "direction").select("regime", "direction", "points")


@query("""WITH g AS (SELECT DISTINCT user_id AS target, event_type AS dimension, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS severity FROM events), t AS (SELECT *, row_number() OVER (PARTITION BY severity, target ORDER BY dimension) AS turn FROM g)
SELECT target, dimension, severity, turn, row_number() OVER (ORDER BY severity, turn, target) AS place FROM t ORDER BY severity, turn, target LIMIT 50""")
def t04_fair_queue(spark, sf_dir):
    g = events(spark, sf_dir).select(F.col("user_id").alias("target"), F.col("event_type").alias("dimension"), F.when(F.col("event_type") == "purchase", 0).otherwise(1).alias("severity")).distinct()
    return lg.fair_queue(g, "severity", "target", "dimension", 50)


@query(f"WITH {DECISIONS} SELECT symbol, arg_max(direction, analysis_time::VARCHAR || lpad(decision_id::VARCHAR, 12, '0')) AS direction, max(decision_id) AS newest_id, count(*) AS versions FROM decisions GROUP BY symbol")
def l13_latest_state(spark, sf_dir):
    d = decisions(spark, sf_dir)
    return d.groupBy("symbol").agg(F.max_by("direction", F.struct("analysis_time", "decision_id")).alias("direction"), F.max("decision_id").alias("newest_id"), F.count("*").alias("versions"))


@query("""WITH e AS (SELECT DISTINCT user_id, CAST(ts AS DATE)::VARCHAR AS day, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, day, round(value, 6) AS equity, round(value - last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) + 0 AS change FROM e""")
def w11_equity_change(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    day = e.groupBy("user_id", "day").agg(F.max_by("value", F.struct("ts", "event_id")).alias("equity"))
    before = F.last("equity", ignorenulls=True).over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    return day.select("user_id", "day", F.round("equity", 6).alias("equity"), F.round(F.col("equity") - before, 6).alias("change"))


@query("SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, count(*) AS n FROM events GROUP BY user_id, event_type")
def a13_repeat_collapse(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_ts"), F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, array_to_string(list_sort(list_distinct(list((user_id % 7)::VARCHAR))), ',') AS kinds FROM events GROUP BY event_type")
def a14_range_rollup(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.array_join(F.array_sort(F.collect_set((F.col("user_id") % 7).cast("string"))), ",").alias("kinds"))


@query("SELECT (user_id) AS user_id, CAST(ts AS DATE)::VARCHAR AS day, arg_max(event_type, ts) AS last_type, count(*) AS n FROM events GROUP BY user_id, CAST(ts AS DATE)")
def a26_latest_per_day(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.max_by("event_type", "ts").alias("last_type"), F.count("*").alias("n"))


@query("SELECT CAST(ts AS DATE)::VARCHAR AS day, sum((event_type='purchase')::INT)::BIGINT AS purchases, sum((event_type<>'purchase')::INT)::BIGINT AS others, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def a28_daily_facts(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("event_type") != "purchase").alias("others"), F.count_distinct("user_id").alias("users"))


@query(f"WITH {DECISIONS} SELECT direction, count(*) AS n, round(quantile_cont(predicted, 0.05), 6) AS q05, round(quantile_cont(predicted, 0.5), 6) AS q50, round(quantile_cont(predicted, 0.95), 6) AS q95, round(avg(predicted), 6) AS mean FROM decisions GROUP BY direction")
def a27_distribution(spark, sf_dir):
    q = lambda p: F.round(F.percentile("predicted", F.lit(p)), 6)
    return decisions(spark, sf_dir).groupBy("direction").agg(F.count("*").alias("n"), q(0.05).alias("q05"), q(0.5).alias("q50"), q(0.95).alias("q95"), F.round(F.avg("predicted"), 6).alias("mean"))


@query(VERIFIED + ", g AS (SELECT regime, count(*) AS n, sum((outcome='success')::INT) AS k FROM prs GROUP BY regime), p AS (SELECT regime, n, k::BIGINT AS hits, k/n::DOUBLE AS p FROM g) SELECT regime, n, hits, round((p + 3.8416/(2*n) - 1.96*sqrt(p*(1-p)/n + 3.8416/(4.0*n*n)))/(1 + 3.8416/n), 6) AS low, round((p + 3.8416/(2*n) + 1.96*sqrt(p*(1-p)/n + 3.8416/(4.0*n*n)))/(1 + 3.8416/n), 6) AS high FROM p")
def a27_wilson(spark, sf_dir):
    from marlstone.functions.numeric import wilson

    g = _pairs(spark, sf_dir).groupBy("regime").agg(F.count("*").alias("n"), F.sum((F.col("outcome") == "success").cast("long")).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return g.select("regime", "n", "hits", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))
