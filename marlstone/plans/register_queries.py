"""Registers and their upkeep over the given tables, and the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import ledger as lg
from marlstone.operators import registers as rg
from marlstone.operators import states as sx
from marlstone.plans.ledger_queries import LOTS, VERIFIED
from marlstone.sources.bindings import BARS, DECISIONS, RESULTS, bars, decisions, events, journal, read, results
from marlstone.sources import store
from marlstone.sources.shared import fresh_path

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT d, (d - i::INT) AS w, i FROM d, (SELECT unnest(range(11)) AS i)) SELECT d::VARCHAR AS day, string_agg(w::DATE::VARCHAR, ',' ORDER BY i) AS weekdays FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY i) AS n FROM s WHERE dayofweek(w::DATE) NOT IN (0, 6)) WHERE n <= 3 GROUP BY d")
def f05_last_weekdays(spark, sf_dir):
    d = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.array_join(F.transform(rg.last_weekdays(F.col("d"), 3), lambda x: F.date_format(x, "yyyy-MM-dd")), ",").alias("weekdays"))


@query("SELECT event_id, sha256(concat_ws('|', coalesce(user_id::VARCHAR, '\\N'), coalesce(event_type, '\\N'), coalesce(props, '\\N'))) AS hash FROM events")
def f10_content_fingerprint(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", rg.fingerprint(F.col("user_id"), F.col("event_type"), F.col("props")).alias("hash"))


@query("SELECT CAST(ts AS DATE)::VARCHAR AS day, " + ", ".join(f"count(*) FILTER (user_id % 4 = {i}) AS s{i}" for i in range(4)) + ", count(DISTINCT user_id) AS names FROM events WHERE event_type = 'purchase' GROUP BY 1")
def a09_session_pivot(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type = 'purchase'")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(*[F.count_if(F.col("user_id") % 4 == i).alias(f"s{i}") for i in range(4)], F.count_distinct("user_id").alias("names"))


@query(f"WITH {BARS}, s AS (SELECT symbol, date, symbol % 2 + (substr(date, 6, 2)::INT // 7) AS basis, amount AS e FROM bars), l AS (SELECT *, lag(basis) OVER w AS pb, lag(e) OVER w AS pe FROM s WINDOW w AS (PARTITION BY symbol ORDER BY date)) SELECT symbol, date AS at, CASE WHEN pb <> basis THEN 'not_comparable' WHEN e <= 0.5 * pe THEN 'weaker' ELSE 'steady' END AS state FROM l WHERE pb IS NOT NULL")
def e14_exposure_weakening(spark, sf_dir):
    s = bars(spark, sf_dir).select("symbol", F.col("date").alias("at"), (F.col("symbol") % 2 + F.floor(F.substring("date", 6, 2).cast("int") / 7)).alias("basis"), F.col("amount").alias("exposure"))
    return rg.weakening(s, 0.5)


@query("SELECT l_suppkey AS supplier, max(abs(l_extendedprice - l_quantity * 1500)) AS spread, min(abs(l_extendedprice - (100000 + 15000 * (l_suppkey % 5)))) AS margin, max(abs(l_extendedprice - l_quantity * 1500)) < min(abs(l_extendedprice - (100000 + 15000 * (l_suppkey % 5)))) AS robust FROM lineitem GROUP BY 1")
def e13_threshold_sensitivity(spark, sf_dir):
    s = F.col("l_suppkey")
    li = read(spark, sf_dir, "lineitem").select(s.alias("supplier"), F.col("l_extendedprice").alias("value"), (F.col("l_quantity") * 1500).alias("alt"), (100000.0 + 15000 * (s % 5)).alias("threshold"))
    return rg.threshold_margin(li, "supplier")


@query("WITH e AS (SELECT event_id, sha256(concat_ws('|', user_id::VARCHAR, event_type)) AS h, ts FROM events), b AS (SELECT sha256(concat_ws('|', c_custkey::VARCHAR, t)) AS h, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (c_custkey % 40) AS f FROM customer, (SELECT unnest(['click', 'view', 'purchase']) AS t)) SELECT event_id AS entry_id, CASE WHEN f IS NULL THEN 'no_bundle' WHEN f >= ts THEN 'bundle_after_entry' ELSE 'linked' END AS state FROM e LEFT JOIN b ON b.h = e.h")
def j14_content_hash_join(spark, sf_dir):
    """Events as entries, and bundles of three event types for every customer, frozen on days of their own."""
    e = events(spark, sf_dir).select(F.col("event_id").alias("entry_id"), rg.fingerprint(F.col("user_id"), F.col("event_type")).alias("content_hash"), F.col("ts").alias("entered_at"))
    k = F.col("c_custkey")
    b = read(spark, sf_dir, "customer").select(k, F.explode(F.array(*[F.lit(t) for t in ("click", "view", "purchase")])).alias("t"))
    return rg.hash_feedback(e, b.select(rg.fingerprint(k, F.col("t")).alias("content_hash"), F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + 86400 * (k % 40)).alias("frozen_at")))


@query("WITH e AS (SELECT c_custkey + 10 AS k FROM customer), o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT coalesce(e.k, o.k) AS customer, CASE WHEN n IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS state FROM e FULL JOIN o ON e.k = o.k")
def j23_expected_universe(spark, sf_dir):
    """The customers' numbers moved by ten are expected, those of the orders observed."""
    expected = read(spark, sf_dir, "customer").select((F.col("c_custkey") + 10).alias("customer"))
    return rg.universe_coverage(expected, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer")), "customer")


@query(f"WITH {DECISIONS}, {RESULTS}, p AS (SELECT decision_id, symbol FROM decisions WHERE decision_id NOT IN (SELECT decision_id FROM results)), s AS (SELECT symbol, month(analysis_time) AS t FROM decisions), n AS (SELECT DISTINCT symbol FROM s WHERE t = (SELECT max(t) FROM s)) SELECT decision_id, symbol FROM p WHERE symbol NOT IN (SELECT symbol FROM n)")
def j25_broken_links(spark, sf_dir):
    d = decisions(spark, sf_dir)
    pending = lg.due_without_result(d, results(spark, sf_dir)).select("decision_id", "symbol")
    return rg.broken_links(pending, d.select("symbol", F.month("analysis_time").alias("taken_at"))).select("decision_id", "symbol")


@query(f"WITH {LOTS}, g AS (SELECT symbol, open_pos, sum(quantity) AS xq FROM lots GROUP BY 1, 2) SELECT j.symbol, min(j.pos) AS open_pos, count(*) AS open_lots FROM journal j LEFT JOIN g ON g.symbol = j.symbol AND g.open_pos = j.pos WHERE kind = 'open' AND coalesce(xq, 0) < q GROUP BY j.symbol")
def l02_active_lifecycle(spark, sf_dir):
    x = sx.lifecycles(journal(spark, sf_dir)).where("status <> 'closed'")
    return x.groupBy("symbol").agg(F.min("open_pos").alias("open_pos"), F.count("*").alias("open_lots"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, arg_max(o_orderkey, lpad(o_custkey::VARCHAR, 9, '0') || lpad(o_orderkey::VARCHAR, 12, '0')) AS k, count(*) AS versions FROM orders GROUP BY 1")
def s19_daily_index(spark, sf_dir):
    """The index as folders of months, upserted with one half of the orders and then with the other."""
    o = read(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = o.select("day", F.col("o_orderkey").alias("k"), (F.col("o_custkey").cast("decimal(20,0)") * 10**12 + F.col("o_orderkey")).alias("version"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    path = fresh_path(spark, "index")
    for i in (0, 1):
        store.upsert_days(rows.where(F.col("k") % 2 == i), path, "month", ["day"], "version")
    index = spark.read.schema(rows.schema).parquet(path).select("day", "k")
    return index.join(o.groupBy("day").agg(F.count("*").alias("versions")), "day")


@query(VERIFIED + ", w AS (SELECT *, avg(actual) OVER v AS base, count(*) OVER v AS seen FROM prs WINDOW v AS (PARTITION BY regime ORDER BY validation_time, decision_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT regime, count(*) AS n, round(avg(pow(predicted - actual, 2)), 6) AS brier, round(avg(pow(base - actual, 2)), 6) AS base_brier FROM w WHERE seen >= 20 GROUP BY regime")
def e05_walk_forward(spark, sf_dir):
    p = lg.pairs(lg.verified(decisions(spark, sf_dir), results(spark, sf_dir)))
    x = rg.walk_forward(p, "regime", ["validation_time", "decision_id"], 20)
    return x.select("regime", "n", F.round("brier", 6).alias("brier"), F.round("base_brier", 6).alias("base_brier"))


@query(VERIFIED + ", w AS (SELECT regime, return_pct, quantile_cont(return_pct, 0.05) OVER v AS lo, quantile_cont(return_pct, 0.95) OVER v AS hi, count(*) OVER v AS seen FROM ver WINDOW v AS (PARTITION BY regime ORDER BY validation_time, decision_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)) SELECT regime, count(*) AS n, round(avg((return_pct BETWEEN lo AND hi)::INT), 6) AS coverage, round(avg(hi - lo), 5) AS width FROM w WHERE seen >= 20 GROUP BY regime")
def e05_interval_coverage(spark, sf_dir):
    v = lg.verified(decisions(spark, sf_dir), results(spark, sf_dir))
    x = rg.interval_coverage(v, "regime", ["validation_time", "decision_id"], "return_pct")
    return x.select("regime", "n", F.round("coverage", 6).alias("coverage"), F.round("width", 5).alias("width"))


@query(VERIFIED + " SELECT regime, count(*) AS n, round(avg((outcome = 'success')::INT), 4) AS win_rate, round(avg(pow(predicted - (outcome = 'success')::INT, 2)) FILTER (outcome IN ('success', 'failure')), 4) AS brier, max(validation_time)::DATE::VARCHAR AS last_day FROM ver GROUP BY regime")
def a25_digest(spark, sf_dir):
    v = lg.verified(decisions(spark, sf_dir), results(spark, sf_dir)).withColumn("won", (F.col("outcome") == "success").cast("int"))
    settled = F.col("outcome").isin("success", "failure")
    return v.groupBy("regime").agg(F.count("*").alias("n"), F.round(F.avg("won"), 4).alias("win_rate"), F.round(F.avg(F.when(settled, F.pow(F.col("predicted") - F.col("won"), 2))), 4).alias("brier"), F.date_format(F.max("validation_time"), "yyyy-MM-dd").alias("last_day"))
