"""Row rules and small grouped jobs: alignment, health, coverage, identity, freshness of feeds, scores, exposures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.numeric import finite


def alignment(as_of: Column, target: Column, observed: Column) -> Column:
    """pass, degraded (the target is a weekend) or blocked: the observation may not lie before the target nor after the as-of date; three date formats are read."""
    day = lambda c: F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "yyyyMMdd"), F.try_to_date(c, "yyyy/MM/dd"))
    a, t, o = day(as_of), day(target), day(observed)
    return F.when(a.isNull() | t.isNull() | o.isNull() | (o < t) | (o > a), "blocked").when(F.dayofweek(t).isin(1, 7), "degraded").otherwise("pass")


def bar_errors(bars: DataFrame) -> DataFrame:
    """symbol, date, code of bars that break a bound: close outside of low and high, a price that is not positive, a date that repeats."""
    w = Window.partitionBy("symbol").orderBy("date")
    x = bars.withColumn("__p", F.lag("date").over(w))
    codes = F.array_compact(F.array(F.when((F.col("close") > F.col("high") + 1e-9) | (F.col("close") < F.col("low") - 1e-9), "close_out_of_range"), F.when(F.col("low") <= 0, "not_positive"), F.when(F.col("date") == F.col("__p"), "date_repeats")))
    return x.select("symbol", "date", F.explode(codes).alias("code"))


def missing_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """symbol, date of the calendar's sessions between a symbol's first and last bar that it lacks."""
    span = bars.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    want = calendar.select("date").distinct().join(span, (F.col("date") >= F.col("a")) & (F.col("date") <= F.col("b"))).select("symbol", "date")
    return want.join(bars.select("symbol", "date"), ["symbol", "date"], "left_anti")


def feed_health(rows: DataFrame, feed: str, now: Column, most_seconds: int) -> DataFrame:
    """feed, age, last_good, state: blocked by a clock in the future, stale beyond its age, else ok. The last good value is the last that is there."""
    g = rows.groupBy(feed).agg(F.max("ts").alias("last"), F.max_by("value", F.when(F.col("value").isNotNull(), F.col("ts"))).alias("last_good"))
    age = F.unix_timestamp(now) - F.unix_timestamp("last")
    return g.select(feed, age.alias("age"), "last_good", F.when(age < 0, "future_clock").when(age > most_seconds, "stale").otherwise("ok").alias("state"))


def ticks(price: Column, tick: str) -> Column:
    """The price as a whole number of ticks; null off the grid."""
    p = price.cast("decimal(20,6)") / F.lit(tick).cast("decimal(10,6)")
    n = F.round(p)
    return F.when(F.abs(p - n) < 1e-6, n.cast("long"))


def unit_value(value: Column, unit: Column, units: dict[str, float]) -> Column:
    """The value in the base unit; an unknown unit gives nothing."""
    factor = F.lit(None).cast("double")
    for name, f in units.items():
        factor = F.when(unit == name, f).otherwise(factor)
    return value * factor


def prioritised(rows: DataFrame, keys: list[tuple[str, DataFrame]]) -> DataFrame:
    """rows with match_id and how: the first of the lookups that finds an entry; more than one entry is ambiguous. Each lookup is (column, entries of that column and match_id)."""
    parts = []
    for i, (key, entries) in enumerate(keys):
        g = entries.groupBy(key).agg(F.min("match_id").alias("match_id"), F.count("*").alias("n"))
        parts.append(rows.join(g, key).select("row_id", F.struct(F.lit(i).alias("p"), F.when(F.col("n") == 1, F.col("match_id")).alias("match_id"), F.when(F.col("n") > 1, "ambiguous").otherwise(key).alias("how")).alias("m")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = found.groupBy("row_id").agg(F.min_by("m", "m.p").alias("m"))
    return rows.join(best, "row_id", "left").select(*rows.columns, F.col("m.match_id").alias("match_id"), F.coalesce("m.how", F.lit("none")).alias("how"))


def one_receipt(exits: DataFrame, receipts: DataFrame) -> DataFrame:
    """exits with net: of exactly one receipt with a net value, in one currency; any other trade has a gap."""
    g = receipts.groupBy("trade_id").agg(F.count("*").alias("n"), F.count_distinct("currency").alias("k"), F.max("net").alias("net"), F.count("net").alias("there"))
    ok = (F.col("n") == 1) & (F.col("k") == 1) & (F.col("there") == 1)
    return exits.join(g, "trade_id", "left").select("trade_id", F.when(ok, F.col("net")).alias("net"), F.when(ok, None).when(F.col("n").isNull(), "no_receipt").when(F.col("n") > 1, "many_receipts").otherwise("net_missing").alias("gap"))


def beat_rate(forecasts: DataFrame, reports: DataFrame, last: int = 8) -> DataFrame:
    """symbol, n, beat_rate over the last periods: the first forecast frozen strictly before the report of its period."""
    f = forecasts.join(reports, ["symbol", "period"]).where("observed_at < reported_at")
    f = f.groupBy("symbol", "period", "actual").agg(F.min_by("forecast", "observed_at").alias("forecast"))
    w = Window.partitionBy("symbol").orderBy(F.desc("period"))
    x = f.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= last)
    return x.groupBy("symbol").agg(F.count("*").alias("n"), F.avg((F.col("actual") > F.col("forecast")).cast("double")).alias("beat_rate"))


def quote(raw: Column) -> Column:
    """(price, source) of a raw quote as JSON text: an object with price and quote_source or source, a pair of price and source, or a bare number (source stub). A price that is no positive number is missing, its source stays."""
    t = F.trim(raw)
    positive = lambda c: F.when(c.try_cast("double") > 0, c.try_cast("double"))
    of = lambda path: F.nullif(F.get_json_object(t, path), F.lit(""))
    number = lambda path: F.when(~F.coalesce(F.get_json_object(t, path), F.lit("")).rlike("(?i)^(true|false)$"), F.get_json_object(t, path))
    # A price in quotes is a text, no number.
    bare = F.when(~t.rlike(r'"price"\s*:\s*"') & ~t.rlike(r'^\[\s*"'), F.coalesce(number("$.price"), number("$[0]")))
    price = finite(F.when(t.startswith("{") | t.startswith("["), positive(bare)).otherwise(positive(t)))
    source = F.when(t.startswith("{"), F.coalesce(of("$.quote_source"), of("$.source"), F.when(price.isNotNull(), "unknown"))).when(t.startswith("["), of("$[1]")).otherwise(F.when(price.isNotNull(), "stub"))
    return F.struct(price.alias("price"), source.alias("source"))


def quote_symbol(symbol: Column, market: Column, given: Column) -> Column:
    """The code that a quote is asked for by: the one that is given, else symbol and the market's suffix."""
    suffix = F.when(F.upper(market).isin("US", "HK", "SH", "SZ"), F.upper(market)).when(F.upper(market) == "A", "SH")
    return F.coalesce(F.nullif(given, F.lit("")), F.when(suffix.isNotNull(), F.concat_ws(".", symbol, suffix)).otherwise(symbol))


def settle(predictions: DataFrame, quotes: DataFrame, lag_seconds: int) -> DataFrame:
    """prediction_id, status, outcome: the first quote at or after the due time, no later than the lag cap; direction right or wrong.

    One window by symbol over forecasts and quotes together, no range join.
    """
    from marlstone.operators.market import close_on_or_after

    x = close_on_or_after(predictions, quotes.select("symbol", F.col("quote_ts").alias("date"), F.col("price").alias("close")), "due_ts")
    price = F.when(F.col("ref_date") <= F.col("due_ts") + F.make_interval(secs=F.lit(lag_seconds)), F.col("ref_close"))
    x = x.withColumn("price", price)
    up = F.col("price") > F.col("reference_price")
    return x.select("prediction_id", F.when(F.col("price").isNull(), "pending").otherwise("settled").alias("status"), F.when(F.col("price").isNotNull(), F.when(F.col("direction") == "long", up).otherwise(~up)).alias("right"))


def adjust(base: DataFrame, adjustments: DataFrame) -> DataFrame:
    """base with multiplier: the product of the adjustments that name the subject's symbol or its direction."""
    a = base.join(adjustments.where("kind = 'symbol'").select(F.col("key").alias("symbol"), "factor"), "symbol").select("id", "factor")
    b = base.join(adjustments.where("kind = 'direction'").select(F.col("key").alias("direction"), "factor"), "direction").select("id", "factor")
    m = a.unionByName(b).groupBy("id").agg(F.product("factor").alias("multiplier"), F.count("*").alias("applied"))
    return base.join(m, "id", "left").na.fill({"multiplier": 1.0, "applied": 0})


def entry_score(x: DataFrame, weights: dict[str, float], spread: float = 2.5) -> DataFrame:
    """score, missing, conflict: weighted mean of the factors that are there; a factor that is missing blocks, scores too far apart conflict."""
    cols = [F.col(c) for c in weights]
    there = F.array_compact(F.array(*cols))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    missing = F.lit(len(weights)) - F.size(there)
    return x.withColumns({"missing": missing, "score": F.when(missing == 0, total), "conflict": F.coalesce(F.array_max(there) - F.array_min(there) > spread, F.lit(False))})


def level_lifetimes(levels: DataFrame, side: int, most: int, least_volume: int, share: float) -> DataFrame:
    """Levels that appear and lose at least share of what they gained within `most` snapshots: symbol, session_id, ticks, appeared, removed, ratio.

    A level is followed at its price; the first snapshot at which it has lost enough counts. Each appearance meets at most `most` later snapshots.
    """
    from marlstone.operators.market import pair_levels

    x = pair_levels(levels, side).withColumn("added", F.col("volume") - F.col("was"))
    a = x.where(F.col("added") > least_volume).select("symbol", "session_id", "ticks", F.col("snap").alias("appeared"), "added", F.col("volume").alias("v0"))
    later = a.withColumn("snap", F.explode(F.sequence(F.col("appeared") + 1, F.col("appeared") + most)))
    snaps = levels.select("symbol", "session_id", "snap").distinct()
    at = x.select("symbol", "session_id", "ticks", "snap", F.col("volume").alias("v"))
    y = later.join(snaps, ["symbol", "session_id", "snap"]).join(at, ["symbol", "session_id", "ticks", "snap"], "left")
    ratio = F.least(F.col("added"), F.greatest(F.col("v0") - F.coalesce("v", F.lit(0)), F.lit(0))) / F.col("added")
    y = y.withColumn("ratio", ratio).where(F.col("ratio") >= share)
    return y.groupBy("symbol", "session_id", "ticks", "appeared").agg(F.min("snap").alias("removed"), F.min_by("ratio", "snap").alias("ratio"))
