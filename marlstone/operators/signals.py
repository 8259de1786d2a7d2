"""Smaller signals: books as arrays, histories, reliability, limit leaks, session moves, watch triggers, method weights, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.market import greedy_origins
from marlstone.sources.shared import few


def book_depth(bids: Column, asks: Column, top: int = 5) -> tuple[Column, Column]:
    """(depth, imbalance) of the first levels of both sides (arrays of price and volume); no depth, no imbalance."""
    total = lambda side: F.aggregate(F.slice(side, F.lit(1), F.lit(top)), F.lit(0.0), lambda a, x: a + x["price"] * x["volume"])
    b, a = total(bids), total(asks)
    return b + a, F.try_divide(b - a, b + a)


def history_delta(history: Column) -> Column:
    """Last less first of an array; missing with fewer than two values."""
    return F.when(F.size(history) >= 2, F.element_at(history, -1) - F.element_at(history, 1))


def change_over(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """key, delta: last less first value of each key that is there, by its time; missing with fewer than two. No history is gathered."""
    x = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.max_by(value, at).alias("last"), F.min_by(value, at).alias("first"))
    return x.select(key, F.when(F.col("n") >= 2, F.col("last") - F.col("first")).alias("delta"))


def reliability(depth: Column, spread: Column, age_hours: Column) -> Column:
    """1 less penalties for a thin book, a wide spread and an old quote, within 0 and 1."""
    p = F.when(depth < 1000, 0.3).otherwise(0.0) + F.when(spread > 0.05, 0.25).otherwise(0.0) + F.when(age_hours > 24, 0.25).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - p))


def limit_leak(book: DataFrame, drop: float = 0.5) -> DataFrame:
    """Snapshots after one that was locked at its limit (columns ticks, limit_ticks, seal): the price left the limit or the queue fell by drop."""
    w = Window.partitionBy("symbol", "session_id").orderBy("snap")
    x = book.withColumn("p", F.lag(F.struct("ticks", "limit_ticks", "seal")).over(w)).where((F.col("p.ticks") == F.col("p.limit_ticks")) & (F.col("p.seal") > 0))
    fell = F.greatest(F.col("p.seal") - F.when(F.col("ticks") == F.col("p.limit_ticks"), F.col("seal")).otherwise(0), F.lit(0)) / F.col("p.seal")
    opened = F.col("ticks") < F.col("p.limit_ticks")
    return x.select("symbol", "session_id", "snap", (opened | (fell >= drop)).alias("fired"), F.greatest(fell, F.when(opened, 1.0).otherwise(0.0)).alias("strength"))


def session_moves(events: DataFrame, bars: DataFrame) -> DataFrame:
    """event_id, move_pct: absolute move from the close at the event to the next after a close, from the one before to it before an open."""
    w = Window.partitionBy("symbol").orderBy("date")
    b = bars.select("symbol", F.col("date").alias("event_date"), "close", F.lag("close").over(w).alias("before"), F.lead("close").over(w).alias("after"))
    x = events.join(b, ["symbol", "event_date"])
    move = F.when(F.col("session") == "after_close", F.try_divide("after", "close")).otherwise(F.try_divide("close", "before")) - 1
    return x.select("event_id", "symbol", F.abs(100 * move).alias("move_pct"))


def crossings(quotes: DataFrame, triggers: DataFrame, cooldown_seconds: int) -> DataFrame:
    """trigger_id, ts of each firing: the price passes the threshold from below, at most once in a cool-down. quotes: symbol, ts, price.

    Crossings are found by the quote before; of each trigger's crossings a fold keeps those far enough from the last one kept.
    """
    w = Window.partitionBy("symbol").orderBy("ts", "event_id")
    q = quotes.withColumn("before", F.lag("price").over(w)).join(triggers, "symbol")
    hit = q.where((F.col("before") < F.col("threshold")) & (F.col("price") >= F.col("threshold"))).select("trigger_id", F.unix_micros("ts").alias("at_us"))
    return greedy_origins(hit, "trigger_id", "at_us", cooldown_seconds * 1_000_000 - 1)


def method_weights(subjects: DataFrame, rules: DataFrame, tighten: Column) -> DataFrame:
    """subject rows with each method's weight of their scenario; under a tightened regime the defensive methods gain a half."""
    x = subjects.join(few(rules), "scenario").withColumn("weight", F.when(tighten & F.col("defensive"), F.col("weight") * 1.5).otherwise(F.col("weight")))
    return x.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("subject")))


def triage(trades: DataFrame, seen: DataFrame) -> DataFrame:
    """pattern, n, mean_r, fresh, novelty: completed trades with an id that occurs once, patterns with a negative mean; ids not consumed before are fresh."""
    once = trades.groupBy("trade_id").agg(F.count("*").alias("k"), F.first("pattern").alias("pattern"), F.first("r").alias("r")).where("k = 1")
    x = once.join(seen.select("trade_id").distinct().withColumn("old", F.lit(True)), "trade_id", "left")
    g = x.groupBy("pattern").agg(F.count("*").alias("n"), F.avg("r").alias("mean_r"), F.count_if(F.col("old").isNull()).alias("fresh")).where("mean_r < 0")
    return g.withColumn("novelty", F.when(F.col("fresh") == 0, "known").when(F.col("fresh") == F.col("n"), "new").otherwise("extended"))


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """table with the newest change of each key: rows of the table whose key changed go, new keys come in."""
    newest = changes.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
    return table.join(newest.select(key), key, "left_anti").unionByName(newest)


def latest_facts(facts: DataFrame, priority: dict[str, int]) -> DataFrame:
    """entity, field, value: of each field the tag of highest priority, of that the fact filed last (columns entity, tag, field, value, filed)."""
    p = F.lit(99)
    for tag, n in priority.items():
        p = F.when(F.col("tag") == tag, n).otherwise(p)
    w = Window.partitionBy("entity", "field").orderBy("p", F.desc("filed"), F.desc("value"))
    return facts.withColumn("p", p).withColumn("__n", F.row_number().over(w)).where("__n = 1").select("entity", "field", "tag", "value", "filed")
