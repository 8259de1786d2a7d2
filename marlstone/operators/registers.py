"""Registers and their upkeep: calendars, content hashes, indexes, coverage of expected rows, comparisons of snapshots, walk-forward scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_weekdays(day: Column, n: int) -> Column:
    """The last n weekdays up to a day, newest first."""
    days = F.sequence(day, F.date_sub(day, 2 * n + 4), F.make_interval(days=F.lit(-1)))
    return F.slice(F.filter(days, lambda d: ~F.dayofweek(d).isin(1, 7)), F.lit(1), F.lit(n))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts as text, in their order, null apart from empty; our own canonical form."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]), 256)


def newest_per_day(index: DataFrame, day: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(day).orderBy(*[F.desc(c) for c in order])
    return index.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def hash_feedback(entries: DataFrame, bundles: DataFrame) -> DataFrame:
    """entries with gap: an entry needs a bundle of the same content hash that was frozen before it."""
    b = bundles.groupBy("content_hash").agg(F.min("frozen_at").alias("frozen_at"))
    # Bundles grow with the table, and their size is taken for smaller than it is: both sides are shuffled, none is sent whole.
    x = entries.join(b.hint("merge"), "content_hash", "left")
    return x.select("entry_id", F.when(F.col("frozen_at").isNull(), "no_bundle").when(F.col("frozen_at") >= F.col("entered_at"), "bundle_after_entry").otherwise("linked").alias("state"))


def universe_coverage(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """key, state: missing, unexpected, duplicate or ok."""
    o = observed.groupBy(key).agg(F.count("*").alias("n"))
    x = expected.select(key).distinct().withColumn("e", F.lit(True)).join(o, key, "full_outer")
    return x.select(key, F.when(F.col("n").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("n") > 1, "duplicate").otherwise("ok").alias("state"))


def broken_links(pending: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Pending rows whose symbol is not in the newest snapshot; without any snapshot there is no finding."""
    top = snapshots.agg(F.max("taken_at").alias("taken_at"))
    newest = snapshots.join(F.broadcast(top), "taken_at").select("symbol").distinct()
    return pending.join(newest, "symbol", "left_anti").join(F.broadcast(top.where("taken_at is not null").select(F.lit(True).alias("known"))), how="left_semi", on=F.lit(True))


def weakening(snapshots: DataFrame, drop: float) -> DataFrame:
    """Snapshots (symbol, at, basis, exposure) whose exposure fell by drop against the one before, only where the basis agrees."""
    w = Window.partitionBy("symbol").orderBy("at")
    x = snapshots.withColumn("p", F.lag(F.struct("basis", "exposure")).over(w)).where("p is not null")
    same = F.col("p.basis") == F.col("basis")
    fell = F.col("exposure") <= (1 - drop) * F.col("p.exposure")
    return x.select("symbol", "at", F.when(~same, "not_comparable").when(fell, "weaker").otherwise("steady").alias("state"))


def threshold_margin(values: DataFrame, by: str) -> DataFrame:
    """by, spread, margin, robust: whether the sources' disagreement could carry the value across its threshold (columns value, alt, threshold)."""
    g = values.groupBy(by).agg(F.max(F.abs(F.col("alt") - F.col("value"))).alias("spread"), F.min(F.abs(F.col("value") - F.col("threshold"))).alias("margin"))
    return g.withColumn("robust", F.col("spread") < F.col("margin"))


def walk_forward(x: DataFrame, by: str, order: list[str], least: int) -> DataFrame:
    """by, n, brier, base_brier: forecasts against the mean outcome of the rows before, from the row that has `least` before it."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    y = x.withColumns({"base": F.avg("actual").over(w), "seen": F.count("actual").over(w)}).where(F.col("seen") >= least)
    return y.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.pow(F.col("predicted") - F.col("actual"), 2)).alias("brier"), F.avg(F.pow(F.col("base") - F.col("actual"), 2)).alias("base_brier"))


def interval_coverage(x: DataFrame, by: str, order: list[str], value: str, last: int = 100, least: int = 20) -> DataFrame:
    """by, n, coverage, width: how often a value lies within the 5% and 95% quantiles of the `last` values before it, and how wide they are apart on average."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-last, -1)
    y = x.withColumns({"__q": F.percentile(value, F.array(F.lit(0.05), F.lit(0.95))).over(w), "__n": F.count(value).over(w)}).where(F.col("__n") >= least)
    low, high = F.get("__q", F.lit(0)), F.get("__q", F.lit(1))
    return y.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col(value).between(low, high).cast("double")).alias("coverage"), F.avg(high - low).alias("width"))
