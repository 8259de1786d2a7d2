"""Decisions and their results, calibration of forecasts, lots, reconciliation, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.numeric import age_weight

LONG, SHORT, PASSIVE = ("long", "buy", "build", "add"), ("short", "sell", "reduce"), ("watch", "avoid")


def outcome(direction: Column, ret: Column) -> Column:
    """Outcome label by direction and sign of the return; passive calls are neutral, what is left is mixed."""
    up, down = direction.isin(*LONG), direction.isin(*SHORT)
    return F.when((up & (ret > 0)) | (down & (ret < 0)), "success").when((up & (ret < 0)) | (down & (ret > 0)), "failure").when(direction.isin(*PASSIVE), "neutral").otherwise("mixed")


def action_bucket(direction: Column, level: Column) -> Column:
    """Bucket by direction first, then level."""
    return F.when(direction.isin(*SHORT), "sell_reduce_short").when(direction.isin(*LONG), "buy_build_add").when(direction.isin(*PASSIVE), "watch_avoid").when(level.isin("L1", "L2"), "buy_build_add").otherwise("watch_avoid")


def verified(decisions: DataFrame, results: DataFrame, newest: int | None = None) -> DataFrame:
    """Decisions with their result and outcome; newest: the so many latest by validation time (ties by id)."""
    x = decisions.join(results, "decision_id").withColumn("outcome", outcome(F.col("direction"), F.col("return_pct")))
    return x.orderBy(F.desc("validation_time"), F.desc("decision_id")).limit(newest) if newest else x


def due_without_result(decisions: DataFrame, results: DataFrame) -> DataFrame:
    return decisions.join(results.select("decision_id"), "decision_id", "left_anti")


def group_stats(x: DataFrame, *keys: str) -> DataFrame:
    won, lost = (F.col("outcome") == "success").cast("long"), (F.col("outcome") == "failure").cast("long")
    return x.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(won).alias("success"), F.sum(lost).alias("failure"), F.round(F.avg(won), 3).alias("win_rate"), F.round(F.avg("return_pct"), 3).alias("avg_return_pct"), F.round(F.sum("return_pct"), 3).alias("sum_return_pct"))


def decayed_stats(x: DataFrame, as_of: Column, half_life: float = 30.0, floor: float = 0.05) -> DataFrame:
    """Win rate and return weighted by age: half-life of 30 days, never under the floor."""
    w = age_weight(F.col("validation_time"), as_of, half_life, floor)
    x = x.withColumn("w", w)
    return x.agg(F.count("*").alias("n"), F.try_divide(F.sum(F.when(F.col("outcome") == "success", F.col("w")).otherwise(0.0)), F.sum("w")).alias("decayed_win_rate"), F.try_divide(F.sum(F.col("w") * F.col("return_pct")), F.sum("w")).alias("decayed_return_pct"))


def tag_counts(x: DataFrame, tags: str = "failure_tags", least: int = 1, share: float = 0.0) -> DataFrame:
    """Tags with at least so many rows and at least this share of all rows."""
    n = x.agg(F.count("*").alias("all_rows"))
    t = x.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).join(F.broadcast(n))
    return t.withColumn("share", F.col("n") / F.col("all_rows")).where((F.col("n") >= least) & (F.col("share") >= share)).select("tag", "n", "share")


def pairs(x: DataFrame) -> DataFrame:
    """Forecasts that were settled as won or lost: predicted, actual."""
    return x.where(F.col("outcome").isin("success", "failure") & F.col("predicted").isNotNull()).withColumn("actual", (F.col("outcome") == "success").cast("double"))


def brier() -> Column:
    return F.round(F.avg(F.pow(F.col("predicted") - F.col("actual"), 2)), 4)


def reliability(p: DataFrame) -> DataFrame:
    """Ten bins by tenths, the last one closed; empty bins have no row."""
    b = F.least(F.lit(9), F.floor(F.round(F.col("predicted") * 10, 9))).cast("int")
    return p.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("predicted"), 3).alias("mean_predicted"), F.round(F.avg("actual"), 3).alias("realised_win_rate"))


def group_calibration(p: DataFrame, *keys: str, least: int = 3) -> DataFrame:
    g = p.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("predicted").alias("m"), F.avg("actual").alias("r"), brier().alias("brier")).where(F.col("n") >= least)
    return g.select(*keys, "n", F.round("m", 3).alias("mean_predicted"), F.round("r", 3).alias("realised_win_rate"), F.round(F.col("m") - F.col("r"), 3).alias("calibration_gap"), "brier")


def worst_group(grouped: DataFrame, key: str, limit: float = 0.08) -> DataFrame:
    """The group with the widest gap of at least limit; ties to the smaller key."""
    return grouped.where(F.abs("calibration_gap") >= limit).orderBy(F.desc(F.abs("calibration_gap")), key).limit(1)


def scorecard(p: DataFrame, least: int = 10, high: float = 0.15, medium: float = 0.08) -> DataFrame:
    """One row: Brier score against that of the base rate (both rounded before they are divided), gap, confidence, materiality."""
    g = p.agg(F.count("*").alias("n"), F.avg("predicted").alias("mp"), F.avg("actual").alias("base"), brier().alias("brier"))
    base_brier = F.round(F.col("base") * (1 - F.col("base")), 4)
    gap = F.round(F.col("mp") - F.col("base"), 3)
    g = g.withColumns({"base_brier": base_brier, "calibration_gap": gap})
    skill = F.round(1 - F.try_divide("brier", "base_brier"), 3)
    confidence = F.when(gap.isNull(), "unknown").when(gap >= medium, "overconfident").when(gap <= -medium, "underconfident").otherwise("well_calibrated")
    material = F.when((F.col("n") < least) | gap.isNull(), "none").when(F.abs(gap) >= high, "high").when(F.abs(gap) >= medium, "medium").otherwise("none")
    return g.select("n", F.round("base", 3).alias("base_rate"), "brier", "base_brier", skill.alias("skill"), "calibration_gap", confidence.alias("confidence"), material.alias("materiality"))


def newest_each(x: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    return x.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def tail_streak(x: DataFrame, by: str, order: list[str], holds: Column) -> DataFrame:
    """Length of the run at the end in which holds is true, for each key."""
    x = x.withColumns({"__i": F.row_number().over(Window.partitionBy(by).orderBy(*order)), "__h": F.coalesce(holds, F.lit(False))})
    return x.groupBy(by).agg((F.max("__i") - F.coalesce(F.max(F.when(~F.col("__h"), F.col("__i"))), F.lit(0))).cast("long").alias("streak"))


def match_lots(journal: DataFrame) -> DataFrame:
    """symbol, open_pos, close_pos, quantity: closes take the oldest open lots first; a close beyond what is open is discarded, not carried.

    Lots and closes are intervals of cumulative quantity per symbol (exact to 8 decimals); closes are moved by the running surplus.
    Both tile the same line, so between two neighbouring ends lies one piece of one lot and one close: a union of the ends and one
    window over them, whatever the quantities are.
    """
    kind = journal.schema["q"].dataType
    w = Window.partitionBy("symbol").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_open, q, none = F.col("kind") == "open", F.col("q").cast("decimal(28,8)"), F.lit(0).cast("decimal(28,8)")
    j = journal.withColumns({"o": F.sum(F.when(is_open, q).otherwise(none)).over(w), "x": F.sum(F.when(is_open, none).otherwise(q)).over(w)})
    j = j.withColumn("xe", F.col("x") - F.greatest(none, F.max(F.col("x") - F.col("o")).over(w)))
    j = j.withColumn("xb", F.coalesce(F.lag("xe").over(Window.partitionBy("symbol").orderBy("pos")), none))
    row = F.struct("pos", "cents", "q")
    ends = j.where((is_open & (q > 0)) | (~is_open & (F.col("xe") > F.col("xb")))).select("symbol", F.when(is_open, F.col("o")).otherwise(F.col("xe")).alias("p"), F.when(is_open, row).alias("a"), F.when(~is_open, row).alias("b"))
    # Downwards, the last lot and the last close seen are those that reach over the piece below an end.
    down = Window.partitionBy("symbol").orderBy(F.desc("p"), F.col("a").isNull(), "a.pos", "b.pos")
    seen = lambda c: F.last(c, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    pieces = ends.select("symbol", (F.col("p") - F.coalesce(F.lead("p").over(down), none)).alias("quantity"), seen("a").alias("a"), seen("b").alias("b")).where("quantity > 0 and a is not null and b is not null")
    side = lambda c, n: [F.col(f"{c}.{k}").alias(f"{n}_{k}") for k in ("cents", "q")]
    return pieces.select("symbol", F.col("a.pos").alias("open_pos"), F.col("b.pos").alias("close_pos"), F.col("quantity").cast(kind).alias("quantity"), *side("a", "open"), *side("b", "close"))


def reconcile(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """key, left_value, right_value, status: only_left, only_right, mismatch or equal."""
    a, b = left.select(key, F.col(value).alias("left_value")), right.select(key, F.col(value).alias("right_value"))
    x = a.join(b, key, "full_outer")
    status = F.when(F.col("right_value").isNull(), "only_left").when(F.col("left_value").isNull(), "only_right").when(F.abs(F.col("left_value") - F.col("right_value")) > tolerance, "mismatch").otherwise("equal")
    return x.withColumn("status", status)


def largest_remainder(x: DataFrame, by: list[str], weight: str, key: str, total: int = 100) -> DataFrame:
    """points: weights as whole numbers that sum to total; what is left goes to the largest remainders, ties to the smaller key."""
    w = Window.partitionBy(*by)
    exact = F.col(weight) * total / F.sum(weight).over(w)
    x = x.withColumns({"__f": F.floor(exact).cast("long"), "__r": F.round(exact - F.floor(exact), 9)})
    place = F.row_number().over(w.orderBy(F.desc("__r"), key))
    return x.withColumn("points", F.col("__f") + F.when(place <= total - F.sum("__f").over(w), 1).otherwise(0)).drop("__f", "__r")


def fair_queue(x: DataFrame, severity: str, target: str, dimension: str, most: int) -> DataFrame:
    """Round robin: by severity, then the first gap of every target, then the second of each; the first `most` rows with their place."""
    turn = F.row_number().over(Window.partitionBy(severity, target).orderBy(dimension))
    order = [F.col(severity), F.col("turn"), F.col(target)]
    out = x.withColumn("turn", turn).orderBy(*order).limit(most)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # `most` rows
