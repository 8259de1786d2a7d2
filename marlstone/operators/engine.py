"""Runs of the factor evaluation over factors and horizons, and the comparison of its two random controls."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.numeric import finite
from marlstone.operators import factors as fx
from marlstone.sources.shared import written

ALIVE = "confirmed_alive"
#: A fall of the median distance below this, without a change of state, speaks against the wider control.
LEAST_DECREASE = 0.3


def required_rows(name: str, horizon: int, min_dates: int) -> int:
    """Bars of a symbol that a factor needs for min_dates sections that do not overlap, and so that its first ones are no more than 30% of them."""
    history = fx.HISTORY[name]
    return max(history + horizon * (min_dates + 1), math.ceil((history + horizon) / 0.30))


def _kept(panel: DataFrame, names: list[str], horizons: list[int]) -> DataFrame:
    """What an evaluation reads of a panel, worked out once for all its sections, dates and controls; a panel that is kept already stays as it is."""
    columns = [c for c in dict.fromkeys(("symbol", "date", "null_eligible", *names, *[f"fwd_{h}" for h in horizons])) if c in panel.columns]
    return panel if panel.columns == columns else written(panel.select(*columns), "panel")


def run_engine(panel: DataFrame, names: list[str], horizons: list[int], trials: int = 100, seed: int = 7, least: int = 30, min_dates: int = 40, share: float = 0.7, null: str = "shuffle", sections: dict[int, DataFrame] | None = None) -> DataFrame:
    """factor_name, horizon and the columns of evaluate, each horizon over sections that do not overlap (a section every `horizon` dates).

    Where a factor has no result and the shortest symbol has fewer bars than it needs, gaps also says insufficient_history_window, with
    available_rows (least, and the median in available_median) and required_rows. sections: those of each horizon, where they are written already.
    """
    if not names or not horizons or min(horizons) < 1:
        raise ValueError("factors and horizons of one bar or more are needed")
    panel = _kept(panel, names, horizons)
    runs = [fx.evaluate(panel, names, h, trials, seed, least, min_dates, share, h, null, (sections or {}).get(h)).withColumn("horizon", F.lit(h)) for h in horizons]
    bars = panel.groupBy("symbol").agg(F.count("*").alias("n")).agg(F.coalesce(F.min("n"), F.lit(0)).alias("available_rows"), F.coalesce(F.median("n"), F.lit(0.0)).alias("available_median"))
    x = reduce(DataFrame.unionByName, runs).join(F.broadcast(bars))  # one row
    needs = reduce(lambda c, nh: F.when((F.col("factor_name") == nh[0]) & (F.col("horizon") == nh[1]), required_rows(*nh, min_dates)).otherwise(c), [(n, h) for n in names for h in horizons], F.lit(None).cast("int"))
    x = x.withColumn("required_rows", needs)
    short = (F.col("status") != "ok") & (F.col("available_rows") < F.col("required_rows"))
    return x.withColumn("gaps", F.when(short, F.concat("gaps", F.array(F.lit("insufficient_history_window")))).otherwise(F.col("gaps")))


def run_nulls(panel: DataFrame, names: list[str], horizons: list[int], trials: int = 100, seed: int = 7, least: int = 30, min_dates: int = 40, share: float = 0.7, nulls: tuple[str, ...] = ("shuffle", "circular")) -> list[DataFrame]:
    """run_engine once for each control, over one panel and one set of sections that all of them read."""
    panel = _kept(panel, names, horizons)
    keep = ["null_eligible"] if "null_eligible" in panel.columns else None
    sections = {h: written(fx.long_sections(panel, names, h, least, keep), "sections") for h in horizons}
    return [run_engine(panel, names, horizons, trials, seed, least, min_dates, share, null, sections) for null in nulls]


def compare_nulls(shuffle: DataFrame, circular: DataFrame, threshold: float = 3.5, directions: dict[str, str] | None = None) -> DataFrame:
    """One row for each factor and horizon of two runs: comparable, both controls' deviation, distance and state, wider, not_higher, state_changed, downgraded.

    wider: rotation's deviation is the larger one; not_higher: its distance is no larger; both false where a run has no result.
    """
    of = lambda run, tag: fx.verdict(run, threshold, directions).select("factor_name", "horizon", F.col("status").alias(f"{tag}_status"), finite(F.col("random_ic_std")).alias(f"{tag}_std"), finite(F.col("alpha_t")).alias(f"{tag}_alpha"), F.col("state").alias(f"{tag}_state"))
    x = of(shuffle, "shuffle").join(of(circular, "circular"), ["factor_name", "horizon"])
    both = (F.col("shuffle_status") == "ok") & (F.col("circular_status") == "ok")
    told = lambda c: both & F.coalesce(c, F.lit(False))
    before, after = F.when(both, F.col("shuffle_state")), F.when(both, F.col("circular_state"))
    return x.withColumns(
        {
            "comparable": both, "shuffle_state": before, "circular_state": after, "wider": told(F.col("circular_std") > F.col("shuffle_std")), "not_higher": told(F.col("circular_alpha") <= F.col("shuffle_alpha") + 1e-12),
            "state_changed": both & ~before.eqNullSafe(after), "downgraded": both & before.eqNullSafe(F.lit(ALIVE)) & ~after.eqNullSafe(F.lit(ALIVE)),
        }
    )


def comparison_summary(entries: DataFrame) -> DataFrame:
    """One row: pairs, comparable, state_changes, downgrades, median_decrease of the distance, invariants (wider and not higher everywhere), falsified (no state changed and the median fell by under 0.3), supported, status."""
    c = F.col("comparable")
    fall = F.when(c, F.col("shuffle_alpha") - F.col("circular_alpha"))
    g = entries.agg(F.count("*").alias("pairs"), F.count_if(c).alias("comparable"), F.count_if("state_changed").alias("state_changes"), F.count_if("downgraded").alias("downgrades"), F.median(fall).alias("median_decrease"), F.coalesce(F.every(F.when(c, F.col("wider") & F.col("not_higher"))), F.lit(False)).alias("invariants"))
    some = F.col("comparable") > 0
    g = g.withColumn("falsified", F.coalesce(some & (F.col("state_changes") == 0) & (F.col("median_decrease") < LEAST_DECREASE), F.lit(False)))
    return g.withColumns({"supported": F.col("invariants") & (F.col("downgrades") > 0), "status": F.when(~some, "insufficient_data").when(~F.col("invariants"), "failed_invariants").otherwise("ok")})


def ceiling(whole: Column, part: Column) -> Column:
    """State of a condition under that of the factor as a whole: a condition can take a confirmed state away, never lift one."""
    return F.when(whole.isNull() | part.isNull(), None).when((whole == ALIVE) & (part != ALIVE), "train_only").otherwise(whole)


def conditional_validation(panel: DataFrame, names: list[str], horizons: list[int], states: DataFrame, bins: list[str], trials: int = 100, seed: int = 7, least: int = 30, min_dates: int = 40, share: float = 0.7, null: str = "shuffle", threshold: float = 3.5) -> DataFrame:
    """One row for each factor, horizon and bin: status, effective_sections, alpha_t, raw_state, global_state, state, degraded.

    states: date, state, the label known at the session before. The sections are those of the factor as a whole, a section every
    horizon dates, so a bin's own do not overlap either; each bin is evaluated on its dates, against controls of its own, with the gates
    and the threshold of the whole. status: ok, insufficient_sample (the gates) or unjudgeable (a statistic is missing); state keeps under
    the ceiling of global_state, and degraded says that a confirmed factor is train_only in this bin.
    """
    keep = ["null_eligible"] if "null_eligible" in panel.columns else None
    panel = _kept(panel, names, horizons)
    key = F.concat_ws("|", "factor_name", F.col("horizon").cast("string"), "state")
    parts = [fx.strided(fx.long_sections(panel, names, h, least, keep), h).withColumn("horizon", F.lit(h)) for h in horizons]
    s = written(reduce(DataFrame.unionByName, parts).join(states.where(F.col("state").isin(*bins)).select("date", "state"), "date").withColumn("factor_name", key).drop("horizon", "state"), "conditions")
    grid = [(n, h, b, f"{n}|{h}|{b}") for n in names for h in horizons for b in bins]
    cells = panel.sparkSession.createDataFrame(grid, "factor string, horizon int, bin string, factor_name string")
    totals = cells.select("factor_name").join(s.groupBy("factor_name").agg(F.count_distinct("date").alias("total_dates")), "factor_name", "left").na.fill(0, ["total_dates"])
    own = fx.verdict(fx.evaluate_sections(s, totals, trials, seed, least, min_dates, share, 1, null), threshold, {k: fx.FACTORS[n][1] for n, _, _, k in grid})
    whole = fx.verdict(run_engine(panel, names, horizons, trials, seed, least, min_dates, share, null), threshold).select(F.col("factor_name").alias("factor"), "horizon", F.when(F.col("status") == "ok", F.col("state")).alias("global_state"))
    x = cells.join(own.select("factor_name", F.col("status").alias("evaluated"), "effective_sections", "alpha_t", F.col("state").alias("raw_state")), "factor_name").join(whole, ["factor", "horizon"])
    ok = F.col("evaluated") == "ok"
    state = F.when(ok, ceiling(F.col("global_state"), F.col("raw_state")))
    x = x.withColumn("state", state)
    status = F.when(~ok, "insufficient_sample").when(F.col("state").isNull(), "unjudgeable").otherwise("ok")
    return x.select("factor", "horizon", "bin", status.alias("status"), "effective_sections", F.when(ok, F.col("alpha_t")).alias("alpha_t"), F.when(ok, F.col("raw_state")).alias("raw_state"), "global_state", "state", F.coalesce((F.col("global_state") == ALIVE) & (F.col("state") == "train_only"), F.lit(False)).alias("degraded"))


def condition_pairs(validated: DataFrame) -> DataFrame:
    """factor, horizon, judgeable, insufficient, unjudgeable, degradations, pair_status of every pair of a conditional validation."""
    of = lambda s: F.count_if(F.col("status") == s)
    g = validated.groupBy("factor", "horizon").agg(F.count("*").alias("bins"), of("ok").alias("judgeable"), of("insufficient_sample").alias("insufficient"), of("unjudgeable").alias("unjudgeable"), F.count_if("degraded").alias("degradations"))
    status = F.when(F.col("degradations") > 0, "degradation_observed").when(F.col("judgeable") == F.col("bins"), "no_degradation").when(F.col("unjudgeable") > 0, "pending_unjudgeable").otherwise("pending_insufficient_sample")
    return g.withColumn("pair_status", status)


def condition_family(pairs: DataFrame, complete: bool) -> DataFrame:
    """One row: whether a dimension of conditions is retained, over the whole declared family of factors and horizons; pending until it is complete."""
    g = pairs.agg(F.sum("bins").alias("scanned"), F.sum("degradations").alias("degradations"), F.every(F.col("judgeable") == F.col("bins")).alias("all_judgeable"), F.sum("unjudgeable").alias("unjudgeable"))
    status = F.when(~F.lit(complete) | F.col("scanned").isNull(), "pending_family_aggregation").when(F.col("degradations") > 0, "retained_degradation_observed").when(F.col("all_judgeable"), "rejected_no_degradation").when(F.col("unjudgeable") > 0, "pending_unjudgeable").otherwise("pending_insufficient_sample")
    return g.select("scanned", "degradations", status.alias("dimension_status"), (status == "retained_degradation_observed").alias("retained"))
