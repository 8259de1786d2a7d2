"""State rules over indicators: sentiment, crowding, risk regime, flows; lifecycles; model weights; partial regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.ledger import match_lots


def sentiment_phase(up: Column, down: Column, height: Column, break_rate: Column, premium: Column) -> Column:
    """Phase by limit-ups, limit-downs, board height, break rate and premium; the first rule that fits."""
    weak = (up <= 15) & (height <= 2) & (premium.isNull() | (premium < 0))
    return (
        F.when((down >= 20) | weak, "ice").when((up >= 80) & (break_rate >= 0.35), "divergence").when((up >= 70) & (height >= 4), "climax").when((down >= 10) & (up <= 40), "retreat")
        .when(up.between(25, 70) & (height >= 3), "ferment").when((up >= 15) & (height >= 2), "start").when(up >= 10, "start").otherwise("ice")
    )


def flow_state(last_values: Column) -> Column:
    """State of the last five daily net flows (oldest first); fewer than three are unknown."""
    n = F.size(last_values)
    at = lambda k: F.element_at(last_values, -k)
    before = F.aggregate(F.slice(last_values, F.lit(1), F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda a, x: a + x)
    count = lambda f: F.size(F.filter(last_values, f))
    up3 = (at(1) > 0) & (at(2) > 0) & (at(3) > 0)
    return (
        F.when(n < 3, "unknown").when((count(lambda x: x > 0) >= 3) & up3, "continuous_inflow").when((count(lambda x: x < 0) >= 3) & (at(1) > 0) & (before < 0), "recovery_inflow")
        .when((at(1) > 0) & (before <= 0), "first_inflow").when((at(1) < 0) & (before > 0), "outflow").otherwise("mixed")
    )


def crowding_state(pctile: Column, d1: Column, d5: Column, premium_pctile: Column) -> Column:
    unwind = F.coalesce(d1 >= 15, F.lit(False)) | F.coalesce(d5 >= 30, F.lit(False))
    return F.when(unwind, "correlation_unwind_active").when(pctile <= 0.05, "dispersion_extreme").when((pctile <= 0.25) | (premium_pctile >= 0.8), "crowding_building").otherwise("benign")


def volatility_signal(last: Column, d1: Column, d5: Column) -> Column:
    n = (last >= 20).cast("int") + F.coalesce((d1 >= 10).cast("int"), F.lit(0)) + F.coalesce((d5 >= 20).cast("int"), F.lit(0))
    return (n >= 2) | ((last >= 25) & (n >= 1))


def risk_regime(signals: DataFrame, by: str) -> DataFrame:
    """by, triggered, layers, regime, multiplier from signal rows (layer, triggered)."""
    g = signals.groupBy(by).agg(F.count_if("triggered").alias("n"), F.count_distinct(F.when(F.col("triggered"), F.col("layer"))).alias("layers"))
    n, k = F.col("n"), F.col("layers")
    rules = [(n <= 1, "normal", 1.0), (n == 2, "stress_building", 0.7), ((n == 3) & (k >= 2), "deleveraging_watch", 0.5), ((n == 4) & (k >= 3), "active_deleveraging", 0.3), (n >= 5, "forced_liquidation", 0.1)]
    name, mult = F.lit("deleveraging_watch"), F.lit(0.5)
    for ok, label, m in reversed(rules):
        name, mult = F.when(ok, label).otherwise(name), F.when(ok, m).otherwise(mult)
    return g.select(by, F.col("n").alias("triggered"), "layers", name.alias("regime"), mult.alias("multiplier"))


def ladder(rows: DataFrame, sector: str, height: str, amount: str, name: str) -> DataFrame:
    """Sectors with count, greatest height and the three leaders by height, then amount, then name."""
    w = Window.partitionBy(sector).orderBy(F.desc(height), F.desc(amount), name)
    x = rows.withColumn("__n", F.row_number().over(w))
    lead = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__n") <= 3, F.struct("__n", F.col(name).cast("string").alias("v"))))), lambda s: s["v"]), ",")
    return x.groupBy(sector).agg(F.count("*").alias("n"), F.max(height).alias("max_height"), lead.alias("leaders"))


def component_briers(samples: DataFrame) -> DataFrame:
    """component, n, brier over samples (component, prediction, outcome) with a prediction in [0, 1] and a settled outcome."""
    ok = samples.where(F.col("prediction").between(0, 1) & F.col("outcome").isin(0.0, 1.0))
    return ok.groupBy("component").agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("prediction") - F.col("outcome"), 2)), 6).alias("brier"))


def bounded_weights(briers: DataFrame, current: DataFrame, most: float = 0.15) -> DataFrame:
    """component, weight, suggested: towards the share of 1 - brier (0.05 at least), no weight moving by more than most. Components are few: one window over them."""
    w = Window.partitionBy(F.lit(0))
    x = current.join(briers, "component").withColumn("q", F.greatest(F.lit(0.05), 1 - F.col("brier")))
    x = x.withColumn("target", F.col("q") / F.sum("q").over(w)).withColumn("top", F.max(F.abs(F.col("target") - F.col("weight"))).over(w))
    step = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(most), F.col("top")), F.lit(1.0)))
    return x.select("component", "weight", F.round(F.col("weight") + step * (F.col("target") - F.col("weight")), 6).alias("suggested"))


def partial_fit(x: DataFrame, by: str, least: int = 6) -> DataFrame:
    """by, n, beta_benchmark, beta_issuer, sigma of t on b and i: both-regressor fit in closed form; singular fits are left out."""
    g = x.groupBy(by).agg(F.count("*").alias("n"), *[F.covar_pop(p, q).alias(p + q) for p, q in ("bb", "ii", "tt", "bi", "bt", "it")])
    vi = F.col("ii") - F.col("bi") * F.col("bi") / F.col("bb")
    g = g.where((F.col("n") >= least) & (F.col("bb") > 1e-24)).withColumn("vi", vi).where(F.col("vi") > F.greatest(F.lit(1e-24), F.col("ii") * 1e-10))
    bi = (F.col("it") - F.col("bi") * F.col("bt") / F.col("bb")) / F.col("vi")
    g = g.withColumn("beta_issuer", bi).withColumn("beta_benchmark", (F.col("bt") - F.col("beta_issuer") * F.col("bi")) / F.col("bb"))
    rss = F.col("n") * (F.col("tt") - F.col("beta_benchmark") * F.col("bt") - F.col("beta_issuer") * F.col("it"))
    return g.select(by, "n", "beta_benchmark", "beta_issuer", F.sqrt(F.greatest(rss, F.lit(0.0)) / (F.col("n") - 3)).alias("sigma"))


def lifecycles(journal: DataFrame) -> DataFrame:
    """One row for each open lot: exited quantity, exits, weighted return in percent, status. Exits take the oldest open lots; what is beyond them is unmatched."""
    lots = match_lots(journal)
    ret = 100 * ((F.col("close_cents") / F.col("close_q")) / (F.col("open_cents") / F.col("open_q")) - 1)
    x = lots.groupBy("symbol", "open_pos").agg(F.sum("quantity").alias("exit_quantity"), F.count("*").alias("exits"), F.sum(ret * F.col("quantity") / F.col("open_q")).alias("return_pct"))
    opens = journal.where("kind = 'open'").select("symbol", F.col("pos").alias("open_pos"), F.col("q").alias("entry_quantity"))
    y = opens.join(x, ["symbol", "open_pos"], "left").na.fill(0, ["exit_quantity", "exits"])
    status = F.when(F.col("exit_quantity") >= F.col("entry_quantity"), "closed").when(F.col("exit_quantity") > 0, "partial").otherwise("open")
    return y.withColumn("status", status).withColumn("outcome", F.when(F.col("status") == "closed", F.when(F.col("return_pct") > 0, "success").otherwise("failure")))


def drift_turnover(weights: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """by, turnover, buys, sells between old weights (weight, ret) drifted by their returns and new ones."""
    w = Window.partitionBy(by)
    grown = F.col("weight") * (1 + F.col("ret"))
    old = weights.withColumn("old", F.try_divide(grown, F.sum(grown).over(w))).select(by, "name", "old")
    x = old.join(new.select(by, "name", F.col("weight").alias("new")), [by, "name"], "full_outer")
    d = F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))
    return x.groupBy(by).agg(F.sum(F.abs(d)).alias("turnover"), F.sum(F.greatest(d, F.lit(0.0))).alias("buys"), F.sum(F.greatest(-d, F.lit(0.0))).alias("sells"))
