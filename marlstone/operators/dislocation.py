"""Event dislocation: what a target has done since an event beyond what its benchmark and the issuer's own abnormal move explain, by a fit frozen before the event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Why a case has no result, and how one that has is classed.
NO_BASELINE, SHORT, NO_SESSION = "event:no_pre_event_baseline", "training:insufficient_pre_event_lookback", "event:no_post_event_closed_session"
NO_BENCHMARK, NO_ISSUER = "model:singular_benchmark_variance", "model:singular_issuer_after_benchmark"
BREAK, RESIDUAL, CANDIDATE, NONE = "model_inapplicable_regime_break", "statistical_residual_only", "relative_dislocation_candidate", "no_threshold_dislocation"

#: Sums from which both regressors' coefficients follow.
_PAIRS = ("bb", "ii", "tt", "bi", "bt", "it")


def _moments(part: Column, name: str) -> list[Column]:
    """n, means and population covariances of the returns b, i, t of the rows in part, as one struct."""
    v = {c: F.when(part, F.col(c)) for c in "bit"}
    return F.struct(F.count_if(part).alias("n"), *[F.avg(v[c]).alias(f"m{c}") for c in "bit"], *[F.covar_pop(v[p], v[q]).alias(p + q) for p, q in _PAIRS]).alias(name)


def _betas(m: Column) -> tuple[Column, Column]:
    """(on the benchmark, on the issuer): least squares with an intercept on both."""
    issuer = F.try_divide(m["it"] - F.try_divide(m["bi"] * m["bt"], m["bb"]), _own(m))
    return F.try_divide(m["bt"] - issuer * m["bi"], m["bb"]), issuer


def _own(m: Column) -> Column:
    """Variance of the issuer that the benchmark leaves."""
    return m["ii"] - F.try_divide(m["bi"] * m["bi"], m["bb"])


def dislocations(closes: DataFrame, events: DataFrame, lookback: int, most_sessions: int, least_z: float, most_shift: float | None = None) -> DataFrame:
    """One row for each event (case, published): columns gap to classification, as below.

    closes: case, date, target, issuer, benchmark closes on their common sessions (positive). The baseline is the last session up to
    published; the fit takes the `lookback` log returns that end there and nothing later. Since then (age sessions): abnormal is the
    target's move beyond its benchmark-only fit, issuer_abnormal the issuer's, spill_over the latter times the issuer's coefficient,
    extra what is left. block_*: sums of the training residuals over blocks of age sessions that do not overlap and end at the baseline,
    the oldest rest left out; z, of extra, needs three blocks that differ. shift_*: by how much the coefficients of the window's two
    halves differ. gap names what is missing; then all else is null.
    """
    by = Window.partitionBy("case")
    x = closes.join(events.select("case", "published"), "case").withColumns({c: F.log(n) for c, n in (("lb", "benchmark"), ("li", "issuer"), ("lt", "target"))})
    in_time = by.orderBy("date")
    x = x.withColumns({"pos": F.row_number().over(in_time), **{c: F.col(f"l{c}") - F.lag(f"l{c}").over(in_time) for c in "bit"}})
    x = x.withColumns({"base": F.count_if(F.col("date") <= F.col("published")).over(by), "last": F.count("*").over(by)})
    # Places in the window, from 0 at its oldest return; the baseline itself has the last.
    x = x.withColumns({"k": F.col("pos") - F.col("base") + lookback - 1, "age": F.col("last") - F.col("base")})
    train = (F.col("k") >= 0) & (F.col("k") < lookback) & F.col("t").isNotNull()
    half = lookback // 2
    at = lambda c, place: F.max(F.when(F.col("pos") == F.col(place), F.col(c)))
    g = x.groupBy("case").agg(F.first("base").alias("base"), F.first("age").alias("age"), _moments(train, "m"), _moments(train & (F.col("k") < half), "m1"), _moments(train & (F.col("k") >= half), "m2"), *[(at(f"l{c}", "last") - at(f"l{c}", "base")).alias(f"c{c}") for c in "bit"])
    m, n = F.col("m"), F.col("m.n")
    gap = (
        F.when(F.col("base") < 1, NO_BASELINE).when(F.col("base") - 1 < lookback, SHORT).when(F.col("age") < 1, NO_SESSION).when(n * m["bb"] <= 1e-24, NO_BENCHMARK)
        .when(n * _own(m) <= F.greatest(F.lit(1e-24), n * m["ii"] * 1e-10), NO_ISSUER)
    )
    beta_b, beta_i = _betas(m)
    g = g.withColumns({"gap": gap, "beta_benchmark": beta_b, "beta_issuer": beta_i})
    g = g.withColumns({"alpha": m["mt"] - F.col("beta_benchmark") * m["mb"] - F.col("beta_issuer") * m["mi"], "on_b": F.try_divide(m["bt"], m["bb"]), "issuer_on_b": F.try_divide(m["bi"], m["bb"])})
    abnormal = F.col("ct") - (m["mt"] - F.col("on_b") * m["mb"]) * F.col("age") - F.col("on_b") * F.col("cb")
    own = F.col("ci") - (m["mi"] - F.col("issuer_on_b") * m["mb"]) * F.col("age") - F.col("issuer_on_b") * F.col("cb")
    g = g.withColumns({"abnormal": abnormal, "issuer_abnormal": own, "spill_over": F.col("beta_issuer") * own, "extra": abnormal - F.col("beta_issuer") * own})
    for part in ("m1", "m2"):
        b, i = _betas(F.col(part))
        ok = (F.col(f"{part}.n") >= 6) & (F.col(f"{part}.n") * F.col(f"{part}.bb") > 1e-24) & (_own(F.col(part)) > 0)
        g = g.withColumns({f"b_{part}": F.when(ok, b), f"i_{part}": F.when(ok, i)})
    g = g.withColumns({"shift_benchmark": F.abs(F.col("b_m1") - F.col("b_m2")), "shift_issuer": F.abs(F.col("i_m1") - F.col("i_m2"))})
    # The training residuals, summed in blocks that end at the baseline.
    r = x.where(train).select("case", "k", "t", "b", "i").join(g.where("gap is null").select("case", "age", "alpha", "beta_benchmark", "beta_issuer"), "case")
    r = r.withColumns({"residual": F.col("t") - F.col("alpha") - F.col("beta_benchmark") * F.col("b") - F.col("beta_issuer") * F.col("i"), "block": F.floor((lookback - 1 - F.col("k")) / F.col("age"))})
    blocks = r.groupBy("case", "block").agg(F.first("age").alias("a"), F.sum("residual").alias("sum"), F.sum(F.col("residual") * F.col("residual")).alias("squares"))
    whole = F.when(F.col("block") < F.floor(lookback / F.col("a")), F.col("sum"))
    blocks = blocks.groupBy("case").agg(F.count(whole).alias("blocks"), F.avg(whole).alias("block_mean"), F.stddev_samp(whole).alias("block_sigma"), F.sqrt(F.sum("squares") / (lookback - 3)).alias("sigma"))
    z = F.when((F.col("blocks") >= 3) & (F.col("block_sigma") > 1e-12), (F.col("extra") - F.col("block_mean")) / F.col("block_sigma"))
    out = g.join(blocks, "case", "left").withColumn("z", z)
    broke = F.coalesce(F.greatest("shift_benchmark", "shift_issuer") > most_shift, F.lit(False)) if most_shift is not None else F.lit(False)
    kind = F.when(broke, BREAK).when((F.col("age") > most_sessions) | F.col("z").isNull(), RESIDUAL).when(F.abs("z") >= least_z, CANDIDATE).otherwise(NONE)
    out = out.withColumns({"side": F.when(F.col("extra") < 0, "laggard").when(F.col("extra") > 0, "rich").otherwise("at_model"), "dislocation_pct": 100 * F.expm1("extra"), "discarded": F.try_mod(F.lit(lookback).cast("long"), F.col("age")), "classification": kind})
    values = ("age", "beta_benchmark", "beta_issuer", "alpha", "sigma", "abnormal", "issuer_abnormal", "spill_over", "extra", "dislocation_pct", "side", "blocks", "discarded", "block_mean", "block_sigma", "z", "shift_benchmark", "shift_issuer", "classification")
    return events.select("case").join(out, "case", "left").select("case", F.when(F.col("base").isNull(), NO_BASELINE).otherwise(F.col("gap")).alias("gap"), *[F.when(F.col("gap").isNull() & F.col("base").isNotNull(), F.col(c)).alias(c) for c in values])
