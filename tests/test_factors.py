"""Factor research: planted signal, boundaries, no look-ahead, row order."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import numeric as nm
from marlstone.operators import factors as fx


def panel(spark, days=40, names=12, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(names):
        close = 100.0
        for d in range(days):
            close *= 1 + rng.normal(0, 0.02)
            rows.append((s, (dt.date(2024, 1, 1) + dt.timedelta(days=d)).isoformat(), close, close * 1.01, close * 0.99, 1000.0 + s, 100.0 + d, 1.0 + s / 10))
    return spark.createDataFrame(rows, "symbol long, date string, close double, high double, low double, volume double, amount double, turnover_rate double")


def test_factor_values_by_hand(spark):
    p = panel(spark)
    rows = {(r.symbol, r.date): r for r in fx.factor_panel(p, list(fx.FACTORS), (1, 3)).collect()}
    bars = {}
    for r in p.orderBy("date").collect():
        bars.setdefault(r.symbol, []).append(r)
    b = bars[3]
    c = [x.close for x in b]
    for i in (5, 21, 30, 39):
        r = rows[3, b[i].date]
        assert r.rev_5 == pytest.approx(-(c[i] / c[i - 5] - 1))
        assert (r.mom_20_1 is None) == (i < 21)
        assert r.fwd_1 == (pytest.approx(c[i + 1] / c[i] - 1) if i < 39 else None)
        rets = [c[k] / c[k - 1] - 1 for k in range(i - 19, i + 1)] if i >= 20 else None
        assert r.vol_20 == (pytest.approx(np.std(rets, ddof=1)) if rets else None)
        assert r.range_pos_252 is None and r.turn_ratio_5_60 is None


def test_future_does_not_move_the_past(spark):
    p = panel(spark)
    names = ["mom_20_1", "rev_5", "vol_20", "amihud_20", "turn_20"]
    changed = p.withColumn("close", F.when(F.col("date") >= "2024-02-01", F.col("close") * 3).otherwise(F.col("close")))
    key = lambda d: {(r.symbol, r.date): tuple(r[n] for n in names) for r in fx.factor_panel(d, names).where("date < '2024-02-01'").collect()}
    assert key(p) == key(changed.repartition(5, "date"))


def test_missing_stays_missing(spark):
    d = spark.createDataFrame([(1, f"2024-01-0{i}", x) for i, x in enumerate([1.0, None, float("nan"), float("inf"), 0.0, 2.0], 1)], "symbol long, date string, close double")
    got = [r.f for r in d.select("date", fx.forward_return(1).alias("f")).orderBy("date").collect()]
    assert got == [None] * 6


def test_average_ranks_and_bins(spark):
    d = spark.createDataFrame([("d", i, float(x)) for i, x in enumerate([3, 1, 3, 2, 3, 9, 9])], "date string, symbol long, x double")
    got = {r.symbol: (r.r, r.b) for r in d.select("symbol", nm.average_rank(F.col("x"), ["date"]).alias("r"), nm.rank_bin(F.col("x"), F.col("symbol"), ["date"], 3).alias("b")).collect()}
    assert [got[i][0] for i in range(7)] == [4.0, 1.0, 4.0, 2.0, 4.0, 6.5, 6.5]
    assert [got[i][1] for i in (1, 3, 0, 2, 4, 5, 6)] == [0, 0, 0, 1, 1, 2, 2]  # place * 3 div 7


def sections(spark, signal=True):
    rng = np.random.default_rng(2)
    rows = []
    for d in range(30):
        f = rng.normal(size=20)
        y = f + 0.1 * rng.normal(size=20) if signal else rng.normal(size=20)
        rows += [(f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", s, float(f[s]), float(y[s])) for s in range(20)]
    return spark.createDataFrame(rows, "date string, symbol long, rev_5 double, fwd_1 double")


def test_planted_signal_is_found_and_noise_is_not(spark):
    of = lambda p: fx.verdict(fx.evaluate(p, ["rev_5"], 1, 30, least=5, min_dates=20)).first()
    v = of(sections(spark))
    assert v.mean_ic > 0.9 and v.alpha_t > 3.5 and v.state == "confirmed_alive"
    n = of(sections(spark, False))
    assert abs(n.mean_ic) < 0.2 and n.state == "noise"


def test_nulls_do_not_depend_on_partitions(spark):
    s = fx.long_sections(sections(spark), ["rev_5"], 1, 5).select("factor_name", "date", "symbol", "fr", "rr").cache()
    for null in (fx.shuffle_null, fx.circular_null):
        a = {r.trial: r.trial_ic for r in null(s, 5).collect()}
        b = {r.trial: r.trial_ic for r in null(s.repartition(7, "symbol"), 5).collect()}
        assert len(a) == 5 and all(a[k] == pytest.approx(b[k]) for k in a)


def test_thin_sections_go(spark):
    p = spark.createDataFrame([("d1", i, 1.0 * i, 1.0) for i in range(4)] + [("d2", i, 1.0 * i, 2.0 * i) for i in range(5)], "date string, symbol long, rev_5 double, fwd_1 double")
    assert {r.date for r in fx.long_sections(p, ["rev_5"], 1, 5).collect()} == {"d2"}
    ic = fx.rank_ic(fx.long_sections(p, ["rev_5"], 1, 4)).where("date = 'd1'").first()
    assert ic.ic is None  # constant returns


def test_preparation(spark):
    d = spark.createDataFrame([("d", i, float(x), 1.0 * i, "a" if i % 2 else None) for i, x in enumerate([1, 2, 3, 4, 1000])], "date string, symbol long, f double, size double, sector string")
    w = {r.symbol: r.f for r in fx.winsor(d, "f", "mad").collect()}
    assert w[4] == 3 + 5 * 1 and w[0] == 1
    z = [r.f for r in fx.standardise(d.withColumn("f", F.lit(7.0)), "f").collect()]
    assert z == [0.0] * 5
    r = [x.f for x in fx.neutralise(d, "f").collect()]
    assert abs(sum(r)) < 1e-9


def test_backtest_costs_and_last_price(spark):
    p = fx.factor_panel(panel(spark, 30, 10), ["rev_5"])
    x = fx.backtest(p, "rev_5", bins=2, every=5, shift=1, least=4).toPandas()
    first = x[x.epoch == 1]
    assert (first.turnover - 1.0).abs().max() < 1e-9 and (first.sell_turnover == 0).all()
    assert (x.cost - (x.turnover * 8 + x.sell_turnover * 5) / 1e4).abs().max() < 1e-12


def test_error_function(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 2.0, 3.5, 5.0]
    got = [r.e for r in spark.createDataFrame([(x,) for x in xs], "x double").select(nm.erfc(F.col("x")).alias("e")).collect()]
    assert all(abs(g - math.erfc(x)) < 2e-7 for g, x in zip(got, xs, strict=True))


def test_parse_number(spark):
    xs = ["1,234.5", "12%", "-", "", None, "NaN", " 7 ", "abc"]
    got = [r.v for r in spark.createDataFrame([(x,) for x in xs], "x string").select(nm.parse_number(F.col("x")).alias("v")).collect()]
    assert got == [1234.5, 12.0, None, None, None, None, 7.0, None]


def test_comparison_of_controls_and_its_summary(spark):
    from marlstone.operators import engine as en

    names = "factor_name string, horizon int, status string, random_ic_std double, random_ic_mean double, mean_ic double, alpha_t double, train_mean_ic double, train_alpha_t double, test_mean_ic double, test_alpha_t double"
    run = lambda rows: spark.createDataFrame([(n, h, s, std, 0.0, 0.1, a, 0.1, tr, 0.1, te) for n, h, s, std, a, tr, te in rows], names)
    shuffle = [("a", 1, "ok", 0.01, 6.0, 5.0, 4.0), ("b", 1, "ok", 0.01, 2.0, 2.0, 2.0), ("c", 1, "insufficient_data", 0.01, 2.0, 2.0, 2.0)]
    circular = [("a", 1, "ok", 0.02, 3.0, 2.5, 2.0), ("b", 1, "ok", 0.02, 1.9, 2.0, 2.0), ("c", 1, "ok", 0.02, 1.0, 1.0, 1.0)]
    x = en.compare_nulls(run(shuffle), run(circular), directions={"a": "+", "b": "+", "c": "+"})
    got = {r.factor_name: (r.comparable, r.shuffle_state, r.circular_state, r.wider, r.not_higher, r.state_changed, r.downgraded) for r in x.collect()}
    assert got == {"a": (True, "confirmed_alive", "noise", True, True, True, True), "b": (True, "noise", "noise", True, True, False, False), "c": (False, None, None, False, False, False, False)}
    s = en.comparison_summary(x).first()
    assert (s.pairs, s.comparable, s.state_changes, s.downgrades, s.invariants, s.falsified, s.supported, s.status) == (3, 2, 1, 1, True, False, True, "ok") and s.median_decrease == pytest.approx(1.55)
    # Without a change of state a median fall of under 0.3 speaks against the wider control.
    s = en.comparison_summary(x.where("factor_name = 'b'")).first()
    assert (s.falsified, s.supported, s.status) == (True, False, "ok")
    assert en.comparison_summary(x.where("factor_name = 'c'")).first().status == "insufficient_data"
    narrow = en.compare_nulls(run(circular), run(shuffle), directions={"a": "+", "b": "+", "c": "+"})
    assert en.comparison_summary(narrow).first().status == "failed_invariants"
    assert en.required_rows("rev_5", 4, 40) == 6 + 4 * 41 and en.required_rows("range_pos_252", 1, 40) == 844


def test_conditions_take_states_away_and_never_lift_them(spark):
    from marlstone.operators import engine as en

    rows = [("a", 1, b, s, d) for b, s, d in (("x", "ok", True), ("y", "ok", False))] + [("b", 1, "x", "ok", False), ("b", 1, "y", "ok", False), ("c", 1, "x", "unjudgeable", False), ("c", 1, "y", "insufficient_sample", False), ("d", 1, "x", "ok", False), ("d", 1, "y", "insufficient_sample", False)]
    v = spark.createDataFrame(rows, "factor string, horizon int, bin string, status string, degraded boolean")
    pairs = en.condition_pairs(v)
    assert {r.factor: r.pair_status for r in pairs.collect()} == {"a": "degradation_observed", "b": "no_degradation", "c": "pending_unjudgeable", "d": "pending_insufficient_sample"}
    family = lambda names, complete=True: en.condition_family(pairs.where(F.col("factor").isin(*names)), complete).first()
    assert (family("ab").dimension_status, family("ab").retained, family("ab").scanned) == ("retained_degradation_observed", True, 4)
    assert [family(n).dimension_status for n in ("b", "bc", "bd")] == ["rejected_no_degradation", "pending_unjudgeable", "pending_insufficient_sample"]
    assert family("ab", False).dimension_status == "pending_family_aggregation"
    states = ["confirmed_alive", "train_only", "noise", "reversed_strict", None]
    d = spark.createDataFrame([(g, p) for g in states for p in states], "g string, p string").withColumn("s", en.ceiling(F.col("g"), F.col("p")))
    for r in d.collect():
        want = None if r.g is None or r.p is None else r.g if r.g != "confirmed_alive" or r.p == "confirmed_alive" else "train_only"
        assert r.s == want
