"""Path studies, exact quantiles, skylines and event dislocations against loops and least squares."""

import math
import random
import statistics
from collections import defaultdict
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import dislocation as ds
from marlstone.operators import paths as pt
from marlstone.operators import quantiles as qt
from marlstone.operators import skyline as sk

LOOKBACK, H, UP, DOWN = 5, 3, 0.05, 0.04
EDGES = {"trailing_return": [-0.02, 0.03], "drawdown": [-0.05]}


def day(i):
    return (date(2023, 1, 1) + timedelta(days=i)).isoformat()


def walk(rng, n):
    close, out = 100.0, []
    for i in range(n):
        close *= math.exp(rng.gauss(0, 0.02))
        out.append((day(i), close, close * (1 + abs(rng.gauss(0, 0.01))), close * (1 - abs(rng.gauss(0, 0.01)))))
    return out


class Loop:
    """One symbol's study, bar by bar."""

    def __init__(self, rows):
        self.rows, self.last = rows, len(rows) - 1

    def state(self, i):
        if i < LOOKBACK:
            return None
        w = self.rows[i - LOOKBACK : i + 1]
        v = {"trailing_return": w[-1][1] / w[0][1] - 1, "drawdown": w[-1][1] / max(r[2] for r in w) - 1}
        return "-".join(str(sum(v[c] >= e for e in edges)) for c, edges in EDGES.items())

    def path(self, i):
        future, base = self.rows[i + 1 : i + H + 1], self.rows[i][1]
        target = max(r[2] for r in self.rows[max(0, i - LOOKBACK) : i + 1])
        first = lambda hit: next((j for j, r in enumerate(future, 1) if hit(r)), None)
        hits = {"up": first(lambda r: r[2] >= base * (1 + UP)), "down": first(lambda r: r[3] <= base * (1 - DOWN)), "recent_high": 0 if base >= target else first(lambda r: r[2] >= target)}
        return hits, future[-1][1] / base - 1 if len(future) == H else None, future

    def sample(self, cutoff, state, mature):
        out, last = [], -H - 1
        for i in range(LOOKBACK, cutoff):
            if i <= last + H or (state is not None and self.state(i) != state) or (mature and i + H > cutoff):
                continue
            out.append(i)
            last = i
        return out


def quantile(xs, q):
    xs = sorted(xs)
    pos = (len(xs) - 1) * q
    return xs[int(pos)] + (xs[min(int(pos) + 1, len(xs) - 1)] - xs[int(pos)]) * (pos - int(pos))


@pytest.fixture(scope="module")
def study(spark):
    rng = random.Random(3)
    bars = {s: walk(rng, n) for s, n in (("a", 160), ("b", 90), ("short", 4))}
    d = spark.createDataFrame([(s, *r) for s, rows in bars.items() for r in rows], "symbol string, date string, close double, high double, low double").repartition(5)
    return bars, pt.study_rows(d, LOOKBACK, H, UP, DOWN, EDGES)


def test_walk_forward_trains_on_matured_origins_alone(study):
    bars, rows = study
    got = defaultdict(dict)
    issued = pt.forecasts(rows, H, 0.3, 4)
    for r in issued.collect():
        got[r.symbol][r.i] = r
    assert set(got) == {"a", "b"}  # the third has no bar with a state
    for s in ("a", "b"):
        loop = Loop(bars[s])
        start = max(LOOKBACK, math.floor(loop.last * 0.3))
        assert sorted(got[s]) == list(range(start, loop.last + 1, H + 1))
        errors, covered = [], []
        for i, r in got[s].items():
            train, base = loop.sample(i, loop.state(i), True), loop.sample(i, None, True)
            assert (r.state, r.train_n, r.base_train_n) == (loop.state(i), len(train), len(base))
            assert r.status == (pt.ISSUED if min(len(train), len(base)) >= 4 else pt.FEW)
            hits, end, _ = loop.path(i)
            assert (r.up, r.down, r.recent_high) == tuple(hits.values()) and r.terminal == (pytest.approx(end) if end is not None else None)
            if r.status != pt.ISSUED:
                assert r.p_up is None and r.base_lo is None
                continue
            for sample, p in ((train, ""), (base, "base_")):
                paths = [loop.path(o) for o in sample]
                for e in pt.EVENTS:
                    assert r[f"{p}p_{e}"] == pytest.approx(statistics.mean(x[0][e] is not None for x in paths))
                assert (r[f"{p}lo"], r[f"{p}hi"]) == (pytest.approx(quantile([x[1] for x in paths], 0.05)), pytest.approx(quantile([x[1] for x in paths], 0.95)))
            if end is not None:
                errors.append((r.p_up - (hits["up"] is not None)) ** 2)
                covered.append(r.lo <= end <= r.hi)
        sc = next(x for x in pt.scores(issued, 10).collect() if x.symbol == s)
        assert (sc.scored, sc.brier_up, sc.coverage90) == (len(errors), pytest.approx(statistics.mean(errors)), pytest.approx(statistics.mean(covered)))
        assert sc.gate == ("sufficient_for_descriptive_scoring" if len(errors) >= 10 else "insufficient")
    assert sum(r.status == pt.FEW for x in got.values() for r in x.values()) > 0


def test_later_bars_change_no_earlier_forecast(spark, study):
    bars, rows = study
    cut = spark.createDataFrame([("a", *r) for r in bars["a"][:100]], "symbol string, date string, close double, high double, low double")
    # The same place of the first forecast: a share of the shorter series.
    names = ("state", "train_n", "base_train_n", "p_up", "base_p_down", "lo", "base_hi")
    of = lambda x, start: {r.i: tuple(r[c] for c in names) for r in pt.forecasts(x, H, start, 4).where("symbol = 'a'").collect()}
    early, late = of(pt.study_rows(cut, LOOKBACK, H, UP, DOWN, EDGES), 40 / 99), of(rows, 40 / 159)
    assert early and all(late[i] == x for i, x in early.items())


def test_cone_of_matched_paths(study):
    bars, rows = study
    q = {"low": 0.1, "mid": 0.5, "high": 0.9}
    for by in (["symbol"], []):
        points, origins = defaultdict(list), defaultdict(int)
        for s in ("a", "b"):
            loop = Loop(bars[s])
            for o in loop.sample(loop.last, loop.state(loop.last), False):
                origins[s if by else ""] += 1
                for step, r in enumerate(loop.path(o)[2], 1):
                    for kind, v in (("close", r[1]), ("high", r[2]), ("low", r[3])):
                        points[s if by else "", step, kind].append(v / loop.rows[o][1] - 1)
        got = {(r.symbol if by else "", r.step, r.kind): r for r in pt.cone(rows, by, H, q).collect()}
        assert set(got) == set(points)
        for k, v in points.items():
            assert (got[k].n, got[k].censored_n) == (len(v), origins[k[0]] - len(v))
            assert [got[k][c] for c in q] == pytest.approx([quantile(v, p) for p in q.values()])


@pytest.mark.parametrize("sorted_rows", [1, 30, 20_000])
def test_exact_quantiles_by_refinement(spark, monkeypatch, sorted_rows):
    monkeypatch.setattr(qt, "BUCKETS", 8)
    rng = np.random.default_rng(4)
    groups = {"normal": rng.normal(size=501).tolist(), "heavy": (rng.pareto(0.5, size=300) * 1e6).tolist(), "ties": [1.0] * 200 + [2.0] * 3, "one": [5.0], "wide": [-1e308, 1e308, 0.0, 1e-300], "none": [None, float("nan")]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(3)
    p = {"q0": 0.0, "q05": 0.05, "q50": 0.5, "q99": 0.99, "q1": 1.0}
    got = {r.g: r for r in qt.exact_quantiles(d, ["g"], "v", p, sorted_rows).collect()}
    assert set(got) == set(groups) - {"none"}
    for g in got:
        v = sorted(groups[g])
        for name, q in p.items():
            pos = (len(v) - 1) * q
            lo, hi = v[math.floor(pos)], v[math.ceil(pos)]
            assert got[g][name] == pytest.approx(lo + (hi - lo) * (pos - math.floor(pos)), rel=1e-12), (g, name)


def test_dislocation_is_frozen_before_its_event(spark):
    rng = np.random.default_rng(6)
    n, lookback, age = 60, 40, 6
    b, i = 0.01 * rng.normal(size=n), 0.02 * rng.normal(size=n)
    t = 0.001 + 1.2 * b + 0.5 * i + 0.004 * rng.normal(size=n)
    i[-age:] += 0.03
    t[-3] += 0.20
    price = {c: (100 * np.exp(np.concatenate([[0.0], np.cumsum(x)]))).tolist() for c, x in (("b", b), ("i", i), ("t", t))}
    rows = [("x", day(k), price["t"][k], price["i"][k], price["b"][k]) for k in range(n + 1)]
    rows += [("late", *r[1:]) for r in rows] + [("early", *r[1:]) for r in rows[: n + 1]] + [("short", *r[1:]) for r in rows[: n + 1]] + [("flat", r[1], r[2], r[3], 50.0) for r in rows[: n + 1]] + [("twin", r[1], r[2], r[4] * 3, r[4]) for r in rows[: n + 1]] + [("blocks", *r[1:]) for r in rows[: n + 1]]
    events = [("x", day(n - age)), ("late", day(n)), ("early", "2000-01-01"), ("short", day(20)), ("flat", day(n - age)), ("twin", day(n - age)), ("blocks", day(n - 15)), ("nowhere", day(5))]
    c = spark.createDataFrame(rows, "case string, date string, target double, issuer double, benchmark double").repartition(4)
    e = spark.createDataFrame(events, "case string, published string")
    got = {r.case: r for r in ds.dislocations(c, e, lookback, 10, 2.0, 5.0).collect()}
    assert {k: r.gap for k, r in got.items()} == {"x": None, "late": ds.NO_SESSION, "early": ds.NO_BASELINE, "short": ds.SHORT, "flat": ds.NO_BENCHMARK, "twin": ds.NO_ISSUER, "blocks": None, "nowhere": ds.NO_BASELINE}
    assert got["late"].extra is None and got["flat"].classification is None
    base = n - age
    tb, ti, tt = b[base - lookback : base], i[base - lookback : base], t[base - lookback : base]
    fit = np.linalg.lstsq(np.column_stack([np.ones(lookback), tb, ti]), tt, rcond=None)[0]
    own, only = (np.linalg.lstsq(np.column_stack([np.ones(lookback), tb]), y, rcond=None)[0] for y in (ti, tt))
    residual = tt - fit[0] - fit[1] * tb - fit[2] * ti
    cb, ci, ct = (x[base:].sum() for x in (b, i, t))
    abnormal, issuer = ct - only[0] * age - only[1] * cb, ci - own[0] * age - own[1] * cb
    extra = abnormal - fit[2] * issuer
    blocks = [residual[lookback - (j + 1) * age : lookback - j * age].sum() for j in range(lookback // age)]
    x = got["x"]
    assert (x.age, x.blocks, x.discarded, x.side) == (age, len(blocks), lookback % age, "rich")
    for name, want in (("alpha", fit[0]), ("beta_benchmark", fit[1]), ("beta_issuer", fit[2]), ("sigma", math.sqrt((residual**2).sum() / (lookback - 3))), ("abnormal", abnormal), ("issuer_abnormal", issuer), ("spill_over", fit[2] * issuer), ("extra", extra), ("block_mean", np.mean(blocks)), ("block_sigma", statistics.stdev(blocks)), ("z", (extra - np.mean(blocks)) / statistics.stdev(blocks)), ("dislocation_pct", 100 * math.expm1(extra))):
        assert x[name] == pytest.approx(want, rel=1e-6), name
    halves = [np.linalg.lstsq(np.column_stack([np.ones(20), tb[k], ti[k]]), tt[k], rcond=None)[0] for k in (slice(0, 20), slice(20, 40))]
    assert (x.shift_benchmark, x.shift_issuer) == (pytest.approx(abs(halves[0][1] - halves[1][1]), rel=1e-6), pytest.approx(abs(halves[0][2] - halves[1][2]), rel=1e-6))
    assert x.classification == ds.CANDIDATE and x.z > 2
    # Two blocks of fifteen sessions are too few for a scale; an age over the rule's is no candidate.
    assert (got["blocks"].blocks, got["blocks"].z, got["blocks"].classification) == (2, None, ds.RESIDUAL)
    assert ds.dislocations(c, e, lookback, 10, 2.0, 0.0).where("case = 'x'").first().classification == ds.BREAK
    # What comes after the baseline changes no coefficient.
    later = c.withColumn("target", F.when(F.col("date") > day(base), F.col("target") * 3).otherwise(F.col("target")))
    assert ds.dislocations(later, e, lookback, 10, 2.0).where("case = 'x'").first().beta_issuer == pytest.approx(x.beta_issuer)


@pytest.mark.parametrize("strong", [1000, 3])
def test_skyline_of_any_front(spark, monkeypatch, strong):
    monkeypatch.setattr(sk, "STRONG", strong)
    rng = np.random.default_rng(8)
    x = rng.random((300, 3))
    x[:150, 2] = 2 - x[:150, 0] - x[:150, 1]  # a plane: no point of it dominates another
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(x)]
    rows += [(1000 + i, *rows[i][1:]) for i in range(5)] + [(2000, None, 0.0, 0.0), (2001, float("nan"), 0.0, 9.0)]
    d = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(4)
    ok = [r for r in rows if r[1] is not None and not math.isnan(r[1])]
    beats = lambda p, q: p[1] <= q[1] and p[2] <= q[2] and p[3] >= q[3] and p[1:] != q[1:]
    want = sorted(r[0] for r in ok if not any(beats(p, r) for p in ok))
    out = sk.skyline(d, ["a", "b"], ["c"])
    assert sorted(r.id for r in out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sk.skyline(d.where("id < 0"), ["a"], []).count() == 0


def test_front_in_tiles():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 6, (900, 3)).astype(float)
    got = {tuple(p) for p in sk.front(x)}
    assert got == {tuple(p) for p in x if not any((q <= p).all() and (q < p).any() for q in x)}
