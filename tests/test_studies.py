"""Lots with fractions, lifecycles as a fold and on a stream, pair graphs, evaluation gates, detectors, store, filings, universes: against loops, numpy and by hand."""

import random
import shutil
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import checkpoints as ck
from marlstone.operators import evidence as ev
from marlstone.operators import factors as fx
from marlstone.operators import ledger as lg
from marlstone.operators import lifecycles as lc
from marlstone.operators import market as mk
from marlstone.operators import signals as sg
from marlstone.sources import filings as fl
from marlstone.sources import scans as sc
from marlstone.sources import store
from marlstone.sources.shared import few
from marlstone.streaming import detectors, streams

ROOT = Path(__file__).resolve().parents[1]


def test_lots_with_fractions_and_large_ones(spark):
    rows = [("a", 1, "open", 63.5), ("a", 2, "open", 1.0), ("a", 3, "open", 5.0), ("a", 4, "close", 64.2), ("a", 5, "close", 1.8), ("b", 1, "open", 1e9), ("b", 2, "close", 2.5e8), ("b", 3, "open", 0.0), ("b", 4, "close", 1e12), ("b", 5, "open", 3.0), ("c", 1, "close", 2.0)]
    d = spark.createDataFrame([(s, p, k, q, 100) for s, p, k, q in rows], "symbol string, pos int, kind string, q double, cents long")
    got = sorted((r.symbol, r.open_pos, r.close_pos, r.quantity) for r in lg.match_lots(d).collect())
    assert got == [("a", 1, 4, 63.5), ("a", 2, 4, 0.7), ("a", 2, 5, 0.3), ("a", 3, 5, 1.5), ("b", 1, 2, 2.5e8), ("b", 1, 4, 7.5e8)]
    assert lg.match_lots(d.where("pos < 0")).count() == 0


def loop(rows):
    """The lifecycles of one symbol's rows (ts, seq, status, side, quantity, r), one after the other."""
    lots, unmatched = [], 0
    for ts, seq, status, side, q, r in sorted(rows, key=lambda x: (x[0], x[1])):
        status, side = status.lower(), (side or "").lower()
        alive = [x for x in lots if x["status"] in ("open", "partial")]
        if status in ("open", "filled_open") and side in ("buy", "long", "open"):
            lots.append({"seq": seq, "q": q, "left": q, "r": 0.0, "n": 0, "status": "open"})
        elif status == "closed_unreconciled":
            if alive:
                alive[0]["status"] = "closed_unreconciled"
            else:
                unmatched += 1
        elif status in ("partial_closed", "closed", "completed") and side in ("sell", "short", "reduce", "exit"):
            if not alive:
                unmatched += 1
            wanted = q
            for x in alive:
                part = min(wanted, x["left"]) if wanted > 0 and x["left"] > 0 else x["left"]
                final = status != "partial_closed" and (wanted <= x["left"] or len(alive) == 1)
                x["r"] += (r or 0.0) * (part / x["q"] if x["q"] else float(final))
                x["left"], x["n"] = round(x["left"] - part, 8), x["n"] + 1
                x["status"] = "closed" if final or x["left"] <= 1e-9 else "partial"
                wanted = max(wanted - part, 0.0)
                if wanted <= 1e-9:
                    break
    return lots, unmatched


def orders(seed):
    rng = random.Random(seed)
    t0, rows = datetime(2024, 1, 1), []
    for s in ("x", "y", "z"):
        for i in range(120):
            status = rng.choice(["open", "Filled_Open", "partial_closed", "partial_closed", "closed", "closed_unreconciled", "noise"])
            side = {"open": "buy", "Filled_Open": "LONG", "closed_unreconciled": None}.get(status, rng.choice(["sell", "Exit"]))
            rows.append((s, i, t0 + timedelta(hours=rng.randint(0, 60)), f"{s}{i}", None, status, side, float(rng.choice([0, 1, 2.5, 3, 10])), rng.choice([None, 0.5, -1.0]), None))
    return rows


SCHEMA = "symbol string, seq long, ts timestamp, order_id string, lifecycle string, status string, side string, quantity double, r double, ret double"


@pytest.mark.parametrize("seed", range(3))
def test_lifecycles_equal_a_loop(spark, seed):
    rows = orders(seed)
    changes = lc.lifecycles(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    last = {}
    for x in sorted((x for x in changes if x.lifecycle), key=lambda x: x.exits):
        last[x.symbol, x.lifecycle] = x
    for s in ("x", "y", "z"):
        want, unmatched = loop([(r[2], r[1], r[5], r[6], r[7], r[8]) for r in rows if r[0] == s])
        assert sum(x.symbol == s and x.status == "unmatched" for x in changes) == unmatched
        for w in want:
            got = last[s, f"{s}:{s}{w['seq']}"]
            assert got.status == w["status"] and (w["status"] == "closed_unreconciled" or got.exits == w["n"])
            if w["status"] == "closed" and got.r is not None:
                assert got.r == pytest.approx(round(w["r"], 4)) and got.outcome == ("success" if got.r > 0 else "failure")


def test_stream_of_orders_gives_the_same_lots(spark):
    rows = [r for r in orders(7) if r[5] != "noise"]
    d = spark.createDataFrame([(*r[:2], datetime(2024, 1, 1) + timedelta(hours=r[1]), *r[3:]) for r in rows], SCHEMA)
    batch = {(r.symbol, r.lifecycle): (r.status, r.exits, r.exited) for r in lc.latest(lc.lifecycles(d)).collect()}
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, detectors.ROCKS)
    try:
        x = lc.latest(streams.drain(lc.stream_lifecycles(streams.as_stream(spark, d, "test-orders")), "test-lots")).collect()
    finally:
        spark.conf.set(name, before)
    assert {(r.symbol, r.lifecycle): (r.status, r.exits, r.exited) for r in x} == batch


def test_voids_and_heals(spark):
    t = datetime(2024, 1, 1)
    rows = [("1", "open", None, None, t), ("2", "open", None, None, t), ("3", "reconciliation_void", "1", None, t), ("4", "reconciliation_not_filled", "2", None, t), ("2", "filled_open", None, True, t + timedelta(days=9)), ("2", "open", None, None, t)]
    d = spark.createDataFrame(rows, "order_id string, status string, voids_order_id string, fill_confirmed boolean, ts timestamp")
    assert sorted((r.order_id, r.status) for r in lc.live_orders(d).collect()) == [("2", "filled_open"), ("2", "open"), ("3", "reconciliation_void"), ("4", "reconciliation_not_filled")]


def test_pair_graph_equals_numpy(spark):
    rng = np.random.default_rng(0)
    n, t = 70, 160  # more than one block of symbols
    y = rng.normal(size=(n, t))
    y[rng.random((n, t)) < 0.2] = np.nan
    y[5] = np.nan
    y[5, :10] = 1.0  # constant and short
    rows = [(s, f"{d:04d}", float(y[s, d])) for s in range(n) for d in range(t) if not np.isnan(y[s, d])]
    got = {(r.a, r.b): r for r in mk.pair_graph(spark.createDataFrame(rows, "symbol long, date string, y double"), 30, 90).collect()}
    assert len(got) == n * (n - 1)
    for a, b in [(0, 1), (1, 0), (3, 69), (69, 3), (64, 65), (5, 6), (6, 5)]:
        both = np.flatnonzero(~np.isnan(y[a]) & ~np.isnan(y[b]))
        r = got[a, b]
        assert (r.aligned, r.n_obs, r.gap) == (len(both), min(90, len(both)), len(both) < 80)
        for k, beta in ((30, r.beta_30), (90, r.beta_90)):
            p, q = y[a][both[-k:]], y[b][both[-k:]]
            want = None if q.var() == 0 else ((p - p.mean()) * (q - q.mean())).mean() / q.var()
            assert beta == (None if want is None else pytest.approx(want))
    assert mk.pair_graph(spark.createDataFrame([], "symbol long, date string, y double")).count() == 0


def test_evaluation_fails_closed(spark):
    rng = np.random.default_rng(3)
    rows = [(f"{d:03d}", s, float(rng.normal()), float(rng.normal()), s % 3 > 0) for d in range(20) for s in range(12)]
    p = spark.createDataFrame(rows, "date string, symbol long, rev_5 double, fwd_1 double, null_eligible boolean")
    of = lambda x, **k: fx.evaluate(x, ["rev_5"], 1, 5, **{"least": 6, "min_dates": 10, **k}).first()
    clean = p.drop("null_eligible")
    assert (of(clean).status, of(clean).gaps) == ("ok", []) and of(clean).effective_sections == 20
    assert of(clean, min_dates=21).gaps == ["insufficient_effective_sections"] and of(clean, min_dates=21).mean_ic is None
    thin = clean.where("symbol < 5 or date > '008'")
    assert of(thin).gaps == ["excessive_cross_section_exclusions"] and of(thin).excluded_dates == 9
    assert (of(p).status, of(p).gaps) == ("ok", ["cross_source_panel_excluded_from_null"])
    assert of(p, least=9).gaps == ["insufficient_null_cross_section", "cross_source_panel_excluded_from_null"]
    short = clean.where("symbol < 9 or date = '000'")
    r = of(short, null="circular")
    assert r.status == "ok" or "circular_series_too_short" in r.gaps
    assert of(short, null="circular", least=10, min_dates=1, share=0.5).gaps != []
    assert of(clean, stride=2).effective_sections == 10
    for bad in ({"trials": 1}, {"least": 1}, {"min_dates": 0}, {"stride": 0}, {"share": 1.0}, {"null": "none"}):
        with pytest.raises(ValueError):
            fx.evaluate(clean, ["rev_5"], **bad)


def test_factors_need_their_history(spark):
    rng = np.random.default_rng(4)
    rows = [(1, f"{i:04d}", float(c), float(c) + 1, float(c) - 1, 1000.0, 100.0 + i, 1.0 + i % 3) for i, c in enumerate(100 + np.cumsum(rng.normal(size=300)))]
    p = spark.createDataFrame(rows, "symbol long, date string, close double, high double, low double, volume double, amount double, turnover_rate double")
    got = {r.factor_name: r.first_row for r in fx.first_rows(fx.factor_panel(p, list(fx.FACTORS)), list(fx.FACTORS)).collect()}
    assert got == fx.HISTORY


def test_shuffle_null_equals_a_loop(spark):
    import hashlib

    rng = np.random.default_rng(5)
    rows = [("f", d, s, float(s + 1), float(rng.permutation(8)[s] + 1)) for d in ("d1", "d2") for s in range(8)]
    got = {r.trial: r.trial_ic for r in fx.shuffle_null(spark.createDataFrame(rows, "factor_name string, date string, symbol long, fr double, rr double"), 4, 7).collect()}
    for t in range(4):
        ics = []
        for d in ("d1", "d2"):
            own = sorted((r for r in rows if r[1] == d), key=lambda r: (hashlib.md5(f"{t}|{d}|{r[2]}|7".encode()).hexdigest(), r[2]))
            ics.append(np.corrcoef(sorted(r[3] for r in own), [r[4] for r in own])[0, 1])
        assert got[t] == pytest.approx(np.mean(ics))


def test_verdict_of_research_factors_is_never_reversed(spark):
    d = spark.createDataFrame([("rev_5", -5.0, 0.0, -5.0, -5.0, -0.1, -0.1, -0.1), ("amihud_20", -5.0, 0.0, -5.0, -5.0, -0.1, -0.1, -0.1), ("vol_20", -5.0, 0.0, -5.0, -5.0, -0.1, -0.1, -0.1), ("rev_5", 5.0, None, 5.0, 5.0, 0.1, 0.1, 0.1)], "factor_name string, alpha_t double, random_ic_mean double, train_alpha_t double, test_alpha_t double, mean_ic double, train_mean_ic double, test_mean_ic double")
    assert [r.state for r in fx.verdict(d).collect()] == ["reversed_strict", "noise", "confirmed_alive", None]


def test_backtest_settles_at_the_last_price_of_the_holding(spark):
    days = [f"2024-01-{i:02d}" for i in range(1, 13)]
    rows = [(s, d, 100.0 + s + i, float(s)) for s in range(4) for i, d in enumerate(days) if not (s == 3 and 3 <= i <= 7)]
    p = spark.createDataFrame(rows, "symbol long, date string, close double, f double")
    x = fx.backtest(p, "f", bins=2, every=5, shift=1, least=2, fee_bps=0, slip_bps=0, stamp_bps=0).orderBy("epoch", "bin").collect()
    # Entry on the second day, exit on the seventh: symbol 3 was last priced on the third.
    top = ((102.0 + 6) / (102.0 + 1) - 1 + (103.0 + 2) / (103.0 + 1) - 1) / 2
    assert x[1].bin == 2 and x[1].gross_return == pytest.approx(top)


def test_wall_breaker_by_hand(spark):
    book = [("s", "d", i, ticks, cum) for i, (ticks, cum) in enumerate([(100, 0), (100, 10), (100, 20), (101, 520), (102, 1020), (103, 1200)])]
    walls = {2: 1000, 3: 600, 4: 100}
    asks = [("s", "d", i, 102, walls.get(i, 0)) for i in range(6)] + [("s", "d", i, 110, 10) for i in range(6)]
    b = spark.createDataFrame(book, "symbol string, session_id string, snap int, ticks long, cumulative_volume long")
    a = spark.createDataFrame(asks, "symbol string, session_id string, snap int, ticks long, volume long")
    got = mk.wall_breaker(b, a, lookback=2, factor=2.0, least_volume=500.0, steps=2, most=4, removed=0.8, executed=0.5).collect()
    assert [(r.snap, round(r.strength, 6)) for r in got] == [(5, 1.0)]
    assert mk.wall_breaker(b, a, lookback=2, factor=2.0, least_volume=700.0, steps=2, most=2, removed=0.8, executed=0.5).count() == 0
    with pytest.raises(ValueError):
        mk.wall_breaker(b, a, steps=9, most=2)


def test_detector_parameters_and_contract(spark):
    assert mk.checked_parameters("ignition", lookback=3) == {"lookback": 3}
    for name, given in (("none", {}), ("ignition", {"other": 1}), ("ignition", {"lookback": 0}), ("ignition", {"lookback": 1.5}), ("ignition", {"least": True}), ("imbalance", {"ratio": "3"})):
        with pytest.raises(ValueError):
            mk.checked_parameters(name, **given)
    d = spark.createDataFrame([(True, 2.0, "tick", ["a"]), (True, float("nan"), "tick", []), (False, 0.5, None, None)], "f boolean, s double, i string, r array<string>")
    c = [F.col(x) for x in "fsir"]
    got = d.select(mk.detector_output(*c).alias("o"), mk.output_errors(*c).alias("e")).collect()
    assert [x.e for x in got] == [["strength_out_of_range"], ["strength_not_finite", "fired_without_evidence"], ["invalid_input_fidelity"]]
    assert [x.o.strength for x in got] == [1.0, None, 0.5]


def test_expiry_geometry_of_a_spread(spark):
    legs = spark.createDataFrame([("u", "C", 100.0, 1.0, 5.0), ("u", "C", 110.0, -1.0, 2.0), ("p", "P", 50.0, 2.0, 3.0)], "underlying string, side string, strike double, qty double, cost double")
    got = {r.underlying: r for r in mk.expiry_geometry(legs, "underlying").collect()}
    assert (got["u"].low, got["u"].high, got["u"].break_evens, got["u"].first_break_even) == (-3.0, 7.0, 1, 103.0)
    assert (got["p"].low, got["p"].high, got["p"].first_break_even) == (-6.0, 94.0, 47.0)


def test_put_and_call_values_keep_parity(spark):
    v = spark.range(1).select(*[mk.option_value(F.lit(s), F.lit(95.0), F.lit(100.0), F.lit(0.5), F.lit(0.3), 0.04).alias(s) for s in "CP"]).first()
    assert v.C - v.P == pytest.approx(95.0 - 100.0 * np.exp(-0.02), abs=1e-4)


def test_betas_fall_back(spark):
    rng = np.random.default_rng(2)
    n = {"long": 120, "short": 60, "few": 10}
    rows = [(s, f"{i:03d}", float(v), float(v)) for s, k in n.items() for i, v in enumerate(rng.normal(size=k))]
    got = {r.symbol: r for r in mk.beta_lookup(spark.createDataFrame([(s,) for s in [*n, "none"]], "symbol string"), spark.createDataFrame(rows, "symbol string, date string, y double, x double")).collect()}
    assert {s: r.source for s, r in got.items()} == {"long": "beta_120", "short": "beta_60", "few": "benchmark_fallback", "none": "benchmark_fallback"}
    assert got["long"].beta == pytest.approx(1.0) and got["none"].beta == 1.0


def test_overlay_only_tightens(spark):
    from marlstone.sources.bindings import CHECKPOINT

    x = spark.range(2000).select(F.col("id").alias("k")).select("k", *[F.expr(e).alias(c) for c, e in CHECKPOINT.items()])
    out = ck.overlay(ck.continuity(ck.execution_quality(ck.exposure_zone(x))))
    up = ck.cap_no(F.col("action_cap"))
    assert out.where(ck.cap_no(F.col("final_cap")) > up).count() == 0
    assert out.select("verdict").distinct().count() >= 7 and out.select("execution_status").distinct().count() == 3 and out.select("zone").distinct().count() == 5
    none = x.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in x.dtypes])
    r = ck.overlay(ck.continuity(ck.execution_quality(ck.exposure_zone(none)))).first()
    assert (r.zone, r.execution_status, r.continuity_status, r.final_cap) == ("unavailable", "no_trade", "data_gap", "L0")


def test_blockers_in_their_order(spark):
    rows = [(False, True, True, ["account"], "TEST", 1.0, True), (True, True, True, ["account"], "TEST", 1.0, True), (True, False, True, ["account"], "TEST", 1.0, True), (True, False, True, ["macro"], "TEST", 1.0, True), (True, False, False, [], "TEST", 1.0, True), (True, False, False, [], "TEST", None, True), (True, False, False, [], "HOLD", 1.0, True), (True, False, False, [], "ADD", 0.0, False)]
    d = spark.createDataFrame(rows, "contract_ok boolean, epistemic_veto boolean, hard_veto boolean, veto_modules array<string>, permission string, multiplier double, unresolved boolean")
    assert [r.b for r in d.select(ck.blocker(d).alias("b")).collect()] == ["contract_gap", "data_gap", "portfolio_or_permission", "market_risk", "ready", "contract_gap", "unresolved_conflict", "no_edge_or_non_open_intent"]


def test_sensitive_keys_at_any_depth(spark):
    payloads = {'{"a": {"API_Key": 1}}': True, '[{"b": [{"sessionToken": 1}]}]': True, '{"token": 1}': True, '{"tokens": 1, "token_address": 2}': False, '{"note": "my \\"password\\": x"}': False, '{"note": "password"}': False, '{"x-ok-access-sign": 1}': True, None: False, "": False, '{"\\u0061pi_key": 1}': True, '{"a": {"ａｐｉ＿ｋｅｙ": 1}}': True, '{"ｎｏｔｅ": 1}': False, '{"пароль": 1}': True, '{"größe": 1}': True, '{"note": "größe"}': False, '{"bad\\x": 1}': True, '{"n\\u006fte": 2}': False}
    d = spark.createDataFrame([(p,) for p in payloads], "p string")
    assert [r.s for r in d.select(ev.has_sensitive_key(F.col("p")).alias("s")).collect()] == list(payloads.values())


def test_tracking_keys_and_secrets(spark):
    d = spark.createDataFrame([("http://a.com/?mc_cid=1&utm_a=2&b=3&mc_EID=4",)], "u string")
    assert d.select(tx.canonical_url(F.col("u"))).first()[0] == "http://a.com/?b=3"
    t = spark.createDataFrame([("at /Home/Me/x\nfine", "API-KEY : a;b, access_token=c, Authorization: BEARER  x~y+z/== tail, my secret: $1 \\ end")], "a string, b string").select(tx.redact_lines(F.col("a"), "/home/me").alias("a"), tx.scrub(F.col("b")).alias("b")).first()
    assert t.a == "[redacted]\nfine"
    cases = {
        "password = x": "password = <redacted>", "password =x y": "password =<redacted> y", "password=a:b c": "password=<redacted> c", "url=http://h?api_key=k&z": "url=http://h?api_key=<redacted>", "PASS-PHRASE:\n v, w": "PASS-PHRASE:\n <redacted>, w",
        "secret, = x": "secret, = x", "secret:": "secret:", "the secret is safe": "the secret is safe", "bearer of news, bearer": "bearer <redacted> news, bearer", "xbearer abc": "xbearer abc", "": "", "password:,x": "password:,x", "my_access_token=1;2": "my_access_token=<redacted>;2",
    }
    got = spark.createDataFrame([(c,) for c in cases] + [("word password: x, " * 20_000,), (None,)], "t string").select(tx.scrub(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == [*cases.values(), "word password: <redacted>, " * 20_000, None]
    html = """<a href="a.html">x</a><A HREF = 'b.html' >y</A><a href=c.html>z</a><a href=""></a><p data-href=no></p><item><link>http://d/1</link></item><link><![CDATA[ http://d/2 ]]></link>"""
    assert spark.createDataFrame([(html,)], "h string").select(tx.links(F.col("h"))).first()[0] == ["a.html", "b.html", "c.html", "http://d/1", "http://d/2"]
    assert t.b == "API-KEY : <redacted>;b, access_token=<redacted>, Authorization: BEARER  <redacted> tail, my secret: <redacted> \\ end"


def test_universe_lists(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# c\naapl x\n\n msft\nAAPL\n")
    (tmp_path / "p.json").write_text('{"universe_core": ["Msft", "tsla", ""], "universe_probation": {"symbols": ["x", {"symbol": "y"}, {"other": 1}]}}')
    got = sc.universe(spark, [str(tmp_path / "l.txt"), str(tmp_path / "p.json")]).orderBy("place").collect()
    assert [(r.symbol, r.layer) for r in got] == [("AAPL", "list"), ("MSFT", "list"), ("TSLA", "core"), ("X", "probation"), ("Y", "probation")]
    with pytest.raises(ValueError):
        sc.universe(spark, [str(tmp_path / "l.txt")], most=1)
    (tmp_path / "e.txt").write_text("# only\n")
    with pytest.raises(ValueError):
        sc.universe(spark, [str(tmp_path / "e.txt")])


def test_store_checks_and_merges(spark, tmp_path):
    rows = spark.createDataFrame([("1", "long", "L1", "0.5", -1.0), (None, "up", "L9", "x", None), ("2", "sell", "L0", None, 3.0)], "decision_id string, direction string, action_level string, predicted string, entry_price double")
    good, bad = store.validated(rows, "decisions")
    assert [r.decision_id for r in good.collect()] == ["2"] and {tuple(r.errors) for r in bad.collect()} == {("price_not_positive",), ("decision_id_missing", "direction_unknown", "level_unknown")}
    for name in store.TABLES:
        assert store.shaped(spark.range(1), name).count() == 1 and store.validated(spark.range(1), name)[1].count() == 1
    t = lambda d: datetime(2024, 1, d)
    s = "name string, value string, updated_at timestamp"
    a = store.merged(None, spark.createDataFrame([("a", "1", t(1)), ("a", "2", t(3)), ("b", "1", None)], s), "state")
    b = store.merged(a, spark.createDataFrame([("a", "3", t(3)), ("b", "2", None), ("c", "1", t(1))], s), "state")
    assert sorted((r.name, r.value) for r in b.collect()) == [("a", "3"), ("b", "2"), ("c", "1")]
    assert store.run_id({"a": 1, "b": 2}) == store.run_id({"b": 2, "a": 1}) != store.run_id({"a": 1})


def test_filing_forms(spark):
    names = {"10-K/A annual": "10-K/A", "Form 4 (x)": "4", "sc 13d, big": "SC 13D", "44 things": None, "": None, None: None, "10-Kx": None}
    d = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.f for r in d.select(fl.form_type(F.col("n")).alias("f")).collect()] == list(names.values())


def test_crossings_cool_down_and_changes(spark):
    t0 = datetime(2024, 1, 1)
    q = spark.createDataFrame([("s", i, t0 + timedelta(seconds=i), p) for i, p in enumerate([0.0, 2.0, 0.0, 2.0, 0.0, 2.0, None, 2.0])], "symbol string, event_id long, ts timestamp, price double")
    trig = spark.createDataFrame([("s", "t", 1.0)], "symbol string, trigger_id string, threshold double")
    got = [r.at_us // 1_000_000 - int(t0.timestamp()) for r in sg.crossings(q, trig, 3).orderBy("at_us").collect()]
    assert [g - got[0] for g in got] == [0, 4]
    assert sg.change_over(q, "symbol", "ts", "price").first().delta == 2.0 and sg.change_over(q.where("event_id = 0"), "symbol", "ts", "price").first().delta is None


def test_broadcasts_are_counted(spark):
    assert few(spark.range(5), 5)._jdf.queryExecution().analyzed().toString().startswith("ResolvedHint")
    assert not few(spark.range(6), 5)._jdf.queryExecution().analyzed().toString().startswith("ResolvedHint")


def test_the_rest_stands_without_the_training_data_folders(tmp_path):
    for name in ("marlstone", "__spark_entry__.py"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "marlstone" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 200 and set(s) <= set(q) and not [k for k in q if k.startswith('op') or k == 'pipeline']"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, env={"PATH": "/usr/bin:/bin"}).returncode == 0
