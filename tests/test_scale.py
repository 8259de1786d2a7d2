"""What larger tables and odd rows brought up: ties, pairs by blocks, many small sessions, controls of wide sections."""

import hashlib
import math
import random

import duckdb
import numpy as np

from marlstone.operators import engine as en
from marlstone.operators import factors as fx
from marlstone.operators import market as mk
from marlstone.plans import checkpoint_queries as cq
from marlstone.sources.shared import written


def test_ordered_distinct_keeps_the_tables_order_in_ties_and_puts_missing_keys_last(spark, tmp_path):
    rows = [(1, 1, 7, 5.0, "R", "O"), (1, 1, 7, 5.0, "A", "F"), (1, 1, 7, 5.0, "N", "O"), (2, None, 7, 5.0, "R", "F"), (2, 2, 7, 5.0, "A", "O"), (3, 1, None, 5.0, "R", "F"), (3, 1, 4, None, "N", "F"), (3, 1, 4, 2.0, "A", "O")]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["k"]: r["v"] for r in cq.o05_ordered_distinct(spark, str(tmp_path)).collect()}
    c = duckdb.connect(config={"threads": 1})
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == dict(c.execute(cq.SQL["o05_ordered_distinct"]).fetchall()) == {1: "R,A,N,O,F", 2: "A,R,O,F", 3: "A,N,R,O,F"}


def test_pairs_of_several_blocks_without_a_copy_of_the_series_for_each(spark, monkeypatch):
    monkeypatch.setattr(mk, "LEAST_SIDE", 4)
    monkeypatch.setattr(mk, "BATCH_PAIRS", 10)
    rng = random.Random(3)
    series = {s: {f"d{t:03}": rng.gauss(0, 1) for t in range(40) if rng.random() < 0.8} for s in range(13)}
    series[3] = dict.fromkeys(series[3], 0.1)  # constant
    series[4] = {d: 1e6 + 1e-4 * v for d, v in series[4].items()}  # far from zero
    series[5] = {d: math.inf if i == 0 else v for i, (d, v) in enumerate(series[5].items())}
    series[6] = {"d001": 1.0}
    rows = [(s, d, v) for s, x in series.items() for d, v in x.items()]
    g = mk.pair_graph(spark.createDataFrame(rows, "symbol long, date string, y double"), 10, 20)
    assert "Generate" not in g._jdf.queryExecution().toString()
    got = {(r.a, r.b): r for r in g.collect()}
    assert len(got) == g.count()
    for a in series:
        for b in series:
            both = sorted(set(series[a]) & set(series[b]))
            assert ((a, b) in got) == (a != b and bool(both))
            if a == b or not both:
                continue
            r = got[a, b]
            assert (r.aligned, r.n_obs) == (len(both), min(20, len(both)))
            for k, told in ((10, r.beta_10), (20, r.beta_20)):
                x, y = (np.array([series[s][d] for d in both[-k:]]) for s in (a, b))
                with np.errstate(all="ignore"):
                    want = np.mean((x - x.mean()) * (y - y.mean())) / np.var(y)
                if b == 3 or not np.isfinite(want):
                    assert told is None or b == 3 and abs(np.var(y)) > 0
                else:
                    assert math.isclose(told, want, rel_tol=1e-7, abs_tol=1e-9)


def test_many_small_sessions_share_the_calls_and_the_state_rows_of_a_few_buckets(spark, tmp_path):
    from datetime import datetime, timedelta

    from marlstone.streaming import detectors, live_book, streams

    t0 = datetime(2024, 1, 1)
    rows = [(f"s{i % 90}", "d", t0 + timedelta(seconds=i), i, 5, i, [10, 9], [100 * (1 + i % 7), 50], [11], [30], None, None) for i in range(270)]
    x = spark.createDataFrame(rows, "symbol string, session_id string, ts timestamp, event_id long, last long, cum long, bids array<long>, bid_volumes array<long>, asks array<long>, ask_volumes array<long>, limit_ticks long, seal long")
    p = live_book.Settings(("order_wall",), lookback=2, wall_factor=1.1, wall_least=1.0)
    seen = {}
    for buckets in (1, 7, 1024):
        with streams.rocks(spark):
            found = live_book.follow(streams.in_order(spark, x, "many", 2), p, buckets=buckets)
            seen[buckets] = sorted(tuple(r) for r in streams.drain(found, "found").collect())
    assert seen[1] == seen[7] == seen[1024] and len(seen[1]) > 0
    told = {}
    for buckets in (1, 1024):
        live = streams.as_stream(spark, x.selectExpr("cast(substr(symbol, 2) as long) symbol", "date'2024-01-01' session_id", "ts", "event_id", "cast(event_id % 5 as long) ticks", "cast(event_id % 97 as long) traded"), "ticks")
        told[buckets] = sorted(tuple(r) for r in streams.drain(detectors.ignition(live, 1.2, 1, 1.0, buckets=buckets), "told").collect())
    assert told[1] == told[1024] and len(told[1]) == 90


def test_many_triggers_share_the_calls_timers_and_state_rows_of_a_few_buckets(spark):
    from datetime import datetime, timedelta

    from marlstone.streaming import streams, watch

    t0 = datetime(2024, 1, 1)
    start, end = 1_704_067_200_000_000, 1_704_067_200_000_000 + 10**12
    quotes = spark.createDataFrame([(f"s{i % 40}", t0 + timedelta(minutes=7 * i), i, float(i * 7919 % 19)) for i in range(400)], "symbol string, ts timestamp, event_id long, price double")
    kinds = (("price_cross", "cross_up", 10.0, 10.0), ("source_stale", "becomes_stale", 7200.0, None), ("data_gap_recovered", "recovers", 7200.0, None))
    triggers = spark.createDataFrame([(f"s{s}", f"{s}-{c}", kind, c, level, ref, start, end, 0, "recross", s % 2 == 1) for s in range(45) for kind, c, level, ref in kinds], watch.TRIGGER)
    seen = {}
    for buckets in (1, 3, 64):
        with streams.rocks(spark):
            fired = watch.watch(streams.in_order(spark, quotes, "quotes", 2), triggers, "1 hour", buckets)
            seen[buckets] = sorted(tuple(r[:4]) + (r.price or -1.0, r.nth) for r in streams.drain(fired, "fired").collect())
    assert seen[1] == seen[3] == seen[64] and {r[3] for r in seen[1]} == {"cross_up", "becomes_stale", "recovers"}
    assert sum(r[0] in ("s40", "s41", "s42", "s43", "s44") for r in seen[1]) == 5  # nothing ever comes


def test_shuffle_control_deals_by_digest_without_a_row_for_a_whole_section(spark):
    from hashlib import md5

    from marlstone.operators import factors as fx

    rng = random.Random(9)
    rows = [("f", d, s, float(rng.randrange(1, 9)), float(rng.randrange(1, 9))) for d in ("d1", "d2", "d3") for s in range(12)] + [("f", "d4", s, 2.0, float(s)) for s in range(5)]  # the last section has no spread
    x = fx.shuffle_null(spark.createDataFrame(rows, "factor_name string, date string, symbol long, fr double, rr double"), 4, 7)
    assert "collect_list" not in x._jdf.queryExecution().toString()
    got = {r.trial: r.trial_ic for r in x.collect()}
    for t in range(4):
        ics = []
        for d in ("d1", "d2", "d3"):
            held = [r for r in rows if r[1] == d]
            dealt = [r[4] for r in sorted(held, key=lambda r: md5(f"{t}|{d}|{r[2]}|7".encode()).hexdigest())]
            ics.append(np.corrcoef(sorted(r[3] for r in held), dealt)[0, 1])
        assert math.isclose(got[t], np.mean(ics), rel_tol=1e-9)
    assert len(got) == 4


def test_a_names_digests_are_worked_out_once_for_all_factors_of_a_date(spark):
    from hashlib import md5

    from pyspark.sql import functions as F

    from marlstone.operators import factors as fx

    rng = random.Random(4)
    rows = [(f, sc, d, s, float(rng.randrange(1, 9)), float(rng.randrange(1, 9))) for f in ("f", "g|r0") for sc in ("overall", "train") for d in ("d1", "d2") for s in range(15) if (f, s) not in (("f", 3), ("g|r0", 8))]
    x = spark.createDataFrame(rows, "factor_name string, scope string, date string, symbol long, fr double, rr double")
    seed = F.when(F.col("scope") == "train", 8).otherwise(7)
    null = fx.shuffle_null(x, 3, seed, ["factor_name", "scope"])
    plan = null._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInArrow [date" in plan  # no factor in the key of the task
    got = {(r.factor_name, r.scope, r.trial): r.trial_ic for r in null.collect()}
    assert len(got) == 12
    for f, sc, t in got:
        ics = []
        for d in ("d1", "d2"):
            held = [r for r in rows if r[:3] == (f, sc, d)]
            dealt = [r[5] for r in sorted(held, key=lambda r: md5(f"{t}|{d}|{r[3]}|{8 if sc == 'train' else 7}".encode()).hexdigest())]
            ics.append(np.corrcoef(sorted(r[4] for r in held), dealt)[0, 1])
        assert math.isclose(got[f, sc, t], np.mean(ics), rel_tol=1e-9)


def plan(df):
    return df._jdf.queryExecution().toString()


ORDERS = "symbol string, seq long, ts timestamp, order_id string, lifecycle string, status string, side string, quantity double, r double, ret double"


def many_orders():
    from datetime import datetime, timedelta

    rng, t0 = random.Random(11), datetime(2024, 1, 1)
    status = lambda: rng.choice([("open", "buy"), ("open", "long"), ("partial_closed", "sell"), ("closed", "exit"), ("closed_unreconciled", None)])
    return [(f"s{i % 30}", i, t0 + timedelta(minutes=i), f"o{i}", None, *status(), float(rng.choice([0, 1, 2.5, 10])), rng.choice([None, 0.5, math.nan]), None) for i in range(900)]


def test_a_table_as_a_stream_is_written_by_its_own_tasks_and_symbols_share_the_calls_of_a_few_buckets(spark, tmp_path, monkeypatch):
    from marlstone.operators import lifecycles as lc
    from marlstone.streaming import streams

    d = spark.createDataFrame(many_orders(), ORDERS)
    want = sorted(map(tuple, lc.latest(lc.lifecycles(d)).collect()), key=str)
    monkeypatch.setattr(lc, "BATCH", 7)
    for buckets in (1, 5, 1024):
        for live in (streams.as_stream(spark, d.repartition(4), "orders"), streams.in_order(spark, d, "orders", 3)):
            with streams.rocks(spark):
                got = lc.latest(streams.drain(lc.stream_lifecycles(live, buckets), "lots")).collect()
            assert sorted(map(tuple, got), key=str) == want
    monkeypatch.setattr(streams, "fresh_path", lambda *_: f"{tmp_path}/stream")
    streams.as_stream(spark, d.repartition(4), "orders")
    assert len(list(tmp_path.glob("stream/part-*"))) == 4


def test_panels_share_files(spark, tmp_path, monkeypatch):
    from marlstone.plans import scan_queries as sq
    from marlstone.sources import scans

    (tmp_path / "p.json").write_text('{"symbol": "A", "source": "x", "rows": [{"date": "2024-01-02", "close": 1.5}]}\n{"symbol": "A", "source": "y", "rows": [{"date": "2024-01-02", "close": 2.5}]}\n{"symbol": "B", "source": "x", "rows": []}\n')
    bars, gaps = scans.load_panels(spark, f"{tmp_path}/p.json", lines=True)
    assert sorted((r.symbol, r.close, r.null_eligible) for r in bars.collect()) == [("A", 1.5, False), ("A", 2.5, False)] and [r.symbol for r in gaps.collect()] == ["B"]
    monkeypatch.setattr(sq, "fresh_path", lambda *_: f"{tmp_path}/panels")
    symbols = sq.s01_panel_scan(spark, "/root/testdata/sf0.001").count()
    assert symbols >= 10 and len(list(tmp_path.glob("panels/**/*.json"))) <= 4


def test_only_the_last_change_of_a_lifecycle_leaves_the_fold(spark, monkeypatch):
    from marlstone.operators import lifecycles as lc

    monkeypatch.setattr(lc, "BATCH", 7)
    d = spark.createDataFrame(many_orders(), ORDERS)
    x = lc.standing(d)
    want = lc.latest(lc.lifecycles(d))
    assert x.columns == want.columns and sorted(map(tuple, x.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "FlatMapGroups" not in plan(x) and "Aggregate" not in plan(x)


def test_forecasts_and_cones_pass_once_over_a_symbols_bars(spark):
    from marlstone.operators import paths as pt

    rng = random.Random(5)
    bars = spark.createDataFrame([(s, f"d{t:03}", c := 10 + rng.random(), c + rng.random(), c - rng.random()) for s in range(3) for t in range(80)], "symbol long, date string, close double, high double, low double")
    rows = pt.study_rows(bars, 5, 3, 0.05, 0.05, {"trailing_return": [0.0], "drawdown": [], "realised_vol": [1.0]})
    assert "Join" not in plan(pt.forecasts(rows, 3, 0.4, 5)) and "Join" not in plan(pt.matched(rows, 3))
    assert mk.greedy_origins(rows.where("state is not null"), ["symbol", "state"], "i", 3).where("i is null").count() == 0


def test_bundles_are_not_sent_whole(spark):
    from marlstone.operators import registers as rg

    e = spark.createDataFrame([("h1", "e1", 5), ("h2", "e2", 5), ("h3", "e3", 5)], "content_hash string, entry_id string, entered_at int")
    b = spark.createDataFrame([("h1", 4), ("h2", 6), ("h2", 7)], "content_hash string, frozen_at int")
    x = rg.hash_feedback(e, b)
    assert {r.entry_id: r.state for r in x.collect()} == {"e1": "linked", "e2": "bundle_after_entry", "e3": "no_bundle"} and "Broadcast" not in plan(x)


def test_range_of_many_rows_without_a_frame_of_many_rows(spark):
    from marlstone.operators import factors as fx

    rng = random.Random(8)
    lows = {(s, t): rng.choice([None, math.nan]) if rng.random() < 0.02 else rng.random() for s in range(3) for t in range(60)}
    d = spark.createDataFrame([(s, t, v, None if v is None else v + 1) for (s, t), v in lows.items()], "symbol int, date int, low double, high double")
    for n in (1, 7, 12):
        for r in fx.with_range(d, n).collect():
            span = [lows.get((r.symbol, r.date - k)) for k in range(n)]
            whole = all(v is not None and v == v for v in span)
            assert (r["__lo"], r["__hi"]) == ((min(span), max(span) + 1) if whole else (None, None))
    bars = d.selectExpr("*", "low close", "low volume", "low amount", "low turnover_rate")
    assert "-251" not in plan(fx.factor_panel(bars, ["range_pos_252"]))


def test_sections_are_counted_by_date_and_ranked_after_one_sort_each(spark):
    from pyspark.sql import functions as F

    from marlstone.operators import factors as fx

    rng = random.Random(9)
    d = spark.createDataFrame([(f"d{t}", s, rng.choice([None, math.nan, 0.5, rng.random()]), rng.choice([None, rng.random()]), rng.random()) for t in range(20) for s in range(8)], "date string, symbol int, a double, b double, fwd_1 double")
    x, long = fx.kept_dates(d, ["a", "b"], 1, 4), fx.long_sections(d, ["a", "b"], 1, 4)
    want = {r.factor_name: r.n for r in long.groupBy("factor_name").agg(F.count_distinct("date").alias("n")).collect()}
    assert {r.factor_name: r.kept_dates for r in x.collect()} == want and all(r.dates == 20 for r in x.collect()) and "Window" not in plan(x)
    physical = long._jdf.queryExecution().sparkPlan().toString()
    assert physical.count("Window ") == 2


def test_weeks_are_not_joined_by_a_shuffle_of_all_bars(spark):
    from marlstone.sources.bindings import bars

    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        x = bars(spark, "/root/testdata/sf0.001")
        assert "SortMergeJoin" not in plan(x) and x.count() > 0
    finally:
        spark.conf.set(name, before)


def test_rotation_in_blocks_of_packed_ranks(spark, monkeypatch):
    monkeypatch.setattr(fx, "TURNED_ROWS", 40)
    assert all(np.array_equal(fx._unpacked(fx._packed(m), *m.shape), m) for m in (np.array([[0.5, 1.0]]), np.array([[1.0], [70000.5], [2.0**30]]), np.array([[-1.25, 3.0]])))
    rng = random.Random(5)
    rows = [("f", f"d{d:02}", s, float(rng.randint(1, 9)) / 2, float(rng.randint(1, 30))) for s in range(40) for d in range(12 if s else 3) if rng.random() < 0.8 or s in (1, 2)]
    df = spark.createDataFrame(rows, "factor_name string, date string, symbol long, fr double, rr double")
    g = fx.circular_null(df, 4, 7)
    assert "turned" in (plan := g._jdf.queryExecution().optimizedPlan().toString()) and "MapInArrow" in plan and "Generate explode" not in plan
    got = {r.trial: r.trial_ic for r in g.collect()}
    ranks = lambda v: [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]
    for trial in range(4):
        series, dates = {}, {}
        for _, d, s, f, r in sorted(rows):
            series.setdefault(s, []).append((d, f, r))
        for s, x in series.items():
            t = len(x)
            if t >= 4:
                o = 2 + int(hashlib.md5(f"{trial}|{s}|7".encode()).hexdigest()[:8], 16) % (t - 3)
                for p, (d, _, r) in enumerate(x):
                    dates.setdefault(d, []).append((x[(p - o) % t][1], r))
        ics = [np.corrcoef(*(ranks(v) for v in zip(*x)))[0, 1] for x in dates.values()]
        assert abs(got[trial] - np.mean([v for v in ics if not np.isnan(v)])) < 1e-9


def test_both_controls_read_one_panel_and_one_set_of_sections(spark, monkeypatch):
    told = []
    for module in (fx, en):
        monkeypatch.setattr(module, "written", lambda df, what: (told.append(what), written(df, what))[1])
    rng = random.Random(9)
    rows = [(f"d{d:03}", s, rng.gauss(0, 1), rng.gauss(0, 1)) for d in range(60) for s in range(12) if s or d > 56]  # the first name is there on three dates
    p = spark.createDataFrame(rows, "date string, symbol long, rev_5 double, fwd_1 double")
    both = en.run_nulls(p, ["rev_5"], [1], 5, least=5)
    assert told.count("panel") == told.count("sections") == 1
    alone = [en.run_engine(p, ["rev_5"], [1], 5, least=5, null=n) for n in ("shuffle", "circular")]
    assert [x.collect() for x in both] == [x.collect() for x in alone]
    # The name leaves its three sections, and the others' ranks close up there: as if it had not been in the controls.
    r = both[1].first()
    s = fx.long_sections(p, ["rev_5"], 1, 5)
    cut = fx.long_sections(p.where("symbol > 0"), ["rev_5"], 1, 5)
    n = fx.with_null(fx.ic_statistics(fx.rank_ic(s), ["factor_name"]), fx.circular_null(cut, 5)).first()
    assert "cross_source_panel_excluded_from_null" not in r.gaps and abs(r.alpha_t - n.alpha_t) < 1e-9 and abs(r.random_ic_std - n.random_ic_std) < 1e-12


def test_windows_of_pairs_from_products_of_stretches(spark):
    rng = np.random.default_rng(4)
    for times, share, windows in ((60, 0.8, (5, 12)), (60, 0.2, (5, 12)), (11, 0.9, (1, 10**6)), (7, 1.0, (7,)), (0, 1.0, (3, 4))):
        x, y = (np.where(rng.random((n, times)) < share, rng.normal(size=(n, times)), np.nan) for n in (6, 9))
        got = mk._pair_sums(x, y, *windows)
        assert len(got) == len(windows)
        for k, sums in zip(windows, got, strict=True):
            for i in range(len(x)):
                assert all(np.allclose(a[i], b, rtol=1e-9, atol=1e-12) for a, b in zip(sums, mk._tail_sums(x[i], y, k), strict=True))
    rows = [(s, f"d{t:02}", float(v)) for s in range(5) for t, v in enumerate(rng.normal(size=30))]
    df = spark.createDataFrame(rows, "symbol long, date string, y double")
    exact, rounded = ({(r.a, r.b): r for r in mk.pair_graph(df, 10, 20, digits).collect()} for digits in (None, 3))
    assert all(rounded[k][c] == round(v[c], 3) and rounded[k].shifted == v.shifted == (abs(v.beta_10 - v.beta_20) >= max(0.35, 0.35 * abs(v.beta_20))) for k, v in exact.items() for c in ("beta_10", "beta_20", "corr_20"))
    assert "round(" not in mk.pair_graph(df, 10, 20, 3)._jdf.queryExecution().optimizedPlan().toString()
