"""Boundaries of ledgers, lots, books, paths, evidence, states and scans; streams against their batch answer."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import evidence as ev
from marlstone.operators import ledger as lg
from marlstone.operators import market as mk
from marlstone.operators import states as sx
from marlstone.sources import scans as sc
from marlstone.sources.shared import append_new

SF = "/root/testdata/sf0.001"


def fifo(rows):
    lots, out = [], []
    for pos, kind, q in rows:
        if kind == "open":
            lots.append([pos, q])
        while kind == "close" and q and lots:
            take = min(q, lots[0][1])
            out.append((lots[0][0], pos, take))
            q -= take
            lots[0][1] -= take
            if not lots[0][1]:
                lots.pop(0)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_lots_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(s, i, rng.choice(["open", "close"]), rng.randint(1, 300)) for s in range(4) for i in range(60)]
    d = spark.createDataFrame([(s, i, k, q, 100 * q) for s, i, k, q in rows], "symbol long, pos int, kind string, q long, cents long").repartition(5)
    got = {}
    for r in lg.match_lots(d).collect():
        got.setdefault(r.symbol, []).append((r.open_pos, r.close_pos, r.quantity))
    for s in range(4):
        assert sorted(got.get(s, [])) == sorted(fifo([(i, k, q) for t, i, k, q in rows if t == s]))


def test_lifecycle_status(spark):
    d = spark.createDataFrame([(1, 1, "open", 10, 1000), (1, 2, "close", 4, 440), (1, 3, "open", 5, 500), (1, 4, "close", 100, 12000)], "symbol long, pos int, kind string, q long, cents long")
    got = {r.open_pos: r for r in sx.lifecycles(d).collect()}
    assert got[1].status == "closed" and got[1].return_pct == pytest.approx(0.4 * 10 + 0.6 * 20) and got[3].exit_quantity == 5


def test_reconcile_and_queue(spark):
    a = spark.createDataFrame([(1, 10), (2, 5), (3, 7)], "k long, v long")
    b = spark.createDataFrame([(2, 5), (3, 9), (4, 1)], "k long, v long")
    assert {r.k: r.status for r in lg.reconcile(a, b, "k", "v", 2).collect()} == {1: "only_left", 2: "equal", 3: "equal", 4: "only_right"}
    assert {r.k: r.status for r in lg.reconcile(a, b, "k", "v", 1.9).collect()}[3] == "mismatch"
    q = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (0, "c", "z")], "sev int, t string, d string")
    assert [(r.t, r.d) for r in lg.fair_queue(q, "sev", "t", "d", 10).orderBy("place").collect()] == [("c", "z"), ("a", "x"), ("b", "x"), ("a", "y")]


def test_points_sum_to_hundred(spark):
    d = spark.createDataFrame([("g", n, w) for n, w in [("a", 1.0), ("b", 1.0), ("c", 1.0)]] + [("h", "a", 5.0)], "g string, n string, w double")
    got = {(r.g, r.n): r.points for r in lg.largest_remainder(d, ["g"], "w", "n").collect()}
    assert got == {("g", "a"): 34, ("g", "b"): 33, ("g", "c"): 33, ("h", "a"): 100}


def test_streak_and_bins(spark):
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate([True, False, True, True])] + [(2, 0, False), (3, 0, None)], "k long, i int, h boolean")
    assert {r.k: r.streak for r in lg.tail_streak(d, "k", ["i"], F.col("h")).collect()} == {1: 2, 2: 0, 3: 0}
    p = spark.createDataFrame([(x, 1.0) for x in (0.0, 0.1, 0.3, 0.9999, 1.0)], "predicted double, actual double")
    assert {r.bin: r.n for r in lg.reliability(p).collect()} == {0: 1, 1: 1, 3: 1, 9: 2}


def test_as_of_is_strict_before_and_inclusive_after(spark):
    bars = spark.createDataFrame([("s", "2024-01-02", 1.0), ("s", "2024-01-05", 2.0)], "symbol string, date string, close double")
    e = spark.createDataFrame([(1, "s", "2024-01-02"), (2, "s", "2024-01-03"), (3, "s", "2024-01-06"), (4, "none", "2024-01-03")], "id long, symbol string, event_date string")
    assert {r.id: r.base_close for r in mk.previous_close(e, bars).collect()} == {1: None, 2: 1.0, 3: 2.0, 4: None}
    assert {r.id: r.ref_close for r in mk.close_on_or_after(e, bars, "event_date").collect()} == {1: 1.0, 2: 2.0, 3: None, 4: None}


def test_first_touch_never_sees_its_own_bar(spark):
    bars = spark.createDataFrame([("s", str(i), c, h, low) for i, (c, h, low) in enumerate([(10.0, 99.0, 1.0), (10.0, 11.0, 9.0), (10.0, 12.0, 9.5)])], "symbol string, date string, close double, high double, low double")
    r = {x.date: x for x in mk.first_touch(bars, 2, 0.2, 0.1).collect()}
    assert (r["0"].up_step, r["0"].down_step, r["0"].complete) == (2, 1, True)
    assert (r["1"].up_step, r["1"].complete, r["1"].terminal) == (1, False, None)


def test_greedy_origins(spark):
    d = spark.createDataFrame([("s", i) for i in (1, 2, 3, 12, 13, 30)], "k string, i long").orderBy(F.desc("i"))
    assert sorted(r.i for r in mk.greedy_origins(d, "k", "i", 10).collect()) == [1, 12, 30]


def test_book_threshold_is_strict(spark):
    rows = [("s", "d", snap, snap, side, lv, 100 - lv if side == 1 else 100 + lv, 100) for snap in range(3) for side in (1, 2) for lv in range(1, 3)]
    rows = [(*r[:7], 300 if r[2] == 2 and r[4] == 1 and r[5] == 1 else r[7]) for r in rows]
    d = spark.createDataFrame(rows, "symbol string, session_id string, snap int, event_id long, side int, level int, ticks long, volume long")
    assert mk.order_wall(d, 1, 2.0, 2, 0.0).count() == 0  # 200 added is not above 2 * 100
    assert mk.order_wall(d, 1, 1.99, 2, 0.0).count() == 1
    hit = {r.snap: r.fired for r in mk.imbalance(d, 2.0, 0).collect()}
    assert hit == {0: False, 1: False, 2: False} and mk.imbalance(d, 1.99, 0).where("fired").count() == 1


def test_setup_counts_nine(spark):
    bars = spark.createDataFrame([("s", f"{i:03d}", float(100 - i), 101.0 - i, 99.0 - i) for i in range(16)], "symbol string, date string, close double, high double, low double")
    got = [r.setup for r in mk.setup_count(bars).orderBy("date").collect()]
    assert got == [0, 0, 0, 0, *range(1, 13)]


def test_option_codes_and_prices(spark):
    d = spark.createDataFrame([("SPY240119C00470500",), ("bad",), (None,)], "c string")
    r = d.select(*[c.alias(n) for n, c in sc.option_code(F.col("c")).items()]).collect()
    assert (r[0].root, str(r[0].expiry), r[0].side, r[0].strike) == ("SPY", "2024-01-19", "C", 470.5) and r[1].root is None and r[1].strike is None
    v = spark.range(1).select(mk.call_value(F.lit(100.0), F.lit(100.0), F.lit(1.0), F.lit(0.2), 0.05).alias("v")).first().v
    assert v == pytest.approx(10.4506, abs=1e-3)


def test_text_functions(spark):
    urls = {"HTTP://A.Com//x//y?utm_a=1&b=2&Ref=3#f": "http://a.com/x/y?b=2", "https://a.com": "https://a.com/", "ftp://a": "", None: "", "mailto:x": ""}
    d = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.c for r in d.select("u", tx.canonical_url(F.col("u")).alias("c")).collect()} == urls
    t = spark.createDataFrame([("ok\nmy Token: x\nend", "password=abc, Bearer q.w")], "a string, b string").select(tx.redact_lines(F.col("a")).alias("a"), tx.scrub(F.col("b")).alias("b")).first()
    assert t.a == "ok\n[redacted]\nend" and t.b == "password=<redacted>, Bearer <redacted>"


def test_title_wins_over_address(spark):
    rows = [(1, "http://a/1", "A long enough title", "e1", "f1", "unknown"), (2, "http://b/2", "a LONG enough title!", "e2", "f2", "within_window"), (3, "http://c/3", "short", "e1", "f1", "stale"), (4, "http://c/3", "short", "e3", "f3", "within_window")]
    got = ev.merge_hits(spark.createDataFrame(rows, "pos int, url string, title string, engine string, family string, freshness string")).orderBy("first_pos").collect()
    assert [(r.url, r.hits, r.families, r.attention) for r in got] == [("http://a/1", 2, 2, "emerging"), ("http://c/3", 1, 1, "quiet")]


def test_caps_never_raise(spark):
    s = spark.createDataFrame([("m", "L4"), ("m", "L1"), ("n", "L5")], "module string, level string")
    caps = spark.createDataFrame([("m", "L2")], "module string, cap string")
    assert [(r.level, r.level_out) for r in ev.apply_caps(s, caps).orderBy("module", "level").collect()] == [("L1", "L1"), ("L4", "L2"), ("L5", "L5")]


def test_phases_on_each_side(spark):
    rows = [(20, 20, 3, 0.0, 1.0, "ice"), (80, 0, 1, 0.35, 1.0, "divergence"), (80, 0, 4, 0.34, 1.0, "climax"), (40, 10, 5, 0.0, 1.0, "retreat"), (25, 0, 3, 0.0, 1.0, "ferment"), (15, 0, 2, 0.0, 1.0, "start"), (15, 0, 2, 0.0, None, "ice"), (9, 0, 9, 0.0, 1.0, "ice")]
    d = spark.createDataFrame(rows, "up int, down int, h int, br double, pr double, want string")
    assert all(r.want == r.got for r in d.select("want", sx.sentiment_phase(*[F.col(c) for c in ("up", "down", "h", "br", "pr")]).alias("got")).collect())


def test_scans(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"symbol": "A", "market": "US", "source": "x", "adjust": "q", "rows": [{"date": "2024-01-02", "close": 1.5}]}')
    (tmp_path / "b.json").write_text('{"symbol": "A", "market": "US", "source": "y", "adjust": "q", "rows": [{"date": "2024-01-03", "close": 2.5}]}')
    (tmp_path / "c.json").write_text('{"symbol": "B", "market": "US", "source": "x", "rows": []}')
    wanted = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    bars, gaps = sc.load_panels(spark, f"{tmp_path}/*.json", wanted)
    assert bars.count() == 2 and not bars.first().null_eligible and sorted(r.symbol for r in gaps.collect()) == ["B", "C"]
    allowed = spark.createDataFrame([("US", "x"), ("US", "y")], "market string, panel_source string")
    assert sc.provenance(bars, allowed).first().status == "mixed_basis"
    assert sc.provenance(bars, allowed.where("panel_source = 'x'")).first().status == "illegal_source"
    (tmp_path / "j.jsonl").write_text('{"id": 1}\nnot json\n{"id": 2}\n')
    rows, bad = sc.read_journal(spark, str(tmp_path / "j.jsonl"), "id long")
    assert rows.count() == 2 and bad.count() == 1
    f = spark.createDataFrame([("x-20240102T000000.json",), ("x-20240201T000000.json",), ("none",)], "path string")
    assert sc.in_window(f, F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")).count() == 1


def test_append_twice_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    for _ in range(2):
        append_new(str(tmp_path / "t"), rows, ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_streams_give_the_batch_answer(spark):
    from marlstone.plans import state_queries as q

    batch = spark.read.parquet(f"{SF}/events.parquet")
    got = {r.event_type: r.n for r in q.r03_stream_first_events(spark, SF).collect()}
    assert got == {r.event_type: r["count"] for r in batch.groupBy("event_type").count().collect()}


def test_every_query_has_a_name_and_most_have_sql():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(s) > 100 and len([k for k in q if k not in s]) < 20
    assert Path(e.__file__).name == "__spark_entry__.py"
