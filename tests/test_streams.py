"""Streams with keyed state against loops over the whole input, cut into micro-batches and restarted from checkpoints."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.operators import lifecycles as lc
from marlstone.streaming import lifecycle_log, streams, watch

T0 = datetime(2024, 1, 1)


def files_of(spark, tmp_path, parts, schema, name="in"):
    """A stream that reads one part for each micro-batch, and a function that writes the next part."""
    folder = f"{tmp_path}/{name}"
    (tmp_path / name).mkdir()

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    for p in parts:
        put(p)
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), put


# ---- watch triggers ----------------------------------------------------------------------------------------------

QUOTES = "symbol string, ts timestamp, event_id long, price double"


def us(t):
    return round((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def watched(trigger, quotes, end):
    """(at_us, price) of the firings of a trigger over all quotes up to end."""
    _, _, kind, condition, level, before, start, stop, cool, rearm, once = trigger
    out, armed, seen, stale, last = [], True, start, False, None

    def fire(at, price):
        nonlocal armed, last
        if (last is None or at - last >= cool * 1_000_000) and (armed or rearm == "after_cooldown") and not (out and once):
            out.append((at, price))
            armed, last = False, at

    def quiet(upto):
        nonlocal stale
        gone = seen + int(level * 1_000_000)
        if kind != "price_cross" and not stale and gone <= upto:
            stale = True
            if condition == "becomes_stale":
                fire(gone, None)

    for at, _, price in sorted(quotes):
        if not start <= at < stop or at > end:
            continue
        quiet(at - 1)
        if kind == "price_cross":
            sides = {"above": (price > level, price <= level), "below": (price < level, price >= level), "cross_up": (before < level <= price, price < level), "cross_down": (before > level >= price, price > level)}
            hit, back = sides[condition]
        else:
            hit, back = condition == "recovers" and stale, True
        before, seen, stale = price, at, False
        armed = armed or back and rearm == "recross"
        if hit:
            fire(at, price)
        if out and (once or rearm == "never"):
            return out
    quiet(min(end, stop - 1))
    return out


def test_watch_triggers_in_any_cut_and_after_a_restart(spark, tmp_path):
    rng = random.Random(5)
    start, rows = us(T0), []
    for s in ("a", "b"):
        at = T0
        for i in range(150):
            at += timedelta(minutes=rng.choice([1, 5, 20, 200]), microseconds=rng.randint(0, 999_999))
            rows.append((s, at, i, float(rng.randint(90, 110))))
    rows.sort(key=lambda r: r[1])
    last = us(rows[-1][1])
    kinds = [("price_cross", c, 100.0) for c in ("above", "below", "cross_up", "cross_down")] + [("source_stale", "becomes_stale", 3600.0), ("data_gap_recovered", "recovers", 3600.0)]
    triggers = [
        (s, f"{s}-{n}-{rearm}-{once}-{cool}-{stop}", kind, c, level, 100.0, start, start + stop * 3_600_000_000, cool, rearm, once)
        for s in ("a", "b") for n, (kind, c, level) in enumerate(kinds) for rearm in watch.REARM for once, cool, stop in ((False, 0, 9999), (False, 7200, 9999), (True, 0, 9999), (False, 0, 60))
    ]
    triggers.append(("c", "nothing-ever-comes", "source_stale", "becomes_stale", 600.0, None, start, start + 9999 * 3_600_000_000, 0, "recross", False))
    bad = [("a", "no-side", "price_cross", "recovers", 1.0, 1.0, start, start + 9, 0, "never", True), ("a", "ended", "price_cross", "above", 1.0, 1.0, start, start, 0, "never", True), ("a", "no-level", "source_stale", "becomes_stale", None, None, start, start + 9, 0, "x", True)]
    t = spark.createDataFrame(triggers + bad, watch.TRIGGER)
    assert {r.trigger_id: r.e for r in t.select("trigger_id", watch.trigger_errors().alias("e")).where("size(e) > 0").collect()} == {"no-side": ["condition"], "ended": ["expires_at"], "no-level": ["rearm_rule", "threshold"]}
    # Three files, neighbours exchanged within the delay, the last one after a restart; quotes without a price don't count.
    for i in range(0, len(rows) - 1, 3):
        rows[i], rows[i + 1] = rows[i + 1], rows[i]
    third = len(rows) // 3
    read, put = files_of(spark, tmp_path, [rows[:third], rows[third : 2 * third]], QUOTES)
    folders = (f"{tmp_path}/out", f"{tmp_path}/state")
    with streams.rocks(spark):
        for part in (None, [*rows[2 * third :], ("a", rows[-1][1], 999, None), ("a", rows[-1][1], 998, float("nan"))]):
            if part:
                put(part)
            got = streams.drain(watch.watch(read(), t, "4 hours"), "w", folders=folders).collect()
    end = (last // 1000 - 4 * 3_600_000) * 1000
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: r.nth):
        found[r.trigger_id].append((r.at_us, r.price))
    quotes = defaultdict(list)
    for s, at, i, price in rows:
        quotes[s].append((us(at), i, price))
    assert {x[1]: found[x[1]] for x in triggers} == {x[1]: watched(x, quotes[x[0]], end) for x in triggers}
    assert len(got) > 300 and found["nothing-ever-comes"] == [(start + 600_000_000, None)]


# ---- lifecycles --------------------------------------------------------------------------------------------------

ORDERS = "symbol string, seq long, ts timestamp, order_id string, lifecycle string, status string, side string, quantity double, r double, ret double, voids_order_id string, fill_confirmed boolean"


def order_rows(rng, symbols=("x", "y"), n=60):
    rows = []
    for s in symbols:
        for i in range(n):
            status = rng.choice(["open", "Filled_Open", "partial_closed", "partial_closed", "closed", "closed_unreconciled", "reconciliation_void", "noise"])
            side = {"open": "buy", "Filled_Open": "LONG", "closed_unreconciled": None, "reconciliation_void": None}.get(status, "sell")
            void = f"{s}{rng.randint(0, i)}" if status == "reconciliation_void" else None
            named = f"{s}:{s}{rng.randint(0, i)}" if status == "closed" and rng.random() < 0.3 else None
            rows.append((s, i, T0 + timedelta(hours=i), f"{s}{i}", named, status, side, float(rng.choice([0, 1, 2.5, 3, 10])), rng.choice([None, 0.5, -1.0]), rng.choice([None, 2.0]), void, False))
        # A fill that is confirmed late heals its order; one event comes twice.
        healed = rng.choice([r for r in rows if r[0] == s and r[10]])[10]
        rows.append((s, n + 5, T0 + timedelta(hours=n + 5), healed, None, "open", "buy", 4.0, None, None, None, True))
        rows.append(rows[-5][:1] + (n + 9,) + rows[-5][2:])
    return rows


def standing_of(rows_df):
    names = ("entry", "left", "exited", "exits", "r", "ret", "status", "outcome")
    return {(r.symbol, r.lifecycle): tuple(r[c] for c in names) for r in rows_df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_late_voids_heals_and_rows_take_back_what_they_change(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = order_rows(rng)
    late = [r for r in rows if r[10] or r[11]] + rng.sample([r for r in rows if not (r[10] or r[11])], 10)
    first = [r for r in rows if r not in late]
    cuts = [first[:40], first[40:], [r for r in late if not r[11]], [r for r in late if r[11]]]
    read, put = files_of(spark, tmp_path, cuts[:2], ORDERS)
    folders = (f"{tmp_path}/out", f"{tmp_path}/state")
    come = list(cuts[0] + cuts[1])
    with streams.rocks(spark):
        for part in (None, *cuts[2:]):
            if part:
                put(part)
                come += part
            changes = streams.drain(lifecycle_log.changelog(read(), "90 days", "60 days"), "o", folders=folders)
            want = lc.latest(lc.lifecycles(lc.live_orders(spark.createDataFrame(come, ORDERS))))
            assert standing_of(lifecycle_log.standing(changes)) == standing_of(want)
    assert changes.where("op = '-'").count() > 10


def test_settled_rows_leave_the_state_and_later_voids_do_not_reach_them(spark, tmp_path):
    def row(i, day, status, side, q, void=None):
        return ("x", i, T0 + timedelta(days=day), f"o{i}", None, status, side, q, None, None, void, False)

    parts = [[row(0, 0, "open", "buy", 5.0), row(1, 1, "open", "buy", 2.0), row(2, 2, "partial_closed", "sell", 5.0)], [row(3, 60, "open", "buy", 1.0)], [row(4, 61, "open", "buy", 1.0)], [row(5, 62, "reconciliation_void", None, 0.0, "o1"), row(6, 62, "reconciliation_void", None, 0.0, "o4"), row(7, 62, "partial_closed", "sell", 2.5)]]
    read, _ = files_of(spark, tmp_path, parts, ORDERS)
    with streams.rocks(spark):
        changes = streams.drain(lifecycle_log.changelog(read(), "10 days", "1 day"), "o")
    got = {r.lifecycle: (r.status, r.exited) for r in lifecycle_log.standing(changes).collect()}
    # o1 was settled before it was voided; o4 was not.
    assert got == {"x:o0": ("closed", 5.0), "x:o1": ("closed", 2.0), "x:o3": ("partial", 0.5)}


# ---- live book ---------------------------------------------------------------------------------------------------


def test_live_book_in_any_cut_with_a_restart(spark, tmp_path):
    from marlstone.operators import market as mk
    from marlstone.operators import rules as rl
    from marlstone.operators import signals as sg
    from marlstone.streaming import live_book

    rng, rows = random.Random(4), []
    for s in ("x", "y"):
        cum, price = 0, 100
        for i in range(40):
            cum += rng.choice([0, 50, 400])
            price += rng.choice([-1, 0, 1, 1])
            bids, asks = [price - k for k in range(1, 6)], [price + k for k in range(1, 6)]
            volume = lambda: [rng.choice([0, 50, 100, 150, 900]) for _ in range(5)]
            rows.append((s, "d", T0 + timedelta(minutes=i), len(rows), price, cum, bids, volume(), asks, volume(), 101, rng.choice([0, 10, 100])))
    schema = "symbol string, session_id string, ts timestamp, event_id long, last long, cum long, bids array<long>, bid_volumes array<long>, asks array<long>, ask_volumes array<long>, limit_ticks long, seal long"
    p = live_book.Settings(lookback=3, wall_factor=1.5, wall_least=50.0, vanish_most=2, vanish_least=100, vanish_share=0.6, break_factor=1.1, break_least=60.0, break_steps=1, break_most=4, break_removed=0.3, break_executed=0.2)
    order = sorted(rows, key=lambda r: (r[2], r[3]))
    read, put = files_of(spark, tmp_path, [order[:25], order[25:50]], schema)
    folders = (f"{tmp_path}/out", f"{tmp_path}/state")
    with streams.rocks(spark):
        for part in (None, [*order[50:], order[3]]):  # a snapshot of the past comes again
            if part:
                put(part)
            got = streams.drain(live_book.follow(read(), p), "b", folders=folders).collect()
    found = defaultdict(list)
    for r in got:
        found[r.detector].append((r.event_id, r.ticks, r.fired, pytest.approx(r.strength)))
    d = spark.createDataFrame(rows, schema).withColumn("snap", F.minute("ts").cast("long"))
    side = lambda n, c, v: d.select("symbol", "session_id", "snap", "event_id", F.lit(n).alias("side"), F.explode(F.arrays_zip(c, v)).alias("x")).select("symbol", "session_id", "snap", "event_id", "side", F.col(f"x.{c}").alias("ticks"), F.col(f"x.{v}").alias("volume"))
    levels = side(1, "bids", "bid_volumes").unionByName(side(2, "asks", "ask_volumes"))
    named = lambda x: {(r.symbol, r.snap): r for r in x.collect()}
    event = {(r[0], r[2].minute): r[3] for r in rows}
    walls = named(mk.order_wall(levels, 1, 1.5, 3, 50.0))
    assert sorted(found["order_wall"], key=str) == sorted([(event[k], None, True, r.strength) for k, r in walls.items()], key=str) and walls
    gone = rl.level_lifetimes(levels, 1, 2, 100, 0.6).collect()
    assert sorted((e, t) for e, t, *_ in found["vanished_level"]) == sorted((event[r.symbol, r.appeared], r.ticks) for r in gone) and gone
    breakers = named(mk.wall_breaker(d.select("symbol", "session_id", "snap", F.col("last").alias("ticks"), F.col("cum").alias("cumulative_volume")), levels.where("side = 2").drop("side"), 3, 1.1, 60.0, 1, 4, 0.3, 0.2))
    assert {e: s for e, _, _, s in found["wall_breaker"]} == {event[k]: r.strength for k, r in breakers.items()} and breakers
    leaks = named(sg.limit_leak(d.select("symbol", "session_id", "snap", F.col("last").alias("ticks"), "limit_ticks", "seal")))
    assert {e: (f, s) for e, _, f, s in found["limit_leak"]} == {event[k]: (r.fired, r.strength) for k, r in leaks.items()} and leaks
    assert [x[0] for x in found["out_of_order"]] == [order[3][3]]


# ---- feeds and late rows -----------------------------------------------------------------------------------------


def test_feeds_get_stale_by_timers_and_recover(spark, tmp_path):
    schema = "feed string, ts timestamp, event_id long"
    at = lambda h: T0 + timedelta(hours=h)
    read, _ = files_of(spark, tmp_path, [[("a", at(0), 1), ("b", at(0), 2)], [("a", at(1), 3)], [("a", at(9), 4), ("b", at(3), 5)], [("a", at(12), 6)]], schema)
    feeds = spark.createDataFrame([(f, us(T0)) for f in ("a", "b", "never")], "feed string, since_us long")
    with streams.rocks(spark):
        got = {(r.feed, r.state, r.at_us) for r in streams.drain(watch.feed_watchdog(read(), feeds, 4 * 3600, "10 hours"), "f").collect()}
    # The watermark ends at two o'clock: nothing has been still for four hours by then.
    assert got == set()
    with streams.rocks(spark):
        got = sorted((r.feed, r.state, (r.at_us - us(T0)) // 3_600_000_000) for r in streams.drain(watch.feed_watchdog(read(), feeds, 4 * 3600, "6 minutes"), "f").collect())
    # b's row of three o'clock comes with one of nine, but the watermark is still that of the batch before: it counts.
    assert got == [("a", "recovered", 9), ("a", "stale", 5), ("b", "stale", 7), ("never", "stale", 4)]


def test_late_rows_and_those_in_time_are_all_rows(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    at = lambda d, h: T0 + timedelta(days=d, hours=h)
    rows = [[(1, at(0, 1), "x", 1.0), (2, at(0, 5), "y", 2.0)], [(3, at(2, 1), "x", 1.5), (4, at(0, 9), "x", 4.0)], [(5, at(0, 7), "x", 8.0), (6, at(1, 7), "x", 16.0)]]
    read, put = files_of(spark, tmp_path, rows[:2], schema)
    folders = (f"{tmp_path}/out", f"{tmp_path}/state")
    for part in (None, rows[2]):
        if part:
            put(part)
        facts, late = streams.accounted_days(read(), "d", 24, folders)
    assert [r.event_id for r in late.collect()] == [5]  # its day closed with row 3; row 6's day has not, row 4 came in the batch that closed it
    got = {(r.day, r.event_type): (r.n, r.cents, r.closed) for r in facts.collect()}
    assert got == {("2024-01-01", "x"): (2, 500, True), ("2024-01-01", "y"): (1, 200, True), ("2024-01-02", "x"): (1, 1600, False), ("2024-01-03", "x"): (1, 150, False)}
    assert sum(n for n, *_ in got.values()) + late.count() == 6


def test_symbols_of_an_order_log_share_the_calls_and_state_rows_of_buckets(spark):
    rows = order_rows(random.Random(11), tuple(f"s{i}" for i in range(7)))
    x = spark.createDataFrame(rows, ORDERS)
    told = {}
    for buckets in (1, 64):
        with streams.rocks(spark):
            changes = streams.drain(lifecycle_log.changelog(streams.in_order(spark, x, "log", 2), "90 days", "60 days", buckets), "log-told")
        told[buckets] = sorted(map(str, lifecycle_log.standing(changes).collect()))
    assert told[1] == told[64] and len(told[1]) > 7


def test_a_long_stretch_of_time_is_several_files_and_one_micro_batch(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    rows = spark.range(2000).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    with streams.rocks(spark):
        stream = streams.in_order(spark, rows, "long", 3, behind=F.col("id") % 5 == 0)
        folders = streams.fresh_path(spark, "long-told"), streams.fresh_path(spark, "long-state")
        told = streams.drain(stream.withColumn("file", F.input_file_name()), "long", folders=folders)
    got = told.select("id", "file", F.regexp_extract(F.input_file_name(), "batch=([0-9]+)", 1).cast("int").alias("batch")).collect()
    assert sorted(r.id for r in got) == list(range(2000))
    width = -(-(1999 * 60 + 1) // 3)
    for r in got:
        assert r.batch == (3 if r.id % 5 == 0 else r.id * 60 // width)
    assert {b: len({r.file for r in got if r.batch == b}) for b in range(4)} == dict.fromkeys(range(4), 4)  # 400 rows in the last, 533 in the others


def test_state_of_the_changelog_goes_as_bytes():
    rows = [("a", 5, 1, "o1", "open", None, "open", False, 2.0, None, None, None, False), ("b", 6, 2, None, "closed", "a:o1", "exit", True, None, 0.5, -1.0, "o1", True)]
    entry = lifecycle_log._entry(rows, lifecycle_log.ROWS)
    assert [type(x) for x in entry] == [bytes] and list(lifecycle_log._rows(entry, lifecycle_log.ROWS)) == rows
    kinds = []

    class Handle:
        def getListState(self, name, schema):
            kinds.append(schema)

        getValueState = getListState

    lifecycle_log.LogFold(1).init(Handle())
    assert set(kinds) == {"data binary"}
