"""Detectors that follow single levels of an order book on a live stream: walls, levels that vanish, walls eaten by trades, leaking limits."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "detector string, symbol string, session_id string, event_id long, ticks long, fired boolean, strength double"
NAMES = [f.split()[0] for f in OUT.split(", ")]
#: A level that is followed: volume, what it gained, snapshots and trades since, its volume and the price one snapshot ago, whether it broke off, whether it had fired.
LEVEL = "event_id long, volume long, added long, rising long, traded long, q long, last long, broken boolean, was boolean"


@dataclass(frozen=True)
class Settings:
    """Parameters of the four detectors, as their batch forms have them; `detectors` says which of them run."""

    detectors: tuple[str, ...] = ("order_wall", "vanished_level", "wall_breaker", "limit_leak")
    lookback: int = 5
    wall_factor: float = 2.0
    wall_least: float = 100.0
    vanish_most: int = 3
    vanish_least: float = 1000.0
    vanish_share: float = 0.8
    break_factor: float = 3.0
    break_least: float = 1000.0
    break_steps: int = 2
    break_most: int = 5
    break_removed: float = 0.8
    break_executed: float = 0.5
    leak_drop: float = 0.5


#: Of a session: snapshots so far, and of the last one time, id, price, traded volume, limit, seal; the last snapshots; the levels that are followed.
SESSION = "symbol:string,session_id:string,n:long,us:long,event_id:long,last:long,cum:long,limit_ticks:long,seal:long,recent:array<struct<bids:array<long>,bid_volumes:array<long>,asks:array<long>,ask_volumes:array<long>>>,levels:array<struct<detector:string,ticks:long,appeared:long,level:struct<" + ",".join(f.replace(" ", ":") for f in LEVEL.split(", ")) + ">>>"
STATE = f"sessions array<struct<{SESSION}>>"
SIDES = ("bids", "bid_volumes", "asks", "ask_volumes")


class LiveBook:
    """The fold of a bucket of sessions, as a call for each small session costs more than its rows. A session's state is bounded by the settings: the last `lookback` snapshots, and every level that is followed, by its price and the snapshot in which it appeared, until it is settled or its snapshots are over; still sessions go."""

    def __init__(self, settings: str, idle_ms: int):
        self.p, self.idle_ms = Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(settings).items()}), idle_ms

    def __call__(self, bucket: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.getOption
        sessions = {tuple(x[:2]): tuple(x[2:]) for x in kept[0]} if kept is not None else {}
        batches, out = defaultdict(list), []
        if not state.hasTimedOut:
            names = ("symbol", "session_id", "us", "event_id", "last", "cum", "limit_ticks", "seal", *SIDES)
            for pdf in rows:
                for x in zip(*(pdf[c].tolist() for c in names), strict=True):
                    batches[tuple(None if v is None or v != v else v for v in x[:2])].append(x[2:])
        for key, batch in batches.items():
            sessions[key] = self._session(key, sorted(batch, key=lambda x: x[:2]), sessions.get(key), out)
        # A session that has been still for so long is over.
        watermark = state.getCurrentWatermarkMs()
        ends = {k: v[1] // 1000 + self.idle_ms for k, v in sessions.items()}
        open_ = [(*k, *v) for k, v in sessions.items() if ends[k] > watermark]
        if open_:
            state.update((open_,))
            state.setTimeoutTimestamp(min(e for e in ends.values() if e > watermark))
        elif kept is not None:
            state.remove()
        if out:
            columns = dict(zip(NAMES, zip(*out, strict=True), strict=True))
            yield pd.DataFrame({**columns, "ticks": pd.array(columns["ticks"], dtype="Int64")})

    def _session(self, key: tuple, batch: list[tuple], kept: tuple | None, out: list[tuple]) -> tuple:
        """The state of a session after its rows of a micro-batch; what they tell goes to out."""
        now, recent, levels = (0, -(2**62), 0, None, None, None, None), [], {}
        if kept is not None:
            now = tuple(kept[:7])
            recent = [[dict(zip(x[0], x[1], strict=True)), dict(zip(x[2], x[3], strict=True))] for x in kept[7]]
            levels = {tuple(x[:3]): list(x[3]) for x in kept[8]}
        none = lambda v: None if v is None or v != v else int(v)
        for us, event_id, last, cum, limit_ticks, seal, *sides in batch:
            if (us, event_id) <= now[1:3]:
                out.append(("out_of_order", *key, event_id, None, False, 0.0))
                continue
            bids, asks = ({int(t): int(v) for t, v in zip(*side, strict=True)} for side in (sides[:2], sides[2:]))
            at = (now[0], us, event_id, none(last), none(cum), none(limit_ticks), none(seal))
            out += [(d, *key, e, t, f, s) for d, e, t, f, s in self._step(at, now, bids, asks, recent, levels)]
            recent = [*recent, [bids, asks]][-self.p.lookback :]
            now = (now[0] + 1, *at[1:])
        return (*now, [(list(b), list(b.values()), list(a), list(a.values())) for b, a in recent], [(*k, tuple(v)) for k, v in levels.items()])

    def _step(self, now, last, bids, asks, recent, levels) -> Iterator[tuple]:
        p, (n, _, event_id, price, cum, _, _) = self.p, now
        past = recent[-p.lookback :] if n >= p.lookback else []
        depth = lambda side: median(v) if (v := [q for x in past for q in x[side].values() if q > 0]) else None
        gained = {t: v - (recent[-1][0].get(t, 0) if recent else 0) for t, v in bids.items()}
        if "order_wall" in p.detectors and (base := depth(0)) is not None:
            gate = base * p.wall_factor
            found = [min(1.0, g / (2.0 * max(gate, p.wall_least))) for g in gained.values() if g > gate and g >= p.wall_least]
            if found:
                yield "order_wall", event_id, None, True, max(found)
        if "vanished_level" in p.detectors:
            yield from self._vanished(n, event_id, bids, gained, levels)
        if "wall_breaker" in p.detectors:
            yield from self._broken(now, asks, depth(1), levels)
        if "limit_leak" in p.detectors and last[3] is not None and last[3] == last[5] and (last[6] or 0) > 0:
            fell = max(last[6] - ((now[6] or 0) if price == now[5] else 0), 0) / last[6]
            opened = price < last[5]
            yield "limit_leak", event_id, None, opened or fell >= p.leak_drop, max(fell, float(opened))

    def _vanished(self, n, event_id, bids, gained, levels) -> Iterator[tuple]:
        """The snapshot in which a level appeared, with the share that it lost first."""
        p = self.p
        for k in [k for k in levels if k[0] == "vanished_level"]:
            x = dict(zip([f.split()[0] for f in LEVEL.split(", ")], levels[k], strict=True))
            share = min(x["added"], max(x["volume"] - bids.get(k[1], 0), 0)) / x["added"]
            if share >= p.vanish_share:
                yield "vanished_level", x["event_id"], k[1], True, share
            if share >= p.vanish_share or n - k[2] >= p.vanish_most:
                del levels[k]
        for t, g in gained.items():
            if g > p.vanish_least:
                levels["vanished_level", t, n] = [event_id, bids[t], g, 0, 0, bids[t], 0, False, False]

    def _broken(self, now, asks, base, levels) -> Iterator[tuple]:
        """Snapshots in which a large ask has been eaten by rising trades and the price has passed it, and had not one snapshot before."""
        p, (n, _, event_id, price, cum, _, _) = self.p, now
        best = None
        for k in [k for k in levels if k[0] == "wall_breaker"]:
            wall, volume, before, rising, traded, q_was, last, broken, was = levels[k]
            q = asks.get(k[1], 0)
            step = cum - before
            broken = broken or q > q_was or price < last
            rising, traded = rising + (step > 0), traded + step
            gone, done = (volume - q) / volume, traded / volume
            ok = n - k[2] >= p.break_steps and not broken and rising >= p.break_steps and gone >= p.break_removed and done >= p.break_executed and price > k[1]
            if ok and not was:
                best = max(best or 0.0, min(1.0, (gone + min(1.0, done / (2.0 * p.break_executed))) / 2.0))
            if n - k[2] >= p.break_most or broken:
                del levels[k]
            else:
                levels[k] = [wall, volume, cum, rising, traded, q, price, broken, ok]
        if best is not None:
            yield "wall_breaker", event_id, None, True, best
        if base is not None:
            for t, v in asks.items():
                if v > max(p.break_least, p.break_factor * base):
                    levels["wall_breaker", t, n] = [event_id, v, cum, 0, 0, v, price, False, False]


def follow(snapshots: DataFrame, settings: Settings, delay: str = "1 day", idle: str = "1 day", buckets: int = 1024) -> DataFrame:
    """detector, symbol, session_id, event_id, ticks, fired, strength over a stream of snapshots: symbol, session_id, ts, event_id, last, cum
    (traded so far), bids, bid_volumes, asks, ask_volumes (prices in ticks and volumes, the same length), limit_ticks, seal.

    Snapshots of a session are taken as they come, in the order of time and id within a micro-batch; one that is not later than the last
    of its session is told as out_of_order and changes nothing. A session that is still for `idle` behind the watermark is over, and its
    state goes. A vanished level is told with the snapshot in which it appeared. Sessions are dealt to buckets by their hash; how many is
    part of a stream's checkpoint.
    """
    if settings.break_steps > settings.break_most:
        raise ValueError("the steps cannot exceed the snapshots that a wall is followed")
    longs = [F.col(c).cast("array<long>").alias(c) for c in ("bids", "bid_volumes", "asks", "ask_volumes")] + [F.col(c).cast("long").alias(c) for c in ("last", "cum", "limit_ticks", "seal")]
    x = snapshots.withWatermark("ts", delay).select(F.col("symbol").cast("string").alias("symbol"), F.col("session_id").cast("string").alias("session_id"), "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"), *longs)
    fold = LiveBook(json.dumps(asdict(settings)), int(pd.Timedelta(idle).total_seconds() * 1000))
    return x.withColumn("bucket", F.pmod(F.xxhash64("symbol", "session_id"), F.lit(buckets)).cast("int")).groupBy("bucket").applyInPandasWithState(lambda key, rows, state: fold(key, rows, state), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
