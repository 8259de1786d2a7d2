"""Order-book detectors on a live stream: state for each symbol and session, kept in the state store."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "symbol long, session_id date, event_id long, fired boolean, strength double"
STATE = "sessions array<struct<symbol:long,session_id:date,kept:array<struct<ticks:long,traded:long>>>>"


class Ignition:
    """A traded volume above a multiple of the median of the intervals before, with a rise to the best ask before; keeps lookback + 1 snapshots of each session of a bucket."""

    def __init__(self, multiplier: float, lookback: int, least: float):
        self.multiplier, self.lookback, self.least = multiplier, lookback, least

    def __call__(self, bucket: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.getOption
        sessions = {tuple(x[:2]): [tuple(v) for v in x[2]] for x in before[0]} if before is not None else {}
        batches, out = defaultdict(list), []
        for pdf in rows:
            for symbol, session_id, *x in zip(*(pdf[c].tolist() for c in ("symbol", "session_id", "ts", "event_id", "ticks", "traded")), strict=True):
                batches[symbol, session_id].append(x)
        for key, batch in batches.items():
            kept = sessions.get(key, [])
            for _, event_id, t, v in sorted(batch, key=lambda x: x[:2]):
                if len(kept) > self.lookback:
                    past = sorted(x[1] for x in kept[-self.lookback :])
                    gate = max(self.least, self.multiplier * (past[(self.lookback - 1) // 2] + past[self.lookback // 2]) / 2)
                    out.append((*key, event_id, bool(v > gate and t - kept[-1][0] >= 1), min(1.0, v / (2 * gate))))
                kept = [*kept, (int(t), int(v))][-(self.lookback + 1) :]
            sessions[key] = kept
        state.update(([(*k, v) for k, v in sessions.items()],))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "session_id", "event_id", "fired", "strength"])


def ignition(snapshots: DataFrame, multiplier: float = 3.0, lookback: int = 5, least: float = 10.0, buckets: int = 1024) -> DataFrame:
    """Ignition over a stream of snapshots (symbol, session_id, ts, event_id, ticks, traded). Rows of a session are put in order within a micro-batch; its first interval has no volume before it. Sessions are dealt to buckets by their hash, as a call for each small session costs more than its rows; how many is part of a stream's checkpoint."""
    fold = Ignition(multiplier, lookback, least)
    keyed = snapshots.select("symbol", "session_id", "ts", "event_id", "ticks", "traded").withColumn("bucket", F.pmod(F.xxhash64("symbol", "session_id"), F.lit(buckets)).cast("int")).groupBy("bucket")
    return keyed.applyInPandasWithState(lambda key, rows, state: fold(key, rows, state), OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def imbalance(snapshots: DataFrame, ratio: float = 3.0, least: float = 1000.0) -> DataFrame:
    """event_id, fired, strength of snapshots with arrays of bid and ask volumes: one side's total above ratio times the other's."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("double"), lambda a, v: a + v)
    x = snapshots.select("event_id", total("bids").alias("bid"), total("asks").alias("ask")).where((F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("bid") + F.col("ask") >= least))
    r = F.col("bid") / F.col("ask")
    return x.select("event_id", (r > ratio).alias("fired"), F.least(F.lit(1.0), r / (2 * ratio)).alias("strength"))


def snapshots_of(stream: DataFrame) -> DataFrame:
    """Event rows as snapshots, as the batch binding makes them."""
    return stream.select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("session_id"), "ts", "event_id", F.round((F.round(F.coalesce("value", F.lit(0.0)), 2) + 1) * 100).cast("long").alias("ticks"), (F.col("event_id") % 97).alias("traded"))
