"""Conditional path studies: states of trailing features, origins that do not overlap, walk-forward forecasts from matured labels, cones of matched paths."""

from __future__ import annotations

import math
from bisect import insort
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.market import greedy_origins
from marlstone.operators.quantiles import exact_quantiles
from marlstone.sources.shared import written

EVENTS = ("up", "down", "recent_high")
#: What a forecast is.
ISSUED, FEW, NO_STATE = "issued", "insufficient_training_sample", "feature_unavailable_at_origin"


def study_rows(bars: DataFrame, lookback: int, h: int, up: float, down: float, edges: dict[str, list[float]]) -> DataFrame:
    """symbol, date, i (from 0), last, state, observed, complete, terminal, path and the first step that touches up, down and the recent high.

    state: of each feature (trailing_return, drawdown, realised_vol over lookback returns) how many of its edges it reaches; null
    without a full window. The path is that of the next h bars; the recent high is the highest of the window, 0 steps where the origin
    closes there.
    """
    by = Window.partitionBy("symbol").orderBy("date")
    w, bar = by.rowsBetween(-lookback, 0), F.struct("close", "high", "low")
    x = bars.withColumn("__r", F.log(F.col("close") / F.lag("close").over(by)))
    x = x.select(
        "symbol", "date", "close", (F.row_number().over(by) - 1).cast("long").alias("i"), (F.count("*").over(Window.partitionBy("symbol")) - 1).alias("last"), F.count("close").over(w).alias("have"), F.max("high").over(w).alias("target"),
        (F.col("close") / F.first("close").over(w) - 1).alias("trailing_return"), (F.col("close") / F.max("high").over(w) - 1).alias("drawdown"), (F.stddev_samp("__r").over(by.rowsBetween(-lookback + 1, 0)) * 252**0.5).alias("realised_vol"),
        F.array_compact(F.array(*[F.lead(bar, k).over(by) for k in range(1, h + 1)])).alias("path"),
    )
    reached = lambda c: sum((F.coalesce((F.col(c) >= float(e)).cast("int"), F.lit(0)) for e in edges[c]), F.lit(0)).cast("string")
    state = F.when(F.col("have") == lookback + 1, F.concat_ws("-", *[reached(c) for c in edges]))
    first = lambda hit: F.coalesce(*[F.when(hit(F.get("path", F.lit(k))), k + 1) for k in range(h)])
    whole = F.size("path") == h
    return x.select(
        "symbol", "date", "close", "i", "last", state.alias("state"), F.size("path").alias("observed"), whole.alias("complete"), "path", F.when(whole, F.element_at("path", -1)["close"] / F.col("close") - 1).alias("terminal"),
        first(lambda b: b["high"] >= F.col("close") * (1 + up)).alias("up"), first(lambda b: b["low"] <= F.col("close") * (1 - down)).alias("down"), F.when(F.col("close") >= F.col("target"), 0).otherwise(first(lambda b: b["high"] >= F.col("target"))).alias("recent_high"),
    )


def origins(rows: DataFrame, h: int, conditional: bool = True) -> DataFrame:
    """symbol, state, i: of the rows with a state the earliest, then each next one more than h bars on, for each symbol and state (or each symbol).

    A sample for any cutoff is the beginning of this one: what is taken depends on earlier rows alone. So one pass serves every
    forecast, which takes those whose label has matured by then.
    """
    x = rows.where("state is not null").select("symbol", "state", "i")
    if conditional:
        return greedy_origins(x, ["symbol", "state"], "i", h)
    return x.join(greedy_origins(x, "symbol", "i", h), ["symbol", "i"]).select("symbol", "state", "i")


def forecasts(rows: DataFrame, h: int, start: float, least_train: int) -> DataFrame:
    """One row for each forecast: symbol, i, state, status, train_n, base_train_n, touch frequencies and 90% intervals of the matched and of all origins, and what came.

    Forecasts stand h + 1 bars apart from the place `start` (a share of the symbol's bars) on. Origins train a forecast from the bar on
    at which their own h bars are over; matched ones have its state. Probabilities are null under least_train origins of either kind.
    """
    begin = F.floor(F.col("last") * start)
    # A symbol's first forecast stands at its first row with a state, from `begin` on.
    first = F.min(F.when((F.col("i") >= begin) & F.col("state").isNotNull(), F.col("i"))).over(Window.partitionBy("symbol"))
    x = rows.withColumn("due", F.coalesce((F.col("i") >= begin) & ((F.col("i") - first) % (h + 1) == 0), F.lit(False)))
    x = x.select("symbol", "i", "state", "due", "complete", "terminal", *[F.col(e).cast("int").alias(e) for e in EVENTS]).where("state is not null or due")
    trained = [f"{b}{c}" for b in ("", "base_") for c in ("train_n", *[f"p_{e}" for e in EVENTS], "lo", "hi")]
    carried = ["symbol", "i", "state", "complete", "terminal", *EVENTS]
    kinds = [f"{c} {k}" for c, k in x.select(*carried).dtypes] + [f"{c} {'long' if c.endswith('train_n') else 'double'}" for c in trained]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("symbol", "i", "state", "due", "complete", "terminal", *EVENTS)]
            at, told = [], []
            for n, (symbol, i, state, due, complete, terminal, *hits) in enumerate(zip(*columns, strict=True)):
                if done is None or symbol != done[0]:
                    done = symbol, defaultdict(lambda: Trained(h))
                if state is not None:
                    for own in (done[1][state], done[1][None]):
                        own.meet(i, complete, terminal, hits)
                if due:
                    at.append(n)
                    told.append((done[1][state].at(i) if state is not None else NOTHING) + done[1][None].at(i))
            if at:
                own = b.select(carried).take(pa.array(at))
                more = [pa.array(c, pa.int64() if name.endswith("train_n") else pa.float64()) for name, c in zip(trained, zip(*told, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([*own.columns, *more], names=[*carried, *trained])

    x = x.repartition("symbol").sortWithinPartitions("symbol", "i").mapInArrow(run, ", ".join(kinds))
    enough = F.least("train_n", "base_train_n") >= least_train
    x = x.withColumn("status", F.when(F.col("state").isNull(), NO_STATE).when(enough, ISSUED).otherwise(FEW))
    names = [c for c in trained if not c.endswith("train_n")]
    return x.select("symbol", "i", "state", "status", "train_n", "base_train_n", *[F.when(F.col("status") == ISSUED, F.col(c)).alias(c) for c in names], "complete", "terminal", *EVENTS)


class Trained:
    """Training rows of one symbol (and state): its origins, in order, as their labels mature."""

    def __init__(self, h: int):
        self.h, self.last, self.waiting = h, None, deque()
        self.n, self.hits, self.ends, self.odd = 0, [0] * len(EVENTS), [], 0

    def meet(self, i: int, complete: bool, terminal: float | None, hits: list[int | None]) -> None:
        """A row with a state: an origin, if it lies more than h bars after the last one."""
        if self.last is None or i > self.last + self.h:
            self.last = i
            if complete:
                self.waiting.append((i, terminal, hits))

    def at(self, i: int) -> tuple:
        """n, touch frequencies, 5% and 95% quantiles (linear, NaN above all) of the origins whose h bars are over at i."""
        while self.waiting and self.waiting[0][0] + self.h <= i:
            _, end, hits = self.waiting.popleft()
            self.n += 1
            self.hits = [a + (b is not None) for a, b in zip(self.hits, hits, strict=True)]
            if end is not None and end == end:
                insort(self.ends, end)
            elif end is not None:
                self.odd += 1
        if not self.n:
            return NOTHING
        return (self.n, *[a / self.n for a in self.hits], self._quantile(0.05), self._quantile(0.95))

    def _quantile(self, p: float) -> float | None:
        size = len(self.ends) + self.odd
        if not size:
            return None
        place = (size - 1) * p
        low, high = math.floor(place), math.ceil(place)
        a, b = (self.ends[k] if k < len(self.ends) else math.nan for k in (low, high))
        return a if low == high or a == b else (high - place) * a + (place - low) * b


#: What stands where nothing has trained a forecast.
NOTHING = (0, *[None] * len(EVENTS), None, None)


def scores(issued: DataFrame, least_scored: int) -> DataFrame:
    """symbol, forecasts, issued, scored, gate, and of the issued forecasts whose bars are over: Brier of each event and of the baseline's probability, coverage and mean width of both 90% intervals."""
    ok = (F.col("status") == ISSUED) & F.col("complete")
    mean = lambda c: F.avg(F.when(ok, c))
    error = lambda p, e: mean(F.pow(F.col(f"{p}p_{e}") - F.col(e).isNotNull().cast("double"), 2))
    g = issued.groupBy("symbol").agg(
        F.count("*").alias("forecasts"), F.count_if(F.col("status") == ISSUED).alias("issued"), F.count_if(ok).alias("scored"), *[error(p, e).alias(f"{n}_{e}") for e in EVENTS for p, n in (("", "brier"), ("base_", "base_brier"))],
        *[x for p in ("", "base_") for x in (mean(F.col("terminal").between(F.col(f"{p}lo"), F.col(f"{p}hi")).cast("double")).alias(f"{p}coverage90"), mean(F.col(f"{p}hi") - F.col(f"{p}lo")).alias(f"{p}width90"))],
    )
    return g.withColumn("gate", F.when(F.col("scored") >= least_scored, "sufficient_for_descriptive_scoring").otherwise("insufficient"))


def matched(rows: DataFrame, h: int) -> DataFrame:
    """Each symbol's origins of the state in which it stands now, up to the bar before its last; incomplete paths too."""
    # Origins of a state depend on its own rows alone, so the other states' go first.
    now = F.max(F.when(F.col("i") == F.col("last"), F.col("state"))).over(Window.partitionBy("symbol"))
    x = rows.withColumn("now", now).where("i < last and state = now").drop("now")
    return greedy_origins(x, ["symbol", "state"], "i", h, tuple(c for c in x.columns if c not in ("symbol", "state", "i")))


def cone(rows: DataFrame, by: list[str], h: int, probabilities: dict[str, float]) -> DataFrame:
    """by, step, kind (close, high, low), n, censored_n and quantiles of the return that the matched origins' paths had at each step: points that were seen, nothing filled."""
    m = written(matched(rows, h).select(*by, "close", "path"), "matched")
    points = m.select(*by, "close", F.posexplode("path").alias("k", "b")).select(*by, (F.col("k") + 1).cast("long").alias("step"), F.explode(F.create_map(*[x for c in ("close", "high", "low") for x in (F.lit(c), F.col("b")[c] / F.col("close") - 1)])).alias("kind", "r"))
    q = exact_quantiles(points, [*by, "step", "kind"], "r", probabilities)
    total = m.groupBy(*by).agg(F.count("*").alias("origins")) if by else m.agg(F.count("*").alias("origins"))
    q = q.join(total, by) if by else q.join(F.broadcast(total))  # one row
    return q.select(*by, "step", "kind", "n", (F.col("origins") - F.col("n")).alias("censored_n"), *probabilities)
