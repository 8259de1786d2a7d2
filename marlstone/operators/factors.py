"""Cross-section factor research on bar panels: factors, preparation, rank correlation, random controls, evaluation."""

from __future__ import annotations

from functools import reduce
from hashlib import md5
from operator import and_

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marlstone.functions.numeric import average_rank, erfc, finite, full_window, pearson, rank_bin
from marlstone.operators.market import as_of
from marlstone.sources.shared import few as hinted
from marlstone.sources.shared import written


def series() -> WindowSpec:
    """A symbol's rows in time."""
    return Window.partitionBy("symbol").orderBy("date")


def _back(n: int, upto: int = 0):
    return series().rowsBetween(-(n - 1) - upto, -upto)


def forward_return(h: int) -> Column:
    """close[t+h] / close[t] - 1 within a symbol; missing where either is, or the close is not positive."""
    close, later = finite(F.col("close")), finite(F.lead("close", h).over(series()))
    return F.when(close > 0, later / close - 1)


def daily_return() -> Column:
    before = finite(F.lag("close", 1).over(series()))
    return F.when(before != 0, finite(F.col("close")) / before - 1)


def with_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ret", daily_return())


def _ratio(a: int, b: int) -> Column:
    close = lambda k: finite(F.lag("close", k).over(series())) if k else finite(F.col("close"))
    return F.try_divide(close(a), close(b)) - 1


def _illiquidity() -> Column:
    x = F.when(finite(F.col("amount")) > 0, F.abs(finite(F.col("ret"))) / F.col("amount"))
    return full_window(F.avg(x), x, _back(20), 20)


def _rolling(c: str, n: int) -> Column:
    x = finite(F.col(c))
    return full_window(F.avg(x), x, _back(n), n)


def _range_position() -> Column:
    lo, hi = F.col("__lo"), F.col("__hi")
    return F.try_divide(finite(F.col("close")) - lo, hi - lo)


def with_range(bars: DataFrame, n: int) -> DataFrame:
    """bars with the least low and the greatest high of the last n rows, __lo and __hi, missing unless all are there.

    Spans of some rows are put together from shorter ones, by the prime factors of n: a frame of n rows would be gone through for every row.
    """
    x, wide = bars.withColumns({"__lo": finite(F.col("low")), "__hi": finite(F.col("high"))}), 1
    while wide < n:
        times = next(k for k in range(2, n // wide + 1) if n // wide % k == 0)
        spans = lambda c: [F.col(c), *[F.lag(c, wide * k).over(series()) for k in range(1, times)]]  # noqa: B023, E731
        whole = lambda c: reduce(and_, (s.isNotNull() for s in spans(c)))
        x = x.withColumns({"__lo": F.when(whole("__lo"), F.least(*spans("__lo"))), "__hi": F.when(whole("__hi"), F.greatest(*spans("__hi")))})
        wide *= times
    return x


#: name: (column over bars with ret and range, hypothesis, used by default). The registry of factors: each is a window expression.
FACTORS: dict[str, tuple[Callable[[], Column], str, bool]] = {
    "mom_20_1": (lambda: _ratio(1, 21), "+", True),
    "mom_60_5": (lambda: _ratio(5, 65), "+", True),
    "rev_5": (lambda: -_ratio(0, 5), "+", True),
    "vol_20": (lambda: full_window(F.stddev_samp(finite(F.col("ret"))), finite(F.col("ret")), _back(20), 20), "-", True),
    "turn_20": (lambda: _rolling("turnover_rate", 20), "-", True),
    "turn_ratio_5_60": (lambda: F.try_divide(_rolling("turnover_rate", 5), _rolling("turnover_rate", 60)), "-", True),
    "range_pos_252": (_range_position, "+", False),
    "amihud_20": (_illiquidity, "research", True),
}


#: Bars that a factor needs before its first value, its own among them.
HISTORY = {"mom_20_1": 22, "mom_60_5": 66, "rev_5": 6, "vol_20": 21, "turn_20": 20, "turn_ratio_5_60": 60, "range_pos_252": 252, "amihud_20": 21}


def size_proxy() -> Column:
    m = _rolling("amount", 20)
    return F.when(m > 0, F.log(m))


def factor_panel(bars: DataFrame, names: list[str] | None = None, horizons: tuple[int, ...] = (1,)) -> DataFrame:
    """bars with ret, size, fwd_<h> and a column for each factor: one pass over the symbols' rows, one shuffle."""
    names = names or [n for n, f in FACTORS.items() if f[2]]
    cols = {"size": size_proxy(), **{f"fwd_{h}": forward_return(h) for h in horizons}, **{n: FACTORS[n][0]() for n in names}}
    x = with_returns(bars)
    return with_range(x, HISTORY["range_pos_252"]).withColumns(cols).drop("__lo", "__hi") if "range_pos_252" in names else x.withColumns(cols)


def first_rows(panel: DataFrame, names: list[str]) -> DataFrame:
    """factor_name, symbols, first_row: symbols with a value, and the least place in a symbol's history at which a factor has one."""
    x = panel.withColumn("__i", F.row_number().over(series())).select("symbol", "__i", F.explode(F.array(*[F.struct(F.lit(n).alias("factor_name"), F.col(n).alias("v")) for n in names])).alias("x")).where("x.v is not null")
    return x.groupBy("x.factor_name").agg(F.count_distinct("symbol").alias("symbols"), F.min("__i").alias("first_row"))


def long_sections(panel: DataFrame, names: list[str], horizon: int, least: int, keep: list[str] | None = None) -> DataFrame:
    """factor_name, date, symbol, factor, fwd, fr, rr: the pairs that are there of dates with at least `least` names, with their average ranks."""
    x = panel.select("date", "symbol", F.col(f"fwd_{horizon}").alias("fwd"), *(keep or []), F.explode(F.array(*[F.struct(F.lit(n).alias("factor_name"), F.col(n).alias("factor")) for n in names])).alias("x"))
    x = x.select("x.*", "date", "symbol", finite(F.col("fwd")).alias("fwd"), *(keep or [])).withColumn("factor", finite(F.col("factor")))
    by = ["factor_name", "date"]
    # Counted in the order of the rank, so that one sort serves both.
    every = Window.partitionBy(*by).orderBy("factor").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.where("factor is not null and fwd is not null").withColumns({"names": F.count("*").over(every), "fr": average_rank(F.col("factor"), by)}).where(F.col("names") >= least)
    return x.withColumn("rr", average_rank(F.col("fwd"), by))


def kept_dates(panel: DataFrame, names: list[str], horizon: int, least: int) -> DataFrame:
    """factor_name, dates, kept_dates: dates of the panel, and those of them that are sections; counted by date, with no row for a name and a factor."""
    there = lambda n: F.count_if(finite(F.col(n)).isNotNull() & finite(F.col(f"fwd_{horizon}")).isNotNull())
    x = panel.groupBy("date").agg(*[there(n).alias(n) for n in names]).where("date is not null")
    x = x.select(F.explode(F.array(*[F.struct(F.lit(n).alias("factor_name"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")
    return x.groupBy("factor_name").agg(F.count("*").alias("dates"), F.count_if(F.col("n") >= least).alias("kept_dates"))


def strided(sections: DataFrame, horizon: int) -> DataFrame:
    """Every horizon-th surviving date of each factor, so that returns do not overlap."""
    dates = sections.select("factor_name", "date").distinct().withColumn("no", F.row_number().over(Window.partitionBy("factor_name").orderBy("date")) - 1)
    return sections.join(dates.where(F.col("no") % horizon == 0), ["factor_name", "date"])


def rank_ic(sections: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ic for each factor and date: correlation of the average ranks."""
    return sections.groupBy(*(by or ["factor_name"]), "date").agg(F.count("*").alias("names"), pearson("fr", "rr").alias("ic"))


def winsorise(panel: DataFrame, c: str, how: str) -> Column:
    """Bounds of c per date as window expressions, and c within them: mad (5 deviations), iqr (3 ranges), quantile (1% to 99%)."""
    w = Window.partitionBy("date")
    q = lambda p: F.percentile(F.col(c), F.lit(p)).over(w)
    if how == "iqr":
        low, high = q(0.25) - 3 * (q(0.75) - q(0.25)), q(0.75) + 3 * (q(0.75) - q(0.25))
    elif how == "quantile":
        low, high = q(0.01), q(0.99)
    else:
        raise ValueError(how)
    return F.when(F.col(c).isNotNull(), F.greatest(low, F.least(high, F.col(c))))


def winsorise_mad(df: DataFrame, c: str) -> DataFrame:
    w = Window.partitionBy("date")
    df = df.withColumn("__m", F.percentile(F.col(c), F.lit(0.5)).over(w)).withColumn("__d", F.abs(F.col(c) - F.col("__m")))
    df = df.withColumn("__mad", F.percentile(F.col("__d"), F.lit(0.5)).over(w))
    inside = F.greatest(F.col("__m") - 5 * F.col("__mad"), F.least(F.col("__m") + 5 * F.col("__mad"), F.col(c)))
    return df.withColumn(c, F.when(F.col(c).isNotNull(), inside)).drop("__m", "__d", "__mad")


def winsor(df: DataFrame, c: str, how: str = "mad") -> DataFrame:
    return winsorise_mad(df, c) if how == "mad" else df.withColumn(c, winsorise(df, c, how))


def standardise(df: DataFrame, c: str, how: str = "zscore") -> DataFrame:
    """c per date as zscore (population), robust_zscore or centred rank; a scale of zero gives 0."""
    w = Window.partitionBy("date")
    if how == "rank":
        n = F.count(c).over(w)
        return df.withColumn(c, (average_rank(F.col(c), ["date"]) - (n + 1) / 2.0) / F.greatest(n, F.lit(1)))
    if how == "robust_zscore":
        df = df.withColumn("__m", F.percentile(F.col(c), F.lit(0.5)).over(w)).withColumn("__d", F.abs(F.col(c) - F.col("__m")))
        mid, scale = F.col("__m"), F.percentile(F.col("__d"), F.lit(0.5)).over(w) * 1.4826
    else:
        mid, scale = F.avg(c).over(w), F.stddev_pop(c).over(w)
    return df.withColumn(c, F.when(scale > 0, (F.col(c) - mid) / scale).when(F.col(c).isNotNull(), 0.0)).drop("__m", "__d")


def neutralise(df: DataFrame, c: str, size: str = "size", sector: str | None = "sector") -> DataFrame:
    """Residual of c: first less its sector's mean of the date, then on size over the date. Missing sizes are 0, missing sectors one sector."""
    w = Window.partitionBy("date")
    if sector:
        df = df.withColumn(c, F.col(c) - F.avg(c).over(Window.partitionBy("date", F.coalesce(F.col(sector), F.lit("unknown")))))
    df = df.withColumn("__s", F.when(F.col(c).isNotNull(), F.coalesce(finite(F.col(size)), F.lit(0.0))))
    beta = F.coalesce(F.try_divide(F.covar_pop(F.col(c), F.col("__s")).over(w), F.var_pop("__s").over(w)), F.lit(0.0))
    return df.withColumn(c, F.col(c) - F.avg(c).over(w) - beta * (F.col("__s") - F.avg("__s").over(w))).drop("__s")


def preprocess(df: DataFrame, c: str, winsor_how: str = "quantile", standard_how: str = "zscore", sector: str | None = "sector") -> DataFrame:
    """Winsorise, neutralise, standardise, in this order, each within its date."""
    return standardise(neutralise(winsor(df, c, winsor_how), c, sector=sector), c, standard_how)


def _mean_ic_by_trial(ics: DataFrame, by: list[str]) -> DataFrame:
    return ics.where("ic is not null").groupBy(*by, "trial").agg(F.avg("ic").alias("trial_ic"))


def _draw(seed: Column | int, *parts: Column) -> Column:
    """The same text in every run, on any partitioning, for what is drawn."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], (seed if isinstance(seed, Column) else F.lit(seed)).cast("string")))


def shuffle_null(sections: DataFrame, trials: int, seed: Column | int = 7, by: list[str] | None = None) -> DataFrame:
    """factor_name, trial, trial_ic: in each date the factor ranks are dealt anew among the names, by the order of an md5 of (trial, date, symbol, seed).

    The panel is shuffled once, by date and seed: what is drawn there is the same for every factor, so a name's digests are worked out
    once for all of them. All trials are dealt inside the task, one after the other, as arrays as long as a date has names, so neither
    rows nor shuffles grow with the trials. Means and spreads of the ranks are the same in every trial: only the sum of products is
    counted anew.
    """
    by = by or ["factor_name"]
    s = sections.select(*by, "date", "symbol", "fr", "rr", (seed if isinstance(seed, Column) else F.lit(seed)).cast("string").alias("__seed"))
    # The texts that are drawn by are Spark's own.
    s = s.select(*by, "date", "fr", "rr", "__seed", F.concat_ws("|", F.lit(""), F.col("date").cast("string"), F.col("symbol").cast("string"), "__seed").alias("__tail"))
    kinds = ", ".join(f"{c} {sections.schema[c].dataType.simpleString()}" for c in by)

    def deal(rows: pa.Table) -> pa.Table:
        encoded = rows["__tail"].combine_chunks().dictionary_encode()
        tails, code = [t.encode() for t in encoded.dictionary.to_pylist()], encoded.indices.to_numpy()
        own = np.zeros(len(code), dtype=np.int64)
        for c in by:
            k = rows[c].combine_chunks().dictionary_encode(null_encoding="encode")
            own = own * len(k.dictionary) + k.indices.to_numpy()
        fr, rr = rows["fr"].to_numpy(), rows["rr"].to_numpy()
        at = np.lexsort((rr, own))
        parts = np.split(at, np.flatnonzero(np.diff(own[at])) + 1)
        held = []
        for p in parts:
            f, r, c = np.sort(fr[p]), rr[p], code[p]
            held.append((f, r, c, f.std() * r.std(), len(np.unique(c)) == len(c)))
        ic = np.full((len(parts), trials), np.nan)
        place, slot = np.empty(len(tails), dtype=np.int64), np.empty(len(tails), dtype=np.int64)
        for t in range(trials if any(x[3] > 0 for x in held) else 0):
            head = str(t).encode()
            keys = np.frombuffer(b"".join([md5(head + x).digest() for x in tails]), dtype=">u8").reshape(-1, 2)
            order = np.argsort(keys[:, 0].astype(np.uint64), kind="stable")
            first = keys[order, 0]
            if (first[1:] == first[:-1]).any():  # the other half decides
                order = np.lexsort((keys[:, 1].astype(np.uint64), keys[:, 0].astype(np.uint64)))
            place[order] = np.arange(len(tails))
            for n, (f, r, c, spread, once) in enumerate(held):
                if not spread > 0:
                    continue
                if once:  # the names of this part, in the order of all
                    slot[:] = -1
                    slot[place[c]] = np.arange(len(c))
                    dealt = r[slot[slot >= 0]]
                else:
                    dealt = r[np.argsort(place[c], kind="stable")]
                ic[n, t] = ((f * dealt).mean() - f.mean() * r.mean()) / spread
        lead = rows.select(by).take(pa.array(np.repeat([p[0] for p in parts], trials)))
        return lead.append_column("trial", pa.array(np.tile(np.arange(trials, dtype=np.int32), len(parts)))).append_column("ic", pa.array(ic.ravel()))

    ics = s.groupBy("date", "__seed").applyInArrow(deal, f"{kinds}, trial int, ic double")
    return _mean_ic_by_trial(ics.where(~F.isnan("ic")), by)


#: Rows of series that a task turns at once.
TURNED_ROWS = 500_000


def circular_null(sections: DataFrame, trials: int, seed: Column | int = 7, by: list[str] | None = None) -> DataFrame:
    """factor_name, trial, trial_ic: each symbol's series of factor ranks is rotated by an offset of its own, from 2 to T - 2, then ranked anew per date.

    Symbols with fewer than 4 sections take no part. Two shuffles of the panel: by symbol, where every date gets what each trial's
    rotation brings it, and by date, where a task ranks the trials of a section side by side as the columns of a matrix (names by
    trials). Between them go blocks, one for each date and stretch of series, whose ranks are packed by bytes (_packed), so that a rank
    of a trial takes as many bytes as its digits need; rows do not grow with the trials.
    """
    by = by or ["factor_name"]
    series_ = sections.withColumn("__seed", seed if isinstance(seed, Column) else F.lit(seed)).groupBy(*by, "symbol").agg(F.array_sort(F.collect_list(F.struct("date", "fr", "rr"))).alias("s"), F.first("__seed").alias("seed")).where(F.size("s") >= 4)
    t = F.size("s")
    number = lambda trial: F.conv(F.substring(_draw(F.col("seed"), trial, F.col("symbol")), 1, 8), 16, 10).cast("long")
    offsets = F.transform(F.sequence(F.lit(0), F.lit(trials - 1)), lambda k: 2 + number(k) % (t - 3))
    series_ = series_.select(*by, F.col("s.date").alias("date"), F.col("s.fr").alias("fr"), F.col("s.rr").alias("rr"), offsets.alias("offsets"))
    day, kinds = sections.schema["date"].dataType.simpleString(), ", ".join(f"{c} {sections.schema[c].dataType.simpleString()}" for c in by)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(np.asarray(batch["fr"].value_lengths()))
            cuts = np.flatnonzero(np.diff(ends // TURNED_ROWS)) + 1 if len(ends) else ends
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                yield from _turned(batch.slice(begin, end - begin), by)

    def ranked(rows: pa.Table) -> pa.Table:
        sizes = rows["names"].to_pylist()
        a = np.vstack([_unpacked(v, n, trials) for v, n in zip(rows["turned"].to_pylist(), sizes, strict=True)])
        b = np.vstack([_unpacked(v, n, 1) for v, n in zip(rows["rr"].to_pylist(), sizes, strict=True)])
        a, b = (_column_ranks(m) for m in (a, b))
        a, b = a - a.mean(axis=0), b - b.mean()
        with np.errstate(divide="ignore", invalid="ignore"):
            ic = (a * b).sum(axis=0) / np.sqrt((a * a).sum(axis=0) * (b * b).sum())
        return rows.select(by).take(pa.array(np.zeros(trials, dtype=np.int64))).append_column("trial", pa.array(np.arange(trials, dtype=np.int32))).append_column("ic", pa.array(ic))

    x = series_.mapInArrow(turn, f"{kinds}, date {day}, names int, turned binary, rr binary")
    ics = x.groupBy(*by, "date").applyInArrow(ranked, f"{kinds}, trial int, ic double")
    return _mean_ic_by_trial(ics.where(~F.isnan("ic")), by)


def _turned(batch: pa.RecordBatch, by: list[str]) -> Iterator[pa.RecordBatch]:
    """Of whole series (by, date, fr, rr, offsets): by, date, names, and packed for these names what each trial's rotation brings them, and rr."""
    sizes = np.asarray(batch["fr"].value_lengths())
    if not sizes.sum():
        return
    fr, rr = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("fr", "rr"))
    dates = batch["date"].flatten().dictionary_encode()
    own = np.zeros(len(sizes), dtype=np.int64)
    for c in by:
        k = batch[c].dictionary_encode(null_encoding="encode")
        own = own * len(k.dictionary) + k.indices.to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = (np.cumsum(sizes) - sizes)[row]
    offsets = batch["offsets"].flatten().to_numpy().reshape(len(sizes), -1)
    code = own[row] * len(dates.dictionary) + dates.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    place, length, start, row = (v[order] for v in (np.arange(len(row)) - start, sizes[row], start, row))
    turned = np.stack([fr[start + (place - offsets[row, k]) % length] for k in range(offsets.shape[1])], axis=1)
    cuts = np.flatnonzero(np.diff(code[order])) + 1
    firsts = np.concatenate([[0], cuts])
    lead = [batch[c].take(pa.array(row[firsts])) for c in by] + [dates.dictionary.take(dates.indices.take(pa.array(order[firsts])))]
    blocks = [[_packed(m) for m in np.split(v, cuts)] for v in (turned, rr[order][:, None])]
    counts = np.diff(np.concatenate([firsts, [len(row)]])).astype(np.int32)
    yield pa.RecordBatch.from_arrays([*lead, pa.array(counts), *[pa.array(v, pa.binary()) for v in blocks]], names=[*by, "date", "names", "turned", "rr"])


def _packed(m: np.ndarray) -> bytes:
    """Ranks (multiples of a half) as whole numbers of the fewest bytes, all first bytes, then all second ones; any other numbers as doubles."""
    twice = 2.0 * m
    if not ((twice >= 0) & (twice < 2**32) & (twice == np.floor(twice))).all():
        return m.astype("<f8").tobytes()
    wide = max(1, (int(twice.max()).bit_length() + 7) // 8)
    return np.ascontiguousarray(twice.astype("<u4").reshape(-1, 1).view(np.uint8)[:, :wide].T).tobytes()


def _unpacked(packed: bytes, names: int, trials: int) -> np.ndarray:
    """The matrix of _packed, names by trials."""
    wide = len(packed) // (names * trials)
    if wide == 8:
        return np.frombuffer(packed, dtype="<f8").reshape(names, trials)
    parts = np.frombuffer(packed, dtype=np.uint8).reshape(wide, -1)
    return sum(parts[k].astype(np.int64) << 8 * k for k in range(wide)).reshape(names, trials) / 2.0


def _column_ranks(m: np.ndarray) -> np.ndarray:
    """Rank from 1 within every column, ties sharing the mean of their places."""
    order = np.argsort(m, axis=0, kind="stable")
    s, at = np.take_along_axis(m, order, axis=0), np.arange(len(m))[:, None]
    begins = np.vstack([np.ones((1, m.shape[1]), dtype=bool), s[1:] != s[:-1]])
    first = np.maximum.accumulate(np.where(begins, at, 0), axis=0)
    ends = np.vstack([begins[1:], np.ones((1, m.shape[1]), dtype=bool)])
    last = np.minimum.accumulate(np.where(ends, at, len(m))[::-1], axis=0)[::-1]
    out = np.empty(m.shape)
    np.put_along_axis(out, order, (first + last) / 2.0 + 1.0, axis=0)
    return out


def ic_statistics(ics: DataFrame, by: list[str]) -> DataFrame:
    """mean_ic, ic_std, icir, t_stat, p_value, positive_ic_share, section_count of the dates' ic."""
    x = ics.where("ic is not null").groupBy(*by).agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("ic_std"), F.count("*").alias("section_count"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_ic_share"))
    t = F.try_divide(F.col("mean_ic"), F.col("ic_std") / F.sqrt("section_count"))
    return x.withColumns({"icir": F.try_divide("mean_ic", "ic_std"), "t_stat": t, "p_value": erfc(F.abs(t) / 2**0.5)})


def with_null(stats: DataFrame, null: DataFrame, by: list[str] | None = None) -> DataFrame:
    """stats with random_ic_mean, random_ic_std and alpha_t, the distance of mean_ic from the random controls in their deviations."""
    by = by or ["factor_name"]
    n = null.groupBy(*by).agg(F.avg("trial_ic").alias("random_ic_mean"), F.stddev_samp("trial_ic").alias("random_ic_std"))
    return stats.join(n, by, "left").withColumn("alpha_t", F.try_divide(F.col("mean_ic") - F.col("random_ic_mean"), F.col("random_ic_std")))


def split_sections(sections: DataFrame, share: float) -> DataFrame:
    """part: train for the first share of each factor's dates (at least 1, at most all but 1), else test."""
    dates = sections.select("factor_name", "date").distinct()
    all_ = Window.partitionBy("factor_name")
    n = F.count("*").over(all_)
    cut = F.greatest(F.lit(1), F.least(n - 1, F.floor(n * share)))
    dates = dates.withColumn("part", F.when(F.row_number().over(all_.orderBy("date")) <= cut, "train").otherwise("test"))
    return sections.join(dates, ["factor_name", "date"])


#: What an evaluation tells of each scope, and of the whole only.
STATS = ("mean_ic", "ic_std", "icir", "t_stat", "p_value", "random_ic_mean", "random_ic_std", "alpha_t", "positive_ic_share")


def evaluate(panel: DataFrame, names: list[str], horizon: int = 1, trials: int = 100, seed: int = 7, least: int = 30, min_dates: int = 40, share: float = 0.7, stride: int = 1, null: str = "shuffle", sections: DataFrame | None = None) -> DataFrame:
    """One row for each factor: status, gaps, counts, statistics overall and of the train and test dates against random controls of their own seeds.

    It fails closed: where too few sections are left (insufficient_effective_sections), more than 30% of the dates have too few names
    (excessive_cross_section_exclusions), or a section has too few names for the controls (insufficient_null_cross_section), status is
    insufficient_data and every statistic missing. Names whose history mixes sources (a column null_eligible that is false) and, under
    rotation, series of fewer than 4 sections take no part in the controls; the gaps say so (cross_source_panel_excluded_from_null,
    circular_series_too_short). Parameters out of range raise ValueError. sections: those of the panel, where they are written already.
    """
    eligible = "null_eligible" in panel.columns
    kept = long_sections(panel, names, horizon, least, ["null_eligible"] if eligible else None) if sections is None else sections
    totals = panel.groupBy().agg(F.count_distinct("date").alias("total_dates")).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("factor_name"), "total_dates")
    return evaluate_sections(kept, totals, trials, seed, least, min_dates, share, stride, null, sections is not None)


def evaluate_sections(sections: DataFrame, totals: DataFrame, trials: int = 100, seed: int = 7, least: int = 30, min_dates: int = 40, share: float = 0.7, stride: int = 1, null: str = "shuffle", held: bool = False) -> DataFrame:
    """evaluate over sections that are there already (of long_sections, perhaps with null_eligible; held: written, too); totals: factor_name and how many dates could have had one."""
    if trials < 2 or least < 2 or min_dates < 1 or stride < 1 or not 0 < share < 1 or null not in ("shuffle", "circular"):
        raise ValueError("invalid evaluation parameters")
    eligible = "null_eligible" in sections.columns
    # Gates, statistics and controls all start from the sections: they are worked out once.
    kept = sections if held else written(sections, "sections")
    used = strided(kept, stride) if stride > 1 else kept
    # Every section stands for the whole and for its own part.
    by = ["factor_name", "scope"]
    x = split_sections(used, share).withColumn("scope", F.explode(F.array(F.lit("overall"), F.col("part"))))
    control = F.coalesce(F.col("null_eligible"), F.lit(True)) if eligible else F.lit(True)
    x = x.withColumn("mixed", ~control)
    short = F.lit(False)
    if null == "circular":
        # Short series are few: they are counted, and the rows themselves stay where they are.
        ends = written(x.groupBy(*by, "symbol").agg(F.count("*").alias("n")).where("n < 4").select(*by, "symbol", F.lit(True).alias("__short")), "short")
        x, short = x.join(hinted(ends), [*by, "symbol"], "left"), F.coalesce("__short", F.lit(False))
    x = x.withColumn("short", ~F.col("mixed") & short).withColumn("control", ~F.col("mixed") & ~F.col("short"))
    by_date = x.groupBy(*by, "date").agg(F.count("*").alias("names"), F.count_if("control").alias("n"), F.max("mixed").alias("mixed"), F.max("short").alias("short"))
    leaves = eligible or null == "circular"
    by_date = written(by_date, "dates") if leaves else by_date
    thin = by_date
    thin = thin.groupBy("factor_name").agg(F.min("n").alias("fewest"), F.max("mixed").alias("mixed"), F.max("short").alias("short"), F.count_if(F.col("scope") == "overall").alias("effective_sections"))
    raw = kept.groupBy("factor_name").agg(F.count_distinct("date").alias("raw_sections"))
    g = totals.join(raw, "factor_name", "left").join(thin, "factor_name", "left").na.fill(0, ["raw_sections", "effective_sections"]).withColumn("excluded_dates", F.col("total_dates") - F.col("raw_sections"))
    few, many = F.col("effective_sections") < min_dates, (F.col("total_dates") == 0) | (F.col("excluded_dates") > 0.30 * F.col("total_dates"))
    starved = ~few & ~many & (F.col("fewest") < least)
    told = F.array_compact(F.array(
        F.when(few, "insufficient_effective_sections"), F.when(many, "excessive_cross_section_exclusions"), F.when(starved, "insufficient_null_cross_section"),
        F.when(~few & ~many & F.col("mixed"), "cross_source_panel_excluded_from_null"), F.when(starved & F.col("short"), "circular_series_too_short"),
    ))
    g = g.select("factor_name", F.when(few | many | starved, "insufficient_data").otherwise("ok").alias("status"), told.alias("gaps"), "total_dates", "excluded_dates", "effective_sections")
    if leaves:  # in sections that names leave the others' ranks close up
        fewer, own = hinted(by_date.where("n < names").select(*by, "date"), 100_000), [*by, "date"]
        ranks = {c: average_rank(F.col(c), own) for c in ("fr", "rr")}
        y = x.where("control")
        y = y.join(fewer, own, "left_anti").unionByName(y.join(fewer, own, "left_semi").withColumns(ranks))
    else:
        y = x
    own_seed = F.when(F.col("scope") == "train", seed + 1).when(F.col("scope") == "test", seed + 2).otherwise(seed)
    controls = (shuffle_null if null == "shuffle" else circular_null)(y, trials, own_seed, by)
    st = with_null(ic_statistics(rank_ic(x, by), by), controls, by)
    of = lambda scope, c: F.max(F.when(F.col("scope") == scope, F.col(c)))
    wide = st.groupBy("factor_name").agg(*[of("overall", c).alias(c) for c in STATS], *[of(p, c).alias(f"{p}_{c}") for p in ("train", "test") for c in ("mean_ic", "alpha_t")])
    out = g.join(wide, "factor_name", "left")
    return out.select(*g.columns, *[F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in wide.columns if c != "factor_name"])


def verdict(evaluated: DataFrame, threshold: float = 3.5, directions: dict[str, str] | None = None) -> DataFrame:
    """state: confirmed_alive, train_only, reversed_strict or noise by the signed distances; null where a statistic is missing.

    directions: the hypothesis of each factor, + or - or research (which has no opposite, so is never reversed); by default that of FACTORS.
    """
    known = directions or {n: f[1] for n, f in FACTORS.items()}
    way = F.lit("")
    for n, d in known.items():
        way = F.when(F.col("factor_name") == n, d).otherwise(way)
    sign = F.when(way == "-", -1.0).otherwise(1.0)
    a, tr, te = (finite(F.col(c)) * sign for c in ("alpha_t", "train_alpha_t", "test_alpha_t"))
    against = lambda ic: way.isin("+", "-") & (ic * sign < 0)
    missing = a.isNull() | tr.isNull() | te.isNull() | finite(F.col("random_ic_mean")).isNull() | finite(F.col("train_mean_ic")).isNull() | finite(F.col("test_mean_ic")).isNull()
    state = (
        F.when(missing, None)
        .when((tr >= threshold) & (te >= threshold) & (F.col("train_mean_ic") * F.col("test_mean_ic") > 0), "confirmed_alive")
        .when((tr >= threshold) & (te < threshold), "train_only")
        .when((a <= -threshold) & (te <= -threshold) & against(F.col("mean_ic")) & against(F.col("test_mean_ic")), "reversed_strict")
        .otherwise("noise")
    )
    return evaluated.withColumn("state", state)


def autocorrelation(sections: DataFrame) -> DataFrame:
    """Correlation of the factor's ranks on adjacent dates, over the names that both dates have."""
    dates = sections.select("factor_name", "date").distinct().withColumn("next", F.lead("date").over(Window.partitionBy("factor_name").orderBy("date")))
    a = sections.select("factor_name", "date", "symbol", "factor").join(dates, ["factor_name", "date"])
    b = sections.select("factor_name", F.col("date").alias("next"), "symbol", F.col("factor").alias("later"))
    by = ["factor_name", "date"]
    both = a.join(b, ["factor_name", "next", "symbol"]).withColumns({"x": average_rank(F.col("factor"), by), "y": average_rank(F.col("later"), by)})
    return both.groupBy(*by).agg(F.count("*").alias("names"), pearson("x", "y").alias("autocorrelation"))


def attribution(panel: DataFrame, factor: str, fwd: str = "fwd_1", least: int = 4) -> DataFrame:
    """alpha, beta_size, beta_factor of each date: return on standardised size and factor, in closed form."""
    x = panel.select("date", *[finite(F.col(c)).alias(k) for c, k in ((factor, "f"), ("size", "s"), (fwd, "r"))]).where("f is not null and s is not null and r is not null")
    x = standardise(standardise(x, "f"), "s")
    g = x.groupBy("date").agg(F.count("*").alias("n"), F.avg("r").alias("alpha"), F.var_pop("s").alias("ss"), F.var_pop("f").alias("ff"), F.covar_pop("s", "f").alias("sf"), F.covar_pop("s", "r").alias("sr"), F.covar_pop("f", "r").alias("fr"))
    d = F.col("ss") * F.col("ff") - F.col("sf") * F.col("sf")
    ok = (F.col("n") >= least) & (d > 1e-9)
    cut = lambda c: F.when(ok, c)
    return g.select("date", "n", cut(F.col("alpha")).alias("alpha"), cut(F.try_divide(F.col("sr") * F.col("ff") - F.col("fr") * F.col("sf"), d)).alias("beta_size"), cut(F.try_divide(F.col("fr") * F.col("ss") - F.col("sr") * F.col("sf"), d)).alias("beta_factor"))


def screen(panel: DataFrame, names: list[str], floor: int = 2, null_limit: int = 3) -> DataFrame:
    """Latest row of each symbol: vote by the signs of its factors' z-scores in their hypothesised direction, edge_status, watch rank."""
    last = panel.withColumn("__n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("__n = 1").select("symbol", *[finite(F.col(n)).alias(n) for n in names])
    # Means and spreads are one row beside the symbols.
    moments = last.agg(*[x for n in names for x in (F.avg(n).alias(f"__m_{n}"), F.stddev_pop(n).alias(f"__s_{n}"))])
    last = last.join(F.broadcast(moments))
    side = lambda n: F.when(F.col(f"__s_{n}") > 0, F.signum(F.col(n) - F.col(f"__m_{n}"))).otherwise(0.0)
    sign = {n: (-1 if FACTORS[n][1] == "-" else 1) for n in names}
    nulls = sum((F.col(n).isNull().cast("int") for n in names), F.lit(0))
    vote = sum((F.coalesce(F.when(F.col(n).isNotNull(), side(n)) * sign[n], F.lit(0.0)).cast("int") for n in names), F.lit(0))
    out = last.select("symbol", nulls.alias("null_count"), vote.alias("vote"))
    status = F.when(F.col("null_count") >= null_limit, f"null_factors>={null_limit}").when(F.abs("vote") < floor, "no_edge").otherwise("edge")
    out = out.withColumn("edge_status", status)
    order = Window.partitionBy(F.col("edge_status") == "edge").orderBy(F.desc(F.abs("vote")), F.desc("vote"), "symbol")
    return out.withColumn("watch_rank", F.when(F.col("edge_status") == "edge", F.row_number().over(order)))


def backtest(panel: DataFrame, factor: str, bins: int = 5, every: int = 5, shift: int = 1, least: int = 30, fee_bps: float = 3, slip_bps: float = 5, stamp_bps: float = 5) -> DataFrame:
    """epoch, bin, gross_return, turnover, sell_turnover, cost, net_return: rank bins formed shift dates before entry, held for every dates.

    A position is settled at its last price up to the exit date. Turnover is against the previous kept epoch's weights, drifted by
    their returns. Epochs with too few names are left out before they are numbered.
    """
    # One row a date: entries, exits and forming dates are neighbours in the calendar.
    cal = Window.partitionBy(F.lit(0)).orderBy("date")
    last_date = F.last("date").over(cal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    slots = panel.select("date").distinct().select(
        (F.row_number().over(cal) - 1).alias("entry"), F.col("date").alias("entry_date"), F.coalesce(F.lead("date", every).over(cal), last_date).alias("exit_date"), F.lag("date", shift).over(cal).alias("form_date"),
    ).where((F.col("entry") >= shift) & ((F.col("entry") - shift) % every == 0) & (F.col("exit_date") > F.col("entry_date")))
    close = panel.select("symbol", "date", finite(F.col("close")).alias("close"), finite(F.col(factor)).alias("factor"))
    formed = close.join(slots, close["date"] == slots["form_date"]).where("factor is not null").select("symbol", "factor", "entry", "entry_date", "exit_date")
    entered = close.where("close is not null").select("symbol", F.col("date").alias("entry_date"), F.col("close").alias("entry_close"))
    held = formed.join(entered, ["symbol", "entry_date"]).withColumn("names", F.count("*").over(Window.partitionBy("entry"))).where(F.col("names") >= max(least, bins))
    held = held.withColumn("bin", rank_bin(F.col("factor"), F.col("symbol"), ["entry"], bins) + 1)
    epochs = held.select("entry").distinct().withColumn("epoch", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("entry")))
    # The last price up to the exit: the prices before the entry are none of the position's.
    last = as_of(held.select("symbol", "entry", "bin", "entry_date", "exit_date", "entry_close"), close.where("close > 0").select("symbol", "date", "close"), "exit_date", True)
    last = last.where("base_date >= entry_date").select("entry", "bin", "symbol", "entry_close", F.col("base_close").alias("last_close"))
    w = Window.partitionBy("entry", "bin")
    pos = last.join(epochs, "entry").withColumns({"ret": F.col("last_close") / F.col("entry_close") - 1, "weight": 1.0 / F.count("*").over(w)})
    grown = F.col("weight") * (1 + F.col("ret"))
    pos = pos.withColumn("drifted", F.try_divide(grown, F.sum(grown).over(w)))
    before = pos.select((F.col("epoch") + 1).alias("epoch"), "bin", "symbol", F.col("drifted").alias("old"))
    total = epochs.agg(F.max("epoch").alias("top"))
    moves = pos.select("epoch", "bin", "symbol", "weight", "ret").join(before, ["epoch", "bin", "symbol"], "full_outer").join(F.broadcast(total), F.col("epoch") <= F.col("top"))
    change = F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))
    g = moves.groupBy("epoch", "bin").agg(F.avg("ret").alias("gross_return"), F.sum(F.abs(change)).alias("turnover"), F.sum(F.greatest(-change, F.lit(0.0))).alias("sell_turnover"), F.count("ret").alias("names"))
    g = g.withColumn("cost", F.col("turnover") * (fee_bps + slip_bps) / 10000.0 + F.col("sell_turnover") * stamp_bps / 10000.0)
    return g.withColumn("net_return", F.col("gross_return") - F.col("cost"))


def performance(returns: DataFrame, by: list[str], order: str, value: str, per_year: float) -> DataFrame:
    """total_return, annualized_return, annualized_volatility, sharpe, max_drawdown, periods of a return series for each key."""
    run = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = returns.where(F.col(value).isNotNull()).withColumn("nav", F.product(1 + F.col(value)).over(run))
    x = x.withColumn("dd", F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(run)) - 1)
    g = x.groupBy(*by).agg(F.count("*").alias("periods"), F.max_by("nav", order).alias("nav"), F.stddev_samp(value).alias("sd"), F.avg(value).alias("m"), F.least(F.lit(0.0), F.min("dd")).alias("max_drawdown"))
    vol = F.col("sd") * per_year**0.5
    return g.select(*by, "periods", (F.col("nav") - 1).alias("total_return"), F.when(F.col("nav") > 0, F.pow("nav", per_year / F.col("periods")) - 1).alias("annualized_return"), vol.alias("annualized_volatility"), F.try_divide(F.col("m") * per_year, vol).alias("sharpe"), "max_drawdown")
