"""Exact quantiles of groups of any size, by refining histograms: no task ever holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.sources.shared import few, written

#: Buckets of an interval in a round; an interval with at most so many rows is sorted; rounds after which an interval is too.
BUCKETS, SORTED, ROUNDS = 1024, 20_000, 40


def exact_quantiles(rows: DataFrame, by: list[str], value: str, probabilities: dict[str, float], sorted_rows: int = SORTED) -> DataFrame:
    """by, n and a column for each named probability: quantiles with linear interpolation, as of all non-missing values of the group.

    A quantile lies between two order statistics. Each is looked for in an interval of values, first the group's whole range: a round
    counts the rows of every interval by bucket (tasks add up before anything is shuffled) and keeps the bucket that holds the wanted
    rank. Intervals of one value are found; those with few rows are ranked at last. Groups without values have no row.
    """
    v = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).cast("double").alias("__v"))
    sizes = written(v.groupBy(*by).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")), "sizes")
    place = lambda p: (F.col("n") - 1) * F.lit(p)
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in probabilities.values()])))
    # What a rank is looked for in: values from lo to hi, `before` rows of the group below them.
    open_ = sizes.select(*by, "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("rows"), F.explode(wanted).alias("rank"))
    at = lambda d: d.select(*by, "lo", "hi", "rank", "before", "rows")
    found, done = None, at(open_)
    for _ in range(ROUNDS):
        done = written(done, "ranks")
        now = done.where("lo = hi").select(*by, "rank", F.col("lo").alias("v"))
        found = now if found is None else found.unionByName(now)
        left = done.where(f"lo < hi and rows > {sorted_rows}")
        ranked = done.where(f"lo < hi and rows <= {sorted_rows}")
        if ranked.limit(1).count():
            spans = ranked.select(*by, "lo", "hi", "before").distinct()
            inside = v.join(few(spans), by).where("__v between lo and hi")
            inside = inside.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy(*by, "lo").orderBy("__v")) - 1)
            found = found.unionByName(inside.join(few(ranked.select(*by, "lo", "rank")), [*by, "lo", "rank"]).select(*by, "rank", F.col("__v").alias("v")))
        if not left.limit(1).count():
            break
        spans = written(left.select(*by, "lo", "hi", "before").distinct(), "spans")
        bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("__v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS))
        h = v.join(few(spans), by).where("__v between lo and hi").groupBy(*by, F.col("lo").alias("of"), bucket.alias("b")).agg(F.count("*").alias("rows"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.first("before").alias("low"))
        h = h.withColumn("before", F.col("low") + F.sum("rows").over(Window.partitionBy(*by, "of").orderBy("b")) - F.col("rows"))
        ranks = left.select(*by, F.col("lo").alias("of"), "rank")
        done = at(h.join(few(ranks), [*by, "of"]).where("rank >= before and rank < before + rows"))
    values = found.groupBy(*by).agg(F.map_from_entries(F.collect_set(F.struct("rank", "v"))).alias("at"))
    x = sizes.select(*by, "n").join(values, by)
    low, high = (lambda p: F.element_at("at", F.floor(place(p)))), (lambda p: F.element_at("at", F.ceil(place(p))))
    return x.select(*by, "n", *[(low(p) + (high(p) - low(p)) * (place(p) - F.floor(place(p)))).alias(name) for name, p in probabilities.items()])
