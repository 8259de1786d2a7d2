"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialise, n_words, read, small

#: A document's hash has LEVELS digits of BITS bits each; a histogram is one digit wide.
LEVELS, BITS = 5, 12
WIDTH = 1 << BITS
CAP = 3
#: Sources whose goals are broadcast; more are joined by a shuffle.
MOST_SOURCES = 100_000


def unit_hash(doc_id: Column, text: Column) -> Column:
    """60-bit hash that orders the documents of a source; a null id falls back on the text."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substr(F.md5(name), F.lit(1), F.lit(15)), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = CAP) -> DataFrame:
    """source, source_size, target: the sum of all sizes shared by weight, none above cap times its source's size.

    Sources take the weights in the order of their code points, null last, repeating. What a cap leaves is shared among the rest by
    weight until none is above: with the sources in the order of cap / weight, that is one level for all sources above the capped ones.
    """
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))  # one row a source
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = s.withColumn("w", F.get(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    s = s.withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    rising = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), F.col("source"))
    below, every = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumns({"capped": F.coalesce(F.sum("limit").over(below), F.lit(0.0)), "left": F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)), "total": F.sum("source_size").over(every)})
    # The level if exactly the sources before this one are capped; it is the true one where this source is the first below its cap.
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("left"))
    s = s.withColumn("true", F.min(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct((F.col("limit") / F.col("w")).alias("r"), F.col("source").isNull().alias("n"), "source", "level"))).over(every)["level"])
    return s.select("source", "source_size", F.when(F.col("true").isNull() | (F.col("true") * F.col("w") >= F.col("limit")), F.col("limit")).otherwise(F.col("true") * F.col("w")).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, target, whole, threshold: each document is taken whole times, and once more where its hash is under threshold.

    sized: a written table of source, hash, size. Its sizes are summed by source and hash bucket; the bucket in which the sum passes
    the goal is looked into again with the next digit of the hash, and only its documents are read. No documents are sorted.
    """
    g = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    g = g.withColumns({"rest": F.col("target") - F.col("whole") * F.col("source_size"), "prefix": F.lit(0).cast("long")})
    # One row for each source in every round: counted once, whether they are few enough to broadcast.
    near = F.broadcast if goals.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES else (lambda df: df)
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        known = g.select(F.col("source").alias("s"), "prefix", "rest")
        at = sized.join(near(known), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", shift + BITS) == F.col("prefix")))
        hist = at.groupBy("source", F.shiftright("hash", shift).alias("b")).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
        run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
        # The last level takes the document that brings the sum nearest; the others the last bucket that begins within the goal.
        last = level == LEVELS - 1
        inside = F.col("before") + (F.col("n") / 2 if last else 0) <= F.col("rest")
        found = hist.groupBy("source").agg(F.max(F.when(inside, F.struct("b", "before", "n"))).alias("m"))
        g = g.join(found.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        if last:
            g = g.withColumn("threshold", F.when(F.col("m").isNull(), F.col("prefix") * WIDTH).otherwise(F.col("m.b") + 1))
        else:
            g = g.withColumns({"rest": F.col("rest") - F.coalesce(F.col("m.before"), F.lit(0)), "prefix": F.coalesce(F.col("m.b"), F.col("prefix") * WIDTH)})
        g = materialise(g.drop("m"), "thresholds")
    return g.select("source", "source_size", "target", "whole", "threshold")


def _sized(docs: DataFrame, source: str, text: str) -> DataFrame:
    return docs.select("doc_id", F.col(source).alias("source"), n_words(F.col(text)).alias("size"), unit_hash(F.col("doc_id"), F.col(text)).alias("hash"))


def _plan(sized: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    goals = materialise(targets(sized, weights), "targets")
    return thresholds(sized, goals)


def _times(plan: DataFrame) -> tuple[DataFrame, Column]:
    p = small(plan.withColumnRenamed("source", "__s"))
    return p, F.col("whole") + F.when(F.col("__hash") < F.col("threshold"), 1).otherwise(0)


def taken(docs: DataFrame, source: str = "source", text: str = "text", weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken for each row of docs. Size: words; a null text has 0.

    Rows that repeat share one hash and are taken or left together; an empty table gives no rows; a source without words has target 0.
    """
    sized = materialise(_sized(docs, source, text), "sizes")
    plan, times = _times(_plan(sized, weights))
    out = sized.withColumnRenamed("hash", "__hash").join(plan, F.col("source").eqNullSafe(F.col("__s"))).withColumn("times", times.cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them; the thresholds are broadcast to the documents, which stay in place."""
    plan, times = _times(_plan(materialise(_sized(docs, source, text).select("source", "size", "hash"), "sizes"), weights))
    # The row travels as one column, so that none of its own can be taken for one of the plan's.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(source).alias("__source"), unit_hash(F.col("doc_id"), F.col(text)).alias("__hash"))
    out = own.join(plan.select("__s", "whole", "threshold"), F.col("__source").eqNullSafe(F.col("__s")))
    return out.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), times))).where("__i > 0").select("__row.*")


def op7_hash_threshold_mix(spark, sf_dir):
    return taken(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The level of the capped sharing as one query: sources in the order of limit / weight, the first that stays below its limit sets it.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY (source IS NULL), source) - 1) % 3]::DOUBLE AS w FROM s0),
s2 AS (SELECT *, 3.0::DOUBLE * source_size AS lim, sum(source_size) OVER () AS total FROM s1),
s3 AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / w, (source IS NULL), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(w) OVER (ORDER BY lim / w, (source IS NULL), source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM s2),
s4 AS (SELECT *, (total - capped)::DOUBLE / rest_w AS lev FROM s3),
lv AS (SELECT arg_min(lev, rn) AS lev FROM (SELECT *, row_number() OVER (ORDER BY lim / w, (source IS NULL), source) AS rn FROM s4) WHERE lev * w <= lim),
t AS (SELECT source, source_size, CASE WHEN lv.lev IS NULL OR lv.lev * w >= lim THEN lim ELSE lv.lev * w END AS target FROM s4, lv),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
hh AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
c AS (SELECT source, h, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM hh)
SELECT d.doc_id, d.size, u.source_size, u.target, (d.size * (u.whole + CASE WHEN c.bef + c.n / 2.0 <= u.target - u.whole * u.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""
