"""Packing by optimal length buckets: dynamic programming over the global length histogram, token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialise, n_words, read, small

#: Lengths up to EXACT have a bin each, longer ones FINE bins for each doubling: at most EXACT + 53 * FINE bins whatever the corpus.
EXACT, FINE = 1024, 128


def length_bin(n: Column) -> Column:
    """The histogram bin of a length, rising with it."""
    n = n.cast("long")
    doubling = F.length(F.bin(F.greatest(n, F.lit(1).cast("long")))) - 1
    low = F.call_function("shiftleft", F.lit(1).cast("long"), doubling)
    fine = F.floor((n - low) * FINE / low).cast("long")
    return F.when(n <= EXACT, n).otherwise(EXACT + (doubling - 10) * FINE + fine).cast("long")


def best_boundaries(counts: np.ndarray, tops: np.ndarray, buckets: int) -> list[int]:
    """Indices of the bins that end a bucket, so that padding every length to its bucket's longest costs least.

    counts and tops (longest length) of the bins, rising. cost[j] = min over i of best[i] + counts in (i, j] * tops[j]; the sum of the
    lengths is the same for every choice. Of equal choices the one with the fewest buckets, then the first, is taken.
    """
    n = len(counts)
    if not n:
        return []
    upto = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    best, back = [np.concatenate([[0.0], np.full(n, np.inf)])], []
    for _ in range(min(buckets, n)):
        now, came = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        for j in range(1, n + 1):
            c = best[-1][:j] + (upto[j] - upto[:j]) * tops[j - 1]
            came[j] = int(np.argmin(c))
            now[j] = c[came[j]]
        best.append(now)
        back.append(came)
    k = min(range(1, len(best)), key=lambda k: best[k][n])
    ends, j = [], n
    for came in reversed(back[:k]):
        ends.append(j - 1)
        j = int(came[j])
    return ends[::-1]


def _histogram(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    hist = lengths.groupBy(length_bin(F.col("n_tokens")).alias("b")).agg(F.count("*").alias("n"), F.max("n_tokens").alias("top")).collect()
    hist.sort(key=lambda r: r["b"])
    return np.array([r["n"] for r in hist], dtype=np.float64), np.array([r["top"] for r in hist], dtype=np.float64)


def boundaries(lengths: DataFrame, buckets: int = 8) -> list[int]:
    """The bucket boundaries (longest length of each) for a column n_tokens; the histogram is all that reaches the driver."""
    counts, tops = _histogram(lengths)
    return [int(tops[i]) for i in best_boundaries(counts, tops, buckets)]


def pack(docs: DataFrame, text: str = "text", buckets: int = 8, budget: int = 16_384, cell_rows: int = 2_048) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, cell, batch, slot, batch_docs, over_budget: one row for each row of docs.

    n_tokens: words of the whole text, 0 for null. A batch holds documents of one bucket, each padded to bucket_len, and its padded
    size is at most the budget; a document that is longer than the budget is a batch of its own and over_budget. Within a bucket rows
    are dealt by hash into cells of about cell_rows rows, and a batch is filled within its cell, so that no bucket is one task: a cell
    leaves one batch that is not full, which costs no padding. Rows that repeat are packed each, and those that would fill a cell by
    themselves are dealt over the cells one by one; an empty table gives no rows.
    """
    # Written once: the texts are read a single time, and both the histogram and the batches come from the same lengths.
    lengths = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_words(F.col(text)).alias("n_tokens")).withColumn("__row", F.monotonically_increasing_id()), "lengths")
    counts, tops = _histogram(lengths)
    ends = best_boundaries(counts, tops, buckets)
    edges = [int(tops[i]) for i in ends] or [0]
    rows = [int(counts[s + 1 : e + 1].sum()) for s, e in zip([-1, *ends], ends, strict=False)] or [0]
    per = F.array(*[F.lit(max(1, -(-r // cell_rows))) for r in rows])
    tops_col = F.array(*[F.lit(e).cast("long") for e in edges])
    # The first boundary that holds the length: at most `buckets` comparisons a row.
    bucket = F.lit(len(edges) - 1)
    for i in reversed(range(len(edges) - 1)):
        bucket = F.when(F.col("n_tokens") <= edges[i], i).otherwise(bucket)
    out = lengths.withColumn("bucket", bucket.cast("int")).withColumn("bucket_len", F.get(tops_col, F.col("bucket")))
    # The row's place in its cell is set by hash, then by its own values: rows that tie are equal.
    hot = lengths.groupBy(F.col("doc_id").alias("__d"), F.col("n_tokens").alias("__t")).agg(F.count("*").alias("__m")).where(F.col("__m") > cell_rows).drop("__m")
    hot = small(materialise(hot.withColumn("__hot", F.lit(True)), "hot"))
    out = out.join(hot, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("n_tokens") == F.col("__t")), "left").drop("__d", "__t")
    out = out.withColumn("cell", F.pmod(F.xxhash64("doc_id", "n_tokens", F.when(F.col("__hot"), F.col("__row"))), F.get(per, F.col("bucket"))).cast("int"))
    fit = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))).cast("long"))
    cell = Window.partitionBy("bucket", "cell")
    out = out.withColumn("__rn", F.row_number().over(cell.orderBy("doc_id", "n_tokens")) - 1).withColumn("__all", F.count("*").over(cell))
    out = out.withColumns({"batch": F.floor(F.col("__rn") / fit).cast("long"), "slot": F.pmod(F.col("__rn"), fit).cast("int")})
    return out.select("doc_id", "n_tokens", "bucket", "bucket_len", "cell", "batch", "slot", F.least(fit, F.col("__all") - F.col("batch") * fit).cast("int").alias("batch_docs"), (F.col("n_tokens") > budget).alias("over_budget"))


def op1_length_buckets(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"))
