"""Rows that no other row beats in every respect, over any number of dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.sources.shared import written

#: Points with the smallest sums that every task holds, and points that are compared with each other at once.
STRONG, TILE = 1_000, 4_096


def _undominated(points: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Which points none of `against` dominates: no larger anywhere and smaller somewhere."""
    keep = np.ones(len(points), dtype=bool)
    for at in range(0, len(points), 256):
        p = points[at : at + 256, None, :]
        for lo in range(0, len(against), 1024):
            a = against[None, lo : lo + 1024, :]
            keep[at : at + 256] &= ~((a <= p).all(2) & (a < p).any(2)).any(1)
    return keep


def front(points: np.ndarray) -> np.ndarray:
    """The undominated points, by rising sum: who dominates has the smaller sum, so each point meets only those kept before it and its own run."""
    points = points[np.argsort(points.sum(axis=1), kind="stable")]
    kept = points[:0]
    for at in range(0, len(points), 512):
        run = points[at : at + 512]
        run = run[_undominated(run, kept)]
        kept = np.concatenate([kept, run[_undominated(run, run)]])
    return kept


def skyline(rows: DataFrame, least: list[str], most: list[str]) -> DataFrame:
    """The rows that no other row dominates: none is as small in all of `least` and as large in all of `most`, and better in one.

    Rows that are equal in all dimensions stay together; rows that miss one take no part. Different points only are compared: each is
    first held against STRONG of the smallest sums (a fixed number), then range-partitioned by sum and reduced to the front of its
    partition. What is left is cut into tiles in the order of sums, and a tile meets itself and those before it, a pair of tiles in a
    task; so no task holds the whole front, however large it is.
    """
    width = len(least) + len(most)
    dims = [F.col(c).cast("double") for c in least] + [-F.col(c).cast("double") for c in most]
    there = F.forall(F.array(*dims), lambda x: x.isNotNull() & ~F.isnan(x))
    x = rows.withColumn("__p", F.when(there, F.array(*[d + F.lit(0.0) for d in dims]))).where("__p is not null")
    points = x.select("__p").distinct().withColumn("s", F.aggregate("__p", F.lit(0.0), lambda a, v: a + v))
    strong = np.array([r["__p"] for r in points.orderBy("s", "__p").limit(STRONG).collect()]).reshape(-1, width)
    shared = rows.sparkSession.sparkContext.broadcast(front(strong))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held, pending = np.zeros((0, width)), 0
        for b in batches:
            new = np.stack(b["p"].to_numpy()) if len(b) else held[:0]
            new = new[_undominated(new, shared.value)]
            # Sorted by sums, so what is kept stays; only the new points can go.
            new = front(new[_undominated(new, held)])
            held = np.concatenate([held, new])
        for at in range(0, len(held), TILE):
            part = held[at : at + TILE]
            yield pd.DataFrame({"p": list(part), "part": np.int64(TaskContext.get().partitionId()), "t": np.int64(pending)})
            pending += 1

    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = points.repartitionByRange(n, "s").sortWithinPartitions("s").select(F.col("__p").alias("p"))
    fronts = written(ranged.mapInPandas(local, "p array<double>, part long, t long"), "fronts")
    # A row for each tile.
    tiles = fronts.select("part", "t").distinct().withColumn("tile", F.row_number().over(Window.orderBy("part", "t")))
    count = tiles.count()
    fronts = fronts.join(F.broadcast(tiles), ["part", "t"]).select("p", "tile")
    mine = fronts.select("p", F.col("tile").alias("i"), F.explode(F.sequence(F.lit(1), "tile")).alias("j"))
    others = fronts.select(F.col("p").alias("q"), F.explode(F.sequence("tile", F.lit(count))).alias("i2"), F.col("tile").alias("j2"))

    def beaten(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((0, width))
        if len(mine) and len(others):
            p = np.stack(mine["p"].to_numpy())
            out = p[~_undominated(p, np.stack(others["q"].to_numpy()))]
        return pd.DataFrame({"p": pd.Series(list(out), dtype=object)})

    gone = mine.groupBy("i", "j").cogroup(others.groupBy("i2", "j2")).applyInPandas(beaten, "p array<double>").distinct()
    stays = fronts.select("p").join(gone, "p", "left_anti")
    return x.join(stays, x["__p"] == stays["p"], "left_semi").drop("__p")
