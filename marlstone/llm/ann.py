"""Approximate nearest neighbours by shifted space-filling curves: several Hilbert orderings, windows of neighbouring keys, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialise, read, small

#: Dimensions and bits of a curve: a key has DIMS * BITS bits.
DIMS, BITS = 8, 7
#: Curves of a length of vector have numbers below this.
MOST_CURVES = 1000
#: Queries whose true neighbours are looked up to fit the window, the smallest window, and the share of those neighbours to be reached.
FIT_QUERIES, FIT_LEAST, FIT_SHARE = 256, 64, 0.95
#: Queries that a task takes beside a block of vectors.
ASKED = 131_072
#: What the product of two blocks of unit vectors may be off by: pairs so near the last place are scored exactly too.
SLACK = 1e-11


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole numbers under 2 ** bits, for all rows at once."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of each level, from the coarsest
        low = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(unit: np.ndarray, curves: int, seed: int = 5) -> np.ndarray:
    """(rows, curves): keys of unit vectors, each curve with a projection and a shift of its own that depend on seed alone."""
    dim = unit.shape[1]
    out = np.empty((len(unit), curves), dtype=np.int64)
    for c in range(curves):
        rng = np.random.default_rng([seed, c, dim])
        side = max(dim, DIMS)
        axes = np.linalg.qr(rng.normal(size=(side, side)))[0][:dim, :DIMS]
        # A coordinate of a unit vector spreads as 1 / sqrt(dim); three spreads each way fill the cube, the shift moves its cells.
        at = (unit @ axes) * np.sqrt(dim) / 6 + 0.5 + rng.uniform(-0.06, 0.06, DIMS)
        out[:, c] = hilbert_keys(np.clip(at * (1 << BITS), 0, (1 << BITS) - 1))
    return out


def usable(v: Column) -> Column:
    """A vector that takes part: not null, not zero, without null or non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def least_ids(rows: DataFrame, key: str, id_: str, k: int) -> DataFrame:
    """The k smallest ids of every key. In three steps over ever fewer parts, each keeping k a part, so that no task meets all rows of a key."""
    for parts in (256, 16, 1):
        w = Window.partitionBy(key, F.pmod(F.xxhash64(id_), F.lit(parts))).orderBy(id_)
        rows = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")
    return rows


def _content() -> list[Column]:
    return [F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), F.reverse("v")).alias("b")]


def _stacked(v: pd.Series) -> np.ndarray:
    """The vectors as rows, each times a power of two that brings its largest component near 1: cosines stay, and no square is too large or too small."""
    x = np.stack(v.to_numpy()).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0, keepdims=True))[1])


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of q with every row of x, summed in extended precision and rounded to double once, so that it depends on the two vectors alone."""
    x, q = x.astype(np.longdouble), q.astype(np.longdouble)
    return ((x * q).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (q * q).sum())).astype(np.float64)


def positions(vectors: DataFrame, curves: int) -> DataFrame:
    """first, curve, pos, n: place of every vector on each curve and the curve's length.

    Spark range-partitions the keys of all curves and sorts each partition; a vector's place is that in its partition, after the
    partitions before it. Vectors of another length have curves of their own.
    """

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby(b["v"].map(len)):
                x = _stacked(part["v"])
                keys = curve_keys(x / np.linalg.norm(x, axis=1, keepdims=True), curves)
                yield pd.DataFrame({"first": part["first"].to_numpy(), "dim": np.int64(dim), "h": list(keys)})

    h = vectors.select("first", "v").mapInPandas(keyed, "first long, dim long, h array<long>")
    h = h.select("first", "dim", F.posexplode("h").alias("c", "h")).select((F.col("dim") * MOST_CURVES + F.col("c")).alias("curve"), "h", "first")
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The identifier counts the rows of a partition from its number's multiple of 2^33.
    ranged = h.repartitionByRange(parts, "curve", "h", "first").sortWithinPartitions("curve", "h", "first").select("first", "curve", F.monotonically_increasing_id().alias("at"))
    ranged = materialise(ranged.withColumn("part", F.shiftright("at", 33).cast("int")), "ranged")
    runs = ranged.groupBy("part", "curve").agg(F.min("at").alias("lo"), F.count("*").alias("m"))
    on_curve = Window.partitionBy("curve").orderBy("part")
    runs = runs.withColumns({"before": F.sum("m").over(on_curve) - F.col("m"), "n": F.sum("m").over(Window.partitionBy("curve"))}).select("part", "curve", F.col("before") - F.col("lo"), "n").toDF("part", "curve", "move", "n")
    # A row for each partition and curve that meet: partitions and curves at most.
    return ranged.join(small(materialise(runs, "runs")), ["part", "curve"]).select("first", "curve", (F.col("at") + F.col("move")).alias("pos"), "n")


def true_neighbours(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """q, first: the k nearest distinct vectors of a bounded table of queries (first, v), by comparison with every vector."""
    asked = [(r["first"], _stacked(pd.Series([r["v"]]))[0]) for r in queries.collect()]
    shared = vectors.sparkSession.sparkContext.broadcast(asked)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_dim: dict[int, tuple[list[int], list[np.ndarray]]] = {}
        for first, v in shared.value:
            names, rows = by_dim.setdefault(len(v), ([], []))
            names.append(first)
            rows.append(v / np.linalg.norm(v))
        for b in batches:
            for dim, part in b.groupby(b["v"].map(len)):
                if dim not in by_dim:
                    continue
                names, rows = by_dim[dim]
                x, first = _stacked(part["v"]), part["first"].to_numpy()
                near = np.stack(rows) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                most = min(k + 1, len(x))
                best = np.argpartition(-near, most - 1, axis=1)[:, :most]
                yield pd.DataFrame({"q": np.repeat(names, most), "first": first[best].ravel(), "score": np.take_along_axis(near, best, 1).ravel()})

    found = vectors.select("first", "v").mapInPandas(scan, "q long, first long, score double").where("q <> first")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("q", "first")


def fit_window(vectors: DataFrame, at: DataFrame, k: int) -> int:
    """Rows to look at on either side of a query on every curve, so that FIT_SHARE of the true neighbours are reached on some curve.

    Measured on a bounded sample: FIT_QUERIES of the queries, taken by hash, with their neighbours by comparison with every vector.
    Vectors in clusters need few rows; those without any structure a share of all.
    """
    sample = vectors.where("asked").orderBy(F.xxhash64("first"), "first").limit(FIT_QUERIES).select("first", "v")
    pairs = materialise(true_neighbours(vectors, sample, k), "pairs")
    names = F.broadcast(pairs.select(F.explode(F.array("q", "first")).alias("first")).distinct())  # k + 1 for each query of the sample at most
    there = materialise(at.join(names, "first").select("first", "curve", "pos"), "sampled")
    of = lambda c: there.select(F.col("first").alias(c), "curve", F.col("pos").alias(f"at_{c}"))
    apart = pairs.withColumnRenamed("first", "nb").join(of("q"), "q").join(of("nb"), ["nb", "curve"]).groupBy("q", "nb").agg(F.min(F.abs(F.col("at_q") - F.col("at_nb"))).alias("apart"))
    far = apart.agg(F.percentile("apart", F.lit(FIT_SHARE))).first()[0]
    return max(FIT_LEAST, int(far or 0) + 1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, curves: int = 32, window: int | None = None, block_rows: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: of each query row its k nearest other rows found, by cosine; ties to the smaller vec_id.

    Every distinct vector is put on `curves` Hilbert orderings, each of a projection and a shift of its own. A query looks at the
    window rows before and after it on every curve (by default as many as fit_window finds for these vectors); what the windows of
    all orderings hold is merged and reranked by the exact cosine of the original vectors, in double precision. Curves are cut into
    blocks of block_rows vectors; a query goes to every block that its window reaches, so vectors are dealt once for each curve however
    wide the window is. The queries of a block are split where they are more than ASKED, so that no task ever holds more than both.

    A score depends on the two vectors alone and is the double next to their cosine; the nearest have the largest, with no tolerance. Rows whose vector is null, zero or holds null or non-finite components, and rows with a null
    id, take no part. Vectors are compared with those of their own length only. Equal vectors are searched once; ids that repeat count
    once each. Fewer than k other vectors: all of them. An empty table gives no rows.
    """
    if not 0 < curves <= MOST_CURVES:
        raise ValueError(f"1 to {MOST_CURVES} curves")
    own = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    own = own.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asked"), F.transform("embedding", lambda x: x + F.lit(0).cast(x_type(vectors))).alias("v"))
    own = own.select("vec_id", "asked", "v", *_content())
    # A distinct vector goes by its smallest id.
    v = materialise(own.groupBy("a", "b").agg(F.min("vec_id").alias("first"), F.first("v").alias("v"), F.max("asked").alias("asked")), "vectors")
    named = own.select("vec_id", "asked", "a", "b").join(v.select("a", "b", "first"), ["a", "b"]).select("first", "vec_id", "asked").distinct()
    named = materialise(named, "named")
    # No more than k + 1 ids of one vector can be among k nearest.
    ids, queries = least_ids(named.select("first", "vec_id").distinct(), "first", "vec_id", k + 1), named.where("asked").select(F.col("vec_id").alias("query_id"), "first").distinct()
    at = materialise(positions(v, curves), "positions")
    half = window or fit_window(v, at, k)
    counted = v.agg(F.count("*").alias("n"), F.count_if("asked").alias("m")).first()
    chunks = max(1, -(-(2 * half + block_rows) * counted["m"] // max(1, counted["n"]) // ASKED))
    block = lambda c: F.floor(c / block_rows)
    there = at.join(v.select("first", "v"), "first").select("curve", block(F.col("pos")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "pos", "first", "v")
    reach = F.sequence(block(F.greatest(F.lit(0).cast("long"), F.col("pos") - half)), block(F.least(F.col("pos") + half, F.col("n") - 1)))
    asks = at.join(v.where("asked").select("first", "v"), "first").select("curve", F.explode(reach).alias("block"), F.pmod(F.xxhash64("first"), F.lit(chunks)).cast("int").alias("chunk"), "pos", "first", "v")
    # Columns of its own, as both sides of the cogroup come from the same tables.
    asks = asks.select(F.col("curve").alias("q_curve"), F.col("block").alias("q_block"), F.col("chunk").alias("q_chunk"), F.col("pos").alias("q_pos"), F.col("first").alias("q_first"), F.col("v").alias("q_v"))

    def rerank(block: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"q": [], "first": [], "score": []}
        if len(block) and len(asks):
            block, asks = block.sort_values("pos", kind="stable"), asks.sort_values("q_pos", kind="stable")
            x, pos, names = _stacked(block["v"]), block["pos"].to_numpy(), block["first"].to_numpy()
            q, at, asking = _stacked(asks["q_v"]), asks["q_pos"].to_numpy(), asks["q_first"].to_numpy()
            norm, own = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            # Queries that stand near each other look at the same stretch at once.
            near_by = np.split(np.arange(len(at)), np.flatnonzero(np.diff(at // max(FIT_LEAST, half))) + 1)
            for ask in (some[i : i + 512] for some in near_by for i in range(0, len(some), 512)):
                lo, hi = np.searchsorted(pos, (at[ask[0]] - half, at[ask[-1]] + half + 1))
                if lo == hi:
                    continue
                near = (q[ask] @ x[lo:hi].T) / (own[ask][:, None] * norm[lo:hi])
                # Each query keeps to its own window, so that neither blocks nor the other queries decide what it sees.
                inside = np.abs(pos[lo:hi] - at[ask][:, None]) <= half
                near[~inside] = -np.inf
                most = min(k + 1, hi - lo)
                # All that could be among the best, with what rounding may hide; then each of these pairs is scored exactly.
                least = np.partition(near, hi - lo - most, axis=1)[:, hi - lo - most]
                for i, row in enumerate((near >= (least - SLACK)[:, None]) & inside):
                    held = lo + np.flatnonzero(row)
                    score = cosines(x[held], q[ask[i]])
                    best = np.lexsort((names[held], -score))[:most]
                    out["q"] += [asking[ask[i]]] * len(best)
                    out["first"] += names[held[best]].tolist()
                    out["score"] += score[best].tolist()
        return pd.DataFrame(out).astype({"q": "int64", "first": "int64", "score": "float64"})

    found = there.groupBy("curve", "block", "chunk").cogroup(asks.groupBy("q_curve", "q_block", "q_chunk")).applyInPandas(rerank, "q long, first long, score double")
    found = found.groupBy("q", "first").agg(F.max("score").alias("score"))
    order = [F.desc("score")]
    few = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(*order, "first"))).where(F.col("n") <= k + 1).drop("n")
    hits = materialise(few, "found").join(ids, "first").select(F.col("q").alias("first"), "vec_id", "score")
    hits = hits.withColumn("n", F.row_number().over(Window.partitionBy("first").orderBy(*order, "vec_id"))).where(F.col("n") <= k + 1).drop("n")
    out = queries.join(hits, "first").where("query_id <> vec_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def x_type(vectors: DataFrame) -> str:
    """Type of the components: vectors travel as they are given, and are doubles where they are compared."""
    return vectors.schema["embedding"].dataType.elementType.simpleString()


def op5_hilbert_neighbours(spark, sf_dir):
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
