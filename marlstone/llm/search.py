"""Exact top-k search by inner product over an inverted index, by MaxScore in shards."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialise, read

#: Rows of a shard and queries of a block that one task holds.
SHARD_ROWS, BLOCK_QUERIES = 8_192, 2_048
#: Rows of a shard that are worked on before the threshold is taken anew: few at first, as there is none yet.
FIRST_ROWS, NEXT_ROWS = 512, 4_096
#: Whole numbers of this size and more are not certain in 64-bit sums; they are Python's own then.
WIDE = 2.0**53
LONG = 2**63 - 1


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of doubles as whole numbers: 64-bit ones, or Python's where any is so large that a sum of products might not fit."""
    with np.errstate(over="ignore"):
        y = np.floor(1024.0 * x)
    if not len(y) or np.abs(y).max() < 2**20:
        return y.astype(np.int64)
    return np.array([int(v) * 1024 if abs(v) >= WIDE else int(np.floor(1024.0 * v)) for v in x.tolist()], dtype=object)


@dataclass
class Postings:
    """The rows of a shard that have a component other than 0 at one place: their slots, rising, and the components; least and most of them, 0 among them."""

    slots: np.ndarray
    weights: np.ndarray
    least: int
    most: int


def postings_of(slots: np.ndarray, components: np.ndarray) -> Postings:
    weights = scaled(components)
    held = weights != 0
    slots, weights = slots[held], weights[held]
    return Postings(slots, weights, min(0, int(weights.min())) if len(weights) else 0, max(0, int(weights.max())) if len(weights) else 0)


def max_score(query: np.ndarray, own_id: int, lists: list[Postings], ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, id), best first, ties to the smaller id: the k ids of a shard with the highest inner product with query, own_id left out. An id that repeats counts once, with its best.

    Terms are the query's components that are not 0, by falling bound on what they can add. The last of them, as far as their bounds
    together stay below the k-th best score so far, are non-essential: a row that only they reach can't enter. The lists of the others
    are traversed; the rows that can still enter are then looked up in one list after the other, and are left as soon as their sum and
    the bounds of the lists to come stay below that score.
    """
    terms = []
    for place in np.flatnonzero(query != 0):
        if place < len(lists) and len(lists[place].slots):
            q, p = int(query[place]), lists[place]
            terms.append((max(q * p.least, q * p.most), max(abs(q * p.least), abs(q * p.most)), q, p))
    terms.sort(key=lambda t: -t[0])
    # What the terms from i on can add at most.
    rest = [0] * (len(terms) + 1)
    for i in range(len(terms) - 1, -1, -1):
        rest[i] = rest[i + 1] + terms[i][0]
    kind = np.int64 if sum(t[1] for t in terms) < LONG and all(t[3].weights.dtype == np.int64 for t in terms) else object
    best: list[tuple[int, int]] = []
    lo = 0
    while lo < len(ids):
        hi = min(len(ids), lo + (NEXT_ROWS if lo else FIRST_ROWS))
        floor_ = best[-1][0] if len(best) == k else None
        essential = len(terms)
        while floor_ is not None and essential and rest[essential - 1] < floor_:
            essential -= 1
        total = np.zeros(hi - lo, dtype=kind)
        for _, _, q, p in terms[:essential]:
            a, b = np.searchsorted(p.slots, (lo, hi))
            total[p.slots[a:b] - lo] += q * p.weights[a:b].astype(kind, copy=False)
        at = np.arange(hi - lo) if floor_ is None else np.flatnonzero(total + rest[essential] >= floor_)
        total = total[at]
        for i in range(essential, len(terms)):
            if not len(at):
                break
            _, _, q, p = terms[i]
            a, b = np.searchsorted(p.slots, (lo, hi))
            slots = p.slots[a:b]
            if len(slots):
                found = np.minimum(np.searchsorted(slots, at + lo), len(slots) - 1)
                there = slots[found] == at + lo
                total[there] += q * p.weights[a:b][found[there]].astype(kind, copy=False)
            stays = total + rest[i + 1] >= floor_
            if not stays.all():
                at, total = at[stays], total[stays]
        keep = ids[lo + at] != own_id
        at, total = at[keep], total[keep]
        if len(at):
            best = _merged(best, total, ids[lo + at], k)
        lo = hi
    return best


def _merged(best: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    if len(scores) > 4 * k and scores.dtype == np.int64:  # ids that repeat may need more; those below the k-th different one can't matter
        order = np.lexsort((ids, -scores))
        scores, ids = scores[order], ids[order]
        first = np.sort(np.unique(ids, return_index=True)[1])[:k]
        scores, ids = scores[first], ids[first]
    top: dict[int, int] = {i: s for s, i in best}
    for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
        top[i] = max(s, top.get(i, s))
    return sorted(((s, i) for i, s in top.items()), key=lambda x: (-x[0], x[1]))[:k]


def usable(v: Column) -> Column:
    """A vector that takes part: not null, without null or non-finite components."""
    return F.coalesce(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def _rows(t: pa.Table, column: str) -> list[np.ndarray]:
    """The lists of a column, one array a row."""
    c = t.column(column).combine_chunks()
    c = pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
    values, offsets = c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


INDEX = "shard long, place int, slots array<int>, weights array<double>, ids array<long>"


def index(rows: DataFrame) -> DataFrame:
    """The inverted index of rows (shard, vec_id, v): a row for each shard and place with the slots that have a component there, and one of place -1 with the shard's ids."""

    def build(t: pa.Table) -> pa.Table:
        ids, vectors = t.column("vec_id").to_numpy(), _rows(t, "v")
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], [vectors[i] for i in order]
        out: dict[str, list] = {"shard": [], "place": [], "slots": [], "weights": [], "ids": []}

        def add(place: int, slots: np.ndarray | None, weights: np.ndarray | None, names: np.ndarray | None) -> None:
            for c, x in zip(out.values(), (t.column("shard")[0].as_py(), place, slots, weights, names), strict=True):
                c.append(x)

        add(-1, None, None, ids)
        length = np.array([len(v) for v in vectors])
        for place in range(length.max(initial=0)):
            slots = np.flatnonzero(length > place)
            x = np.array([vectors[i][place] for i in slots], dtype=np.float64)
            held = x != 0
            add(place, slots[held].astype(np.int32), x[held], None)
        kinds = {"shard": pa.int64(), "place": pa.int32(), "slots": pa.list_(pa.int32()), "weights": pa.list_(pa.float64()), "ids": pa.list_(pa.int64())}
        return pa.table({c: pa.array(out[c], kind) for c, kind in kinds.items()})

    return rows.groupBy("shard").applyInArrow(build, INDEX)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k other ids with the highest inner product of floor(1024 * component), ties to the smaller id.

    Rows are dealt by hash over shards of about SHARD_ROWS, and each shard is written as an inverted index, a term for each place of a
    vector. Queries go to every shard in blocks of BLOCK_QUERIES: the query set against all rows is what is asked, and a task holds one
    shard and one block. Each answers by MaxScore with its best k, and the shards' answers are merged. Exact: a row is left only where
    the bounds show that it cannot enter.

    Rows with a null id, or whose vector is null or holds null or non-finite components, take no part; zero and empty vectors do.
    Vectors of another length count as 0 where they end. Rows that repeat count once; an id with several vectors stands with its best
    score for each query, is a query by each of them, and never finds itself. Fewer than k other ids: all of them. A score that a long
    cannot hold is given as the nearest long, ranked by its true value within a shard. An empty table, or one without queries, gives no
    rows. Other columns play no part.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    own = vectors.where(usable(F.col(vector)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    own = materialise(own.groupBy("vec_id", "v").agg(F.max("asked").alias("asked")).withColumn("h", F.xxhash64("vec_id", "v")), "vectors")
    counted = own.agg(F.count("*").alias("n"), F.count_if("asked").alias("m")).first()
    shards, blocks = max(1, -(-counted["n"] // SHARD_ROWS)), max(1, -(-counted["m"] // BLOCK_QUERIES))
    dealt = lambda n, at: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(at)
    built = materialise(index(own.select(F.pmod("h", F.lit(shards)).alias("shard"), "vec_id", "v")), "index")
    terms = built.select("*", dealt(blocks, "block"))
    asks = own.where("asked").select(F.col("vec_id").alias("query_id"), "v", F.pmod(F.col("h").bitwiseXOR(F.shiftright("h", 32)), F.lit(blocks)).alias("q_block"), dealt(shards, "q_shard"))

    def search(terms: pa.Table, asks: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if terms.num_rows and asks.num_rows:
            place, slots, weights, names = terms.column("place").to_numpy(), _rows(terms, "slots"), _rows(terms, "weights"), _rows(terms, "ids")
            ids = names[int(np.flatnonzero(place == -1)[0])]
            by_place = {int(p): postings_of(slots[i], weights[i]) for i, p in enumerate(place) if p >= 0}
            lists = [by_place[p] for p in range(len(by_place))]
            for query_id, q in zip(asks.column("query_id").to_pylist(), _rows(asks, "v"), strict=True):
                for score, i in max_score(scaled(q), query_id, lists, ids, k):
                    for c, x in zip(out.values(), (query_id, i, max(-LONG - 1, min(LONG, int(score)))), strict=True):
                        c.append(x)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    found = terms.groupBy("block", "shard").cogroup(asks.groupBy("q_block", "q_shard")).applyInArrow(search, "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    # In two steps, so that no task meets the answers of very many shards.
    for key in (["query_id", F.pmod("vec_id", F.lit(64))], ["query_id"]):
        best = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_maxscore_search(spark, sf_dir):
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda t: coalesce(t[1] * t[2], 0)))::BIGINT AS score FROM v AS q, v AS c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
