"""SimHash near-duplicates by bit-sliced comparison: every pair of fingerprints within the radius is linked, none is lost."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import folded_words, materialise, read

BITS = 64


def fingerprint(text: str | None) -> int:
    """64 majority bits over the XXH64 (seed 42) of the 3-word shingles of a text, repeats included; no words: 0."""
    from xxhash import xxh64_intdigest

    w = folded_words(text)
    if not w:
        return 0
    grams = map(b" ".join, zip(w, w[1:], w[2:], strict=False)) if len(w) >= 3 else [b" ".join(w)]
    h = np.fromiter((xxh64_intdigest(g, 42) for g in grams), dtype="<u8", count=max(1, len(w) - 2))
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # whole texts, in pieces that bound the memory of the unpacked bits
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' doc_id and fp (the fingerprint as a signed long), one row for each row of docs. Ids pass as Arrow has them: pandas would make a batch with a null one floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, fp long")


# ---- bit-sliced comparison ---------------------------------------------------------------------------------------


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit plane p holds bit p of every fingerprint, 64 fingerprints to a machine word."""
    pad = np.zeros(-len(fps) % 64, dtype=np.uint64)
    bits = np.unpackbits(np.concatenate([fps, pad]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")


def _near(differs: Callable[[int, np.ndarray], np.ndarray], alive: np.ndarray, radius: int) -> np.ndarray:
    """Bit mask (words of 64) of the alive lanes that differ in at most radius bits; differs(p, at): where the words `at` differ in plane p.

    A carry-save counter, one bit of the count per plane, is added to for 64 lanes at once; the sum saturates above the radius. Words
    in which no lane can still be within the radius are abandoned.
    """
    width = max(1, (radius + 1).bit_length())
    at = np.flatnonzero(alive)
    ok = alive[at].copy()
    counter = [np.zeros(len(at), dtype=np.uint64) for _ in range(width)]
    for p in range(BITS):
        carry = differs(p, at)
        for i in range(width):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        if p % 4 == 3:  # above the radius or over the counter's end: out
            over = carry.copy() if p else np.zeros_like(carry)
            above, equal = over, ~over
            for i in reversed(range(width)):
                bit = np.uint64(0xFFFFFFFFFFFFFFFF) if (radius >> i) & 1 else np.uint64(0)
                above = above | (equal & counter[i] & ~bit)
                equal = equal & ~(counter[i] ^ bit)
            ok = ok & ~above
            keep = ok != 0
            if not keep.all():
                at, ok, counter = at[keep], ok[keep], [c[keep] for c in counter]
                if not len(at):
                    break
    out = np.zeros(len(alive), dtype=np.uint64)
    out[at] = ok
    return out


def within(query: int, vertical: np.ndarray, alive: np.ndarray, radius: int = 3) -> np.ndarray:
    """Bit mask of the alive fingerprints at most radius bits from query."""
    return _near(lambda p, at: ~vertical[p, at] if (query >> p) & 1 else vertical[p, at], alive, radius)


def pairs_within(a: np.ndarray, b: np.ndarray, radius: int = 3) -> np.ndarray:
    """Whether a[i] and b[i] are at most radius bits apart: the pairs lie side by side in the lanes of two sets of planes."""
    va, vb = planes(a), planes(b)
    near = _near(lambda p, at: va[p, at] ^ vb[p, at], np.full(va.shape[1], 0xFFFFFFFFFFFFFFFF, dtype=np.uint64), radius)
    return np.unpackbits(near.view(np.uint8), bitorder="little")[: len(a)].astype(bool)


#: Groups of up to so many fingerprints are compared pair by pair, the pairs of all groups side by side: 28 pairs each at most.
SMALL = 8


def link_groups(tiles: np.ndarray, fps: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): links among the fingerprints of each run of equal tiles, enough to connect its classes."""
    starts = np.flatnonzero(np.diff(tiles, prepend=tiles[:1] - 1))
    sizes = np.diff(starts, append=len(tiles))
    lefts, rights = [], []
    for m in range(2, SMALL + 1):
        i, j = np.triu_indices(m, 1)
        group = starts[sizes == m][:, None]
        lefts.append((group + i).ravel())
        rights.append((group + j).ravel())
    left, right = np.concatenate(lefts), np.concatenate(rights)
    near = pairs_within(fps[left].view(np.uint64), fps[right].view(np.uint64), radius) if len(left) else np.zeros(0, dtype=bool)
    a, b = [fps[left[near]]], [fps[right[near]]]
    for s, m in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        found = np.array(link(fps[s : s + m].view(np.uint64), radius), dtype=np.int64).reshape(-1, 2)
        a.append(fps[s + found[:, 0]])
        b.append(fps[s + found[:, 1]])
    return np.concatenate(a), np.concatenate(b)


def link(fps: np.ndarray, radius: int = 3) -> list[tuple[int, int]]:
    """Edges (index, index), a spanning forest of the links within radius among distinct fps.

    Each fingerprint is compared once with all that no earlier one has reached: what is already in a component needs no second link.
    """
    n = len(fps)
    vertical = planes(fps)
    alive = np.zeros(vertical.shape[1], dtype=np.uint64)
    full, rest = divmod(n, 64)
    alive[:full] = np.uint64(0xFFFFFFFFFFFFFFFF)
    if rest:
        alive[full] = np.uint64((1 << rest) - 1)
    edges: list[tuple[int, int]] = []
    for start in range(n):
        if not (int(alive[start >> 6]) >> (start & 63)) & 1:
            continue
        alive[start >> 6] &= ~np.uint64(1 << (start & 63))
        front = [start]
        while front:
            q = front.pop()
            hit = within(int(fps[q]), vertical, alive, radius)
            words = np.flatnonzero(hit)
            if not len(words):
                continue
            alive[words] &= ~hit[words]
            bits = np.unpackbits(hit[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w, b = np.nonzero(bits)
            found = (words[w] * 64 + b).tolist()
            edges += [(q, x) for x in found]
            front += found
    return edges


def candidate_keys(fp: str = "fp"):
    """The 16 keys of a fingerprint: of any two within 3 bits of each other, at least one is equal.

    One of four 16-bit blocks is free of differing bits, and so is one of four 12-bit parts of the other 48 bits.
    """
    keys = []
    for i in range(4):
        rest = [b for b in range(BITS) if not 16 * i <= b < 16 * i + 16]
        for j in range(4):
            part = rest[12 * j : 12 * j + 12]
            mask = (0xFFFF << (16 * i)) | sum(1 << b for b in part)
            mask -= (1 << 64) * (mask >> 63)
            keys.append(F.struct(F.lit(4 * i + j).cast("byte").alias("part"), F.col(fp).bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


def edges(fps: DataFrame, radius: int = 3, tile: int = 512) -> DataFrame:
    """Links (a, b) among the distinct fp of fps, enough to connect every class of fingerprints within the radius (3 at most).

    A key held by more than tile fingerprints is dealt into chunks, and each pair of chunks is a group of its own, so that no task
    ever holds more than two chunks of one key.
    """
    if radius > 3:
        raise ValueError("the candidate keys hold up to 3 differing bits")
    keyed = fps.select("fp", F.explode(candidate_keys()).alias("k")).select("fp", F.xxhash64("k.part", "k.bits").alias("key"))
    # Only keys that two fingerprints hold matter; counting is pre-aggregated by the map side.
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").withColumn("chunks", F.ceil(F.col("m") / tile).cast("int"))
    held = keyed.join(shared, "key").withColumn("c", F.pmod(F.xxhash64("fp", F.lit(5)), F.col("chunks")).cast("int"))
    tiles = held.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = tiles.select("fp", F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("tile")).distinct()
    n = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = tiles.repartition(n, "tile").sortWithinPartitions("tile", "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"fp": np.array([], dtype=np.int64), "tile": np.array([], dtype=np.int64)})

        def linked(tiles: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
            a, b = link_groups(tiles, fps, radius)
            return pd.DataFrame({"a": a, "b": b})

        for batch in batches:
            both = pd.concat([held, batch[["fp", "tile"]]], ignore_index=True)
            if not len(both):
                continue
            t, f = both["tile"].to_numpy(), both["fp"].to_numpy()
            last = np.searchsorted(t, t[-1])  # the last tile may go on in the next batch
            if last:
                yield linked(t[:last], f[:last])
            held = both.iloc[last:]
        if len(held):
            yield linked(held["tile"].to_numpy(), held["fp"].to_numpy())

    return dealt.mapInPandas(run, "a long, b long").where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, root) for each node of links (a, b): root is the smallest node reachable. Least labels spread and then jump to their own
    label's label, so rounds grow with the logarithm of a chain's length; each round is written to the shared folder."""
    both = materialise(links.select("a", "b").union(links.select("b", "a")).toDF("v", "u").distinct(), "links")
    labels = materialise(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("root")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("root").alias("near"))
        spread = labels.join(near, "v").select("v", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = spread.select(F.col("v").alias("root"), F.col("root").alias("next"))
        new = materialise(spread.join(jump, "root").select("v", F.least("root", "next").alias("root"), (F.least("root", "next") != F.col("old")).alias("moved")), "labels")
        labels = new.select("v", "root")
        if not new.where("moved").limit(1).count():
            return labels
    raise RuntimeError("the components did not settle")


def classes(docs: DataFrame, text: str = "text", radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id for each row of docs: component_id is the smallest doc_id reachable over links.

    Fingerprints link at radius or fewer differing bits, equal ones always. A null text counts as empty; empty texts have fingerprint
    0, linked like any other. Rows that repeat get the same class. A null doc_id takes part in links, but never names a class unless
    all of the class are null.
    """
    own = materialise(fingerprints(docs, text), "fingerprints")
    fps = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = materialise(edges(fps, radius), "edges")
    roots = components(found)
    named = fps.join(roots, F.col("fp") == F.col("v"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = materialise(named.groupBy("root").agg(F.min("first").alias("component_id")).join(named, "root").select("fp", "component_id"), "classes")
    return own.join(ids, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, text: str = "text", radius: int = 3) -> DataFrame:
    """The rows of docs that stay: of each class the one with the smallest doc_id (of repeated ids one row).

    A row that is not the first of any class goes; rows with a null doc_id have no order among the rest and stay.
    """
    # The ids that go are few beside the texts: where they are small, Spark broadcasts them and no text moves.
    gone = materialise(classes(docs, text, radius).groupBy("doc_id").agg(F.max("component_id").alias("c")).where("c < doc_id").select("doc_id"), "gone")
    stays = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = materialise(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    if again.limit(1).count():
        twice = stays.join(again, "doc_id", "left_semi").withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*[c for c in docs.columns if c != "doc_id"])))
        stays = stays.join(again, "doc_id", "left_anti").unionByName(twice.where("__n = 1").drop("__n"))
    return stays


def op4_simhash_bitsliced(spark, sf_dir):
    found = classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
