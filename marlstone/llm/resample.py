"""Importance resampling towards a target: hashed n-gram counts of the corpus and of the target give every document a weight, Gumbel noise and a global order draw without replacement.

The hash is CRC32 by a position table: a byte that stands d bytes before the end of a feature adds a value that depends on the byte and
on d alone, so the hashes of all features of a block of text are one table lookup and one XOR over spans, and a constant for the length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialise, placed, read

#: Bytes of a span that one lookup of the position table covers; longer spans are folded in blocks of so many.
REACH = 32
#: Bytes of text and features that are worked on at a time.
PIECE, FEATURES = 1 << 21, 1 << 16
BLANK = 0x20


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte by distance from the end, length constants, the move of a register by REACH zero bytes)."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
    by_distance = [step]
    for _ in range(REACH - 1):  # one zero byte more behind the byte
        last = by_distance[-1]
        by_distance.append((last >> 8) ^ step[last & 0xFF])
    # Of n zero bytes: what the register's start and end add.
    constant = np.array([zlib.crc32(bytes(n)) ^ 0xFFFFFFFF for n in range(REACH + 1)], dtype=np.uint32)
    moved = np.zeros((4, 256), dtype=np.uint32)
    for k in range(4):
        x = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(REACH):
            x = (x >> 8) ^ step[x & 0xFF]
        moved[k] = x
    return np.array(by_distance), constant, moved


BY_DISTANCE, CONSTANT, MOVED = _tables()
_FLAT = BY_DISTANCE.ravel()

#: A-Z lower-cased; which bytes stand in words: digits, a-z and all of the characters above ASCII.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def spans_crc(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC32 of data[starts[i]:ends[i]] for every i, spans may overlap; none is empty."""
    size = ends - starts
    blocks = -(-size // REACH)
    # The first block of a span holds what the whole blocks behind it leave over.
    first = size - (blocks - 1) * REACH
    if blocks.max(initial=1) == 1:
        lo, length = starts, size
    else:
        nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        lo = np.repeat(starts, blocks) + np.where(nth > 0, np.repeat(first, blocks) + (nth - 1) * REACH, 0)
        length = np.where(nth > 0, REACH, np.repeat(first, blocks))
    at = np.cumsum(length) - length
    # Positions of all bytes of all blocks, and how far each is from its block's end.
    within = np.arange(length.sum()) - np.repeat(at, length)
    distance = np.repeat(length, length) - 1 - within
    part = np.bitwise_xor.reduceat(_FLAT[distance * 256 + data[np.repeat(lo, length) + within]], at) if len(at) else np.zeros(0, dtype=np.uint32)
    head = np.cumsum(blocks) - blocks
    out = part[head] ^ CONSTANT[first]
    left = np.flatnonzero(blocks > 1)
    j = 1
    while len(left):  # block by block, for the spans that have one more
        x = out[left]
        out[left] = MOVED[0][x & 0xFF] ^ MOVED[1][(x >> 8) & 0xFF] ^ MOVED[2][(x >> 16) & 0xFF] ^ MOVED[3][x >> 24] ^ part[head[left] + j]
        j += 1
        left = left[blocks[left] > j]
    return out ^ np.uint32(0xFFFFFFFF)


def text_features(texts: list[bytes], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, crc, is_word) in slices of bounded size: the features of every text, runs of 1 to most words joined by one blank."""
    data = FOLD[np.frombuffer(b"\0".join(texts), dtype=np.uint8)] if texts else np.zeros(0, dtype=np.uint8)
    word = IN_WORD[data]
    no = np.zeros(1, dtype=np.int8)
    edge = np.diff(np.concatenate([no, word.view(np.int8), no]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return
    last = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(last, starts, side="right")
    if most > 1:  # words one blank apart
        size = ends - starts
        at = np.cumsum(size + 1) - size - 1
        close = np.full(int(at[-1] + size[-1]), BLANK, dtype=np.uint8)
        close[np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())] = data[word]
        data, starts, ends = close, at, at + size
    for n in range(1, most + 1):
        held = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :]) if n > 1 else np.arange(len(of))
        size = np.cumsum(ends[held + n - 1] - starts[held])
        lo = 0
        while lo < len(held):  # so many features, or as many bytes
            hi = min(lo + FEATURES, max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PIECE, side="right"))))
            some = held[lo:hi]
            yield of[some], spans_crc(data, starts[some], ends[some + n - 1]), np.full(len(some), n == 1)
            lo = hi


def _pieces(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(row of the first, texts) for runs of texts of about PIECE bytes; null: empty."""
    held: list[bytes] = []
    size = first = 0
    for i, t in enumerate(column.cast(pa.large_binary())):
        held.append(t.as_py() or b"")
        size += len(held[-1])
        if size >= PIECE:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def bucket_counts(texts: DataFrame, text: str = "text", most: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, n: features of all texts in each bucket that has some. Tasks add up their own, so a row for each task and bucket is shuffled at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for _, piece in _pieces(b.column(0)):
                for _, crc, _ in text_features(piece, most):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return texts.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """floor(1000 * ln of the smoothed share in the target over that in the source) of every bucket. buckets rows at most come to the driver."""
    rows = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("s", "t")]).collect()
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64).tolist()


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of a document in thousandths, rounded down, from the first 8 hex digits of sha256 of `seed:doc_id` (a null id: nothing behind the colon)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", most: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank (longs) for each row of docs; rank is null where the document is not drawn.

    Two passes over the texts: bucket counts, then the mean gain of each document. A table of `buckets` gains (80 kB for 10,000) goes to
    the tasks. The draw takes floor(percent * N / 100) of the N rows with least_words words; a histogram of scores finds the score of the
    last one, and only rows at or above it are ordered, by range-partitioning over all tasks.

    A null text has no features, weight 0 and its noise; so has an empty one. A null doc_id ties after all others. Rows that repeat have
    the same weight and score, and ranks next to each other. An empty docs gives no rows; an empty target makes all gains come from the
    corpus alone. Texts are read whole; a long one is worked on in slices. Other columns play no part.
    """
    table = docs.sparkSession.sparkContext.broadcast(np.array(gains(bucket_counts(docs, text, most, buckets), bucket_counts(target, target_text, most, buckets), buckets), dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = table.value
        for b in batches:
            words, count, total = (np.zeros(b.num_rows, dtype=np.int64) for _ in range(3))
            for first, piece in _pieces(b.column(1)):
                for of, crc, is_word in text_features(piece, most):
                    of = of + first
                    np.add.at(words, of[is_word], 1)
                    np.add.at(count, of, 1)
                    np.add.at(total, of, gain[crc % np.uint32(buckets)])
            # Whole numbers divided rounding down.
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (words, count, weight))], ["doc_id", "words", "n_features", "weight"])

    weighed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, words long, n_features long, weight long")
    weighed = materialise(weighed.withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "fit": F.col("words") >= least_words}), "weights")
    # Few scores: gains and noise are thousandths of logarithms.
    over = Window.orderBy(F.desc("score"))
    counted = materialise(weighed.where("fit").groupBy("score").count(), "scores").select("score", F.sum("count").over(over).alias("upto"), F.sum("count").over(Window.partitionBy()).alias("all"))
    goal = F.floor(F.col("all") * percent / 100)
    last = counted.where((goal > 0) & (F.col("upto") >= goal)).select(F.max("score").alias("score"), F.max(goal).alias("goal")).first()
    least, goal = last["score"], last["goal"] or 0
    out = ["doc_id", "n_features", "weight", "score"]
    if not goal:
        return weighed.select(*out, F.lit(None).cast("long").alias("rank"))
    in_reach = F.col("fit") & (F.col("score") >= least)
    drawn = placed(weighed.where(in_reach).select(*out, F.monotonically_increasing_id().alias("row")), [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row")], "drawn")
    drawn = drawn.select(*out, F.when(F.col("pos") < goal, F.col("pos") + 1).cast("long").alias("rank"))
    return weighed.where(~in_reach).select(*out, F.lit(None).cast("long").alias("rank")).union(drawn)


def op12_crc_resample(spark, sf_dir):
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: CRC32 bit by bit over the UTF-8 bytes of each different word.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
dw AS MATERIALIZED (SELECT r, w, count(*) AS c FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
bw AS MATERIALIZED (SELECT w, count(*) AS c FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY w),
h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
crc AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda y, i: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 10000 AS b FROM h),
s AS (SELECT b, sum(c) AS s FROM dw JOIN crc USING (w) GROUP BY b),
t AS (SELECT b, sum(c) AS t FROM bw JOIN crc USING (w) GROUP BY b),
st AS (SELECT b, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t FROM s FULL JOIN t USING (b)),
g AS MATERIALIZED (SELECT b, floor(1000 * ln((t + 1) * ((SELECT coalesce(sum(s), 0) FROM st) + 10000) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM st) + 10000))))::BIGINT AS g FROM st),
m AS (SELECT r, sum(c)::BIGINT AS n, floor(sum(c * g)::DOUBLE / sum(c))::BIGINT AS weight FROM dw JOIN crc USING (w) JOIN g USING (b) GROUP BY r),
w AS (SELECT d.r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m ON d.r = m.r),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM w WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM w LEFT JOIN k ON w.r = k.r
"""
