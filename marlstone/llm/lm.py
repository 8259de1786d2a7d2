"""Scoring of whole documents by a gated recurrent language model, beside a unigram score from counts over the whole corpus."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import gru
from marlstone.llm.common import folded_words, materialise, read

#: The end token: no word holds a blank.
END = b" end"
#: Tokens whose counts the tasks hold; all others are joined. Ids 0 and 1 of the model: any other word, the end.
HEAD, VOCAB, MEMBERS, HIDDEN = 100_000, 1024, 32, 16
#: Documents that run side by side, and tokens of one such batch at most (but for a single longer document).
SIDE, SIDE_TOKENS = 1024, 1_000_000
#: Rounds of training, after each of which the shards' weights are averaged, and tokens of a shard.
ROUNDS, SHARD_TOKENS = 2, 8_000_000


def _with_split(docs: DataFrame, text: str) -> DataFrame:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select("doc_id", (F.crc32(name) % 10 == 0).alias("held_out"), F.col(text).cast("string").alias("t"))


def token_counts(train: DataFrame) -> DataFrame:
    """token, c over the column t of train; one end for each row. Tasks count first, and pass on a full table of counts as it fills."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[bytes] = Counter()
        for b in batches:
            for t in b["t"]:
                n.update(folded_words(t))
                n[END] += 1
            if len(n) > 500_000:
                yield pd.DataFrame({"token": list(n), "c": list(n.values())})
                n = Counter()
        if n:
            yield pd.DataFrame({"token": list(n), "c": list(n.values())})

    return train.select("t").mapInPandas(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame, most: int) -> dict[bytes, int]:
    """At most `most` of the most frequent tokens: those above the lowest count that leaves no more, found from a histogram of logarithms."""
    band = F.floor(F.log2("c") * 32).cast("int")
    h = sorted(((r["b"], r["n"]) for r in counts.groupBy(band.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, low = 0, None
    for b, n in h:
        if total + n > most:
            break
        total, low = total + n, b
    return {} if low is None else {bytes(r["token"]): r["c"] for r in counts.where(band >= low).collect()}


def vocabulary(head: dict[bytes, int], total: int, size: int = VOCAB) -> tuple[dict[bytes, int], np.ndarray]:
    """Ids of the model's tokens by falling count, and the count of each id; id 0 takes all other words."""
    best = sorted((t for t in head if t != END), key=lambda t: (-head[t], t))[: size - 2]
    ids = {END: 1} | {t: i + 2 for i, t in enumerate(best)}
    counts = np.zeros(size)
    for t, i in ids.items():
        counts[i] = head.get(t, 0)
    counts[0] = max(1.0, total - counts.sum())
    return ids, counts


def _batches(ids: list[np.ndarray]) -> Iterator[list[int]]:
    """Row numbers by falling length, in batches that run side by side."""
    batch: list[int] = []
    size = 0
    for i in sorted(range(len(ids)), key=lambda i: (-len(ids[i]), i)):
        if batch and (len(batch) >= SIDE or size + len(ids[i]) > SIDE_TOKENS):
            yield batch
            batch, size = [], 0
        batch.append(i)
        size += len(ids[i])
    if batch:
        yield batch


def train_model(train: DataFrame, ids: dict[bytes, int], counts: np.ndarray, rate: float = 0.02, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """One pass over all tokens of all training documents, states carried from window to window, in ROUNDS rounds.

    Hashes deal the documents to rounds and to as many shards as the corpus has multiples of SHARD_TOKENS tokens. In a round every shard
    trains from the same weights on its documents of the round, in the order of their hashes; the shards' weights, averaged by tokens,
    begin the next round. So the weights depend on the rows alone, not on how the input or the cluster is cut into partitions. The
    shards' weights are summed in Spark, in 16 groups, so the driver gets 16 rows at most for each round. Rows with one id and one text
    are of one shard, which reads them as a stream.
    """
    sc = train.sparkSession.sparkContext
    model = gru.start(counts, hidden, MEMBERS)
    shape = [model[k].shape for k in gru.NAMES]
    shards = int(max(1, -(-counts.sum() // SHARD_TOKENS)))
    names = [F.col(c) for c in ("doc_id", "t") if c in train.columns]
    own = train.select("t", F.xxhash64(*names).alias("o"))

    def trained(shared) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            own, weights = shared.value
            adam = gru.Adam(gru.load(weights), rate)

            def docs() -> Iterator[np.ndarray]:
                for b in batches:
                    seqs = []
                    for t in b["t"]:
                        words = folded_words(t)
                        words.append(END)
                        seqs.append(np.fromiter(map(own.get, words, repeat(0)), dtype=np.int32, count=len(words)))
                    # The longest begin first, so that no few of them are left to train alone.
                    yield from sorted(seqs, key=lambda s: -(len(s) // 1024))

            seen = gru.train_stream(adam, docs(), 1)
            if seen:
                flat = np.concatenate([adam.w[k].ravel() for k in gru.NAMES]).astype(np.float64) * seen
                yield pd.DataFrame({"shard": [TaskContext.get().partitionId()], "n": [float(seen)], "w": [flat.tobytes()]})

        mine = own.where(F.pmod("o", F.lit(ROUNDS)) == round_)
        # A shard is a partition.
        dealt = mine.repartitionById(shards, F.pmod(F.shiftright("o", 8), F.lit(shards)).cast("int")).sortWithinPartitions("o")
        return dealt.select("t").mapInPandas(run, "shard int, n double, w binary")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "n": [pdf["n"].sum()], "w": [np.sum([np.frombuffer(x) for x in pdf["w"]], axis=0).tobytes()]})

    for round_ in range(ROUNDS):
        found = materialise(trained(sc.broadcast((ids, gru.dump(model)))), "weights")
        rows = found.groupBy(F.pmod("shard", F.lit(16)).alias("g")).applyInPandas(add, found.schema).collect()
        if rows:
            flat, at = np.sum([np.frombuffer(r["w"]) for r in sorted(rows, key=lambda r: r["shard"])], axis=0) / sum(r["n"] for r in rows), 0
            for k, s in zip(gru.NAMES, shape, strict=True):
                n = int(np.prod(s))
                model[k] = flat[at : at + n].reshape(s).astype(np.float32)
                at += n
    return model


def scored(docs: DataFrame, text: str = "text", head_size: int = HEAD, hidden: int = HIDDEN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Learns from the rows whose crc32 of doc_id (as text; null: empty) is not 0 modulo 10. The model gives the probability of each
    token of its vocabulary and of "any other word"; which other word is then a matter of its smoothed count among the words outside
    the vocabulary, so that score is the probability of the whole text. Null texts count as empty: one end token. Rows that repeat get
    equal scores. Without training rows every count is 0 and the model is the one before training.
    """
    sc = docs.sparkSession.sparkContext
    own = _with_split(docs, text)
    train = own.where(~F.col("held_out"))
    counts = materialise(token_counts(train), "counts")
    is_end = F.col("token") == F.lit(END)
    total, kinds, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(is_end, F.col("c"))), F.lit(0))).first()
    head = head_of(counts, head_size)
    if ends:  # the end is no word that a join could find, so its count is always at hand
        head[END] = ends
    ids, by_id = vocabulary(head, total)
    model = train_model(train, ids, by_id, hidden=hidden)
    # What the words outside the vocabulary have: tokens and kinds.
    other_n = max(0, total - sum(head.get(t, 0) for t in ids))
    other_v = max(0, kinds - sum(1 for t in ids if t in head)) + 1
    bottom, other = math.log10(total + 0.1 * (kinds + 1)), math.log10(other_n + 0.1 * other_v)
    shared = sc.broadcast((head, ids, gru.dump(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, ids, weights = shared.value
        w = gru.load(weights)
        # A word's place in the head gives its id and the logarithm of its count; the last place stands for all others.
        place = {t: i for i, t in enumerate(head)}
        n = len(place)
        id_at = np.array([ids.get(t, 0) for t in head] + [0], dtype=np.int32)
        log_at = np.array([math.log10(c + 0.1) for c in head.values()] + [0.0])
        other_at = np.where(id_at == 0, log_at - other, 0.0)
        other_at[n] = 0.0
        end = head.get(END, 0)
        for b in batches:
            rows = {k: [] for k in ("n_tokens", "known", "base", "others", "tail", "times")}
            seqs = []
            for t in b.column("t").to_pylist():
                words = folded_words(t)
                at = np.fromiter(map(place.get, words, repeat(n)), dtype=np.int32, count=len(words))
                tail = Counter(map(words.__getitem__, np.flatnonzero(at == n).tolist()))
                seqs.append(np.append(id_at[at], np.int32(1)))
                rows["n_tokens"].append(len(words) + 1)
                rows["known"].append(int((at < n).sum()) + (end > 0))
                rows["base"].append(float(log_at[at].sum()) + math.log10(end + 0.1))
                rows["others"].append(float(other_at[at].sum()))
                rows["tail"].append(list(tail))
                rows["times"].append(list(tail.values()))
            logp = np.zeros(len(seqs))
            for part in _batches(seqs):
                logp[part] = gru.score(w, [seqs[i] for i in part], 1)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            made = [pa.array(x, kind) for x, kind in zip(rows.values(), kinds, strict=True)]
            # Ids pass as Arrow has them: pandas would make a batch with a null one floats.
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *made, pa.array(logp / math.log(10))], ["doc_id", "held_out", *rows, "logp"])

    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, others double, tail array<binary>, times array<long>, logp double"
    done = own.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "t").mapInArrow(run, schema)
    done = materialise(done.withColumn("row", F.monotonically_increasing_id()), "scores")
    # The rare words, counted by a join: every kind of word has one row in counts, and few documents hold it.
    rare = done.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("token"), F.col("x.times").alias("times"))
    c = F.coalesce(F.col("c"), F.lit(0))
    rare = rare.join(counts, "token", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(c + 0.1)).alias("log"), F.sum(F.when(c > 0, F.col("times"))).alias("seen"), F.sum("times").alias("all"))
    done = done.drop("tail", "times").join(rare, "row", "left").na.fill(0, ["log", "seen", "all"])
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("seen")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("log") - F.col("n_tokens") * bottom).alias("base_score"),
        (F.col("logp") + F.col("others") + F.col("log") - F.col("all") * other).alias("score"),
    )


def op10_gru_scores(spark, sf_dir):
    return scored(read(spark, sf_dir, "documents"))


