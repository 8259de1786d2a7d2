"""Token counts with a digest cache: only texts that no earlier run has counted are encoded, each distinct one once."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import materialise, read, shared_dir

CACHE_SCHEMA = "digest string, tokenizer string, n_tokens long"
#: Chunks whose counts a Python worker remembers; beyond that it starts anew, so that its memory is bounded.
REMEMBERED = 400_000
_BREAK = re.compile(r" (?=\s|$)")
_CUT = re.compile(r" (?=\S)")
_loaded: dict[str, tuple[object, dict[str, int]]] = {}


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer version: library and content of its file."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    with open(path, "rb") as f:
        return f"{library}:{hashlib.sha256(f.read()).hexdigest()[:24]}"


def _encoder(path: str):
    """(count many texts, memory of chunk counts), loaded once in each Python worker."""
    if path not in _loaded:
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _loaded[path] = (lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]), {}
        else:
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = (lambda texts: [len(ids) for ids in p.encode(texts, num_threads=1)]), {}
    return _loaded[path]


def chunks(text: str) -> list[str]:
    """Pieces of a text that a byte-level pre-tokenizer never joins: cut before each blank that a non-blank follows.

    The blank belongs to the piece after it. Its patterns take one leading blank into a word, and leave the last blank of a run to the
    word that follows, so the tokens of the pieces are the tokens of the text.
    """
    if not text:
        return []
    parts = text.split(" ") if not _BREAK.search(text) else _CUT.split(text)
    return [parts[0], *[" " + p for p in parts[1:]]] if parts[0] else [" " + p for p in parts[1:]]


def is_byte_level(path: str) -> bool:
    """Whether a tokenizer file is a byte-level model without normalizer, prefix blank or stripping special tokens: the one kind whose texts can be cut at blanks."""
    import json

    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    pre = t.get("pre_tokenizer") or {}
    strips = any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") or " " in a.get("content", "") for a in t.get("added_tokens", []))
    return not t.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not strips and not (t.get("model") or {}).get("dropout")


def count_tokens(texts: list[str], path: str, cut: bool) -> list[int]:
    """Tokens of whole texts. cut: count chunks, each distinct one once while it is remembered."""
    count, known = _encoder(path)
    if not cut:
        return [n for at in range(0, len(texts), 64) for n in count(texts[at : at + 64])]
    out = []
    for text in texts:
        pieces = chunks(text)
        if new := list({p for p in pieces if p not in known}):
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set(pieces))
            known.update(zip(new, count(new), strict=True))
        out.append(sum(map(known.__getitem__, pieces)))
    return out


def _cached(spark: SparkSession, cache: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache) if there else None


def fill(docs: DataFrame, tokenizer: str, cache: str, text: str = "text") -> None:
    """Append the counts of the distinct texts of docs that the cache does not hold."""
    spark, version, cut = docs.sparkSession, tokenizer_digest(tokenizer), is_byte_level(tokenizer)
    t = F.coalesce(F.col(text), F.lit(""))
    # Copies meet on the map side: of a text that fills a third of the table, each task passes on one. The texts are dealt by digest
    # once, for the copies and for the cache alike.
    misses = docs.select(F.sha2(t, 256).alias("digest"), t.alias("t")).groupBy("digest").agg(F.first("t").alias("t"))
    if (held := _cached(spark, cache)) is not None:
        misses = misses.join(held.where(F.col("tokenizer") == version).select("digest"), "digest", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"digest": b["digest"].tolist(), "tokenizer": version, "n_tokens": count_tokens(b["t"].tolist(), tokenizer, cut)})

    misses.mapInPandas(run, CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache)


def counted(docs: DataFrame, tokenizer: str, text: str = "text", cache: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of docs.

    A row's text is named by the SHA-256 of its content (null: the empty text; nothing else is normalised away, as it would change
    the counts) and the tokenizer by that of its file. Names that the cache holds are joined; of the others each distinct text is
    encoded once, in parallel, and appended to the cache for later runs. cache: a Parquet folder, by default one in the session's
    shared folder. Rows that repeat share one count.
    """
    spark = docs.sparkSession
    cache = cache or f"{shared_dir(spark)}/marlstone/token-counts"
    version = tokenizer_digest(tokenizer)
    t = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col("doc_id"), F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t, 256).alias("digest"))
    named = materialise(named, "digests")
    fill(docs, tokenizer, cache, text)
    # Of the cache, the version's folder is read, and of that the digests at hand. A run beside this one may have appended a name
    # twice; the counts are equal.
    at_hand = named.select("digest").distinct()
    known = _cached(spark, cache).where(F.col("tokenizer") == version).join(at_hand, "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # Written, so that the join below deals both sides anew and Spark can split a digest that many rows share.
    known = materialise(known, "known")
    return named.join(known, "digest").select("doc_id", "n_bytes", "n_tokens")


def op6_token_digest_cache(spark, sf_dir):
    import public_tokenizers

    # A cache of its own for each call, so that the query encodes every distinct text whatever ran before it: one row in 16 (by hash)
    # first, as an earlier run over a smaller corpus would have, then all, of which those texts are found counted.
    cache, path = f"{shared_dir(spark)}/marlstone/token-counts-{uuid.uuid4().hex}", public_tokenizers.path("byte_bpe_50k.json")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fill(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0), path, cache=cache)
    found = counted(docs, path, cache=cache)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
