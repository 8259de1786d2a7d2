"""The corpus pipeline: quality rules, near-duplicates, pseudonyms, source mix, packing. Each stage is written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import mixing, packing, pii, quality, simhash
from marlstone.llm.common import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the rest lose their host's frequent lines. Columns of docs pass as they are but for text and n_chars."""
    kept = quality.clean(docs)
    return _with_text(kept, F.col("text"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return simhash.deduplicate(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values in the texts become pseudonyms."""
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    done = pii.pseudonymise(rows, pii.DEMO_KEY).select("__row.*", F.col("text").alias("__clean"))
    return _with_text(done, F.col("__clean"), docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and slot of every row that is left."""
    return packing.pack(docs)


def _with_text(df: DataFrame, text, columns: list[str]) -> DataFrame:
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return df.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns])


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("source_mix", source_mix), ("packing", packed)]

#: Keyed Feistel permutations and the dynamic programme are no SQL; tests/llm holds brute-force versions of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
