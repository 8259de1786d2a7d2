"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as the operators split words on it, for Java and for Python regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded_words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8: bytes split at exactly the six ASCII blanks and lower-case ASCII only, many times faster than a pattern."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session; where that is unset, one of our own in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if (found := sc._jsc.sc().getCheckpointDir()).isDefined():
        return found.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="marlstone-")
    sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialise(df: DataFrame, what: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, and is computed once."""
    path = f"{shared_dir(df.sparkSession)}/marlstone/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A broadcast hint where df, an already written table, has at most so many rows; else df, for an ordinary join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def placed(df: DataFrame, order: list[Column], what: str) -> DataFrame:
    """df, written in order, with pos: 0, 1, 2, ... over all its rows. Spark range-partitions and sorts them, so rows that are alike in part of order are dealt over many tasks."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    # The identifier counts the rows of a partition from its number's multiple of 2^33.
    ranged = materialise(ranged.withColumn("__part", F.shiftright("__at", 33).cast("int")), what)
    runs = ranged.groupBy("__part").agg(F.min("__at").alias("lo"), F.count("*").alias("m"))
    # One row for each partition: the only window without a key.
    runs = runs.select("__part", (F.sum("m").over(Window.orderBy("__part")) - F.col("m") - F.col("lo")).alias("__move"))
    return ranged.join(F.broadcast(runs), "__part").withColumn("pos", F.col("__at") + F.col("__move")).drop("__part", "__at", "__move")


def fold_case(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(text: Column) -> Column:
    """Two 64-bit halves: one group per text, null apart from the empty text."""
    return F.struct(F.xxhash64(F.lit(1), text).alias("a"), F.xxhash64(F.lit(2), text.isNull(), text).alias("b"))
