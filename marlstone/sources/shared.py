"""Tables written to the folder that the executors of a session share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a folder of our own in local mode, and an error on a cluster."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/marlstone/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: computed once for all that use it."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_new(table: str, rows: DataFrame, keys: list[str]) -> None:
    """Appends the rows whose keys the Parquet table does not hold; repeats among the rows themselves are one row. Running it twice adds nothing."""
    spark = rows.sparkSession
    rows = rows.dropDuplicates(keys)
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        rows = rows.join(spark.read.schema(rows.schema).parquet(table).select(*keys), keys, "left_anti")
    rows.write.mode("append").parquet(table)


def few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A broadcast hint on a small table once its rows are counted; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
