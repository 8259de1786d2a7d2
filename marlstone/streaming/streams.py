"""Streams over the event log: plain stream transforms, and a runner that drains a bounded source for batch use."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.shared import fresh_path, written


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream; its time stamps have no zone and are read as the session's (UTC)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def as_stream(spark: SparkSession, rows: DataFrame, what: str, files: int | None = None) -> DataFrame:
    """A table as a stream of its files: written to the shared folder by its own tasks (or in so many files, by so many tasks), read as they are found."""
    path = fresh_path(spark, what)
    (rows.coalesce(files) if files else rows).write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


#: Rows of a file, at least, where a stretch of time is more than one.
FILE_ROWS = 1_000_000


def in_order(spark: SparkSession, rows: DataFrame, what: str, files: int = 3, behind: Column | None = None) -> DataFrame:
    """A table with ts as a stream that brings a stretch of time for each micro-batch: `files` equal ones, one after the other, and the rows that are `behind` in a last one.

    A stretch is a file, or where every stretch has many rows the same number of files for each, written by as many tasks.
    """
    path = fresh_path(spark, what)
    # Worked out once, in as many tasks as it takes.
    rows = written(rows, f"{what}-rows")
    us = F.unix_micros("ts")
    lo, hi = rows.agg(F.min(us), F.max(us)).first()
    width = -(-((hi or 0) - (lo or 0) + 1) // files)
    number = F.floor((us - (lo or 0)) / width)
    last = F.coalesce(behind, F.lit(False)) if behind is not None else F.lit(False)
    stretches = [~last & (number == i) for i in range(files)] + ([last] if behind is not None else [])
    fewest = min(rows.agg(*[F.count_if(s) for s in stretches]).first())
    parts = max(1, fewest // FILE_ROWS)
    for stretch in stretches:
        rows.where(stretch).repartition(parts).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", parts).parquet(path)


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, which state of several kinds and timers need; the session's own provider afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain(stream: DataFrame, what: str, mode: str = "append", folders: tuple[str, str] | None = None) -> DataFrame:
    """Run a stream over all that its source holds now and give what its sink has: a Parquet table in the shared folder. With folders (of the sink and of the checkpoint) a later call goes on where this one ended."""
    spark = stream.sparkSession
    path, state = folders or (fresh_path(spark, what), fresh_path(spark, f"{what}-state"))
    schema = stream.schema

    def put(batch: DataFrame, number: int) -> None:
        # One folder for each batch, overwritten when the batch is tried again: nothing is written twice.
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def first_events(stream: DataFrame, key: str = "event_id", delay: str = "1 day") -> DataFrame:
    """The first event of every id; repeats within the delay are dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def daily_counts(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Facts of closed days; later rows than the delay are dropped by the watermark."""
    g = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "cents")


def runs(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Snapshot runs of a user, split at a gap; works on a stream (with a watermark) and on a table."""
    g = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


def repeats(events: DataFrame) -> DataFrame:
    """Actions of a user in sliding hours of half-hour steps: how often the same one was seen."""
    g = events.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "user_id", "event_type").agg(F.count("*").alias("n"))
    return g.select(F.unix_millis("w.start").alias("start_ms"), "user_id", "event_type", "n")


def feed_ages(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Latest event of each feed per closed day, for a watchdog that flags feeds whose last value is old."""
    g = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.max("ts").alias("last"))
    late = F.unix_timestamp("w.end") - F.unix_timestamp("last") > 3600
    return g.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", late.alias("stale"))


def accounted_days(stream: DataFrame, what: str, delay_hours: int = 24, folders: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, late) of a stream of events, drained: day, event_type, n, cents, closed of the rows that came in time, and the rows that came after their day had closed, so that both together are all rows.

    A day closes when an event of a later time than its end and the delay has been read; what a micro-batch brings is held against the
    days closed by those before it. Each micro-batch leaves its sums, its late rows and its latest time in folders of its own, which
    are overwritten when it is tried again; with folders given, a later call goes on where this one ended.
    """
    spark = stream.sparkSession
    path, state = folders or (fresh_path(spark, what), fresh_path(spark, f"{what}-state"))
    fields, delay_us, day_us = stream.schema, delay_hours * 3_600_000_000, 86_400_000_000
    us = F.unix_micros("ts")
    end = (F.floor(us / day_us) + 1) * day_us

    def clock(before: int) -> int:
        """Time up to which days are closed for a batch: that of the batches before it, less the delay."""
        seen = _table(spark, f"{path}/clock", "us long").where(F.col("batch") < before).agg(F.max("us")).first()[0]
        return -(2**62) if seen is None else seen - delay_us

    def put(batch: DataFrame, number: int) -> None:
        closed = F.lit(clock(number))
        batch = batch.persist()
        late = batch.where(end <= closed)
        late.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        sums = batch.where(end > closed).groupBy(F.floor(us / day_us).alias("d"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
        sums.write.mode("overwrite").parquet(f"{path}/sums/batch={number}")
        batch.agg(F.max(us).alias("us")).write.mode("overwrite").parquet(f"{path}/clock/batch={number}")
        batch.unpersist()

    q = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    closed = clock(2**31)
    g = _table(spark, f"{path}/sums", "d long, event_type string, n long, cents long").groupBy("d", "event_type").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))
    facts = g.select(F.date_format(F.timestamp_micros(F.col("d") * day_us), "yyyy-MM-dd").alias("day"), "event_type", "n", "cents", ((F.col("d") + 1) * day_us <= closed).alias("closed"))
    return facts, _table(spark, f"{path}/late", fields).drop("batch")


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The batches' folders under path, which may not be there yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*").withColumn("batch", F.regexp_extract(F.input_file_name(), "batch=([0-9]+)", 1).cast("int"))
