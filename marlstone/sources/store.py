"""The relational store as tables with declared columns, keys and checks; runs and snapshots as folders named by content and symbol."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.sources.shared import few, written


@dataclass(frozen=True)
class Table:
    """Columns as a schema string, the key, the column whose largest value is the newest version, and checks: code to a condition that holds."""

    schema: str
    key: tuple[str, ...]
    newest: str
    checks: dict[str, str] = field(default_factory=dict)


#: Fixed names: the eight core tables and the two of calibration.
TABLES = {
    "events": Table("event_id string, symbol string, event_type string, occurred_at timestamp, payload string", ("event_id",), "occurred_at", {"event_type_missing": "event_type is not null"}),
    "decisions": Table(
        "decision_id string, symbol string, direction string, action_level string, analysis_time timestamp, predicted double, entry_price double", ("decision_id",), "analysis_time",
        {"direction_unknown": "direction in ('long', 'short', 'watch', 'avoid', 'reduce', 'buy', 'sell', 'build', 'add')", "level_unknown": "action_level rlike '^L[0-5]$'", "predicted_out_of_range": "predicted is null or predicted between 0 and 1", "price_not_positive": "entry_price is null or entry_price > 0"},
    ),
    "results": Table("decision_id string, return_pct double, validation_time timestamp, failure_tags array<string>", ("decision_id",), "validation_time", {"return_missing": "return_pct is not null", "clock_missing": "validation_time is not null"}),
    "reviews": Table("review_id string, decision_id string, outcome string, reviewed_at timestamp", ("review_id",), "reviewed_at", {"outcome_unknown": "outcome in ('success', 'failure', 'neutral', 'mixed')"}),
    "state": Table("name string, value string, updated_at timestamp", ("name",), "updated_at"),
    "claims": Table("claim_id string, decision_id string, relation string, value string, polarity string, made_at timestamp", ("claim_id",), "made_at", {"polarity_unknown": "polarity in ('asserted', 'positive', 'negative')"}),
    "predictions": Table("prediction_id string, symbol string, direction string, reference_price double, due_at timestamp, made_at timestamp", ("prediction_id",), "made_at", {"due_before_made": "due_at > made_at", "price_not_positive": "reference_price > 0"}),
    "outcomes": Table("prediction_id string, status string, price double, settled_at timestamp", ("prediction_id",), "settled_at", {"status_unknown": "status in ('settled', 'expired', 'pending')"}),
    "calibration_samples": Table("sample_id string, symbol string, predicted_p double, outcome int, outcome_time timestamp", ("sample_id",), "outcome_time", {"predicted_out_of_range": "predicted_p between 0 and 1", "outcome_not_binary": "outcome in (0, 1)"}),
    "pending_predictions": Table("trade_lifecycle_id string, symbol string, predicted_p double, opened_at timestamp", ("trade_lifecycle_id",), "opened_at", {"predicted_out_of_range": "predicted_p between 0 and 1"}),
}


def shaped(rows: DataFrame, name: str) -> DataFrame:
    """rows with the table's columns and types; what does not fit its type is missing, what is not there too."""
    wanted = rows.sparkSession.createDataFrame([], TABLES[name].schema).schema
    simple = lambda f: F.col(f.name).try_cast(f.dataType.simpleString()) if not f.dataType.simpleString().startswith("array") else F.col(f.name)
    return rows.select(*[(simple(f) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted.fields])


def errors(name: str) -> Column:
    """Codes of the checks that a row breaks: a key that is missing, then the table's own; an unknown answer breaks a check."""
    t = TABLES[name]
    keys = [F.when(F.col(k).isNull(), f"{k}_missing") for k in t.key]
    return F.array_compact(F.array(*keys, *[F.when(~F.coalesce(F.expr(ok), F.lit(False)), code) for code, ok in t.checks.items()]))


def validated(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): rows that keep every check, and the others with their errors."""
    x = shaped(rows, name).withColumn("errors", errors(name))
    return x.where(F.size("errors") == 0).drop("errors"), x.where(F.size("errors") > 0)


def merged(current: DataFrame | None, rows: DataFrame, name: str) -> DataFrame:
    """The table after an upsert: of each key the newest version, ties to the later of the two."""
    t = TABLES[name]
    x = rows.withColumn("__later", F.lit(1))
    if current is not None:
        x = x.unionByName(current.withColumn("__later", F.lit(0)))
    w = Window.partitionBy(*t.key).orderBy(F.desc_nulls_last(t.newest), F.desc("__later"))
    return x.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__later")


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was based on."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def version(spark: SparkSession, root: str, name: str) -> int:
    """The newest committed version of a table, 0 before the first."""
    fs, at = _fs(spark, f"{root}/{name}/commits")
    return max((int(f.getPath().getName()) for f in fs.listStatus(at)), default=0) if fs.exists(at) else 0


def read_table(spark: SparkSession, root: str, name: str, at: int | None = None) -> DataFrame:
    """The table as it was committed at a version (the newest by default); without any, no rows."""
    n = version(spark, root, name) if at is None else at
    if n == 0:
        return spark.createDataFrame([], TABLES[name].schema)
    folder = spark.read.text(f"{root}/{name}/commits/{n:08d}").first()[0]
    return spark.read.schema(TABLES[name].schema).parquet(f"{root}/{name}/{folder}")


def commit(rows: DataFrame, root: str, name: str) -> int:
    """Upserts rows into a table under root and returns the new version: checked, merged and written aside, then named by a commit file.

    The commit file is the only thing that readers go by, and is created once: a write that fails before it leaves the old version, and
    of two writers that started from one version the second gets Conflict and has to merge anew. What a check rejects is kept, with
    its codes, beside the version. Older versions stay readable.
    """
    spark = rows.sparkSession
    base = version(spark, root, name)
    good, bad = validated(rows, name)
    folder = f"data/{base + 1:08d}-{uuid.uuid4().hex}"
    merged(read_table(spark, root, name, base), good, name).write.parquet(f"{root}/{name}/{folder}")
    bad.write.parquet(f"{root}/{name}/rejected/{folder.split('/')[1]}")
    fs, at = _fs(spark, f"{root}/{name}/commits/{base + 1:08d}")
    try:
        out = fs.create(at, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            raise Conflict(f"{name} is at version {version(spark, root, name)}, this write began at {base}") from None
        raise
    out.write(bytearray(folder.encode()))
    out.close()
    return base + 1


def rejected(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All rows that commits of a table rejected, with their errors."""
    fs, at = _fs(spark, f"{root}/{name}/rejected")
    schema = f"{TABLES[name].schema}, errors array<string>"
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{root}/{name}/rejected") if fs.exists(at) else spark.createDataFrame([], schema)


def upsert_days(rows: DataFrame, path: str, day: str, key: list[str], newest: str) -> None:
    """Upserts rows into a Parquet index with a folder for each day: only the folders of the days in rows are read and written anew, of each key its newest row stays.

    The days' old rows are written aside first, as a folder cannot be read while it is overwritten; Spark puts the new folders in place
    when all of them are written.
    """
    spark = rows.sparkSession
    fs, at = _fs(spark, path)
    x = rows.withColumn("__later", F.lit(1))
    if fs.exists(at):
        old = spark.read.schema(rows.schema).parquet(path).join(few(rows.select(day).distinct()), day, "left_semi")
        x = x.unionByName(written(old.select(*rows.columns), "days").withColumn("__later", F.lit(0)))
    w = Window.partitionBy(day, *key).orderBy(F.desc_nulls_last(newest), F.desc("__later"))
    x = x.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__later")
    x.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def run_id(parameters: dict) -> str:
    """Names a run by its parameters, whatever their order."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]


def write_run(rows: DataFrame, root: str, parameters: dict) -> str:
    """The rows of one run in a folder of its own; the same run written again replaces itself, and a run that fails leaves no result (Spark commits a job's files at its end)."""
    path = f"{root}/run_id={run_id(parameters)}"
    rows.write.mode("overwrite").parquet(path)
    return path


def freeze(rows: DataFrame, root: str) -> None:
    """Append observations (symbol, observed_at, ...), each symbol in its own folder."""
    rows.write.mode("append").partitionBy("symbol").parquet(root)


def frozen(spark: SparkSession, root: str, as_of: Column) -> DataFrame:
    """Of each symbol the newest observation at or before as_of; one that was frozen twice is one."""
    x = spark.read.parquet(root).where(F.col("observed_at") <= as_of)
    rest = [c for c in x.columns if c not in ("symbol", "observed_at")]
    return x.groupBy("symbol").agg(F.max(F.struct("observed_at", *rest)).alias("x")).select("symbol", "x.*")


def rename_parts(spark: SparkSession, path: str, column: str, name: str) -> None:
    """Files of a table written by partitions of `column` get the name that readers of foreign journals expect, with the column's value in it; a file for each value."""
    fs, at = _fs(spark, path)
    for folder in fs.listStatus(at):
        value = folder.getPath().getName().removeprefix(f"{column}=")
        for f in fs.listStatus(folder.getPath()) if folder.isDirectory() else []:
            if f.getPath().getName().startswith("part-"):
                fs.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder.getPath(), name.format(value)))
