"""Scans and row normalisers: bar files, journals, JSON payloads, option codes, source cascades."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.numeric import parse_number
from marlstone.sources.shared import few

BAR = "struct<date:string,open:double,close:double,high:double,low:double,volume:double,amount:double,turnover_rate:double,pct_change:double>"
PANEL = f"symbol string, market string, source string, adjust string, basis string, caveats array<string>, rows array<{BAR}>"


def load_panels(spark: SparkSession, path: str, wanted: DataFrame | None = None, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(bars, gaps) from one JSON file per panel, or from files of any number of panels, one a line. A symbol of more than one source is not eligible for nulls; a wanted symbol without rows is a gap, not an error."""
    raw = spark.read.schema(PANEL).option("multiLine", not lines).json(path)
    x = raw.select("symbol", "market", F.col("source").alias("panel_source"), F.col("adjust").alias("panel_adjust"), "caveats", F.explode("rows").alias("r")).select("*", "r.*").drop("r")
    kinds = x.groupBy("symbol").agg(F.count_distinct("panel_source").alias("sources"))
    bars = x.join(kinds, "symbol").withColumn("null_eligible", F.col("sources") <= 1).drop("sources")
    gaps = (wanted or raw.select("symbol")).select("symbol").distinct().join(bars.select("symbol").distinct(), "symbol", "left_anti").withColumn("reason_code", F.lit("panel_missing_or_empty"))
    return bars, gaps


def read_journal(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, gaps) of a JSON-lines journal; malformed lines go to the gaps, empty ones are none."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    x = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema + ", _bad string", options).alias("r")).select("r.*")
    return x.where("_bad is null").drop("_bad"), x.where("_bad is not null").select(F.col("_bad").alias("line"), F.lit("malformed_line").alias("reason_code"))


def universe(spark: SparkSession, paths: list[str], most: int = 10_000) -> DataFrame:
    """symbol, layer, place of the symbols that the files list, in the order of the files and their lines, each where it is seen first.

    A file is a list with one symbol a line (what follows a blank is ignored, lines that begin with # are comments) or a JSON policy
    with universe_core and universe_probation.symbols (texts, or objects with a symbol). Lists are small by nature: each is read as one
    text. More than `most` symbols, or none, raise ValueError.
    """
    policy = "universe_core array<string>, universe_probation struct<symbols:array<string>>"
    parts = []
    for i, path in enumerate(paths):
        t = spark.read.text(path, wholetext=True).withColumn("j", F.from_json("value", policy))
        of = lambda items: F.transform(items, lambda s: F.when(s.startswith("{"), F.get_json_object(s, "$.symbol")).otherwise(s))
        lines = F.transform(F.filter(F.split("value", "\n"), lambda s: ~F.ltrim(s).startswith("#")), lambda s: F.substring_index(F.regexp_replace(F.trim(s), r"\s+", " "), " ", 1))
        is_policy = F.col("j.universe_core").isNotNull() | F.col("j.universe_probation").isNotNull()
        none = F.array().cast("array<string>")
        layers = F.when(is_policy, F.array(F.struct(F.lit("core").alias("layer"), of(F.coalesce("j.universe_core", none)).alias("s")), F.struct(F.lit("probation").alias("layer"), of(F.coalesce("j.universe_probation.symbols", none)).alias("s")))).otherwise(F.array(F.struct(F.lit("list").alias("layer"), lines.alias("s"))))
        x = t.select(F.lit(i).alias("file"), F.posexplode(layers).alias("part", "l")).select("file", "part", "l.layer", F.posexplode("l.s").alias("line", "symbol"))
        parts.append(x.withColumn("symbol", F.upper(F.trim("symbol"))).where("symbol <> ''"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    first = every.groupBy("symbol").agg(F.min(F.struct("file", "part", "line", "layer")).alias("at"))
    n = first.count()
    if not 0 < n <= most:
        raise ValueError(f"{n} symbols; from 1 to {most} are allowed")
    # At most `most` rows: one window over them numbers the list.
    return first.select("symbol", "at.layer", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at")).alias("place"))


def in_window(files: DataFrame, first: Column, last: Column) -> DataFrame:
    """Files (column path) whose name holds a time stamp yyyymmddThhmmss within the window; others are pruned before they are read."""
    at = F.try_to_timestamp(F.regexp_extract("path", r"(\d{8}T\d{6})", 1), F.lit("yyyyMMdd'T'HHmmss"))
    return files.withColumn("stamp", at).where((F.col("stamp") >= first) & (F.col("stamp") < last))


#: A file name with the time from which its lines are: name_yyyyMMddTHHmmss_rest.
STAMPED = r"_(\d{8}T\d{6})_"


def window_globs(first: datetime, last: datetime, name: str) -> str:
    """A glob of the file names of the days from first to before last: whole years and months by their prefix."""
    parts, day, end = [], first.date(), (last - timedelta(microseconds=1)).date()
    while day <= end:
        year, month = date(day.year + 1, 1, 1), date(day.year + day.month // 12, day.month % 12 + 1, 1)
        if (day.month, day.day) == (1, 1) and year <= end + timedelta(days=1):
            parts.append(f"{day:%Y}")
            day = year
        elif day.day == 1 and month <= end + timedelta(days=1):
            parts.append(f"{day:%Y%m}")
            day = month
        else:
            parts.append(f"{day:%Y%m%d}")
            day += timedelta(days=1)
    return f"{name}_{{{','.join(parts)}}}*"


def scan_window(spark: SparkSession, path: str, name: str, schema: str, first: datetime, last: datetime) -> tuple[DataFrame, DataFrame]:
    """(rows, gaps) of the JSON-lines files under path whose name has a time from first to before last; day of the days in between that have no file.

    The names decide while the files are listed: files of other days are neither planned nor opened. Of the days at the ends, the time
    in the name decides. Malformed lines are rows without values.
    """
    if last <= first:
        raise ValueError("the window is empty")
    x = spark.read.schema(schema).option("pathGlobFilter", window_globs(first, last, name)).option("recursiveFileLookup", True).json(path)
    stamp = F.to_timestamp(F.regexp_extract(F.col("_metadata.file_name"), STAMPED, 1), "yyyyMMdd'T'HHmmss")
    x = x.withColumn("stamp", stamp).where((F.col("stamp") >= F.lit(first)) & (F.col("stamp") < F.lit(last)))
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first.date()), F.lit((last - timedelta(microseconds=1)).date()))).alias("day"))
    return x, days.join(x.select(F.to_date("stamp").alias("day")).distinct(), "day", "left_anti")


def normalise_bars(raw: DataFrame, order: str) -> DataFrame:
    """Typed bars from text fields: bad dates go, of a date's rows the last by order wins, pct_change is against the day before."""
    x = raw.withColumn("date", F.date_format(F.try_to_date("date", "yyyy-MM-dd"), "yyyy-MM-dd")).where("date is not null")
    x = x.withColumns({c: parse_number(F.col(c).cast("string")) for c in ("close", "volume")})
    x = x.withColumn("__n", F.row_number().over(Window.partitionBy("symbol", "date").orderBy(F.desc(order)))).where("__n = 1").drop("__n", order)
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    return x.withColumn("pct_change", 100 * (F.try_divide(F.col("close"), before) - 1))


def cascade(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """The first source, in the order given, that has rows for a key; its number in source_no."""
    tagged = [d.withColumn("source_no", F.lit(i)) for i, d in enumerate(sources)]
    x = tagged[0]
    for d in tagged[1:]:
        x = x.unionByName(d)
    return x.withColumn("__m", F.min("source_no").over(Window.partitionBy(*keys))).where(F.col("source_no") == F.col("__m")).drop("__m")


def cascade_status(sources: list[DataFrame], expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source_no, n, failure for every expected key: the source that it is taken from and its rows there, or no_source_has_rows."""
    got = cascade(sources, keys).groupBy(*keys).agg(F.first("source_no").alias("source_no"), F.count("*").alias("n"))
    x = expected.select(*keys).distinct().join(got, keys, "left")
    return x.select(*keys, "source_no", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.when(F.col("n").isNull(), "no_source_has_rows").alias("failure"))


def provenance(bars: DataFrame, allowed: DataFrame) -> DataFrame:
    """symbol, sources, adjusts, status: more than one basis, or a market and source that are not allowed together, fails closed."""
    g = bars.groupBy("symbol", "market").agg(F.array_sort(F.collect_set("panel_source")).alias("sources"), F.count_distinct("panel_adjust").alias("adjusts"), F.count("*").alias("rows_"))
    legal = bars.select("symbol", "market", "panel_source").distinct().join(few(allowed), ["market", "panel_source"], "left_anti").groupBy("symbol").agg(F.count("*").alias("illegal"))
    x = g.join(legal, "symbol", "left").na.fill(0, ["illegal"])
    return x.withColumn("status", F.when(F.col("illegal") > 0, "illegal_source").when((F.size("sources") > 1) | (F.col("adjusts") > 1), "mixed_basis").otherwise("ok"))


def option_code(code: Column) -> dict[str, Column]:
    """root, expiry, side, strike of an option code: letters, yymmdd, C or P, strike in thousandths."""
    p = r"^([A-Z]{1,6})(\d{6})([CP])(\d{8})$"
    return {"root": F.nullif(F.regexp_extract(code, p, 1), F.lit("")), "expiry": F.try_to_date(F.regexp_extract(code, p, 2), "yyMMdd"), "side": F.nullif(F.regexp_extract(code, p, 3), F.lit("")), "strike": F.regexp_extract(code, p, 4).try_cast("double") / 1000}


def retention_plan(files: DataFrame, as_of: Column, keep_days: int) -> DataFrame:
    """month, files, bytes of what is older than keep_days (columns modified, bytes)."""
    old = files.where(F.col("modified") < as_of - F.make_interval(days=F.lit(keep_days)))
    return old.groupBy(F.date_format("modified", "yyyy-MM").alias("month")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
