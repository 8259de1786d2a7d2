"""Quality rules: base text statistics and cross-document line frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import WORD, digest, materialise, read


#: Words of a short line.
SHORT = 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_key(line: Column) -> Column:
    """128-bit key of the normalised line: A-Z and other letters lower-cased, digits to 0, runs of white space to one blank."""
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "), "[0-9]+", "0"))
    return _let(norm, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"))))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, wherever the optimizer puts the expression."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that the text has twice or more: windows are hashed to 64 bits, and only texts where two agree sort them."""

    def sorted_pairs(h: Column) -> Column:
        return F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))
    return F.when(F.size(w) < 4, 0).otherwise(_let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(sorted_pairs(h), covered))))


def base_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = _let(F.array_remove(F.split(t, r"[\x20\x09-\x0D]+", -1), ""), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("rep")))
    dup = _let(F.filter(_lines(t), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    df = df.withColumns({
        "__base": words,
        "word_chars": (F.length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": dup.cast("long"),
    })
    df = df.withColumns({"n_words": F.col("__base.n"), "n_repeat_words": F.col("__base.rep")}).drop("__base")
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def frequent_lines(docs: DataFrame, host: str, text: str, max_docs: int, max_share: float) -> tuple[DataFrame, DataFrame]:
    """(lines, limits): every row's lines with their words, and the line keys above the limit in a host.

    A line is above the limit where more than max_docs different texts of the host hold it, whatever the host's size; a line of one or
    two words, which texts share by chance, has to be in more than max_share of the host's texts as well. Exact copies of a text count
    once, so copies alone never make a line frequent.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    one = F.transform(_lines(t), lambda x: F.struct(_line_key(x).alias("key"), F.coalesce(F.regexp_count(x, F.lit(WORD)), F.lit(0)).alias("words")))
    # Written once: the texts are cut into lines a single time. explode_outer, so that an empty text still counts in its host.
    own = _keyed(docs, host, text).withColumn("__row", F.monotonically_increasing_id())
    lines = own.select(F.col("__host").alias("host"), F.col("__doc").alias("doc"), F.col("doc_id").alias("first"), F.col("__row").alias("row"), F.explode_outer(one).alias("l"))
    lines = materialise(lines.select("host", "doc", "first", "row", F.col("l.key").alias("key"), F.col("l.words").alias("words")), "lines")
    texts = lines.groupBy("host", "doc").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("texts"))
    lines = lines.where("key is not null")
    # First by (host, line, text), then by (host, line): a line that a third of all rows hold is never one group.
    held = lines.groupBy("host", "key", "doc").agg(F.min("first").alias("first"), F.max("words").alias("words"))
    counts = held.groupBy("host", "key").agg(F.count("*").alias("n"), F.max("words").alias("words"), F.min(F.struct(F.col("first").isNull(), "first", "doc")).alias("m"))
    limits = counts.where(F.col("n") > max_docs).join(texts, "host").where((F.col("words") > SHORT) | (F.col("n") > max_share * F.col("texts")))
    return lines, limits.select("host", "key", F.col("m.doc").alias("spared"))


def line_verdicts(docs: DataFrame, host: str = "source", text: str = "text", max_docs: int = 24, max_share: float = 0.0005, min_left: float = 0.35) -> DataFrame:
    """One row for each (host, text) that holds lines above the limits: n_removed_words, n_removed_lines, removed (line keys), depleted.

    The text with the smallest doc_id that holds such a line keeps it, so of a family of copies one stays whole.
    depleted: under min_left of the words are left.
    """
    lines, limits = frequent_lines(docs, host, text, max_docs, max_share)
    # By text, so copies are looked up once; repeats of a line are summed within one row, as rows with one id or none hold the text again.
    per_text = lines.groupBy("host", "doc", "row", "key").agg(F.sum("words").alias("words"), F.count("*").alias("n"))
    per_text = per_text.groupBy("host", "doc", "key").agg(F.min("words").alias("words"), F.min("n").alias("n"))
    hit = per_text.join(limits, ["host", "key"]).where(F.col("doc") != F.col("spared"))
    return hit.groupBy("host", "doc").agg(F.sum("words").alias("n_removed_words"), F.sum("n").alias("n_removed_lines"), F.collect_set("key").alias("removed")).withColumn("__left", F.lit(min_left))


def judge(docs: DataFrame, host: str = "source", text: str = "text", keep_removed: bool = False, **limits) -> DataFrame:
    """Each row of docs without its text, with its base statistics, n_removed_lines, n_removed_words, depleted, kept.

    Line frequency: hash every normalised line, count the different texts of each host that hold it, take the lines above the limits
    out, and reject what is then depleted. Null texts count as empty, null hosts are one host, empty lines are no lines; rows that
    repeat get the same verdict each. Columns of docs that clash with the added names are replaced. keep_removed leaves the keys
    __host and __doc of the text, and removed, the keys of its lines above the limits.
    """
    v = line_verdicts(docs, host, text, **limits).withColumnRenamed("host", "__host").withColumnRenamed("doc", "__doc")
    own = base_columns(_keyed(docs, host, text), text).drop(text, "n_removed_words", "n_removed_lines", "depleted", "kept", "removed")
    own = own.join(v if keep_removed else v.drop("removed"), ["__host", "__doc"], "left")
    gone = F.coalesce(F.col("n_removed_words"), F.lit(0)).cast("long")
    own = own.withColumns({"n_removed_words": gone, "n_removed_lines": F.coalesce(F.col("n_removed_lines"), F.lit(0)).cast("long")})
    own = own.withColumn("depleted", F.coalesce((F.col("n_words") - F.col("n_removed_words")) < F.col("__left") * F.col("n_words"), F.lit(False)))
    own = own.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted")).drop("__left")
    return own if keep_removed else own.drop("__host", "__doc")


def _keyed(docs: DataFrame, host: str, text: str) -> DataFrame:
    return docs.withColumns({"__host": F.xxhash64(F.col(host).isNull(), F.col(host)), "__doc": digest(F.col(text))})


def clean(docs: DataFrame, host: str = "source", text: str = "text", **limits) -> DataFrame:
    """The rows of docs that judge keeps, with their host's frequent lines taken out of text; other columns as they are.

    The verdicts, one small row for each host and text, are written first, so no statistic is computed twice.
    """
    found = materialise(judge(docs.select("doc_id", host, text), host, text, keep_removed=True, **limits), "verdicts")
    verdicts = found.where("kept").groupBy("__host", "__doc").agg(F.first("removed").alias("__removed"))
    own = _keyed(docs, host, text).join(verdicts, ["__host", "__doc"])
    left = F.array_join(F.filter(_lines(F.col(text)), lambda x: ~F.coalesce(F.array_contains(F.col("__removed"), _line_key(x)), F.lit(False))), "\n")
    return own.withColumn(text, F.when(F.col("__removed").isNull(), F.col(text)).otherwise(left)).select(*docs.columns)


def op2_quality_lines(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "n_removed_words", "depleted", "kept")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g2 AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS s FROM g),
g3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g2),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM g3 WHERE n > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS l FROM d),
nl AS (SELECT doc_id, source, t, l, trim(regexp_replace(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS k, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS nw FROM ln),
hosts AS (SELECT source, count(DISTINCT t) AS texts FROM d GROUP BY source),
lim AS (SELECT nl.source, k, max(nw) AS nw, count(DISTINCT t) AS n, arg_min(t, doc_id) AS spared FROM nl WHERE k <> '' GROUP BY nl.source, k),
over AS (SELECT lim.source, k, spared FROM lim JOIN hosts ON lim.source IS NOT DISTINCT FROM hosts.source WHERE n > 24 AND (nw > 2 OR n > 0.0005 * texts)),
gone AS (SELECT doc_id, count(*) AS rl, sum(nw) AS rw FROM nl JOIN over ON nl.source IS NOT DISTINCT FROM over.source AND nl.k = over.k WHERE nl.t <> over.spared GROUP BY doc_id),
s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
  (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(rl, 0)::BIGINT AS n_removed_lines, coalesce(rw, 0)::BIGINT AS n_removed_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN gone ON w.doc_id = gone.doc_id),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, (n_words - n_removed_words < 0.35 * n_words) AS depleted FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_lines, n_removed_words, depleted, (NOT base_failed AND NOT depleted) AS kept FROM b
"""
