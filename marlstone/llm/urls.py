"""URL filter by the ratio of two character language models, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import LOWER, UPPER, materialise, read, small

#: Fixed rules: (host, path, verdict). A rule fits its host and all subdomains where the url's path starts with its path.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
ORDER = 4
#: Symbols of the models: a-z, 0 for every digit, 11 marks, the start, and * for all else. Grams are bounded by 40 ** ORDER.
START, OTHER = "^", "*"
SYMBOLS = 40
MOST_GRAMS = 400_000


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to / ? # or the end, A-Z lower-cased; then up to ? # or the end. Else both empty."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3, F.length(url))
    host = F.when(at > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER))
    path = F.when(at > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else null; rules of equal length by their text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def folded(host: Column, path: Column) -> Column:
    """A url in the models' symbols, behind the start marks."""
    s = F.regexp_replace(F.translate(F.concat(host, path), UPPER, LOWER), r"[0-9]+", "0")
    return F.concat(F.lit(START * (ORDER - 1)), F.regexp_replace(s, r"[^a-z0./_=&%~:+-]", OTHER))


def _grams(s: Column) -> Column:
    return F.when(F.length(s) >= ORDER, F.transform(F.sequence(F.lit(1), F.length(s) - ORDER + 1), lambda i: F.substr(s, i, F.lit(ORDER))))


def gram_table(urls: DataFrame) -> DataFrame:
    """gram, llr: log probability of the gram's last symbol after its first ones, under the accepted less under the rejected model.

    urls: folded, accepted, rejected, n (how often). Variable order by Witten-Bell smoothing: a context speaks as far as it has been seen,
    the rest is left to the context without its first symbol, down to equal chances. Every gram of any url has a row, seen in training or
    not; the counts of all orders come from those of the longest.
    """
    g = urls.select(F.explode(_grams(F.col("folded"))).alias("gram"), "accepted", "rejected", "n")
    full = g.groupBy("gram").agg(F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("rejected"), F.col("n")).otherwise(0)).alias("r"))
    full = materialise(full, "grams")
    lower: DataFrame | None = None
    for k in range(1, ORDER + 1):
        own = full.groupBy(F.substring("gram", -k, k).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")) if k < ORDER else full.withColumnRenamed("gram", "g")
        context = Window.partitionBy(F.substring("g", 1, k - 1))
        if k == 1:  # one row a symbol, 40 at most
            context = Window.partitionBy(F.lit(0))
            below = own.withColumns({"pa": F.lit(1.0 / SYMBOLS), "pr": F.lit(1.0 / SYMBOLS)})
        else:
            below = own.withColumn("s", F.substring("g", 2, k - 1)).join(lower.withColumnRenamed("g", "s"), "s").drop("s")
        for c, p in (("a", "pa"), ("r", "pr")):
            n, kinds = F.sum(c).over(context), F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).over(context)
            below = below.withColumn(f"new_{p}", F.when(n > 0, (F.col(c) + kinds * F.col(p)) / (n + kinds)).otherwise(F.col(p)))
        lower = below.select("g", F.col("new_pa").alias("pa"), F.col("new_pr").alias("pr"))
    return lower.select(F.col("g").alias("gram"), (F.ln("pa") - F.ln("pr")).alias("llr"))


def scored(urls: DataFrame, table: DataFrame) -> DataFrame:
    """folded, score: the sum of llr over the url's grams by their number; urls has one row for each folded url."""
    # The table's rows are bounded by the symbols, not by the urls: at most 40 ** ORDER. Counted, it is broadcast up to MOST_GRAMS, so
    # that the grams of the urls stay where they are.
    at = urls.select("folded", F.explode(_grams(F.col("folded"))).alias("gram")).join(small(table, MOST_GRAMS), "gram")
    return at.groupBy("folded").agg(F.avg("llr").alias("score"))


def cut_off(scores: DataFrame) -> DataFrame:
    """One row, cut: the score at or above which most urls of known verdict are right, both verdicts weighing the same.

    From a histogram of 2,000 bins between -10 and 10; of equal cuts the one nearest to 0, then the smaller. 0 without both verdicts.
    """
    b = F.greatest(F.lit(0), F.least(F.lit(1999), F.floor((F.col("score") + 10) * 100))).cast("int")
    h = scores.groupBy(b.alias("b")).agg(F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("rejected"), F.col("n")).otherwise(0)).alias("r"))
    run, every = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    h = h.withColumns({"a_below": F.coalesce(F.sum("a").over(run), F.lit(0)), "r_below": F.coalesce(F.sum("r").over(run), F.lit(0)), "all_a": F.sum("a").over(every), "all_r": F.sum("r").over(every)})
    right = (F.col("all_a") - F.col("a_below")) / F.col("all_a") + F.col("r_below") / F.col("all_r")
    cut = F.col("b") / 100.0 - 10
    both = (F.col("all_a") > 0) & (F.col("all_r") > 0)
    best = h.where(both).agg(F.max(F.struct(F.round(F.try_divide(right, F.lit(1)), 12).alias("right"), (-F.abs(cut)).alias("near"), (-cut).alias("minus"))).alias("m"))
    return best.select(F.coalesce(-F.col("m.minus"), F.lit(0.0)).alias("cut"))


def judge(pages: DataFrame, url: str = "url", rules=RULES, holdout: int = 5) -> DataFrame:
    """pages with host, path, rule, score, verdict: the rule's verdict where one fits, else allow where score reaches the cut.

    Trained on the urls whose verdict a rule gives; one in holdout of them (by hash) is left out of training and sets the cut. Every
    distinct folded url is scored once; a url that fills a third of the table is one row with its count. Empty hosts and paths score 0:
    such a url is allowed if the cut is at most 0. Null urls count as empty; repeated rows get equal verdicts; columns of pages that
    clash with the added names are replaced.
    """
    host, path = parts(F.col(url))
    own = pages.drop("host", "path", "rule", "score", "verdict").withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "__v": verdict, "__folded": folded(F.col("host"), F.col("path"))})
    urls = own.groupBy(F.col("__folded").alias("folded")).agg(
        F.sum(F.when(F.col("__v") == "allow", 1).otherwise(0)).alias("na"), F.sum(F.when(F.col("__v") == "block", 1).otherwise(0)).alias("nr"), F.count("*").alias("n")
    )
    urls = materialise(urls.withColumn("held", F.pmod(F.xxhash64("folded"), F.lit(holdout)) == 0), "urls")
    known = lambda held, both: both.where(held).select("folded", "score" if "score" in both.columns else F.lit(0.0).alias("score"), F.explode(F.array(F.struct(F.lit(True).alias("accepted"), F.lit(False).alias("rejected"), F.col("na").alias("n")), F.struct(F.lit(False).alias("accepted"), F.lit(True).alias("rejected"), F.col("nr").alias("n")))).alias("x")).select("folded", "score", "x.*")
    train = known(F.lit(True), urls.withColumns({"na": F.when(F.col("held"), 0).otherwise(F.col("na")), "nr": F.when(F.col("held"), 0).otherwise(F.col("nr"))}))
    table = materialise(gram_table(train), "llr")
    scores = materialise(scored(urls.select("folded"), table), "scores")
    cut = cut_off(known(F.col("held"), urls.join(scores, "folded"))).first()["cut"]
    out = own.join(scores.withColumnRenamed("folded", "__folded"), "__folded", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.withColumn("verdict", F.coalesce("__v", F.when(F.col("score") >= cut, "allow").otherwise("block"))).drop("__v", "__folded")


def op9_url_char_lm(spark, sf_dir):
    found = judge(read(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", "score")
