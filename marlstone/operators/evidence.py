"""Search hits, coverage, provenance, decisions and scores as grouped jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import title_key
from marlstone.sources.shared import few


def merge_hits(hits: DataFrame) -> DataFrame:
    """One row for each merged hit of (pos, url, title, engine, family, snippet, freshness): a title key of 12 or more characters seen before wins over the address.

    Stale and future hits go first. The first hit by pos gives title and address.
    """
    h = hits.where(~F.col("freshness").isin("stale", "future_timestamp") & (F.col("url") != "") & (F.col("title") != ""))
    h = h.withColumn("tk", title_key(F.col("title")))
    key = F.when(F.length("tk") >= 12, F.concat(F.lit("t:"), "tk")).otherwise(F.concat(F.lit("u:"), "url"))
    g = h.withColumn("key", key).groupBy("key").agg(
        F.min_by("url", "pos").alias("url"), F.min_by("title", "pos").alias("title"), F.min("pos").alias("first_pos"), F.count("*").alias("hits"), F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"), F.count_distinct("family").alias("families"),
        F.min(F.when(F.col("freshness") == "unknown", 1).otherwise(0)).alias("fresh_rank"),
    )
    return g.withColumn("attention", F.when(F.col("families") >= 3, "broad").when(F.col("families") >= 2, "emerging").otherwise("quiet"))


def coverage(targets: DataFrame, dimensions: DataFrame, observations: DataFrame, least_families: int) -> DataFrame:
    """target, dimension, families, state for every cell of the grid, missing ones too. targets and dimensions are the two axes of a report.

    The dimensions are one list, which every target is spread over.
    """
    usable = F.col("usable")
    o = observations.groupBy("target", "dimension").agg(F.count_distinct(F.when(usable, F.col("family"))).alias("families"), F.count("*").alias("rows_"))
    # One row, an array as long as the report is wide.
    axis = dimensions.agg(F.array_sort(F.collect_set("dimension")).alias("dimensions"))
    grid = targets.join(F.broadcast(axis)).select("target", F.explode("dimensions").alias("dimension"))
    x = grid.join(o, ["target", "dimension"], "left").na.fill(0, ["families", "rows_"])
    state = F.when(F.col("rows_") == 0, "missing").when(F.col("families") == 0, "unusable").when(F.col("families") < least_families, "partial").otherwise("covered")
    return x.withColumn("state", state)


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def module_multiplier(signals: DataFrame) -> DataFrame:
    """decision_id, multiplier: the least of each module, multiplied over the modules."""
    return signals.groupBy("decision_id", "module").agg(F.min("multiplier").alias("m")).groupBy("decision_id").agg(F.product("m").alias("multiplier"), F.count("*").alias("modules"))


LEVELS = ("L0", "L1", "L2", "L3", "L4", "L5")


def level_no(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), c) - 1


def apply_caps(signals: DataFrame, caps: DataFrame) -> DataFrame:
    """signals with level_out and changed: a module's cap may lower the level, never raise it; modules without a cap keep theirs."""
    x = signals.join(few(caps), "module", "left")
    out = F.least(level_no(F.col("level")), F.coalesce(level_no(F.col("cap")), F.lit(5)))
    return x.withColumn("level_out", F.concat(F.lit("L"), out.cast("string"))).withColumn("changed", F.col("level_out") != F.col("level"))


def compile_decisions(signals: DataFrame) -> DataFrame:
    """decision_id, posture: any hard veto blocks; allow against deny is a conflict; else the least level over all signals stands."""
    g = signals.groupBy("decision_id").agg(F.max("veto").alias("veto"), F.count_distinct("entry").alias("entries"), F.min(level_no(F.col("level"))).alias("least"), F.count("*").alias("signals"))
    posture = F.when(F.col("veto"), "blocked").when(F.col("entries") > 1, "conflict").otherwise(F.concat(F.lit("L"), F.col("least").cast("string")))
    return g.select("decision_id", "signals", posture.alias("posture"))


def weighted_score(x: DataFrame, weights: dict[str, float], top: float, penalty: Column | None = None, per_point: float = 2.0) -> Column:
    """Sum of rating / top * weight less per_point for each penalty point, within 0 and 100."""
    s = sum((F.col(c) / top * w for c, w in weights.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), s - (per_point * penalty if penalty is not None else 0.0)))


def band(score: Column, edges=((85, "A"), (70, "B"), (55, "C"))) -> Column:
    out = F.lit("D")
    for edge, name in reversed(edges):
        out = F.when(score >= edge, name).otherwise(out)
    return out


def contract_errors(rules: dict[str, Column]) -> Column:
    """The codes of the rules that a row breaks, in the order of the rules; a rule that is unknown counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()]))


def contained_quotes(quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """quote_id, found: the quote's text, white space folded, lies in the text of the document it cites."""
    fold = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    x = quotes.join(documents.select("doc_id", F.col("text").alias("__t")), "doc_id", "left")
    return x.select("quote_id", "doc_id", F.coalesce(F.contains(fold(F.col("__t")), fold(F.col("text"))), F.lit(False)).alias("found"))


def latest_by(x: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return x.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


#: Parts of a key's name that make it sensitive, whole names that do, and names that are public all the same.
SENSITIVE_PARTS = (
    "api_key", "secret", "passphrase", "access_token", "refresh_token", "bearer_token", "auth_token", "session_token", "id_token", "api_token", "private_key",
    "password", "authorization", "cookie", "mnemonic", "seed_phrase", "access_key", "access_sign", "signature",
)
SENSITIVE_NAMES = ("token", "auth", "credential", "credentials", "header", "headers", "sign")
PUBLIC_NAMES = ("token_contract", "token_address")


#: Full-width forms and what they stand for.
_WIDE, _PLAIN = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))


def has_sensitive_key(payload: Column) -> Column:
    """Whether a key anywhere in a JSON text is sensitive. Keys are decoded first; a key with a letter or digit that is not ASCII, full-width forms apart, is sensitive whatever it says, as is one that can't be decoded. Texts that are values are no keys."""
    plain = lambda words: [w.replace("_", "") for w in words]
    # String by string from the start, so that no match begins inside a value; a key is one that a colon follows.
    strings = F.regexp_extract_all(payload, F.lit(r'"(?:[^"\\]|\\.)*+"(?:\s*:)?'), F.lit(0))
    keys = F.transform(F.filter(strings, lambda s: s.endswith(":")), lambda s: F.regexp_replace(s, r"\s*:$", ""))
    # All keys of a payload as one array: escapes are read by the parser of JSON.
    decoded = F.from_json(F.concat(F.lit("["), F.array_join(keys, ","), F.lit("]")), "array<string>")
    names = F.transform(decoded, lambda k: F.translate(k, _WIDE, _PLAIN))
    foreign = lambda k: k.rlike(r"[\p{L}\p{N}&&[^\x00-\x7F]]")
    bare = lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", "")
    known = lambda k: ~k.isin(*plain(PUBLIC_NAMES)) & (k.isin(*plain(SENSITIVE_NAMES)) | k.startswith("okaccess") | k.rlike("|".join(plain(SENSITIVE_PARTS))))
    return F.when(payload.isNull() | (F.size(keys) == 0), False).otherwise(F.coalesce(F.exists(names, lambda k: foreign(k) | known(bare(k))), F.lit(True)))


def is_live(closed: Column, active: Column) -> Column:
    """A market is live unless it says that it is closed or not active; its end date is not to be trusted."""
    return ~F.coalesce(closed, F.lit(False)) & F.coalesce(active, F.lit(True))


def ordered_distinct(*lists: str) -> Column:
    """The values of several lists one after the other, each at its first place only; missing ones go."""
    return F.array_compact(F.array_distinct(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists])))


def confirmed_factors(registry: DataFrame, factors: list[str], market: str) -> DataFrame:
    """factor, id, confirmations: rows (id, status, tags) that are confirmed alive for the market, by the factors that they name; id is the newest."""
    alive = registry.where((F.col("status") == "confirmed_alive") & F.array_contains("tags", market))
    named = alive.select("id", F.explode(F.array_intersect("tags", F.array(*[F.lit(f) for f in factors]))).alias("factor"))
    return named.groupBy("factor").agg(F.max("id").alias("id"), F.count("*").alias("confirmations"))


def card_errors(cards: DataFrame, documents: DataFrame) -> DataFrame:
    """card, errors: codes of method cards (card, author, sources, covered): no author, a source that is no document (doc_id, access_state), a restricted source that no gap covers."""
    used = cards.select("card", "covered", F.explode(F.array_distinct("sources")).alias("doc_id")).join(documents.select("doc_id", "access_state"), "doc_id", "left")
    bare = F.col("access_state").isin("subscriber_only", "blocked") & ~F.array_contains("covered", F.col("doc_id"))
    found = used.groupBy("card").agg(F.max(F.col("access_state").isNull()).alias("lost"), F.max(F.coalesce(bare, F.lit(False))).alias("bare"))
    x = cards.join(found, "card", "left")
    codes = F.array_compact(F.array(F.when(F.col("author").isNull(), "card_identity_missing"), F.when(F.size("sources") == 0, "card_sources_missing"), F.when(F.col("lost"), "card_source_missing"), F.when(F.col("bare"), "restricted_source_gap_missing")))
    return x.select("card", codes.alias("errors"))


def guard_cases(tags: DataFrame, cases: dict[str, str]) -> DataFrame:
    """tag, n, guard_case: the case that guards against a failure tag; tags without one go to manual review."""
    case = F.lit("manual_review")
    for tag, name in cases.items():
        case = F.when(F.col("tag") == tag, name).otherwise(case)
    return tags.groupBy("tag").agg(F.count("*").alias("n")).withColumn("guard_case", case)
