"""Text, search hits, coverage, provenance and decisions over the given tables, and the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import evidence as ev
from marlstone.sources.bindings import events, read

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CANON = """CASE WHEN regexp_matches(url, '(?i)^https?://[^/?#]+') THEN lower(regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1))
  || regexp_replace(CASE WHEN regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1) END, '/{2,}', '/', 'g')
  || CASE WHEN qs = '' THEN '' ELSE '?' || qs END ELSE '' END"""
URLS = """u0 AS (SELECT page_id, trim(coalesce(url, '')) AS url, html FROM pages), u1 AS (SELECT *, array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN ('fbclid','gclid','mc_cid','mc_eid','ref','ref_src','spm')), '&') AS qs FROM u0)"""


@query(f"WITH {URLS} SELECT page_id, {CANON} AS canonical FROM u1")
def f01_canonical_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("canonical"))


TITLE = "trim(regexp_extract(html, '(?is)<title>([^<]*)</title>', 1))"


@query(f"SELECT page_id, regexp_replace(lower({TITLE}), '[^a-z0-9\\x{{3400}}-\\x{{9fff}}]+', '', 'g') AS title_key FROM pages")
def f02_title_key(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", tx.title_key(tx.title(F.col("html"))).alias("title_key"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{3400}-\\x{9fff}]') THEN 'zh' ELSE 'en' END AS script FROM documents")
def f03_language(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.language(F.col("text")).alias("script"))


@query("SELECT page_id, count(*) AS links, count(DISTINCT l) AS distinct_links FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS l FROM pages) GROUP BY page_id")
def s17_link_extraction(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.explode(tx.links(F.col("html"))).alias("l")).groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("l").alias("distinct_links"))


@query(r"""WITH w AS (SELECT doc_id, text, string_split_regex(text, '[ \t\n\f\r\v,;]+') AS ws, regexp_extract_all(text, '[ \t\n\f\r\v,;]+') AS gs FROM documents),
x AS (SELECT doc_id, text, unnest(list_transform(range(1, len(ws) + 1), lambda i: {'i': i, 'w': ws[i], 'b': CASE WHEN i > 1 THEN ws[i - 1] ELSE '' END, 'bb': CASE WHEN i > 2 THEN ws[i - 2] ELSE '' END, 'gb': i > 1 AND NOT regexp_matches(gs[i - 1], '[,;]'), 'gbb': i > 2 AND NOT regexp_matches(gs[i - 2], '[,;]'), 'g': coalesce(gs[i], '')})) AS s FROM w),
y AS (SELECT doc_id, s.i AS i, s.w AS w, s.g AS g, s.b AS b, s.bb AS bb, s.gb AS gb, s.gbb AS gbb, regexp_extract_all(s.w, '[^=:]*[=:]|[^=:]+$') AS ps FROM x),
nm AS (SELECT *, list_transform(ps, lambda p: right(p, 1) IN ('=', ':') AND len(list_filter(['apikey', 'accesstoken', 'secret', 'password', 'passphrase'], lambda n: suffix(translate(lower(regexp_extract(left(p, -1), '[A-Za-z0-9_-]*$')), '-_', ''), n))) > 0) AS hit,
  len(list_filter(['apikey', 'accesstoken', 'secret', 'password', 'passphrase'], lambda n: suffix(translate(lower(regexp_extract(regexp_replace(b, '[=:]$', ''), '[A-Za-z0-9_-]*$')), '-_', ''), n))) > 0 AS nb,
  len(list_filter(['apikey', 'accesstoken', 'secret', 'password', 'passphrase'], lambda n: suffix(translate(lower(regexp_extract(b, '[A-Za-z0-9_-]*$')), '-_', ''), n))) > 0 AS nw,
  len(list_filter(['apikey', 'accesstoken', 'secret', 'password', 'passphrase'], lambda n: suffix(translate(lower(regexp_extract(bb, '[A-Za-z0-9_-]*$')), '-_', ''), n))) > 0 AS nbb FROM y),
f AS (SELECT *, list_position(hit[1:len(hit) - 1], true) AS k FROM nm),
z AS (SELECT doc_id, i, CASE WHEN w = '' THEN w WHEN gb AND right(b, 1) IN ('=', ':') AND (CASE WHEN b IN ('=', ':') THEN gbb AND nbb ELSE nb END) THEN '<redacted>' WHEN gb AND len(w) > 1 AND left(w, 1) IN ('=', ':') AND nw THEN left(w, 1) || '<redacted>' WHEN k > 0 THEN array_to_string(ps[1:k], '') || '<redacted>'
  WHEN gb AND regexp_matches(lower(b), '\bbearer$') THEN regexp_replace(w, '^[A-Za-z0-9._~+/-]+=*', '<redacted>') ELSE w END || g AS o FROM f),
r AS (SELECT doc_id, string_agg(o, '' ORDER BY i) AS s FROM z GROUP BY doc_id)
SELECT d.doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN regexp_matches(lower(l), 'token|credential|auth|/home/') THEN '[redacted]' ELSE l END), chr(10))) AS redacted_md5, md5(r.s) AS scrubbed_md5 FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id""")
def p12_redaction(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(tx.redact_lines(t, "/home/")).alias("redacted_md5"), F.md5(tx.scrub(t)).alias("scrubbed_md5"))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\\s*[-*]\\s'))) AS bullets, len(list_filter(string_split(text, chr(10)), lambda l: contains(l, '|'))) AS table_lines, regexp_matches(text, '(?i)password|token') AS has_secret_word, CASE WHEN regexp_matches(text, '(?i)lorem ipsum|todo|tbd') THEN 1 ELSE 0 END AS placeholder FROM documents")
def p20_document_lint(spark, sf_dir):
    ls = F.split("text", "\n", -1)
    n = lambda f: F.size(F.filter(ls, f)).cast("long")
    return read(spark, sf_dir, "documents").select("doc_id", F.size(ls).cast("long").alias("lines"), n(lambda x: x.rlike(r"^\s*[-*]\s")).alias("bullets"), n(lambda x: x.contains("|")).alias("table_lines"), F.col("text").rlike("(?i)password|token").alias("has_secret_word"), F.when(F.col("text").rlike("(?i)lorem ipsum|todo|tbd"), 1).otherwise(0).alias("placeholder"))


@query("SELECT doc_id, n AS matched, round(n / 4.0, 3) AS relevance, n >= 2 AS relevant FROM (SELECT doc_id, (regexp_matches(lower(text), '(^|[^a-z0-9])the([^a-z0-9]|$)')::INT + regexp_matches(lower(text), '(^|[^a-z0-9])license([^a-z0-9]|$)')::INT + regexp_matches(lower(text), '(^|[^a-z0-9])der([^a-z0-9]|$)')::INT + regexp_matches(lower(text), '(^|[^a-z0-9])mit([^a-z0-9]|$)')::INT) AS n FROM documents)")
def p19_query_relevance(spark, sf_dir):
    n = sum((tx.has_keyword(F.col("text"), w).cast("int") for w in ("the", "license", "der", "mit")), F.lit(0))
    return read(spark, sf_dir, "documents").select("doc_id", n.alias("matched")).select("doc_id", "matched", F.round(F.col("matched") / 4.0, 3).alias("relevance"), (F.col("matched") >= 2).alias("relevant"))


@query("SELECT doc_id, regexp_matches(text, '(?i)(^|[^a-z0-9])license([^a-z0-9]|$)') AS has_license, regexp_matches(text, '(?i)(^|[^a-z0-9])copyright([^a-z0-9]|$)') AS has_copyright FROM documents")
def f12_keywords(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.has_keyword(F.col("text"), "license").alias("has_license"), tx.has_keyword(F.col("text"), "copyright").alias("has_copyright"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT doc_id FROM documents)")
def j18_orphan_claims(spark, sf_dir):
    """Orders as claims that cite the document of their customer's number."""
    return ev.orphans(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", read(spark, sf_dir, "documents"), "doc_id").select("o_orderkey", "o_custkey")


@query(r"SELECT item_id AS quote_id, item_id AS doc_id, coalesce(contains(trim(regexp_replace(d.text, '\s+', ' ', 'g')), trim(regexp_replace(b.text, '\s+', ' ', 'g'))), false) AS found FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id")
def j19_quote_containment(spark, sf_dir):
    quotes = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("item_id").alias("doc_id"), "text")
    return ev.contained_quotes(quotes, read(spark, sf_dir, "documents"))


HITS = f"""{URLS}, hits AS (SELECT page_id AS pos, {CANON} AS url, {TITLE} AS title, 'e' || (page_id % 4)::VARCHAR AS engine, 'f' || (page_id % 3)::VARCHAR AS family,
  CASE WHEN page_id % 10 = 0 THEN 'stale' WHEN page_id % 10 = 1 THEN 'unknown' WHEN page_id % 17 = 3 THEN 'future_timestamp' ELSE 'within_window' END AS freshness FROM u1)"""


def _hits(spark, sf_dir):
    p = F.col("page_id")
    fresh = F.when(p % 10 == 0, "stale").when(p % 10 == 1, "unknown").when(p % 17 == 3, "future_timestamp").otherwise("within_window")
    return read(spark, sf_dir, "pages").select(p.alias("pos"), tx.canonical_url(F.col("url")).alias("url"), tx.title(F.col("html")).alias("title"), F.concat(F.lit("e"), (p % 4).cast("string")).alias("engine"), F.concat(F.lit("f"), (p % 3).cast("string")).alias("family"), fresh.alias("freshness"))


MERGED = f"""{HITS}, k AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9\\x{{3400}}-\\x{{9fff}}]+', '', 'g') AS tk FROM hits WHERE freshness NOT IN ('stale', 'future_timestamp') AND url <> '' AND title <> ''),
mg AS (SELECT CASE WHEN len(tk) >= 12 THEN 't:' || tk ELSE 'u:' || url END AS key, arg_min(url, pos) AS url, min(pos) AS first_pos, count(*) AS hits, array_to_string(list_sort(list_distinct(list(engine))), ',') AS engines, count(DISTINCT family) AS families, min((freshness = 'unknown')::INT) AS fresh_rank FROM k GROUP BY 1)"""


@query(f"WITH {MERGED} SELECT url, first_pos, hits, engines, families, CASE WHEN families >= 3 THEN 'broad' WHEN families >= 2 THEN 'emerging' ELSE 'quiet' END AS attention FROM mg")
def a15_merged_hits(spark, sf_dir):
    return ev.merge_hits(_hits(spark, sf_dir)).select("url", "first_pos", "hits", "engines", "families", "attention")


@query(f"WITH {MERGED} SELECT url, families, hits FROM mg ORDER BY fresh_rank, families DESC, hits DESC, first_pos LIMIT 25")
def t07_ranked_candidates(spark, sf_dir):
    return ev.merge_hits(_hits(spark, sf_dir)).orderBy("fresh_rank", F.desc("families"), F.desc("hits"), "first_pos").limit(25).select("url", "families", "hits")


@query(f"WITH {HITS}, n AS (SELECT * FROM hits UNION ALL SELECT pos + 1000000, url, title, 'social' AS engine, 's' AS family, freshness FROM hits WHERE pos % 2 = 0) SELECT engine, count(*) AS n, count(DISTINCT url) AS urls FROM n GROUP BY engine")
def o01_union_sources(spark, sf_dir):
    h = _hits(spark, sf_dir)
    more = h.where("pos % 2 = 0").withColumns({"pos": F.col("pos") + 1_000_000, "engine": F.lit("social"), "family": F.lit("s")})
    return h.unionByName(more).groupBy("engine").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


@query("WITH o AS (SELECT user_id AS target, hour(ts) AS dimension, event_id % 4 AS family, event_id % 5 <> 0 AS usable FROM events), t AS (SELECT DISTINCT user_id AS target FROM events), d AS (SELECT DISTINCT hour(ts) AS dimension FROM events), g AS (SELECT target, dimension, count(DISTINCT family) FILTER (usable) AS families, count(*) AS n FROM o GROUP BY 1, 2) SELECT t.target, d.dimension::INT AS dimension, coalesce(families, 0) AS families, CASE WHEN n IS NULL THEN 'missing' WHEN families = 0 THEN 'unusable' WHEN families < 3 THEN 'partial' ELSE 'covered' END AS state FROM t CROSS JOIN d LEFT JOIN g ON g.target = t.target AND g.dimension = d.dimension")
def a17_coverage(spark, sf_dir):
    o = events(spark, sf_dir).select(F.col("user_id").alias("target"), F.hour("ts").alias("dimension"), (F.col("event_id") % 4).alias("family"), (F.col("event_id") % 5 != 0).alias("usable"))
    return ev.coverage(o.select("target").distinct(), o.select("dimension").distinct(), o, 3).select("target", "dimension", "families", "state")


@query("SELECT user_id, event_type, count(DISTINCT event_id % 4) AS independent_sources, count(*) AS retrievals, CASE WHEN count(DISTINCT event_id % 4) >= 3 THEN 'broad' WHEN count(DISTINCT event_id % 4) = 2 THEN 'emerging' ELSE 'quiet' END AS state FROM events GROUP BY user_id, event_type")
def a16_independent_sources(spark, sf_dir):
    g = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count_distinct(F.col("event_id") % 4).alias("independent_sources"), F.count("*").alias("retrievals"))
    n = F.col("independent_sources")
    return g.withColumn("state", F.when(n >= 3, "broad").when(n == 2, "emerging").otherwise("quiet"))


SIGNALS = "sg AS (SELECT l_orderkey AS decision_id, 'm' || (l_linenumber % 4)::VARCHAR AS module, 'L' || (l_quantity::BIGINT % 6)::VARCHAR AS level, 1 - l_discount AS multiplier, l_tax >= 0.08 AND l_returnflag = 'R' AS veto, CASE WHEN l_linestatus = 'O' THEN 'allow' ELSE 'deny' END AS entry FROM lineitem)"


def _signals(spark, sf_dir):
    q = F.col("l_quantity").cast("long") % 6
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("decision_id"), F.concat(F.lit("m"), (F.col("l_linenumber") % 4).cast("string")).alias("module"), F.concat(F.lit("L"), q.cast("string")).alias("level"), (1 - F.col("l_discount")).alias("multiplier"), ((F.col("l_tax") >= 0.08) & (F.col("l_returnflag") == "R")).alias("veto"), F.when(F.col("l_linestatus") == "O", "allow").otherwise("deny").alias("entry"))


@query(f"WITH {SIGNALS}, m AS (SELECT decision_id, module, min(multiplier) AS m FROM sg GROUP BY 1, 2) SELECT decision_id, count(*) AS modules, round(product(m), 8) AS multiplier FROM m GROUP BY decision_id")
def a19_module_multiplier(spark, sf_dir):
    return ev.module_multiplier(_signals(spark, sf_dir)).select("decision_id", "modules", F.round("multiplier", 8).alias("multiplier"))


@query(f"WITH {SIGNALS} SELECT module, level, CASE WHEN module = 'm1' THEN 'L' || least(substr(level, 2)::INT, 2)::VARCHAR WHEN module = 'm2' THEN 'L' || least(substr(level, 2)::INT, 4)::VARCHAR ELSE level END AS level_out, count(*) AS n FROM sg GROUP BY 1, 2, 3")
def l08_caps(spark, sf_dir):
    caps = spark.createDataFrame([("m1", "L2"), ("m2", "L4")], "module string, cap string")
    return ev.apply_caps(_signals(spark, sf_dir), caps).groupBy("module", "level", "level_out").agg(F.count("*").alias("n"))


@query(f"WITH {SIGNALS} SELECT decision_id, count(*) AS signals, CASE WHEN bool_or(veto) THEN 'blocked' WHEN count(DISTINCT entry) > 1 THEN 'conflict' ELSE 'L' || min(substr(level, 2)::INT)::VARCHAR END AS posture FROM sg GROUP BY decision_id")
def l09_compile(spark, sf_dir):
    return ev.compile_decisions(_signals(spark, sf_dir))


@query("WITH r AS (SELECT p_partkey, (p_partkey % 6)::DOUBLE AS a, (p_partkey % 5)::DOUBLE AS b, (p_size % 6)::DOUBLE AS c, p_partkey % 3 AS pen FROM part), s AS (SELECT p_partkey, greatest(0.0, least(100.0, a/5*40 + b/5*35 + c/5*25 - 2*pen)) AS score FROM r) SELECT p_partkey, round(score, 4) AS score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' ELSE 'D' END AS band FROM s")
def l11_scorecard(spark, sf_dir):
    k = F.col("p_partkey")
    x = read(spark, sf_dir, "part").select("p_partkey", (k % 6).cast("double").alias("a"), (k % 5).cast("double").alias("b"), (F.col("p_size") % 6).cast("double").alias("c"), (k % 3).alias("pen"))
    x = x.withColumn("score", ev.weighted_score(x, {"a": 40.0, "b": 35.0, "c": 25.0}, 5.0, F.col("pen")))
    return x.select("p_partkey", F.round("score", 4).alias("score"), ev.band(F.col("score")).alias("band"))


@query("SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT coalesce(value > 0, false) THEN 'value_not_positive' END, CASE WHEN NOT coalesce(event_type IN ('purchase', 'view', 'click'), false) THEN 'unknown_type' END, CASE WHEN NOT coalesce(user_id % 10 <> 3, false) THEN 'blocked_user' END], lambda c: c IS NOT NULL)) AS code FROM events) GROUP BY code")
def p07_contract_errors(spark, sf_dir):
    rules = {"value_not_positive": F.col("value") > 0, "unknown_type": F.col("event_type").isin("purchase", "view", "click"), "blocked_user": F.col("user_id") % 10 != 3}
    return events(spark, sf_dir).select(F.explode(ev.contract_errors(rules)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN lpad((c_custkey % 1000000)::VARCHAR, 6, '6') WHEN 1 THEN (c_custkey % 99999)::VARCHAR WHEN 2 THEN 'abc' WHEN 3 THEN '700.hk' ELSE '??' END AS sym FROM customer), u AS (SELECT c_custkey, upper(trim(sym)) AS s FROM s) SELECT c_custkey, CASE WHEN regexp_matches(s, '\\.HK$') THEN 'HK' WHEN regexp_matches(s, '^[0-9]{6}$') THEN 'A' WHEN regexp_matches(s, '^[0-9]{1,5}$') THEN 'HK' WHEN regexp_matches(s, '^[A-Z]{1,5}$') THEN 'US' ELSE 'unknown' END AS market, CASE WHEN regexp_matches(s, '\\.HK$') OR regexp_matches(s, '^[0-9]{1,5}$') THEN lpad(replace(s, '.HK', ''), 5, '0') || '.HK' WHEN regexp_matches(s, '^[0-9]{6}$') THEN s || CASE WHEN s[1] IN ('6', '9') THEN '.SH' WHEN s[1] IN ('4', '8') THEN '.BJ' ELSE '.SZ' END WHEN regexp_matches(s, '^[A-Z]{1,5}$') THEN s || '.US' ELSE s END AS code FROM u")
def p04_identity_routing(spark, sf_dir):
    k = F.col("c_custkey")
    sym = F.when(k % 5 == 0, F.lpad((k % 1000000).cast("string"), 6, "6")).when(k % 5 == 1, (k % 99999).cast("string")).when(k % 5 == 2, "abc").when(k % 5 == 3, "700.hk").otherwise("??")
    return read(spark, sf_dir, "customer").select("c_custkey", tx.market_of(sym).alias("market"), tx.padded_code(sym).alias("code"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unknown' WHEN event_id % 5 - 1 < 0 THEN 'future_timestamp' WHEN event_id % 5 - 1 <= 2 THEN 'within_window' ELSE 'stale' END AS state FROM events")
def p06_freshness(spark, sf_dir):
    pub = F.when(F.col("event_id") % 7 != 0, F.timestamp_seconds(F.unix_timestamp("ts") - (F.col("event_id") % 5 - 1) * 3600))
    return events(spark, sf_dir).select("event_id", tx.freshness(pub, F.col("ts"), 2).alias("state"))


@query("SELECT event_id, (from_json(props, '{\"k\": \"BIGINT\"}')).k AS k FROM events")
def f13_json_field(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT user_id, arg_max(event_type, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS last_type, max(event_id) AS top_id FROM events GROUP BY user_id")
def t06_latest_record(spark, sf_dir):
    x = ev.latest_by(events(spark, sf_dir), "user_id", ["ts", "event_id"]).select("user_id", F.col("event_type").alias("last_type"))
    return x.join(events(spark, sf_dir).groupBy("user_id").agg(F.max("event_id").alias("top_id")), "user_id")


@query("WITH d AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, event_type, day::VARCHAR AS day FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC, event_type) <= 3")
def t05_newest_distinct(spark, sf_dir):
    x = events(spark, sf_dir).select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    return x.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day"), "event_type"))).where("n <= 3").drop("n")
