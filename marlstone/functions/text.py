"""Column functions for text, addresses and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\x{3400}-\\x{9fff}"
#: Query parameters that only track, and words whose line is taken out whole.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "spm")
CREDENTIAL_WORDS = ("token", "credential", "auth")
#: Names whose assigned value is masked, words apart.
SECRET_NAMES = ("api key", "access token", "secret", "password", "passphrase")


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, tracking parameters and fragment dropped, runs of slashes folded; empty where it is no http address."""
    u = F.trim(F.coalesce(url, F.lit("")))
    ok = u.rlike("(?i)^https?://[^/?#]+")
    head = F.lower(F.regexp_extract(u, "(?i)^(https?://[^/?#]+)", 1))
    path = F.regexp_extract(u, "(?i)^https?://[^/?#]+([^?#]*)", 1)
    path = F.regexp_replace(F.when(path == "", "/").otherwise(path), "/{2,}", "/")
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~key(p).startswith("utm_") & ~key(p).isin(*TRACKING))
    tail = F.array_join(kept, "&")
    return F.when(ok, F.concat(head, path, F.when(tail == "", "").otherwise(F.concat(F.lit("?"), tail)))).otherwise("")


def title_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), f"[^a-z0-9{CJK}]+", "")


def language(text: Column) -> Column:
    return F.when(text.rlike(f"[{CJK}]"), "zh").otherwise("en")


def redact_lines(text: Column, home: str | None = None) -> Column:
    """A line that holds a credential word, or the home folder where one is named, is replaced whole."""

    def bad(line: Column) -> Column:
        low = F.lower(line)
        words = [*CREDENTIAL_WORDS, home.lower()] if home else CREDENTIAL_WORDS
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))

    return F.array_join(F.transform(F.split(text, "\n", -1), lambda line: F.when(bad(line), "[redacted]").otherwise(line)), "\n")


#: What stands between the words of a text, and the characters of a bearer credential (RFC 6750: letters, digits and these, then any =).
BETWEEN = r"[ \t\n\f\r\x0B,;]+"
CREDENTIAL = r"^[\p{Alpha}\p{Digit}\-._~+/]+=*"
MASK = "<redacted>"


def scrub(text: Column) -> Column:
    """Masks the values of secrets in place: what stands behind a secret's name and a sign, up to white space, a comma or a semicolon, and the credential behind the word bearer.

    A text is cut into words. A name is the end of what precedes a sign (= or :), compared without case, hyphens and underscores. Name,
    sign and value may share a word or stand apart, with white space alone between them: a word is masked from behind its first sign
    that follows a name, or whole if the word before ends in such a sign.
    """
    cut = F.struct(F.split(text, BETWEEN, -1).alias("words"), F.regexp_extract_all(text, F.lit(BETWEEN), F.lit(0)).alias("gaps"))
    # All names and the word bearer hold one of these. The text is cut once, and its words are looked at by their places.
    done = F.get(F.transform(F.array(cut), lambda s: _scrubbed(s["words"], s["gaps"])), F.lit(0))
    return F.when(text.rlike("(?i)key|token|secret|pass|bearer"), done).otherwise(text)


def _scrubbed(words: Column, gaps: Column) -> Column:
    names = F.array(*[F.lit(n.replace(" ", "")) for n in SECRET_NAMES])
    named = lambda w: F.exists(names, lambda n: F.translate(F.lower(F.regexp_extract(w, "[A-Za-z0-9_-]*$", 0)), "-_", "").endswith(n))
    signed = lambda w: w.rlike("[=:]$")
    bare = lambda w: F.regexp_replace(w, "[=:]$", "")
    at = lambda i: F.coalesce(F.get(words, i), F.lit(""))
    apart = lambda i: F.coalesce(F.get(gaps, i), F.lit(",")).rlike("^[^,;]+$")
    # Pieces of a word up to each sign and the rest behind the last one.
    pieces = lambda w: F.regexp_extract_all(w, F.lit("[^=:]*[=:]|[^=:]+$"), F.lit(0))

    def one(w: Column, i: Column) -> Column:
        before, gap = at(i - 1), apart(i - 1)
        # The word before ends in a sign behind a name, be the name its own or, of a sign that stands alone, one word back.
        alone = before.isin("=", ":")
        valued = gap & signed(before) & F.when(alone, apart(i - 2) & named(at(i - 2))).otherwise(named(bare(before)))
        led = gap & w.rlike("^[=:].") & named(before)
        p = pieces(w)
        first = F.array_min(F.filter(F.transform(p, lambda x, k: F.when(signed(x) & named(bare(x)) & (k < F.size(p) - 1), k)), lambda k: k.isNotNull()))
        inner = F.concat(F.array_join(F.slice(p, 1, first + 1), ""), F.lit(MASK))
        bearer = gap & F.lower(before).rlike(r"\bbearer$")
        return F.when(w == "", w).when(valued, MASK).when(led, F.concat(F.substring(w, 1, 1), F.lit(MASK))).when(first.isNotNull(), inner).when(bearer, F.regexp_replace(w, CREDENTIAL, MASK)).otherwise(w)

    return F.array_join(F.zip_with(F.transform(words, one), gaps, lambda w, g: F.concat(w, F.coalesce(g, F.lit("")))), "")


def has_keyword(text: Column, word: str) -> Column:
    """The word stands by itself, whatever its case."""
    return F.lower(text).rlike(rf"(?<![a-z0-9]){word.lower()}(?![a-z0-9])")


def freshness(published: Column, observed: Column, hours: int | None) -> Column:
    if hours is None:
        return F.lit("not_required")
    age = F.unix_timestamp(observed) - F.unix_timestamp(published)
    return F.when(published.isNull() | observed.isNull(), "unknown").when(age < 0, "future_timestamp").when(age <= hours * 3600, "within_window").otherwise("stale")


def market_of(symbol: Column) -> Column:
    """Market by suffix, else by digits: six digits are A, one to five HK, letters US."""
    s = F.upper(F.trim(symbol))
    return F.when(s.rlike(r"\.(SH|SZ|BJ)$"), "A").when(s.rlike(r"\.HK$"), "HK").when(s.rlike(r"\.US$"), "US").when(s.rlike("^[0-9]{6}$"), "A").when(s.rlike("^[0-9]{1,5}$"), "HK").when(s.rlike("^[A-Z]{1,5}$"), "US").otherwise("unknown")


def padded_code(symbol: Column) -> Column:
    """The symbol with its exchange: A codes by first digit, HK codes filled to five digits."""
    s = F.upper(F.trim(symbol))
    m, bare = market_of(symbol), F.regexp_replace(s, r"\.(SH|SZ|BJ|HK|US)$", "")
    exchange = F.when(bare.rlike("^(6|9)"), "SH").when(bare.rlike("^(4|8)"), "BJ").otherwise("SZ")
    return F.when(m == "A", F.concat(bare, F.lit("."), exchange)).when(m == "HK", F.concat(F.lpad(bare, 5, "0"), F.lit(".HK"))).when(m == "US", F.concat(bare, F.lit(".US"))).otherwise(s)


def links(html: Column) -> Column:
    """All addresses of a page's href attributes, in quotes of either kind or none, and of the link elements of a feed, in their order; nothing for empty ones."""
    attribute = r"""(?<![\w-])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    element = r"<link>\s*(?:<!\[CDATA\[\s*)?([^<\]]*?)\s*(?:\]\]>\s*)?</link>"
    places = F.regexp_extract_all(html, F.lit(f"(?is)(?:{attribute}|{element})"), F.lit(0))
    found = F.transform(places, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?is)^href\s*=\s*[\"']?|[\"']$", ""), r"(?is)^<link>\s*(?:<!\[CDATA\[\s*)?|\s*(?:\]\]>\s*)?</link>$", "")))
    return F.filter(found, lambda x: x != "")


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "(?is)<title>([^<]*)</title>", 1))
