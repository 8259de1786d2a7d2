"""Format-preserving Feistel pseudonyms for personal numbers, dates, addresses and secrets, in DataFrame operations only.

Every value found is checked (Luhn, calendar, octets, mod 97) and then permuted under a key within its own format: digits stay digits,
letters stay letters of their case, separators stay in place, card numbers keep a right check digit, dates stay dates. The permutation
depends on the key, the kind and the value alone, so equal values stay linked across documents, and no table of values is kept. It is
one to one within each format: where the network leaves the format (a number that is no SSN, a hexadecimal value from one that is none),
it is applied again until it is back, which keeps it a permutation of the format (cycle walking).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import read

#: Rounds of the network, and how often it is applied at most until a value is back in its format: of the widest gap, one letter of
#: six in 26, no run is longer than six; of month-first dates a step is needed by two of five of those before (0.4 ** 40: one in 10 ** 15),
#: of the others by under one in eight (8 ** -40). Such a value would keep its last step, one to one or not.
ROUNDS, WALK = 8, 40
HEXADECIMAL = "^(?:[0-9a-f]+|[0-9A-F]+)$"
NO_SSN = "^(?:000|666|9)|^[0-9]{3}00|0000$"
_B, _E = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
#: kind: pattern; the first kind that fits a place wins.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "secret": r"(?:AKIA|ASIA)[0-9A-Z]{16}" + _E + r"|(?:ghp|gho|ghs)_[A-Za-z0-9]{36}" + _E + r"|(?i:password|passwd|pwd|secret|token|api[_-]?key)[ ]?[=:][ ]?[\"']?[A-Za-z0-9_+/-]{8,}",
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)" + _E,
    "date": r"\d{4}-\d{2}-\d{2}(?![-\d])" + _E + r"|\d{4}/\d{2}/\d{2}(?![/\d])" + _E + r"|\d{2}\.\d{2}\.\d{4}" + _E + r"|\d{2}/\d{2}/\d{4}" + _E,
    "card": r"(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4} \d{6} \d{4,5}|\d{4}-\d{6}-\d{4,5})(?![ -]?\d)" + _E,
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}" + _E + r"|\(\d{3}\)[ ]?\d{3}-\d{4}" + _E + r"|\d{3}-\d{3}-\d{4}" + _E,
    "ssn": r"\d{3}-\d{2}-\d{4}" + _E,
    "iban": r"[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?" + _E,
}
#: An address begins where its run of characters does, or where the value before ends: so each run is read once, however long it is.
_RUN = r"(?:(?<![A-Za-z0-9._%+-])|\G|(?<=\G[._%+-]{1,9}))"
# The kinds that begin with a digit, a letter or a sign stand behind one look at the character before.
PATTERN = _B + "(?:" + "|".join(f"(?:{_RUN if kind == 'email' else ''}{p})" for kind, p in KINDS.items()) + ")"
#: Text without these cannot hold any kind: a secret can be of letters alone, behind its name's sign or its own first letters.
GATE = r"[@0-9=:]|AKIA|ASIA|gh[pos]_"
#: 400 years of the calendar have 146,097 days = 189 * 773, the two halves of a date.
ERA, DAY_L, DAY_R = 146_097, 189, 773
#: Years whose 400 years (counted from 1700) have four digits throughout.
YEARS = (100, 9699)


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _mac(key: Column | str, kind: Column, i: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", key if isinstance(key, Column) else F.lit(key), kind, i.cast("string"), other), 512)


def _shift(half: Column, stream: Column, letters: Column) -> Column:
    """Each digit and letter of half moves within its own class by the key stream; other characters stay. letters: 26, or 6 for hexadecimal."""

    def one(j: Column) -> Column:
        c = F.substr(half, j, F.lit(1))
        a = F.ascii(c)
        k = F.conv(F.substr(stream, F.pmod(j - 1, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        move = lambda low, n: F.char(F.lit(low) + F.pmod(a - low + k, n))
        return F.when(a.between(48, 57), move(48, F.lit(10))).when(a.between(97, 122), move(97, letters)).when(a.between(65, 90), move(65, letters)).otherwise(c)

    return F.when(F.length(half) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), one), ""))


def _network(value: Column, kind: Column, key: Column | str, letters: Column) -> Column:
    """Balanced Feistel network: a permutation of the strings with the same character classes in the same places."""
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), cut).alias("l"), F.substr(value, cut + 1, F.length(value) - cut).alias("r"))

    def step(s: Column, i: Column) -> Column:
        l2 = _shift(s["l"], _mac(key, kind, 2 * i, s["r"]), letters)
        # The new left half is needed twice; a one-element transform names it.
        return _let(l2, lambda x: F.struct(x.alias("l"), _shift(s["r"], _mac(key, kind, 2 * i + 1, x), letters).alias("r")))

    return _let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step), lambda s: F.concat(s["l"], s["r"]))


def permute(value: Column, kind: Column, key: Column | str, outside=None) -> Column:
    """A permutation of the strings with the same character classes in the same places that lie not outside (a predicate).

    Hexadecimal strings of one case are permuted among themselves, and so are all others: each network is applied until its value is
    in the class that it came from.
    """
    out = outside or (lambda x: F.lit(False))

    def walk(hexadecimal: Column) -> Column:
        letters = F.when(hexadecimal, 6).otherwise(26)
        gone = lambda x: (~hexadecimal & x.rlike(HEXADECIMAL)) | out(x)
        again = lambda x, _: F.when(gone(x), _network(x, kind, key, letters)).otherwise(x)
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), _network(value, kind, key, letters), again)

    return _let(value.rlike(HEXADECIMAL), walk)


def permute_number(value: Column, left: int, right: int, kind: str, key: Column | str) -> Column:
    """Feistel network over 0 <= value < left * right, by modular addition on a half of each size; value is a long."""

    def word(i: Column, other: Column) -> Column:
        return F.conv(F.substr(_mac(key, F.lit(kind), i, other.cast("string")), F.lit(1), F.lit(12)), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        l2 = F.pmod(s["l"] + word(2 * i, s["r"]), F.lit(left).cast("long"))
        return F.get(F.transform(F.array(l2), lambda x: F.struct(x.alias("l"), F.pmod(s["r"] + word(2 * i + 1, x), F.lit(right).cast("long")).alias("r"))), F.lit(0))

    start = F.struct(F.floor(value / right).cast("long").alias("l"), F.pmod(value, F.lit(right).cast("long")).alias("r"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step)
    return F.get(F.transform(F.array(done), lambda s: s["l"] * right + s["r"]), F.lit(0))


def _luhn_sum(digits: Column, last_doubled: bool) -> Column:
    """Luhn sum; last_doubled: the last digit is doubled, as in the payload of a check digit."""
    n = F.length(digits)

    def one(acc: Column, j: Column) -> Column:
        d = F.substr(digits, j, F.lit(1)).cast("int")
        twice = F.pmod(n - j, F.lit(2)) == (0 if last_doubled else 1)
        return acc + F.when(~twice, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), one)


def _lay(new: Column, like: Column) -> Column:
    """The digits of new in the places of the digits of like."""
    place = lambda j: F.substr(like, j, F.lit(1))
    at = lambda j: F.length(_digits(F.substr(like, F.lit(1), j)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(like)), lambda j: F.when(place(j).rlike("[0-9]"), F.substr(new, at(j), F.lit(1))).otherwise(place(j))), "")


def _day(v: Column) -> Column:
    """The date of yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, dd/mm/yyyy or, where that is none, mm/dd/yyyy."""
    forms = [(v, "yyyy-MM-dd"), (v, "yyyy/MM/dd"), (F.translate(v, "/", "."), "dd.MM.yyyy"), (v, "MM/dd/yyyy")]
    return F.coalesce(*[F.try_to_date(x, form) for x, form in forms])


def kind_of(v: Column) -> Column:
    """The kind of a value found, null where its check fails: such a value stays as it is. Years before 100 or after 9699 are no dates."""
    d = _digits(v)
    octets = F.split(v, r"\.")
    date = _day(v)
    whole = lambda p: v.rlike(f"^(?:{p})$")
    # mod 97 of a rearranged IBAN, digit by digit.
    code = F.regexp_replace(v, " ", "")
    moved = F.concat(F.substr(code, F.lit(5), F.length(code)), F.substr(code, F.lit(1), F.lit(4)))
    val = lambda c: F.when(F.ascii(c).between(48, 57), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    checks = F.substr(code, F.lit(3), F.lit(2)).between("02", "98")
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.pmod(F.when(val(c) > 9, a * 100).otherwise(a * 10) + val(c), F.lit(97)))
    return (
        F.when(v.contains("@"), "email")
        .when(whole(KINDS["secret"]), "secret")
        .when(whole(KINDS["ip"]), F.when(F.forall(octets, lambda o: o.cast("int") < 256), "ip"))
        .when(whole(KINDS["date"]), F.when(F.year(date).between(*YEARS), "date"))
        .when(v.startswith("+") | v.startswith("("), F.when(F.length(d).between(7, 15), "phone"))
        .when(whole(KINDS["card"]), F.when((_luhn_sum(d, False) % 10 == 0) & (d.cast("decimal(38,0)") > 0), "card"))
        .when(whole(r"\d{3}-\d{3}-\d{4}"), "phone")
        .when(whole(KINDS["ssn"]), F.when(~v.rlike("^(000|666|9)|-00-|-0000$"), "ssn"))
        .when(whole(KINDS["iban"]), F.when((rest == 1) & checks, "iban"))
    )


def pseudonym(v: Column, kind: Column, key: Column | str) -> Column:
    """The pseudonym of a value of this kind: of the same kind again, and another for every other value of its format."""
    card = _let(_digits(v), lambda d: _let(permute(F.substr(d, F.lit(1), F.length(d) - 1), F.lit("card"), key, lambda p: p.rlike("^0+$")), lambda p: _lay(F.concat(p, F.pmod(10 - _luhn_sum(p, True) % 10, F.lit(10)).cast("string")), v)))
    digits = _let(permute(_digits(v), F.lit("ssn"), key, lambda p: p.rlike(NO_SSN)), lambda p: _lay(p, v))
    # A phone keeps the country code that + opens.
    head = F.regexp_extract(v, r"^\+\d{1,3}(?=[ .(-])", 0)
    phone = F.concat(head, _let(F.substr(v, F.length(head) + 1, F.length(v)), lambda w: _let(permute(_digits(w), F.lit("phone"), key), lambda p: _lay(p, w))))
    octet = lambda j: F.get(F.split(v, r"\."), F.lit(j)).cast("long")
    part = lambda x, by: F.pmod(F.floor(x / by).cast("long"), F.lit(256)).cast("string")
    ip = _let(permute_number(octet(0) * 16777216 + octet(1) * 65536 + octet(2) * 256 + octet(3), 65536, 65536, "ip", key), lambda x: F.concat_ws(".", part(x, 16777216), part(x, 65536), part(x, 256), part(x, 1)))
    base = F.lit("1700-01-01").cast("date")
    since = F.datediff(_day(v), base).cast("long")
    again = lambda n: F.floor(n / ERA).cast("long") * ERA + permute_number(F.pmod(n, F.lit(ERA).cast("long")), DAY_L, DAY_R, "date", key)
    on = lambda n: F.date_add(base, n.cast("int"))
    # A date that only reads month first keeps to days after the 12th: its pseudonym reads so too.
    month_first = v.rlike("^[0-9]{2}/") & F.try_to_date(v, "dd/MM/yyyy").isNull()
    walked = _let(again(since), lambda n: F.when(month_first, F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), n, lambda x, _: F.when(F.dayofmonth(on(x)) <= 12, again(x)).otherwise(x))).otherwise(n))
    form = [(v.rlike("^[0-9]{4}-"), "yyyy-MM-dd"), (v.rlike("^[0-9]{4}/"), "yyyy/MM/dd"), (month_first, "MM/dd/yyyy"), (v.contains("/"), "dd/MM/yyyy"), (F.lit(True), "dd.MM.yyyy")]
    date = _let(walked, lambda n: F.coalesce(*[F.when(is_, F.date_format(on(n), f)) for is_, f in form]))
    email = F.concat(permute(F.substring_index(v, "@", 1), F.lit("email"), key), F.lit("@"), F.substring_index(v, "@", -1))
    # Of a secret, the name before = and an access key's four first letters stay.
    name = F.regexp_extract(v, r"^(?:AKIA|ASIA|gh[pos]_|[^=:]*[=:][ ]?[\"']?)", 0)
    secret = F.concat(name, permute(F.substr(v, F.length(name) + 1, F.length(v)), F.lit("secret"), key))
    # Country and check digits of an IBAN change places with its account: the account is permuted, the check computed anew.
    code = F.regexp_replace(v, " ", "")
    val = lambda c: F.when(F.ascii(c).between(48, 57), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    mod = lambda s: F.aggregate(F.split(s, ""), F.lit(0), lambda a, c: F.pmod(F.when(val(c) > 9, a * 100).otherwise(a * 10) + val(c), F.lit(97)))
    bban = permute(F.substr(code, F.lit(5), F.length(code)), F.lit("iban"), key)
    made = _let(bban, lambda b: F.concat(F.substr(code, F.lit(1), F.lit(2)), F.lpad((98 - mod(F.concat(b, F.substr(code, F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0"), b))
    iban = _let(made, lambda m: F.array_join(F.transform(F.sequence(F.lit(1), F.length(v)), lambda j: F.when(F.substr(v, j, F.lit(1)) == " ", " ").otherwise(F.substr(m, F.length(F.regexp_replace(F.substr(v, F.lit(1), j), " ", "")), F.lit(1)))), ""))
    return F.when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", digits).when(kind == "ip", ip).when(kind == "date", date).when(kind == "email", email).when(kind == "secret", secret).when(kind == "iban", iban)


def _with_key(docs: DataFrame, key: str) -> DataFrame:
    """docs with the key as __key: a subquery reads it from a table of one row, so that no plan, explain text or event log shows it."""
    spark = docs.sparkSession
    return docs.withColumn("__key", spark.createDataFrame([(key,)], "key string").select("key").scalar())


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with every checked value in text replaced, and pii: the kinds found, in the order of their places.

    No shuffle: a text is cut at its values and joined again in its own row. A null text stays null with no kinds. A column pii of
    docs is replaced; other columns, repeated rows and null ids pass as they are.
    """
    t = F.col(text)
    out = _with_key(docs, key).withColumn("__v", F.when(t.rlike(GATE), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))))
    out = out.withColumn("__k", F.transform("__v", lambda v: F.struct(v.alias("v"), kind_of(v).alias("k"))))
    new = F.transform("__k", lambda x: F.coalesce(pseudonym(x["v"], x["k"], F.col("__key")), x["v"]))
    out = out.withColumn("__n", F.when(F.exists("__k", lambda x: x["k"].isNotNull()), new))
    whole = F.array_join(F.zip_with(F.split(t, PATTERN, -1), F.col("__n"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    kinds = F.coalesce(F.filter(F.transform("__k", lambda x: x["k"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return out.withColumns({text: F.when(F.col("__n").isNull(), t).otherwise(whole), "pii": kinds}).drop("__v", "__k", "__n", "__key")


#: Stands in for the key that a production run takes from its secret store.
DEMO_KEY = "marlstone-demo-key"


def op3_feistel_pseudonyms(spark, sf_dir):
    found = pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    counts = {f"n_{k}": F.size(F.filter("pii", F.lit(k).eqNullSafe)).cast("long") for k in KINDS}
    return found.withColumns({"n_found": F.size("pii").cast("long"), **counts}).select("doc_id", "text", "n_found", *counts)
