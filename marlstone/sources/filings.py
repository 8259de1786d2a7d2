"""Normalisers of regulatory filings and statements: raw JSON rows to typed columns with the gaps that they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.numeric import parse_number

FILING = "id string, file_name string, file_urls array<string>, publish_at string"
STATEMENT = "currency string, indicators array<struct<field_name:string,indicator_name:string,indicator_value:string,yoy:string>>"
INSIDER = "owner_name string, transaction_type string, transaction_date string, shares string, price string, document_url string, form string"
HOLDERS = "shareholder_list array<struct<shareholder_name:string,shareholder_id:string,report_date:string,percent_of_shares:string,shares_changed:string>>"
#: Forms that a file's name can begin with.
FORMS = ("10-K", "10-Q", "8-K", "20-F", "6-K", "DEF 14A", "13F-HR", "SC 13D", "SC 13G", "3", "4", "5")


def form_type(name: Column) -> Column:
    """The form of a file's name, with /A where it is an amendment: whatever code stands before " - ", else a known form that the name begins with; null for any other."""
    head = F.trim(F.substring_index(name, " - ", 1))
    coded = F.when(name.contains(" - ") & head.rlike("^[A-Za-z0-9-]+(?:/[Aa])?$"), F.upper(head))
    forms = "|".join(f.replace(" ", r"\s+") for f in FORMS)
    found = F.regexp_extract(F.upper(F.trim(name)), rf"^(?:FORM\s+)?((?:{forms})(?:/A)?)(?=\s|$|[(:,])", 1)
    return F.coalesce(coded, F.when(found != "", F.regexp_replace(found, r"\s+", " ")))


def archive_parts(url: Column) -> dict[str, Column]:
    """cik (ten digits), accession (10-2-6 digits), document of an archive address; null where it is none."""
    p = r"/[Aa]rchives/edgar/data/(\d{1,10})/(\d{18})(?:/([^/?#]+))?"
    part = lambda i: F.nullif(F.regexp_extract(url, p, i), F.lit(""))
    a = part(2)
    return {"cik": F.lpad(part(1), 10, "0"), "accession": F.concat_ws("-", F.substring(a, 1, 10), F.substring(a, 11, 2), F.substring(a, 13, 6)), "document": part(3), "known": a.isNotNull()}


def filings(raw: DataFrame, json: str = "json") -> DataFrame:
    """id, form_type, amendment, issuer_cik, accession_number, document_url, fact_key, gaps of raw filing rows.

    The issuer comes from ten digits in brackets in the name, else from the address. Without an address, an accession, a form or an
    issuer the row stays, with a gap for each.
    """
    x = raw.select(F.from_json(json, FILING).alias("r")).select("r.*")
    x = x.withColumn("document_url", F.get(F.filter("file_urls", lambda u: u.startswith("http")), F.lit(0)))
    a = archive_parts(F.col("document_url"))
    named = F.nullif(F.regexp_extract("file_name", r"\((\d{10})\)", 1), F.lit(""))
    accession = F.when(a["known"], a["accession"])
    x = x.withColumns({"form_type": form_type(F.col("file_name")), "issuer_cik": F.coalesce(named, a["cik"]), "accession_number": accession})
    gaps = F.array_compact(F.array(
        F.when(F.col("document_url").isNull(), "document_url_missing").when(F.col("accession_number").isNull(), "accession_missing"), F.when(F.col("form_type").isNull(), "form_type_missing"), F.when(F.col("issuer_cik").isNull(), "issuer_cik_missing"),
    ))
    return x.select("id", "form_type", F.coalesce(F.col("form_type").endswith("/A"), F.lit(False)).alias("amendment"), "issuer_cik", "accession_number", "document_url", F.concat(F.lit("sec:"), "accession_number").alias("fact_key"), gaps.alias("gaps"))


def statements(raw: DataFrame, json: str = "json") -> DataFrame:
    """id, field_name, value, unit, yoy of a statement's indicators: percent strings are numbers with the unit percent, the rest are in the statement's currency."""
    x = raw.select("id", F.from_json(json, STATEMENT).alias("r")).select("id", "r.currency", F.explode("r.indicators").alias("i")).where("i.field_name is not null")
    percent = F.coalesce(F.trim("i.indicator_value").endswith("%"), F.lit(False))
    return x.select("id", F.col("i.field_name").alias("field_name"), parse_number(F.col("i.indicator_value")).alias("value"), F.when(percent, "percent").otherwise(F.col("currency")).alias("unit"), parse_number(F.col("i.yoy")).alias("yoy"))


def insiders(raw: DataFrame, json: str = "json") -> DataFrame:
    """owner, kind, shares, price, accession_number, amendment of insider rows; rows without an accession are no evidence of their own."""
    x = raw.select("id", F.from_json(json, INSIDER).alias("r")).select("id", "r.*")
    a = archive_parts(F.col("document_url"))
    return x.select("id", F.trim("owner_name").alias("owner"), F.col("transaction_type").alias("kind"), parse_number(F.col("shares")).alias("shares"), parse_number(F.col("price")).alias("price"), F.when(a["known"], a["accession"]).alias("accession_number"), F.coalesce(F.upper(F.coalesce("form", F.lit("4"))).endswith("/A"), F.lit(False)).alias("amendment"))


def holders(raw: DataFrame, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """(rows, payloads) of holder lists, the quarterly ones of institutions among them.

    rows: id, holder, report_date, percent, changed, unattributed (no name). payloads: id, holders, as_of_dates, mixed_period (rows of more
    than one report date, whose shares may not be summed), unattributed_count, gaps. The order of a list says nothing about size.
    """
    x = raw.select("id", F.coalesce(F.from_json(json, HOLDERS)["shareholder_list"], F.array()).alias("l"))
    x = x.withColumn("l", F.filter("l", lambda r: r.isNotNull()))
    nameless = lambda r: F.coalesce(F.trim(r["shareholder_name"]), F.lit("")) == ""
    dates = F.array_sort(F.array_distinct(F.filter(F.transform("l", lambda r: F.nullif(r["report_date"], F.lit(""))), lambda d: d.isNotNull())))
    p = x.select("id", F.size("l").alias("holders"), dates.alias("as_of_dates"), F.size(F.filter("l", nameless)).alias("unattributed_count")).withColumn("mixed_period", F.size("as_of_dates") > 1)
    gaps = F.array_compact(F.array(F.when(F.col("holders") == 0, "empty_holder_list"), F.when(F.col("mixed_period"), "mixed_report_periods"), F.when(F.col("unattributed_count") > 0, "unattributed_holders"), F.lit("ordering_unknown")))
    r = x.select("id", F.explode("l").alias("r"))
    rows = r.select("id", F.trim("r.shareholder_name").alias("holder"), F.nullif("r.report_date", F.lit("")).alias("report_date"), parse_number(F.col("r.percent_of_shares")).alias("percent"), parse_number(F.col("r.shares_changed")).alias("changed"), nameless(F.col("r")).alias("unattributed"))
    return rows, p.withColumn("gaps", gaps)
