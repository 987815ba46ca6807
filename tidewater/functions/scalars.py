"""Scalar rules: numbers and periods in vendor text, market time, identifiers, titles and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKET_ZONE = "Asia/Kolkata"


def parse_number(text: Column) -> Column:
    """'8.94%' or '1,234.5' as a number; anything else is null."""
    bare = F.regexp_replace(F.trim(text), r"[,%\s]", "")
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), bare.cast("double"))


def parse_period(label: Column) -> Column:
    """'Mar 2026' as that month's last day."""
    return F.last_day(F.try_to_date(F.concat(F.lit("01 "), F.trim(label)), "dd MMM yyyy"))


def quarters_back(day: Column, n: int) -> Column:
    """The month end ``n`` quarters before."""
    return F.last_day(F.add_months(day, -3 * n))


def fiscal_quarter_end(quarter: Column, published: Column) -> Column:
    """The last end of fiscal quarter 1 to 4 (April to March) on or before a date."""
    month = F.when(quarter == 4, 3).otherwise(quarter * 3 + 3)
    this = F.last_day(F.make_date(F.year(published), month, F.lit(1)))
    return F.when(this <= published, this).otherwise(F.last_day(F.make_date(F.year(published) - 1, month, F.lit(1))))


def market_date(instant: Column) -> Column:
    """The exchange's calendar date of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(instant, MARKET_ZONE))


def bar_final_at(start: Column, minutes: Column, margin_seconds: int = 300) -> Column:
    """When an intraday bar may be used: its end and a settling margin."""
    return F.timestamp_seconds(F.unix_timestamp(start) + minutes * 60 + margin_seconds)


def bar_state(start: Column, minutes: Column, fetched_at: Column, margin_seconds: int = 300) -> Column:
    """FORMING before a bar's end, SETTLING within the margin, then COMPLETE."""
    end = F.unix_timestamp(start) + minutes * 60
    at = F.unix_timestamp(fetched_at)
    return F.when(at < end, "FORMING").when(at < end + margin_seconds, "SETTLING").otherwise("COMPLETE")


def on_grid(start: Column, session_open: Column, minutes: Column) -> Column:
    """Whether a bar starts a whole number of widths after the session's open."""
    return F.pmod(F.unix_timestamp(start) - F.unix_timestamp(session_open), minutes * 60) == 0


def valid_isin(code: Column) -> Column:
    """Two letters, nine letters or digits, and a Luhn check digit over letters read as 10 to 35."""
    digits = F.array_join(F.transform(F.split(code, "(?!^)"), lambda c: F.conv(c, 36, 10)), "")
    return F.coalesce(code.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$") & F.call_function("luhn_check", digits), F.lit(False))


def key_segment(key: Column) -> Column:
    """The segment of a ``SEGMENT|ID`` key; a key of another form is null."""
    return F.when(key.rlike(r"^[A-Z_]+\|.+$"), F.split_part(key, F.lit("|"), F.lit(1)))


def ceil_to_tick(price: Column, tick: Column) -> Column:
    """The least multiple of the tick that is not below an exact price."""
    return F.ceil(price / tick) * tick


def canonical_url(url: Column) -> Column:
    """https, lower-case host, neither fragment nor tracking parameters, no trailing slash or /amp."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "/amp/?$", ""), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(?i:utm_[^=]*|fbclid|gclid|igshid|mc_cid|mc_eid|ref|cmpid)(=|$)")), "&")
    return F.when(
        bare != "",
        F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))),
    )


def plain_title(title: Column) -> Column:
    """A title in lower case with everything but letters and digits squeezed to single spaces.

    The column form folds case by Unicode's simple rules; compatibility forms
    (full width, ligatures) take :func:`tidewater.operators.news.compatible_title` first.
    """
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


def stable_id(*parts: Column) -> Column:
    """sha256 over parts that a unit separator joins; null parts count as empty."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\u001f", *[F.coalesce(p, F.lit("")) for p in parts]), 256))


def crore_amount(title: Column) -> Column:
    """The greatest amount in crore (or cr) behind a currency mark in a headline; a lakh crore is 100,000."""
    amount = r"(?i)(?:rs\.?|₹|inr)\s?([\d,]+(?:\.\d+)?)\s?(crore|cr\b|lakh crore)"
    found = F.regexp_extract_all(title, F.lit(amount), F.lit(0))
    one = lambda m: F.regexp_replace(F.regexp_extract(m, amount, 1), ",", "").try_cast("double") * F.when(m.rlike("(?i)lakh"), 100000.0).otherwise(1.0)
    return F.array_max(F.transform(found, one))
