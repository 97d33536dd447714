"""Dates, times, numbers, marks, hashes and other scalar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d[\d_]*\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
#: Spellings of a missing value, in lower case.
MISSING = ("", "unknown", "none", "null", "n/a", "na")


def iso_date(value: Column) -> Column:
    """The first ten characters as a date, or null; a month alone is no date."""
    head = F.substring(F.trim(value), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd")).when(head.rlike(r"^\d{8}$"), F.try_to_date(head, "yyyyMMdd"))


def days_apart(left: Column, right: Column) -> Column:
    return F.abs(F.datediff(left, right))


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def previous_quarter_end(period_end: Column) -> Column:
    """The quarter end before a quarter end; any other month has none."""
    return F.when(F.month(period_end) % 3 == 0, F.last_day(F.add_months(period_end, -3)))


def completed_quarter_end(ts: Column) -> Column:
    """The end of the last quarter that was over at a time."""
    return F.date_sub(F.trunc(ts, "quarter"), 1)


def timestamp(value: Column) -> Column:
    """An ISO text as an instant; one without a zone is UTC (the session's zone)."""
    return value.try_cast("timestamp")


def later(left: Column, right: Column) -> Column:
    """The later of two times; null only if both are."""
    return F.greatest(left, right)


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def eastern(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, "America/New_York")


def eastern_text(ts: Column) -> Column:
    """With the offset that held there at the time."""
    local = eastern(ts)
    hours = F.timestamp_diff("HOUR", ts, local)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.when(hours < 0, "-").otherwise("+"), F.lpad(F.abs(hours).cast("string"), 2, "0"), F.lit(":00"))


def market_session(ts: Column) -> Column:
    minutes = F.hour(eastern(ts)) * 60 + F.minute(eastern(ts))
    return F.when(minutes < 570, "pre-market").when(minutes >= 960, "after-market").when(minutes.isNotNull(), "market-hours")


def lag_days(accepted: Column, period_end: Column) -> Column:
    return F.datediff(F.to_date(accepted), period_end)


def hours_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 3_600_000_000


def window_bucket(hours: Column) -> Column:
    return F.when(hours <= 24, "<=1d").when(hours <= 72, "1-3d").when(hours.isNotNull(), ">3d")


def maturity_month(value: Column) -> Column:
    head = F.substring(value, 1, 10)
    return F.when(F.length(head).isin(7, 10) & (F.substring(head, 5, 1) == "-"), F.substring(head, 1, 7))


def clock(value: Column) -> Column:
    """HH:MM:SS of the digits of a text; midnight if there are fewer than four."""
    digits = F.regexp_replace(F.coalesce(value, F.lit("")), r"\D", "")
    seconds = F.when(F.length(digits) >= 6, F.substring(digits, 5, 2)).otherwise("00")
    return F.when(F.length(digits) < 4, "00:00:00").otherwise(F.concat_ws(":", F.substring(digits, 1, 2), F.substring(digits, 3, 2), seconds))


def digits_date(value: Column) -> Column:
    """YYYY-MM-DD of the first eight digits of a text."""
    digits = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\D", "")
    return F.when(F.length(digits) >= 8, F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)))


def period_length_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def month_chunks(start: Column, end: Column) -> Column:
    """The months from start to end, the first and last clipped, as an array of from and to."""
    months = F.sequence(F.trunc(start, "month"), end, F.expr("interval 1 month"))
    return F.transform(months, lambda m: F.struct(F.greatest(m.cast("date"), start).alias("from"), F.least(F.last_day(m), end).alias("to")))


def number(value: Column) -> Column:
    """A text with commas as a double, else null."""
    plain = F.replace(value.cast("string"), F.lit(","), F.lit(""))
    return F.when(plain.rlike(NUMBER), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))


def fixed(value: Column, digits: int = 10) -> Column:
    """Fixed-point text without trailing zeros."""
    return F.when(value.isNotNull(), F.regexp_replace(F.format_string(f"%.{digits}f", value), r"\.?0+$", ""))


def spread_bucket(value: Column, width: float = 0.0025) -> Column:
    return F.bround(value / F.lit(width)) * F.lit(width)


def mark(direct: Column | None, fair_value: Column, principal: Column) -> Column:
    """Fair value for a unit of principal; a stored mark comes first, no principal gives none."""
    made = F.when(principal != 0, fair_value / principal)
    return made if direct is None else F.coalesce(direct, made)


def error_pp(prediction: Column, actual: Column) -> Column:
    return F.abs(prediction - actual) * 100


def pct_change(old: Column, new: Column) -> Column:
    return F.when(old != 0, new / old - 1)


def direction(deltas: Column) -> Column:
    """upward if nothing fell and something rose, downward the other way round, else mixed_or_unchanged."""
    rose, fell = (F.exists(F.filter(deltas, lambda d: d.isNotNull()), test) for test in (lambda d: d > 0, lambda d: d < 0))
    return F.when(rose & ~fell, "upward").when(fell & ~rose, "downward").otherwise("mixed_or_unchanged")


def percent(part: Column, whole: Column, digits: int = 3) -> Column:
    return F.round(F.coalesce(F.try_divide(F.lit(100.0) * part, whole), F.lit(0.0)), digits)


def stable_id(*values: Column, length: int = 24) -> Column:
    """The first hexadecimal digits of a hash over the values, null as empty."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(v.cast("string"), F.lit("")) for v in values]), 256), 1, length)


def canonical_json(map_column: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(map_column))))


def present(value: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(value.cast("string"))).isin(*MISSING), F.lit(False))


def known(value: Column) -> Column:
    """The value, or null where it says that it is not known."""
    return F.when(~value.isin("", "unknown", "UNKNOWN"), value)


def accession_folder(cik: Column, accession: Column) -> Column:
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.regexp_replace(cik.cast("string"), "^0+", ""), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")))


def first_present(columns: list[str], among: list[str]) -> Column:
    """The first of the candidate columns (of those the table has) that is not blank, with its name."""
    found = [F.when(F.trim(F.col(f"`{c}`")) != "", F.struct(F.trim(F.col(f"`{c}`")).alias("value"), F.lit(c).alias("concept"))) for c in columns if c in among]
    none = F.lit(None).cast("struct<value:string,concept:string>")
    return F.coalesce(*found, none)
