"""Amounts, dates, estimates and hashes on columns. The clock is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import _col, from_begin, grab, may_match, once


def half_up(x) -> Column:
    """Nearest integer with halves towards plus infinity."""
    return F.floor(_col(x) + F.lit(0.5)).cast("long")


def _cents(digits: Column) -> Column:
    value = F.regexp_replace(digits, ",", "").try_cast("decimal(18,2)")
    return once(value, lambda v: F.when(v > 0, (v * 100).cast("long")))


def currency_cents(text) -> Column:
    """First dollar amount in cents; null if there is none or it is zero."""
    return _cents(grab(text, fixed.AMOUNT))


def all_currency_cents(text) -> Column:
    """Every dollar amount in cents, in reading order."""
    found = F.regexp_extract_all(_col(text), F.lit(fixed.AMOUNT), F.lit(1))
    return F.filter(F.transform(found, _cents), lambda x: x.isNotNull())


def plausible_principal(cents) -> Column:
    return once(_col(cents), lambda c: F.when(c >= fixed.LEAST_PRINCIPAL_CENTS, c))


def _iso(year: Column, month: Column, day: Column) -> Column:
    ok = (month >= 1) & (month <= 12) & (day >= 1) & (day <= 31)
    return F.when(ok, F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")))


def first_date(text) -> Column:
    """First date as yyyy-mm-dd text. One with a month's name wins, wherever it stands; 2026-02-31 passes."""

    def long(date: Column) -> Column:
        month = F.array_position(F.array(*map(F.lit, fixed.MONTHS)), F.lower(F.regexp_extract(date, fixed.LONG_DATE, 1))).cast("int")
        return once(month, lambda m: _iso(F.regexp_extract(date, fixed.LONG_DATE, 3), m, F.regexp_extract(date, fixed.LONG_DATE, 2).try_cast("int")))

    def short(date: Column) -> Column:
        part = lambda k: F.regexp_extract(date, fixed.SHORT_DATE, k)
        return F.when(date != "", _iso(part(3), part(1).try_cast("int"), part(2).try_cast("int")))

    # The parts are matched in the date alone, which the text gives once; a text without a month's name is not searched for one.
    named = once(F.lower(_col(text)), lambda low: may_match(low, fixed.LONG_DATE))
    return once(F.when(named, F.regexp_extract(_col(text), fixed.LONG_DATE, 0)).otherwise(""), lambda date: F.when(date != "", long(date)).otherwise(once(F.regexp_extract(_col(text), fixed.SHORT_DATE, 0), short)))


#: Characters from a label's beginning in which a date, or a time, is looked for.
DATE_WINDOW, TIME_WINDOW = 200, 120


def from_label(text, label: str, size: int, lower: Column | None = None) -> Column:
    """`size` characters from where a label begins; null without the label. `lower` is the text as `lowered` has it, if it is at hand."""
    found = lambda t: once(F.regexp_instr(t, F.lit(label)), lambda at: F.when(at > 0, F.substring(t, at, F.lit(size))))
    return found(_col(text)) if lower is None else F.when(may_match(lower, label), once(from_begin(text, lower, label), found))


def labeled_date(text, labels: list[str]) -> Column:
    """First label, in order, whose next 200 characters hold a date."""
    return F.coalesce(*(first_date(from_label(text, p, DATE_WINDOW)) for p in labels))


def labeled_time(text, labels: list[str], lower: Column | None = None) -> Column:
    """First label whose next 120 characters hold a time, as `h:mm AM`."""

    def time(window: Column) -> Column:
        return once(grab(window, fixed.CLOCK_TIME, 0), lambda t: F.upper(F.regexp_replace(t, r"(?i)\s?(AM|PM)\z", " $1")))

    return F.coalesce(*(time(from_label(text, p, TIME_WINDOW, lower)) for p in labels))


def sale_month(slug) -> Column:
    """Date of a slug like AUGUST-4-2026-PROPERTY-SALE; null for others and for impossible days."""
    return F.try_to_date(F.initcap(F.replace(grab(_col(slug), r"(?i)([A-Z]+-\d{1,2}-\d{4})-PROPERTY-SALE"), F.lit("-"), F.lit(" "))), "MMMM d yyyy")


def days_until(day, as_of) -> Column:
    """Whole days from `as_of`, rounded up."""
    return F.ceil((F.unix_timestamp(_col(day).cast("timestamp")) - F.unix_timestamp(_col(as_of).cast("timestamp"))) / 86400).cast("long")


def months_elapsed(loan_date, as_of, total: int) -> Column:
    days = (F.unix_timestamp(_col(as_of).cast("timestamp")) - F.unix_timestamp(_col(loan_date).cast("timestamp"))) / 86400.0
    return F.least(F.lit(total).cast("long"), F.greatest(F.lit(0).cast("long"), half_up(days / F.lit(fixed.DAYS_A_MONTH))))


def remaining_balance(principal_cents, loan_date, as_of, rate_pct: float = fixed.ANNUAL_RATE_PCT, years: int = fixed.TERM_YEARS) -> Column:
    """Estimated remaining balance of a fixed-rate loan: struct<cents long, confidence double, months long>."""
    total, rate = years * 12, rate_pct / 100 / 12
    n = months_elapsed(loan_date, as_of, total)
    principal = _col(principal_cents) / F.lit(100.0)
    if rate:
        whole = (1 + rate) ** total
        left = principal * (F.lit(whole) - F.pow(F.lit(1 + rate), n)) / F.lit(whole - 1)
    else:
        left = principal * (1 - n / F.lit(total))
    cents = F.greatest(F.lit(0).cast("long"), half_up(left * 100))
    return F.struct(cents.alias("cents"), F.when((n > 0) & (n < total), 0.4).otherwise(0.25).alias("confidence"), n.alias("months"))


def equity(market, appraised, stated_balance, estimated_balance) -> Column:
    """Value less balance, the better source of each first; null if either is unknown."""
    return F.coalesce(_col(market), _col(appraised)) - F.coalesce(_col(stated_balance), _col(estimated_balance))


def equity_bucket(cents) -> Column:
    c = _col(cents)
    return F.when(c.isNull(), "unavailable").when(c < fixed.EQUITY_LOW_CENTS, "under_25k").when(c <= fixed.EQUITY_HIGH_CENTS, "25k_to_75k").otherwise("over_75k")


def value_estimate(appraised) -> Column:
    """struct<estimate, low, high, confidence> from an appraised value."""
    a = _col(appraised)
    e = half_up(a * 1.08)
    return F.when(a.isNotNull(), F.struct(e.alias("estimate"), half_up(a * 0.92).alias("low"), half_up(a * 1.15).alias("high"), F.lit(0.35).alias("confidence")))


def suspicious_ratio(a, b, threshold: float) -> Column:
    """Two amounts that differ by a factor that no correction explains."""
    x, y = _col(a).cast("double"), _col(b).cast("double")
    return F.coalesce((F.least(x, y) > 0) & (F.greatest(x, y) / F.least(x, y) >= threshold), F.lit(False))


def llm_cost_cents(tokens_in, tokens_out) -> Column:
    return half_up(_col(tokens_in) * 300 / 1_000_000 + _col(tokens_out) * 1500 / 1_000_000)


def seed_hash(text) -> Column:
    """31-polynomial of the characters, 32 bits unsigned."""
    return F.aggregate(F.split(_col(text), ""), F.lit(0).cast("long"), lambda h, c: F.when(c == "", h).otherwise(F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32))))


def confidence_band(x) -> Column:
    c = _col(x)
    return F.when(c.isNull(), "unknown").when(c >= fixed.HIGH_CONFIDENCE, "high").when(c >= fixed.MEDIUM_CONFIDENCE, "medium").otherwise("low")


def content_hash(body) -> Column:
    return F.sha2(_col(body).cast("binary"), 256)


def dollars(cents) -> Column:
    """`$1,234`, or null."""
    return F.concat(F.lit("$"), F.format_number(F.round(_col(cents) / 100.0), 0))


def long_day(day) -> Column:
    return F.date_format(_col(day), "MMMM d, yyyy")


def money_text(cents, missing: str = fixed.NO_MONEY, mark: str = "") -> Column:
    """An amount as `dollars` has it, behind `mark`, or what to say without one."""
    return F.coalesce(F.concat(F.lit(mark), dollars(cents)), F.lit(missing))


def short_day(day) -> Column:
    """`Sep 1, 2026`: calendar dates, whatever the reader's zone."""
    return F.coalesce(F.date_format(_col(day), "MMM d, yyyy"), F.lit(fixed.NO_SALE_DATE))


def owner_text(name) -> Column:
    known = (F.length(_col(name)) > 0) & (F.lower(F.trim(_col(name))) != "unknown owner")
    return F.when(F.coalesce(known, F.lit(False)), _col(name)).otherwise(fixed.NO_OWNER)


def address_text(address, pending, unlocked) -> Column:
    """The address where it is known and the reader's to see; else whether a plan would show it."""
    shown = F.coalesce(F.length(_col(address)) > 0, F.lit(False))
    return F.when(shown, _col(address)).when(~_col(unlocked) & ~_col(pending), fixed.ADDRESS_LOCKED).otherwise(fixed.ADDRESS_PENDING)
