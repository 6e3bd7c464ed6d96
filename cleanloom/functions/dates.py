"""Dates in text. ISO comes first, then the listed formats; what depends on today takes `as_of`."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V
from . import let
from . import text as T

_EMBEDDED = r"\d{1,4}[/.\-]\d{1,2}[/.\-]\d{1,4}"


def excel_serial(c: Column) -> Column:
    """Days since 1899-12-30."""
    n = c.try_cast("int")
    return F.when(n.between(1, V.EXCEL_LAST), F.date_add(F.lit(V.EXCEL_EPOCH).cast("date"), n))


def arabic_months(c: Column) -> Column:
    """Names of months become numbers, longer names first."""
    for name in sorted(V.ARABIC_MONTHS, key=len, reverse=True):
        c = F.replace(c, F.lit(name), F.lit(str(V.ARABIC_MONTHS[name])))
    return c


def _shaped(c: Column, fmt: str) -> Column:
    """The date in one format; the shape is tested first, so that years have four digits (two for yy)."""
    fields = {"yy": r"\d{2}", "y": r"\d{4}", "MMMM": "[A-Za-z]{3,}", "MMM": "[A-Za-z]{3}", "M": r"\d{1,2}", "d": r"\d{1,2}", "H": r"\d{1,2}", "m": r"\d{1,2}", "s": r"\d{1,2}", "'T'": "T"}
    shape = "".join(fields.get(x, re.escape(x)) for x in re.findall(r"yy|MMMM|MMM|'T'|[yMdHms]|.", fmt))
    return F.when(F.rlike(c, F.lit(f"^{shape}$")), F.to_date(F.try_to_timestamp(c, F.lit(fmt))))


def listed(c: Column, formats: tuple[str, ...] = V.DATE_FORMATS) -> Column:
    """The first of the formats that reads the text. Only formats with the text's marks between letters and digits are tried."""
    by_marks: dict[str, list[str]] = {}
    for f in formats:
        by_marks.setdefault(re.sub("[A-Za-z']", "", f), []).append(f)

    def tried(marks: Column) -> Column:
        cases = [(marks == m, functools.reduce(F.coalesce, (_shaped(c, f) for f in own))) for m, own in by_marks.items()]
        return functools.reduce(lambda rest, case: F.when(*case).otherwise(rest), reversed(cases), F.lit(None).cast("date"))

    return let(F.regexp_replace(c, "[A-Za-z0-9]", ""), tried)


def parse(c: Column) -> Column:
    """A date of a cell: listed formats, Arabic months, a serial of 4 to 6 digits."""

    def read(v: Column) -> Column:
        words = F.when(F.rlike(v, F.lit(V.ARABIC)), let(F.regexp_replace(arabic_months(v), r"\s+", " "), lambda m: listed(m, ("d M y", "y M d", "d/M/y", "y-M-d"))))
        return F.when(F.rlike(v, F.lit(r"^\d{4,6}$")), excel_serial(v)).when(F.length(v).between(6, 40) & F.rlike(v, F.lit(r"\d")), F.coalesce(listed(v), words))

    return let(T.western_digits(T.squeeze(c)), read)


def separators(c: Column) -> Column:
    v = F.translate(T.strip(c), "\\-", "//")
    return T.squeeze(F.regexp_replace(v, r"(?U)[^\w\s:/]", " "))


def full_year(three: Column, as_of_year: int) -> Column:
    """The year nearest to as_of_year that ends in the last two of three digits, from 1900 to 30 years ahead."""
    last, century = F.right(three, F.lit(2)).try_cast("int"), as_of_year // 100
    options = F.array(*((F.lit((century + k) * 100) + last) for k in (-1, 0, 1)))
    fits = F.filter(options, lambda y: (y >= 1900) & (y <= as_of_year + 30))
    best = F.array_min(F.transform(fits, lambda y: F.struct(F.abs(y - as_of_year).alias("far"), y.alias("y"))))
    return F.when(F.rlike(three, F.lit(r"^\d{3}$")), best["y"])


def repair_years(c: Column, as_of_year: int) -> Column:
    """d/m/yyy gets a year of four digits."""
    pattern = r"\b(\d{1,2})/(\d{1,2})/(\d{3})\b"
    fixed = lambda v, year: F.when(year.isNotNull(), F.regexp_replace(v, F.lit(pattern), F.concat(F.lit("$1/$2/"), year.cast("string")))).otherwise(v)
    return let(c, lambda v: let(full_year(F.regexp_extract(v, pattern, 3), as_of_year), lambda year: fixed(v, year)))


def embedded(c: Column) -> Column:
    """The first part that looks like a date; null where there is none."""
    return F.nullif(F.regexp_extract(c, _EMBEDDED, 0), F.lit(""))


def clean_cell(c: Column, as_of_year: int) -> Column:
    """struct(date, action): how a date came out of the cell, or that none did."""
    without_time = lambda raw: F.regexp_replace(raw, r"[T ]\d{1,2}:\d{2}(:\d{2})?.*$", "")

    def decide(raw: Column, norm: Column, fixed: Column) -> Column:
        direct = F.coalesce(*(parse(x) for x in (raw, without_time(raw), fixed)))
        timed = F.rlike(raw, F.lit(r"\d{1,2}:\d{2}"))
        told = F.when(fixed != norm, "Corrected Year Typo").when(timed, "Stripped Time").otherwise("")

        def outcome(d: Column) -> Column:
            inner = parse(embedded(norm))
            return F.when(d.isNotNull(), F.struct(d.alias("date"), told.alias("action"))).otherwise(let(inner, lambda i: F.struct(i.alias("date"), F.when(F.coalesce(raw, F.lit("")) == "", "").when(i.isNotNull(), "Extracted Embedded Date").otherwise("Coerced Text to Null").alias("action"))))

        return let(direct, outcome)

    return let(T.strip(c), lambda raw: let(separators(raw), lambda norm: let(repair_years(norm, as_of_year), lambda fixed: decide(raw, norm, fixed))))


def whole_cell(c: Column) -> Column:
    """struct(date, action) of a cell that is a date, with a time after it or without; nothing is repaired or extracted."""
    without_time = lambda raw: F.regexp_replace(raw, r"[T ]\d{1,2}:\d{2}(:\d{2})?.*$", "")
    timed = lambda raw: F.when(F.rlike(raw, F.lit(r"\d{1,2}:\d{2}")), "Stripped Time").otherwise("")
    return let(T.strip(c), lambda raw: let(F.coalesce(parse(raw), parse(without_time(raw))), lambda d: F.struct(d.alias("date"), F.when(d.isNotNull(), timed(raw)).otherwise("").alias("action"))))


def within_bounds(c: Column, as_of: str, min_year: int = 1900, max_future_years: int = 1) -> Column:
    """The parsed date if its year is min_year or later and it's no later than as_of plus 365 days a year."""
    last = F.date_add(F.lit(as_of).cast("date"), 365 * max_future_years)
    return let(parse(c), lambda d: F.when((F.year(d) >= min_year) & (d <= last), d))


def bound_failure(c: Column, as_of: str, min_year: int = 1900, max_future_years: int = 1) -> Column:
    """invalid, future, ancient, or null for what is empty or within bounds."""
    last = F.date_add(F.lit(as_of).cast("date"), 365 * max_future_years)
    why = let(parse(c), lambda d: F.when(d.isNull(), "invalid").when(F.year(d) < min_year, "ancient").when(d > last, "future"))
    return F.when(T.strip(c) != "", why)


def smart(c: Column) -> Column:
    """Arabic months, then a serial, then the formats."""
    return parse(c)


def has_time(c: Column) -> Column:
    """Whether a timestamp isn't at midnight."""
    return (F.hour(c) != 0) | (F.minute(c) != 0) | (F.second(c) != 0)
