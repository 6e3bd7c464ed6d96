"""Numbers that stand in text, and phone numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V
from . import let
from . import text as T

_PLAIN = r"^-?\d*\.?\d+\.?$|^-?\d+\.$"


def plain_double(c: Column) -> Column:
    """The number a plain text is, else null."""
    c = T.strip(c)
    return F.when(F.rlike(c, F.lit(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")), c.try_cast("double"))


def mixed_number(c: Column, strict_suffix: bool = False) -> Column:
    """A number among currency words, separators, (negatives), % and K, M, B; null where none comes out.

    strict_suffix: K, M and B count only right after a digit and at the end of the cell; otherwise letters of units that
    happen to be k, m or b count too ("12 kg" is 12000).
    """

    def scaled(v: Column, percent: Column, negative: Column) -> Column:
        last = F.upper(F.right(v, F.lit(1)))
        factor = F.when(last == "K", 1e3).when(last == "M", 1e6).when(last == "B", 1e9).otherwise(1.0)
        n = let(F.regexp_replace(v, "[KMBkmb]$", ""), lambda d: F.when(F.rlike(d, F.lit(_PLAIN)), d.try_cast("double"))) * factor
        return let(F.when(percent, n / 100.0).otherwise(n), lambda x: F.when(negative, -F.abs(x)).otherwise(x))

    def stripped(v: Column) -> Column:
        negative = F.rlike(v, F.lit(r"(?s)^\(.*\)$"))
        x = F.when(negative, F.regexp_replace(v, r"(?s)^\(-?(.*)\)$", "$1")).otherwise(v)
        x = F.regexp_replace(x, V.CURRENCY_SIGNS, "")
        x = F.regexp_replace(x, r"(?iU)\b(?:" + "|".join(V.CURRENCY_WORDS) + r")\b", "")
        x = F.regexp_replace(x, r"(?<=\d)\s+(?=\d)", "")
        if strict_suffix:
            x = F.regexp_replace(x, r"(?i)(?<!\d)[kmb]|[kmb](?!\s*%?$)", "")
        x = F.regexp_replace(x, V.NUMERIC_JUNK, "")
        return let(x, lambda y: scaled(F.regexp_replace(y, "%$", ""), y.endswith("%"), negative))

    return let(F.translate(T.western_digits(T.strip(c)), "٫٬", "."), stripped)


def boolean_text(c: Column) -> Column:
    """True or False for the tokens of both languages, other values as they are."""
    low = F.lower(c)
    out = F.when(low.isNull(), None)
    for token, value in V.BOOLEANS.items():
        out = out.when(low == token, value)
    return out.otherwise(c)


def is_integral(c: Column) -> Column:
    return c == F.floor(c)


def phone(c: Column, default_country: str = "+20", compat: bool = True) -> Column:
    """The number with its country code; empty where none comes out.

    compat: an Egyptian 010... gets the code before its zero and is then too long; without it the zero goes.
    """

    def with_code(d: Column) -> Column:
        n, tail, plus = F.length(d), F.substring(d, 2, 100), F.concat(F.lit("+"), d)
        out = F.when(d.startswith("20") & (n >= 11), plus).when((d.startswith("966") | d.startswith("971")) & (n >= 12), plus)
        out = out.when(d.startswith("1") & (n == 11), F.concat(F.lit("+20"), tail)).when(d.startswith("5") & (n == 9), F.concat(F.lit("+966"), d)).when(d.startswith("05") & (n == 10), F.concat(F.lit("+966"), tail))
        if not compat:
            out = out.when(d.startswith("01") & (n == 11), F.concat(F.lit("+20"), tail))
        return out.when(~d.startswith("+"), F.concat(F.lit(default_country), d)).otherwise(d)

    def checked(full: Column) -> Column:
        size, out = F.length(full), F.when(full.isNull(), "")
        for code, (least, most) in V.COUNTRY_LENGTHS.items():
            out = out.when(full.startswith(code), F.when(size.between(least, most), full).otherwise(""))
        return out.when(full.startswith("+") & size.between(10, 15), full).otherwise("")

    digits = F.regexp_replace(T.western_digits(T.strip(c)), r"[^\d+]", "")
    return F.coalesce(let(F.regexp_replace(digits, "^00", "+"), lambda d: let(with_code(d), checked)), F.lit(""))
