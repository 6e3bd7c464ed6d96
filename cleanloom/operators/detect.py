"""What columns hold: one aggregate over all rows gives the evidence for all columns, rules on the driver name the kinds."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import dates, numeric
from ..functions import text as T
from . import rows
from .headers import any_header
from .quantiles import quantiles

def share(condition: Column, of: Column | None = None) -> Column:
    """The share of rows (with `of`) where the condition holds; null without rows."""
    hit = F.coalesce(condition, F.lit(False)).cast("double")
    return F.avg(hit if of is None else F.when(of, hit))


def header_has(name: str, keywords: Sequence[str]) -> bool:
    """Whether a word of the header is a keyword, or the header starts or ends with one of several words. Parts of words don't count."""
    words = re.split(r"[\W_]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", str(name)).lower())
    joined = f" {' '.join(words)} "
    return any(f" {' '.join(re.split(r'[\W_]+', k.lower()))} " in joined for k in keywords)


def first_header(columns: Sequence[str], keywords: Sequence[str]) -> str | None:
    return next((c for c in columns if header_has(c, keywords)), None)


@any_header
def phone_column(df: DataFrame) -> str | None:
    return first_header(rows.visible(df), [k for k in V.PHONE_HEADERS if k not in ("number", "رقم")])


@any_header
def descriptive_columns(df: DataFrame) -> list[str]:
    return [c for c in rows.text_columns(df) if header_has(c, V.DESCRIPTIVE_HEADERS)]


def is_financial(name: str) -> bool:
    """Whether a financial keyword stands anywhere in the header, within words as well."""
    return any(k in str(name).lower() for k in V.FINANCIAL_HEADERS)


@any_header
def imputation_guides(df: DataFrame) -> tuple[str | None, str | None]:
    """(fine, coarse) by the priority of headers."""

    def choose(priorities):
        return next((c for p in priorities for c in rows.visible(df) if header_has(c, [p])), None)

    return choose(V.FINE_GUIDES), choose(V.COARSE_GUIDES)


@any_header
def evidence(df: DataFrame, columns: Sequence[str] | None = None, only: Sequence[str] | None = None, dated: Sequence[str] | None = None) -> DataFrame:
    """A row a column: what its cells look like. One pass over the table counts its values; patterns look at distinct values only.

    only: the facts that are wanted, as their patterns take most of the time. dated: the columns whose cells are read as dates; others have a share of 0.
    """
    columns = list(columns or rows.visible(df))
    n, v = F.col("n"), F.col("value")
    counts = rows.cells(df, [], columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    # Columns of empty tables have a row as well.
    every = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("column"), F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("n"))
    s, there = T.strip(v), v.isNotNull()
    low = F.lower(s)
    filled = F.sum(F.when(there, n))
    part = lambda hit: F.try_divide(F.sum(F.when(there, F.when(F.coalesce(hit, F.lit(False)), n).otherwise(0))), filled)
    mean = lambda size: F.try_divide(F.sum(F.when(there, size * n)), filled)
    asked = F.lit(True) if dated is None else F.col("column").isin(*dated)
    told = {
        "total": lambda: F.sum("n"), "filled": lambda: F.coalesce(filled, F.lit(0)), "distinct_values": lambda: F.count(F.when(there, 1)),
        "dates": lambda: part(F.when(asked, dates.parse(s).isNotNull() & ~F.rlike(s, F.lit(V.NUMBER)))),  # a number may be a serial, which doesn't make a column of dates
        "numbers": lambda: part(F.rlike(s, F.lit(V.NUMBER))), "castable": lambda: part(numeric.plain_double(F.regexp_replace(s, "[, ]", "")).isNotNull()),
        "booleans": lambda: part(low.isin(*V.BOOLEANS)), "mean_length": lambda: mean(F.length(s)), "mean_words": lambda: mean(F.size(F.regexp_extract_all(s, F.lit(r"(?U)\w+"), F.lit(0)))),
        "emails": lambda: part(F.rlike(s, F.lit(V.EMAIL))), "phones": lambda: part(F.rlike(s, F.lit(V.PHONE)) & (F.length(F.regexp_replace(s, r"\D", "")) >= 7)),
        "arabic": lambda: part(T.language(s) == "ar"), "english": lambda: part(T.language(s) == "en"), "mixed": lambda: part(T.language(s) == "mixed"),
        "digits_and_letters": lambda: part(F.rlike(s, F.lit(r"\d")) & F.rlike(s, F.lit(r"\p{L}"))), "mixed_numbers": lambda: part(numeric.mixed_number(s).isNotNull()),
        "at_signs": lambda: part(F.contains(s, F.lit("@")) & F.contains(s, F.lit("."))),
    }
    return counts.unionByName(every).groupBy("column").agg(*(told[name]().alias(name) for name in (only or told)))


def _language(e) -> str:
    ar, en, mixed = e["arabic"] or 0.0, e["english"] or 0.0, e["mixed"] or 0.0
    if ar >= 0.6 or en >= 0.6:
        return "ar" if ar >= en else "en"
    if mixed >= 0.4 or (ar >= 0.4 and en >= 0.4):
        return "mixed"
    best = max(("ar", ar), ("en", en), ("mixed", mixed), key=lambda x: x[1])
    return best[0] if best[1] > 0 else "other"


def is_date(name: str, kind: str, e) -> bool:
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return True
    if header_has(name, V.DATE_HEADERS):
        return kind == "string"
    if kind != "string" or header_has(name, V.ID_HEADERS) or not e["filled"]:
        return False
    return 4 <= (e["mean_length"] or 0) <= 25 and (e["dates"] or 0) >= 0.6


def column_type(name: str, kind: str, e) -> str:
    """boolean, date, numeric or text."""
    if kind == "boolean":
        return "boolean"
    if kind not in ("string", "date", "timestamp", "timestamp_ntz"):
        return "numeric"
    if is_date(name, kind, e):
        return "date"
    if e["filled"] and (e["numbers"] or 0) >= 0.8:
        return "numeric"
    return "boolean" if e["filled"] and e["booleans"] == 1 else "text"


def engine_type(e) -> str:
    """unknown, date, numeric or text, by the stricter shares of the file-to-file engine."""
    if not e["filled"]:
        return "unknown"
    return "date" if (e["dates"] or 0) >= 0.8 else "numeric" if (e["castable"] or 0) >= 0.9 else "text"


def personal_data(e) -> str | None:
    return "Email" if (e["emails"] or 0) > 0.5 else "Phone" if (e["phones"] or 0) > 0.5 else None


@any_header
def facts(df: DataFrame, columns: Sequence[str] | None = None, only: Sequence[str] | None = None, dated: Sequence[str] | None = None) -> dict[str, dict]:
    """The rows of evidence by their columns, for the functions below that take them."""
    return {r["column"]: r.asDict() for r in evidence(df, columns, only, dated).collect()} if columns is None or columns else {}


#: What categorical_columns and context_columns look at.
CONTEXT_FACTS = ("total", "filled", "distinct_values", "phones", "at_signs")


@any_header
def dates_and_personal(df: DataFrame) -> tuple[list[str], dict[str, str | None]]:
    """The text columns that hold dates, and the personal data of each text column, as types tells them. Cells are read as dates only where the header leaves it open."""
    text = rows.text_columns(df)
    dated = [c for c in text if not header_has(c, V.DATE_HEADERS) and not header_has(c, V.ID_HEADERS)]
    found = facts(df, text, ("filled", "emails", "phones") + (("mean_length", "dates") if dated else ()), dated)
    return [c for c in text if is_date(c, "string", found[c])], {c: personal_data(found[c]) for c in text}


@any_header
def types(df: DataFrame, found: dict[str, dict] | None = None) -> dict[str, dict]:
    """For each column: type, engine_type, language, pii, date and the evidence. found: the facts, where they are known."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    out = {}
    for name, e in (facts(df) if found is None else found).items():
        kind = column_type(name, kinds[name], e)
        out[name] = e | {"type": kind, "engine_type": engine_type(e), "language": _language(e) if kind == "text" else "other", "pii": personal_data(e), "date": is_date(name, kinds[name], e)}
    return out


@any_header
def numbers_in_text(df: DataFrame, least_parsed: float = 0.5, found: dict[str, dict] | None = None) -> list[str]:
    """Text columns whose cells hold digits and letters and mostly come out as numbers."""
    text = rows.text_columns(df)
    found = facts(df, text) if found is None else found
    return [c for c in text if (found[c]["digits_and_letters"] or 0) > 0 and (found[c]["mixed_numbers"] or 0) >= least_parsed]


def first_cells(df: DataFrame, column: str, order_by: Sequence[str], most: int) -> DataFrame:
    """value (as text) of the first filled cells."""
    c = F.col(rows.quoted(column))
    return df.where(c.isNotNull()).orderBy(*order_by).limit(most).select(c.cast("string").alias("value"))


@any_header
def polish_dates(df: DataFrame, order_by: Sequence[str], sample: int = 5) -> list[str]:
    """Date columns before export: by a keyword anywhere in the header, by type, or where any of the first filled cells is a date."""
    kinds, out = {f.name: f.dataType.typeName() for f in df.schema}, []
    for c in rows.visible(df):
        if any(k in c.lower() for k in V.POLISH_DATE_HEADERS) or kinds[c] in ("date", "timestamp", "timestamp_ntz"):
            out.append(c)
        elif kinds[c] == "string" and not first_cells(df, c, order_by, sample).where(dates.parse(F.col("value")).isNotNull() & ~F.rlike(T.strip(F.col("value")), F.lit(V.NUMBER))).isEmpty():
            out.append(c)
    return out


@any_header
def polish_numbers(df: DataFrame) -> list[str]:
    """Numeric columns before export: by type alone."""
    return [c for c in rows.numeric_columns(df) if not c.startswith("_") and c != "System_Notes"]


@any_header
def engine_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, dates) by shares of all filled cells: 0.85 are numbers once commas and blanks are gone; 0.75 are dates."""
    found = {r["column"]: r for r in evidence(df).collect()}
    numeric = [c for c in found if c in rows.numeric_columns(df) or (found[c]["filled"] and found[c]["castable"] >= 0.85)]
    return numeric, [c for c, e in found.items() if e["filled"] and e["dates"] >= 0.75]


@any_header
def digits_and_letters(df: DataFrame) -> list[str]:
    """Columns in which some cell has a digit and some cell, the same or another, a letter."""
    columns = rows.visible(df)
    has = lambda c, p: F.coalesce(F.bool_or(F.rlike(F.col(rows.quoted(c)).cast("string"), F.lit(p))), F.lit(False))
    got = df.agg(F.array(*(has(c, r"\p{Nd}") & has(c, r"\p{L}") for c in columns))).first()[0]
    return [c for c, hit in zip(columns, got, strict=True) if hit]


@any_header
def name_columns(df: DataFrame, found: dict[str, dict] | None = None) -> list[str]:
    by_header = [c for c in rows.visible(df) if header_has(c, V.NAME_HEADERS)]
    rest = [c for c in rows.text_columns(df) if c not in by_header]
    found = facts(df, rest) if found is None else found
    return by_header + [c for c in rest if found[c]["filled"] and 1 <= (found[c]["mean_words"] or 0) <= 4 and found[c]["distinct_values"] < 0.6 * found[c]["total"]]


@any_header
def categorical_columns(df: DataFrame, found: dict[str, dict] | None = None) -> list[str]:
    """Text columns with nulls that aren't personal data or identifiers."""
    text = rows.text_columns(df)
    found = facts(df, text) if found is None else found
    return [c for c in text if 0 < (e := found[c])["filled"] < e["total"] and (e["at_signs"] or 0) <= 0.5 and (e["phones"] or 0) <= 0.5 and e["distinct_values"] <= 0.8 * e["total"]]


@any_header
def context_columns(df: DataFrame, target: str, most: int = 5, found: dict[str, dict] | None = None) -> list[str]:
    """Text columns of few values, fewest first."""
    text = [c for c in rows.text_columns(df) if c != target]
    found = facts(df, text) if found is None else found
    few = [c for c in text if found[c]["filled"] and found[c]["distinct_values"] < 0.3 * found[c]["total"]]
    return sorted(few, key=lambda c: (found[c]["distinct_values"] / found[c]["total"], c))[:most]


@any_header
def value_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, filled, distinct_values (case aside), top_share: by one exchange over the cells."""
    counts = rows.cells(df, [], columns).where("value IS NOT NULL").groupBy("column", F.lower("value").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(F.sum("n").alias("filled"), F.count(F.lit(1)).alias("distinct_values"), (F.max("n") / F.sum("n")).alias("top_share"))


@any_header
def roles(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, role (boolean, datetime, numeric, categorical, identifier, text, empty), filled, distinct_ratio, top_share."""
    columns = list(columns or rows.visible(df))
    seen = value_shares(df, columns).withColumn("distinct_ratio", F.col("distinct_values") / F.col("filled"))
    facts = evidence(df, columns).select("column", "dates", "castable", "booleans")
    role = (
        F.when(F.coalesce("filled", F.lit(0)) == 0, "empty").when(F.col("booleans") == 1, "boolean").when(F.col("dates") >= 0.65, "datetime").when(F.col("castable") >= 0.85, "numeric")
        .when((F.col("distinct_ratio") <= 0.2) | (F.col("top_share") >= 0.2), "categorical").when((F.col("distinct_ratio") >= 0.85) & (F.col("filled") >= 8), "identifier").otherwise("text")
    )
    return facts.join(seen, "column", "left").select("column", role.alias("role"), F.coalesce("filled", F.lit(0)).alias("filled"), "distinct_ratio", "top_share")


@any_header
def context_guides(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[str | None, str | None]:
    """(fine, coarse): the first two categorical columns by top share, then fewer distinct values, then more filled cells."""
    ranked = roles(df, columns).where("role = 'categorical'").orderBy(F.desc("top_share"), "distinct_ratio", F.desc("filled"), "column").limit(2).collect()
    return tuple([r["column"] for r in ranked] + [None, None])[:2]


@any_header
def grouping_scores(df: DataFrame, value: str, groups: Sequence[str], least: float = 0.02) -> DataFrame:
    """group, score: variance of the group's median (a row) over the value's variance, times the share of rows that it covers; groups below `least` or alone are left out."""
    v = F.col(value).cast("double")
    whole = df.agg(F.var_samp(v).alias("__var"), F.count(v).alias("__n"))
    out = None
    for g in groups:
        med = quantiles(df.where(F.col(g).isNotNull()), v, [0.5], [F.col(g)]).select(F.col("__q")[0].alias("m"), F.col("__n").alias("n")).where("n > 0")
        # The sample variance of medians repeated n times.
        stats = med.agg(F.sum("n").alias("n"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("mean"), F.sum(F.col("m") * F.col("m") * F.col("n")).alias("squares"), F.count(F.lit(1)).alias("groups"))
        spread = (F.col("squares") - F.col("n") * F.col("mean") * F.col("mean")) / (F.col("n") - 1)
        one = stats.crossJoin(whole).where("n >= 4 AND groups >= 2 AND __var > 0").select(F.lit(g).alias("group"), (spread / F.col("__var") * F.col("n") / F.col("__n")).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out.where(F.col("score") >= least)


@any_header
def best_grouping(df: DataFrame, value: str, groups: Sequence[str]) -> str | None:
    groups = [g for g in groups if g != value]
    if not groups:
        return None
    found = grouping_scores(df, value, groups).orderBy(F.desc("score"), "group").limit(1).collect()
    return found[0]["group"] if found else None


@any_header
def predictiveness(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """feature, spread: the mean over the feature's groups of distinct targets a row, the worst first."""
    out = None
    for f in features:
        one = df.groupBy(f).agg((F.count_distinct(target) / F.count(F.lit(1))).alias("r")).agg(F.avg("r").alias("spread")).select(F.lit(f).alias("feature"), "spread")
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("spread"), "feature")
