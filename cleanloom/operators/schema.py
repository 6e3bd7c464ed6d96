"""Types and columns: what may be cast, what is there twice, how small a type may be."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import dates, numeric
from ..functions import text as T
from . import detect, rows
from .headers import any_header
from .quantiles import medians


@any_header
def duplicate_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Later columns whose cells all equal an earlier column's of the same type (null-safe).

    One pass takes a fingerprint of each column in row order; only columns of equal fingerprints are compared cell by cell, in one more.
    """
    columns = list(columns or rows.visible(df))
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    whole = F.xxhash64(*columns)  # the row's own hash, so that equal bags of values in other rows differ
    prints = df.agg(*(F.bit_xor(F.xxhash64(whole, F.coalesce(F.col(c).cast("string"), F.lit("\x00")))).alias(c) for c in columns)).first().asDict()
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :] if kind[a] == kind[b] and prints[a] == prints[b]]
    if not pairs:
        return []
    same = df.agg(*(F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"{i}") for i, (a, b) in enumerate(pairs))).first()
    return sorted({b for i, (_, b) in enumerate(pairs) if same[i] in (True, None)}, key=columns.index)


@any_header
def strict_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Casts text columns with financial headers (or the given ones) whose filled cells are all numbers."""
    columns = [c for c in (columns or [c for c in rows.text_columns(df) if detect.is_financial(c)]) if c in rows.text_columns(df)]
    if not columns:
        return df
    fit = df.agg(*(((F.count(c) == F.count(numeric.plain_double(F.col(c)))) & (F.count(c) > 0)).alias(c) for c in columns)).first()
    return df.select(*(numeric.plain_double(F.col(c)).alias(c) if c in columns and fit[c] else c for c in df.columns))


@any_header
def standard_types(df: DataFrame, date_columns: Sequence[str] = ()) -> tuple[DataFrame, dict[str, str]]:
    """Text columns of numbers alone become double, of boolean tokens alone True and False; what became of each."""
    text = [c for c in rows.text_columns(df) if c not in date_columns]
    if not text:
        return df, {}
    value = lambda c: F.nullif(F.col(c), F.lit(V.SENTINEL))
    facts = df.agg(*(F.struct(F.count(value(c)).alias("n"), F.count(numeric.plain_double(value(c))).alias("num"), F.sum(F.lower(F.col(c)).isin(*V.BOOLEANS).cast("long")).alias("bool"), F.count(c).alias("all")).alias(c) for c in text)).first()
    found, out = {}, []
    for c in df.columns:
        if c in text and facts[c]["n"] and facts[c]["n"] == facts[c]["num"]:
            found[c] = "numeric"
            out.append(numeric.plain_double(value(c)).alias(c))
        elif c in text and facts[c]["all"] and facts[c]["all"] == facts[c]["bool"]:
            found[c] = "boolean"
            out.append(numeric.boolean_text(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out), found


@any_header
def clean_numbers(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Numbers out of text; and column, converted, invalid."""
    columns = list(columns if columns is not None else detect.numbers_in_text(df))
    if not columns:
        return df, df.sparkSession.createDataFrame([], "column string, converted long, invalid long")
    out = df.select(*(numeric.mixed_number(F.col(c).cast("string")).alias(c) if c in columns else c for c in df.columns))
    facts = [F.struct(F.lit(c).alias("column"), F.count(numeric.mixed_number(F.col(c).cast("string"))).alias("converted"), (F.count(c) - F.count(numeric.mixed_number(F.col(c).cast("string")))).alias("invalid")) for c in columns]
    return out, df.agg(F.array(*facts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@any_header
def typed(df: DataFrame, numeric_cols: Sequence[str] = (), date_cols: Sequence[str] = (), notes_col: str = "Notes") -> DataFrame:
    """Numeric and date columns get their types; what doesn't parse becomes null and is told in the notes, as are times that dates lose."""
    kinds, notes, out = {f.name: f.dataType.typeName() for f in df.schema}, [], []
    for c in df.columns:
        v = F.col(c)
        if c in numeric_cols and kinds[c] == "string":
            n = numeric.plain_double(F.regexp_replace(v, "[, ]", ""))
            notes.append(F.when(n.isNull() & (T.strip(v) != ""), F.concat(F.lit(f"{c}: "), v)))
            out.append(n.alias(c))
        elif c in date_cols and kinds[c] == "string":
            d = dates.whole_cell(v)
            notes.append(F.when(d["date"].isNull() & (T.strip(v) != ""), F.concat(F.lit(f"{c}: "), v)).when(d["action"] == "Stripped Time", F.concat(F.lit(f"{c}: time dropped from "), v)))
            out.append(d["date"].alias(c))
        elif c in date_cols and kinds[c].startswith("timestamp"):
            notes.append(F.when(dates.has_time(v), F.concat(F.lit(f"{c}: time dropped from "), v.cast("string"))))
            out.append(F.to_date(v).alias(c))
        elif c != notes_col:
            out.append(v)
    old = [F.nullif(F.col(notes_col).cast("string"), F.lit(""))] if notes_col in df.columns else []
    return df.select(*out, F.array_join(F.array(*old, *notes, F.lit(None).cast("string")), " | ").alias(notes_col))


@any_header
def integral(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Double columns whose filled cells are all whole become long."""
    columns = [c for c in (columns or rows.numeric_columns(df)) if df.schema[c].dataType.typeName() in ("double", "float")]
    if not columns:
        return df
    whole = df.agg(*(F.bool_and(numeric.is_integral(F.col(c)) & (F.abs(c) < 2.0**53)).alias(c) for c in columns)).first()
    return df.select(*(F.col(c).cast("long").alias(c) if c in columns and whole[c] else c for c in df.columns))


@any_header
def standard_empty(df: DataFrame, numeric_cols: Sequence[str] = (), keep: Sequence[str] = ("System_Notes",)) -> DataFrame:
    """Missing tokens of numeric columns, and empty text of others, become null."""
    return df.select(*(F.when(F.col(c).isin(*V.EXPORT_MISSING), None).otherwise(F.col(c)).alias(c) if c in numeric_cols and c in rows.text_columns(df) else F.nullif(F.col(c), F.lit("")).alias(c) if c in rows.text_columns(df) and c not in keep else c for c in df.columns))


_RANGES = (("byte", -(2**7), 2**7 - 1), ("short", -(2**15), 2**15 - 1), ("int", -(2**31), 2**31 - 1))


@any_header
def smallest_types(df: DataFrame) -> DataFrame:
    """column, type, recommended: the narrowest type that holds all values exactly; text of few values is a dictionary_candidate."""
    whole = [f.name for f in df.schema if f.dataType.typeName() in ("short", "integer", "long")]
    real = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    text = rows.text_columns(df)
    facts = [F.struct(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c) for c in whole]
    facts += [F.bool_and((F.col(c).cast("float").cast("double") == F.col(c)) | F.isnan(c)).alias(c) for c in real]
    facts += [(F.count_distinct(c) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias(c) for c in text]
    got, out = df.agg(*facts).first() if facts else {}, []
    for f in df.schema:
        kind = best = f.dataType.simpleString()
        if f.name in whole and got[f.name]["low"] is not None:
            best = next((n for n, a, b in _RANGES if a <= got[f.name]["low"] and got[f.name]["high"] <= b), "bigint")
        elif f.name in real and got[f.name]:
            best = "float"
        elif f.name in text and got[f.name] <= 0.2:
            best = "dictionary_candidate"
        out.append((f.name, kind, {"byte": "tinyint", "short": "smallint"}.get(best, best)))
    return df.sparkSession.createDataFrame(out, "column string, type string, recommended string")


@any_header
def thresholded_types(df: DataFrame) -> DataFrame:
    """column, type, recommended by thresholds: text with less than half distinct values is a dictionary_candidate, doubles below a million in size may be float, longs within 32 bits int."""
    facts, kinds = [], {f.name: f.dataType.simpleString() for f in df.schema}
    for c in rows.visible(df):
        x = F.col(rows.quoted(c))
        if kinds[c] == "string":
            fits = F.count_distinct(x) < 0.5 * F.count(F.lit(1))
        elif kinds[c] == "double":
            fits = (F.abs(F.min(x)) < 1e6) & (F.abs(F.max(x)) < 1e6)
        elif kinds[c] == "bigint":
            fits = (F.min(x) >= -(2**31)) & (F.max(x) <= 2**31 - 1)
        else:
            fits = F.lit(False)
        better = {"string": "dictionary_candidate", "double": "float", "bigint": "int"}.get(kinds[c], kinds[c])
        facts.append(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.when(fits, better).otherwise(kinds[c]).alias("recommended")))
    return df.agg(F.array(*facts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@any_header
def numbers_with_violations(df: DataFrame, columns: Sequence[str], key: Sequence[str], notes_col: str = "Notes") -> tuple[DataFrame, DataFrame]:
    """Numbers out of text columns: commas and blanks go, what is no number becomes null and is noted, cells that were null get the column's median.

    Second: key..., column, value, kind (missing, violation, outlier) of the cells that this concerns; outliers by quartiles.
    """
    from . import outliers

    n = lambda c: numeric.plain_double(F.regexp_replace(F.col(rows.quoted(c)).cast("string"), r"[,\s]", ""))
    wide = df.select("*", *(n(c).alias(f"__n_{i}") for i, c in enumerate(columns)))
    own = [f"__n_{i}" for i in range(len(columns))]
    told, cells, values = [], [], {}
    for i, c in enumerate(columns):
        raw, number = F.col(rows.quoted(c)).cast("string"), F.col(f"__n_{i}")
        wrong = raw.isNotNull() & number.isNull()
        told.append(F.when(wrong, F.format_string(f"{c}: '%s' is no number", raw)))
        kind = F.when(raw.isNull(), "missing").when(wrong, "violation")
        cells.append(F.struct(F.lit(c).alias("column"), raw.alias("value"), kind.alias("kind")))
        values[c] = F.when(raw.isNull(), F.col(f"__m_{i}")).otherwise(number)
    found = wide.select(*key, F.explode(F.filter(F.array(*cells), lambda x: x["kind"].isNotNull())).alias("x")).select(*key, "x.*")
    beyond = outliers.coordinates(wide, key, own)
    names = F.create_map(*(F.lit(x) for i, c in enumerate(columns) for x in (f"__n_{i}", c)))
    found = found.unionByName(beyond.select(*key, names[F.col("column")].alias("column"), F.col("value").cast("string").alias("value"), F.lit("outlier").alias("kind")))
    old = [F.nullif(F.col(notes_col).cast("string"), F.lit(""))] if notes_col in df.columns else []
    for i, c in enumerate(columns):
        wide = wide.crossJoin(F.broadcast(medians(df, n(c), f"__m_{i}")))
    out = wide.select(*(values[c].alias(c) if c in values else F.col(rows.quoted(c)) for c in df.columns if c != notes_col), F.array_join(F.array(*old, *told), " | ").alias(notes_col))
    return integral(out, columns), found


@any_header
def downcast(df: DataFrame) -> DataFrame:
    to = {r["column"]: r["recommended"] for r in smallest_types(df).collect() if r["recommended"] not in (r["type"], "dictionary_candidate")}
    return df.select(*(F.col(c).cast(to[c]).alias(c) if c in to else c for c in df.columns))
