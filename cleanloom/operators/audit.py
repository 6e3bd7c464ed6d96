"""What changed, why, and how cells are to be shown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import dates
from ..functions import text as T
from . import rows
from .headers import any_header

#: Kinds of cells, the strongest last.
KINDS = ("missing", "outlier", "median", "imputed")
TRAIL = "row_id string, column string, old_value string, new_value string, reason string, type string"


class AuditTrail:
    """Collects audit tables; nothing runs until report() is used."""

    def __init__(self, df: DataFrame) -> None:
        self.spark, self.parts = df.sparkSession, []

    def changes(self, before: DataFrame, after: DataFrame, key: Sequence[str], reason: str, columns: Sequence[str] | None = None) -> None:
        found = rows.changed_cells(before, after, key, columns)
        self.parts.append(found.select(F.concat_ws("|", *(F.col(k).cast("string") for k in key)).alias("row_id"), "column", "old_value", "new_value", F.lit(reason).alias("reason"), F.lit("cell").alias("type")))

    def bulk(self, reason: str, column: str, count: int) -> None:
        self.parts.append(self.spark.createDataFrame([(None, column, None, str(count), reason, "bulk")], TRAIL))

    def report(self) -> DataFrame:
        return rows.union_all(self.parts) if self.parts else self.spark.createDataFrame([], TRAIL)

    def summary(self) -> DataFrame:
        return self.report().groupBy("reason", "column").agg(F.count(F.lit(1)).alias("changes"))


@any_header
def clean_dates(df: DataFrame, columns: Sequence[str], key: Sequence[str], as_of_year: int, sequence: Sequence[str] = (), flag: str = "is_chronology_invalid") -> tuple[DataFrame, DataFrame]:
    """Dates as ISO text, and flag: a later column's date lies before an earlier one's. Anomalies: key..., column_name, original_value, action_taken."""
    if lost := [c for c in [*columns, *sequence] if c not in df.columns]:
        raise ValueError(f"no such columns: {lost}")
    parsed = df.select(*df.columns, *(dates.clean_cell(F.col(c).cast("string"), as_of_year).alias(f"__d_{c}") for c in columns))
    at = lambda c: F.col(f"__d_{c}.date") if c in columns else F.to_date(c)
    wrong = F.lit(False)
    for i, a in enumerate(sequence):
        for b in sequence[i + 1 :]:
            wrong = wrong | F.coalesce(at(b) < at(a), F.lit(False))
    out = parsed.select(*(F.date_format(f"__d_{c}.date", "yyyy-MM-dd").alias(c) if c in columns else F.col(c) for c in df.columns), *([wrong.alias(flag)] if sequence else []))
    told = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("original_value"), F.col(f"__d_{c}.action").alias("action_taken")) for c in columns]
    if sequence:
        told.append(F.struct(F.lit(sequence[-1]).alias("column_name"), F.date_format(at(sequence[-1]), "yyyy-MM-dd").alias("original_value"), F.when(wrong, "Chronology Invalid").otherwise("").alias("action_taken")))
    anomalies = parsed.select(*key, F.explode(F.filter(F.array(*told), lambda t: t["action_taken"] != "")).alias("x")).select(*key, "x.*")
    return out, anomalies


@any_header
def bounded_dates(df: DataFrame, columns: Sequence[str], as_of: str, min_year: int = 1900, max_future_years: int = 1) -> tuple[DataFrame, DataFrame]:
    """ISO dates within bounds, others null; and column, invalid, future, ancient, changed."""
    iso = {c: F.date_format(dates.within_bounds(F.col(c).cast("string"), as_of, min_year, max_future_years), "yyyy-MM-dd") for c in columns}
    why = {c: dates.bound_failure(F.col(c).cast("string"), as_of, min_year, max_future_years) for c in columns}
    count = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    facts = [F.struct(F.lit(c).alias("column"), *(count(F.coalesce(why[c] == k, F.lit(False))).alias(k) for k in ("invalid", "future", "ancient")), count(~iso[c].eqNullSafe(F.col(c).cast("string"))).alias("changed")) for c in columns]
    return df.select(*(iso[c].alias(c) if c in columns else F.col(c) for c in df.columns)), df.agg(F.array(*facts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@any_header
def fixed_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """ISO text where the cell parses, the cell as it was otherwise."""
    return df.select(*(F.coalesce(F.date_format(dates.parse(F.col(c).cast("string")), "yyyy-MM-dd"), F.col(c).cast("string")).alias(c) if c in columns else c for c in df.columns))


@any_header
def cell_kinds(df: DataFrame, key: Sequence[str], numbers: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """key..., column of missing cells: null numbers, and null, blank or placeholder text."""
    told = [F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("hit")) for c in numbers]
    told += [F.struct(F.lit(c).alias("column"), (F.col(c).isNull() | (T.strip(F.col(c)) == "") | T.is_placeholder(F.col(c))).alias("hit")) for c in texts]
    return df.select(*key, F.explode(F.filter(F.array(*told), lambda x: x["hit"])).alias("x")).select(*key, "x.column")


def styles(kinds: DataFrame, key: Sequence[str]) -> DataFrame:
    """key..., column, kind: the strongest of a cell's kinds (column kind of the input)."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return kinds.where(place > 0).groupBy(*key, "column").agg(F.max_by("kind", place).alias("kind"))


def notes(templates: Sequence, existing=None):
    """Joins the notes that aren't null by ' | '."""
    parts = ([F.nullif(existing, F.lit(""))] if existing is not None else []) + list(templates)
    return F.array_join(F.array(*parts), " | ")


@any_header
def row_audit(df: DataFrame, types: dict[str, str], notes_col: str = "Notes") -> DataFrame:
    """Checks each cell against its column's type again (numeric, date) and adds notes of those that fail."""
    from ..functions import numeric

    told = []
    for c, kind in types.items():
        s = F.col(c).cast("string")
        bad = numeric.plain_double(F.regexp_replace(s, "[, ]", "")).isNull() if kind == "numeric" else dates.parse(s).isNull() if kind == "date" else None
        if bad is not None:
            told.append(F.when(s.isNotNull() & (T.strip(s) != "") & bad, F.format_string(f"{c}: %s is no {kind}", s)))
    old = F.col(notes_col) if notes_col in df.columns else None
    keep = [c for c in df.columns if c != notes_col]
    return df.select(*keep, notes(told or [F.lit(None).cast("string")], old).alias(notes_col))


@any_header
def coverage(df: DataFrame, changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """cells_checked (of the columns that were checked), cells_modified, coverage_pct of all the table's cells."""
    checked = df.agg((F.count(F.lit(1)) * len(columns)).alias("cells_checked"), (F.count(F.lit(1)) * len(rows.visible(df))).alias("cells"))
    done = changes.agg(F.count(F.lit(1)).alias("cells_modified"))
    return checked.crossJoin(done).select("cells_checked", "cells_modified", F.round(100.0 * F.col("cells_checked") / F.greatest("cells", F.lit(1)), 2).alias("coverage_pct"))


@any_header
def highlighted(df: DataFrame, status_columns: Sequence[str], original: Sequence[str] = ("Original Value", "Populated", "Original")) -> DataFrame:
    """Adds _highlight: names of columns whose status isn't original."""
    hits = [F.when(F.col(s).isNotNull() & ~F.col(s).isin(*original), s.removesuffix("_imputation_status")) for s in status_columns]
    return df.withColumn("_highlight", F.array_compact(F.array(*hits)))


@any_header
def shifted(before: DataFrame, after: DataFrame, key: Sequence[str], typed_columns: Sequence[str]) -> DataFrame:
    """Changed cells of columns that aren't declared numeric or date."""
    return rows.changed_cells(before, after, key, [c for c in rows.visible(before) if c not in typed_columns and c not in key])


@any_header
def many_nulls(df: DataFrame, least: float = 0.2) -> DataFrame:
    """column, null_share of columns with more nulls than that."""
    columns = rows.visible(df)
    shares = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns)).unpivot([], columns, "column", "null_share")
    return shares.where(F.col("null_share") > least)


SENTINEL = V.SENTINEL
