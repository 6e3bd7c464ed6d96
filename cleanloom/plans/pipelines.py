"""Pipelines: presets over the operators. Each has one or few probe jobs for its decisions and returns lazy tables."""

from __future__ import annotations

import functools
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from .. import vocabulary as V
from ..functions import numeric
from ..functions import text as T
from ..operators import audit, detect, fuzzy, impute, outliers, profile, rows, schema
from ..sources import readers, writers
from ..operators.headers import any_header


@dataclass(frozen=True)
class CleanOptions:
    """What a run does; None of columns: found by the probe."""

    phones: bool = True
    numbers: bool = True
    fuzzy: bool = True
    dates: bool = True
    normalise: bool = True
    impute: bool = True
    impute_text: bool = True
    optimise_types: bool = False
    drop_low_variance: bool = False
    text_forms: bool = False
    outlier_columns: Sequence[str] | None = None
    threshold: float = 90
    as_of: str = "2026-01-01"
    order_by: Sequence[str] = (rows.ROW_ID,)


@dataclass(frozen=True)
class CleanResult:
    """data, audit and, worked out when they are asked for, quality_before and quality_after."""

    data: DataFrame
    audit: DataFrame
    before: DataFrame
    log: dict = field(default_factory=dict)

    @functools.cached_property
    def quality_before(self) -> DataFrame:
        return profile.quality(self.before.drop(rows.ROW_ID))

    @functools.cached_property
    def quality_after(self) -> DataFrame:
        return profile.quality(self.data.drop(rows.ROW_ID))


def _phones(df: DataFrame, log: dict) -> DataFrame:
    column = detect.phone_column(df)
    log["phone_column"] = column
    return clean_phones(df, column)[0] if column else df


@any_header
def clean_phones(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Standard numbers; and phones_standardized, invalid_phones, empty_phones."""
    new, old = numeric.phone(F.col(column).cast("string")), F.col(column).cast("string")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    told = df.agg(count(~new.eqNullSafe(old)).alias("phones_standardized"), count((new == "") & old.isNotNull() & (T.strip(old) != "")).alias("invalid_phones"), count(old.isNull() | (T.strip(old) == "")).alias("empty_phones"))
    return df.select(*(new.alias(c) if c == column else c for c in df.columns)), told


@any_header
def clean(df: DataFrame, options: CleanOptions = CleanOptions()) -> CleanResult:
    """The app's order: strict numbers, duplicate and useless columns, white space, phones, spellings, dates, text, majority words, types, outliers, duplicates, imputation."""
    df = before = tables.written(tables.spread(rows.with_row_id(df), rows.ROW_ID), "clean-input")
    log: dict = {}
    df = schema.strict_numeric(df)
    twins = schema.duplicate_columns(df)
    log["duplicate_columns"] = twins
    df = df.drop(*twins)
    if options.drop_low_variance:
        log["dropped"] = [r["column"] for r in profile.dropping(df).where("recommend_drop").collect()]
        df = df.drop(*log["dropped"])
    text = rows.text_columns(df)
    df = df.select(*(T.strip(F.col(c)).alias(c) if c in text else c for c in df.columns))
    if options.phones:
        df = _phones(df, log)
    df = tables.written(df, "clean-stripped")
    when, personal = detect.dates_and_personal(df)
    plain = [c for c in rows.text_columns(df) if c not in when and personal[c] is None]
    spelt = [c for c in plain if not detect.header_has(c, V.ID_HEADERS)]  # codes that differ in a character are different ones
    if options.fuzzy:
        df, mapping = fuzzy.token_set_harmonise(df, spelt, options.threshold)
        log["spellings"] = mapping.count()
    if options.dates:
        df = audit.fixed_dates(df, when)
    if options.normalise:
        mail = [c for c, k in personal.items() if k == "Email"]
        df = df.select(*(F.lower(T.strip(F.col(c))).alias(c) if c in mail else T.normalised(F.col(c)).alias(c) if c in plain else c for c in df.columns))
        df, mapping = fuzzy.majority_words(tables.written(df, "clean-forms"), spelt)
    # The text is read again and again from here on.
    df, log["types"] = schema.standard_types(tables.written(df, "clean-text"), when)
    df = outliers.flag(df, options.outlier_columns)
    df = rows.drop_duplicates(df, options.order_by)
    if options.impute:
        fine, coarse = detect.imputation_guides(df)
        numbers = [c for c in rows.numeric_columns(df) if not c.startswith("__")]
        if fine and coarse:
            for c in numbers:
                df = impute.hierarchical_median(df, c, fine, coarse, f"__{c}_status")
        df = impute.fill_missing(df, numbers, [])
    if options.impute_text:
        df = tables.written(df, "clean-numbers")
        found = detect.facts(df, rows.text_columns(df), detect.CONTEXT_FACTS)
        for c in detect.categorical_columns(df, found):
            df = impute.text_by_siblings(df, c, detect.context_columns(df, c, found=found), detect.descriptive_columns(df)).drop(f"{c}_predicted")
        df = impute.sentinel_text(df, rows.text_columns(df))
    if options.optimise_types:
        df = schema.downcast(df)
    out = tables.written(df.drop(*(c for c in df.columns if c.startswith("__") and c not in (outliers.FLAG,))), "clean-output")
    shared = [c for c in rows.visible(before) if c in out.columns]
    return CleanResult(out, rows.changed_cells(before, out, [rows.ROW_ID], shared), before, log)


@any_header
def clean_library(df: DataFrame, options: CleanOptions = CleanOptions()) -> CleanResult:
    """The library's order: phones, numbers in text, names, spellings, bounded dates, text from context, types."""
    df = before = tables.written(rows.with_row_id(df), "clean-input")
    log: dict = {}
    if options.text_forms:
        df = df.select(*(T.charset_normalised(F.col(rows.quoted(c))).alias(c) if c in rows.text_columns(df) else F.col(rows.quoted(c)) for c in df.columns))
    if options.phones:
        df = _phones(df, log)
    if options.numbers:
        phone = [log.get("phone_column")]
        df, _ = schema.clean_numbers(df, [c for c in detect.numbers_in_text(df) if c not in phone])
    df, _ = fuzzy.clean_names(df)
    if options.fuzzy:
        df, _ = fuzzy.token_set_harmonise(df, None, options.threshold)
    if options.dates:
        df, _ = audit.bounded_dates(df, [c for c, k in detect.types(df).items() if k["date"] and c in rows.text_columns(df)], options.as_of)
    df = tables.written(df, "clean-text")
    if options.impute_text:
        found = detect.facts(df, rows.text_columns(df))
        for c in detect.categorical_columns(df, found):
            df = impute.text_by_siblings(df, c, detect.context_columns(df, c, found=found), detect.descriptive_columns(df)).drop(f"{c}_predicted")
    if options.optimise_types:
        df = schema.downcast(df)
    df = tables.written(df, "clean-output")
    shared = [c for c in rows.visible(before) if c in df.columns]
    return CleanResult(df, rows.changed_cells(before, df, [rows.ROW_ID], shared), before, log)


@any_header
def clean_legacy(df: DataFrame, options: CleanOptions = CleanOptions(text_forms=True, impute_text=False, optimise_types=True)) -> tuple[CleanResult, dict]:
    """The older preset: text in one form first, then phones, numbers, spellings, dates, small types; and its summary with the seconds it took."""
    began = time.perf_counter()
    result = clean_library(df, options)
    told = summary(result)
    return result, told | {"processing_time_seconds": round(time.perf_counter() - began, 3), "successful_cleans": told["total_rows"]}


def summary(result: CleanResult) -> dict:
    """total_rows, total_cols, quality before and after, changes by column, and what the run logged."""
    changes = {r["column"]: r["n"] for r in result.audit.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    quality = [q.first()["score"] for q in (result.quality_before, result.quality_after)]
    return {"total_rows": result.data.count(), "total_cols": len(rows.visible(result.data)), "quality": quality, "changes": changes, "operations": result.log}


@any_header
def second_engine(df: DataFrame, key: Sequence[str], numeric_cols: Sequence[str] | None = None, date_cols: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The second engine: financial columns strictly, columns found by shares, numbers with violations and medians, dates typed, text filled by the sentinel and harmonised. Data, and the cells that were missing, wrong or beyond."""
    df = schema.strict_numeric(df)
    if numeric_cols is None or date_cols is None:
        found = detect.engine_columns(df)
        numeric_cols = list(numeric_cols) if numeric_cols is not None else [c for c in found[0] if c not in key]
        date_cols = list(date_cols) if date_cols is not None else [c for c in found[1] if c not in numeric_cols]
    out, cells = schema.numbers_with_violations(df, numeric_cols, key)
    out = schema.typed(out, [], date_cols)
    text = [c for c in rows.text_columns(out) if c not in (*key, "Notes")]
    out, _ = fuzzy.token_set_harmonise(impute.sentinel_text(out, text), text)
    return out, cells


@any_header
def typed_engine(df: DataFrame, numeric_cols: Sequence[str] | None = None, date_cols: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Typed columns with notes, the audit of changed cells, and its coverage. Columns that aren't named are found."""
    df = tables.written(rows.with_row_id(df), "typed-input")
    if numeric_cols is None or date_cols is None:
        kinds = {c: k["engine_type"] for c, k in detect.types(df).items()}
        numeric_cols = numeric_cols if numeric_cols is not None else [c for c, k in kinds.items() if k == "numeric"]
        date_cols = date_cols if date_cols is not None else [c for c, k in kinds.items() if k == "date"]
    out = schema.integral(schema.typed(df, numeric_cols, date_cols))
    changes = rows.changed_cells(df, out, [rows.ROW_ID])
    return out, changes, audit.coverage(df, changes, rows.visible(df))


def file_to_file(spark: SparkSession, source: str, target: str) -> dict[str, str]:
    """Reads a file, types it, drops duplicate rows, and writes data, audit and report as Parquet; the types that were found."""
    df = rows.with_row_id(readers.read(spark, source))
    df = rows.drop_duplicates(df, [rows.ROW_ID])
    kinds = {c: k["engine_type"] for c, k in detect.types(df).items()}
    out, changes, cover = typed_engine(df, [c for c, k in kinds.items() if k == "numeric"], [c for c, k in kinds.items() if k == "date"])
    out.write.mode("overwrite").parquet(f"{target}/data")
    changes.write.mode("overwrite").parquet(f"{target}/audit")
    writers.report_rows(out).write.mode("overwrite").parquet(f"{target}/report")
    cover.write.mode("overwrite").parquet(f"{target}/coverage")
    return kinds


@any_header
def polish(df: DataFrame, date_cols: Sequence[str] | None = None, numeric_cols: Sequence[str] | None = None) -> tuple[DataFrame, dict]:
    """Before export: duplicate columns go, dates and numbers get types (with System_Notes a row), empty cells become null."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    found = detect.types(df) if date_cols is None or numeric_cols is None else {}
    date_cols = list(date_cols) if date_cols is not None else [c for c, k in found.items() if k["date"] and kinds[c] in ("string", "date", "timestamp")]
    numeric_cols = list(numeric_cols) if numeric_cols is not None else [c for c, k in found.items() if k["type"] == "numeric"]
    twins = schema.duplicate_columns(df)
    df = schema.standard_empty(df.drop(*twins), numeric_cols)
    out = schema.integral(schema.typed(df, numeric_cols, date_cols, "System_Notes"), None)
    return (out if date_cols or numeric_cols else out.drop("System_Notes")), {"dates": date_cols, "numbers": numeric_cols, "dropped": twins}


@any_header
def clustering(df: DataFrame, preset: str = "BALANCED") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The harmonised table, the mapping, and its summary."""
    out, mapping = fuzzy.harmonise(df, None, V.preset(preset))
    return out, mapping, fuzzy.correction_summary(mapping)


@any_header
def waterfall(df: DataFrame, numbers: Sequence[str], categorical: Sequence[str], fine: str, coarse: str, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Four levels for each column, and the summary of where values came from."""
    for c in [*numbers, *categorical, fine, coarse]:
        if c not in df.columns:
            raise ValueError(f"no column {c}")
    for c in numbers:
        df = impute.median_waterfall(df, c, fine, coarse, order_by, partition_by)
    for c in categorical:
        df = impute.mode_waterfall(df, c, fine, numbers[0], order_by, partition_by) if numbers else impute.categorical_by_context(df, [c], [fine, coarse])
    return df, impute.summary(df, [*numbers, *categorical])
