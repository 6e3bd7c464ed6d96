"""Writers: text, JSON, and styled workbooks of bounded size, whose rows pass through the driver one after the other."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, profile, rows
from . import xlsx
from ..operators.headers import any_header


@any_header
def for_export(df: DataFrame) -> DataFrame:
    """No internal columns, all text, empty for null."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.visible(df)))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, UTF-8."""
    for_export(df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def csv_with_mark(df: DataFrame, path: str, most_rows: int = 1_000_000) -> None:
    """One local file with a byte-order mark, for spreadsheets; for at most `most_rows` rows, as they pass through the driver."""
    import csv

    out = for_export(df)
    if out.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"more than {most_rows} rows: use write_csv")
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(out.columns)
        w.writerows(out.toLocalIterator())


@any_header
def display_widths(df: DataFrame, least: int = 10, most: int = 50) -> DataFrame:
    """column, width: of the longest cell or the header, within bounds."""
    columns = rows.visible(df)
    long = df.agg(*(F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)).alias(c) for c in columns)).unpivot([], columns, "column", "longest")
    return long.select("column", F.least(F.greatest(F.greatest("longest", F.length("column")) + 2, F.lit(least)), F.lit(most)).alias("width"))


def number_formats(types: dict[str, str]) -> dict[str, str]:
    return {c: {"date": "yyyy-mm-dd", "numeric": "#,##0.00"}.get(k, "@") for c, k in types.items()}


def style_cells(df: DataFrame, kinds: DataFrame, key: list[str]) -> DataFrame:
    """df with __kinds map<string, string>: the kind of each of the row's cells that has one."""
    own = audit.styles(kinds, key).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("column", "kind"))).alias("__kinds"))
    return df.join(own, key, "left")


def _sheet(name: str, df: DataFrame, right_to_left: bool, formats: dict[str, str] | None = None) -> xlsx.Sheet:
    columns = [c for c in df.columns if not c.startswith("__") and c != rows.ROW_ID]
    plain = {f.name: f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "string") for f in df.schema}
    out = df.select(*(F.col(rows.quoted(c)) if plain[c] else F.col(rows.quoted(c)).cast("string").alias(c) for c in columns), *(["__kinds"] if "__kinds" in df.columns else []))
    widths = {r["column"]: r["width"] for r in display_widths(df.select(*map(rows.quoted, columns))).collect()} if columns else {}
    return xlsx.Sheet(name, columns, ((list(r)[: len(columns)], (r["__kinds"] if "__kinds" in df.columns else None) or {}) for r in out.toLocalIterator()), widths, formats, right_to_left)


def write_xlsx(path: str, df: DataFrame, kinds: DataFrame | None = None, key: list[str] | None = None, others: dict[str, DataFrame] | None = None, right_to_left: bool = True, formats: dict[str, str] | None = None) -> None:
    """A local workbook: the table, cells coloured by kind (key..., column, kind), and further tables as sheets of their own."""
    data = style_cells(df, kinds, key) if kinds is not None else df
    if key:
        data = data.orderBy(*key)
    xlsx.write(path, [_sheet("data", data, right_to_left, formats), *(_sheet(n, t, right_to_left) for n, t in (others or {}).items())])


def write_workbook(folder: str, data: DataFrame, audit_trail: DataFrame, violations: DataFrame, shifts: DataFrame) -> None:
    """The sheets of a workbook as Parquet folders."""
    for name, df in (("data", data), ("audit_report", audit_trail), ("type_violations", violations), ("data_shifts", shifts)):
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


@any_header
def style_map(df: DataFrame, kinds: DataFrame, key: list[str]) -> DataFrame:
    """key..., column, kind, width: what a spreadsheet writer needs to colour cells and size columns."""
    return audit.styles(kinds, key).join(display_widths(df), "column", "left")


@any_header
def report_rows(df: DataFrame) -> DataFrame:
    """column, null_count, null_pct: the table of the text report."""
    return profile.missing(df)


def text_report(df: DataFrame, title: str = "Audit report") -> str:
    """Lines of the report; one a column."""
    return "\n".join([title, *(f"{r['column']}: {r['null_count']} null ({r['null_pct']} %)" for r in report_rows(df).collect())])


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as JSON."""
    return df.select(F.to_json(F.struct(*map(rows.quoted, df.columns))).alias("json"))


def metrics_json(df: DataFrame) -> str:
    """The first row of a metrics table."""
    return json.dumps(df.first().asDict(recursive=True), default=str, ensure_ascii=False)
