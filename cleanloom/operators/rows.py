"""Row identity, deduplication, previews, unions, neighbour windows, table comparison."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from .. import tables
from .headers import any_header

ROW_ID = "_row_id"


def quoted(name: str) -> str:
    """The column's name for F.col, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def visible(df: DataFrame) -> list[str]:
    """Columns that aren't internal."""
    return [c for c in df.columns if not c.startswith("__") and c != ROW_ID]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() == "string" and not f.name.startswith("__") and f.name != ROW_ID]


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = {"byte", "short", "integer", "long", "float", "double", "decimal"}
    return [f.name for f in df.schema if f.dataType.typeName() in kinds and not f.name.startswith("__") and f.name != ROW_ID]


@any_header
def with_row_id(df: DataFrame) -> DataFrame:
    """Adds an increasing (not dense) id; deterministic for a given input and split of it."""
    return df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id())


@any_header
def drop_duplicates(df: DataFrame, order_by: Sequence[str] | None = None, subset: Sequence[str] | None = None) -> DataFrame:
    """Keeps the first row of equal ones. Without an order, which of them is arbitrary, so equal in every column of the default subset.

    The first is found by an aggregate (min over the order's values), so that equal rows combine before the shuffle.
    """
    keys = list(subset or visible(df))
    if not order_by:
        return df.dropDuplicates(keys)
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest) if rest else F.lit(1), F.struct(*order_by)).alias("__first")
    return df.groupBy(*keys).agg(first).select(*(c if c in keys else F.col(f"__first.{c}").alias(c) for c in df.columns))


@any_header
def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row: total, distinct_rows, duplicates."""
    counts = df.groupBy(*(subset or visible(df))).agg(F.count(F.lit(1)).alias("__n"))
    return counts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct_rows")).withColumn("duplicates", F.col("total") - F.col("distinct_rows"))


@any_header
def preview(df: DataFrame, order_by: Sequence[str], n: int = 100) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


@any_header
def table_metrics(df: DataFrame) -> DataFrame:
    """rows, columns, cells, missing."""
    columns = visible(df)
    missing = sum((F.sum(F.col(c).isNull().cast("long")) for c in columns), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(columns)).alias("columns"), (F.count(F.lit(1)) * len(columns)).alias("cells"), F.coalesce(missing, F.lit(0)).cast("long").alias("missing"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _ranges(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """The rows in ranges of their order, written with the range's number __p."""
    return tables.written(df.repartitionByRange(*order_by).withColumn("__p", F.spark_partition_id()), "ranges")


@any_header
def carried(df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str] = (), backward: bool = True, into: str | None = None) -> DataFrame:
    """Fills nulls by the last value before, then (backward) the next after.

    Without a key, no task sees all rows: ranges of the order are filled on their own, and the last value of each is carried over its border.
    """
    base = df if partition_by else _ranges(df, order_by)
    w = Window.partitionBy(*(partition_by or ["__p"])).orderBy(*order_by)
    v = F.col(column)
    before, after = F.last(v, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(v, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    if not partition_by:
        place = F.when(v.isNotNull(), F.struct(*order_by))
        ends = base.groupBy("__p").agg(F.max_by(v, place).alias("__last"), F.min_by(v, place).alias("__first"))
        over = Window.orderBy("__p")  # a row a range
        ends = ends.select("__p", F.last("__last", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("__from"), F.first("__first", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("__to"))
        base = base.join(F.broadcast(ends), "__p")
        before, after = F.coalesce(before, F.col("__from")), F.coalesce(after, F.col("__to"))
    out = base.withColumn("__carried", F.coalesce(before, after) if backward else before)
    return _with(out, df, into or column, F.col("__carried"))


def _with(out: DataFrame, df: DataFrame, name: str, value: Column) -> DataFrame:
    """The columns of df with one of them, or one more, from out."""
    return out.select(*(value.alias(c) if c == name else F.col(c) for c in df.columns), *([] if name in df.columns else [value.alias(name)]))


@any_header
def neighbour(df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str] = (), same: Sequence[str] = (), into: str | None = None, any_of: Sequence[str] = ()) -> DataFrame:
    """Fills nulls by the row before, else the row after. same: only where these columns are equal (null-safe) there; any_of: only where at least one of these is (null equals nothing).

    Without a key, no task sees all rows: the last row of each range of the order meets the first one of the next.
    """
    base = df if partition_by else _ranges(df, order_by)
    w = Window.partitionBy(*(partition_by or ["__p"])).orderBy(*order_by)
    row = F.struct(F.col(column).alias("v"), *(F.col(c).alias(f"s{i}") for i, c in enumerate(same)), *(F.col(c).alias(f"a{i}") for i, c in enumerate(any_of)))
    lag, lead = F.lag(row, 1).over(w), F.lead(row, 1).over(w)
    if not partition_by:
        place = F.struct(*order_by)
        ends = base.groupBy("__p").agg(F.max_by(row, place).alias("__last"), F.min_by(row, place).alias("__first"))
        over = Window.orderBy("__p")  # a row a range
        base = base.join(F.broadcast(ends.select("__p", F.lag("__last", 1).over(over).alias("__from"), F.lead("__first", 1).over(over).alias("__to"))), "__p")
        lag, lead = F.coalesce(lag, F.col("__from")), F.coalesce(lead, F.col("__to"))

    def of(there: Column) -> Column:
        equal = functools.reduce(lambda a, b: a & b, (there[f"s{i}"].eqNullSafe(F.col(c)) for i, c in enumerate(same)), F.lit(True))
        some = functools.reduce(lambda a, b: a | b, (F.coalesce(there[f"a{i}"] == F.col(c), F.lit(False)) for i, c in enumerate(any_of)), F.lit(not any_of))
        return F.when(there.isNotNull() & equal & some, there["v"])

    out = base.withColumn("__before", lag).withColumn("__after", lead)
    return _with(out, df, into or column, F.coalesce(F.col(column), of(F.col("__before")), of(F.col("__after"))))


def cells(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """key..., column, value (as text): one row a cell."""
    return df.select(*key, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(list(key), list(columns), "column", "value")


@any_header
def changed_cells(before: DataFrame, after: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """key..., column, old_value, new_value of the cells that differ (null-safe). Both tables are joined once, as they are wide; only what differs becomes long."""
    columns = [c for c in (columns or visible(before)) if c in after.columns and c not in key]
    a = before.select(*key, F.struct(*(F.col(c).cast("string").alias(c) for c in columns)).alias("__old"))
    b = after.select(*key, F.struct(*(F.col(c).cast("string").alias(c) for c in columns)).alias("__new"))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"__old.`{c}`").alias("old_value"), F.col(f"__new.`{c}`").alias("new_value")) for c in columns))
    met = a.join(b, list(key)).select(*key, F.explode(F.filter(pairs, lambda p: ~p["old_value"].eqNullSafe(p["new_value"]))).alias("__p"))
    return met.select(*key, "__p.column", "__p.old_value", "__p.new_value")
