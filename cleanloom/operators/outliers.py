"""Outliers by quartiles, over whole columns or within groups, and arithmetic relations between columns."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from . import rows
from .headers import any_header
from .quantiles import quantiles

FLAG = "__outlier__"


def _quartiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: __q_0, ... struct(q, n) of the columns."""
    out = None
    for i, c in enumerate(columns):
        one = quantiles(df, F.col(c), [0.25, 0.75]).select(F.struct(F.col("__q").alias("q"), F.col("__n").alias("n")).alias(f"__q_{i}"))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def _beyond(v, q1, q3):
    reach = V.IQR_FACTOR * (q3 - q1)
    return F.coalesce((q3 > q1) & ((v < q1 - reach) | (v > q3 + reach)), F.lit(False))


@any_header
def flag(df: DataFrame, columns: Sequence[str] | None = None, flag_col: str = FLAG) -> DataFrame:
    """Adds the flag, and {flag}cells: how many cells of the row lie beyond. One row of quartiles is broadcast."""
    columns = list(columns or rows.numeric_columns(df))
    if not columns:
        return df.withColumn(flag_col, F.lit(False)).withColumn(f"{flag_col}cells", F.lit(0))
    v = lambda c: F.col(c).cast("double")
    q = _quartiles(df, columns)
    hits = [F.when(F.col(f"__q_{i}.n") >= V.IQR_LEAST_VALUES, _beyond(v(c), F.col(f"__q_{i}.q")[0], F.col(f"__q_{i}.q")[1])).otherwise(False).cast("int") for i, c in enumerate(columns)]
    out = df.crossJoin(F.broadcast(q)).withColumn(f"{flag_col}cells", sum(hits[1:], hits[0]))
    return out.select(*df.columns, (F.col(f"{flag_col}cells") > 0).alias(flag_col), f"{flag_col}cells")


@any_header
def coordinates(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """key..., column, value of the cells that lie beyond."""
    v = lambda c: F.col(c).cast("double")
    q = _quartiles(df, columns)
    cells = F.array(*(F.struct(F.lit(c).alias("column"), v(c).alias("value"), ((F.col(f"__q_{i}.n") >= V.IQR_LEAST_VALUES) & _beyond(v(c), F.col(f"__q_{i}.q")[0], F.col(f"__q_{i}.q")[1])).alias("hit")) for i, c in enumerate(columns)))
    return df.crossJoin(F.broadcast(q)).select(*key, F.explode(F.filter(cells, lambda x: x["hit"])).alias("x")).select(*key, "x.column", "x.value")


@any_header
def outlier_rows(df: DataFrame, limit: int = 30, flag_col: str = FLAG) -> DataFrame:
    return df.where(flag_col).drop(flag_col, f"{flag_col}cells").limit(limit)


@any_header
def flag_grouped(df: DataFrame, value: str, groups: Sequence[str], least: int = 4, guard_groups: bool = False, flag_col: str = FLAG) -> DataFrame:
    """Flags a value beyond the quartiles of its group, for any of the group columns; null is a group of its own.

    least: of the column's values; with guard_groups of each group's as well.
    """
    v, out, hits = F.col(value).cast("double"), df, []
    for i, g in enumerate(groups):
        q = quantiles(df, v, [0.25, 0.75], [F.col(g)]).select(F.col("__k0").alias(f"__g_{i}"), F.col("__q").alias(f"__q_{i}"), F.col("__n").alias(f"__n_{i}"))
        out = out.join(q, F.col(g).eqNullSafe(F.col(f"__g_{i}")), "left")
        hits.append(_beyond(v, F.col(f"__q_{i}")[0], F.col(f"__q_{i}")[1]) & ((F.col(f"__n_{i}") >= least) if guard_groups else F.lit(True)))
    whole = df.agg(F.count(v).alias("__all"))
    any_hit = hits[0]
    for h in hits[1:]:
        any_hit = any_hit | h
    return out.crossJoin(F.broadcast(whole)).select(*df.columns, (any_hit & (F.col("__all") >= least)).alias(flag_col))


@any_header
def products(df: DataFrame, columns: Sequence[str], tolerance: float = 0.04, least_rows: int = 5, least_share: float = 0.85) -> DataFrame:
    """a, b, c, support, share: column pairs whose product is a third column's size in enough of the complete rows. One pass for all triples."""
    triples = [(a, b, c) for a, b in itertools.combinations(columns, 2) for c in columns if c not in (a, b)]
    v = lambda x: F.col(x).cast("double")

    def fact(a, b, c):
        full = v(a).isNotNull() & v(b).isNotNull() & v(c).isNotNull()
        near = F.coalesce((v(c) != 0) & (F.abs(v(a) * v(b) - F.abs(v(c))) <= tolerance * F.abs(v(c))), F.lit(False))
        return F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.sum(full.cast("long")).alias("support"), F.avg(F.when(full, near.cast("double"))).alias("share"))

    if not triples:
        return df.sparkSession.createDataFrame([], "a string, b string, c string, support long, share double")
    long = df.agg(F.array(*(fact(*t) for t in triples)).alias("x")).select(F.explode("x").alias("x")).select("x.*").where((F.col("support") >= least_rows) & (F.col("share") >= least_share))
    return long.unionByName(long.select(F.col("b").alias("a"), F.col("a").alias("b"), "c", "support", "share"))


@any_header
def repair_products(df: DataFrame, relations: Sequence[tuple[str, str, str]], tolerance: float = 0.03) -> DataFrame:
    """c becomes a * b where it is null or too far off; {c}_calculation_status tells it."""
    for a, b, c in relations:
        p, v = F.col(a).cast("double") * F.col(b).cast("double"), F.col(c).cast("double")
        wrong = p.isNotNull() & (v.isNull() | (F.abs(v - p) > F.greatest(F.abs(p) * tolerance, F.lit(1e-9))))
        status = F.when(wrong & v.isNull(), "Calculated").when(wrong, "Corrected").when(v.isNotNull(), "Original Value")
        df = df.withColumns({f"{c}_calculation_status": status, c: F.when(wrong, p).otherwise(v)})
    return df
