"""Profiles and quality scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text as T
from . import detect, rows, schema
from .headers import any_header
from .quantiles import quantiles


@any_header
def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row a column: mean, median, std, min, max, q1, q3 and outliers. Quartiles in one pass, outliers against them in another."""
    v = lambda c: F.col(c).cast("double")
    first = df.agg(*(F.struct(F.avg(v(c)).alias("mean"), F.stddev_samp(v(c)).alias("std"), F.min(v(c)).alias("min"), F.max(v(c)).alias("max")).alias(f"__s_{i}") for i, c in enumerate(columns)))
    for i, c in enumerate(columns):
        first = first.crossJoin(F.broadcast(quantiles(df, v(c), [0.25, 0.5, 0.75]).select(F.col("__q").alias("q")))).withColumn(f"__s_{i}", F.struct(f"__s_{i}.*", "q")).drop("q")
    bounds = F.broadcast(first)

    def out(i: int, c: str):
        q1, q3 = F.col(f"__s_{i}.q")[0], F.col(f"__s_{i}.q")[2]
        reach = V.IQR_FACTOR * (q3 - q1)
        return F.coalesce(F.sum(((v(c) < q1 - reach) | (v(c) > q3 + reach)).cast("long")), F.lit(0))

    kept = [F.first(f"__s_{i}").alias(f"__s_{i}") for i in range(len(columns))]
    second = df.select(*columns).crossJoin(bounds).agg(*kept, *(out(i, c).alias(f"__o_{i}") for i, c in enumerate(columns)))
    rows_of = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"__s_{i}").alias("s"), F.col(f"__o_{i}").alias("outliers")) for i, c in enumerate(columns)))
    long = second.select(F.explode(rows_of).alias("x"))
    stats = [F.round(F.col(f"x.s.{n}"), 2).alias(n) for n in ("mean", "std", "min", "max")]
    return long.select("x.column", *stats, *(F.round(F.col("x.s.q")[i], 2).alias(n) for i, n in enumerate(("q1", "median", "q3"))), "x.outliers")


@any_header
def missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, null_count, null_pct, the most first."""
    columns = list(columns or rows.visible(df))
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns))
    long = counts.unpivot(["__n"], columns, "column", "null_count")
    return long.select("column", F.coalesce("null_count", F.lit(0)).alias("null_count"), F.coalesce(F.round(100.0 * F.col("null_count") / F.col("__n"), 2), F.lit(0.0)).alias("null_pct")).orderBy(F.desc("null_count"), "column")


@any_header
def frequencies(df: DataFrame, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """column, value, n, and rank by falling n, then value; with `top` the first ones only."""
    counts = rows.cells(df, [], columns).where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value")))
    return ranked.where(F.col("rank") <= top) if top else ranked


@any_header
def dropping(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, null_share, top_share, high_missing, low_variance, recommend_drop."""
    columns = list(columns or rows.visible(df))
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    counts = rows.cells(df, [], columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    each = counts.groupBy("column").agg(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("filled"), F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("most"))
    out = each.crossJoin(F.broadcast(total)).select("column", (F.col("nulls") / F.col("__n")).alias("null_share"), F.coalesce(F.try_divide("most", "filled"), F.lit(0.0)).alias("top_share"), "filled")
    high, low = F.col("null_share") > V.HIGH_MISSING, (F.col("top_share") > V.LOW_VARIANCE) & (F.col("filled") > 1)
    return out.select("column", "null_share", "top_share", high.alias("high_missing"), low.alias("low_variance"), (high | low).alias("recommend_drop"))


@any_header
def build(df: DataFrame) -> DataFrame:
    """A row a column: type, total, null_count, null_pct, unique, fill_rate, language, pii, recommendations, numeric statistics, top values."""
    spark, kinds = df.sparkSession, detect.types(df)
    facts = [(c, k["type"], k["total"], k["total"] - k["filled"], k["distinct_values"], k["language"], k["pii"]) for c, k in kinds.items()]
    base = spark.createDataFrame(facts, "column string, type string, total long, null_count long, unique long, language string, pii string")
    base = base.withColumn("null_pct", F.coalesce(F.round(100 * F.try_divide("null_count", "total"), 1), F.lit(0.0))).withColumn("fill_rate", F.round(100 - F.col("null_pct"), 1))
    base = base.join(dropping(df).drop("null_share"), "column", "left")
    numbers = [c for c in rows.numeric_columns(df) if kinds[c]["type"] == "numeric"]
    stats = numeric_profile(df, numbers) if numbers else spark.createDataFrame([], "column string, mean double, std double, min double, max double, q1 double, median double, q3 double, outliers long")
    base = base.join(stats, "column", "left")
    texts = [c for c, k in kinds.items() if k["type"] == "text" and k["filled"]]
    if texts:
        top = frequencies(df, texts, 5).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("top_values"))
        base = base.join(top, "column", "left")
    return base


@any_header
def quality(df: DataFrame) -> DataFrame:
    """One row: score of 100, and the shares it is made of: missing cells, duplicate rows, duplicate columns, numbers as text."""
    columns, text = rows.visible(df), rows.text_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0)], "score double, missing double, duplicates double, duplicate_columns double, numbers_as_text double")
    numbers = [F.coalesce(detect.share(F.rlike(T.strip(F.col(c)), F.lit(V.NUMBER)), F.col(c).isNotNull()) >= 0.8, F.lit(False)).cast("int") for c in text]
    cells = df.agg((sum(F.sum(F.col(c).isNull().cast("long")) for c in columns) / (F.count(F.lit(1)) * len(columns))).alias("missing"), (sum(numbers, F.lit(0)) / len(columns)).alias("numbers_as_text"))
    dup = rows.duplicate_count(df).select(F.col("total").alias("__rows"), (F.col("duplicates") / F.greatest("total", F.lit(1))).alias("duplicates"))
    twin = len(schema.duplicate_columns(df)) / len(columns)
    out = cells.crossJoin(dup).select("__rows", F.coalesce("missing", F.lit(0.0)).alias("missing"), "duplicates", F.lit(twin).alias("duplicate_columns"), "numbers_as_text")
    score = 40 * (1 - F.col("missing")) + 20 * (1 - F.col("duplicates")) + 10 * (1 - F.col("duplicate_columns")) + 30 * (1 - F.col("numbers_as_text"))
    # A table without cells has no quality.
    score = F.when(F.col("__rows") > 0, score).otherwise(0.0)
    return out.select(F.round(score, 1).alias("score"), "missing", "duplicates", "duplicate_columns", "numbers_as_text")


@any_header
def language_tally(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, language, n over the cells."""
    return rows.cells(df, [], columns).where("value IS NOT NULL").groupBy("column", T.language(F.col("value")).alias("language")).agg(F.count(F.lit(1)).alias("n"))
