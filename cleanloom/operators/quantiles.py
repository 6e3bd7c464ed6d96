"""Exact quantiles and modes of groups of any size, without a buffer that grows with a group.

A mode is found by counting (group, value), which combines before the shuffle, and then taking each group's most frequent value.

A quantile of tables beyond FEW_ROWS rows (those read from files: beyond FEW_BYTES) takes two passes. The first brackets it: a sketch of bounded size gives, for each group, values
whose ranks are surely below and above the quantile's. The second counts rows between the brackets and distinct values within them;
running sums of these counts give the exact value. So what meets in one task is a small share of a group's distinct values, sorted,
never its rows. Smaller tables take Spark's own aggregate; the results are the same.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows, and bytes of files, up to which one aggregate keeps the distinct values of a group in memory.
FEW_ROWS = 5_000_000
FEW_BYTES = 256 << 20
#: Ranks of a sketch are off by one of so many parts of a group at most; groups of up to twice as many rows are counted whole.
ACCURACY = 10_000


def _few(df: DataFrame) -> bool:
    """Whether the table is small, by the sizes of what it is read from, or else by its rows."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size()))
    # Sources of unknown size count as exabytes.
    return size <= FEW_BYTES if size < 1 << 60 else df.count() <= FEW_ROWS


def _groups(df: DataFrame, keys: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"__k{i}" for i in range(len(keys))]
    return df.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)), "__v"), names


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """left joined with a row of right for each group; null is a group."""
    if not names:
        return left.crossJoin(F.broadcast(right))
    other = right.select(*(F.col(n).alias(f"__o{n}") for n in names), *(c for c in right.columns if c not in names))
    return left.join(other, functools.reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"__o{n}")) for n in names))).drop(*(f"__o{n}" for n in names))


def quantiles(df: DataFrame, value: Column, shares: Sequence[float], keys: Sequence[Column] = ()) -> DataFrame:
    """__k0, __k1, ... (the keys), __q array<double> (null without values), __n of the values; one row without keys."""
    base, names = _groups(df.withColumn("__v", value.cast("double")), keys)
    if _few(df):
        return base.groupBy(*names).agg(F.percentile("__v", list(shares)).alias("__q"), F.count("__v").alias("__n"))
    margin = 4 / ACCURACY
    low, high = [max(0.0, p - margin) for p in shares], [min(1.0, p + margin) for p in shares]
    sketch = F.percentile_approx("__v", [*low, *high], ACCURACY)
    near = base.groupBy(*names).agg(F.count("__v").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), sketch.alias("__s"))
    small = F.col("__n") <= 2 * ACCURACY
    ends = [(F.when(small | F.lit(a == 0), F.col("__min")).otherwise(F.col("__s")[i]), F.when(small | F.lit(b == 1), F.col("__max")).otherwise(F.col("__s")[len(low) + i])) for i, (a, b) in enumerate(zip(low, high, strict=True))]
    near = near.select(*names, "__n", F.array(*(a for a, _ in ends)).alias("__lo"), F.array(*(b for _, b in ends)).alias("__hi"))
    v = F.col("__v")
    # Grows with the value, and is the same between two brackets.
    region = sum(((v >= F.col("__lo")[i]).cast("int") + (v > F.col("__hi")[i]).cast("int") for i in range(len(shares))), F.lit(0))
    within = functools.reduce(lambda a, b: a | b, (v.between(F.col("__lo")[i], F.col("__hi")[i]) for i in range(len(shares))))
    met = _same(base.where(v.isNotNull()), near, names).select(*names, "__n", region.alias("__region"), F.when(within, v).alias("__x"))
    counts = met.groupBy(*names, "__n", "__region", "__x").agg(F.count(F.lit(1)).alias("__c"))
    upto = counts.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*names).orderBy("__region", "__x").rowsBetween(Window.unboundedPreceding, 0)))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("__upto") > rank, F.col("__x")))

    picked = []
    for i, p in enumerate(shares):
        place = (F.col("__n") - 1) * F.lit(float(p))
        picked += [at(F.floor(place)).alias(f"__a{i}"), at(F.ceil(place)).alias(f"__b{i}")]
    found = upto.groupBy(*names, "__n").agg(*picked)

    def between(i: int, p: float) -> Column:
        place = (F.col("__n") - 1) * F.lit(float(p))
        return F.when(F.floor(place) == F.ceil(place), F.col(f"__a{i}")).otherwise((F.ceil(place) - place) * F.col(f"__a{i}") + (place - F.floor(place)) * F.col(f"__b{i}"))

    out = found.select(*names, F.array(*(between(i, p) for i, p in enumerate(shares))).alias("__q"), "__n")
    if names:  # groups without values
        return out.unionByName(near.where("__n = 0").select(*names, F.lit(None).cast("array<double>").alias("__q"), "__n"))
    return near.select(F.col("__n").alias("__all")).join(out, F.col("__all") == F.col("__n"), "left").select("__q", F.col("__all").alias("__n"))


def medians(df: DataFrame, value: Column, name: str, keys: Sequence[Column] = ()) -> DataFrame:
    """The keys as __k0, ..., and the median; one row without keys."""
    found = quantiles(df, value, [0.5], keys)
    return found.select(*(c for c in found.columns if c.startswith("__k")), F.col("__q")[0].alias(name))


def modes(df: DataFrame, value: Column, name: str, keys: Sequence[Column] = ()) -> DataFrame:
    """The keys as __k0, ..., and the most frequent value (ties: the smallest); one row without keys, groups without values are left out."""
    base, names = _groups(df.withColumn("__v", value).where(F.col("__v").isNotNull()), keys)
    counts = base.groupBy(*names, "__v").agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*names).agg(F.min_by("__v", F.struct(-F.col("__n"), F.col("__v"))).alias(name))
