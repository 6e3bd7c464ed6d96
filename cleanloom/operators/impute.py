"""Imputation. Medians and modes are small aggregates joined back, so a level costs one shuffle of its groups, not of the rows' whole width at once.

Each imputer leaves what was filled alone and tells in a status column where a value came from. Modes of equal counts go to
the smallest value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text as T
from . import detect, outliers, rows
from .headers import any_header
from .quantiles import medians, modes, quantiles

ORIGINAL = "Original Value"


#: Of rows, a value, the result's name and keys: a row a group, or one row without keys.
Stat = Callable[..., DataFrame]


def _by_group(df: DataFrame, keys: Sequence[str], stat: Stat, column: str, name: str, null_safe: bool = False) -> DataFrame:
    """df with the statistic of the column over the rows of equal keys; a null key gives null unless null_safe."""
    own = [f"__k{i}" for i in range(len(keys))]
    source = df if null_safe else df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    small = stat(source, F.col(column), name, [F.col(k) for k in keys])
    on = None
    for k, o in zip(keys, own, strict=True):
        same = F.col(k).eqNullSafe(F.col(o)) if null_safe else F.col(k) == F.col(o)
        on = same if on is None else on & same
    return df.join(small, on, "left").drop(*own)


def _of_all(df: DataFrame, source: DataFrame, stat: Stat, column: str, name: str) -> DataFrame:
    """df with the statistic of a column over all rows of source."""
    return df.crossJoin(F.broadcast(stat(source, F.col(column), name)))


def _filled(df: DataFrame, keep: Sequence[str], target: str, levels: Sequence[tuple[str, str]], status: str, original: str | None, else_status: str | None = None, as_double: bool = False) -> DataFrame:
    """Target from the first level (column, status text) that has a value."""
    v = F.col(target).cast("double") if as_double else F.col(target)
    value, told = v, F.when(v.isNotNull(), original)
    for name, text in levels:
        value = F.coalesce(value, F.col(name))
        told = told.when(F.col(name).isNotNull(), text)
    out = [(value.alias(c) if c == target else F.col(c)) for c in keep if c != status]
    return df.select(*out, told.otherwise(else_status).alias(status))


@any_header
def hierarchical_median(df: DataFrame, target: str, fine: str, coarse: str, status: str | None = None) -> DataFrame:
    """The fine group's median, else the coarse group's, else the table's."""
    for c in (target, fine, coarse):
        if c not in df.columns:
            raise KeyError(c)
    out = _by_group(df, [fine], medians, target, "__fine")
    out = out.join(medians(df.where(F.col(coarse).isNotNull()), F.col(target), "__coarse", [F.col(coarse)]), F.col(coarse) == F.col("__k0"), "left").drop("__k0")
    out = _of_all(out, df, medians, target, "__all")
    levels = [("__fine", "Filled by Item Context"), ("__coarse", "Filled by Category Context"), ("__all", "Filled by Global Median")]
    return _filled(out, df.columns, target, levels, status or f"{target}_imputation_status", ORIGINAL, as_double=True)


@any_header
def fill_missing(df: DataFrame, numbers: Sequence[str] | None = None, texts: Sequence[str] | None = None) -> DataFrame:
    """Numbers by their column's median, text by the sentinel."""
    numbers, texts = list(numbers if numbers is not None else rows.numeric_columns(df)), list(texts if texts is not None else rows.text_columns(df))
    df2 = df
    for i, c in enumerate(numbers):
        df2 = _of_all(df2, df, medians, c, f"__m_{i}")
    return df2.select(*(F.coalesce(F.col(c).cast("double"), F.col(f"__m_{numbers.index(c)}")).alias(c) if c in numbers else F.coalesce(F.col(c), F.lit(V.SENTINEL)).alias(c) if c in texts else F.col(c) for c in df.columns))


@any_header
def grouped_median(df: DataFrame, targets: Sequence[str], categorical: Sequence[str], fallback: Sequence[str] = ()) -> DataFrame:
    """The median of the best grouping column's group, then of the fallback groups'; no median of the table."""
    for target in targets:
        best = detect.best_grouping(df, target, categorical)
        groups = ([best] if best else []) + [g for g in fallback if g != best and g in df.columns]
        out, levels = df, []
        for i, g in enumerate(groups):
            small = medians(df.where(F.col(g).isNotNull()), F.col(target), f"__m_{i}", [F.col(g)])
            out = out.join(small, F.col(g) == F.col("__k0"), "left").drop("__k0")
            levels.append((f"__m_{i}", f"Filled by Grouped Median ({g})"))
        df = _filled(out, df.columns, target, levels, f"{target}_imputation_status", ORIGINAL, as_double=True)
    return df


@any_header
def categorical_by_context(df: DataFrame, targets: Sequence[str], anchors: Sequence[str]) -> DataFrame:
    """The mode of rows with equal anchors (null is a value), then of each anchor in turn over what is filled so far."""
    for target in targets:
        own = [a for a in anchors if a != target]
        status, cols = f"{target}_imputation_status", [c for c in df.columns if c != f"{target}_imputation_status"]
        df = _filled(_by_group(df, own, modes, target, "__m", True), cols, target, [("__m", "Filled by Item Context")], status, ORIGINAL) if own else df.withColumn(status, F.when(F.col(target).isNotNull(), ORIGINAL))
        for a in own:
            out = _by_group(df, [a], modes, target, "__m")
            told = F.when(F.col(target).isNull() & F.col("__m").isNotNull(), "Filled by Anchor Context").otherwise(F.col(status))
            df = out.select(*(F.coalesce(target, "__m").alias(c) if c == target else told.alias(c) if c == status else F.col(c) for c in df.columns))
    return df


@any_header
def median_waterfall(df: DataFrame, target: str, fine: str, coarse: str, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Fine median (null is a group), coarse median of the column as filled so far, the neighbour's value, the table's median."""
    out = _by_group(df, [fine], medians, target, "__1", True).withColumn("__v1", F.coalesce(F.col(target).cast("double"), F.col("__1")))
    out = _by_group(out, [coarse], medians, "__v1", "__2", True).withColumn("__v2", F.coalesce("__v1", "__2"))
    out = rows.neighbour(out, "__v2", order_by, partition_by, into="__3")
    out = _of_all(out, df, medians, target, "__4")
    levels = [("__1", "Filled by Item Context"), ("__2", "Filled by Category Fallback"), ("__3", "Filled by Sequential Neighbor"), ("__4", "Filled by Global Median")]
    return _filled(out, df.columns, target, levels, f"{target}_imputation_status", "Populated", as_double=True)


@any_header
def quantile_bin(df: DataFrame, value: str, bins: int = 5, into: str = "__bin") -> DataFrame:
    """Adds the bin 0, 1, ... of quantile edges (equal edges fall together; the first bin takes both its ends); null for null, and where the edges are one."""
    v = F.col(value).cast("double")
    edges = quantiles(df, v, [i / bins for i in range(bins + 1)]).select(F.array_distinct("__q").alias("__edges"))
    at = F.greatest(F.size(F.filter("__edges", lambda e: e < v)) - 1, F.lit(0))
    return df.crossJoin(F.broadcast(edges)).withColumn(into, F.when(v.isNotNull() & (F.size("__edges") > 1), at)).drop("__edges")


@any_header
def equal_width_bin(df: DataFrame, value: str, bins: int = 5, into: str = "__bin") -> DataFrame:
    v = F.col(value).cast("double")
    ends = df.agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    at = F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor((v - F.col("__lo")) * bins / (F.col("__hi") - F.col("__lo"))), F.lit(bins - 1)))
    return df.crossJoin(F.broadcast(ends)).withColumn(into, at.cast("int")).drop("__lo", "__hi")


@any_header
def mode_waterfall(df: DataFrame, target: str, fine: str, number: str, order_by: Sequence[str], partition_by: Sequence[str] = (), bins: int = 5) -> DataFrame:
    """Fine mode, the mode of the number's quantile bin, the neighbour's value, the table's mode."""
    out = _by_group(df, [fine], modes, target, "__1", True)
    out = _by_group(quantile_bin(out, number, bins), ["__bin"], modes, target, "__2").drop("__bin")
    out = rows.neighbour(out.withColumn("__v", F.coalesce(target, "__1", "__2")), "__v", order_by, partition_by, into="__3")
    out = _of_all(out, df, modes, target, "__4")
    levels = [("__1", "Filled by Item Context"), ("__2", "Filled by Numeric Bin"), ("__3", "Filled by Sequential Neighbor"), ("__4", "Filled by Global Mode")]
    return _filled(out, df.columns, target, levels, f"{target}_imputation_status", "Populated")


@any_header
def cleaned_and_carried(df: DataFrame, numbers: Sequence[str], texts: Sequence[str], fine: str, coarse: str, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Placeholders become null; numbers: fine median, coarse median, carried values, the table's median; text: fine mode, carried values, the table's mode."""
    df = df.select(*(T.blank_to_null(F.col(c)).alias(c) if c in texts else c for c in df.columns))
    for c in [*numbers, *texts]:
        stat = medians if c in numbers else modes
        levels, out = [("__1", "Filled by Item Context")], _by_group(df, [fine], stat, c, "__1")
        if c in numbers:
            out = _by_group(out, [coarse], stat, c, "__2")
            levels.append(("__2", "Filled by Category Context"))
        value = F.coalesce(F.col(c).cast("double") if c in numbers else F.col(c), *(n for n, _ in levels))
        out = _of_all(rows.carried(out.withColumn("__v", value), "__v", order_by, partition_by, into="__3"), df, stat, c, "__4")
        levels += [("__3", "Filled by Sequence"), ("__4", "Filled Globally")]
        df = _filled(out, df.columns, c, levels, f"{c}_imputation_status", ORIGINAL, as_double=c in numbers)
    return df


@any_header
def by_transaction(df: DataFrame, target: str, fine: str, coarse: str, keys: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = (), numeric: bool = True) -> DataFrame:
    """Fine, coarse, then the neighbour whose transaction keys are all equal, then the table; statuses Original, Filled ..., Unfilled."""
    stat = medians if numeric else modes
    out = _by_group(_by_group(df, [fine], stat, target, "__1"), [coarse], stat, target, "__2")
    out = rows.neighbour(out, target, order_by, partition_by, keys, into="__3") if keys else out.withColumn("__3", F.lit(None).cast(df.schema[target].dataType))
    out = _of_all(out, df, stat, target, "__4")
    levels = [("__1", "Filled by Item Context"), ("__2", "Filled by Category Context"), ("__3", "Filled by Transaction Neighbor"), ("__4", "Filled Globally")]
    return _filled(out, df.columns, target, levels, f"{target}_imputation_status", "Original", "Unfilled", numeric)


@any_header
def text_by_features(df: DataFrame, target: str, features: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """The neighbour with equal features (null-safe), the mode of equal features, then with the worst feature dropped one by one, then the table's mode as an estimate."""
    ranked = [r["feature"] for r in detect.predictiveness(df, target, features).collect()]
    out = rows.neighbour(df, target, order_by, partition_by, features, into="__n")
    levels = [("__n", "Neighbor Match")]
    for i in range(len(ranked)):
        out = _by_group(out, ranked[i:], modes, target, f"__m_{i}", True)
        levels.append((f"__m_{i}", "Multi-Feature Matrix" if i == 0 else "Relaxed Feature Match"))
    out = _of_all(out, df, modes, target, "__g").withColumn("__g", F.concat("__g", F.lit("_Estimated")))
    return _filled(out, df.columns, target, [*levels, ("__g", "Global Mode Fallback")], f"{target}_prediction_type", "Original")


@any_header
def text_by_siblings(df: DataFrame, target: str, contexts: Sequence[str], descriptive: Sequence[str] = (), with_sentinel: bool = True) -> DataFrame:
    """The mode of the context column whose equal (normalised) values have the most filled targets; else a known value that a description names; else the sentinel.

    All rows see the table as it was; {target}_predicted tells what was filled from context.
    """
    clean = T.blank_to_null(F.col(target))
    base = df.select(*(clean.alias(c) if c == target else F.col(c) for c in df.columns))
    out, options = base, []
    for i, c in enumerate(contexts):
        key = F.nullif(T.for_matching(F.col(c)), F.lit(""))
        counts = base.where(F.col(target).isNotNull()).groupBy(key.alias(f"__k_{i}"), F.col(target).alias("__t")).agg(F.count(F.lit(1)).alias("__n")).where(F.col(f"__k_{i}").isNotNull())
        small = counts.groupBy(f"__k_{i}").agg(F.sum("__n").alias(f"__c_{i}"), F.min_by("__t", F.struct(-F.col("__n"), F.col("__t"))).alias(f"__m_{i}"))
        out = out.join(small, key == F.col(f"__k_{i}"), "left")
        options.append(F.struct(F.coalesce(F.col(f"__c_{i}"), F.lit(0)).alias("n"), F.lit(-i).alias("first"), F.col(f"__m_{i}").alias("v")))
    best = F.array_max(F.array(*options))["v"] if options else F.lit(None).cast("string")
    named = F.lit(None).cast("string")
    if descriptive:
        # Distinct descriptions meet the words of known values, and come back by the descriptions themselves.
        known = base.where(F.col(target).isNotNull()).select(F.explode(T.keywords(F.col(target))).alias("__w")).distinct()
        # The first description that names a known word counts; of several words in it the smallest.
        at = lambda i: lambda w: F.struct(F.lit(i).alias("i"), w.alias("w"))
        words = F.flatten(F.array(*(F.transform(F.coalesce(T.keywords(F.col(d)), F.array().cast("array<string>")), at(i)) for i, d in enumerate(descriptive))))
        own = [F.col(d).alias(f"__d_{i}") for i, d in enumerate(descriptive)]
        asked = base.where(F.col(target).isNull()).select(*own, words.alias("__words")).distinct().withColumn("__at", F.explode("__words")).withColumn("__w", F.col("__at.w"))
        hit = asked.join(known, "__w").groupBy(*(f"__d_{i}" for i in range(len(descriptive)))).agg(F.min("__at")["w"].alias("__named"))
        same = F.lit(True)
        for i, d in enumerate(descriptive):
            same = same & F.col(d).eqNullSafe(F.col(f"__d_{i}"))
        out = out.join(hit, same, "left")
        named = F.initcap("__named")
    value = F.coalesce(F.col(target), best, named, *([F.lit(V.SENTINEL)] if with_sentinel else []))
    predicted = F.col(target).isNull() & F.coalesce(best, named).isNotNull()
    return out.select(*(value.alias(c) if c == target else F.col(c) for c in df.columns), predicted.alias(f"{target}_predicted"))


@any_header
def universal(df: DataFrame, numbers: Sequence[str], categorical: Sequence[str], fine: str | None = None, coarse: str | None = None) -> DataFrame:
    """Text in one form, categories by context, numbers by the best group's median, then products found and repaired."""
    df = df.select(*(T.imputation_text(F.col(c)).alias(c) if c in rows.text_columns(df) else c for c in df.columns))
    if not fine or not coarse:
        guides = detect.context_guides(df, [c for c in rows.text_columns(df)])
        fine, coarse = fine or guides[0], coarse or guides[1]
    anchors = [a for a in (fine, coarse) if a]
    df = categorical_by_context(df, categorical, anchors)
    df = grouped_median(df, numbers, [*dict.fromkeys([*categorical, *anchors])], anchors)
    found = outliers.products(df, numbers).orderBy(F.desc("share"), "c", "a", "b").collect() if len(numbers) > 2 else []
    relations = {r["c"]: (r["a"], r["b"], r["c"]) for r in reversed(found)}
    return outliers.repair_products(df, list(relations.values()))


@any_header
def by_bins(df: DataFrame, target: str, fine: str, number: str, same: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Fine mode, the mode of the number's bin, a neighbour that shares a column of `same`, the table's mode or Unknown."""
    out = _by_group(df, [fine], modes, target, "__1")
    out = _by_group(quantile_bin(out, number), ["__bin"], modes, target, "__2").drop("__bin")
    out = rows.neighbour(out, target, order_by, partition_by, into="__3", any_of=same) if same else out.withColumn("__3", F.lit(None).cast("string"))
    out = _of_all(out, df, modes, target, "__4").withColumn("__4", F.coalesce("__4", F.lit("Unknown")))
    levels = [("__1", "Filled by Item Context"), ("__2", "Filled by Numeric Bin"), ("__3", "Filled by Sequential Neighbor"), ("__4", "Filled by Global Mode")]
    return _filled(out, df.columns, target, levels, f"{target}_imputation_status", "Populated")


@any_header
def universal_legacy(df: DataFrame, numbers: Sequence[str], categorical: Sequence[str], fine: str, coarse: str, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Numbers: fine median, coarse median, the neighbour whose other columns are all equal, the table's median. Categories: fine mode, the
    mode of the bin of the number with the most values, a neighbour of the same fine or coarse group, the table's mode or Unknown.
    Statuses tell only what was filled; cells that were there have none."""
    for c in (fine, coarse):
        if c not in df.columns:
            raise KeyError(c)
    numbers, categorical = [c for c in numbers if c in df.columns], [c for c in categorical if c in df.columns]
    context = [c for c in df.columns if c not in (*numbers, *categorical)]
    best = None
    if numbers and categorical:
        counts = df.agg(*(F.count(F.col(c).cast("double")).alias(c) for c in numbers)).first()
        best = max(numbers, key=lambda c: counts[c])
    out = df
    for c in numbers:
        step = _by_group(_by_group(out, [fine], medians, c, "__1"), [coarse], medians, c, "__2")
        step = step.withColumn("__v", F.coalesce(F.col(c).cast("double"), "__1", "__2"))
        step = _of_all(rows.neighbour(step, "__v", order_by, partition_by, context, into="__3"), df, medians, c, "__4")
        levels = [("__1", "Filled by Item Context"), ("__2", "Filled by Category Fallback"), ("__3", "Filled by Sequential Neighbor"), ("__4", "Populated")]
        out = _filled(step, out.columns, c, levels, f"{c}_imputation_status", None, as_double=True)
    for c in categorical:
        step = _by_group(out, [fine], modes, c, "__1")
        step = _by_group(quantile_bin(step, best), ["__bin"], modes, c, "__2").drop("__bin") if best else step.withColumn("__2", F.lit(None).cast("string"))
        step = step.withColumn("__v", F.coalesce(c, "__1", "__2"))
        step = rows.neighbour(step, "__v", order_by, partition_by, into="__3", any_of=[fine, coarse])
        step = _of_all(step, df, modes, c, "__4").withColumn("__4", F.coalesce("__4", F.lit("Unknown")))
        levels = [("__1", "Filled by Item Context"), ("__2", "Filled by Category Fallback"), ("__3", "Filled by Sequential Neighbor"), ("__4", "Populated")]
        out = _filled(step, out.columns, c, levels, f"{c}_imputation_status", None)
    return out


@any_header
def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, status, n: where the values of each column came from."""
    status = {c: f"{c}_imputation_status" for c in columns}
    long = df.select(*(F.col(s).alias(c) for c, s in status.items())).unpivot([], list(columns), "column", "status")
    return long.groupBy("column", "status").agg(F.count(F.lit(1)).alias("n"))


@any_header
def sentinel_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(F.coalesce(F.col(c), F.lit(V.SENTINEL)).alias(c) if c in columns else c for c in df.columns))
