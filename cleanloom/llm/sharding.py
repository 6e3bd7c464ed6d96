"""Proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled by a seeded hash and ranked within their source; rank r of n gets the fraction
(2r - 1) / 2n, and the order of all rows by fraction is cut into shards of equal counts. Each source is
spread evenly over that order, so every shard holds the mixture.

Both ranks are found without a task that sees a whole source, or all rows: a source's rows are bucketed by their
hash, and all rows by their fraction; a rank is the count of the buckets before plus the place in its own bucket. Only counts of
buckets meet in one task.

Law: `rows` (counts of shards differ by one at most). Groups of equal texts are not held together: one
group may be larger than a shard, and the method ranks rows.

Defined results: null and empty texts have size 1 and crc 0; a null source is a source of its own; the
order of ties is by hash, id, crc and size, so rows that tie are the same in every column of the result; repeated rows are rows
of their own; an empty table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _shared as sh

#: Rows in a bucket, about.
BUCKET_ROWS = 4096


def _offsets(counts: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """Adds __before: the rows of lower buckets (with the same `by`)."""
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*by, bucket, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))


def interleaved(docs: DataFrame, shards: int = 8, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A row for each row of docs: doc_id, source, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    # A key that is never null and differs for a null source.
    base = base.withColumn("__stratum", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string"))))
    base = base.withColumn("__h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    base = sh.written(base, "shard-rows")
    n = base.count()
    buckets = max(1, -(-n // bucket_rows))
    order = ["__h", "doc_id", "text_crc32", "size"]

    base = base.withColumn("__b", F.pmod(F.shiftrightunsigned("__h", 20), F.lit(buckets)).cast("long"))
    cells = base.groupBy("__stratum", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = _offsets(cells, ["__stratum"], "__b")
    totals = cells.groupBy("__stratum").agg(F.sum("__n").alias("__total"))
    # By (stratum, bucket): the join and the window share one exchange.
    ranked = base.join(before.join(totals, "__stratum"), ["__stratum", "__b"])
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("__stratum", "__b").orderBy(*order))
    ranked = ranked.withColumn("__f", (2 * rank - 1) / (2 * F.col("__total"))).drop("__before", "__b", "__total")
    ranked = sh.written(ranked.withColumn("__b", F.least(F.floor(F.col("__f") * buckets), F.lit(buckets - 1)).cast("long")), "shard-ranks")

    before = _offsets(ranked.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")), [], "__b")
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__b").orderBy("__f", "__stratum", *order)) - 1
    placed = ranked.join(before, "__b").withColumn("__place", place)
    shard = F.expr(f"__place * {shards}L div {max(n, 1)}L")
    # Shard s starts at the first place whose shard is s.
    first = F.expr(f"(shard * {max(n, 1)}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard.cast("int")).select("doc_id", "source", "size", "text_crc32", "shard", (F.col("__place") - first).cast("long").alias("slot"))
