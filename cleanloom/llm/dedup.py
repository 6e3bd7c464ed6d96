"""Exact dedup by skew-safe combining.

Three stages, each of which groups by the SHA-256 digest together with the whole normalised text, so that
rows only meet when their contents are the same:

1. Local: the map side of the first aggregation leaves each partition one row for each of its contents.
2. Salted: these meet in groups (digest, salt), the salt dealt by partition, so a content that fills a third of the
   table is merged by many tasks.
3. Global: the winners of the salts, at most SALTS a content, meet by digest.

Members then look up their class by digest, length and a second 64-bit hash. That the key names one
content is checked where contents are at hand (in stage 3): two contents with one key end the job with
an error, so a result is never wrong. A hot digest on the members' side is split by adaptive execution.

Defined results: null counts as an empty text; texts are equal when identical after lower-casing A-Z only;
the row with the largest id stays, a null id being smaller than any; rows that repeat the winning id and text are one
document and are all marked as kept, as are all rows of a class without any id; an empty table gives an
empty result; other columns aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared as sh

SALTS = 32


def normalised(text: Column) -> Column:
    return sh.ascii_lower(F.coalesce(text, F.lit("")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """A row for each distinct content: key binary, bytes, second, keep_id, group_size."""
    base = docs.select(F.col(id_col).alias("__id"), normalised(F.col(text_col)).alias("__norm"))
    base = base.select("__id", "__norm", F.unhex(F.sha2("__norm", 256)).alias("__key"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("__salt"))
    merge = [F.max("__id").alias("__id"), F.sum("__n").alias("__n")]
    salted = base.withColumn("__n", F.lit(1).cast("long")).groupBy("__key", "__salt", "__norm").agg(*merge)
    whole = salted.groupBy("__key", "__norm").agg(*merge)
    one = whole.select("__key", F.octet_length("__norm").alias("__bytes"), F.xxhash64("__norm").alias("__second"), "__id", "__n")
    # The contents are told apart already; a key of two of them ends the job.
    one = one.groupBy("__key", "__bytes", "__second").agg(F.max("__id").alias("keep_id"), F.sum("__n").alias("group_size"), F.count(F.lit(1)).alias("__contents"))
    sure = F.when(F.col("__contents") > 1, F.raise_error(F.lit("two contents with one digest, length and second hash"))).otherwise(F.col("group_size"))
    return one.select("__key", "__bytes", "__second", "keep_id", sure.cast("long").alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = normalised(F.col(text_col))
    members = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(norm, 256)).alias("__key"), F.octet_length(norm).alias("__bytes"), F.xxhash64(norm).alias("__second"))
    # As a table, so that both sides of the join are plain exchanges and a hot digest's members can be split.
    own = sh.written(classes(docs, id_col, text_col, salts), "dedup-classes")
    found = members.join(own, ["__key", "__bytes", "__second"], "left")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("__key")).alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    keep = exact_duplicates(docs, id_col, text_col, salts).where("kept").select(F.col("doc_id").alias("__keep_id"), F.col("text_sha256").alias("__sha")).distinct()
    mine = F.sha2(normalised(F.col(text_col)), 256)
    return docs.join(keep, F.col(id_col).eqNullSafe(F.col("__keep_id")) & (mine == F.col("__sha")), "left_semi")
