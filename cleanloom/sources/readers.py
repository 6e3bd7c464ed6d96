"""Readers. Everything comes in as text, as messy files do; types are found later."""

from __future__ import annotations

import codecs
import csv
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..operators import rows

#: Bytes at a file's start that a byte-order mark is looked for in.
PROBE_BYTES = 4


def guess_encoding(data: bytes) -> str:
    """The first of the encodings that reads the bytes strictly; a byte-order mark decides at once. A character cut at the end counts as read."""
    if data.startswith(codecs.BOM_UTF8):
        return "utf-8-sig"
    if data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return "utf-16"
    for name in V.READER_ENCODINGS:
        try:
            codecs.getincrementaldecoder(name)("strict").decode(data)
            return name
        except UnicodeDecodeError:
            continue
    return "utf-8"


def detect_encodings(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of the path by encoding. Each file's is the first that reads all its lines strictly, found in a distributed pass; a byte-order mark decides at once."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted(s.getPath().toString() for s in fs.globStatus(where) or [] if s.isFile()) or sorted(s.getPath().toString() for s in fs.listStatus(where) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
    found = {}
    for f in files:
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f))
        try:
            head = bytes(stream.readNBytes(PROBE_BYTES))
        finally:
            stream.close()
        if head.startswith((codecs.BOM_UTF8, codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
            found[f] = "utf-16" if head.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)) else "utf-8-sig"
    # Line breaks are the same byte in all the other encodings.
    for f in [f for f in files if f not in found]:
        found[f] = _strict(spark, f)
    out: dict[str, list[str]] = {}
    for f in files:
        out.setdefault(found[f], []).append(f)
    return out


def _strict(spark: SparkSession, file: str) -> str:
    """The first of the encodings that reads all lines of the file."""

    def run(batches):
        import pandas as pd

        fine = dict.fromkeys(V.READER_ENCODINGS, True)
        for pdf in batches:
            for data in pdf["value"]:
                for name in V.READER_ENCODINGS:
                    try:
                        fine[name] and bytes(data).decode(name)
                    except UnicodeDecodeError:
                        fine[name] = False
        yield pd.DataFrame({"name": list(fine), "fine": list(fine.values())})

    lines = spark.read.text(file).select(F.col("value").cast("binary").alias("value"))
    fine = {r["name"] for r in lines.mapInPandas(run, "name string, fine boolean").groupBy("name").agg(F.bool_and("fine").alias("fine")).where("fine").collect()}
    return next((n for n in V.READER_ENCODINGS if n in fine), "utf-8")


#: Encodings that Spark's CSV reader takes itself.
_NATIVE = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1", "utf-16": "UTF-16"}


def read_csv(spark: SparkSession, path: str | list[str], encoding: str | None = None, na: tuple[str, ...] = V.READER_NA, separator: str = ",") -> DataFrame:
    """All columns as text; headers stripped; the NA tokens become null. encoding None: found from all bytes of each file.

    Encodings that Spark's reader doesn't take are decoded line by line, in splits, before it parses them; such files can't have line breaks within fields.
    """
    if encoding is None:
        groups = [read_csv(spark, files, name, na, separator) for name, files in detect_encodings(spark, path).items()]
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), groups)
    if encoding in _NATIVE:
        df = spark.read.option("header", True).option("encoding", _NATIVE[encoding]).option("multiLine", encoding == "utf-16").option("sep", separator).option("nullValue", "").csv(path)
    else:
        lines = _decoded(spark, path, encoding)
        first = lines.where("head").select("value").first()
        names = next(iter(csv.reader([first[0]], delimiter=separator))) if first else []
        schema = ", ".join(f"_{i} string" for i in range(len(names)))
        body = lines.where("NOT head AND value <> ''")
        df = body.select(F.from_csv("value", schema, {"sep": separator}).alias("r")).select("r.*").toDF(*names) if names else spark.createDataFrame([], "empty string")
    return _tidied(df, na)


def _tidied(df: DataFrame, na: tuple[str, ...]) -> DataFrame:
    """Headers stripped and each once (a later one of the same name gets a number), NA tokens null."""
    names: list[str] = []
    for c in (c.lstrip("﻿").strip() for c in df.columns):
        names.append(next(n for k in range(len(df.columns)) if (n := f"{c}.{k}" if k else c) not in names))
    df = df.toDF(*names)
    return df.select(*(F.when(F.col(rows.quoted(c)).isin(*na), None).otherwise(F.col(rows.quoted(c))).alias(c) for c in df.columns))


def _decoded(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """head (whether it's the first line of a file), value of the lines; files are split as Spark splits them."""

    def run(batches):
        import pandas as pd

        begun = set()
        for pdf in batches:
            head = []
            for file, start in zip(pdf["file"], pdf["start"], strict=True):
                head.append(start == 0 and file not in begun)
                begun.add(file)
            yield pd.DataFrame({"head": head, "value": [bytes(v).decode(encoding, "replace").rstrip("\r") for v in pdf["value"]]})

    lines = spark.read.text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return lines.mapInPandas(run, "head boolean, value string")


def read_xlsx(spark: SparkSession, path: str, na: tuple[str, ...] = V.READER_NA) -> DataFrame:
    """The first sheets of workbooks, all columns as text; the first row of the first file has the headers. One task a file, as a workbook holds about a million rows at most."""

    def run(batches):
        import pandas as pd

        from . import xlsx

        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"], strict=True):
                some: list = []
                for n, cells in enumerate(xlsx.read_rows(bytes(data))):
                    some.append((file, n, cells))
                    if len(some) == 10_000:
                        yield pd.DataFrame(some, columns=["file", "n", "cells"])
                        some = []
                yield pd.DataFrame(some, columns=["file", "n", "cells"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, n int, cells array<string>")
    first = found.where("n = 0").orderBy("file").select("cells").first()
    if not first:
        return spark.createDataFrame([], "empty string")
    names = [c if c is not None else f"Unnamed: {i}" for i, c in enumerate(first["cells"])]
    df = found.where("n > 0").select(*(F.try_element_at("cells", F.lit(i + 1)).alias(f"_{i}") for i in range(len(names)))).toDF(*names)
    return _tidied(df, na)


def typed_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """CSV with types that Spark infers from all rows."""
    df = spark.read.option("header", True).option("inferSchema", True).option("sep", separator).csv(path)
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """By the name's ending: csv, txt, tsv, xlsx, parquet, json, orc."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("csv", "txt", "tsv"):
        return read_csv(spark, path, **({"separator": "\t"} if kind == "tsv" else {}) | options)
    if kind in ("parquet", "json", "orc"):
        return getattr(spark.read, kind)(path)
    if kind == "xlsx":
        return read_xlsx(spark, path, **options)
    raise ValueError(f"no reader for .{kind} files")
