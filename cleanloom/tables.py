"""Tables in the folder that driver and executors share: they cut a plan's lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, in local mode, a new local one; on a cluster an error, as no local folder is shared."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cleanloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The rows of df as a written table in the shared folder (or a folder in it)."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of files for each task that runs at once, up to which spread() takes no more partitions than such tasks.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys to as many partitions as tasks run at once; larger tables, and those of unknown size, to Spark's number of them. A table of one file would else stay in one task, as would what is written from it."""
    leaves, tasks = df._jdf.queryExecution().optimizedPlan().collectLeaves(), df.sparkSession.sparkContext.defaultParallelism
    few = sum(leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size())) <= tasks * SPREAD_BYTES
    return df.repartition(tasks, *keys) if few else df.repartition(*keys)


def local(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A table of rows that the driver has. It goes to the JVM as Arrow's, where lists of rows would take a job of Python workers."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], schema=kinds), StructType.fromDDL(schema))


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of tables that no plan reads any more."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
