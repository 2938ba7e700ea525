"""Tables in the folder that driver and executors share; they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table that others are joined with is broadcast up to this many rows; beyond, the join shuffles.
BROADCAST_ROWS = 50_000
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only with a local master where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-cascade-")
    return f"file://{_own[app]}"


def written(df: DataFrame) -> DataFrame:
    """df written once and read back, for plans that read it several times; the table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def looked_up(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df written once, for joins: as a broadcast if it has at most so many rows, so that what it is joined with stays where it is."""
    out = written(df)
    return F.broadcast(out) if out.count() <= most else out
