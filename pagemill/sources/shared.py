"""Tables in the folder that the cluster's machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only on a local master whose session names no folder, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints/pagemill"


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet, in spark.checkpoint.dir; without that, in the warehouse, which machines share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = LOCAL_FOLDER if spark.sparkContext.master.partition("[")[0] == "local" else spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, kept as a table: what reads them twice computes them once, and their lineage ends."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
