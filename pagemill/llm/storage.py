"""Tables written to the folder that the cluster's machines share."""

from __future__ import annotations

import gc
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Used only on a local master whose session names no folder, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints/pagemill"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster's machines share; without one named, the warehouse, which they share too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    return LOCAL_FOLDER if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local" else spark.conf.get("spark.sql.warehouse.dir")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, kept as a Parquet table in the shared folder: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """As `written`, in as many buckets of the column as there are shuffle partitions: joins and groups on it read the table without a shuffle.

    Each task writes a file per bucket that it has rows of, so deal rows by the column first unless a task has few values.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.option("path", path).option("compression", "uncompressed").bucketBy(shuffle_partitions(spark), column).saveAsTable(table)
    found = spark.table(table)
    found._bucketed = table
    return found


def bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket, of n, of 64-bit keys in a table of `bucketed`: Spark's hash (Murmur3 of a long, seed 42), positive modulo n."""
    u32 = np.uint32
    turn = lambda x, r: (x << u32(r)) | (x >> u32(32 - r))
    raw = np.asarray(keys, np.int64).view(np.uint64)
    h = np.full(len(raw), 42, u32)
    for half in (raw & np.uint64(0xFFFFFFFF), raw >> np.uint64(32)):
        k = turn(half.astype(u32) * u32(0xCC9E2D51), 15) * u32(0x1B873593)
        h = turn(h ^ k, 13) * u32(5) + u32(0xE6546B64)
    h ^= u32(8)
    h = (h ^ (h >> u32(16))) * u32(0x85EBCA6B)
    h = (h ^ (h >> u32(13))) * u32(0xC2B2AE35)
    h ^= h >> u32(16)
    return h.view(np.int32).astype(np.int64) % n


def delete(df: DataFrame) -> None:
    """Drop the files of a `written` table that nothing reads any more; and of a `bucketed` one its entry in the catalog."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if table := getattr(df, "_bucketed", None):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs: it does so once the driver has collected garbage."""
    gc.collect()
    spark._jvm.System.gc()


#: Texts go to Python in Arrow batches of about this size at most.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch, so that Python workers stay small beside the JVM.

    A session setting, because a lazy plan reads it only when it runs.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = spark.conf.get(key)
    except Exception:  # noqa: BLE001  (a Spark without the setting bounds rows only)
        return
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
