"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's folder under spark.checkpoint.dir. Unset, a folder under /tmp serves a local master, whose driver
    and executors are one process; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "/tmp/checkpoints"
    return f"{found.rstrip('/')}/quillon-{spark.sparkContext.applicationId}"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Documents of one Arrow batch.
BATCH_DOCS = 512


def short_batches(spark: SparkSession | None) -> None:
    """From now on a Python worker of the session gets few documents at once, so that what it holds does not grow with a partition."""
    if spark is not None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_DOCS))


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def clear(spark: SparkSession) -> None:
    """Delete the session's scratch tables; results that still read them must have been written before."""
    p = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew if it has fewer partitions than there are cores: a small file of one row group would keep one busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Tables of at most so many short rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for a broadcast if its counted rows allow one."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
