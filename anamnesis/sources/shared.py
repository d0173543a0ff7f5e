"""Tables written to the folder that driver and executors share: they end a lineage and outlive executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def written(df: DataFrame, what: str) -> DataFrame:
    """df written below spark.checkpoint.dir and read again. Where that is unset a temporary folder serves, but only if the
    executors are threads of the driver (local tests)."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = f"file://{tempfile.mkdtemp(prefix='anamnesis-')}"
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, read from files, over a few partitions for each core, where the files alone would leave cores idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(4 * cores)


def published(spark: SparkSession, text: str, path: str) -> bool:
    """Write a small file that appears at once and in whole; False if there is one of that name already.

    HDFS refuses to move a file onto another, and on a local disk a link does. Where a store does neither, one writer at a time
    must be seen to from outside.
    """
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = as_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
    out = fs.create(as_path(aside), False)
    out.write(text.encode())
    out.close()
    try:
        if fs.getUri().getScheme() != "file":
            return fs.rename(as_path(aside), as_path(path))
        try:
            os.link(as_path(aside).toUri().getPath(), as_path(path).toUri().getPath())
            return True
        except FileExistsError:
            return False
    finally:
        if fs.exists(as_path(aside)):
            fs.delete(as_path(aside), False)


def small_text(spark: SparkSession, path: str) -> str:
    as_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = as_path.getFileSystem(spark._jsc.hadoopConfiguration()).open(as_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
