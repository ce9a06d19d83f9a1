"""Cutting lineage in iterative jobs: tables written to the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors see: under spark.checkpoint.dir, or the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/kgloom-{uuid.uuid4().hex}"


def _until_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def staged(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written and read back; survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    _until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, buckets: int, column: str) -> DataFrame:
    """The rows of ``df``, written in buckets by ``column`` and read back: a grouping by it moves none of them."""
    spark, name = df.sparkSession, f"kgloom_{uuid.uuid4().hex}"
    path = scratch(spark)
    df.write.bucketBy(buckets, column).option("path", path).saveAsTable(name)
    _until_exit(spark, path)
    return spark.table(name)
