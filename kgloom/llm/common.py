"""What the corpus operators share: reading tables, scratch tables in the shared folder, text constants."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors see: under spark.checkpoint.dir, or the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/kgloom-{uuid.uuid4().hex}"


def _until_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    _until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, so that other columns of the input can't clash."""
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in columns.items()))


def bounded_sample(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """``n`` of ``rows`` (all, where there are fewer), the same in whatever order they come: those of the least hashes of the columns ``by``.

    The rows are counted first; those whose hash is far too great are dropped where they are read, so that the task which
    ranks the rest gets a few times ``n`` rows however large the table is. The bound leaves 4 n + 100 rows on average.
    """
    h, of = F.pmod(F.xxhash64(*by), F.lit(1 << 40)), rows.count()
    if of > 4 * n + 100:
        rows = rows.filter(h < F.lit(int((1 << 40) * (4 * n + 100) / of)))
    return rows.orderBy(h, *by).limit(n)


def text_slices(texts: pa.Array, octets: int = 1 << 20) -> Iterator[pa.Array]:
    """The texts in slices of about ``octets`` bytes, one text at least; null counts as empty."""
    texts = pc.fill_null(texts, "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        past = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + octets, "right"))
        yield texts.slice(at, max(1, past - at))
        at = max(past, at + 1)
