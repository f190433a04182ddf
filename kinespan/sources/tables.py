"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """`{folder}/{name}.parquet`, a file or a folder of files."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored_bytes(df: DataFrame) -> int:
    """The size of the files behind `df`, as the file system states it."""
    context = df.sparkSession.sparkContext
    total = 0
    for name in df.inputFiles():
        where = context._jvm.org.apache.hadoop.fs.Path(name)
        total += where.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(where).getLen()
    return total
