"""Where intermediate tables go, and how lineage is cut.

Executors can be lost, so nothing that is read twice may live on one of them. Tables are written to
the shared folder that the cluster names in ``spark.checkpoint.dir``; only a local session without
that setting gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in a local session without it, a new temporary one."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SETTING} must name a folder that all executors share")
    named = tempfile.mkdtemp(prefix="kinespan-")
    spark.conf.set(SETTING, named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: computed once, readable after the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._written_at = path
    return found


def discard(df: DataFrame) -> None:
    """Deletes the table behind a result of `written` that nothing reads any more, such as the last round's state."""
    path = getattr(df, "_written_at", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table that `written` or `new_path` made. Absent paths are no error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Tasks over which `spread` deals groups at most.
MOST_TASKS = 50_000


def spread(df: DataFrame, keys: list[str], n_groups: int) -> DataFrame:
    """`df` dealt by `keys` into as many tasks as their `n_groups` groups are worth: few bytes may mean much work, so Spark must not merge them by size."""
    return df.repartition(int(min(max(n_groups, 1), max(64, n_groups // 4), MOST_TASKS)), *keys)
