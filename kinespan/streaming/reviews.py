"""The review log as a stream: the present table kept current, and counts by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from kinespan.operators.change_feed import BucketedTable, operation, review_changes


def keep_current(log: DataFrame, table: BucketedTable, checkpoint: str) -> DataStreamWriter:
    """Applies a stream of review lines to `table`, batch by batch; start the returned writer.

    Applying a batch again changes nothing, so a batch repeated after a failure does no harm.
    """

    def apply(batch: DataFrame, _: int) -> None:
        table.apply(review_changes(batch))

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def counts_by_window(log: DataFrame, size: str = "1 day", late: str = "7 days") -> DataFrame:
    """Lines by window of `received_at` and operation; lines more than `late` behind are left out, and windows that old are final."""
    kept = log.withWatermark("received_at", late).where(F.col("received_at").isNotNull())
    return kept.groupBy(F.window("received_at", size).alias("w"), operation(F.col("op")).alias("op")).agg(F.count("*").alias("n")).select("w.start", "w.end", "op", "n")
