from test_change_feed import SCHEMA, by_hand, log, present

from kinespan.operators.change_feed import BucketedTable, review_changes
from kinespan.streaming.reviews import counts_by_window, keep_current


def test_log_as_a_stream(spark, tmp_path):
    lines = log(200, 5)
    for i in range(4):
        spark.createDataFrame(lines[i::4], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = BucketedTable(spark, str(tmp_path / "table"), ["reviewer_id", "reference_id"], 4)
    keep_current(stream, table, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert present(table, review_changes(spark.createDataFrame(lines, SCHEMA))) == by_hand(lines)


def test_windows_leave_out_late_lines(spark, tmp_path):
    rows = [("i", "2025-03-01 10:00:00"), ("Insert", "2025-03-01 11:00:00"), ("d", "2025-03-20 00:00:00")]
    for op, at in rows:
        spark.createDataFrame([(op, at)], "op string, at string").selectExpr("op", "cast(at AS timestamp) AS received_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("op string, received_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = counts_by_window(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {(r["op"], r["n"]) for r in spark.table("counts").collect()} == {("i", 2), ("d", 1)}
