"""Queries of the core's data problems: skewed groups (p2) and the change feed (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespan.functions.labels import action_key, age_key
from kinespan.operators.change_feed import DELETED, BucketedTable, buckets_for, review_changes
from kinespan.operators.skewed_groups import dense_group_statistics, heavy_groups
from kinespan.sources.tables import stored_bytes, table
from kinespan.workspace import new_path

KEYS = ["action_code", "age_bin_12m_label"]


def _statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of every group as the rows' own labels name it; labels are read on the distinct spellings."""
    pairs = table(spark, folder, "dtw_pairwise").select(*KEYS, "segment_id_a", "segment_id_b", "distance")
    return dense_group_statistics(pairs, KEYS, "distance", ["segment_id_a", "segment_id_b"], [action_key(F.col(KEYS[0])), age_key(F.col(KEYS[1]))])


def p2_group_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, distinct executions, smallest and mean usable distance of every (action, age) that a row names."""
    return _statistics(spark, folder).na.drop(subset=KEYS).withColumn("mean_value", F.round("mean_value", 4))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Groups with at least 5 % of all stored rows."""
    return heavy_groups(_statistics(spark, folder)).select(*KEYS)


def present_reviews(spark: SparkSession, folder: str, batches: int = 2) -> DataFrame:
    """The present review table: the log applied to an empty table in `batches` runs of line numbers."""
    log = table(spark, folder, "registro_revision_visual")
    changes = review_changes(log)
    current = BucketedTable(spark, new_path(spark, "reviews"), ["reviewer_id", "reference_id"], buckets_for(stored_bytes(log)))
    low, high = changes.agg(F.min("_arrival"), F.max("_arrival")).first()
    if low is not None:
        nr = F.floor((F.col("_arrival") - low) * batches / (high - low + 1))
        for b in range(batches):
            current.apply(changes.where(nr == b))
    return current.current(changes.drop("_order", "_arrival", DELETED).schema)


def p4_current_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Every present row with the whole of its answers."""
    return present_reviews(spark, folder).select(
        "reviewer_id", "reference_id", "revision", "final_status", "actor_identity",
        F.array_join("failure_reasons", "|").alias("failure_reasons"),
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every present row."""
    return present_reviews(spark, folder).select("reviewer_id", "reference_id", "revision", "final_status")


QUERIES = {
    "p2_found": p2_found,
    "p2_group_statistics": p2_group_statistics,
    "p4_found": p4_found,
    "p4_current_reviews": p4_current_reviews,
}

_ACTION = r"""CASE WHEN regexp_extract({0}, '^\D*0*(\d{{1,9}})\D*$', 1) <> '' THEN 'A' || CASE WHEN length(regexp_extract({0}, '^\D*0*(\d{{1,9}})\D*$', 1)) < 2
 THEN '0' ELSE '' END || regexp_extract({0}, '^\D*0*(\d{{1,9}})\D*$', 1) END"""
_AGE = r"""CASE WHEN regexp_matches({0}, '^\D*\d+\D+\d+\D*$') THEN regexp_extract({0}, '^\D*0*(\d+)\D+0*(\d+)\D*$', 1) || '_' || regexp_extract({0}, '^\D*0*(\d+)\D+0*(\d+)\D*$', 2) || 'mo' END"""


def action_sql(column: str) -> str:
    """DuckDB's form of `labels.action_key`."""
    return _ACTION.format(column)


def age_sql(column: str) -> str:
    """DuckDB's form of `labels.age_key`."""
    return _AGE.format(column)


_PAIRS = f"SELECT {action_sql('action_code')} AS action_code, {age_sql('age_bin_12m_label')} AS age_bin_12m_label, segment_id_a, segment_id_b, distance FROM dtw_pairwise"
_CURRENT = r"""SELECT lower(trim(reviewer_id, E' \t\r\n')) AS reviewer_id, reference_id, revision, upper(trim(answers.final_status, E' \t\r\n')) AS final_status,
 answers.actor_identity AS actor_identity, array_to_string(answers.failure_reasons, '|') AS failure_reasons,
 lower(trim(op, E' \t\r\n'))[1] AS o, row_number() OVER (PARTITION BY lower(trim(reviewer_id, E' \t\r\n')), reference_id ORDER BY revision DESC, line_no DESC) AS nr
 FROM registro_revision_visual
 WHERE reviewer_id IS NOT NULL AND reference_id IS NOT NULL AND revision IS NOT NULL AND op IS NOT NULL"""

SQL = {
    "p2_found": f"""WITH p AS ({_PAIRS}) SELECT action_code, age_bin_12m_label FROM p WHERE action_code IS NOT NULL AND age_bin_12m_label IS NOT NULL
 GROUP BY 1, 2 HAVING count(*) >= 0.05 * (SELECT count(*) FROM p)""",
    "p2_group_statistics": f"""WITH p AS ({_PAIRS}), u AS (
 SELECT action_code, age_bin_12m_label, count(DISTINCT s) AS n_members FROM (
  SELECT action_code, age_bin_12m_label, unnest([segment_id_a, segment_id_b]) AS s FROM p) GROUP BY 1, 2), g AS (
 SELECT action_code, age_bin_12m_label, count(*) AS n_rows,
  count(*) FILTER (WHERE isfinite(distance) AND distance >= 0) AS n_usable,
  min(distance) FILTER (WHERE isfinite(distance) AND distance >= 0) AS min_value,
  round(avg(distance) FILTER (WHERE isfinite(distance) AND distance >= 0), 4) AS mean_value FROM p GROUP BY 1, 2)
 SELECT action_code, age_bin_12m_label, n_rows, n_members, n_usable, min_value, mean_value FROM g JOIN u USING (action_code, age_bin_12m_label)""",
    "p4_found": f"SELECT reviewer_id, reference_id, revision, final_status FROM ({_CURRENT}) WHERE nr = 1 AND o <> 'd'",
    "p4_current_reviews": f"SELECT reviewer_id, reference_id, revision, final_status, actor_identity, failure_reasons FROM ({_CURRENT}) WHERE nr = 1 AND o <> 'd'",
}
