"""Report queries: support by group, review states, reductions by policy, fingerprints of stored matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def support_matrix(executions: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """`row` with a pair of columns per value: distinct children and executions; 0 where there are none."""
    wide = executions.groupBy(row).pivot(column, values).agg(F.count_distinct("child").alias("children"), F.count(F.lit(1)).alias("executions"))
    return wide.na.fill(0)


def review_states(log: DataFrame, line: str = "line_no") -> DataFrame:
    """`reference_id`, `reviewer_id`, `final_status`: the state in force of each reference.

    Of each reviewer's lines on it the highest revision holds, of several the later line; of several
    reviewers the one who appeared last on it, whatever the revisions. Lines without reviewer, reference
    or revision do not count.
    """
    rows = log.where("reviewer_id IS NOT NULL AND reference_id IS NOT NULL AND revision IS NOT NULL")
    own = rows.groupBy("reference_id", "reviewer_id").agg(
        F.min(line).alias("_first"), F.max(F.struct(F.col("revision"), F.col(line), F.col("final_status"))).alias("_last")
    )
    last = own.groupBy("reference_id").agg(F.max(F.struct("_first", "reviewer_id", F.col("_last.final_status").alias("final_status"))).alias("r"))
    return last.select("reference_id", "r.reviewer_id", "r.final_status")


def review_tally(catalog: DataFrame, states: DataFrame) -> DataFrame:
    """`final_status`, `n` over the catalog's references; those without a state are `pendiente`."""
    met = catalog.select(F.col("segment_id").alias("reference_id")).distinct().join(states, "reference_id", "left")
    return met.groupBy(F.coalesce("final_status", F.lit("pendiente")).alias("final_status")).agg(F.count("*").alias("n"))


def policy_reduction(losses: DataFrame, keys: list[str], policy: str, loss: str, base: str, policies: list[str]) -> DataFrame:
    """`policy`, `reduction_pct`: 100 (1 - mean of each group's loss over its loss under `base`), one row per policy other than it."""
    others = [p for p in policies if p != base]
    wide = losses.groupBy(*keys).pivot(policy, policies).agg(F.first(loss))
    ratio = [F.avg(F.col(f"`{p}`") / F.when(F.col(f"`{base}`") > 0, F.col(f"`{base}`"))).alias(p) for p in others]
    long = wide.agg(*ratio).unpivot([], others, "policy", "r")
    return long.select("policy", (100 * (1 - F.col("r"))).alias("reduction_pct"))


def fingerprints(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """`keys`, `n_rows`, `fingerprint`: an order-free digest of each group's rows, equal for equal rows in any order and layout.

    Row digests are summed in decimal, so groups of any size need no sorting and no gathering.
    """
    text: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]
    digest = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *text), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum(digest).cast("string").alias("fingerprint"))


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_nr", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nr = 1").drop("_nr")
