"""Comparing executions with references: requests, planned comparisons, states and controls.

The plan is made before any distance, so that completeness is measured against it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespan.functions.labels import age_start
from kinespan.operators.dtw import CONDITIONING_VERSION, METRIC_VERSION, SUPPORT
from kinespan.workspace import MOST_TASKS

#: The age groups that references exist for, their distance in months, the offsets compared.
AGE_GROUPS = ["36_47mo", "48_59mo", "60_71mo", "72_83mo"]
STEP = 12
OFFSETS = [-1, 0, 1]
#: References that are broadcast at most, and planned comparisons that a task makes, about.
BROADCAST_REFERENCES, TASK_ROWS = 1_000_000, 4_000_000
#: References of a group that a task meets at a time.
BLOCK = 256


def reference_catalog(topk: DataFrame, primaries: DataFrame, groups: list[str]) -> DataFrame:
    """The catalog's distinct rows with `is_primary`: whether the group's primary is this segment."""
    main = primaries.select(*groups, F.col("medoid_segment_id").alias("_main"))
    return topk.distinct().join(main, groups, "left").withColumn("is_primary", F.coalesce(F.col("segment_id") == F.col("_main"), F.lit(False))).drop("_main")


def catalog_problems(catalog: DataFrame, training: DataFrame, groups: list[str]) -> DataFrame:
    """`problem`, `n`: groups without exactly one primary, references outside the training executions."""
    odd = catalog.groupBy(*groups).agg(F.count_if("is_primary").alias("n")).where("n <> 1").agg(F.count("*").alias("n"))
    outside = catalog.select("segment_id").distinct().join(training.select("segment_id"), "segment_id", "left_anti").agg(F.count("*").alias("n"))
    return odd.withColumn("problem", F.lit("groups_without_one_primary")).unionByName(outside.withColumn("problem", F.lit("references_outside_training"))).select("problem", "n")


def target_group(label: Column, offset: Column, ages: list[str] = AGE_GROUPS) -> Column:
    """The supported age group that starts `offset` steps after `label`'s; null for none and for an unreadable label."""
    starts = F.create_map(*[F.lit(x) for a in ages for x in (int(a.split("_")[0]), a)])
    return F.try_element_at(starts, age_start(label) + offset * F.lit(STEP))


def requests(executions: DataFrame, catalog: DataFrame, with_sequence: DataFrame | None = None, offsets: list[int] = OFFSETS) -> DataFrame:
    """One row per execution and offset with the group asked for and a state.

    `executions`: `segment_id`, `child`, `action`, `age`. States in order of precedence:
    `fuera_de_dominio_etario` (no such group, or an unreadable label), `sin_grupo_de_referencia`,
    `sin_secuencia` (not in `with_sequence`, where given), `solicitada`.
    """
    sizes = catalog.groupBy(F.col("action"), F.col("age").alias("_target")).agg(F.count("*").alias("_n"))
    asked = executions.select("segment_id", "child", "action", "age", F.explode(F.array(*map(F.lit, offsets))).alias("age_offset"))
    asked = asked.withColumn("_target", target_group(F.col("age"), F.col("age_offset"))).join(sizes, ["action", "_target"], "left")
    has = F.lit(True)
    if with_sequence is not None:
        asked = asked.join(with_sequence.select("segment_id", F.lit(True).alias("_has")).distinct(), "segment_id", "left")
        has = F.col("_has").isNotNull()
    state = (
        F.when(F.col("_target").isNull(), "fuera_de_dominio_etario").when(F.col("_n").isNull(), "sin_grupo_de_referencia")
        .when(~has, "sin_secuencia").otherwise("solicitada")
    )
    return asked.select(
        "segment_id", "child", "action", "age", "age_offset", F.coalesce("_target", F.lit("")).alias("target_age"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_references"), state.alias("state"),
    )


def planned(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per granted request and reference of its group.

    A few groups have most of the requests and most of the references, so requests are dealt by segment, into as
    many tasks as their references are worth, and meet all references there: no task has a group to itself.
    A task meets a group's references a block at a time, each with all its requests: rows repeat within a short
    distance, which files of so many rows need to stay small.
    """
    references = catalog.select(
        "action", F.col("age").alias("target_age"), F.col("segment_id").alias("reference_id"), F.col("child").alias("reference_child"), "rank", "is_primary"
    )
    granted = asked.where("state = 'solicitada'")
    n, n_references = granted.agg(F.sum("n_references")).first()[0] or 0, references.count()
    if n_references > BROADCAST_REFERENCES:
        return granted.drop("n_references", "state").join(references, ["action", "target_age"])
    nr = F.row_number().over(Window.partitionBy("action", "target_age").orderBy("reference_id", "rank", "reference_child"))
    blocks = references.withColumn("_block", F.floor((nr - 1) / BLOCK).cast("int"))
    each = granted.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_references") - 1) / BLOCK).cast("int")))).drop("n_references", "state")
    dealt = each.repartition(int(min(max(n // TASK_ROWS, 1), MOST_TASKS)), "segment_id", "age_offset").sortWithinPartitions("action", "target_age", "_block")
    dealt = dealt.where(F.monotonically_increasing_id() >= 0)  # always true; without it Spark drops a sort below a join
    return dealt.join(F.broadcast(blocks), ["action", "target_age", "_block"]).drop("_block")


def with_states(plan: DataFrame, distances: DataFrame, sequences: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The plan with `distance` and a state: `calculada`, `sin_secuencia` (either sequence is missing) or `sin_camino_admisible`.

    `distances`: `segment_id`, `reference_id`, `distance` of every comparison whose sequences exist, null for an abstention.
    """
    known = sequences.select("segment_id").distinct()
    met = plan.join(distances, ["segment_id", "reference_id"], "left")
    met = met.join(known.select("segment_id", F.lit(True).alias("_a")), "segment_id", "left")
    met = met.join(known.select(F.col("segment_id").alias("reference_id"), F.lit(True).alias("_b")), "reference_id", "left")
    state = F.when(F.col("distance").isNotNull(), "calculada").when(F.col("_a").isNull() | F.col("_b").isNull(), "sin_secuencia").otherwise("sin_camino_admisible")
    stamped = {"state": state, "metric_version": F.lit(METRIC_VERSION), "conditioning_version": F.lit(CONDITIONING_VERSION), "support": F.lit(support)}
    return met.withColumns(stamped).drop("_a", "_b")


def separation_controls(training: DataFrame, validation: DataFrame, catalog: DataFrame, plan: DataFrame, result: DataFrame) -> DataFrame:
    """`control`, `n_violations` of six controls; every one holds at 0.

    `child_in_both`: children of both sets; `reference_outside_training`; `own_reference`: an execution
    compared with its own child; `plan_not_observed`: planned or observed comparisons that the other
    side lacks; `duplicate_comparison`: repeated ones; `mixed_versions`: versions beyond the first.
    """
    key = ["segment_id", "reference_id", "age_offset"]
    of = lambda df, name: df.agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("control"), "n_violations")
    children = lambda df: df.select("child").where("child IS NOT NULL").distinct()
    a, b = plan.select(*key).distinct(), result.select(*key).distinct()
    checks = [
        of(children(training).intersect(children(validation)), "child_in_both"),
        of(catalog.select("segment_id").distinct().join(training, "segment_id", "left_anti"), "reference_outside_training"),
        of(result.where("child = reference_child"), "own_reference"),
        of(a.exceptAll(b).unionByName(b.exceptAll(a)), "plan_not_observed"),
        of(result.groupBy(*key).count().where("count > 1"), "duplicate_comparison"),
        of(result.select("metric_version", "conditioning_version").distinct(), "mixed_versions").withColumn("n_violations", F.greatest(F.col("n_violations") - 1, F.lit(0))),
    ]
    return reduce(DataFrame.unionByName, checks)


def state_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """`state` (and `by`) with the number of rows."""
    return rows.groupBy(*(by or []), "state").agg(F.count("*").alias("n"))
