"""Profiles of executions against younger, own and older age groups, and their roll-ups.

Abstention is contagious on purpose: a summary of a set of references, or of a child's executions,
exists only if every member has its distance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The summaries over a group's references, and the names of the age offsets.
SUMMARIES = ("primaria", "mediana_topk", "minimo_topk")
OFFSET_NAMES = {-1: "Y", 0: "E", 1: "O"}


def profiles(results: DataFrame) -> DataFrame:
    """Three rows per execution: `summary`, `d_Y`, `d_E`, `d_O`, margins against E, `complete`, `nearest`.

    `primaria` needs exactly one primary reference; the others need all references of the group.
    `nearest` is null without distances and on a tie for the least. One shuffle, by execution.
    """
    keys = ["segment_id", "child", "action", "age"]
    aggregates: list[Column] = []
    for offset, name in OFFSET_NAMES.items():
        here = F.col("age_offset") == offset
        done = F.col("state") == "calculada"
        value = F.when(here, F.col("distance"))
        all_done = (F.count_if(here & ~done) == 0) & (F.count_if(here) > 0)
        primary = here & F.col("is_primary")
        aggregates += [
            F.when((F.count_if(primary) == 1) & (F.count_if(primary & ~done) == 0), F.max(F.when(primary, F.col("distance")))).alias(f"primaria_{name}"),
            F.when(all_done, F.percentile(value, F.lit(0.5))).alias(f"mediana_topk_{name}"),
            F.when(all_done, F.min(value)).alias(f"minimo_topk_{name}"),
        ]
    wide = results.groupBy(*keys).agg(*aggregates)
    rows = F.array(*[F.struct(F.lit(s).alias("summary"), *[F.col(f"{s}_{n}").alias(f"d_{n}") for n in OFFSET_NAMES.values()]) for s in SUMMARIES])
    long = wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    distances = [F.col(f"d_{n}") for n in OFFSET_NAMES.values()]
    least = F.least(*distances)
    ties = reduce(lambda a, b: a + b, [F.coalesce((d == least).cast("int"), F.lit(0)) for d in distances])
    nearest = F.when(ties == 1, F.when(F.col("d_Y") == least, "Y").when(F.col("d_E") == least, "E").otherwise("O"))
    return long.withColumns({
        "margin_Y_E": F.col("d_Y") - F.col("d_E"), "margin_O_E": F.col("d_O") - F.col("d_E"),
        "complete": reduce(lambda a, b: a & b, [d.isNotNull() for d in distances]), "nearest": nearest,
    })


def child_action_rollup(found: DataFrame) -> DataFrame:
    """Per child, action, summary and statistic (`media`, `mediana`, `minimo`, `maximo`) the distances, null unless all executions have them."""
    statistics = {"media": F.avg, "mediana": lambda c: F.percentile(c, F.lit(0.5)), "minimo": F.min, "maximo": F.max}
    keys = ["child", "action", "summary"]
    aggregates = [
        F.when(F.count(f"d_{n}") == F.count("*"), f(F.col(f"d_{n}"))).alias(f"{s}_{n}") for s, f in statistics.items() for n in OFFSET_NAMES.values()
    ]
    wide = found.groupBy(*keys).agg(F.count("*").alias("n_executions"), *aggregates)
    rows = F.array(*[F.struct(F.lit(s).alias("statistic"), *[F.col(f"{s}_{n}").alias(f"d_{n}") for n in OFFSET_NAMES.values()]) for s in statistics])
    return wide.select(*keys, "n_executions", F.explode(rows).alias("r")).select(*keys, "n_executions", "r.*")


def coverage(found: DataFrame) -> DataFrame:
    """Per summary: executions, with E, complete, without any distance; and on the executions complete in all three
    summaries the medians, the nearest groups and how often the nearest differs from the primary summary's (a tie on both sides differs)."""
    common = found.groupBy("segment_id").agg(
        F.count_if("complete").alias("_c"), F.max(F.when(F.col("summary") == "primaria", F.col("nearest"))).alias("_primary")
    )
    met = found.join(common, "segment_id").withColumn("_common", F.col("_c") == len(SUMMARIES))
    on = lambda c: F.when(F.col("_common"), c)
    none = F.col("d_Y").isNull() & F.col("d_E").isNull() & F.col("d_O").isNull()
    same = F.coalesce(F.col("nearest") == F.col("_primary"), F.lit(False))
    return met.groupBy("summary").agg(
        F.count("*").alias("n_executions"), F.count("d_E").alias("n_with_E"), F.count_if("complete").alias("n_complete"), F.count_if(none).alias("n_none"),
        F.count_if("_common").alias("n_common"),
        *[F.percentile(on(F.col(f"d_{n}")), F.lit(0.5)).alias(f"median_{n}") for n in OFFSET_NAMES.values()],
        *[F.count_if(F.col("_common") & (F.col("nearest") == n)).alias(f"nearest_{n}") for n in OFFSET_NAMES.values()],
        F.count_if(F.col("_common") & ~same).alias("n_changed"),
    )
