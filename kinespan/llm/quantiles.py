"""Percentiles of very many values per group by exact bisection.

For each wanted rank there is an interval of values that holds it. A pass cuts every interval at
evenly spaced midpoints, counts the rows between them and keeps, of each group and rank, the part
that holds the rank, drawn in to the least and greatest value seen there. An interval of one value
is resolved. Counts add up, so days or partitions can be counted apart and their counts combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespan.workspace import discard, written

#: Parts that a pass makes of an interval: it does the work of eight halvings.
FANOUT = 256
#: Interval tables of at most this many rows are broadcast; larger ones are joined with salted rows.
BROADCAST_ROWS = 50_000
SALTS = 16
#: Passes after which the values must be resolved; doubles need fewer.
MAX_PASSES = 300


def summary_counts(values: DataFrame, by: list[str]) -> DataFrame:
    """`n`, `least` and `most` of `_v` by `_g` and the columns `by`: the first pass, of one part of the data."""
    return values.groupBy("_g", *by).agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))


def combined(counts: DataFrame) -> DataFrame:
    """Counts of several parts of the data as counts of the whole."""
    by = [c for c in ("_g", "lo", "hi", "cell") if c in counts.columns]
    return counts.groupBy(*by).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def cell_counts(values: DataFrame, intervals: DataFrame, n_intervals: int, by: list[str]) -> DataFrame:
    """Rows of `values` between the midpoints of the `intervals` (`_g`, `lo`, `hi`) of their group, by `by`."""
    inside = (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))
    if n_intervals <= BROADCAST_ROWS:
        met = values.join(F.broadcast(intervals), "_g").where(inside)
    else:
        salted = intervals.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = values.withColumn("_s", (F.rand(7) * SALTS).cast("int")).join(salted, ["_g", "_s"]).where(inside)
    width = F.col("hi") - F.col("lo")
    place = F.when(width < float("inf"), (F.col("_v") - F.col("lo")) / width).otherwise((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2))
    cell = F.least(F.lit(FANOUT - 1), F.floor(place * FANOUT)).cast("int")
    return met.groupBy("_g", "lo", "hi", cell.alias("cell"), *by).agg(
        F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most")
    )


def within(values: DataFrame, intervals: DataFrame, n_intervals: int) -> DataFrame:
    """The rows of `values` in any interval of their group, each once: all that later passes need."""
    lists = intervals.groupBy("_g").agg(F.collect_list(F.struct("lo", "hi")).alias("_in"))  # two for each wanted percentile at most
    if n_intervals <= BROADCAST_ROWS:
        met = values.join(F.broadcast(lists), "_g")
    else:
        salted = lists.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = values.withColumn("_s", (F.rand(7) * SALTS).cast("int")).join(salted, ["_g", "_s"]).drop("_s")
    return met.where(F.exists("_in", lambda i: (F.col("_v") >= i["lo"]) & (F.col("_v") <= i["hi"]))).drop("_in")


def narrowed(open_: DataFrame, counts: DataFrame) -> DataFrame:
    """The open ranks (`_g`, `rank`, `lo`, `hi`, `below`) with the cell of their interval that holds them."""
    running = Window.partitionBy("_g", "lo", "hi").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.withColumn("upto", F.sum("n").over(running))
    met = open_.join(upto, ["_g", "lo", "hi"])
    before = F.col("below") + F.col("upto") - F.col("n")
    return met.where((before <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("upto"))).select(
        "_g", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), before.alias("below")
    )


def percentiles(
    rows: DataFrame, group: Column, value: Column, wanted: list[float], part: Column | None = None, tolerance: float = 0.0
) -> DataFrame:
    """`grp`, `percentile`, `value`, `n_values` for each group and each of `wanted` (shares from 0 to 1).

    Linear interpolation between neighbouring ranks, every row counting. The value is exact for
    `tolerance` 0, else off by at most `tolerance`, since intervals no wider than it are left as they
    are and answered by their lower end. Values that are null, NaN or infinite do not count;
    rows of a null group neither. Groups without a value, and empty tables, give no rows. With `part`
    every pass counts each part of the data apart and then combines the parts' counts.
    """
    if any(not 0 <= p <= 1 for p in wanted) or not wanted:
        raise ValueError("percentiles are shares from 0 to 1, at least one")
    by = ["_part"] if part is not None else []
    number = value.cast("double")
    values = rows.select(group.alias("_g"), number.alias("_v"), *([part.alias("_part")] if by else []))
    values = values.where(F.col("_g").isNotNull() & (F.abs("_v") < F.lit(float("inf"))))
    values = written(values, "values")

    whole = summary_counts(values, by)
    whole = written(combined(whole) if by else whole, "summary")
    place = F.col("p") * (F.col("n") - 1)
    targets = written(
        whole.withColumn("p", F.explode(F.array(*map(F.lit, sorted(set(wanted))))))
        .select("_g", "p", "n", F.floor(place).alias("low"), F.ceil(place).alias("high"), (place - F.floor(place)).alias("part_of"), "least", "most"),
        "targets",
    )
    ranks = targets.select("_g", F.explode(F.array("low", "high")).alias("rank"), F.col("least").alias("lo"), F.col("most").alias("hi")).distinct()
    state = written(ranks.withColumn("below", F.lit(0).cast("long")), "ranks")
    wide = (F.col("hi") - F.col("lo")) > tolerance
    resolved = [state.where(~wide)]
    rows_left = values
    for nr in range(MAX_PASSES):
        open_ = state.where(wide)
        n_open = open_.count()
        if not n_open:
            break
        intervals = open_.select("_g", "lo", "hi").distinct()
        if nr == 1:
            # the first pass left each rank a small part of the values; what lies outside has been counted
            rows_left = written(within(values, intervals, n_open), "values")
            discard(values)
        counts = cell_counts(rows_left, intervals, n_open, by)
        state = written(narrowed(open_, combined(counts) if by else counts), "ranks")
        resolved.append(state.where(~wide))
    else:
        raise RuntimeError(f"not resolved in {MAX_PASSES} passes")
    discard(rows_left)
    found = resolved[0]
    for more in resolved[1:]:
        found = found.unionByName(more)
    found = found.select("_g", "rank", F.col("lo").alias("v"))
    low = found.select("_g", F.col("rank").alias("low"), F.col("v").alias("v_low"))
    high = found.select("_g", F.col("rank").alias("high"), F.col("v").alias("v_high"))
    between = F.col("v_low") + (F.col("v_high") - F.col("v_low")) * F.col("part_of")
    return targets.join(low, ["_g", "low"]).join(high, ["_g", "high"]).select(
        F.col("_g").alias("grp"), F.col("p").alias("percentile"), between.alias("value"), F.col("n").alias("n_values")
    )
