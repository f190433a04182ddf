"""Resampling study of templates: plans, trials, and how trials compare.

A trial is one solved set of templates for a group, scheme, repetition, number of training children
and number of templates. Randomness is a seeded hash of these coordinates, so a trial does not depend
on partitions, on order or on other trials.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespan.operators import templates as T
from kinespan.workspace import written

#: Training sizes tried besides the largest, repetitions, children held out.
GRID = [3, 5, 8, 10, 12, 15, 20, 25, 30]
REPETITIONS, SEED, HELD_OUT = 200, 20260715, 3


def plan(children: DataFrame, keys: list[str], repetitions: int = REPETITIONS, seed: int = SEED, held_out: int = HELD_OUT) -> DataFrame:
    """`keys`, `scheme`, `repetition`, `child`, `train_order`, `maximum`: a permutation of each group's children per scheme and repetition.

    `train_order` is null for children held out and 1..maximum for the others; the first n of them are
    the training set of size n, so sets of growing size are nested. Schemes: `primary_h3` holds out
    `held_out` children; `secondary_h20` max(5, ceil(0.2 n)) if 8 are left. Groups with too few children have no rows.
    """
    distinct = children.select(*keys, "child").where("child IS NOT NULL").distinct()
    size = distinct.groupBy(*keys).agg(F.count("*").alias("n"))
    second = F.greatest(F.lit(5), F.ceil(F.round(F.col("n") * 0.2, 9))).cast("int")
    schemes = F.array_compact(F.array(
        F.when(F.col("n") > held_out, F.struct(F.lit("primary_h3").alias("scheme"), F.lit(held_out).alias("h"))),
        F.when(F.col("n") - second >= 8, F.struct(F.lit("secondary_h20").alias("scheme"), second.alias("h"))),
    ))
    tasks = size.select(*keys, "n", F.explode(schemes).alias("s")).select(*keys, "n", "s.*", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("repetition"))
    place = F.xxhash64(F.lit(seed), *[F.col(k) for k in keys], "scheme", "repetition", "child")
    nr = F.row_number().over(Window.partitionBy(*keys, "scheme", "repetition").orderBy(place, "child"))
    return distinct.join(tasks, keys).withColumn("_nr", nr).select(
        *keys, "scheme", "repetition", "child", F.when(F.col("_nr") > F.col("h"), F.col("_nr") - F.col("h")).alias("train_order"), (F.col("n") - F.col("h")).cast("int").alias("maximum")
    )


def nested_sets(planned: DataFrame, keys: list[str], grid: list[int] = GRID) -> DataFrame:
    """`keys`, `scheme`, `repetition`, `n_children`, `maximum`, `child`: the training sets of every size of the grid, and of the largest."""
    sizes = F.array_distinct(F.concat(F.filter(F.array(*map(F.lit, grid)), lambda n: (n >= 3) & (n <= F.col("maximum"))), F.array("maximum")))
    each = planned.where("train_order IS NOT NULL").withColumn("n_children", F.explode(sizes))
    return each.where("train_order <= n_children").select(*keys, "scheme", "repetition", "n_children", "maximum", "child")


def trials(distances: DataFrame, planned: DataFrame, keys: list[str], ks: list[int], grid: list[int] = GRID, starts: int = 5) -> DataFrame:
    """One row per trial: `ids`, `train_loss`, `holdout_loss`, `holdout_p90`, `support_ok`.

    `distances` as `templates.clip_distances`. All trials of a k are solved together: a trial is a group
    whose costs are those of its training children. Holdout losses are over the children held out.
    Unknown costs count as in `templates.filled_costs`.
    """
    at = [*keys, "scheme", "repetition", "n_children"]
    sets = written(nested_sets(planned, keys, grid), "sets")
    matrix = written(T.filled_costs(T.cost_matrix(distances, keys), keys), "costs")
    own = matrix.join(sets, [*keys, "child"])
    cost = own.join(sets.select(*at, F.col("child").alias("candidate_child")), [*at, "candidate_child"]).select(*at, "child", "candidate", "candidate_child", "cost")
    cost = written(cost, "trial-costs")
    held = planned.where("train_order IS NULL").select(*keys, "scheme", "repetition", "child")
    out = []
    for k in ks:
        enough = cost.where(F.col("n_children") >= k)
        solved = written(T.solved_templates(enough, at, k, starts), "solved")
        value = T.objectives(enough, solved, at).withColumnRenamed("objective", "train_loss")
        near = T._nearest_two(enough, solved, at).groupBy(*at, "n1").agg(F.count("*").alias("c")).groupBy(*at).agg(F.min("c").alias("c"), F.count("*").alias("used"))
        least = F.greatest(F.lit(T.SUPPORT_LEAST), F.ceil(F.round(F.col("n_children") * T.SUPPORT_SHARE, 9)))
        support = near.select(*at, ((F.col("used") == k) & (F.col("c") >= least)).alias("support_ok"))
        outside = matrix.join(solved, [*keys, "candidate"]).join(held, [*keys, "scheme", "repetition", "child"]).groupBy(*at, "child").agg(F.min("cost").alias("c"))
        losses = outside.groupBy(*at).agg(F.avg("c").alias("holdout_loss"), F.percentile("c", F.lit(0.9)).alias("holdout_p90"))
        out.append(value.join(support, at).join(losses, at, "left").withColumn("k", F.lit(k)))
    found = reduce(DataFrame.unionByName, out)
    return found.join(planned.select(*keys, "scheme", "repetition", "maximum").distinct(), [*keys, "scheme", "repetition"])


def against_largest(found: DataFrame, keys: list[str]) -> DataFrame:
    """Trials with their comparison to the one with most children of the same repetition and k: `excess`, `exact_match`, `jaccard`."""
    at = [*keys, "scheme", "repetition", "k"]
    largest = found.where("n_children = maximum").select(*at, F.col("ids").alias("_ids"), F.col("holdout_loss").alias("_loss"))
    met = found.join(largest, at, "left")
    return met.withColumns({
        "excess": F.col("holdout_loss") - F.col("_loss"), "exact_match": F.col("ids") == F.col("_ids"), "jaccard": T.set_overlap(F.col("ids"), F.col("_ids")),
    }).drop("_ids", "_loss")


def partners(found: DataFrame, keys: list[str], what: str = "ids") -> DataFrame:
    """Trials with `partner`, the `what` of the next repetition of the same size and k, of the first after the last; null for a single one."""
    w = Window.partitionBy(*keys, "scheme", "n_children", "k").orderBy("repetition")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    alone = F.count("*").over(whole) < 2
    return found.withColumn("partner", F.when(~alone, F.coalesce(F.lead(what).over(w), F.first(what).over(whole))))


def partner_geometry(found: DataFrame, distances: DataFrame, keys: list[str], k: int) -> DataFrame:
    """How far each trial's set of `k` templates lies from its partner's, all children of the group being known: `templates.set_geometry` by trial."""
    at = [*keys, "scheme", "repetition", "n_children", "k"]
    met = partners(found.where(F.col("k") == k), keys).where("partner IS NOT NULL")
    side = lambda c: met.select(*at, F.posexplode(c).alias("slot", "candidate"))
    return T.set_geometry(side("ids"), side("partner"), distances, at, k, keys)


def paired_gains(found: DataFrame, keys: list[str], loss: str = "holdout_loss") -> DataFrame:
    """Trials with `reduction_vs_k1`, `gain_vs_previous_k` (relative) and `gain_per_child` over the next smaller size."""
    by_k = Window.partitionBy(*keys, "scheme", "repetition", "n_children").orderBy("k")
    by_n = Window.partitionBy(*keys, "scheme", "repetition", "k").orderBy("n_children")
    relative = lambda base: F.when(base > 0, (base - F.col(loss)) / base)
    one = F.first(F.when(F.col("k") == 1, F.col(loss)), True).over(by_k.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    step = F.col("n_children") - F.lag("n_children").over(by_n)
    return found.withColumns({
        "reduction_vs_k1": relative(one),
        "gain_vs_previous_k": F.when(F.lag("k").over(by_k) == F.col("k") - 1, relative(F.lag(loss).over(by_k))),
        "gain_per_child": (F.lag(loss).over(by_n) - F.col(loss)) / step,
    })


def coassignment(assigned: DataFrame, keys: list[str], trial: str = "repetition") -> DataFrame:
    """`keys`, `child_a` <= `child_b`, `n_trials`, `together`: how often two children of a group share a template.

    Pairs of children are what is asked for; they meet within one trial of one group.
    """
    a = assigned.select(*keys, trial, F.col("child").alias("child_a"), F.col("slot").alias("_a"))
    b = assigned.select(*keys, trial, F.col("child").alias("child_b"), F.col("slot").alias("_b"))
    met = a.join(b, [*keys, trial]).where("child_a <= child_b")
    return met.groupBy(*keys, "child_a", "child_b").agg(F.count("*").alias("n_trials"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("together"))


def assignment_stability(assigned: DataFrame, keys: list[str], k: int) -> DataFrame:
    """`keys`, `child`, `modal_slot`, `modal_share`, `entropy` of a child's slots over all trials; entropy over ln k, 0 for one template."""
    counts = assigned.groupBy(*keys, "child", "slot").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys, "child"))
    p = counts.withColumn("p", F.col("n") / total)
    entropy = -F.sum(F.col("p") * F.log("p")) / F.lit(log(k)) if k > 1 else F.lit(0.0)
    best = F.max(F.struct("p", (-F.col("slot")).alias("s")))
    return p.groupBy(*keys, "child").agg(best.alias("b"), entropy.alias("entropy")).select(*keys, "child", (-F.col("b.s")).alias("modal_slot"), F.col("b.p").alias("modal_share"), (F.col("entropy") + 0.0).alias("entropy"))


def mode_text(c: Column) -> Column:
    """The most frequent text, of equally frequent ones the first; `<missing>` for none."""
    return F.coalesce(F.mode(c, True), F.lit("<missing>"))
