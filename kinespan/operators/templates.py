"""Templates of groups: p-median sets over children, with one template per child, and how sets compare.

Every step works on all groups at once: a greedy pick, or a round of swaps, is one aggregation of the
long cost table. A group is named by `keys`; a resampled group is a group with more keys.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespan.operators.references import both_ways
from kinespan.workspace import written

#: A swap must lower the objective by more than this, and by more than this share of it: sums of very large costs are no more exact.
TOLERANCE, RELATIVE = 1e-12, 1e-9
#: Rounds of swaps after which it is an error that they still find one.
MAX_SWAPS = 1_000
#: A template's least number of children: 5, or this share of the group's.
SUPPORT_SHARE, SUPPORT_LEAST = 0.15, 5


def complete_clips(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, `segment_id` of the clips that have a distance to every other clip of their group.

    Clips with a missing pair are left out, since costs over different sets of clips do not compare.
    """
    per = both_ways(pairs, keys).groupBy(*keys, "segment_id").agg(F.count("*").alias("n"))
    size = per.groupBy(*keys).agg(F.count("*").alias("size"))
    return per.join(size, keys).where("n = size - 1").select(*keys, "segment_id")


def every_clip(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, `segment_id` of all clips that have a distance to any other clip of their group."""
    return both_ways(pairs, keys).select(*keys, "segment_id").distinct()


def clips_left_out(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, `n_clips`, `n_complete`, `n_pairs`, `n_complete_pairs`: how much of each group `complete_clips` keeps, in clips and in pairs of them."""
    clips, kept = every_clip(pairs, keys), complete_clips(pairs, keys)
    side = lambda c: kept.select(*keys, F.col("segment_id").alias(c))
    inside = pairs.join(side("segment_id_a"), [*keys, "segment_id_a"], "left_semi").join(side("segment_id_b"), [*keys, "segment_id_b"], "left_semi")
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    met = count(clips, "n_clips").join(count(kept, "n_complete"), keys, "left").join(count(pairs, "n_pairs"), keys).join(count(inside, "n_complete_pairs"), keys, "left")
    return met.na.fill(0, ["n_complete", "n_complete_pairs"]).select(*keys, "n_clips", "n_complete", "n_pairs", "n_complete_pairs")


def clip_distances(pairs: DataFrame, clips: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, `segment_id`, `child`, `candidate`, `candidate_child`, `distance` of all ordered pairs of clips, a clip to itself 0.

    `clips`: `keys`, `segment_id`, `child`; both ends of a pair must be among them.
    """
    ends = both_ways(pairs, keys).withColumnRenamed("other", "candidate")
    own = clips.select(*keys, "segment_id", F.col("segment_id").alias("candidate"), F.lit(0.0).alias("distance"))
    other = clips.select(*keys, F.col("segment_id").alias("candidate"), F.col("child").alias("candidate_child"))
    return ends.unionByName(own).join(clips, [*keys, "segment_id"]).join(other, [*keys, "candidate"])


def cost_matrix(distances: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, `child`, `candidate`, `candidate_child`, `cost`: the mean distance of a child's clips to a candidate clip."""
    return distances.groupBy(*keys, "child", "candidate", "candidate_child").agg(F.avg("distance").alias("cost"))


def filled_costs(cost: DataFrame, keys: list[str]) -> DataFrame:
    """`cost_matrix` with a row for every child and candidate of a group, also where no distance of the child's clips to the candidate is known.

    Such a cost is the child's greatest known one, so that no candidate gains by a missing distance; `known` is false there.
    A matrix without missing costs stays as it is.
    """
    far = cost.groupBy(*keys, "child").agg(F.max("cost").alias("_far"))
    cells = far.join(cost.select(*keys, "candidate", "candidate_child").distinct(), keys)
    met = cells.join(cost, [*keys, "child", "candidate", "candidate_child"], "left")
    return met.select(*keys, "child", "candidate", "candidate_child", F.coalesce("cost", "_far").alias("cost"), F.col("cost").isNotNull().alias("known"))


def group_scales(distances: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, `between`, `within`: the median over pairs of children of their clips' median distance, and over children
    with several clips of their own clips'. Null where there is none."""
    ordered = distances.where("segment_id < candidate")
    per = ordered.groupBy(*keys, F.least("child", "candidate_child").alias("a"), F.greatest("child", "candidate_child").alias("b")).agg(F.percentile("distance", F.lit(0.5)).alias("m"))
    same = F.col("a") == F.col("b")
    median = lambda where: F.percentile(F.when(where, F.col("m")), F.lit(0.5))
    return per.groupBy(*keys).agg(median(~same).alias("between"), median(same).alias("within"))


def _ids(c: Column) -> Column:
    return F.array_sort(c)


def greedy_templates(cost: DataFrame, keys: list[str], k: int) -> DataFrame:
    """`keys`, `slot`, `candidate`, `candidate_child`: picked one after the other, each lowering the mean least cost most.

    Clips of children that have a template are no candidates. Ties go to the first id, objectives being
    compared at 9 decimals. A group with fewer than `k` children gets as many as it has.
    """
    best = cost.select(*keys, "child").distinct().withColumn("best", F.lit(float("inf")))
    picks: list[DataFrame] = []
    for slot in range(k):
        met = cost.join(best, [*keys, "child"])
        value = met.groupBy(*keys, "candidate", "candidate_child").agg(F.avg(F.least("cost", "best")).alias("v"))
        if picks:
            used = reduce(DataFrame.unionByName, picks).select(*keys, "candidate_child")
            value = value.join(used, [*keys, "candidate_child"], "left_anti")
        key = F.struct(F.round("v", 9).alias("v"), F.col("candidate").alias("c"), F.col("candidate_child").alias("h"))
        pick = value.groupBy(*keys).agg(F.min(key).alias("p"))
        pick = written(pick.select(*keys, F.lit(slot).alias("slot"), F.col("p.c").alias("candidate"), F.col("p.h").alias("candidate_child")), "pick")
        picks.append(pick)
        if slot + 1 < k:
            near = cost.join(pick.select(*keys, "candidate"), [*keys, "candidate"]).select(*keys, "child", F.col("cost").alias("c"))
            best = written(best.join(near, [*keys, "child"], "left").select(*keys, "child", F.least("best", "c").alias("best")), "best")
    return reduce(DataFrame.unionByName, picks)


def random_templates(cost: DataFrame, keys: list[str], k: int, seed: int) -> DataFrame:
    """As `greedy_templates`, but `k` different children by a seeded hash and one clip of each by another."""
    clips = cost.select(*keys, "candidate", "candidate_child").distinct()
    child = F.xxhash64(F.lit(seed), *[F.col(x) for x in keys], "candidate_child")
    clip = F.xxhash64(F.lit(seed + 1), *[F.col(x) for x in keys], "candidate")
    one = clips.groupBy(*keys, "candidate_child").agg(F.min_by("candidate", F.struct(clip, "candidate")).alias("candidate"))
    nr = F.row_number().over(Window.partitionBy(*keys).orderBy(child, "candidate_child")) - 1
    return one.withColumn("slot", nr).where(F.col("slot") < k).select(*keys, "slot", "candidate", "candidate_child")


def _nearest_two(cost: DataFrame, templates: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, `child`, `n1` (slot), `c1`, `c2`: the nearest template of each child and the cost of the next, infinite without one."""
    met = cost.join(templates.select(*keys, "slot", "candidate"), [*keys, "candidate"])
    order = F.array_sort(F.collect_list(F.struct("cost", "slot")))  # as many as there are templates
    two = met.groupBy(*keys, "child").agg(order.alias("o"))
    return two.select(*keys, "child", F.col("o")[0]["slot"].alias("n1"), F.col("o")[0]["cost"].alias("c1"), F.coalesce(F.get("o", F.lit(1))["cost"], F.lit(float("inf"))).alias("c2"))


def objectives(cost: DataFrame, templates: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, `objective`, `ids` (sorted) of each group's templates."""
    value = _nearest_two(cost, templates, keys).groupBy(*keys).agg(F.avg("c1").alias("objective"))
    return value.join(templates.groupBy(*keys).agg(_ids(F.collect_list("candidate")).alias("ids")), keys)


def refined_templates(cost: DataFrame, templates: DataFrame, keys: list[str]) -> DataFrame:
    """Templates after swaps: in each round every group makes the swap of one template that lowers its objective most, until none does.

    Ties go to the set whose sorted ids come first. All swaps of a group are valued in one pass over its
    costs: without template t a child falls back to its next, so min(cost, fallback) is all there is to it.
    """
    state = written(templates, "templates")
    for _ in range(MAX_SWAPS):
        two = _nearest_two(cost, state, keys)
        slots = state.groupBy(*keys).agg(F.collect_list(F.struct("slot", "candidate", "candidate_child")).alias("held"))
        met = cost.join(two, [*keys, "child"]).join(slots, keys).withColumn("out", F.explode("held"))
        taken = F.exists("held", lambda h: (h["slot"] != F.col("out.slot")) & (h["candidate_child"] == F.col("candidate_child")))
        without = F.when(F.col("n1") == F.col("out.slot"), F.col("c2")).otherwise(F.col("c1"))
        value = met.where(~taken & (F.col("candidate") != F.col("out.candidate"))).groupBy(*keys, "candidate", "candidate_child", F.col("out.slot").alias("slot")).agg(
            F.avg(F.least("cost", without)).alias("v"), F.first("held").alias("held")
        )
        ids = _ids(F.transform("held", lambda h: F.when(h["slot"] == F.col("slot"), F.col("candidate")).otherwise(h["candidate"])))
        key = F.struct(F.round("v", 9).alias("v"), ids.alias("ids"), F.col("slot").alias("slot"), F.col("candidate").alias("c"), F.col("candidate_child").alias("h"), F.col("v").alias("exact"))
        now = two.groupBy(*keys).agg(F.avg("c1").alias("now"))
        best = written(value.groupBy(*keys).agg(F.min(key).alias("s")).join(now, keys).where(F.col("s.exact") < F.col("now") - F.greatest(F.lit(TOLERANCE), F.col("now") * RELATIVE)), "swaps")
        if not best.take(1):
            return state
        swap = best.select(*keys, F.col("s.slot").alias("slot"), F.col("s.c").alias("_c"), F.col("s.h").alias("_h"))
        state = written(
            state.join(swap, [*keys, "slot"], "left").select(*keys, "slot", F.coalesce("_c", "candidate").alias("candidate"), F.coalesce("_h", "candidate_child").alias("candidate_child")), "templates"
        )
    raise RuntimeError(f"swaps still lower an objective after {MAX_SWAPS} rounds")


def solved_templates(cost: DataFrame, keys: list[str], k: int, starts: int = 5, seed: int = 20260715) -> DataFrame:
    """`keys`, `slot`, `candidate`, `candidate_child`: the best of a greedy and `starts` - 1 random starts, each refined by swaps.

    The best has the least objective, then the first ids. Slots are in the order of ids.
    """
    if k < 1 or starts < 1:
        raise ValueError("k and starts must be at least 1")
    runs = [greedy_templates(cost, keys, k)] + [random_templates(cost, keys, k, seed + 1000 * s) for s in range(1, starts)]
    begun = reduce(DataFrame.unionByName, [r.withColumn("start", F.lit(i)) for i, r in enumerate(runs)])
    each = cost.withColumn("start", F.explode(F.array(*map(F.lit, range(starts))))) if starts > 1 else cost.withColumn("start", F.lit(0))
    refined = refined_templates(each, begun, [*keys, "start"])
    value = objectives(each, refined, [*keys, "start"])
    best = value.groupBy(*keys).agg(F.min(F.struct(F.round("objective", 9).alias("v"), "ids", "start")).alias("b")).select(*keys, F.col("b.start").alias("start"))
    kept = refined.join(best, [*keys, "start"]).drop("start", "slot")
    nr = F.row_number().over(Window.partitionBy(*keys).orderBy("candidate")) - 1
    return kept.withColumn("slot", nr).select(*keys, "slot", "candidate", "candidate_child")


def assignments(distances: DataFrame, templates: DataFrame, keys: list[str]) -> DataFrame:
    """Per child of each group: `template`, `slot`, `loss`, `clip_loss`, `margin`, `consistency`.

    `loss`: mean distance of the child's clips to its template, the nearest by that mean (ties: the first
    slot); `clip_loss`: mean of each clip's least distance; `margin`: what the second template costs more,
    null for one template; `consistency`: share of clips whose own nearest template is the child's.
    """
    met = distances.join(templates.select(*keys, "slot", "candidate"), [*keys, "candidate"])
    clip = met.groupBy(*keys, "child", "segment_id").agg(F.min(F.struct("distance", "slot")).alias("n"))
    clips = clip.groupBy(*keys, "child", F.col("n.slot").alias("s")).agg(F.count("*").alias("n"), F.sum("n.distance").alias("t"))
    sides = clips.groupBy(*keys, "child").agg(F.sum("n").alias("n_clips"), F.sum("t").alias("total"), F.map_from_entries(F.collect_list(F.struct("s", "n"))).alias("by"))
    means = met.groupBy(*keys, "child", "slot", "candidate").agg(F.avg("distance").alias("c"))
    order = F.array_sort(F.collect_list(F.struct("c", "slot", "candidate")))
    first = means.groupBy(*keys, "child").agg(order.alias("o")).join(sides, [*keys, "child"])
    near = F.col("o")[0]
    return first.select(
        *keys, "child", near["candidate"].alias("template"), near["slot"].alias("slot"), near["c"].alias("loss"), (F.col("total") / F.col("n_clips")).alias("clip_loss"),
        (F.get("o", F.lit(1))["c"] - near["c"]).alias("margin"),
        (F.coalesce(F.try_element_at("by", near["slot"]), F.lit(0)) / F.col("n_clips")).alias("consistency"),
    )


def assignment_summary(assigned: DataFrame, scales: DataFrame, keys: list[str], ambiguous: float = 0.05) -> DataFrame:
    """`keys`, children, mean, median and 90th percentile of the loss, and the share of children whose margin is at most `ambiguous` times `between`."""
    met = assigned.join(scales.select(*keys, "between"), keys, "left")
    close = F.coalesce(F.col("margin") <= ambiguous * F.col("between"), F.lit(False))
    return met.groupBy(*keys).agg(
        F.count("*").alias("n_children"), F.avg("loss").alias("loss_mean"), F.percentile("loss", F.lit(0.5)).alias("loss_median"), F.percentile("loss", F.lit(0.9)).alias("loss_p90"),
        F.avg(close.cast("double")).alias("ambiguous_share"),
    )


def support(assigned: DataFrame, templates: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, `slot`, `candidate`, `n_assigned`, `minimum`, `supported`: children of each template against max(5, ceil(0.15 n)); unused ones have 0."""
    used = assigned.groupBy(*keys, "slot").agg(F.count("*").alias("n_assigned"))
    sizes = assigned.groupBy(*keys).agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(SUPPORT_LEAST), F.ceil(F.round(F.col("n") * SUPPORT_SHARE, 9))).cast("int")
    met = templates.join(used, [*keys, "slot"], "left").join(sizes, keys)
    n = F.coalesce("n_assigned", F.lit(0))
    return met.select(*keys, "slot", "candidate", n.cast("long").alias("n_assigned"), least.alias("minimum"), (n >= least).alias("supported"))


def near_limit(scales: DataFrame, keys: list[str], of_within: float = 1.0, of_between: float = 0.1) -> DataFrame:
    """`keys`, `near`: up to where two templates count as alike: the scale within children, or without one a part of that between them."""
    within = F.when(F.col("within") > 0, F.col("within") * of_within)
    return scales.select(*keys, F.coalesce(within, F.col("between") * of_between).alias("near"))


def normalized(value: Column, scale: Column) -> Column:
    """`value` over `scale`; null for a scale that is missing or not positive."""
    return value / F.when(scale > 0, scale)


def set_geometry(left: DataFrame, right: DataFrame, distances: DataFrame, keys: list[str], k: int, group: list[str] | None = None) -> DataFrame:
    """How far two sets of `k` templates lie apart: the best one-to-one match (`match_mean`, `match_max`), `hausdorff`, `nearest_mean`.

    `left`, `right`: `keys`, `slot` 0..k-1, `candidate`; `distances`: `group` (by default `keys`), `segment_id`,
    `candidate`, `distance`. With `group`, several sets of one group, such as trials, share its distances.
    `mapping` gives the right slot of each left slot; of equal matches the first in order of slots. The
    match is the least over all k! orders, which k of at most 5 keeps small. Groups lacking a distance have no row.
    """
    if not 1 <= k <= 5:
        raise ValueError("k must lie between 1 and 5")
    a = left.select(*keys, F.col("slot").alias("i"), F.col("candidate").alias("segment_id"))
    b = right.select(*keys, F.col("slot").alias("j"), "candidate")
    group = keys if group is None else group
    met = a.join(b, keys).join(distances.select(*group, "segment_id", "candidate", "distance"), [*group, "segment_id", "candidate"])
    cells = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "j", "distance"))).alias("m")).where(F.size("m") == k * k)
    d = lambda i, j: F.col("m")[i * k + j]["distance"]
    orders = [F.struct(F.round(reduce(lambda x, y: x + y, [d(i, p[i]) for i in range(k)]), 12).alias("t"), F.array(*map(F.lit, p)).alias("p")) for p in permutations(range(k))]
    best = F.array_min(F.array(*orders))["p"]
    chosen = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get("m", i * k + F.get(best, i))["distance"])
    rows = [reduce(F.least, [d(i, j) for j in range(k)]) if k > 1 else d(i, 0) for i in range(k)]
    columns = [reduce(F.least, [d(i, j) for i in range(k)]) if k > 1 else d(0, j) for j in range(k)]
    total = lambda xs: reduce(lambda x, y: x + y, xs)
    return cells.select(
        *keys, best.alias("mapping"), (F.aggregate(chosen, F.lit(0.0), lambda t, x: t + x) / k).alias("match_mean"), F.array_max(chosen).alias("match_max"),
        F.array_max(F.array(*rows, *columns)).alias("hausdorff"), ((total(rows) + total(columns)) / (2 * k)).alias("nearest_mean"),
    )


def adjusted_rand(labels: DataFrame, keys: list[str], left: str = "left", right: str = "right") -> DataFrame:
    """`keys`, `n`, `ari` of two labelings of the same members; 1 where both are trivial."""
    pairs = lambda n: n * (n - 1) / 2
    cells = labels.groupBy(*keys, left, right).agg(F.count("*").alias("n"))
    both = cells.groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("c"), F.sum("n").alias("n"))
    side = lambda c, name: cells.groupBy(*keys, c).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias(name))
    met = both.join(side(left, "a"), keys).join(side(right, "b"), keys)
    expected = F.when(F.col("n") > 1, F.col("a") * F.col("b") / pairs(F.col("n"))).otherwise(F.lit(0.0))
    room = (F.col("a") + F.col("b")) / 2 - expected
    return met.select(*keys, "n", F.when(F.abs(room) < 1e-12, 1.0).otherwise((F.col("c") - expected) / F.when(F.abs(room) >= 1e-12, room)).alias("ari"))


def set_overlap(left: Column, right: Column) -> Column:
    """The Jaccard index of two arrays; 1 for two empty ones."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(left, right)) / F.when(union > 0, union))


def near_overlap(left: DataFrame, right: DataFrame, distances: DataFrame, keys: list[str], limit: Column) -> DataFrame:
    """`keys`, `near_overlap`: the mean of both sets' shares of templates that have one of the other set within `limit`."""
    d = distances.select(*keys, "segment_id", "candidate", "distance")

    def share(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        met = a.select(*keys, F.col("candidate").alias("segment_id")).join(d, [*keys, "segment_id"]).join(b.select(*keys, "candidate"), [*keys, "candidate"])
        near = met.groupBy(*keys, "segment_id").agg(F.min("distance").alias("distance"))
        return near.groupBy(*keys).agg(F.avg((F.col("distance") <= limit).cast("double")).alias(name))

    return share(left, right, "_l").join(share(right, left, "_r"), keys).select(*keys, ((F.col("_l") + F.col("_r")) / 2).alias("near_overlap"))
