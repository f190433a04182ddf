"""References of groups: usable pairs, centrality, medoids, diverse top-k sets, catalogs.

Pairs come as `groups`, `segment_id_a`, `segment_id_b`, `distance`. All groups are worked on at once;
none is gathered: each pick of the diverse set is one more round of joins over all groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespan.functions.labels import references_for
from kinespan.workspace import written

#: The percentiles of a group's distances that a further reference must be away, tried in turn.
DIVERSITY = (("p25", 0.25), ("p20", 0.20), ("p10", 0.10))


def usable(distance: Column) -> Column:
    """True for a distance that is a finite, non-negative number."""
    return F.coalesce((distance >= 0) & (distance < F.lit(float("inf"))) & ~F.isnan(distance), F.lit(False))


def usable_pairs(stored: DataFrame, groups: list[str], order: str = "computed_at") -> DataFrame:
    """One row per unordered pair of different segments with a usable distance: of pairs stored more than once the latest.

    Of the latest the greatest distance; rows without a time come before all others. Ids are trimmed.
    """
    a, b = F.trim("segment_id_a"), F.trim("segment_id_b")
    rows = stored.where(usable(F.col("distance")) & a.isNotNull() & b.isNotNull() & (a != b))
    keyed = rows.select(*groups, F.least(a, b).alias("segment_id_a"), F.greatest(a, b).alias("segment_id_b"), "distance", F.col(order).alias("_at"))
    return keyed.groupBy(*groups, "segment_id_a", "segment_id_b").agg(F.max_by("distance", F.struct("_at", "distance")).alias("distance"))


def both_ways(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """`groups`, `segment_id`, `other`, `distance`: every pair in either direction."""
    ends = F.array(F.struct(F.col("segment_id_a").alias("s"), F.col("segment_id_b").alias("o")), F.struct(F.col("segment_id_b").alias("s"), F.col("segment_id_a").alias("o")))
    return pairs.select(*groups, F.explode(ends).alias("e"), "distance").select(*groups, F.col("e.s").alias("segment_id"), F.col("e.o").alias("other"), "distance")


def centrality(pairs: DataFrame, groups: list[str]) -> DataFrame:
    """`groups`, `segment_id`, `mean_distance`, `n_pairs` over each segment's pairs."""
    return both_ways(pairs, groups).groupBy(*groups, "segment_id").agg(F.avg("distance").alias("mean_distance"), F.count("*").alias("n_pairs"))


def medoids(central: DataFrame, groups: list[str]) -> DataFrame:
    """`groups`, `medoid_segment_id`, `mean_distance`: the least mean, on a tie the first id. Means are compared at 9 decimals."""
    key = F.struct(F.round("mean_distance", 9).alias("m"), F.col("segment_id").alias("s"))
    best = central.groupBy(*groups).agg(F.min(F.struct(key.alias("k"), "mean_distance")).alias("b"))
    return best.select(*groups, F.col("b.k.s").alias("medoid_segment_id"), F.col("b.mean_distance").alias("mean_distance"))


def distance_quantiles(pairs: DataFrame, groups: list[str], shares: tuple[float, ...] = (0.25, 0.20, 0.10)) -> DataFrame:
    """`groups` and `q{share}` of the group's distances, exact with linear interpolation."""
    found = pairs.groupBy(*groups).agg(F.percentile("distance", F.array(*map(F.lit, shares))).alias("q"))
    return found.select(*groups, *[F.col("q")[i].alias(f"q{round(s * 100)}") for i, s in enumerate(shares)])


def diverse_references(pairs: DataFrame, children: DataFrame, groups: list[str], most: int = 4) -> DataFrame:
    """Up to `most` references of each group: the medoid, then central segments of other children that are far enough away.

    `children`: `segment_id`, `child`, one row each; a segment without a row is a child of its own.
    How many are asked for depends on the group's children. In each round the candidates are segments
    of children not chosen yet; those whose least distance to the chosen is at least the group's 25th
    percentile of distances come first, else the 20th's, else the 10th's; of these the most central is
    taken. A group ends when no candidate is left. Distances and means are compared at 9 decimals. Columns: `groups`, `segment_id`, `rank`, `child`,
    `mean_distance`, `k_requested`, `threshold_used`, `n_group_clips`, `n_group_children`.
    """
    pairs = written(pairs, "pairs")
    central = centrality(pairs, groups).withColumn("mean_distance", F.round("mean_distance", 9))
    child = F.coalesce("child", F.concat(F.lit("desconocido::"), F.col("segment_id")))
    pool = central.join(children.select("segment_id", "child"), "segment_id", "left").withColumn("child", child).drop("n_pairs")
    pool = written(pool, "candidates")
    sizes = pool.groupBy(*groups).agg(F.count("*").alias("n_group_clips"), F.count_distinct("child").alias("n_group_children"))
    sizes = written(sizes.withColumn("k_requested", F.least(references_for(F.col("n_group_children")), F.lit(most))).join(distance_quantiles(pairs, groups), groups), "sizes")
    links = both_ways(pairs, groups)
    order = F.struct(F.col("mean_distance").alias("m"), F.col("segment_id").alias("s"), F.col("child").alias("c"))
    picked = pool.groupBy(*groups).agg(F.min(order).alias("p")).select(*groups, "p.*", F.lit(1).alias("rank"), F.lit("primaria").alias("threshold_used"))
    picked = written(picked, "picked")
    rounds = [picked]
    for rank in range(2, most + 1):
        chosen = reduce(DataFrame.unionByName, rounds)
        open_ = pool.join(sizes.where(F.col("k_requested") >= rank), groups)
        # a group goes on only if its last round found one
        open_ = open_.join(rounds[-1].select(*groups), groups, "left_semi")
        open_ = open_.join(chosen.select(*groups, F.col("c").alias("child")), [*groups, "child"], "left_anti")
        away = links.join(chosen.select(*groups, F.col("s").alias("other")), [*groups, "other"]).groupBy(*groups, "segment_id").agg(F.min("distance").alias("away"))
        met = open_.join(away, [*groups, "segment_id"])
        level = F.lit(None).cast("string")
        step = F.lit(None).cast("int")
        for i, (name, share) in reversed(list(enumerate(DIVERSITY))):
            far = F.round("away", 9) >= F.round(f"q{round(share * 100)}", 9)
            level, step = F.when(far, name).otherwise(level), F.when(far, i).otherwise(step)
        best = met.withColumn("_step", step).withColumn("_name", level).where("_step IS NOT NULL")
        best = best.groupBy(*groups).agg(F.min(F.struct("_step", order.alias("o"), "_name")).alias("p"))
        rounds.append(written(best.select(*groups, "p.o.*", F.lit(rank).alias("rank"), F.col("p._name").alias("threshold_used")), "picked"))
    found = reduce(DataFrame.unionByName, rounds).join(sizes, groups)
    return found.select(
        *groups, F.col("s").alias("segment_id"), "rank", F.col("c").alias("child"), F.col("m").alias("mean_distance"),
        "k_requested", "threshold_used", "n_group_clips", "n_group_children",
    )


def primaries(references: DataFrame, groups: list[str]) -> DataFrame:
    """The references of rank 1, as `groups`, `medoid_segment_id`."""
    return references.where("rank = 1").select(*groups, F.col("segment_id").alias("medoid_segment_id"))


def catalog_sizes(references: DataFrame, groups: list[str]) -> DataFrame:
    """`n_references`, `n_groups`: how many groups have how many references."""
    return references.groupBy(*groups).agg(F.count("*").alias("n_references")).groupBy("n_references").agg(F.count("*").alias("n_groups"))


def catalog_differences(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` and `side` (`left` or `right`) of rows, each once, that only one catalog has."""
    a, b = left.select(*columns).distinct(), right.select(*columns).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def matrix_violations(stored: DataFrame, groups: list[str], expected: DataFrame | None = None) -> DataFrame:
    """`groups`, `violation`, `n`: what keeps stored pairs from being a full matrix.

    `diagonal` (a segment with itself), `missing_id`, `not_finite`, `negative`, `duplicate_pair` (an
    unordered pair stored again), and with `expected` (`groups`, `n_clips`) `incomplete`: the
    number of different pairs that n_clips lacks or exceeds.
    """
    a, b, d = F.col("segment_id_a"), F.col("segment_id_b"), F.col("distance")
    none = a.isNull() | b.isNull()
    by = stored.groupBy(*groups, F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).agg(
        F.count("*").alias("n"), F.first(none).alias("_none"), F.first(F.coalesce(a == b, F.lit(False))).alias("_same"),
        F.count_if(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))).alias("not_finite"),
        F.count_if((d < 0) & ~F.isnan(d) & (d > float("-inf"))).alias("negative"),
    )
    sums = by.groupBy(*groups).agg(
        F.sum(F.when(F.col("_same") & ~F.col("_none"), F.col("n"))).alias("diagonal"), F.sum(F.when(F.col("_none"), F.col("n"))).alias("missing_id"),
        F.sum("not_finite").alias("not_finite"), F.sum("negative").alias("negative"),
        F.sum(F.when(~F.col("_same") & ~F.col("_none"), F.col("n") - 1)).alias("duplicate_pair"),
        F.count_if(~F.col("_same") & ~F.col("_none")).alias("_pairs"),
    )
    names = ["diagonal", "missing_id", "not_finite", "negative", "duplicate_pair"]
    if expected is not None:
        whole = (F.col("n_clips") * (F.col("n_clips") - 1) / 2).cast("long")
        sums = sums.join(expected.select(*groups, "n_clips"), groups, "left").withColumn("incomplete", F.abs(whole - F.col("_pairs")))
        names.append("incomplete")
    long = sums.unpivot(groups, names, "violation", "n")
    return long.where("n > 0")
