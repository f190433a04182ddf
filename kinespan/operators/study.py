"""What a resampling study says: curves over sample sizes, choices of k and n, associations, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespan.operators.resampling import mode_text
from kinespan.workspace import written

#: The thresholds by which k is chosen.
K_RULES = {"support": 0.8, "gain": 0.05, "gain_from_4": 0.10, "p90_worsening": 0.02, "geometry": 0.25, "ari": 0.5}
#: The thresholds by which a sample size counts as stable.
N_RULES = {
    "excess_median": 0.05, "excess_p90": 0.10, "geometry_median": 0.10, "geometry_p90": 0.20, "agreement": 0.8, "ari": 0.5, "support": 0.8,
    "marginal": 0.01, "deterioration": 0.02,
}
LATER_SIZES = 2
QUANTILES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def spread(c: Column, name: str) -> list[Column]:
    """Mean, standard deviation (0 for one value), standard error and six quantiles of the non-null values."""
    sd = F.coalesce(F.stddev_samp(c), F.when(F.count(c) > 0, 0.0))
    return [
        F.avg(c).alias(f"{name}_mean"), sd.alias(f"{name}_sd"), (sd / F.sqrt(F.count(c))).alias(f"{name}_se"),
        *[F.percentile(c, F.lit(q)).alias(f"{name}_{n}") for n, q in QUANTILES.items()],
    ]


def curves(trials: DataFrame, by: list[str], numbers: list[str], flags: list[str], set_id: str) -> DataFrame:
    """Per `by` (group, scheme, n, k, ...): repetitions, nine statistics of each of `numbers`, the rate of each of
    `flags`, and of the sets `set_id` the number of different ones, the share of the most frequent and the entropy.

    One shuffle by the curve's point; the sets are counted beside it.
    """
    wide = trials.groupBy(*by).agg(
        F.count("*").alias("repetitions"), *[c for n in numbers for c in spread(F.col(n), n)], *[F.avg(F.col(f).cast("double")).alias(f"{f}_rate") for f in flags]
    )
    sets = trials.groupBy(*by, set_id).agg(F.count("*").alias("c"))
    total = F.sum("c")
    shares = sets.groupBy(*by).agg(
        F.count("*").alias("n_sets"), (F.max("c") / total).alias("mode_share"),
        (F.log(total) - F.sum(F.col("c") * F.log("c")) / total).alias("set_entropy"),
    )
    return wide.join(shares, by)


def selection_frequency(trials: DataFrame, by: list[str], clips: DataFrame, keys: list[str]) -> DataFrame:
    """`by`, `segment_id`, `n_selected`, `frequency`: how often each clip of the group is in a set; clips never chosen have 0."""
    points = trials.groupBy(*by).agg(F.count("*").alias("n"))
    chosen = trials.select(*by, F.explode("ids").alias("segment_id")).groupBy(*by, "segment_id").agg(F.count("*").alias("c"))
    met = points.join(clips.select(*keys, "segment_id").distinct(), keys).join(chosen, [*by, "segment_id"], "left")
    n = F.coalesce("c", F.lit(0)).cast("long")
    return met.select(*by, "segment_id", n.alias("n_selected"), (n / F.col("n")).alias("frequency"))


def choose_k(curve: DataFrame, keys: list[str], cap: int, rules: dict[str, float] = K_RULES) -> DataFrame:
    """`keys`, `selected_k`, `reason`, `strict`: the number of templates up to `cap` that each group's curve supports.

    `curve`: `keys`, `k`, `support_rate`, `dominant` (true where a covariate explains the solution),
    `loss_mean`, `loss_se`, `gain_median`, `p90_mean`, `geometry_median`, `ari_median`. Of the supported,
    not dominated k those within a standard error of the best count; the least that also gains enough,
    does not worsen the 90th percentile and is stable is `strict`; else the least within the error, else
    the least supported, else 1. Missing statistics fail their test.
    """
    by_k = Window.partitionBy(*keys).orderBy("k")
    whole = Window.partitionBy(*keys)
    ok = lambda c: F.coalesce(c, F.lit(False))
    base = ok((F.col("support_rate") >= rules["support"]) & ~F.coalesce("dominant", F.lit(False)))
    before = F.when(F.lag("k").over(by_k) == F.col("k") - 1, F.lag("p90_mean").over(by_k))
    worse = F.coalesce((F.col("p90_mean") - before) / F.greatest(before, F.lit(1e-12)), F.when(before.isNull(), 0.0))
    work = curve.where(F.col("k") <= cap).withColumn("base", base).withColumn("worse", worse)
    best = F.min(F.when(F.col("base"), F.struct("loss_mean", "k", "loss_se"))).over(whole)
    work = work.withColumn("limit", best["loss_mean"] + best["loss_se"]).withColumn("near", ok(F.col("loss_mean") <= F.col("limit")))
    gain = F.when(F.col("k") >= 4, F.lit(rules["gain_from_4"])).otherwise(rules["gain"])
    strict = (
        F.col("base") & F.col("near") & ((F.col("k") == 1) | ok(F.col("gain_median") >= gain)) & ok(F.col("worse") <= rules["p90_worsening"])
        & ok(F.col("geometry_median") <= rules["geometry"]) & ((F.col("k") == 1) | ok(F.col("ari_median") >= rules["ari"]))
    )
    least = lambda c: F.min(F.when(c, F.col("k")))
    found = work.groupBy(*keys).agg(least(strict).alias("s"), least(F.col("base") & F.col("near")).alias("f"), least(F.col("base")).alias("b"))
    reason = (
        F.when(F.col("s").isNotNull(), "smallest_k_within_1se_gain_support_geometry_assignments").when(F.col("f").isNotNull(), "smallest_k_within_1se_support_fallback")
        .when(F.col("b").isNotNull(), "smallest_support_eligible_k_fallback").otherwise("fallback_k1_no_support_eligible_solution")
    )
    return found.select(*keys, F.coalesce("s", "f", "b", F.lit(1)).alias("selected_k"), reason.alias("reason"), F.col("s").isNotNull().alias("strict"))


#: What a group's number of templates is called.
K_STATUS = {1: "single_template_sufficient", 2: "two_templates_preferred", 3: "three_templates_preferred", 4: "four_templates_preferred", 5: "five_templates_preferred"}


def select_k(curve: DataFrame, keys: list[str], rules: dict[str, float] = K_RULES) -> DataFrame:
    """`keys`, `selected_k`, `selected_k_cap3`, `selected_k_cap5`, `strict`, `reason`, `status` and the statistics of the chosen k.

    Up to three templates are chosen; more only where a cap of five finds a strict choice above three. `curve` as for `choose_k`.
    """
    of = lambda cap: choose_k(curve, keys, cap, rules).select(*keys, *[F.col(c).alias(f"_{c}{cap}") for c in ("selected_k", "reason", "strict")])
    met = of(3).join(of(5), keys)
    more = (F.col("_selected_k5") > 3) & F.col("_strict5")
    pick = lambda c: F.when(more, F.col(f"_{c}5")).otherwise(F.col(f"_{c}3"))
    reason = F.when(more, F.concat(F.lit("research_extension_above_cap3:"), "_reason5")).otherwise(F.concat(F.lit("operational_cap3:"), "_reason3"))
    chosen = met.select(*keys, pick("selected_k").alias("selected_k"), F.col("_selected_k3").alias("selected_k_cap3"), F.col("_selected_k5").alias("selected_k_cap5"), pick("strict").alias("strict"), reason.alias("reason"))
    row = curve.select(*keys, F.col("k").alias("selected_k"), "support_rate", "loss_mean", "loss_se", "p90_mean", "geometry_median", "ari_median")
    names = F.create_map(*[F.lit(x) for pair in K_STATUS.items() for x in pair])
    status = (
        F.when(~F.coalesce(F.col("support_rate") >= rules["support"], F.lit(False)), "insufficient_support").when(~F.col("strict") & (F.col("selected_k") > 1), "high_heterogeneity_no_stable_k")
        .otherwise(F.try_element_at(names, F.col("selected_k")))
    )
    return chosen.join(row, [*keys, "selected_k"], "left").withColumn("status", status)


def k_policies(curve: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, `policy`, `selected_k` and its loss: one template, the caps of three and five, and the choice of `select_k`."""
    policies = [("fixed_k1", F.lit(1)), ("cap_k3", F.col("selected_k_cap3")), ("cap_k5", F.col("selected_k_cap5")), ("adaptive_operational", F.col("selected_k"))]
    each = selected.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), k.alias("selected_k")) for n, k in policies])).alias("p")).select(*keys, "p.*")
    return each.join(curve.select(*keys, F.col("k").alias("selected_k"), "loss_mean", "loss_se", "p90_mean", "support_rate"), [*keys, "selected_k"])


def one_se_n(curve: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, `n_1se`: the least size under the maximum whose loss is within a standard error of the best of them."""
    under = curve.where("n_children < maximum")
    best = F.min(F.struct("loss_mean", "n_children", "loss_se")).over(Window.partitionBy(*keys))
    near = under.withColumn("_b", best).where("loss_mean <= _b.loss_mean + _b.loss_se")
    return near.groupBy(*keys).agg(F.min("n_children").alias("n_1se"))


def persistent_n(curve: DataFrame, keys: list[str], rules: dict[str, float] = N_RULES, later: int = LATER_SIZES) -> DataFrame:
    """`keys`, `n_equivalence`: the least size under the maximum that passes all tests, as do the next `later` sizes,
    and after which the loss never rises by more than `deterioration`. Missing statistics fail; groups without one have no row.

    `curve`: `keys`, `n_children`, `maximum`, `excess_median`, `excess_p90`, `geometry_median`,
    `geometry_p90`, `agreement_median`, `ari_median`, `support_rate`, `marginal`, `loss_mean`.
    """
    w = Window.partitionBy(*keys).orderBy("n_children")
    passed = (
        (F.col("excess_median") <= rules["excess_median"]) & (F.col("excess_p90") <= rules["excess_p90"]) & (F.col("geometry_median") <= rules["geometry_median"])
        & (F.col("geometry_p90") <= rules["geometry_p90"]) & (F.col("agreement_median") >= rules["agreement"]) & (F.col("ari_median") >= rules["ari"])
        & (F.col("support_rate") >= rules["support"]) & (F.col("marginal") <= rules["marginal"])
    )
    ahead = w.rowsBetween(0, later)
    work = curve.where("n_children < maximum").withColumn("_p", F.coalesce(passed, F.lit(False)).cast("int"))
    work = work.withColumns({
        "_all": F.min("_p").over(ahead), "_n": F.count("*").over(ahead), "_later": F.max("loss_mean").over(w.rowsBetween(1, Window.unboundedFollowing)),
    })
    stable = (F.col("_all") == 1) & (F.col("_n") == later + 1) & (F.col("_later").isNull() | (F.col("_later") - F.col("loss_mean") <= rules["deterioration"]))
    return work.where(stable).groupBy(*keys).agg(F.min("n_children").alias("n_equivalence"))


def select_n(curve: DataFrame, keys: list[str], rules: dict[str, float] = N_RULES, later: int = LATER_SIZES) -> DataFrame:
    """Per group `status`, `n_equivalence`, `n_1se`, `n_recommended`, bounds, and the size that allows for 15 and 20 % loss."""
    under = F.col("n_children") < F.col("maximum")
    sizes = curve.groupBy(*keys).agg(
        F.count_if(under).alias("_n"), F.max(F.when(under, F.col("support_rate"))).alias("_support"), F.max(F.when(under, F.col("n_children"))).alias("_top"), F.max("maximum").alias("maximum")
    )
    met = sizes.join(persistent_n(curve, keys, rules, later), keys, "left").join(one_se_n(curve, keys), keys, "left")
    status = (
        F.when(F.col("_n") < later + 1, "insufficient_children_for_stability_estimation").when(F.col("_support") < rules["support"], "insufficient_support")
        .when(F.col("n_equivalence").isNull(), "not_stabilized_below_available_maximum").otherwise("stabilized_below_available_maximum")
    )
    met = met.withColumn("status", status).withColumn("n_recommended", F.when(F.col("status") == "stabilized_below_available_maximum", F.greatest("n_equivalence", "n_1se")))
    inflated = lambda share: F.ceil(F.round(F.col("n_recommended") / share, 9)).cast("int")
    return met.select(
        *keys, "maximum", "n_equivalence", "n_1se", "n_recommended", F.least("n_equivalence", "n_1se").alias("n_lower"), F.coalesce("n_recommended", "_top").alias("n_upper"),
        inflated(0.85).alias("n_for_15pct_loss"), inflated(0.80).alias("n_for_20pct_loss"), "status",
    )


def sample_size_summary(selected: DataFrame, action: str, age: str, n: str, ages: list[str]) -> DataFrame:
    """`scope` (global, action, age), `action`, `age`, groups, those with a size, and six quantiles of the size, by grouping sets.

    Every one of `ages` has a row, empty ones too.
    """
    both = F.grouping_id()
    quantiles = F.percentile(F.col(n), F.array(*map(F.lit, (0.0, 0.5, 0.75, 0.8, 0.9, 1.0))))
    sets = selected.groupingSets([[], [F.col(action)], [F.col(age)]], action, age).agg(both.alias("g"), F.count("*").alias("n_groups"), F.count(n).alias("n_with_size"), quantiles.alias("q"))
    scope = F.when(F.col("g") == 3, "global").when(F.col("g") == 1, "action").otherwise("age")
    found = sets.select(scope.alias("scope"), F.col(action).alias("action"), F.col(age).alias("age"), "n_groups", "n_with_size", *[F.col("q")[i].alias(f"q{p}") for i, p in enumerate((0, 50, 75, 80, 90, 100))])
    empty = selected.sparkSession.createDataFrame([(a,) for a in ages], "age string").join(found.where("scope = 'age'").select("age"), "age", "left_anti")
    nothing = empty.select(F.lit("age").alias("scope"), F.lit(None).cast("string").alias("action"), "age", F.lit(0).cast("long").alias("n_groups"), F.lit(0).cast("long").alias("n_with_size"), *[F.lit(None).cast("double").alias(f"q{p}") for p in (0, 50, 75, 80, 90, 100)])
    return found.unionByName(nothing)


def child_covariates(executions: DataFrame, keys: list[str], categories: list[str], numbers: list[str]) -> DataFrame:
    """Per group and child: executions, the most frequent value of each of `categories` (`<missing>` for none), the median of each of `numbers`."""
    return executions.groupBy(*keys, "child").agg(
        F.count("*").alias("repeat_count"), *[mode_text(F.col(c)).alias(c) for c in categories], *[F.percentile(F.col(n), F.lit(0.5)).alias(n) for n in numbers]
    )


def eta_squared(rows: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """`keys`, `eta_squared`: the share of the value's variation that lies between labels; 0 with under 3 values, one label or no variation.

    From sums per label, in one pass: no row is joined with its mean.
    """
    x = F.col(value).cast("double")
    per = rows.where(F.col(value).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    whole = per.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.count("*").alias("labels"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("inside")
    )
    between = per.join(whole.select(*keys, "mean"), keys).groupBy(*keys).agg(F.sum(F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("between"))
    met = whole.join(between, keys)
    total = F.col("between") + F.col("inside")
    return met.select(*keys, F.when((F.col("n") < 3) | (F.col("labels") < 2) | (total <= 0), 0.0).otherwise(F.col("between") / F.when(total > 0, total)).alias("eta_squared"))


def mutual_information(labels: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """`keys`, `nmi` of two labelings over the arithmetic mean of their entropies; 1 if both have one class, 0 without information."""
    return _information(labels.groupBy(*keys, left, right).agg(F.count("*").alias("n")), keys, left, right)


def _information(cells: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """`mutual_information` of labelings whose pairs of labels are counted in `n`."""
    spread_ = lambda c, name: cells.groupBy(*keys, c).agg(F.sum("n").alias("n")).groupBy(*keys).agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias(name))
    joint = cells.groupBy(*keys).agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("h"))
    met = joint.join(spread_(left, "a"), keys).join(spread_(right, "b"), keys)
    mean = (F.col("a") + F.col("b")) / 2
    return met.select(*keys, F.when(mean < 1e-12, 1.0).otherwise(F.greatest((F.col("a") + F.col("b") - F.col("h")) / F.when(mean >= 1e-12, mean), F.lit(0.0))).alias("nmi"))


def permutation_test(labels: DataFrame, keys: list[str], left: str, right: str, member: str, permutations: int = 200, seed: int = 700) -> DataFrame:
    """`keys`, `effect` (normalized mutual information), `p_value` = (1 + permutations at least as strong) / (permutations + 1).

    A permutation deals the group's `right` labels out again in the order of a seeded hash of the
    members; all permutations of all groups are counted in one aggregation. Groups with one `left` label have effect 0 and p 1.
    The members' places and the counted labels are written, so that the rows are dealt once.
    """
    placed = written(labels.select(*keys, member, left, right).withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(member))), "placed")
    place = F.when(F.col("_p") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), "_p", *keys, member))
    each = placed.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(permutations)))).select(*keys, "_p", "_at", F.col(right).alias("_right"), place.alias("_place"))
    given = each.select(*keys, "_p", "_right", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy("_place", "_at")).alias("_at"))
    met = given.join(placed.select(*keys, "_at", left), [*keys, "_at"])
    cells = written(met.groupBy(*keys, "_p", left, "_right").agg(F.count("*").alias("n")), "cells")
    strength = written(_information(cells, [*keys, "_p"], left, "_right"), "strength")
    own = strength.where("_p = 0").select(*keys, F.col("nmi").alias("effect"))
    strong = strength.where("_p > 0").join(own, keys).groupBy(*keys, "effect").agg(((F.count_if(F.col("nmi") >= F.col("effect") - 1e-12) + 1) / F.lit(permutations + 1)).alias("p_value"))
    several = cells.where("_p = 0").groupBy(*keys).agg((F.count_distinct(left) > 1).alias("_several"))
    return strong.join(several, keys).select(*keys, F.when(F.col("_several"), F.col("effect")).otherwise(0.0).alias("effect"), F.when(F.col("_several"), F.col("p_value")).otherwise(1.0).alias("p_value"))


def confounders(assigned: DataFrame, covariates: DataFrame, keys: list[str], categories: list[str], numbers: list[str], permutations: int = 200, effect: float = 0.5, p: float = 0.05) -> DataFrame:
    """Per group and covariate `effect`, `p_value`, `dominant`: does it go with the children's templates?

    Categories by normalized mutual information with its permutation test, `dominant` if the effect is at
    least `effect` and p at most `p`. Numbers by the share of variation between templates, without a test and
    never dominant. Children without the covariate do not count; all covariates are worked on in one job each kind.
    """
    met = assigned.select(*keys, "child", F.col("slot").cast("string").alias("slot")).join(covariates, [*keys, "child"])
    texts = met.unpivot([*keys, "child", "slot"], [F.col(c).cast("string").alias(c) for c in categories], "variable", "v").where("v IS NOT NULL AND v <> '<missing>'")
    tested = permutation_test(texts, [*keys, "variable"], "v", "slot", "child", permutations)
    values = met.unpivot([*keys, "child", "slot"], [F.col(c).cast("double").alias(c) for c in numbers], "variable", "v").where("v IS NOT NULL")
    shares = eta_squared(values, [*keys, "variable"], "slot", "v").select(*keys, "variable", F.col("eta_squared").alias("effect"), F.lit(None).cast("double").alias("p_value"))
    found = tested.unionByName(shares)
    return found.withColumn("dominant", F.coalesce((F.col("effect") >= effect) & (F.col("p_value") <= p), F.lit(False)))


def stability_bands(curve: DataFrame, selected: DataFrame, keys: list[str], numbers: list[str], left_out: list[str], age: str = "age") -> DataFrame:
    """`n_children`, `n_groups` and, of each of `numbers`, the quartiles over groups, at each group's selected k and under its largest size.

    Groups of an age in `left_out` do not count.
    """
    met = curve.join(selected.select(*keys, F.col("selected_k").alias("k")), [*keys, "k"]).where(~F.col(age).isin(left_out) & (F.col("n_children") < F.col("maximum")))
    quartile = lambda c, q: F.percentile(F.col(c), F.lit(q))
    bands = [quartile(c, q).alias(f"{c}_{n}") for c in numbers for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return met.groupBy("n_children").agg(F.count_distinct(*keys).alias("n_groups"), *bands)
