"""Queries of the resampling study and of reports.

`study_trials` solves trials on the stored matrices; curves, choices of k and n and the final templates
(`study_trial_...`, `study_template_catalog`) are made of them. The arithmetic of these steps is checked
against SQL on a table of trials derived from `lineitem`, so that both engines see the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespan.functions.labels import BLANKS
from kinespan.operators import checks, packed_trials, reporting, resampling, study
from kinespan.operators.comparison import AGE_GROUPS
from kinespan.operators.references import usable, usable_pairs
from kinespan.plans import views
from kinespan.plans.groups import _shown, _up
from kinespan.plans.templates import _distances
from kinespan.plans.views import CHILDREN_SQL, PAIRS_SQL, TOPK_SQL, executions_sql
from kinespan.sources.tables import table
from kinespan.workspace import spread, written

PART = ["part"]
GROUP = ["action", "age"]
#: Repetitions of the registered study; sizes, numbers of templates and starts are those of the full one.
REPETITIONS, KS = 10, [1, 2, 3, 4, 5]
#: What curves are made of.
METRICS = [
    "holdout_loss", "holdout_loss_median", "holdout_p90", "holdout_clip_loss", "excess_normalized", "match_mean_between", "match_mean_within", "agreement", "ari", "cluster_jaccard_mean",
    "partner_match_mean_between", "partner_ari", "partner_agreement", "reduction_vs_k1", "gain_vs_previous_k", "gain_per_child_normalized", "ambiguous", "consistency",
]
POINT = ["part", "scheme", "n_children", "maximum", "k"]


def _children(spark: SparkSession, folder: str) -> DataFrame:
    ends = views.pairs(spark, folder).select("part", F.explode(F.array("segment_id_a", "segment_id_b")).alias("segment_id")).distinct()
    return ends.join(views.training_children(spark, folder), "segment_id", "left").select("part", F.coalesce("child", F.concat(F.lit("desconocido::"), F.col("segment_id"))).alias("child"))


def resampling_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """How many children the nested sets of every matrix, scheme and size have, over all repetitions."""
    sets = resampling.nested_sets(resampling.plan(_children(spark, folder), PART, REPETITIONS), PART)
    return sets.groupBy("part", "scheme", "n_children", "maximum").agg(F.count("*").alias("n_rows"))


def _matrices(spark: SparkSession, folder: str) -> DataFrame:
    """The stored matrices as tasks read them (`packed_trials.matrix_rows`), whole and with every clip: each pair once, each clip with its child."""
    stored = table(spark, folder, "dtw_pairwise").where("part IS NOT NULL")
    n = stored.select(*PART).distinct().count()
    pairs = usable_pairs(spread(stored, PART, n), PART).select("part", F.col("segment_id_a").alias("a"), F.col("segment_id_b").alias("b"), "distance")
    a, b = F.trim("segment_id_a"), F.trim("segment_id_b")
    ends = stored.where(usable(F.col("distance")) & (a != b)).select("part", F.explode(F.array(a, b)).alias("segment_id")).distinct()
    clips = ends.join(views.training_children(spark, folder), "segment_id", "left")
    clips = clips.withColumn("child", F.coalesce("child", F.concat(F.lit("desconocido::"), F.col("segment_id"))))
    found = pairs.unionByName(packed_trials.named_clips(clips, PART))
    found._n_matrices = n  # so that the pairs are not read again to count them
    return found


def _curve(spark: SparkSession, folder: str, numbers: list[str] = METRICS, only: str | None = None, largest: bool = False) -> DataFrame:
    """Curves of the trials of every matrix, of any size: all, of `only` one scheme, or of each matrix's `largest` size alone. What a query does not read is not solved. Not written yet."""
    return packed_trials.curves(_matrices(spark, folder), PART, numbers, KS, [] if largest else resampling.GRID, REPETITIONS, only=only)


def study_trials(spark: SparkSession, folder: str) -> DataFrame:
    """Solved trials of every matrix, each against that with most children and that of the next repetition."""
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), "|").alias(c)
    found = packed_trials.trials(_matrices(spark, folder), PART, KS, resampling.GRID, REPETITIONS)
    return found.select(*[joined(c) if t.startswith("array") else F.col(c) for c, t in found.dtypes])


def study_trial_curves(spark: SparkSession, folder: str) -> DataFrame:
    """Eighteen statistics of the solved trials by scheme, size and number of templates, each with mean, spread and quantiles."""
    return _curve(spark, folder)


#: The trials and numbers that `_k_curve` reads.
_OF_K = {"only": "primary_h3", "largest": True, "numbers": ["holdout_loss", "gain_vs_previous_k", "holdout_p90", "partner_match_mean_between", "partner_ari"]}


def _k_curve(curve: DataFrame) -> DataFrame:
    """What `select_k` reads, at each matrix's largest size; covariates do not enter here."""
    return curve.where("scheme = 'primary_h3' AND n_children = maximum").select(
        "part", "k", F.col("support_ok_rate").alias("support_rate"), F.lit(None).cast("boolean").alias("dominant"), F.col("holdout_loss_mean").alias("loss_mean"), F.col("holdout_loss_se").alias("loss_se"),
        F.col("gain_vs_previous_k_median").alias("gain_median"), F.col("holdout_p90_mean").alias("p90_mean"), F.col("partner_match_mean_between_median").alias("geometry_median"),
        F.col("partner_ari_median").alias("ari_median"),
    )


def _chosen_k(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The curve of k of every matrix, written, and the number of templates chosen by it."""
    curve = written(_k_curve(_curve(spark, folder, **_OF_K)), "curve")
    return curve, study.select_k(curve, PART)


def study_trial_k(spark: SparkSession, folder: str) -> DataFrame:
    """The number of templates that every matrix's trials support, by the study's own rules."""
    return _chosen_k(spark, folder)[1]


def study_trial_policies(spark: SparkSession, folder: str) -> DataFrame:
    """The loss of every matrix under one template, caps of three and five, and the chosen number."""
    return study.k_policies(*_chosen_k(spark, folder), PART)


def study_trial_n(spark: SparkSession, folder: str) -> DataFrame:
    """The number of children from which every matrix's trials are stable, at its chosen number of templates, by the study's own rules."""
    numbers = [*_OF_K["numbers"], "excess_normalized", "match_mean_between", "agreement", "ari"]
    curve = _curve(spark, folder, numbers, only="primary_h3")
    scale = F.when(F.col("between") > 0, F.col("between"))
    points = [
        F.col("excess_normalized_median").alias("excess_median"), F.col("excess_normalized_p90").alias("excess_p90"), F.col("match_mean_between_median").alias("geometry_median"),
        F.col("match_mean_between_p90").alias("geometry_p90"), "agreement_median", "ari_median", F.col("support_ok_rate").alias("support_rate"), "marginal",
        (F.col("holdout_loss_mean") / scale).alias("loss_mean"), (F.col("holdout_loss_se") / scale).alias("loss_se"),
    ]
    of_k = F.struct("support_ok_rate", "holdout_loss_mean", "holdout_loss_se", "gain_vs_previous_k_median", "holdout_p90_mean", "partner_match_mean_between_median", "partner_ari_median")
    curve = written(curve.select(*POINT, F.struct(*points).alias("n"), F.when(F.col("n_children") == F.col("maximum"), of_k).alias("k_")), "curve")
    chosen = study.select_k(written(_k_curve(curve.select(*POINT, "k_.*")), "curve"), PART).select("part", F.col("selected_k").alias("k"))
    return study.select_n(curve.join(chosen, ["part", "k"]).select("part", "n_children", "maximum", "n.*"), PART)


def study_full_solutions(spark: SparkSession, folder: str) -> DataFrame:
    """The templates of every matrix solved over all its children, for one to five."""
    found = packed_trials.full_solutions(_matrices(spark, folder), PART, KS)
    return found.withColumn("assigned_children", F.array_join("assigned_children", "|"))


def study_child_stability(spark: SparkSession, folder: str) -> DataFrame:
    """How stably every child of a matrix is assigned over the repetitions."""
    found = packed_trials.assignment_stability(_matrices(spark, folder), PART, KS, REPETITIONS)
    return found.drop("together").withColumn("shares", F.array_join(F.col("shares").cast("array<string>"), "|"))


def study_template_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """The final templates of every matrix: those over all children at its chosen number, with how often trials at its recommended size chose them."""
    chosen = written(_chosen_k(spark, folder)[1], "chosen")
    matrices = _matrices(spark, folder)
    solutions = packed_trials.full_solutions(matrices, PART, KS).join(chosen.select("part", F.col("selected_k").alias("k"), "status"), ["part", "k"])
    counts = packed_trials.selected(matrices, PART, KS, [], REPETITIONS, only="primary_h3")
    found = solutions.join(counts.select("part", "k", "segment_id", F.col("frequency").alias("selection_frequency")), ["part", "k", "segment_id"], "left")
    return found.select(
        "part", F.col("k").alias("selected_k"), "status", "slot", "segment_id", "child", "n_assigned", (F.col("n_assigned") / F.col("n_children")).alias("assigned_share"), "own_loss_mean", "own_loss_median",
        "own_loss_p90", "nearest_other", "selection_frequency", "support_ok",
    )


def study_selection_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """How often every clip of a matrix is in a trial's set."""
    return packed_trials.selected(_matrices(spark, folder), PART, KS, resampling.GRID, REPETITIONS)


def derived_trials(spark: SparkSession, folder: str) -> DataFrame:
    """Trials derived from `lineitem`: one row per group, repetition, size and k."""
    r = table(spark, folder, "lineitem")
    keyed = r.select(
        F.concat(F.lit("A0"), (F.col("l_suppkey") % 3 + 1).cast("string")).alias("action"), F.get(F.array(*map(F.lit, AGE_GROUPS)), (F.col("l_partkey") % 4).cast("int")).alias("age"),
        F.lit("primary_h3").alias("scheme"), (F.col("l_orderkey") % 40).cast("int").alias("repetition"),
        F.get(F.array(*map(F.lit, [3, 5, 8, 10, 12, 15, 20])), F.col("l_linenumber") - 1).alias("n_children"), (F.col("l_quantity").cast("int") % 3 + 1).alias("k"),
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_partkey",
    )
    at = ["action", "age", "scheme", "repetition", "n_children", "k"]
    return keyed.groupBy(*at).agg(
        (F.min("l_extendedprice") / 100).alias("holdout_loss"), F.max("l_discount").alias("excess"), F.max("l_tax").alias("geometry"),
        (F.max("l_returnflag") == "R").alias("support_ok"), (F.min("l_partkey") % 5).cast("string").alias("set_id"), F.lit(20).alias("maximum"),
    )


def trial_gains(spark: SparkSession, folder: str) -> DataFrame:
    """Gains of the derived trials over fewer templates and fewer children."""
    found = resampling.paired_gains(derived_trials(spark, folder), GROUP)
    return found.select(*GROUP, "repetition", "n_children", "k", *[_shown(c).alias(c) for c in ("reduction_vs_k1", "gain_vs_previous_k", "gain_per_child")])


def trial_partners(spark: SparkSession, folder: str) -> DataFrame:
    """The set of the next repetition of every derived trial."""
    return resampling.partners(derived_trials(spark, folder), GROUP, "set_id").select(*GROUP, "repetition", "n_children", "k", "set_id", "partner")


_POINT = [*GROUP, "n_children", "k"]


def _curves(spark: SparkSession, folder: str) -> DataFrame:
    return study.curves(derived_trials(spark, folder), _POINT, ["holdout_loss", "excess"], ["support_ok"], "set_id")


def study_curves(spark: SparkSession, folder: str) -> DataFrame:
    """Curves of the derived trials."""
    found = _curves(spark, folder)
    numbers = [c for c, t in found.dtypes if t == "double"]
    return found.select(*_POINT, "repetitions", "n_sets", *[_shown(c).alias(c) for c in numbers])


def _curve_of_k(spark: SparkSession, folder: str) -> DataFrame:
    """A curve over k of every group, at its largest size, from the derived trials."""
    t = derived_trials(spark, folder).where("n_children < maximum")
    return t.groupBy(*GROUP, "k").agg(
        F.avg(F.col("support_ok").cast("double")).alias("support_rate"), F.round(F.avg("holdout_loss"), 4).alias("loss_mean"), F.round(F.stddev_samp("holdout_loss") / 3, 4).alias("loss_se"),
        F.percentile("excess", F.lit(0.5)).alias("gain_median"), F.round(F.percentile("holdout_loss", F.lit(0.9)), 4).alias("p90_mean"),
        F.percentile("geometry", F.lit(0.5)).alias("geometry_median"), (F.lit(1.0) - F.percentile("geometry", F.lit(0.5)) * 8).alias("ari_median"), F.lit(False).alias("dominant"),
    )


def study_choose_k(spark: SparkSession, folder: str) -> DataFrame:
    """The number of templates that the derived curves support."""
    return study.choose_k(_curve_of_k(spark, folder), GROUP, 3, study.K_RULES | {"support": 0.25})


def _curve_of_n(spark: SparkSession, folder: str) -> DataFrame:
    t = derived_trials(spark, folder).where("k = 1")
    return t.groupBy(*GROUP, "n_children", "maximum").agg(
        F.avg(F.col("support_ok").cast("double")).alias("support_rate"), F.round(F.avg("holdout_loss") / 1000, 4).alias("loss_mean"), F.round(F.stddev_samp("holdout_loss") / 6000, 4).alias("loss_se"),
        F.percentile("excess", F.lit(0.5)).alias("excess_median"), F.percentile("excess", F.lit(0.9)).alias("excess_p90"), F.percentile("geometry", F.lit(0.5)).alias("geometry_median"),
        F.percentile("geometry", F.lit(0.9)).alias("geometry_p90"), F.lit(0.9).alias("agreement_median"), F.lit(0.9).alias("ari_median"), F.lit(0.0).alias("marginal"),
    )


_RULES = study.N_RULES | {"support": 0.15, "excess_median": 0.075, "deterioration": 0.05}


def study_select_n(spark: SparkSession, folder: str) -> DataFrame:
    """Sample sizes that the derived curves support."""
    return study.select_n(_curve_of_n(spark, folder), GROUP, _RULES)


def study_size_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Their distribution, globally, by action and by age."""
    found = study.sample_size_summary(study_select_n(spark, folder), "action", "age", "n_1se", AGE_GROUPS)
    return found.withColumns({c: _shown(c) for c in found.columns if c[0] == "q"})


def coassignment(spark: SparkSession, folder: str) -> DataFrame:
    """How often two parts of a line status share a slot, from `lineitem`: orders stand for trials, parts for children."""
    r = table(spark, folder, "lineitem").groupBy("l_linestatus", (F.col("l_orderkey") % 25).alias("repetition"), (F.col("l_partkey") % 20).cast("string").alias("child"))
    assigned = r.agg(F.max(F.col("l_linenumber") % 2).alias("slot")).withColumnRenamed("l_linestatus", "part")
    return resampling.coassignment(assigned, PART).withColumn("together", _shown("together"))


def assignment_stability(spark: SparkSession, folder: str) -> DataFrame:
    """The most frequent slot and the entropy of the same assignments."""
    r = table(spark, folder, "lineitem").groupBy("l_linestatus", (F.col("l_orderkey") % 25).alias("repetition"), (F.col("l_partkey") % 20).cast("string").alias("child"))
    assigned = r.agg((F.sum("l_linenumber") % 2).cast("int").alias("slot")).withColumnRenamed("l_linestatus", "part")
    return resampling.assignment_stability(assigned, PART, 2).withColumns({"modal_share": _shown("modal_share"), "entropy": _shown("entropy")})


def child_covariates(spark: SparkSession, folder: str) -> DataFrame:
    """Covariates of every child of a training group."""
    rows = views.executions(spark, folder, "training").where("child IS NOT NULL AND action IS NOT NULL AND age IS NOT NULL")
    found = study.child_covariates(rows, GROUP, ["institution_id", "excel_city", "camera_id"], ["duration_seconds", "age_months_final_excel"])
    return found.withColumns({c: _shown(c) for c in ("duration_seconds", "age_months_final_excel")})


def eta_squared(spark: SparkSession, folder: str) -> DataFrame:
    """How much of the durations of a training group lies between cameras."""
    rows = views.executions(spark, folder, "training").where("action IS NOT NULL AND age IS NOT NULL")
    return study.eta_squared(rows, GROUP, "camera_id", "duration_seconds").withColumn("eta_squared", _shown("eta_squared"))


def mutual_information(spark: SparkSession, folder: str) -> DataFrame:
    """How much a training group's institutions and cameras say of each other."""
    rows = views.executions(spark, folder, "training").where("action IS NOT NULL AND age IS NOT NULL AND institution_id IS NOT NULL AND camera_id IS NOT NULL")
    return study.mutual_information(rows, GROUP, "institution_id", "camera_id").withColumn("nmi", _shown("nmi"))


def permutation_test(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the share of 50 permutations that say as much."""
    rows = views.executions(spark, folder, "training").where("action IS NOT NULL AND age IS NOT NULL AND institution_id IS NOT NULL AND camera_id IS NOT NULL")
    return study.permutation_test(rows, GROUP, "institution_id", "camera_id", "segment_id", 50)


def support_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Children and executions of both manifests by action and age."""
    both = views.executions(spark, folder, "training").unionByName(views.executions(spark, folder, "validation"))
    return reporting.support_matrix(both, "action", "age", AGE_GROUPS)


def _log(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "registro_revision_visual")
    return rows.select(F.lower(F.trim("reviewer_id", F.lit(BLANKS))).alias("reviewer_id"), "reference_id", "revision", "line_no", F.upper(F.trim("answers.final_status", F.lit(BLANKS))).alias("final_status"))


def review_status(spark: SparkSession, folder: str) -> DataFrame:
    """The state in force of every reviewed reference."""
    return reporting.review_states(_log(spark, folder))


def review_tally(spark: SparkSession, folder: str) -> DataFrame:
    """Stored references by state of review."""
    return reporting.review_tally(views.topk(spark, folder), reporting.review_states(_log(spark, folder)))


def policy_reduction(spark: SparkSession, folder: str) -> DataFrame:
    """Mean reduction of the derived loss by two and three templates instead of one."""
    losses = derived_trials(spark, folder).groupBy(*GROUP, F.concat(F.lit("k"), F.col("k").cast("string")).alias("policy")).agg(F.avg("holdout_loss").alias("loss"))
    return reporting.policy_reduction(losses, GROUP, "policy", "loss", "k1", ["k1", "k2", "k3"]).withColumn("reduction_pct", _shown("reduction_pct"))


def matrix_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """An order-free digest of every stored matrix's ids."""
    return reporting.fingerprints(table(spark, folder, "dtw_pairwise"), PART, ["segment_id_a", "segment_id_b"])


def templates_per_group(spark: SparkSession, folder: str) -> DataFrame:
    """Groups by the number of templates chosen for them, strictly and not."""
    wide = study_choose_k(spark, folder).groupBy("selected_k").pivot("strict", [True, False]).agg(F.count(F.lit(1)))
    return wide.select("selected_k", F.coalesce("true", F.lit(0)).alias("n_strict"), F.coalesce("false", F.lit(0)).alias("n_other"))


def stability_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Quartiles of the derived curves over groups by size, at the chosen number of templates."""
    found = study.stability_bands(_curves(spark, folder).withColumn("maximum", F.lit(20)), study_choose_k(spark, folder), GROUP, ["holdout_loss_mean", "excess_median"], ["36_47mo"])
    return found.select("n_children", "n_groups", *[_shown(c).alias(c) for c in found.columns[2:]])


def confounders(spark: SparkSession, folder: str) -> DataFrame:
    """Covariates of the children of every training group against a split of them in two, with 20 permutations."""
    rows = views.executions(spark, folder, "training").where("child IS NOT NULL AND action IS NOT NULL AND age IS NOT NULL")
    covariates = written(study.child_covariates(rows, GROUP, ["institution_id", "camera_id"], ["duration_seconds"]), "covariates")
    assigned = covariates.select(*GROUP, "child", (F.length("child") % 2 + F.substring("child", -1, 1).cast("int") % 2).alias("slot"))
    return study.confounders(assigned, covariates.drop("repeat_count"), GROUP, ["institution_id", "camera_id"], ["duration_seconds"], 20)


def confounder_effects(spark: SparkSession, folder: str) -> DataFrame:
    """Their effects alone."""
    return confounders(spark, folder).select(*GROUP, "variable", _shown("effect").alias("effect"))


def preflight(spark: SparkSession, folder: str) -> DataFrame:
    """Checks of the stored inputs before a study."""
    catalog = views.topk(spark, folder).where("part IS NOT NULL").select("part", "segment_id", "rank")
    return checks.preflight(views.executions(spark, folder, "training"), views.part_groups(spark, folder), views.pairs(spark, folder), catalog)


def partner_geometry(spark: SparkSession, folder: str) -> DataFrame:
    """How far the sets of two templates of successive repetitions lie apart."""
    distances = _distances(spark, folder, complete=False)
    trials = written(packed_trials.trials(distances, PART, [2], resampling.GRID, REPETITIONS), "trials")
    return resampling.partner_geometry(trials, distances, PART, 2).withColumn("mapping", F.array_join(F.col("mapping").cast("array<string>"), ""))


QUERIES = {
    f.__name__: f
    for f in (
        resampling_sizes, study_trials, study_trial_curves, study_trial_k, study_trial_policies, study_trial_n, study_full_solutions, study_child_stability, study_template_catalog, study_selection_frequency, trial_gains, trial_partners, study_curves, study_choose_k, study_select_n, study_size_summary, coassignment,
        assignment_stability, child_covariates, eta_squared, mutual_information, permutation_test, support_matrix, review_status, review_tally, policy_reduction, matrix_fingerprint,
        templates_per_group, stability_bands, confounders, confounder_effects, preflight, partner_geometry,
    )
}

_AGES = "['36_47mo', '48_59mo', '60_71mo', '72_83mo']"
_DERIVED = f"""SELECT action, age, 'primary_h3' AS scheme, repetition, n_children, k, min(p) / 100 AS holdout_loss, max(d) AS excess, max(t) AS geometry, max(f) = 'R' AS support_ok,
 CAST(min(q) % 5 AS VARCHAR) AS set_id, 20 AS maximum FROM (SELECT 'A0' || (l_suppkey % 3 + 1) AS action, {_AGES}[l_partkey % 4 + 1] AS age, CAST(l_orderkey % 40 AS INT) AS repetition,
 [3, 5, 8, 10, 12, 15, 20][l_linenumber] AS n_children, CAST(trunc(l_quantity) AS INT) % 3 + 1 AS k, l_extendedprice AS p, l_discount AS d, l_tax AS t, l_returnflag AS f, l_partkey AS q FROM lineitem) GROUP BY ALL"""


def _spread_sql(c: str) -> str:
    q = ", ".join(f"{_up(f'quantile_cont({c}, {v})')} AS {c}_{n}" for n, v in study.QUANTILES.items())
    sd = f"coalesce(stddev_samp({c}), 0)"
    return f"{_up(f'avg({c})')} AS {c}_mean, {_up(sd)} AS {c}_sd, {_up(f'{sd} / sqrt(count({c}))')} AS {c}_se, {q}"


_CURVE_N = f"""SELECT action, age, n_children, maximum, avg(CASE WHEN support_ok THEN 1.0 ELSE 0.0 END) AS support_rate, round(avg(holdout_loss) / 1000, 4) AS loss_mean, round(stddev_samp(holdout_loss) / 6000, 4) AS loss_se,
 median(excess) AS excess_median, quantile_cont(excess, 0.9) AS excess_p90, median(geometry) AS geometry_median, quantile_cont(geometry, 0.9) AS geometry_p90 FROM ({_DERIVED}) WHERE k = 1 GROUP BY ALL"""
_SELECT_N = f"""WITH c AS MATERIALIZED ({_CURVE_N}), u AS (SELECT * FROM c WHERE n_children < maximum),
 o AS (SELECT action, age, min(n_children) AS n_1se FROM (SELECT *, first_value(loss_mean + loss_se) OVER (PARTITION BY action, age ORDER BY loss_mean, n_children) AS lim FROM u) WHERE loss_mean <= lim GROUP BY ALL),
 p AS (SELECT *, CASE WHEN coalesce(excess_median <= 0.075 AND excess_p90 <= 0.1 AND geometry_median <= 0.1 AND geometry_p90 <= 0.2 AND support_rate >= 0.15, false) THEN 1 ELSE 0 END AS ok FROM u),
 w AS (SELECT *, min(ok) OVER a AS al, count(*) OVER a AS n, max(loss_mean) OVER (PARTITION BY action, age ORDER BY n_children ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM p
  WINDOW a AS (PARTITION BY action, age ORDER BY n_children ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
 e AS (SELECT action, age, min(n_children) AS n_equivalence FROM w WHERE al = 1 AND n = 3 AND (later IS NULL OR later - loss_mean <= 0.05) GROUP BY ALL),
 z AS (SELECT action, age, count(*) FILTER (n_children < maximum) AS n, max(support_rate) FILTER (n_children < maximum) AS s, max(n_children) FILTER (n_children < maximum) AS top, max(maximum) AS maximum FROM c GROUP BY ALL),
 m AS (SELECT z.*, n_equivalence, n_1se, CASE WHEN n < 3 THEN 'insufficient_children_for_stability_estimation' WHEN s < 0.15 THEN 'insufficient_support' WHEN n_equivalence IS NULL THEN 'not_stabilized_below_available_maximum'
  ELSE 'stabilized_below_available_maximum' END AS status FROM z LEFT JOIN e USING (action, age) LEFT JOIN o USING (action, age)),
 r AS (SELECT *, CASE WHEN status = 'stabilized_below_available_maximum' THEN greatest(n_equivalence, n_1se) END AS n_recommended FROM m),
 f AS (SELECT action, age, maximum, n_equivalence, n_1se, n_recommended, least(n_equivalence, n_1se) AS n_lower, coalesce(n_recommended, top) AS n_upper, CAST(ceil(round(n_recommended / 0.85, 9)) AS INT) AS n_for_15pct_loss,
  CAST(ceil(round(n_recommended / 0.8, 9)) AS INT) AS n_for_20pct_loss, status FROM r)"""
_EXEC = executions_sql("training")
_LOG = r"SELECT lower(trim(reviewer_id, E' \t\r\n')) AS reviewer_id, reference_id, revision, line_no, upper(trim(answers.final_status, E' \t\r\n')) AS final_status FROM registro_revision_visual WHERE reviewer_id IS NOT NULL AND reference_id IS NOT NULL AND revision IS NOT NULL"
_STATES = f"""SELECT reference_id, reviewer_id, final_status FROM (SELECT *, row_number() OVER (PARTITION BY reference_id ORDER BY first DESC, revision DESC, line_no DESC) AS nr FROM (
 SELECT *, min(line_no) OVER (PARTITION BY reference_id, reviewer_id) AS first FROM ({_LOG}))) WHERE nr = 1"""
_ASSIGNED = "SELECT l_linestatus AS part, l_orderkey % 25 AS repetition, CAST(l_partkey % 20 AS VARCHAR) AS child, max(l_linenumber % 2) AS slot FROM lineitem GROUP BY ALL"
_Q = "[0, 0.5, 0.75, 0.8, 0.9, 1]"

_COVARIATES = f"""WITH e AS MATERIALIZED (SELECT * FROM ({_EXEC}) WHERE child IS NOT NULL AND action IS NOT NULL AND age IS NOT NULL),
 {', '.join(f"m_{c} AS (SELECT action, age, child, first(v ORDER BY n DESC, v) AS {c} FROM (SELECT action, age, child, {c} AS v, count(*) AS n FROM e WHERE {c} IS NOT NULL GROUP BY ALL) GROUP BY action, age, child)" for c in ('institution_id', 'camera_id'))},
 x AS MATERIALIZED (SELECT action, age, child, CAST(length(child) % 2 + CAST(right(child, 1) AS INT) % 2 AS VARCHAR) AS s, institution_id, camera_id, d FROM (SELECT action, age, child, median(duration_seconds) AS d FROM e GROUP BY ALL)
  LEFT JOIN m_institution_id USING (action, age, child) LEFT JOIN m_camera_id USING (action, age, child)),
 t AS MATERIALIZED (SELECT action, age, s, 'institution_id' AS variable, institution_id AS v FROM x WHERE institution_id IS NOT NULL UNION ALL SELECT action, age, s, 'camera_id', camera_id FROM x WHERE camera_id IS NOT NULL)"""
_K_SQL = """SELECT selected_k, count(*) FILTER (strict) AS n_strict, count(*) FILTER (NOT strict) AS n_other FROM ({0}) GROUP BY selected_k"""

SQL = {
    "resampling_sizes": f"""WITH c AS (SELECT part, count(DISTINCT coalesce(child, 'desconocido::' || s)) AS n FROM (SELECT part, unnest([segment_id_a, segment_id_b]) AS s FROM ({PAIRS_SQL})) LEFT JOIN ({CHILDREN_SQL}) ON segment_id = s GROUP BY part),
 t AS (SELECT part, 'primary_h3' AS scheme, n - 3 AS maximum FROM c WHERE n > 3 UNION ALL SELECT part, 'secondary_h20', n - CAST(greatest(5, ceil(round(n * 0.2, 9))) AS INT) FROM c WHERE n - greatest(5, ceil(round(n * 0.2, 9))) >= 8),
 s AS (SELECT *, unnest(list_distinct(list_append(list_filter([3, 5, 8, 10, 12, 15, 20, 25, 30], lambda g: g <= maximum), maximum::INT))) AS n_children FROM t)
 SELECT part, scheme, CAST(n_children AS INT) AS n_children, CAST(maximum AS INT) AS maximum, CAST(n_children * {REPETITIONS} AS BIGINT) AS n_rows FROM s""",
    "trial_gains": f"""WITH d AS MATERIALIZED ({_DERIVED}) SELECT action, age, repetition, n_children, k,
 {_up('CASE WHEN one > 0 THEN (one - holdout_loss) / one END')} AS reduction_vs_k1, {_up('CASE WHEN pk = k - 1 AND pl > 0 THEN (pl - holdout_loss) / pl END')} AS gain_vs_previous_k, {_up('(nl - holdout_loss) / (n_children - nn)')} AS gain_per_child
 FROM (SELECT *, max(holdout_loss) FILTER (k = 1) OVER (PARTITION BY action, age, repetition, n_children) AS one, lag(k) OVER a AS pk, lag(holdout_loss) OVER a AS pl, lag(holdout_loss) OVER b AS nl, lag(n_children) OVER b AS nn FROM d
 WINDOW a AS (PARTITION BY action, age, repetition, n_children ORDER BY k), b AS (PARTITION BY action, age, repetition, k ORDER BY n_children))""",
    "trial_partners": f"""SELECT action, age, repetition, n_children, k, set_id, CASE WHEN count(*) OVER (PARTITION BY action, age, n_children, k) > 1 THEN
 coalesce(lead(set_id) OVER w, first_value(set_id) OVER w) END AS partner FROM ({_DERIVED}) WINDOW w AS (PARTITION BY action, age, n_children, k ORDER BY repetition)""",
    "study_curves": f"""WITH d AS MATERIALIZED ({_DERIVED}), w AS (SELECT action, age, n_children, k, count(*) AS repetitions, {_spread_sql('holdout_loss')}, {_spread_sql('excess')}, {_up('avg(CASE WHEN support_ok THEN 1.0 ELSE 0.0 END)')} AS support_ok_rate FROM d GROUP BY ALL),
 s AS (SELECT action, age, n_children, k, count(*) AS n_sets, {_up('max(c) / sum(c)')} AS mode_share, {_up('ln(sum(c)) - sum(c * ln(c)) / sum(c)')} AS set_entropy FROM (SELECT action, age, n_children, k, set_id, count(*)::DOUBLE AS c FROM d GROUP BY ALL) GROUP BY action, age, n_children, k)
 SELECT * FROM w JOIN s USING (action, age, n_children, k)""",
    "study_choose_k": f"""WITH c AS MATERIALIZED (SELECT action, age, k, avg(CASE WHEN support_ok THEN 1.0 ELSE 0.0 END) AS support_rate, round(avg(holdout_loss), 4) AS loss_mean, round(stddev_samp(holdout_loss) / 3, 4) AS loss_se, median(excess) AS gain,
 round(quantile_cont(holdout_loss, 0.9), 4) AS p90, median(geometry) AS geometry, 1 - median(geometry) * 8 AS ari FROM ({_DERIVED}) WHERE n_children < maximum GROUP BY ALL),
 b AS (SELECT *, support_rate >= 0.25 AS base, coalesce((p90 - lag(p90) OVER w) / lag(p90) OVER w, 0) AS worse FROM c WHERE k <= 3 WINDOW w AS (PARTITION BY action, age ORDER BY k)),
 l AS (SELECT *, base AND loss_mean <= (SELECT arg_min(x.loss_mean + x.loss_se, [x.loss_mean, x.k]) FROM b x WHERE x.base AND x.action = b.action AND x.age = b.age) AS near FROM b),
 g AS (SELECT action, age, min(k) FILTER (near AND (k = 1 OR gain >= 0.05) AND worse <= 0.02 AND geometry <= 0.25 AND (k = 1 OR ari >= 0.5)) AS s, min(k) FILTER (near) AS f, min(k) FILTER (base) AS b FROM l GROUP BY ALL)
 SELECT action, age, coalesce(s, f, b, 1) AS selected_k, CASE WHEN s IS NOT NULL THEN 'smallest_k_within_1se_gain_support_geometry_assignments' WHEN f IS NOT NULL THEN 'smallest_k_within_1se_support_fallback'
 WHEN b IS NOT NULL THEN 'smallest_support_eligible_k_fallback' ELSE 'fallback_k1_no_support_eligible_solution' END AS reason, s IS NOT NULL AS strict FROM g""",
    "study_select_n": f"{_SELECT_N} SELECT * FROM f",
    "study_size_summary": f"""{_SELECT_N}, s AS (SELECT CASE WHEN grouping(action, age) = 3 THEN 'global' WHEN grouping(action, age) = 1 THEN 'action' ELSE 'age' END AS scope, action, age, count(*) AS n_groups, count(n_1se) AS n_with_size,
 quantile_cont(n_1se, {_Q}) AS q FROM f GROUP BY GROUPING SETS ((), (action), (age)))
 SELECT scope, action, age, n_groups, n_with_size, {', '.join(f"{_up(f'q[{i + 1}]')} AS q{p}" for i, p in enumerate((0, 50, 75, 80, 90, 100)))} FROM s""",
    "coassignment": f"""WITH a AS MATERIALIZED ({_ASSIGNED}) SELECT x.part, x.child AS child_a, y.child AS child_b, count(*) AS n_trials, {_up('avg(CASE WHEN x.slot = y.slot THEN 1.0 ELSE 0.0 END)')} AS together
 FROM a x JOIN a y ON x.part = y.part AND x.repetition = y.repetition AND x.child <= y.child GROUP BY ALL""",
    "assignment_stability": f"""WITH a AS (SELECT l_linestatus AS part, l_orderkey % 25 AS repetition, CAST(l_partkey % 20 AS VARCHAR) AS child, CAST(sum(l_linenumber) % 2 AS INT) AS slot FROM lineitem GROUP BY ALL),
 c AS (SELECT part, child, slot, count(*)::DOUBLE AS n FROM a GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY part, child) AS p FROM c)
 SELECT part, child, arg_max(slot, [p, -slot]) AS modal_slot, {_up('max(p)')} AS modal_share, {_up('-sum(p * ln(p)) / ln(2)')} AS entropy FROM p GROUP BY part, child""",
    "child_covariates": f"""WITH e AS MATERIALIZED (SELECT * FROM ({_EXEC}) WHERE child IS NOT NULL AND action IS NOT NULL AND age IS NOT NULL),
 {', '.join(f"m_{c} AS (SELECT action, age, child, first(v ORDER BY n DESC, v) AS {c} FROM (SELECT action, age, child, {c} AS v, count(*) AS n FROM e WHERE {c} IS NOT NULL GROUP BY ALL) GROUP BY action, age, child)" for c in ('institution_id', 'excel_city', 'camera_id'))}
 SELECT action, age, child, repeat_count, {', '.join(f"coalesce({c}, '<missing>') AS {c}" for c in ('institution_id', 'excel_city', 'camera_id'))}, duration_seconds, age_months_final_excel FROM (
 SELECT action, age, child, count(*) AS repeat_count, {_up('median(duration_seconds)')} AS duration_seconds, {_up('median(age_months_final_excel)')} AS age_months_final_excel FROM e GROUP BY ALL)
 LEFT JOIN m_institution_id USING (action, age, child) LEFT JOIN m_excel_city USING (action, age, child) LEFT JOIN m_camera_id USING (action, age, child)""",
    "eta_squared": f"""WITH e AS MATERIALIZED (SELECT action, age, camera_id AS l, duration_seconds AS x FROM ({_EXEC}) WHERE action IS NOT NULL AND age IS NOT NULL AND camera_id IS NOT NULL AND duration_seconds IS NOT NULL),
 w AS (SELECT *, avg(x) OVER (PARTITION BY action, age) AS m, avg(x) OVER (PARTITION BY action, age, l) AS ml FROM e)
 SELECT action, age, {_up('CASE WHEN count(*) < 3 OR count(DISTINCT l) < 2 OR sum(power(x - m, 2)) <= 0 THEN 0.0 ELSE sum(power(ml - m, 2)) / sum(power(x - m, 2)) END')} AS eta_squared FROM w GROUP BY action, age""",
    "mutual_information": f"""WITH e AS MATERIALIZED (SELECT action, age, institution_id AS l, camera_id AS r FROM ({_EXEC}) WHERE action IS NOT NULL AND age IS NOT NULL AND institution_id IS NOT NULL AND camera_id IS NOT NULL),
 c AS (SELECT action, age, l, r, count(*)::DOUBLE AS n FROM e GROUP BY ALL), j AS (SELECT action, age, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM c GROUP BY ALL),
 a AS (SELECT action, age, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS a FROM (SELECT action, age, l, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL), b AS (SELECT action, age, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS b FROM (SELECT action, age, r, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL)
 SELECT action, age, {_up('CASE WHEN (a + b) / 2 < 1e-12 THEN 1.0 ELSE greatest((a + b - h) / ((a + b) / 2), 0) END')} AS nmi FROM j JOIN a USING (action, age) JOIN b USING (action, age)""",
    "support_matrix": f"""SELECT action, {', '.join(f'''count(DISTINCT child) FILTER (age = '{a}') AS "{a}_children", count(*) FILTER (age = '{a}') AS "{a}_executions"''' for a in AGE_GROUPS)}
 FROM (SELECT * FROM ({_EXEC}) UNION ALL SELECT * FROM ({executions_sql('validation')})) GROUP BY action""",
    "review_status": _STATES,
    "review_tally": f"SELECT coalesce(final_status, 'pendiente') AS final_status, count(*) AS n FROM (SELECT DISTINCT segment_id FROM ({TOPK_SQL})) LEFT JOIN ({_STATES}) ON reference_id = segment_id GROUP BY 1",
    "policy_reduction": f"""WITH l AS (SELECT action, age, avg(holdout_loss) FILTER (k = 1) AS a, avg(holdout_loss) FILTER (k = 2) AS b, avg(holdout_loss) FILTER (k = 3) AS c FROM ({_DERIVED}) GROUP BY ALL)
 SELECT 'k2' AS policy, {_up('100 * (1 - avg(b / a))')} AS reduction_pct FROM l UNION ALL SELECT 'k3', {_up('100 * (1 - avg(c / a))')} FROM l""",
    "matrix_fingerprint": """SELECT part, count(*) AS n_rows, CAST(sum(CAST('0x' || substr(sha256(concat_ws(chr(31), coalesce(segment_id_a, chr(0)), coalesce(segment_id_b, chr(0)))), 1, 15) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM dtw_pairwise GROUP BY part""",
}

SQL["templates_per_group"] = _K_SQL.format(SQL["study_choose_k"])
SQL["stability_bands"] = f"""WITH d AS MATERIALIZED ({_DERIVED}), c AS (SELECT action, age, n_children, k, avg(holdout_loss) AS m, median(excess) AS e FROM d GROUP BY ALL), s AS ({SQL["study_choose_k"]})
 SELECT n_children, count(DISTINCT [action, age]) AS n_groups, {', '.join(f"{_up(f'quantile_cont({c}, {q})')} AS {n}_{b}" for c, n in (('m', 'holdout_loss_mean'), ('e', 'excess_median')) for b, q in (('q1', 0.25), ('median', 0.5), ('q3', 0.75)))}
 FROM c JOIN s USING (action, age) WHERE k = selected_k AND age <> '36_47mo' AND n_children < 20 GROUP BY n_children"""
SQL["confounder_effects"] = f"""{_COVARIATES}, c AS (SELECT action, age, variable, s, v, count(*)::DOUBLE AS n FROM t GROUP BY ALL), j AS (SELECT action, age, variable, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h, count(DISTINCT v) AS vs FROM c GROUP BY ALL),
 a AS (SELECT action, age, variable, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS a FROM (SELECT action, age, variable, s, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL),
 b AS (SELECT action, age, variable, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS b FROM (SELECT action, age, variable, v, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL),
 w AS (SELECT *, avg(d) OVER (PARTITION BY action, age) AS m, avg(d) OVER (PARTITION BY action, age, s) AS ml FROM x WHERE d IS NOT NULL)
 SELECT action, age, variable, {_up('CASE WHEN vs < 2 THEN 0.0 WHEN (a + b) / 2 < 1e-12 THEN 1.0 ELSE greatest((a + b - h) / ((a + b) / 2), 0) END')} AS effect FROM j JOIN a USING (action, age, variable) JOIN b USING (action, age, variable)
 UNION ALL SELECT action, age, 'duration_seconds', {_up('CASE WHEN count(*) < 3 OR count(DISTINCT s) < 2 OR sum(power(d - m, 2)) <= 0 THEN 0.0 ELSE sum(power(ml - m, 2)) / sum(power(d - m, 2)) END')} FROM w GROUP BY action, age"""
SQL["preflight"] = f"""WITH m AS MATERIALIZED ({_EXEC}), i AS MATERIALIZED ({views.PART_GROUPS_SQL}), p AS MATERIALIZED ({PAIRS_SQL}), e AS MATERIALIZED (SELECT DISTINCT part, unnest([segment_id_a, segment_id_b]) AS segment_id FROM p),
 c AS MATERIALIZED (SELECT DISTINCT part, segment_id, rank FROM ({TOPK_SQL}) WHERE part IS NOT NULL),
 x AS (SELECT part, segment_id FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY round(v, 9), segment_id) AS nr FROM (SELECT part, segment_id, avg(distance) AS v FROM (
  SELECT part, segment_id_a AS segment_id, distance FROM p UNION ALL SELECT part, segment_id_b, distance FROM p) GROUP BY ALL)) WHERE nr = 1)
 SELECT 'execution_repeated' AS "check", count(*) AS n_violations FROM (SELECT segment_id FROM m GROUP BY segment_id HAVING count(*) > 1)
 UNION ALL SELECT 'execution_without_child', count(*) FROM m WHERE child IS NULL UNION ALL SELECT 'execution_without_group', count(*) FROM m WHERE action IS NULL OR age IS NULL
 UNION ALL SELECT 'index_part_without_group', count(*) FROM i WHERE action IS NULL OR age IS NULL
 UNION ALL SELECT 'index_part_without_pairs', count(*) FROM i WHERE part NOT IN (SELECT part FROM p) UNION ALL SELECT 'pairs_without_index', count(DISTINCT part) FROM p WHERE part NOT IN (SELECT part FROM i)
 UNION ALL SELECT 'segment_outside_manifest', count(*) FROM e WHERE segment_id NOT IN (SELECT segment_id FROM m)
 UNION ALL SELECT 'reference_outside_matrix', count(*) FROM (SELECT DISTINCT part, segment_id FROM c EXCEPT SELECT part, segment_id FROM e)
 UNION ALL SELECT 'matrix_without_first_reference', count(*) FROM (SELECT part FROM p EXCEPT SELECT part FROM c WHERE rank = 1)
 UNION ALL SELECT 'first_reference_is_not_the_medoid', count(*) FROM (SELECT DISTINCT part, segment_id FROM c WHERE rank = 1) f JOIN x USING (part) WHERE f.segment_id <> x.segment_id"""
