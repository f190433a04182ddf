"""Queries of references, comparisons and profiles, over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespan.functions.labels import age_start, child_or_unknown, child_text, references_for
from kinespan.operators import comparison, profiles, references
from kinespan.operators.references import usable
from kinespan.plans import views
from kinespan.plans.motion import compared_motion, compared_sql
from kinespan.plans.views import (
    BOTH_SQL, CHILDREN_SQL, PAIRS_SQL, PART_GROUPS_SQL, PRIMARIES_SQL, TOPK_SQL, diverse_sql, executions_sql,
)
from kinespan.sources.tables import table
from kinespan.workspace import written

PART = ["part"]


def _shown(c: str):
    """A number as it is put out: at 6 decimals, with halves, which means of stored decimals often are, always rounded up."""
    return F.floor((F.col(c) + 3e-8) * 1e6 + 0.5) / 1e6


def group_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Usable pairs of every matrix, repeated ones once."""
    return views.pairs(spark, folder)


def group_centrality(spark: SparkSession, folder: str) -> DataFrame:
    """Mean distance of every segment in its matrix."""
    return references.centrality(views.pairs(spark, folder), PART).withColumn("mean_distance", _shown("mean_distance"))


def group_medoid(spark: SparkSession, folder: str) -> DataFrame:
    """The medoid of every matrix."""
    found = references.medoids(references.centrality(views.pairs(spark, folder), PART), PART)
    return found.withColumn("mean_distance", _shown("mean_distance"))


def group_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """The percentiles by which references must differ, of every matrix."""
    found = references.distance_quantiles(views.pairs(spark, folder), PART)
    return found.select("part", *[F.round(c, 6).alias(c) for c in ("q25", "q20", "q10")])


def topk_diverse(spark: SparkSession, folder: str) -> DataFrame:
    """The diverse references of every matrix."""
    found = references.diverse_references(views.pairs(spark, folder), views.training_children(spark, folder), PART)
    return found.withColumn("mean_distance", _shown("mean_distance"))


def topk_first_two(spark: SparkSession, folder: str) -> DataFrame:
    """The first and second reference of every matrix."""
    return topk_diverse(spark, folder).where("rank <= 2").select("part", "segment_id", "rank", "child", "k_requested", "threshold_used", "n_group_clips", "n_group_children")


def catalog_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog assembled from all matrices: groups, ranks and which segments are primaries of their matrix."""
    found = topk_diverse(spark, folder)
    main = references.primaries(found, PART)
    return found.join(main, "part").join(views.part_groups(spark, folder), "part", "left").select(
        "part", "action", "age", "segment_id", "rank", (F.col("segment_id") == F.col("medoid_segment_id")).alias("is_primary")
    )


def catalog_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """How many stored matrices have how many references."""
    return references.catalog_sizes(views.topk(spark, folder).where("part IS NOT NULL"), PART)


def catalog_diff(spark: SparkSession, folder: str) -> DataFrame:
    """First references that only the stored or only the rebuilt catalog has."""
    stored = views.topk(spark, folder).where("rank = 1 AND part IS NOT NULL").select("part", "segment_id")
    rebuilt = references.medoids(references.centrality(views.pairs(spark, folder), PART), PART).select("part", F.col("medoid_segment_id").alias("segment_id"))
    return references.catalog_differences(stored, rebuilt, ["part", "segment_id"])


def matrix_violations(spark: SparkSession, folder: str) -> DataFrame:
    """What keeps every stored matrix from being full and clean."""
    index = table(spark, folder, "dtw_pairwise_index").groupBy("part").agg(F.max("n_clips").alias("n_clips"))
    return references.matrix_violations(table(spark, folder, "dtw_pairwise"), PART, index)


def index_check(spark: SparkSession, folder: str) -> DataFrame:
    """Announced against stored rows of every matrix."""
    stored = table(spark, folder, "dtw_pairwise").groupBy("part").agg(F.count("*").alias("n_stored"), F.count_if(usable(F.col("distance"))).alias("n_usable"))
    index = table(spark, folder, "dtw_pairwise_index").groupBy("part").agg(F.count("*").alias("n_entries"), F.max("n_pairs").alias("n_announced"))
    return index.join(stored, "part", "full").na.fill(0, ["n_entries", "n_stored", "n_usable"])


def child_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling of a child under both rules for children."""
    rows = table(spark, folder, "manifiesto_entrenamiento").select("segment_id", "excel_children").distinct()
    return rows.select("segment_id", "excel_children", child_or_unknown(F.col("excel_children"), F.col("segment_id")).alias("for_grouping"), child_text(F.col("excel_children")).alias("as_written"))


def k_by_children(spark: SparkSession, folder: str) -> DataFrame:
    """Children of every training group and how many references that asks for."""
    rows = views.executions(spark, folder, "training").where("action IS NOT NULL AND age IS NOT NULL")
    found = rows.groupBy("action", "age").agg(F.count_distinct("child").alias("n_children"), F.count("*").alias("n_clips"))
    return found.withColumn("k_requested", references_for(F.col("n_children")))


def age_bin_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Every age label of the validation manifest with its first month, as written and as one text."""
    rows = table(spark, folder, "manifiesto_validacion").groupBy("age_bin_12m_label").agg(F.count("*").alias("n"))
    from kinespan.functions.labels import age_key

    return rows.select("age_bin_12m_label", "n", age_start(F.col("age_bin_12m_label")).alias("start_as_written"), age_start(age_key(F.col("age_bin_12m_label"))).alias("start"))


def _catalog(spark: SparkSession, folder: str) -> DataFrame:
    """All distinct references of each group, from all its matrices; the first by rank and id is its primary."""
    rows = views.topk(spark, folder).groupBy("action", "age", "segment_id").agg(F.min("rank").alias("rank"), F.min("child").alias("child"))
    main = rows.groupBy("action", "age").agg(F.min(F.struct("rank", "segment_id")).alias("m")).select("action", "age", F.col("m.segment_id").alias("medoid_segment_id"))
    return comparison.reference_catalog(rows, main, ["action", "age"])


def reference_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """The stored catalog with its stored primaries marked."""
    found = comparison.reference_catalog(views.topk(spark, folder), views.primaries(spark, folder), ["action", "age"])
    return found.select("action", "age", "part", "segment_id", "rank", "is_primary")


def catalog_problems(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with the stored catalog."""
    marked = comparison.reference_catalog(views.topk(spark, folder), views.primaries(spark, folder), ["action", "age"])
    return comparison.catalog_problems(marked, views.executions(spark, folder, "training"), ["action", "age"])


def _requests(spark: SparkSession, folder: str, catalog: DataFrame) -> DataFrame:
    cases = views.executions(spark, folder, "validation")
    with_sequence = cases.where("duration_seconds IS NOT NULL").select("segment_id")
    return comparison.requests(cases, catalog, with_sequence)


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """What every validation execution asks for; those without a duration count as having no sequence."""
    return _requests(spark, folder, _catalog(spark, folder))


def request_states(spark: SparkSession, folder: str) -> DataFrame:
    """Requests by state."""
    return comparison.state_counts(requests(spark, folder))


def coverage_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Requests by action and state, with a column per state."""
    states = ["solicitada", "fuera_de_dominio_etario", "sin_grupo_de_referencia", "sin_secuencia"]
    return requests(spark, folder).groupBy("action").pivot("state", states).count().na.fill(0, states)


def expected_comparisons(spark: SparkSession, folder: str) -> DataFrame:
    """The planned comparisons; they grow with executions times references."""
    catalog = written(_catalog(spark, folder), "catalog")
    return comparison.planned(written(_requests(spark, folder, catalog), "requests"), catalog)


def expected_comparisons_all(spark: SparkSession, folder: str) -> DataFrame:
    """The comparisons planned with all references of a group, which `expected_comparisons` are too."""
    return expected_comparisons(spark, folder)


def comparison_status(spark: SparkSession, folder: str) -> DataFrame:
    """Every planned comparison of sequences with its state."""
    _, _, _, found = compared_motion(spark, folder)
    return found.select("segment_id", "reference_id", "age_offset", "is_primary", F.round("distance", 6).alias("distance"), "state")


def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Comparisons by action and state."""
    _, _, _, found = compared_motion(spark, folder)
    return comparison.state_counts(found, ["action"])


def separation_controls(spark: SparkSession, folder: str) -> DataFrame:
    """The six controls of the separation of training and validation."""
    rows, catalog, plan, found = compared_motion(spark, folder)
    return comparison.separation_controls(rows.where("is_training"), rows.where("NOT is_training"), catalog, plan, found)


def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    _, _, _, found = compared_motion(spark, folder)
    return written(profiles.profiles(found), "profiles")


_ROUNDED = ["d_Y", "d_E", "d_O"]


def execution_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles of every validation sequence, from the kernel's distances to all references of its groups."""
    found = _profiles(spark, folder)
    return found.withColumns({c: _shown(c) for c in [*_ROUNDED, "margin_Y_E", "margin_O_E"]})


def child_action_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles by child and action."""
    return profiles.child_action_rollup(_profiles(spark, folder)).withColumns({c: _shown(c) for c in _ROUNDED})


def coverage_by_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage and agreement of the three summaries."""
    found = profiles.coverage(_profiles(spark, folder))
    return found.withColumns({c: _shown(c) for c in ("median_Y", "median_E", "median_O")})


QUERIES = {
    f.__name__: f
    for f in (
        group_pairs, group_centrality, group_medoid, group_quantiles, topk_diverse, topk_first_two, catalog_rebuilt, catalog_sizes, catalog_diff, matrix_violations,
        index_check, child_canonical, k_by_children, age_bin_parse, reference_catalog, catalog_problems, requests, request_states, coverage_matrix,
        expected_comparisons, expected_comparisons_all, comparison_status, status_counts, separation_controls, execution_profiles, child_action_rollup, coverage_by_summary,
    )
}

def _up(c: str) -> str:
    """DuckDB's form of `_shown`."""
    return f"floor(({c} + 3e-8) * 1e6 + 0.5) / 1e6"


_CENTRAL = f"SELECT part, segment_id, avg(distance) AS m, count(*) AS n FROM ({BOTH_SQL}) GROUP BY part, segment_id"
_TOPK = diverse_sql(PAIRS_SQL, CHILDREN_SQL)
_FOUND = f"SELECT * EXCLUDE (m), {_up('m')} AS mean_distance FROM found"
_AGES = "'36_47mo', '48_59mo', '60_71mo', '72_83mo'"
_CATALOG = f"""SELECT action, age, segment_id, min(rank) AS rank, min(child) AS child, row_number() OVER (PARTITION BY action, age ORDER BY min(rank), segment_id) = 1 AS is_primary
 FROM ({TOPK_SQL}) GROUP BY action, age, segment_id"""
_REQUESTS = f"""SELECT segment_id, child, action, age, age_offset, coalesce(t, '') AS target_age, coalesce(n, 0) AS n_references,
 CASE WHEN t IS NULL THEN 'fuera_de_dominio_etario' WHEN n IS NULL THEN 'sin_grupo_de_referencia' WHEN duration_seconds IS NULL THEN 'sin_secuencia' ELSE 'solicitada' END AS state FROM (
 SELECT e.*, age_offset, CASE WHEN age IN ({_AGES}) OR age IS NOT NULL THEN list_filter([{_AGES}], lambda g: CAST(split_part(g, '_', 1) AS INT) = CAST(split_part(age, '_', 1) AS INT) + 12 * age_offset)[1] END AS t
 FROM ({executions_sql('validation')}) e, (VALUES (-1), (0), (1)) o(age_offset)) LEFT JOIN (SELECT action AS ga, age AS gg, count(*) AS n FROM ({_CATALOG}) GROUP BY ALL) ON ga = action AND gg = t"""
_PLAN = f"""SELECT r.action, r.target_age, r.segment_id, r.child, r.age, r.age_offset, c.segment_id AS reference_id, c.child AS reference_child, c.rank, c.is_primary FROM ({_REQUESTS}) r
 JOIN ({_CATALOG}) c ON c.action = r.action AND c.age = r.target_age WHERE state = 'solicitada'"""

def _profile_columns() -> str:
    out = []
    for offset, name in ((-1, "Y"), (0, "E"), (1, "O")):
        here = f"age_offset = {offset}"
        out.append(
            f"""CASE s WHEN 'primaria' THEN CASE WHEN count(*) FILTER ({here} AND is_primary) = 1 AND count(*) FILTER ({here} AND is_primary AND state <> 'calculada') = 0 THEN max(distance) FILTER ({here} AND is_primary) END
 ELSE CASE WHEN count(*) FILTER ({here}) > 0 AND count(*) FILTER ({here} AND state <> 'calculada') = 0 THEN CASE s WHEN 'minimo_topk' THEN min(distance) FILTER ({here}) ELSE median(distance) FILTER ({here}) END END END AS d_{name}"""
        )
    return ", ".join(out)


_PROFILES = f"""{compared_sql('')}, w AS (SELECT segment_id, child, action, age, s AS summary, {_profile_columns()} FROM results, (VALUES ('primaria'), ('mediana_topk'), ('minimo_topk')) x(s) GROUP BY segment_id, child, action, age, s),
 f AS MATERIALIZED (SELECT *, d_Y - d_E AS margin_Y_E, d_O - d_E AS margin_O_E, d_Y IS NOT NULL AND d_E IS NOT NULL AND d_O IS NOT NULL AS complete,
 CASE WHEN len(list_filter([d_Y, d_E, d_O], lambda d: d = least(d_Y, d_E, d_O))) = 1 THEN ['Y', 'E', 'O'][list_position([d_Y, d_E, d_O], least(d_Y, d_E, d_O))] END AS nearest FROM w)"""

SQL = {
    "group_pairs": PAIRS_SQL,
    "group_centrality": f"SELECT part, segment_id, {_up('m')} AS mean_distance, n AS n_pairs FROM ({_CENTRAL})",
    "group_medoid": f"SELECT part, segment_id AS medoid_segment_id, {_up('m')} AS mean_distance FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY round(m, 9), segment_id) AS nr FROM ({_CENTRAL})) WHERE nr = 1",
    "group_quantiles": f"SELECT part, round(q[1], 6) AS q25, round(q[2], 6) AS q20, round(q[3], 6) AS q10 FROM (SELECT part, quantile_cont(distance, [0.25, 0.2, 0.1]) AS q FROM ({PAIRS_SQL}) GROUP BY part)",
    "topk_diverse": f"{_TOPK} {_FOUND}",
    "topk_first_two": f"{_TOPK} SELECT part, segment_id, rank, child, k_requested, threshold_used, n_group_clips, n_group_children FROM found WHERE rank <= 2",
    "catalog_rebuilt": f"{_TOPK} SELECT part, action, age, segment_id, rank, rank = 1 AS is_primary FROM found LEFT JOIN ({PART_GROUPS_SQL}) USING (part)",
    "catalog_sizes": f"SELECT n_references, count(*) AS n_groups FROM (SELECT part, count(*) AS n_references FROM ({TOPK_SQL}) WHERE part IS NOT NULL GROUP BY part) GROUP BY n_references",
    "catalog_diff": f"""WITH a AS (SELECT DISTINCT part, segment_id FROM ({TOPK_SQL}) WHERE rank = 1 AND part IS NOT NULL),
 b AS (SELECT part, segment_id FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY round(m, 9), segment_id) AS nr FROM ({_CENTRAL})) WHERE nr = 1)
 SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "matrix_violations": """WITH k AS (SELECT part, least(segment_id_a, segment_id_b) AS a, greatest(segment_id_a, segment_id_b) AS b, count(*) AS n, bool_or(segment_id_a IS NULL OR segment_id_b IS NULL) AS none,
 bool_or(segment_id_a = segment_id_b) AS same, count(*) FILTER (distance IS NULL OR NOT isfinite(distance)) AS nf, count(*) FILTER (isfinite(distance) AND distance < 0) AS neg FROM dtw_pairwise GROUP BY ALL),
 g AS (SELECT part, sum(n) FILTER (coalesce(same, false) AND NOT none) AS diagonal, sum(n) FILTER (none) AS missing_id, sum(nf) AS not_finite, sum(neg) AS negative,
 sum(n - 1) FILTER (NOT coalesce(same, false) AND NOT none) AS duplicate_pair, count(*) FILTER (NOT coalesce(same, false) AND NOT none) AS pairs FROM k GROUP BY part),
 h AS (SELECT g.*, abs(n_clips * (n_clips - 1) // 2 - pairs) AS incomplete FROM g LEFT JOIN (SELECT part, max(n_clips) AS n_clips FROM dtw_pairwise_index GROUP BY part) USING (part))
 SELECT part, violation, CAST(n AS BIGINT) AS n FROM (SELECT part, unnest(['diagonal', 'missing_id', 'not_finite', 'negative', 'duplicate_pair', 'incomplete']) AS violation,
 unnest([diagonal, missing_id, not_finite, negative, duplicate_pair, incomplete]) AS n FROM h) WHERE n > 0""",
    "index_check": """SELECT part, coalesce(n_entries, 0) AS n_entries, n_announced, coalesce(n_stored, 0) AS n_stored, coalesce(n_usable, 0) AS n_usable FROM (
 SELECT part, count(*) AS n_entries, max(n_pairs) AS n_announced FROM dtw_pairwise_index GROUP BY part) FULL JOIN (
 SELECT part, count(*) AS n_stored, count(*) FILTER (isfinite(distance) AND distance >= 0) AS n_usable FROM dtw_pairwise GROUP BY part) USING (part)""",
    "child_canonical": r"""SELECT DISTINCT segment_id, excel_children, CASE WHEN excel_children IS NULL OR trim(excel_children) = '' THEN 'desconocido::' || segment_id
 WHEN isfinite(TRY_CAST(trim(excel_children, E' ') AS DOUBLE)) AND abs(TRY_CAST(trim(excel_children) AS DOUBLE)) < 9e15 AND TRY_CAST(trim(excel_children) AS DOUBLE) = floor(TRY_CAST(trim(excel_children) AS DOUBLE))
 THEN CAST(CAST(TRY_CAST(trim(excel_children) AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE trim(excel_children) END AS for_grouping,
 nullif(regexp_replace(trim(excel_children), '\.0$', ''), '') AS as_written FROM manifiesto_entrenamiento""",
    "k_by_children": f"""SELECT action, age, n_children, n_clips, CASE WHEN n_children < 5 THEN 1 WHEN n_children < 10 THEN 2 WHEN n_children < 20 THEN 3 ELSE 4 END AS k_requested FROM (
 SELECT action, age, count(DISTINCT child) AS n_children, count(*) AS n_clips FROM ({executions_sql('training')}) WHERE action IS NOT NULL AND age IS NOT NULL GROUP BY action, age)""",
    "age_bin_parse": rf"""SELECT age_bin_12m_label, n, TRY_CAST(nullif(regexp_extract(age_bin_12m_label, '^\s*(\d+)_(\d+)mo\s*$', 1), '') AS INT) AS start_as_written,
 TRY_CAST(split_part({views.age_sql('age_bin_12m_label')}, '_', 1) AS INT) AS start FROM (SELECT age_bin_12m_label, count(*) AS n FROM manifiesto_validacion GROUP BY age_bin_12m_label)""",
    "reference_catalog": f"SELECT action, age, part, segment_id, rank, coalesce(segment_id = medoid_segment_id, false) AS is_primary FROM ({TOPK_SQL}) LEFT JOIN ({PRIMARIES_SQL}) USING (action, age)",
    "catalog_problems": f"""WITH c AS MATERIALIZED (SELECT action, age, segment_id, coalesce(segment_id = medoid_segment_id, false) AS p FROM ({TOPK_SQL}) LEFT JOIN ({PRIMARIES_SQL}) USING (action, age))
 SELECT 'groups_without_one_primary' AS problem, count(*) AS n FROM (SELECT action, age FROM c GROUP BY action, age HAVING count(*) FILTER (p) <> 1)
 UNION ALL SELECT 'references_outside_training', count(DISTINCT segment_id) FROM c WHERE segment_id NOT IN (SELECT segment_id FROM manifiesto_entrenamiento WHERE segment_id IS NOT NULL)""",
    "requests": _REQUESTS,
    "request_states": f"SELECT state, count(*) AS n FROM ({_REQUESTS}) GROUP BY state",
    "coverage_matrix": f"""SELECT action, {', '.join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ('solicitada', 'fuera_de_dominio_etario', 'sin_grupo_de_referencia', 'sin_secuencia'))} FROM ({_REQUESTS}) GROUP BY action""",
    "expected_comparisons": _PLAN,
    "expected_comparisons_all": _PLAN,
    "comparison_status": compared_sql("SELECT segment_id, reference_id, age_offset, is_primary, round(distance, 6) AS distance, state FROM results"),
    "status_counts": compared_sql("SELECT action, state, count(*) AS n FROM results GROUP BY action, state"),
    "separation_controls": compared_sql(
        """, k AS (SELECT segment_id, reference_id, age_offset FROM plan), o AS (SELECT segment_id, reference_id, age_offset FROM results)
 SELECT 'child_in_both' AS control, (SELECT count(*) FROM (SELECT child FROM motion WHERE is_training INTERSECT SELECT child FROM motion WHERE NOT is_training)) AS n_violations
 UNION ALL SELECT 'reference_outside_training', (SELECT count(DISTINCT segment_id) FROM catalog WHERE segment_id NOT IN (SELECT segment_id FROM motion WHERE is_training))
 UNION ALL SELECT 'own_reference', (SELECT count(*) FROM results WHERE child = reference_child)
 UNION ALL SELECT 'plan_not_observed', (SELECT count(*) FROM ((SELECT * FROM k EXCEPT SELECT * FROM o) UNION ALL (SELECT * FROM o EXCEPT SELECT * FROM k)))
 UNION ALL SELECT 'duplicate_comparison', (SELECT count(*) FROM (SELECT segment_id, reference_id, age_offset FROM results GROUP BY ALL HAVING count(*) > 1))
 UNION ALL SELECT 'mixed_versions', (SELECT greatest(count(DISTINCT metric_version || '|' || conditioning_version) - 1, 0) FROM results)"""
    ),
    "execution_profiles": f"""{_PROFILES} SELECT segment_id, child, action, age, summary, {_up('d_Y')} AS d_Y, {_up('d_E')} AS d_E, {_up('d_O')} AS d_O, {_up('margin_Y_E')} AS margin_Y_E,
 {_up('margin_O_E')} AS margin_O_E, complete, nearest FROM f""",
    "child_action_rollup": f"""{_PROFILES}, a AS (SELECT child, action, summary, count(*) AS n_executions, {', '.join(f"CASE WHEN count(d_{n}) = count(*) THEN [avg(d_{n}), median(d_{n}), min(d_{n}), max(d_{n})] END AS l_{n}" for n in 'YEO')} FROM f GROUP BY child, action, summary)
 SELECT child, action, summary, n_executions, ['media', 'mediana', 'minimo', 'maximo'][i] AS statistic, {', '.join(f"{_up(f'l_{n}[i]')} AS d_{n}" for n in 'YEO')} FROM a, range(1, 5) x(i)""",
    "coverage_by_summary": f"""{_PROFILES}, c AS (SELECT segment_id, count(*) FILTER (complete) = 3 AS common, max(nearest) FILTER (summary = 'primaria') AS own FROM f GROUP BY segment_id)
 SELECT summary, count(*) AS n_executions, count(d_E) AS n_with_E, count(*) FILTER (complete) AS n_complete, count(*) FILTER (d_Y IS NULL AND d_E IS NULL AND d_O IS NULL) AS n_none,
 count(*) FILTER (common) AS n_common, {', '.join(f"{_up(f'median(d_{n}) FILTER (common)')} AS median_{n}" for n in 'YEO')}, {', '.join(f"count(*) FILTER (common AND nearest = '{n}') AS nearest_{n}" for n in 'YEO')},
 count(*) FILTER (common AND NOT coalesce(nearest = own, false)) AS n_changed FROM f JOIN c USING (segment_id) GROUP BY summary""",
}
