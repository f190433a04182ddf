"""Queries of conditioning and distances, over sequences derived from the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespan.operators import comparison, conditioning, dtw, references
from kinespan.plans.views import MOTION_SQL, POSE_HIPS, POSE_SQL, POSE_TORSO, diverse_sql, long_motion, motion, pose
from kinespan.workspace import written


def _filled(spark: SparkSession, folder: str) -> DataFrame:
    return conditioning.fill_gaps(pose(spark, folder))


def validity_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Valid observations of every segment and joint."""
    rows = pose(spark, folder)
    ok = conditioning.is_valid(F.col("x"), F.col("y"), F.col("confidence"))
    return rows.groupBy("segment_id", "joint").agg(F.count_if(ok).alias("n_valid"), F.count("*").alias("n_frames"))


def gap_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    """The pose table after short gaps are filled."""
    return _filled(spark, folder).select("segment_id", "frame", "joint", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "valid")


def root_origin(spark: SparkSession, folder: str) -> DataFrame:
    """The origin of every frame and where it comes from."""
    found = conditioning.root_origins(_filled(spark, folder), POSE_HIPS)
    return found.select("segment_id", "frame", F.round("root_x", 6).alias("root_x"), F.round("root_y", 6).alias("root_y"), "root_source")


def torso_scale(spark: SparkSession, folder: str) -> DataFrame:
    """The scale of every segment."""
    found = conditioning.torso_scales(_filled(spark, folder), POSE_TORSO)
    return found.select("segment_id", F.round("scale", 6).alias("scale"), "scale_fallback")


def normalize_pose(spark: SparkSession, folder: str) -> DataFrame:
    """The conditioned pose table."""
    found, _ = conditioning.conditioned(pose(spark, folder), POSE_HIPS, POSE_TORSO)
    at = lambda c: F.round(F.col(c).cast("double"), 4).alias(c)
    return found.select("segment_id", "frame", "joint", at("x"), at("y"), "valid")


def conditioning_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """Missing share, scale and fallbacks of every segment."""
    _, found = conditioning.conditioned(pose(spark, folder), POSE_HIPS, POSE_TORSO)
    return found.withColumns({"missing_share": F.round("missing_share", 6), "scale": F.round("scale", 6)})


def conditioning_summary(spark: SparkSession, folder: str) -> DataFrame:
    """One row over all segments."""
    return conditioning.batch_summary(conditioning_diagnostics(spark, folder)).withColumn("mean_missing_share", F.round("mean_missing_share", 6))


def packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Every conditioned sequence packed: frames, cells and missing cells."""
    found, _ = conditioning.conditioned(pose(spark, folder), POSE_HIPS, POSE_TORSO)
    packed = conditioning.sequences(found)
    cells = F.flatten("frames")
    return packed.select("segment_id", "n_frames", F.size(cells).alias("n_cells"), F.size(F.filter(cells, lambda v: v.isNull())).alias("n_missing"))


def sequence_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Raw sequences that fail the checks before a comparison, where every 29th has lost a cell of its first frame."""
    rows = motion(spark, folder)
    broken = F.pmod(F.substring("segment_id", 2, 9).cast("int"), F.lit(29)) == 0
    cut = F.transform("frames", lambda f, i: F.when((i == 0) & broken, F.slice(f, 1, 7)).otherwise(f))
    return conditioning.sequence_violations(rows.withColumn("frames", cut), joints=4)


def _training(spark: SparkSession, folder: str) -> DataFrame:
    return motion(spark, folder).where("is_training").select("action", "age", "segment_id", "frames")


def dtw_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Distances of all pairs of a group's training sequences."""
    found = dtw.pair_distances(_training(spark, folder), ["action", "age"])
    return found.withColumn("distance", F.round("distance", 6)).withColumn("state", F.when(F.col("distance").isNull(), "sin_camino_admisible").otherwise("calculada"))


def dtw_expression_form(spark: SparkSession, folder: str) -> DataFrame:
    """Validation sequences against the group's first training sequence, by nested expressions alone."""
    first = _training(spark, folder).groupBy("action", "age").agg(F.min(F.struct("segment_id", "frames")).alias("r"))
    cases = motion(spark, folder).where("NOT is_training").select("action", "age", "segment_id", "frames")
    met = cases.join(first, ["action", "age"])
    return met.select("segment_id", F.col("r.segment_id").alias("reference_id"), F.round(dtw.dtw_expression(F.col("frames"), F.col("r.frames")), 6).alias("distance"))


def local_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Costs of every validation sequence's first frame with each frame of the group's first training sequence."""
    first = _training(spark, folder).groupBy("action", "age").agg(F.min(F.struct("segment_id", "frames")).alias("r"))
    cases = motion(spark, folder).where("NOT is_training").select("action", "age", "segment_id", F.get("frames", F.lit(0)).alias("a"))
    met = cases.join(first, ["action", "age"]).select("segment_id", F.col("r.segment_id").alias("reference_id"), "a", F.posexplode("r.frames").alias("frame", "b"))
    cost = dtw.local_cost(F.col("a"), F.col("b"))
    return met.select("segment_id", "reference_id", "frame", F.when(cost < float("inf"), F.round(cost, 6)).alias("cost"))


def dtw_path_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment steps of every validation sequence with the group's first training sequence."""
    first = _training(spark, folder).groupBy("action", "age").agg(F.min(F.struct("segment_id", "frames")).alias("r"))
    cases = motion(spark, folder).where("NOT is_training").select("action", "age", "segment_id", "frames")
    met = cases.join(first, ["action", "age"]).select("segment_id", F.col("r.segment_id").alias("reference_id"), dtw.dtw_path()("frames", F.col("r.frames")).alias("path"))
    return met.select("segment_id", "reference_id", F.posexplode("path").alias("step", "s")).select("segment_id", "reference_id", "step", "s.i", "s.j", F.round("s.cost", 6).alias("cost"))


def dtw_distance_17(spark: SparkSession, folder: str) -> DataFrame:
    """The same with 17 joints and 20 to 40 frames."""
    rows = long_motion(spark, folder).where("is_training").select("action", "age", "segment_id", "frames")
    return dtw.pair_distances(rows, ["action", "age"]).withColumn("distance", F.round("distance", 6))


def compared_motion(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sequences, catalog, plan and results: every validation sequence against the diverse references of its own and the neighbouring age groups.

    The references come from the distances of all pairs of each group's training sequences.
    """
    rows = written(motion(spark, folder), "motion")
    training = rows.where("is_training")
    pairs = written(dtw.pair_distances(training.select("action", "age", "segment_id", "frames"), ["action", "age"]).where("distance IS NOT NULL"), "pairs")
    found = references.diverse_references(pairs, training.select("segment_id", "child"), ["action", "age"])
    catalog = written(found.select("action", "age", "segment_id", "child", "rank", (F.col("rank") == 1).alias("is_primary")), "catalog")
    plan = written(comparison.planned(comparison.requests(rows.where("NOT is_training"), catalog, rows), catalog), "plan")
    results = comparison.with_states(plan, dtw.planned_distances(plan, rows), rows)
    return rows, catalog, plan, written(results, "results")


def motion_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """The references of every group of training sequences."""
    return compared_motion(spark, folder)[1].select("action", "age", "segment_id", "child", "rank", "is_primary")


def motion_comparisons(spark: SparkSession, folder: str) -> DataFrame:
    """Every validation sequence against the references of its own and the neighbouring age groups, with states."""
    found = compared_motion(spark, folder)[3]
    return found.select("segment_id", "reference_id", "age_offset", "is_primary", F.round("distance", 6).alias("distance"), "state")


def pair_index(spark: SparkSession, folder: str) -> DataFrame:
    """Clips and pairs of every training group."""
    return dtw.pair_counts(_training(spark, folder), ["action", "age"])


QUERIES = {
    f.__name__: f
    for f in (
        validity_mask, gap_interpolation, root_origin, torso_scale, normalize_pose, conditioning_diagnostics, conditioning_summary, packed_sequences,
        sequence_violations, local_cost, dtw_distance, dtw_expression_form, dtw_path_steps, dtw_distance_17, motion_catalog, motion_comparisons, pair_index,
    )
}

_MASKED = f"""SELECT segment_id, frame, joint, confidence, coalesce(isfinite(x) AND isfinite(y) AND confidence >= 0.3 AND NOT (x = 0 AND y = 0), false) AS ok,
 CASE WHEN ok THEN x END AS x, CASE WHEN ok THEN y END AS y FROM (SELECT * FROM ({POSE_SQL}))"""
_FILLED = f"""SELECT segment_id, frame, joint, CASE WHEN fill THEN ax + (bx - ax) * (frame - af) / (bf - af) ELSE x END AS x,
 CASE WHEN fill THEN ay + (by_ - ay) * (frame - af) / (bf - af) ELSE y END AS y, ok OR coalesce(fill, false) AS valid FROM (
 SELECT *, NOT ok AND bf - af - 1 <= 3 AS fill FROM (SELECT *,
 last_value(CASE WHEN ok THEN frame END IGNORE NULLS) OVER a AS af, last_value(x IGNORE NULLS) OVER a AS ax, last_value(y IGNORE NULLS) OVER a AS ay,
 first_value(CASE WHEN ok THEN frame END IGNORE NULLS) OVER b AS bf, first_value(x IGNORE NULLS) OVER b AS bx, first_value(y IGNORE NULLS) OVER b AS by_
 FROM ({_MASKED}) WINDOW a AS (PARTITION BY segment_id, joint ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 b AS (PARTITION BY segment_id, joint ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)))"""
_ROOTS = f"""SELECT segment_id, frame, coalesce(avg(x) FILTER (joint IN (2, 3)), avg(x)) AS root_x, coalesce(avg(y) FILTER (joint IN (2, 3)), avg(y)) AS root_y,
 CASE WHEN count(x) FILTER (joint IN (2, 3)) > 0 THEN 'hips' WHEN count(x) > 0 THEN 'visible' ELSE 'none' END AS root_source FROM ({_FILLED}) GROUP BY segment_id, frame"""
_SCALES = f"""SELECT segment_id, greatest(coalesce(m, d, 1.0), 1.0) AS scale, m IS NULL AS scale_fallback FROM (
 SELECT segment_id, sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2)) AS d FROM ({_FILLED}) GROUP BY segment_id) LEFT JOIN (
 SELECT a.segment_id, median(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS m FROM ({_FILLED}) a JOIN ({_FILLED}) b ON a.segment_id = b.segment_id AND a.frame = b.frame
  AND a.joint < b.joint WHERE a.x IS NOT NULL AND b.x IS NOT NULL AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) > 1e-6 GROUP BY a.segment_id) USING (segment_id)"""
_DIAGNOSTICS = f"""SELECT f.segment_id, f.n_frames, round(f.missing, 6) AS missing_share, root_fallback_frames, root_no_support_frames, round(scale, 6) AS scale, scale_fallback FROM (
 SELECT segment_id, count(DISTINCT frame) AS n_frames, avg(CASE WHEN valid THEN 0.0 ELSE 1.0 END) AS missing FROM ({_FILLED}) GROUP BY segment_id) f JOIN (
 SELECT segment_id, count(*) FILTER (root_source = 'visible') AS root_fallback_frames, count(*) FILTER (root_source = 'none') AS root_no_support_frames FROM ({_ROOTS}) GROUP BY segment_id) r
 USING (segment_id) JOIN ({_SCALES}) s USING (segment_id)"""
_COST = """CASE WHEN len(list_filter([0, 1, 2, 3], lambda k: {a}[2 * k + 1] + {a}[2 * k + 2] + {b}[2 * k + 1] + {b}[2 * k + 2] IS NOT NULL)) >= 2 THEN
 sqrt(list_sum(list_transform([0, 1, 2, 3], lambda k: coalesce(power({a}[2 * k + 1] - {b}[2 * k + 1], 2) + power({a}[2 * k + 2] - {b}[2 * k + 2], 2), 0))) * 4
 / len(list_filter([0, 1, 2, 3], lambda k: {a}[2 * k + 1] + {a}[2 * k + 2] + {b}[2 * k + 1] + {b}[2 * k + 2] IS NOT NULL))) ELSE 'inf'::DOUBLE END"""
_DTW = """WITH RECURSIVE p AS MATERIALIZED ({pairs}), d AS (SELECT {keys}, fa, fb, 0 AS i, list_concat([0.0::DOUBLE], list_transform(range(len(fb)), lambda x: 'inf'::DOUBLE)) AS r FROM p
 UNION ALL SELECT {keys}, fa, fb, i + 1, list_reduce(list_prepend(['inf'::DOUBLE], list_transform(range(1, len(fb) + 1), lambda j: [j::DOUBLE])),
  lambda acc, j: list_append(acc, least(r[j[1]::INT + 1], acc[-1], r[j[1]::INT]) + c[j[1]::INT]))
  FROM (SELECT *, list_transform(fb, lambda b: {cost}) AS c FROM d WHERE i < len(fa))),
 e AS (SELECT {keys}, r[-1] / (len(fa) + len(fb)) AS v FROM d WHERE i = len(fa))"""
_TRAIN_PAIRS = f"""SELECT a.action, a.age, a.segment_id AS segment_id_a, b.segment_id AS segment_id_b, a.frames AS fa, b.frames AS fb
 FROM ({MOTION_SQL}) a JOIN ({MOTION_SQL}) b ON a.action = b.action AND a.age = b.age AND a.segment_id < b.segment_id WHERE a.is_training AND b.is_training"""
_FIRST = f"SELECT action, age, arg_min(segment_id, segment_id) AS reference_id, arg_min(frames, segment_id) AS rf FROM ({MOTION_SQL}) WHERE is_training GROUP BY action, age"
_CASE_PAIRS = f"SELECT c.segment_id, f.reference_id, c.frames AS fa, f.rf AS fb FROM ({MOTION_SQL}) c JOIN ({_FIRST}) f USING (action, age) WHERE NOT c.is_training"

def dtw_sql(pairs: str, keys: str) -> str:
    """The head of a DuckDB query whose `e` has `keys` and the distance `v` (infinite for abstentions) of `pairs` (`fa`, `fb`)."""
    return _DTW.format(pairs=pairs, keys=keys, cost=_COST.format(a="fa[i + 1]", b="b"))


_STATE = "CASE WHEN isfinite(v) THEN 'calculada' ELSE 'sin_camino_admisible' END"
_COMPARED = f"""motion AS MATERIALIZED ({MOTION_SQL}), train_pairs AS MATERIALIZED (SELECT action || '|' || age AS part, segment_id_a, segment_id_b, v AS distance FROM (
 {dtw_sql(_TRAIN_PAIRS, 'action, age, segment_id_a, segment_id_b')} SELECT * FROM e) WHERE isfinite(v)),
 catalog AS MATERIALIZED (SELECT split_part(part, '|', 1) AS action, split_part(part, '|', 2) AS age, segment_id, child, rank, rank = 1 AS is_primary FROM (
 {diverse_sql('SELECT * FROM train_pairs', 'SELECT segment_id, child FROM motion WHERE is_training')} SELECT * FROM found)),
 plan AS MATERIALIZED (SELECT c.segment_id, c.child, c.action, c.age, o.age_offset, r.segment_id AS reference_id, r.child AS reference_child, r.rank, r.is_primary, c.frames AS fa, x.frames AS fb
  FROM motion c, (VALUES (-1), (0), (1)) o(age_offset), catalog r JOIN motion x ON x.segment_id = r.segment_id
  WHERE NOT c.is_training AND r.action = c.action AND CAST(r.age[:2] AS INT) = CAST(c.age[:2] AS INT) + 12 * o.age_offset),
 results AS MATERIALIZED (SELECT p.* EXCLUDE (fa, fb), CASE WHEN isfinite(v) THEN v END AS distance, {_STATE} AS state, '{dtw.METRIC_VERSION}' AS metric_version, '{dtw.CONDITIONING_VERSION}' AS conditioning_version FROM plan p JOIN (
  {dtw_sql('SELECT segment_id, reference_id, min(fa) AS fa, min(fb) AS fb FROM plan GROUP BY segment_id, reference_id', 'segment_id, reference_id')} SELECT * FROM e) USING (segment_id, reference_id))"""


def compared_sql(body: str) -> str:
    """A DuckDB query over `motion`, `catalog`, `plan` and `results` of `compared_motion`."""
    return f"WITH {_COMPARED} {body}"


SQL = {
    "validity_mask": f"SELECT segment_id, joint, count(*) FILTER (ok) AS n_valid, count(*) AS n_frames FROM ({_MASKED}) GROUP BY segment_id, joint",
    "gap_interpolation": f"SELECT segment_id, frame, joint, round(x, 6) AS x, round(y, 6) AS y, valid FROM ({_FILLED})",
    "root_origin": f"SELECT segment_id, frame, round(root_x, 6) AS root_x, round(root_y, 6) AS root_y, root_source FROM ({_ROOTS})",
    "torso_scale": f"SELECT segment_id, round(scale, 6) AS scale, scale_fallback FROM ({_SCALES})",
    "normalize_pose": f"""SELECT segment_id, frame, joint, round(CAST(CAST((x - root_x) / scale AS FLOAT) AS DOUBLE), 4) AS x, round(CAST(CAST((y - root_y) / scale AS FLOAT) AS DOUBLE), 4) AS y, valid
 FROM ({_FILLED}) JOIN ({_ROOTS}) USING (segment_id, frame) JOIN ({_SCALES}) USING (segment_id)""",
    "conditioning_diagnostics": _DIAGNOSTICS,
    "conditioning_summary": f"""SELECT count(*) AS n_segments, round(avg(missing_share), 6) AS mean_missing_share, count(*) FILTER (root_fallback_frames > 0) AS n_root_fallback,
 count(*) FILTER (scale_fallback) AS n_scale_fallback FROM ({_DIAGNOSTICS})""",
    "packed_sequences": f"""SELECT segment_id, CAST(count(DISTINCT frame) AS INT) AS n_frames, CAST(2 * count(*) AS INT) AS n_cells, CAST(2 * count(*) FILTER (NOT valid OR x IS NULL) AS INT) AS n_missing
 FROM ({_FILLED}) GROUP BY segment_id""",
    "sequence_violations": f"""SELECT segment_id, unnest(list_filter(['wrong_width', 'half_missing'], lambda v: v = 'wrong_width' OR frames[1][7] IS NOT NULL)) AS violation
 FROM ({MOTION_SQL}) WHERE CAST(substr(segment_id, 2) AS INT) % 29 = 0""",
    "local_cost": f"""SELECT segment_id, reference_id, CAST(n AS INT) AS frame, CASE WHEN isfinite(c) THEN round(c, 6) END AS cost FROM (
 SELECT segment_id, reference_id, n, {_COST.format(a='fa[1]', b='fb[n + 1]')} AS c FROM (SELECT *, unnest(range(len(fb))) AS n FROM ({_CASE_PAIRS})))""",
    "dtw_distance": f"""{dtw_sql(_TRAIN_PAIRS, 'action, age, segment_id_a, segment_id_b')} SELECT action, age, segment_id_a, segment_id_b, CASE WHEN isfinite(v) THEN round(v, 6) END AS distance,
 CASE WHEN isfinite(v) THEN 'calculada' ELSE 'sin_camino_admisible' END AS state FROM e""",
    "dtw_expression_form": f"{dtw_sql(_CASE_PAIRS, 'segment_id, reference_id')} SELECT segment_id, reference_id, CASE WHEN isfinite(v) THEN round(v, 6) END AS distance FROM e",
    "motion_catalog": compared_sql("SELECT * FROM catalog"),
    "motion_comparisons": compared_sql("SELECT segment_id, reference_id, age_offset, is_primary, round(distance, 6) AS distance, state FROM results"),
    "pair_index": f"SELECT action, age, count(*) AS n_clips, count(*) * (count(*) - 1) // 2 AS n_pairs FROM ({MOTION_SQL}) WHERE is_training GROUP BY action, age",
}
