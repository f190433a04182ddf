"""Views that several queries start from, each as a DataFrame and as DuckDB SQL.

Motion sequences are derived from `embeddings`: 64 numbers are 8 frames of 4 joints. The other views
clean the domain tables: executions, stored pairs, groups of matrices, catalogs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespan.functions.labels import action_key, age_key, whole_number_key
from kinespan.operators.references import usable_pairs
from kinespan.plans.problems import action_sql, age_sql
from kinespan.sources.tables import table

#: The layout of the derived poses: joints, the two that stand for hips, the pairs that give the scale.
POSE_JOINTS, POSE_HIPS = 4, (2, 3)
POSE_TORSO = ((0, 1), (2, 3), (0, 2), (1, 3), (0, 3), (1, 2))
ABSENT = 0.10


def _segment(vec_id: Column) -> Column:
    return F.concat(F.lit("S"), F.lpad(vec_id.cast("string"), 5, "0"))


def pose(spark: SparkSession, folder: str) -> DataFrame:
    """`segment_id`, `frame`, `joint`, `x`, `y`, `confidence` from the embeddings."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), 7 - F.col("vec_id").cast("int") % 3)).alias("frame"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(POSE_JOINTS - 1))).alias("joint"))
    at = lambda i: F.get("embedding", F.col("frame") * 8 + F.col("joint") * 2 + i).cast("double") * 50
    v, f, j = F.col("vec_id"), F.col("frame"), F.col("joint")
    confidence = ((v * 7 + f * 3 + j * 11 + v * j * 5) % 23) / F.lit(23.0)
    return rows.select(_segment(v).alias("segment_id"), "frame", "joint", at(0).alias("x"), at(1).alias("y"), confidence.alias("confidence"))


POSE_SQL = """SELECT 'S' || lpad(CAST(vec_id AS VARCHAR), 5, '0') AS segment_id, CAST(f AS INT) AS frame, CAST(j AS INT) AS joint,
 CAST(embedding[f * 8 + j * 2 + 1] AS DOUBLE) * 50 AS x, CAST(embedding[f * 8 + j * 2 + 2] AS DOUBLE) * 50 AS y,
 ((vec_id * 7 + f * 3 + j * 11 + vec_id * j * 5) % 23) / 23.0::DOUBLE AS confidence
 FROM embeddings, range(8) t(f), range(4) u(j) WHERE f < 8 - vec_id % 3"""


def motion(spark: SparkSession, folder: str) -> DataFrame:
    """`segment_id`, `child`, `action`, `age`, `is_training`, `frames`: packed sequences with missing joints.

    Joints under a confidence of 0.10 are missing; every 17th segment lacks three joints in its third frame, which forces abstentions.
    """
    e = table(spark, folder, "embeddings")
    v = F.col("vec_id").cast("int")
    missing = lambda f, j: (((v * 7 + f * 3 + j * 11 + v * j * 5) % 23) / F.lit(23.0) < ABSENT) | ((v % 17 == 0) & (f == 2) & (j < 3))
    cell = lambda f, x: F.when(~missing(f, (x / 2).cast("int")), F.get("embedding", f * 8 + x).cast("double"))
    frames = F.transform(F.sequence(F.lit(0), 7 - v % 3), lambda f: F.transform(F.sequence(F.lit(0), F.lit(2 * POSE_JOINTS - 1)), lambda x: cell(f, x)))
    child = (v * 31) % 60
    ages = F.array(*map(F.lit, ("36_47mo", "48_59mo", "60_71mo", "72_83mo")))
    return e.select(
        _segment(F.col("vec_id")).alias("segment_id"), child.cast("string").alias("child"),
        F.concat(F.lit("A"), F.lpad((F.col("label") % 3 + 1).cast("string"), 2, "0")).alias("action"), F.get(ages, child % 4).alias("age"),
        (child % 10 < 7).alias("is_training"), frames.alias("frames"),
    )


MOTION_SQL = """SELECT 'S' || lpad(CAST(vec_id AS VARCHAR), 5, '0') AS segment_id, CAST((vec_id * 31) % 60 AS VARCHAR) AS child,
 'A' || lpad(CAST(label % 3 + 1 AS VARCHAR), 2, '0') AS action, ['36_47mo', '48_59mo', '60_71mo', '72_83mo'][((vec_id * 31) % 60) % 4 + 1] AS age,
 ((vec_id * 31) % 60) % 10 < 7 AS is_training,
 [[CASE WHEN NOT (((vec_id * 7 + f * 3 + (x // 2) * 11 + vec_id * (x // 2) * 5) % 23) / 23.0::DOUBLE < 0.1 OR (vec_id % 17 = 0 AND f = 2 AND x // 2 < 3))
  THEN CAST(embedding[f * 8 + x + 1] AS DOUBLE) END FOR x IN range(8)] FOR f IN range(8 - vec_id % 3)] AS frames FROM embeddings"""


def long_motion(spark: SparkSession, folder: str) -> DataFrame:
    """As `motion`, with 17 joints and 20 to 40 frames; a joint is missing where its hash says so."""
    e = table(spark, folder, "embeddings")
    v = F.col("vec_id").cast("int")
    missing = lambda f, j: (v * 7 + f * 3 + j * 11 + v * j * 5) % 23 < 2
    cell = lambda f, x: F.when(~missing(f, (x / 2).cast("int")), F.get("embedding", (f * 11 + x) % 64).cast("double"))
    frames = F.transform(F.sequence(F.lit(0), 19 + v % 21), lambda f: F.transform(F.sequence(F.lit(0), F.lit(33)), lambda x: cell(f, x)))
    return motion(spark, folder).drop("frames").join(e.select(_segment(F.col("vec_id")).alias("segment_id"), frames.alias("frames")), "segment_id")


_LATEST = ["recibido_en", "registrado_en", "excel_children", "action_code", "age_bin_12m_label"]
COVARIATES = ["institution_id", "excel_city", "camera_id", "pose2d_quality_label", "excel_sex"]
MANIFESTS = {"training": "manifiesto_entrenamiento", "validation": "manifiesto_validacion"}


def executions(spark: SparkSession, folder: str, which: str) -> DataFrame:
    """One row per execution of a manifest, of rows sent again the one received last: `segment_id`, `child`, `action`, `age`, covariates.

    Ties are settled by the remaining columns, so the result does not depend on the order of rows.
    """
    rows = table(spark, folder, MANIFESTS[which]).where("segment_id IS NOT NULL")
    rest = [*_LATEST, *COVARIATES, "duration_seconds", "age_months_final_excel"]
    last = rows.groupBy("segment_id").agg(F.max(F.struct(*rest)).alias("r")).select("segment_id", "r.*")
    return last.select(
        "segment_id", whole_number_key(F.col("excel_children")).alias("child"), F.col("excel_children").alias("child_text"), action_key(F.col("action_code")).alias("action"),
        age_key(F.col("age_bin_12m_label")).alias("age"), *COVARIATES, "duration_seconds", "age_months_final_excel",
    )


CHILD_SQL = r"""CASE WHEN regexp_matches({0}, '^\+?0*[1-9]\d*(\.0*)?$') THEN regexp_extract({0}, '^\+?0*([1-9]\d*)(\.0*)?$', 1)
 WHEN regexp_matches({0}, '^\+?(\d+\.?\d*|\.\d+)[eE][+-]?\d{{1,2}}$') AND TRY_CAST({0} AS DOUBLE) > 0 AND TRY_CAST({0} AS DOUBLE) = floor(TRY_CAST({0} AS DOUBLE))
 THEN CAST(CAST(TRY_CAST({0} AS DOUBLE) AS HUGEINT) AS VARCHAR) END"""
_PLAIN = r"translate(trim(excel_children, E' \t\r\n'), '０１２３４５６７８９', '0123456789')"


def executions_sql(which: str) -> str:
    """DuckDB's form of `executions`."""
    rest = [*_LATEST, *COVARIATES, "duration_seconds", "age_months_final_excel"]
    order = ", ".join(f"{c} DESC NULLS LAST" for c in rest)
    return f"""SELECT segment_id, {CHILD_SQL.format(_PLAIN)} AS child, excel_children AS child_text, {action_sql('action_code')} AS action, {age_sql('age_bin_12m_label')} AS age,
 {', '.join(COVARIATES)}, duration_seconds, age_months_final_excel FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY {order}) AS nr
 FROM {MANIFESTS[which]} WHERE segment_id IS NOT NULL) WHERE nr = 1"""


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Usable stored pairs by matrix: `part`, `segment_id_a`, `segment_id_b`, `distance`."""
    return usable_pairs(table(spark, folder, "dtw_pairwise"), ["part"])


PAIRS_SQL = """SELECT part, segment_id_a, segment_id_b, distance FROM (SELECT part, least(trim(segment_id_a), trim(segment_id_b)) AS segment_id_a,
 greatest(trim(segment_id_a), trim(segment_id_b)) AS segment_id_b, distance, row_number() OVER (PARTITION BY part, least(trim(segment_id_a), trim(segment_id_b)),
 greatest(trim(segment_id_a), trim(segment_id_b)) ORDER BY computed_at DESC NULLS LAST, distance DESC) AS nr FROM dtw_pairwise
 WHERE isfinite(distance) AND distance >= 0 AND trim(segment_id_a) <> trim(segment_id_b)) WHERE nr = 1"""
BOTH_SQL = f"""SELECT part, segment_id_a AS segment_id, segment_id_b AS other, distance FROM ({PAIRS_SQL})
 UNION ALL SELECT part, segment_id_b, segment_id_a, distance FROM ({PAIRS_SQL})"""


def part_groups(spark: SparkSession, folder: str) -> DataFrame:
    """`part`, `action`, `age` from the index, whichever entry of a part names them."""
    index = table(spark, folder, "dtw_pairwise_index").where("part IS NOT NULL")
    return index.groupBy("part").agg(F.min(action_key(F.col("action_code"))).alias("action"), F.min(age_key(F.col("age_bin_12m_label"))).alias("age"))


PART_GROUPS_SQL = f"SELECT part, min({action_sql('action_code')}) AS action, min({age_sql('age_bin_12m_label')}) AS age FROM dtw_pairwise_index WHERE part IS NOT NULL GROUP BY part"


def topk(spark: SparkSession, folder: str) -> DataFrame:
    """The stored catalog, each row once: `action`, `age`, `part`, `segment_id`, `rank`, `child`; rows without segment or group left out."""
    rows = table(spark, folder, "catalogo_topk")
    found = rows.select(
        action_key(F.col("action_code")).alias("action"), age_key(F.col("age_bin_12m_label")).alias("age"), "part", "segment_id", F.col("rank").cast("int").alias("rank"),
        whole_number_key(F.col("excel_children")).alias("child"),
    )
    return found.where("action IS NOT NULL AND age IS NOT NULL AND segment_id IS NOT NULL").groupBy("action", "age", "part", "segment_id").agg(F.min("rank").alias("rank"), F.min("child").alias("child"))


TOPK_SQL = f"""SELECT action, age, part, segment_id, min(rank) AS rank, min(child) AS child FROM (SELECT {action_sql('action_code')} AS action, {age_sql('age_bin_12m_label')} AS age, part,
 segment_id, rank, {CHILD_SQL.format(_PLAIN)} AS child FROM catalogo_topk) WHERE action IS NOT NULL AND age IS NOT NULL AND segment_id IS NOT NULL GROUP BY ALL"""


def primaries(spark: SparkSession, folder: str) -> DataFrame:
    """The stored primaries: `action`, `age`, `medoid_segment_id`."""
    rows = table(spark, folder, "catalogo_primarias")
    return rows.select(F.col("action_code").alias("action"), F.col("age_bin_12m_label").alias("age"), "medoid_segment_id")


PRIMARIES_SQL = "SELECT action_code AS action, age_bin_12m_label AS age, medoid_segment_id FROM catalogo_primarias"


def training_children(spark: SparkSession, folder: str) -> DataFrame:
    """`segment_id`, `child` of the training executions, for grouping segments by child."""
    from kinespan.functions.labels import child_or_unknown

    return executions(spark, folder, "training").select("segment_id", F.coalesce("child", child_or_unknown(F.lit(None).cast("string"), F.col("segment_id"))).alias("child"))


CHILDREN_SQL = f"SELECT segment_id, coalesce(child, 'desconocido::' || segment_id) AS child FROM ({executions_sql('training')})"


def _further_pick(rank: int) -> str:
    """SQL of one further pick, from `pool`, `links`, `sizes` and the picks so far in p1..p{rank - 1}."""
    so_far = " UNION ALL ".join(f"SELECT part, segment_id, child FROM p{i}" for i in range(1, rank))
    return f"""p{rank} AS MATERIALIZED (SELECT part, segment_id, child, m, {rank} AS rank, ['p25', 'p20', 'p10'][step] AS threshold_used FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY step, m, segment_id, child) AS nr FROM (
 SELECT o.*, CASE WHEN round(away, 9) >= round(q[1], 9) THEN 1 WHEN round(away, 9) >= round(q[2], 9) THEN 2 WHEN round(away, 9) >= round(q[3], 9) THEN 3 END AS step FROM pool o JOIN sizes USING (part)
 JOIN (SELECT l.part, l.segment_id, min(distance) AS away FROM links l JOIN ({so_far}) c ON l.part = c.part AND l.other = c.segment_id GROUP BY l.part, l.segment_id) a USING (part, segment_id)
 WHERE k_requested >= {rank} AND part IN (SELECT part FROM p{rank - 1}) AND (part, child) NOT IN (SELECT part, child FROM ({so_far}))) WHERE step IS NOT NULL) WHERE nr = 1)"""


def diverse_sql(pairs: str, children: str) -> str:
    """The head of a DuckDB query whose `found` is `diverse_references` of `pairs` (`part`, `segment_id_a`, `segment_id_b`, `distance`), the means unrounded."""
    both = f"SELECT part, segment_id_a AS segment_id, segment_id_b AS other, distance FROM ({pairs}) UNION ALL SELECT part, segment_id_b, segment_id_a, distance FROM ({pairs})"
    return f"""WITH links AS MATERIALIZED ({both}), pool AS MATERIALIZED (SELECT part, c.segment_id, round(m, 9) AS m, coalesce(child, 'desconocido::' || c.segment_id) AS child FROM (
  SELECT part, segment_id, avg(distance) AS m FROM links GROUP BY part, segment_id) c LEFT JOIN ({children}) k ON c.segment_id = k.segment_id),
 sizes AS MATERIALIZED (SELECT part, n_group_clips, n_group_children, CASE WHEN n_group_children < 5 THEN 1 WHEN n_group_children < 10 THEN 2 WHEN n_group_children < 20 THEN 3 ELSE 4 END AS k_requested, q
  FROM (SELECT part, count(*) AS n_group_clips, count(DISTINCT child) AS n_group_children FROM pool GROUP BY part)
  JOIN (SELECT part, quantile_cont(distance, [0.25, 0.2, 0.1]) AS q FROM ({pairs}) GROUP BY part) USING (part)),
 p1 AS MATERIALIZED (SELECT part, segment_id, child, m, 1 AS rank, 'primaria' AS threshold_used FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY m, segment_id) AS nr FROM pool) WHERE nr = 1),
 {_further_pick(2)}, {_further_pick(3)}, {_further_pick(4)},
 found AS (SELECT part, segment_id, CAST(rank AS INT) AS rank, child, m, k_requested, threshold_used, n_group_clips, n_group_children FROM (
 SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4) JOIN sizes USING (part))"""
