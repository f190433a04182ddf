"""Queries of templates, over the stored matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespan.operators import packed_trials
from kinespan.operators import templates as T
from kinespan.plans import views
from kinespan.plans.groups import _shown, _up
from kinespan.plans.views import CHILDREN_SQL, PAIRS_SQL
from kinespan.workspace import written

PART = ["part"]


def _distances(spark: SparkSession, folder: str, complete: bool = True) -> DataFrame:
    """Ordered pairs of the clips of every matrix with their children: of those that have all their distances, as the SQL has it, or of every clip."""
    pairs = written(views.pairs(spark, folder), "pairs")
    clips = (T.complete_clips if complete else T.every_clip)(pairs, PART).join(views.training_children(spark, folder), "segment_id", "left")
    clips = clips.withColumn("child", F.coalesce("child", F.concat(F.lit("desconocido::"), F.col("segment_id"))))
    return written(T.clip_distances(pairs, clips, PART), "distances")


def template_clips_left_out(spark: SparkSession, folder: str) -> DataFrame:
    """Clips and pairs of every matrix, and how many of them the queries with `complete_clips` work on."""
    return T.clips_left_out(written(views.pairs(spark, folder), "pairs"), PART)


def group_scales(spark: SparkSession, folder: str) -> DataFrame:
    """Median distances between and within the children of every matrix."""
    found = T.group_scales(_distances(spark, folder), PART)
    return found.select("part", _shown("between").alias("between"), _shown("within").alias("within"))


def cost_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Mean distance of every child to every candidate clip."""
    return T.cost_matrix(_distances(spark, folder), PART).withColumn("cost", _shown("cost"))


def pmedian_k1(spark: SparkSession, folder: str) -> DataFrame:
    """The best single template of every matrix."""
    cost = written(T.cost_matrix(_distances(spark, folder), PART), "cost")
    found = T.solved_templates(cost, PART, 1, starts=1)
    value = T.objectives(cost, found, PART)
    return found.join(value, "part").select("part", "candidate", "candidate_child", _shown("objective").alias("objective"))


def pmedian_greedy2(spark: SparkSession, folder: str) -> DataFrame:
    """Two templates of every matrix, picked greedily."""
    cost = written(T.cost_matrix(_distances(spark, folder), PART), "cost")
    return T.greedy_templates(cost, PART, 2).select("part", "slot", "candidate", "candidate_child")


def pmedian_k3(spark: SparkSession, folder: str) -> DataFrame:
    """Three templates of every matrix, over all its clips: greedy and four random starts, refined by swaps."""
    small, large = packed_trials.packed_matrices(_distances(spark, folder, complete=False), PART)
    found = packed_trials.solved_templates(small, PART, 3)
    if not large.isEmpty():
        cost = written(T.filled_costs(T.cost_matrix(large, PART), PART), "cost")
        long = T.solved_templates(cost, PART, 3)
        found = found.unionByName(long.join(T.objectives(cost, long, PART).drop("ids"), "part"))
    return found.withColumn("objective", _shown("objective"))


def _two(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    distances = _distances(spark, folder)
    cost = written(T.cost_matrix(distances, PART), "cost")
    return distances, written(T.greedy_templates(cost, PART, 2), "two")


def template_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every child's template among the two greedy ones of its matrix."""
    distances, two = _two(spark, folder)
    found = T.assignments(distances, two, PART)
    return found.withColumns({c: _shown(c) for c in ("loss", "clip_loss", "margin", "consistency")})


def template_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Losses and ambiguous children of every matrix."""
    distances, two = _two(spark, folder)
    found = T.assignment_summary(T.assignments(distances, two, PART), T.group_scales(distances, PART), PART)
    return found.withColumns({c: _shown(c) for c in ("loss_mean", "loss_median", "loss_p90", "ambiguous_share")})


def template_support(spark: SparkSession, folder: str) -> DataFrame:
    """Children of each of the two greedy templates."""
    distances, two = _two(spark, folder)
    return T.support(T.assignments(distances, two, PART), two, PART)


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The two greedy templates of every matrix, and its two clips with the least ids of different children."""
    distances, two = _two(spark, folder)
    first = distances.groupBy("part", "child").agg(F.min("segment_id").alias("candidate"))
    lists = first.groupBy("part").agg(F.slice(F.array_sort(F.collect_list("candidate")), 1, 2).alias("c")).where(F.size("c") == 2)
    return distances, two, lists.select("part", F.posexplode("c").alias("slot", "candidate"))


def set_geometry(spark: SparkSession, folder: str) -> DataFrame:
    """How far the greedy pair of every matrix lies from the pair with the least ids."""
    distances, two, other = _sides(spark, folder)
    found = T.set_geometry(two, other, distances, PART, 2)
    names = ("match_mean", "match_max", "hausdorff", "nearest_mean")
    return found.select("part", F.array_join(F.col("mapping").cast("array<string>"), "").alias("mapping"), *[_shown(c).alias(c) for c in names])


def set_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Shared ids, and templates within half the between scale, of the same two pairs."""
    distances, two, other = _sides(spark, folder)
    of = lambda df, name: df.groupBy("part").agg(F.collect_list("candidate").alias(name))
    scales = T.group_scales(distances, PART).select("part", (F.col("between") * 0.5).alias("_limit"))
    with_limit = distances.join(scales, "part").withColumn("distance", F.col("distance") - F.col("_limit"))
    near = T.near_overlap(two, other, with_limit, PART, F.lit(0.0))
    return of(two, "l").join(of(other, "r"), "part").join(near, "part").select("part", _shown_of(T.set_overlap(F.col("l"), F.col("r"))).alias("jaccard"), _shown("near_overlap").alias("near_overlap"))


def _shown_of(c):
    return F.floor((c + 3e-8) * 1e6 + 0.5) / 1e6


def assignment_rand(spark: SparkSession, folder: str) -> DataFrame:
    """Adjusted Rand index of the children's templates under both pairs."""
    distances, two, other = _sides(spark, folder)
    a = T.assignments(distances, two, PART).select("part", "child", F.col("slot").alias("left"))
    b = T.assignments(distances, other, PART).select("part", "child", F.col("slot").alias("right"))
    return T.adjusted_rand(a.join(b, ["part", "child"]), PART).withColumn("ari", _shown("ari"))


QUERIES = {
    f.__name__: f
    for f in (
        template_clips_left_out, group_scales, cost_matrix, pmedian_k1, pmedian_greedy2, pmedian_k3, template_assignment, template_summary, template_support, set_geometry, set_overlap, assignment_rand,
    )
}

_HEAD = f"""WITH pairs AS MATERIALIZED ({PAIRS_SQL}), ends AS MATERIALIZED (SELECT part, segment_id_a AS segment_id, segment_id_b AS candidate, distance FROM pairs
 UNION ALL SELECT part, segment_id_b, segment_id_a, distance FROM pairs),
 per AS (SELECT part, segment_id, count(*) AS n FROM ends GROUP BY ALL),
 clips AS MATERIALIZED (SELECT p.part, p.segment_id, coalesce(k.child, 'desconocido::' || p.segment_id) AS child FROM per p JOIN (SELECT part, count(*) AS size FROM per GROUP BY part) z
  ON p.part = z.part AND n = size - 1 LEFT JOIN ({CHILDREN_SQL}) k ON k.segment_id = p.segment_id),
 d AS MATERIALIZED (SELECT e.part, e.segment_id, a.child, e.candidate, b.child AS candidate_child, distance FROM (SELECT * FROM ends UNION ALL SELECT part, segment_id, segment_id, 0.0 FROM clips) e
  JOIN clips a ON a.part = e.part AND a.segment_id = e.segment_id JOIN clips b ON b.part = e.part AND b.segment_id = e.candidate),
 cost AS MATERIALIZED (SELECT part, child, candidate, candidate_child, avg(distance) AS cost FROM d GROUP BY ALL),
 scales AS MATERIALIZED (SELECT part, median(m) FILTER (a <> b) AS between_, median(m) FILTER (a = b) AS within_ FROM (SELECT part, least(child, candidate_child) AS a,
  greatest(child, candidate_child) AS b, median(distance) AS m FROM d WHERE segment_id < candidate GROUP BY ALL) GROUP BY part),
 one AS MATERIALIZED (SELECT part, candidate, candidate_child, v FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY round(v, 9), candidate) AS nr FROM (
  SELECT part, candidate, candidate_child, avg(cost) AS v FROM cost GROUP BY ALL)) WHERE nr = 1),
 second AS MATERIALIZED (SELECT part, candidate, candidate_child FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY round(v, 9), candidate) AS nr FROM (
  SELECT c.part, c.candidate, c.candidate_child, avg(least(c.cost, b.cost)) AS v FROM cost c JOIN one o ON o.part = c.part AND o.candidate_child <> c.candidate_child
  JOIN cost b ON b.part = c.part AND b.child = c.child AND b.candidate = o.candidate GROUP BY ALL)) WHERE nr = 1),
 two AS MATERIALIZED (SELECT part, 0 AS slot, candidate, candidate_child FROM one UNION ALL SELECT part, 1, candidate, candidate_child FROM second),
 other AS MATERIALIZED (SELECT part, CAST(nr - 1 AS INT) AS slot, candidate FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY candidate) AS nr, count(*) OVER (PARTITION BY part) AS n FROM (
  SELECT part, child, min(segment_id) AS candidate FROM d GROUP BY ALL)) WHERE nr <= 2 AND n >= 2)"""


def _assigned(name: str, templates: str) -> str:
    return f"""{name}_m AS MATERIALIZED (SELECT d.part, child, segment_id, slot, d.candidate, distance FROM d JOIN {templates} t ON t.part = d.part AND t.candidate = d.candidate),
 {name}_c AS (SELECT part, child, segment_id, min(distance) AS near, arg_min(slot, [distance, slot]) AS s FROM {name}_m GROUP BY ALL),
 {name}_k AS (SELECT part, child, slot, candidate, avg(distance) AS c FROM {name}_m GROUP BY ALL),
 {name}_o AS (SELECT part, child, slot, candidate, c, lead(c) OVER w - c AS margin, row_number() OVER w AS nr FROM {name}_k WINDOW w AS (PARTITION BY part, child ORDER BY c, slot)),
 {name} AS MATERIALIZED (SELECT o.part, o.child, o.candidate AS template, o.slot, o.c AS loss, avg(near) AS clip_loss, o.margin, avg(CASE WHEN s = o.slot THEN 1.0 ELSE 0.0 END) AS consistency
  FROM {name}_o o JOIN {name}_c c ON c.part = o.part AND c.child = o.child WHERE nr = 1 GROUP BY ALL)"""


_A = _assigned("a", "two")
_CROSS = "x AS MATERIALIZED (SELECT t.part, t.slot AS i, o.slot AS j, t.candidate AS ti, o.candidate AS oj, distance FROM two t JOIN other o ON o.part = t.part JOIN d ON d.part = t.part AND d.segment_id = t.candidate AND d.candidate = o.candidate)"
_M = "(SELECT part, max(distance) FILTER (i = 0 AND j = 0) AS p, max(distance) FILTER (i = 0 AND j = 1) AS q, max(distance) FILTER (i = 1 AND j = 0) AS r, max(distance) FILTER (i = 1 AND j = 1) AS s FROM x GROUP BY part HAVING count(*) = 4)"

SQL = {
    "template_clips_left_out": f"""{_HEAD}, p AS (SELECT part, count(*) AS n FROM pairs GROUP BY part), c AS (SELECT part, count(*) AS n FROM clips GROUP BY part),
 i AS (SELECT p.part, count(*) AS n FROM pairs p JOIN clips a ON a.part = p.part AND a.segment_id = p.segment_id_a JOIN clips b ON b.part = p.part AND b.segment_id = p.segment_id_b GROUP BY p.part),
 s AS (SELECT part, count(*) AS n FROM per GROUP BY part)
 SELECT s.part, s.n AS n_clips, coalesce(c.n, 0) AS n_complete, p.n AS n_pairs, coalesce(i.n, 0) AS n_complete_pairs FROM s JOIN p USING (part) LEFT JOIN c USING (part) LEFT JOIN i USING (part)""",
    "group_scales": f"{_HEAD} SELECT part, {_up('between_')} AS between, {_up('within_')} AS within FROM scales".replace(" AS between,", ' AS "between",'),
    "cost_matrix": f"{_HEAD} SELECT part, child, candidate, candidate_child, {_up('cost')} AS cost FROM cost",
    "pmedian_k1": f"{_HEAD} SELECT part, candidate, candidate_child, {_up('v')} AS objective FROM one",
    "pmedian_greedy2": f"{_HEAD} SELECT * FROM two",
    "template_assignment": f"{_HEAD}, {_A} SELECT part, child, template, slot, {', '.join(f'{_up(c)} AS {c}' for c in ('loss', 'clip_loss', 'margin', 'consistency'))} FROM a",
    "template_summary": f"""{_HEAD}, {_A} SELECT part, count(*) AS n_children, {_up('avg(loss)')} AS loss_mean, {_up('median(loss)')} AS loss_median, {_up('quantile_cont(loss, 0.9)')} AS loss_p90,
 {_up('avg(CASE WHEN margin <= 0.05 * between_ THEN 1.0 ELSE 0.0 END)')} AS ambiguous_share FROM a LEFT JOIN scales USING (part) GROUP BY part""",
    "template_support": f"""{_HEAD}, {_A}, z AS (SELECT part, count(*) AS n FROM a GROUP BY part)
 SELECT t.part, t.slot, t.candidate, count(a.child) AS n_assigned, CAST(greatest(5, ceil(round(n * 0.15, 9))) AS INT) AS minimum, count(a.child) >= greatest(5, ceil(round(n * 0.15, 9))) AS supported
 FROM two t JOIN z ON z.part = t.part LEFT JOIN a ON a.part = t.part AND a.slot = t.slot GROUP BY t.part, t.slot, t.candidate, n""",
    "set_geometry": f"""{_HEAD}, {_CROSS} SELECT part, CASE WHEN round(p + s, 12) <= round(q + r, 12) THEN '01' ELSE '10' END AS mapping,
 {_up('CASE WHEN round(p + s, 12) <= round(q + r, 12) THEN p + s ELSE q + r END / 2')} AS match_mean, {_up('CASE WHEN round(p + s, 12) <= round(q + r, 12) THEN greatest(p, s) ELSE greatest(q, r) END')} AS match_max,
 {_up('greatest(least(p, q), least(r, s), least(p, r), least(q, s))')} AS hausdorff, {_up('(least(p, q) + least(r, s) + least(p, r) + least(q, s)) / 4')} AS nearest_mean FROM {_M}""",
    "set_overlap": f"""{_HEAD}, {_CROSS}, l AS (SELECT part, list(candidate) AS l FROM two GROUP BY part), r AS (SELECT part, list(candidate) AS r FROM other GROUP BY part),
 n AS (SELECT part, (avg(CASE WHEN least(p, q) <= h THEN 1.0 ELSE 0 END) + avg(CASE WHEN least(s, r) <= h THEN 1.0 ELSE 0 END) + avg(CASE WHEN least(p, r) <= h THEN 1.0 ELSE 0 END) + avg(CASE WHEN least(q, s) <= h THEN 1.0 ELSE 0 END)) / 4 AS v
  FROM {_M} JOIN (SELECT part, between_ * 0.5 AS h FROM scales) USING (part) GROUP BY part)
 SELECT part, {_up('len(list_intersect(l, r))::DOUBLE / len(list_distinct(list_concat(l, r)))')} AS jaccard, {_up('v')} AS near_overlap FROM l JOIN r USING (part) JOIN n USING (part)""",
    "assignment_rand": f"""{_HEAD}, {_A}, {_assigned('b', 'other')}, m AS (SELECT a.part, a.child, a.slot AS l, b.slot AS r FROM a JOIN b USING (part, child)),
 c AS (SELECT part, sum(n * (n - 1) / 2) AS c, sum(n) AS n FROM (SELECT part, l, r, count(*) AS n FROM m GROUP BY ALL) GROUP BY part),
 s AS (SELECT part, sum(n * (n - 1) / 2) AS s FROM (SELECT part, l, count(*) AS n FROM m GROUP BY ALL) GROUP BY part), t AS (SELECT part, sum(n * (n - 1) / 2) AS t FROM (SELECT part, r, count(*) AS n FROM m GROUP BY ALL) GROUP BY part),
 v AS (SELECT part, n, c, CASE WHEN n > 1 THEN s * t / (n * (n - 1) / 2) ELSE 0 END AS e, (s + t) / 2 AS top FROM c JOIN s USING (part) JOIN t USING (part))
 SELECT part, CAST(n AS BIGINT) AS n, {_up('CASE WHEN abs(top - e) < 1e-12 THEN 1.0 ELSE (c - e) / (top - e) END')} AS ari FROM v""",
}
