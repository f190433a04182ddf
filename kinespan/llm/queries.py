"""Registered queries of the operators for training data, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespan.functions.labels import action_key, age_key, whole_number_key
from kinespan.llm import consensus as agreeing
from kinespan.llm import languages, mixing, quantiles, splits, tokens
from kinespan.plans.problems import SQL as CORE_SQL
from kinespan.plans.problems import action_sql, present_reviews
from kinespan.sources.tables import table
from kinespan.workspace import written

# ---- 1: splits that keep related records together


def _executions(spark: SparkSession, folder: str) -> DataFrame:
    """Both manifests with the component of each row."""
    both = None
    for name, short in (("manifiesto_entrenamiento", "training"), ("manifiesto_validacion", "validation")):
        rows = table(spark, folder, name).withColumn("manifest", F.lit(short))
        both = rows if both is None else both.unionByName(rows)
    return splits.components(both, F.col("segment_id"), whole_number_key(F.col("excel_children")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Executions of the validation manifest that are tied to a training row."""
    rows = written(_executions(spark, folder).select("segment_id", "component", "manifest").distinct(), "executions")
    tied = rows.where("manifest = 'training'").select("component").distinct()
    return rows.where("manifest = 'validation' AND segment_id IS NOT NULL").join(tied, "component", "left_semi").select("segment_id").distinct()


def _proportions(spark: SparkSession, folder: str) -> list[tuple[str, float]]:
    return [(r["split_name"], r["proportion"]) for r in table(spark, folder, "proporciones_particion").orderBy("split_name").collect()]


def _action_and_age() -> Column:
    return F.concat_ws("|", F.coalesce(action_key(F.col("action_code")), F.lit("?")), F.coalesce(age_key(F.col("age_bin_12m_label")), F.lit("?")))


def p1_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of both manifests with its component and its new split."""
    rows = written(_executions(spark, folder).select("manifest", "segment_id", "excel_children", "action_code", "age_bin_12m_label", "component"), "executions")
    return splits.stratified_splits(rows, "component", _action_and_age(), _proportions(spark, folder))


def p1_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of all rows that every split reached, and how far the labels' shares are off."""
    return splits.reached_splits(p1_assignment(spark, folder), _action_and_age(), _proportions(spark, folder))


# ---- 3: percentiles

WANTED = [0.01, 0.10, 0.25, 0.50, 0.75, 0.90, 0.99]


#: Parts of which the actions are broadcast; with more, only rows without an action of their own are joined.
BROADCAST_PARTS = 100_000


def _distances(spark: SparkSession, folder: str) -> DataFrame:
    """`action`, usable `distance`, `day` of every stored row; the action from the index where the row has none."""
    index = written(table(spark, folder, "dtw_pairwise_index").groupBy("part").agg(F.min(action_key(F.col("action_code"))).alias("of_part")), "parts")
    pairs = table(spark, folder, "dtw_pairwise").where("distance >= 0").select(action_key(F.col("action_code")).alias("own"), "part", "distance", F.to_date("computed_at").alias("day"))
    if index.count() <= BROADCAST_PARTS:
        return pairs.join(F.broadcast(index), "part", "left").select(F.coalesce("own", "of_part").alias("action"), "distance", "day")
    named = pairs.where("own IS NOT NULL").select(F.col("own").alias("action"), "distance", "day")
    return named.unionByName(pairs.where("own IS NULL").join(index, "part").select(F.col("of_part").alias("action"), "distance", "day"))


def _percentiles(spark: SparkSession, folder: str, by_day: bool) -> DataFrame:
    day = F.col("day") if by_day else None
    found = quantiles.percentiles(_distances(spark, folder), F.col("action"), F.col("distance"), WANTED, day)
    return found.select(F.col("grp").alias("action_code"), "percentile", F.round("value", 6).alias("value"), "n_values")


def p3_action_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Seven exact percentiles of the usable distances of every action."""
    return _percentiles(spark, folder, False)


def p3_percentiles_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """The same, every pass counting each day apart and then combining the days' counts."""
    return _percentiles(spark, folder, True)


# ---- 5: consensus

STATUSES = ["PASS", "REVIEW", "FAIL"]


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return present_reviews(spark, folder).select("reviewer_id", "reference_id", "final_status")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The consensus status of every reference with present rows of at least three reviewers."""
    labels = _labels(spark, folder)
    enough = labels.groupBy("reference_id").agg(F.count("*").alias("n")).where("n >= 3").select(F.col("reference_id").alias("item"))
    items, _ = agreeing.consensus(labels, "reference_id", "reviewer_id", "final_status", STATUSES)
    return items.join(enough, "item", "left_semi").select(F.col("item").alias("reference_id"), F.col("label").alias("final_status"))


def p5_items(spark: SparkSession, folder: str) -> DataFrame:
    """Consensus, confidence and agreement of every reference."""
    items, _ = agreeing.consensus(_labels(spark, folder), "reference_id", "reviewer_id", "final_status", STATUSES)
    return items.withColumnRenamed("item", "reference_id")


def p5_reviewers(spark: SparkSession, folder: str) -> DataFrame:
    """The reliability of every reviewer."""
    _, annotators = agreeing.consensus(_labels(spark, folder), "reference_id", "reviewer_id", "final_status", STATUSES)
    return annotators.withColumnRenamed("annotator", "reviewer_id")


def p5_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Krippendorff's alpha of the present reviews."""
    return agreeing.krippendorff_alpha(_labels(spark, folder), "reference_id", "reviewer_id", "final_status").withColumn("alpha", F.round("alpha", 6))


# ---- 6: tokens


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.token_ids(_documents(spark, folder), "text", ["doc_id"])


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text as its ids give it back: exact, with an empty text for null."""
    return p6_ids(spark, folder).select("doc_id", tokens.texts_of(spark, F.col("ids")).alias("text"))


# ---- 7: mixing


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, folder, "mezcla_objetivo")
    counted = tokens.token_counts(_documents(spark, folder), "text", ["doc_id", "source"])
    sized = written(mixing.sized_documents(counted, targets), "sized")
    return sized, mixing.budgets(sized, targets)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that cannot reach their share: those of which the draw took all it may and is short."""
    sized, budget = _mixture(spark, folder)
    return mixing.reached_shares(mixing.draw(sized, budget), budget).where("short").select("source")


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Every drawn document and how often it is taken."""
    sized, budget = _mixture(spark, folder)
    return mixing.draw(sized, budget)


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares wished for and reached."""
    sized, budget = _mixture(spark, folder)
    return mixing.reached_shares(mixing.draw(sized, budget), budget).drop("exhausted", "short")


# ---- 8: languages


def _inferred(spark: SparkSession, folder: str) -> DataFrame:
    documents = _documents(spark, folder)
    return languages.languages_of(documents, ["doc_id", "lang"], "text", languages.fitted_model(documents))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Languages in which a document has enough prose and which its label does not name."""
    each = _inferred(spark, folder).select("doc_id", "lang", F.explode("languages").alias("l")).where(F.col("l.n_words") >= languages.LEAST_WORDS)
    unnamed = ~F.array_contains(languages.named_languages(F.col("lang")), F.col("l.lang"))
    return each.where(unnamed).select("doc_id", F.col("l.lang").alias("lang"))


def p8_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The main language of every document and how sure it is."""
    return languages.main_language(_inferred(spark, folder)).drop("lang")


def p8_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every stretch of prose with its language."""
    return _inferred(spark, folder).select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.*")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_assignment, p1_shares, p3_action_percentiles, p3_percentiles_by_day, p5_found, p5_items, p5_reviewers, p5_agreement,
        p6_ids, p6_round_trip, p7_found, p7_mixture, p7_shares, p8_found, p8_documents, p8_segments,
    )
}

_CHILD = r"""CASE WHEN regexp_matches(t, '^\+?0*[1-9]\d*(\.0*)?$') THEN regexp_extract(t, '^\+?0*([1-9]\d*)(\.0*)?$', 1)
 WHEN regexp_matches(t, '^\+?(\d+\.?\d*|\.\d+)[eE][+-]?\d{1,2}$') AND TRY_CAST(t AS DOUBLE) > 0 AND TRY_CAST(t AS DOUBLE) = floor(TRY_CAST(t AS DOUBLE)) THEN CAST(CAST(TRY_CAST(t AS DOUBLE) AS HUGEINT) AS VARCHAR) END"""
_BOTH = " UNION ALL ".join(
    f"SELECT '{m}' AS manifest, segment_id, translate(trim(excel_children, E' \\t\\r\\n'), '０１２３４５６７８９', '0123456789') AS t FROM {t}"
    for m, t in (("training", "manifiesto_entrenamiento"), ("validation", "manifiesto_validacion"))
)
_DISTANCES = f"""SELECT coalesce(p.a, i.a) AS action_code, distance FROM (SELECT {action_sql('action_code')} AS a, part, distance FROM dtw_pairwise) p
 LEFT JOIN (SELECT part, min({action_sql('action_code')}) AS a FROM dtw_pairwise_index GROUP BY part) i USING (part)
 WHERE isfinite(distance) AND distance >= 0"""
_PERCENTILES = f"""SELECT action_code, percentile, round(value, 6) AS value, n_values FROM (SELECT action_code, unnest({WANTED}::DOUBLE[]) AS percentile,
 unnest(quantile_cont(distance, {WANTED})) AS value, count(*) AS n_values FROM ({_DISTANCES}) WHERE action_code IS NOT NULL GROUP BY action_code)"""

SQL = {
    "p1_found": f"""WITH RECURSIVE r AS MATERIALIZED (SELECT manifest, segment_id, {_CHILD} AS child FROM ({_BOTH})),
 e AS MATERIALIZED (SELECT DISTINCT 's' || segment_id AS s, 'c' || child AS c FROM r WHERE segment_id IS NOT NULL AND child IS NOT NULL),
 links AS MATERIALIZED (SELECT s AS a, c AS b FROM e UNION ALL SELECT c, s FROM e),
 reached AS (SELECT 's' || segment_id AS n FROM r WHERE manifest = 'training' AND segment_id IS NOT NULL
  UNION SELECT 'c' || child FROM r WHERE manifest = 'training' AND child IS NOT NULL
  UNION SELECT b FROM reached JOIN links ON a = n)
 SELECT DISTINCT segment_id FROM r WHERE manifest = 'validation' AND segment_id IS NOT NULL
  AND ('s' || segment_id IN (SELECT n FROM reached) OR 'c' || child IN (SELECT n FROM reached))""",
    "p3_action_percentiles": _PERCENTILES,
    "p3_percentiles_by_day": _PERCENTILES,
    "p5_agreement": f"""WITH l AS (SELECT DISTINCT reference_id AS i, reviewer_id AS a, final_status AS l FROM ({CORE_SQL['p4_found']}) WHERE final_status IS NOT NULL),
 c AS (SELECT i, l, count(*) AS n FROM l GROUP BY i, l), t AS (SELECT i, sum(n) AS n, sum(n * n) AS q FROM c GROUP BY i HAVING sum(n) > 1),
 o AS (SELECT count(*) AS n_items, CAST(sum(n) AS BIGINT) AS n_labels, sum((n * n - q) / (n - 1)) AS d FROM t),
 k AS (SELECT sum(m * m) AS q FROM (SELECT sum(n) AS m FROM c WHERE i IN (SELECT i FROM t) GROUP BY l))
 SELECT n_items, n_labels, round(1 - d / ((n_labels * n_labels - q) / (n_labels - 1)), 6) AS alpha FROM o, k""",
    "p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
