"""Checks before a study: what its inputs lack, and whether they stayed as they were."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespan.operators.references import centrality, medoids


def violations(name: str, rows: DataFrame, where: Column | str | None = None) -> DataFrame:
    """`check`, `n_violations`: how many rows there are, or how many of them meet `where`."""
    met = rows if where is None else rows.where(where)
    return met.agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("check"), "n_violations")


def preflight(manifest: DataFrame, index: DataFrame, pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Checks of the inputs of a study, each with its violations; a study may start when all are 0.

    `manifest`: `segment_id`, `child`, `action`, `age`; `index`: `part`, `action`, `age`; `pairs`: `part`,
    `segment_id_a`, `segment_id_b`, `distance`; `catalog`: `part`, `segment_id`, `rank`.
    """
    ends = pairs.select("part", F.explode(F.array("segment_id_a", "segment_id_b")).alias("segment_id")).distinct()
    known = manifest.select("segment_id").distinct()
    parts = pairs.select("part").distinct()
    firsts = catalog.where("rank = 1").select("part", "segment_id").distinct()
    found = medoids(centrality(pairs, ["part"]), ["part"])
    return reduce(DataFrame.unionByName, [
        violations("execution_repeated", manifest.groupBy("segment_id").count(), "count > 1"),
        violations("execution_without_child", manifest, "child IS NULL"),
        violations("execution_without_group", manifest, "action IS NULL OR age IS NULL"),
        violations("index_part_without_group", index, "action IS NULL OR age IS NULL"),
        violations("index_part_without_pairs", index.select("part").distinct().join(parts, "part", "left_anti")),
        violations("pairs_without_index", parts.join(index, "part", "left_anti")),
        violations("segment_outside_manifest", ends.join(known, "segment_id", "left_anti")),
        violations("reference_outside_matrix", catalog.select("part", "segment_id").distinct().join(ends, ["part", "segment_id"], "left_anti")),
        violations("matrix_without_first_reference", parts.join(firsts, "part", "left_anti")),
        violations("first_reference_is_not_the_medoid", firsts.join(found, "part"), "segment_id <> medoid_segment_id"),
    ])


def integrity(before: DataFrame, after: DataFrame, expected: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """`key`, the three digests, `unchanged`, `as_expected` of every input that any side names; an absent one is neither."""
    side = lambda df, name: df.select(key, F.col(digest).alias(name))
    met = side(before, "before").join(side(after, "after"), key, "full").join(side(expected, "expected"), key, "full")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return met.withColumns({"unchanged": same("before", "after"), "as_expected": same("after", "expected")})


def raise_on_violations(checks: DataFrame) -> None:
    """ValueError naming the checks that are not 0."""
    bad = checks.where("n_violations > 0").orderBy("check").collect()
    if bad:
        raise ValueError("; ".join(f"{r['check']}: {r['n_violations']}" for r in bad))
