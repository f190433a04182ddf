import pytest
from pyspark.sql import functions as F

from kinespan.operators import checks, study
from kinespan.operators import templates as T


def test_preflight_one_violation_at_a_time(spark):
    manifest = spark.createDataFrame([(s, c, "A01", "36_47mo") for s, c in zip("abc", "123")], "segment_id string, child string, action string, age string")
    index = spark.createDataFrame([("p", "A01", "36_47mo")], "part string, action string, age string")
    pairs = spark.createDataFrame([("p", "a", "b", 1.0), ("p", "a", "c", 1.0), ("p", "b", "c", 2.0)], "part string, segment_id_a string, segment_id_b string, distance double")
    catalog = spark.createDataFrame([("p", "a", 1)], "part string, segment_id string, rank int")
    good = dict(manifest=manifest, index=index, pairs=pairs, catalog=catalog)
    of = lambda **x: {r["check"] for r in checks.preflight(**(good | x)).where("n_violations > 0").collect()}
    assert of() == set()
    checks.raise_on_violations(checks.preflight(**good))
    assert of(manifest=manifest.unionByName(manifest.limit(1))) == {"execution_repeated"}
    assert of(manifest=manifest.withColumn("child", F.when(F.col("segment_id") != "a", F.col("child")))) == {"execution_without_child"}
    assert of(manifest=manifest.where("segment_id <> 'c'")) == {"segment_outside_manifest"}
    assert of(index=index.where("false")) == {"pairs_without_index"}
    assert of(catalog=catalog.where("false")) == {"matrix_without_first_reference"}
    assert of(catalog=spark.createDataFrame([("p", "b", 1)], catalog.schema)) == {"first_reference_is_not_the_medoid"}
    assert of(catalog=catalog.unionByName(spark.createDataFrame([("p", "z", 2)], catalog.schema))) == {"reference_outside_matrix"}
    with pytest.raises(ValueError, match="pairs_without_index: 1"):
        checks.raise_on_violations(checks.preflight(**(good | {"index": index.where("false")})))


def test_integrity(spark):
    of = lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    got = {r["path"]: (r["unchanged"], r["as_expected"]) for r in checks.integrity(of([("a", "1"), ("b", "1")]), of([("a", "1"), ("b", "2")]), of([("a", "1"), ("b", "2"), ("c", "3")])).collect()}
    assert got == {"a": (True, True), "b": (False, True), "c": (False, False)}


def test_limits_and_confounders(spark):
    scales = spark.createDataFrame([("x", 2.0, 0.5), ("y", 2.0, None), ("z", None, None)], "g string, between double, within double")
    assert {r["g"]: r["near"] for r in T.near_limit(scales, ["g"]).collect()} == {"x": 0.5, "y": 0.2, "z": None}
    assigned = spark.createDataFrame([("x", f"c{i}", i % 2) for i in range(24)], "g string, child string, slot int")
    covariates = spark.createDataFrame([("x", f"c{i}", "ab"[i % 2], "<missing>" if i < 4 else "ab"[i // 2 % 2], float(i)) for i in range(24)], "g string, child string, same string, other string, v double")
    got = {r["variable"]: r for r in study.confounders(assigned, covariates, ["g"], ["same", "other"], ["v"], 40).collect()}
    assert got["same"]["dominant"] and got["same"]["effect"] == pytest.approx(1)
    assert not got["other"]["dominant"] and got["v"]["p_value"] is None and got["v"]["effect"] < 0.05
