import math

import pytest
from pyspark.sql import functions as F

from kinespan.operators import conditioning as C


def pose(spark, frames, change=lambda f, j: None):
    """Every joint j at (10 + j, 10 + 2j) with confidence 0.9 unless `change` says otherwise."""
    rows = []
    for f in range(frames):
        for j in range(17):
            rows.append(("s", f, j, *(change(f, j) or (10.0 + j, 10.0 + 2 * j, 0.9))))
    return spark.createDataFrame(rows, "segment_id string, frame int, joint int, x double, y double, confidence double")


def test_validity(spark):
    cases = [(0.0, 0.0, 0.9), (0.0, 1.0, 0.9), (1.0, 1.0, 0.2), (1.0, 1.0, 0.3), (float("nan"), 1.0, 0.9), (None, 1.0, 0.9), (1.0, float("inf"), 0.9), (1.0, 1.0, None)]
    df = spark.createDataFrame(cases, "x double, y double, c double")
    assert [r[0] for r in df.select(C.is_valid(F.col("x"), F.col("y"), F.col("c"))).collect()] == [False, True, False, True, False, False, False, False]


def test_gaps(spark):
    lost = {(0, f) for f in (2, 3, 4)} | {(1, f) for f in (7, 8, 9, 10)} | {(2, 0)}
    df = pose(spark, 14, lambda f, j: (0.0, 0.0, 0.9) if (j, f) in lost else (float(f), float(2 * f) + 1, 0.9))
    got = {(r["joint"], r["frame"]): r for r in C.fill_gaps(df).collect()}
    assert all(got[0, f]["valid"] and got[0, f]["x"] == pytest.approx(f) and got[0, f]["y"] == pytest.approx(2 * f + 1) for f in (2, 3, 4))
    assert not any(got[1, f]["valid"] or got[1, f]["x"] is not None for f in (7, 8, 9, 10))
    assert not got[2, 0]["valid"]
    assert sum(not r["valid"] for r in got.values()) == 5


def test_centre_scale_and_fallbacks(spark):
    df = pose(spark, 4, lambda f, j: (1.0, 1.0, 0.0) if f == 1 and j in (11, 12) else None)
    filled = C.fill_gaps(df, longest=0)
    roots, scales = C.root_origins(filled), C.torso_scales(filled)
    assert {r["frame"]: r["root_source"] for r in roots.collect()} == {0: "hips", 1: "visible", 2: "hips", 3: "hips"}
    found = {(r["frame"], r["joint"]): r for r in C.normalized(filled, roots, scales).collect()}
    scale = scales.first()["scale"]
    assert found[0, 11]["x"] == pytest.approx(-0.5 / scale, rel=1e-6) and found[1, 11]["x"] is None
    assert scale >= 1 and not scales.first()["scale_fallback"]
    one = C.diagnostics(filled, roots, scales).first()
    assert (one["n_frames"], one["root_fallback_frames"], one["root_no_support_frames"]) == (4, 1, 0)
    assert one["missing_share"] == pytest.approx(2 / 68)


def test_scale_falls_back_to_the_box_and_to_one(spark):
    df = pose(spark, 1, lambda f, j: (3.0 * j, 4.0 * j, 0.9) if j in (1, 2) else (0.0, 0.0, 0.9))
    r = C.torso_scales(C.fill_gaps(df)).first()
    assert r["scale_fallback"] and r["scale"] == pytest.approx(math.hypot(3, 4))
    r = C.torso_scales(C.fill_gaps(pose(spark, 1, lambda f, j: (0.0, 0.0, 0.9)))).first()
    assert (r["scale"], r["scale_fallback"]) == (1.0, True)


def test_packing_checks_and_differences(spark):
    found, _ = C.conditioned(pose(spark, 3))
    packed = C.sequences(found)
    r = packed.first()
    assert r["n_frames"] == 3 and [len(f) for f in r["frames"]] == [34] * 3
    assert C.sequence_violations(packed).count() == 0
    bad = spark.createDataFrame([("a", [[1.0]]), ("b", []), ("c", [[1.0, None]]), ("d", [[float("nan"), 1.0]]), ("e", [[1.0, 2.0]])], "segment_id string, frames array<array<double>>")
    got = {(r["segment_id"], r["violation"]) for r in C.sequence_violations(bad, joints=1).collect()}
    assert got == {("a", "wrong_width"), ("a", "half_missing"), ("b", "no_frames"), ("c", "half_missing"), ("d", "not_finite")}
    assert C.differences(found, found).count() == 0
    other = found.withColumn("x", F.when((F.col("frame") == 1) & (F.col("joint") == 2), 9.0).otherwise(F.col("x")).cast("float"))
    assert [tuple(r) for r in C.differences(found, other.where("frame < 2")).select("frame", "joint").orderBy("frame", "joint").collect()][0] == (1, 2)
    assert C.differences(found, other.where("frame < 2")).count() == 18


def test_empty(spark):
    found, notes = C.conditioned(pose(spark, 0))
    assert found.count() == 0 and notes.count() == 0 and C.batch_summary(notes).first()["n_segments"] == 0
