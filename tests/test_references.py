import random

import numpy as np
import pytest

from kinespan.operators import references as R

SCHEMA = "part string, segment_id_a string, segment_id_b string, distance double"


def groups(seed=11):
    """Points in the plane of several children, as long matrices of three groups."""
    rng = np.random.default_rng(seed)
    rows, children = [], []
    for g, n in (("p", 24), ("q", 12), ("r", 6)):
        at = rng.normal(size=(n, 2))
        ids = [f"{g}{i:03d}" for i in range(n)]
        children += [(s, f"c{g}{i // 2}") for i, s in enumerate(ids)]
        rows += [(g, ids[i], ids[j], float(np.linalg.norm(at[i] - at[j]))) for i in range(n) for j in range(i + 1, n)]
    return rows, children


def by_hand(rows, children):
    """The references of one group, picked one after the other."""
    d, child = {}, dict(children)
    for _, a, b, v in rows:
        d[a, b] = d[b, a] = v
    ids = sorted({a for a, _ in d})
    mean = {s: round(np.mean([d[s, o] for o in ids if (s, o) in d]), 9) for s in ids}
    cut = [(n, round(float(np.quantile([v for *_, v in rows], q)), 9)) for n, q in R.DIVERSITY]
    n = len({child[s] for s in ids})
    k = 1 if n < 5 else 2 if n < 10 else 3 if n < 20 else 4
    picked = [(min(ids, key=lambda s: (mean[s], s)), "primaria")]
    while len(picked) < k:
        for name, least in cut:
            far = [s for s in ids if child[s] not in {child[p] for p, _ in picked} and round(min(d[s, p] for p, _ in picked), 9) >= least]
            if far:
                picked.append((min(far, key=lambda s: (mean[s], s)), name))
                break
        else:
            break
    return picked


def test_diverse_references_match_brute_force(spark):
    rows, children = groups()
    found = R.diverse_references(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(children, "segment_id string, child string"), ["part"])
    got = {}
    for r in found.orderBy("part", "rank").collect():
        got.setdefault(r["part"], []).append((r["segment_id"], r["threshold_used"]))
    assert got == {g: by_hand([r for r in rows if r[0] == g], children) for g in "pqr"}
    assert {tuple(r) for r in R.catalog_sizes(found, ["part"]).collect()} == {(3, 1), (2, 1), (1, 1)}
    assert R.primaries(found, ["part"]).count() == 3


def test_medoid_ties_and_unknown_children(spark):
    rows = [("g", "a", "b", 1.0), ("g", "b", "c", 1.0), ("g", "a", "c", 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert R.medoids(R.centrality(df, ["part"]), ["part"]).first()["medoid_segment_id"] == "a"
    found = R.diverse_references(df, spark.createDataFrame([], "segment_id string, child string"), ["part"]).collect()
    assert [(r["segment_id"], r["child"], r["n_group_children"]) for r in found] == [("a", "desconocido::a", 3)]


def test_usable_pairs(spark):
    rows = [
        ("g", "b", "a", 1.0, 1), ("g", "a", "b", 2.0, 2), (" g", "a", "b", 2.0, 2), ("g", "a", " b", 3.0, None), ("g", "a", "a", 0.0, 1), ("g", "a", "c", float("nan"), 1), ("g", "a", "c", float("inf"), 1),
        ("g", "a", "c", -1.0, 1), ("g", None, "c", 1.0, 1), ("g", "a", "d", None, 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA + ", computed_at int")
    assert {tuple(r) for r in R.usable_pairs(df, ["part"]).collect()} == {("g", "a", "b", 2.0), (" g", "a", "b", 2.0)}
    assert R.usable_pairs(df.where("false"), ["part"]).count() == 0


def test_violations_one_by_one(spark):
    full = [("g", "a", "b", 1.0), ("g", "a", "c", 2.0), ("g", "b", "c", 3.0)]
    size = spark.createDataFrame([("g", 3)], "part string, n_clips long")
    of = lambda rows: {(r["violation"], r["n"]) for r in R.matrix_violations(spark.createDataFrame(rows, SCHEMA), ["part"], size).collect()}
    assert of(full) == set()
    assert of(full[:2]) == {("incomplete", 1)}
    assert of([*full, ("g", "b", "a", 1.0)]) == {("duplicate_pair", 1)}
    assert of([*full, ("g", "a", "a", 0.0)]) == {("diagonal", 1)}
    assert of([*full[:2], ("g", "b", "c", float("nan"))]) == {("not_finite", 1)}
    assert of([*full[:2], ("g", "b", "c", -1.0)]) == {("negative", 1)}
    assert of([*full, ("g", None, "c", 1.0)]) == {("missing_id", 1)}


def test_catalog_differences(spark):
    a = spark.createDataFrame([("g", "a"), ("g", "a"), ("g", "b")], "part string, segment_id string")
    b = spark.createDataFrame([("g", "b"), ("h", None)], "part string, segment_id string")
    assert {tuple(r) for r in R.catalog_differences(a, b, ["part", "segment_id"]).collect()} == {("g", "a", "left"), ("h", None, "right")}


def test_quantiles(spark):
    rng = random.Random(1)
    v = [rng.random() for _ in range(11)]
    df = spark.createDataFrame([("g", "a", f"b{i}", x) for i, x in enumerate(v)], SCHEMA)
    r = R.distance_quantiles(df, ["part"]).first()
    assert [r["q25"], r["q20"], r["q10"]] == pytest.approx([np.quantile(v, q) for q in (0.25, 0.2, 0.1)])
