from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespan.operators import resampling, study
from kinespan.operators import templates as T

KEYS = ["g"]


@pytest.fixture(scope="module")
def data(spark):
    """Two groups of clips in the plane, two clips a child."""
    rng = np.random.default_rng(21)
    pairs, clips, at = [], [], {}
    for g, n in (("x", 16), ("y", 12)):
        ids = [f"{g}{i:02d}" for i in range(n)]
        for i, s in enumerate(ids):
            at[s] = rng.normal(size=2)
            clips.append((g, s, f"{g}-c{i // 2}"))
        pairs += [(g, a, b, float(np.linalg.norm(at[a] - at[b]))) for a, b in combinations(ids, 2)]
    clip_table = spark.createDataFrame(clips, "g string, segment_id string, child string")
    pair_table = spark.createDataFrame(pairs, "g string, segment_id_a string, segment_id_b string, distance double")
    distances = T.clip_distances(pair_table, clip_table, KEYS).cache()
    return dict(pairs=pair_table, distances=distances, cost=T.cost_matrix(distances, KEYS).cache(), clips=clips, at=at)


def objective(data, group, ids):
    own = {}
    for g, s, c in data["clips"]:
        if g == group:
            own.setdefault(c, []).append(s)
    d = lambda a, b: np.linalg.norm(data["at"][a] - data["at"][b])
    return np.mean([min(np.mean([d(s, t) for s in clips]) for t in ids) for clips in own.values()])


def best(data, group, k):
    child = {s: c for g, s, c in data["clips"] if g == group}
    sets = (ids for ids in combinations(sorted(child), k) if len({child[s] for s in ids}) == k)
    return min((objective(data, group, ids), ids) for ids in sets)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_solver_against_all_sets(data, k):
    found = T.solved_templates(data["cost"], KEYS, k, starts=3)
    chosen = {}
    for r in found.orderBy("slot").collect():
        chosen.setdefault(r["g"], []).append(r)
    for g in "xy":
        ids = tuple(r["candidate"] for r in chosen[g])
        assert ids == tuple(sorted(ids)) and len({r["candidate_child"] for r in chosen[g]}) == k
        optimum = best(data, g, k)[0]
        assert objective(data, g, ids) >= optimum - 1e-12
        assert objective(data, g, ids) <= optimum * (1 if k == 1 else 1.05) + 1e-9


def test_swaps_never_make_it_worse(data):
    greedy = T.greedy_templates(data["cost"], KEYS, 3)
    before = {r["g"]: r["objective"] for r in T.objectives(data["cost"], greedy, KEYS).collect()}
    after = {r["g"]: r["objective"] for r in T.objectives(data["cost"], T.refined_templates(data["cost"], greedy, KEYS), KEYS).collect()}
    assert all(after[g] <= before[g] + 1e-12 for g in "xy")


def test_scales_assignments_and_support(data):
    two = T.greedy_templates(data["cost"], KEYS, 2)
    ids = {g: [r["candidate"] for r in two.where(f"g = '{g}'").orderBy("slot").collect()] for g in "xy"}
    scales = {r["g"]: r for r in T.group_scales(data["distances"], KEYS).collect()}
    d = lambda a, b: np.linalg.norm(data["at"][a] - data["at"][b])
    for g in "xy":
        own = {}
        for q, s, c in data["clips"]:
            if q == g:
                own.setdefault(c, []).append(s)
        between = np.median([np.median([d(a, b) for a in own[p] for b in own[q]]) for p, q in combinations(sorted(own), 2)])
        assert scales[g]["between"] == pytest.approx(between)
        assert scales[g]["within"] == pytest.approx(np.median([d(*c) for c in own.values()]))
        for r in T.assignments(data["distances"], two, KEYS).where(f"g = '{g}'").collect():
            means = [np.mean([d(s, t) for s in own[r["child"]]]) for t in ids[g]]
            assert r["template"] == ids[g][int(np.argmin(means))] and r["loss"] == pytest.approx(min(means)) and r["margin"] == pytest.approx(max(means) - min(means))
            assert r["clip_loss"] == pytest.approx(np.mean([min(d(s, t) for t in ids[g]) for s in own[r["child"]]]))
    support = T.support(T.assignments(data["distances"], two, KEYS), two, KEYS).collect()
    assert all(r["minimum"] == 5 and r["supported"] == (r["n_assigned"] >= 5) for r in support)
    assert sum(r["n_assigned"] for r in support) == 14


def test_geometry_against_all_orders(spark, data):
    left, right = T.greedy_templates(data["cost"], KEYS, 3), T.random_templates(data["cost"], KEYS, 3, 5)
    ids = {(n, g): [r["candidate"] for r in t.where(f"g = '{g}'").orderBy("slot").collect()] for n, t in (("l", left), ("r", right)) for g in "xy"}
    for r in T.set_geometry(left, right, data["distances"], KEYS, 3).collect():
        d = np.array([[np.linalg.norm(data["at"][a] - data["at"][b]) for b in ids["r", r["g"]]] for a in ids["l", r["g"]]])
        assert r["match_mean"] == pytest.approx(min(np.mean([d[i, p[i]] for i in range(3)]) for p in permutations(range(3))))
        assert r["hausdorff"] == pytest.approx(max(d.min(axis=0).max(), d.min(axis=1).max()))
        assert r["match_mean"] == pytest.approx(np.mean([d[i, j] for i, j in enumerate(r["mapping"])]))
    same = T.set_geometry(left, left, data["distances"], KEYS, 3).collect()
    assert all(r["match_mean"] == 0 and r["mapping"] == [0, 1, 2] for r in same)
    with pytest.raises(ValueError):
        T.set_geometry(left, left, data["distances"], KEYS, 6)


def test_rand_index(spark):
    rows = [("same", a, b) for a, b in zip("aabbc", "xxyyz")] + [("trivial", "a", "x")] * 3 + [("one", "a", "x")] + [("mixed", a, b) for a, b in zip("aaabbb", "xxyyyy")]
    got = {r["g"]: r["ari"] for r in T.adjusted_rand(spark.createDataFrame(rows, "g string, left string, right string"), KEYS).collect()}
    assert got["same"] == 1 and got["trivial"] == 1 and got["one"] == 1
    assert got["mixed"] == pytest.approx((4 + 0 - (6 * 7 / 15) + 0) / ((6 + 7) / 2 - 6 * 7 / 15))


def test_incomplete_clips_are_left_out(spark, data):
    cut = data["pairs"].where("NOT (segment_id_a = 'x00' AND segment_id_b = 'x01')")
    left = {r["segment_id"] for r in T.complete_clips(cut, KEYS).where("g = 'x'").collect()}
    assert left == {f"x{i:02d}" for i in range(2, 16)}


def test_plan_is_nested_and_independent_of_partitions(spark):
    df = spark.createDataFrame([("x", f"c{i}") for i in range(20)] + [("small", "a"), ("small", "b"), ("x", None)], "g string, child string")
    planned = resampling.plan(df, KEYS, 3)
    sets = resampling.nested_sets(planned, KEYS).where("scheme = 'primary_h3'").collect()
    by = {}
    for r in sets:
        by.setdefault((r["repetition"], r["n_children"]), set()).add(r["child"])
    assert {n for _, n in by} == {3, 5, 8, 10, 12, 15, 17} and {r["g"] for r in sets} == {"x"}
    for rep in (1, 2, 3):
        for a, b in zip((3, 5, 8, 10, 12, 15), (5, 8, 10, 12, 15, 17)):
            assert by[rep, a] < by[rep, b] and len(by[rep, a]) == a
    assert by[1, 5] != by[2, 5]
    again = resampling.plan(df.repartition(9), KEYS, 3)
    assert sorted(map(str, again.collect())) == sorted(map(str, planned.collect()))


def test_trials(data):
    planned = resampling.plan(data["distances"].select("g", "child"), KEYS, 2)
    found = resampling.against_largest(resampling.trials(data["distances"], planned, KEYS, [1, 2], [3], starts=1), KEYS)
    rows = found.collect()
    assert {(r["g"], r["n_children"], r["k"], r["repetition"]) for r in rows} == {(g, n, k, r) for g, top in (("x", 5), ("y", 3)) for n in {3, top} for k in (1, 2) for r in (1, 2)}
    assert all(r["excess"] == 0 and r["exact_match"] and r["jaccard"] == 1 for r in rows if r["n_children"] == r["maximum"])
    assert all(r["holdout_loss"] > 0 and not r["support_ok"] for r in rows if r["n_children"] == 3)
    gains = resampling.paired_gains(found, KEYS).where("k = 1").collect()
    assert all(r["reduction_vs_k1"] == 0 and r["gain_vs_previous_k"] is None for r in gains)


CURVE = "g string, k int, support_rate double, dominant boolean, loss_mean double, loss_se double, gain_median double, p90_mean double, geometry_median double, ari_median double"


def test_choice_of_k(spark):
    rows = [
        ("strict", 1, 1.0, False, 1.0, 0.01, None, 1.0, 0.1, None), ("strict", 2, 1.0, False, 0.8, 0.05, 0.2, 0.9, 0.1, 0.8), ("strict", 3, 1.0, False, 0.79, 0.05, 0.01, 0.9, 0.1, 0.8),
        ("fallback", 1, 1.0, False, 1.0, 0.01, None, 1.0, 0.1, None), ("fallback", 2, 1.0, False, 0.5, 0.05, 0.5, 0.9, None, 0.8),
        ("none", 1, 0.1, False, 1.0, 0.01, None, 1.0, 0.1, None), ("dominated", 1, 1.0, True, 0.1, 0.01, None, 1.0, 0.1, None), ("dominated", 2, 1.0, None, 0.9, 0.01, 0.2, 2.0, 0.1, 0.8),
    ]
    got = {r["g"]: (r["selected_k"], r["strict"]) for r in study.choose_k(spark.createDataFrame(rows, CURVE), KEYS, 3).collect()}
    assert got == {"strict": (2, True), "fallback": (2, False), "none": (1, False), "dominated": (2, False)}


def test_choice_of_n(spark):
    names = "g string, n_children int, maximum int, loss_mean double, loss_se double, excess_median double, excess_p90 double, geometry_median double, geometry_p90 double, agreement_median double, ari_median double, support_rate double, marginal double"
    good = (0.01, 0.05, 0.05, 0.1, 0.9, 0.9, 1.0, 0.001)
    rows = [("ok", n, 20, 0.5, 0.1, *(good if n >= 8 else (0.5, *good[1:]))) for n in (3, 5, 8, 10, 12, 20)]
    rows += [("worse", n, 20, loss, 0.0, *good) for n, loss in ((3, 0.1), (5, 0.1), (8, 0.1), (10, 0.5), (20, 0.1))]
    rows += [("short", n, 5, 0.5, 0.1, *good) for n in (3, 5)] + [("weak", n, 20, 0.5, 0.1, *good[:6], 0.2, 0.001) for n in (3, 5, 8)]
    got = {r["g"]: (r["status"], r["n_equivalence"], r["n_recommended"], r["n_for_20pct_loss"]) for r in study.select_n(spark.createDataFrame(rows, names), KEYS).collect()}
    assert got["ok"] == ("stabilized_below_available_maximum", 8, 8, 10)
    assert got["worse"][:2] == ("not_stabilized_below_available_maximum", None)
    assert got["short"][0] == "insufficient_children_for_stability_estimation" and got["weak"][0] == "insufficient_support"


def test_partners_wrap_around(spark):
    df = spark.createDataFrame([("x", "s", r, 5, 1, f"set{r}") for r in (1, 2, 3)] + [("y", "s", 1, 5, 1, "only")], "g string, scheme string, repetition int, n_children int, k int, ids string")
    got = {(r["g"], r["repetition"]): r["partner"] for r in resampling.partners(df, KEYS).collect()}
    assert got == {("x", 1): "set2", ("x", 2): "set3", ("x", 3): "set1", ("y", 1): None}


def test_associations(spark):
    rows = [("tied", f"m{i}", "ab"[i % 2], "xy"[i % 2]) for i in range(20)] + [("free", f"m{i}", "ab"[i % 2], "xy"[i // 2 % 2]) for i in range(20)] + [("one", f"m{i}", "a", "xy"[i % 2]) for i in range(6)]
    df = spark.createDataFrame(rows, "g string, m string, l string, r string")
    got = {r["g"]: r for r in study.permutation_test(df, KEYS, "l", "r", "m", 60).collect()}
    assert got["tied"]["effect"] == pytest.approx(1) and got["tied"]["p_value"] < 0.05
    assert got["free"]["effect"] == pytest.approx(0, abs=1e-9) and got["free"]["p_value"] > 0.5
    assert (got["one"]["effect"], got["one"]["p_value"]) == (0.0, 1.0)
    numbers = spark.createDataFrame([("x", "a", 1.0), ("x", "a", 1.0), ("x", "b", 3.0), ("flat", "a", 1.0), ("flat", "b", 1.0), ("flat", "b", 1.0), ("x", None, 9.0)], "g string, l string, v double")
    assert {r["g"]: r["eta_squared"] for r in study.eta_squared(numbers, KEYS, "l", "v").collect()} == {"x": 1.0, "flat": 0.0}


def test_a_missing_pair_costs_no_clip(spark):
    """One distance of six is missing: all four clips stay, and the unknown costs are the children's greatest."""
    known = {("a", "b"): 1.0, ("a", "c"): 2.0, ("a", "d"): 3.0, ("b", "c"): 4.0, ("b", "d"): 5.0}
    pairs = spark.createDataFrame([("x", a, b, d) for (a, b), d in known.items()], "g string, segment_id_a string, segment_id_b string, distance double")
    assert {r["segment_id"] for r in T.every_clip(pairs, KEYS).collect()} == set("abcd")
    assert tuple(T.clips_left_out(pairs, KEYS).first()) == ("x", 4, 2, 5, 1)
    clips = T.every_clip(pairs, KEYS).withColumn("child", F.concat(F.lit("k"), "segment_id"))
    cost = T.filled_costs(T.cost_matrix(T.clip_distances(pairs, clips, KEYS), KEYS), KEYS).cache()
    got = {(r["child"], r["candidate"]): (r["cost"], r["known"]) for r in cost.collect()}
    want = {(f"k{a}", b): (0.0 if a == b else known.get((min(a, b), max(a, b))), True) for a in "abcd" for b in "abcd"}
    assert got == want | {("kc", "d"): (4.0, False), ("kd", "c"): (5.0, False)}
    assert [r["candidate"] for r in T.solved_templates(cost, KEYS, 2).orderBy("slot").collect()] == ["a", "d"]


def test_permuted_rows_are_dealt_once(spark, monkeypatch):
    """The rows times permutations are sorted and counted in one plan; what follows reads the counts."""
    seen = {}
    keep = study.written
    monkeypatch.setattr(study, "written", lambda df, name: seen.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and keep(df, name), raising=False)
    df = spark.createDataFrame([("g", f"m{i:02d}", "ab"[i % 2], "xy"[i // 3 % 2]) for i in range(30)], "g string, m string, l string, r string")
    found = study.permutation_test(df, KEYS, "l", "r", "m", 10)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 1
    assert seen["cells"].count("row_number") > 0 and seen["cells"].count("Generate explode") == 1
