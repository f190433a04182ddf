from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinespan.operators import packed_trials as P
from kinespan.operators import resampling, study
from kinespan.operators import templates as T
from kinespan.plans import study as plans


def rows(n=14, children=9, missing=0.05, seed=1):
    rng = np.random.default_rng(seed)
    at = rng.random((n, 3))
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
    gone = np.triu(rng.random((n, n)) < missing, 1)
    gone |= gone.T
    return pd.DataFrame([(f"s{i:02d}", f"c{i % children}", f"s{j:02d}", f"c{j % children}", d[i, j]) for i in range(n) for j in range(n) if not gone[i, j]], columns=["segment_id", "child", "candidate", "candidate_child", "distance"])


def best_by_hand(m, train, k):
    own = [i for i in range(len(m.ids)) if train[m.origin[i]]]
    sets = [s for s in combinations(own, k) if len({m.origin[i] for i in s}) == k]
    return min(m.cost[train][:, list(s)].min(axis=1).mean() for s in sets)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_solutions_are_the_best_of_all_sets(k):
    m = P.Matrix(rows())
    rng = np.random.default_rng(3)
    train = np.zeros((6, 9), bool)
    np.put_along_axis(train, np.argsort(rng.random(train.shape), axis=1)[:, :6], True, axis=1)
    value, sets = P.solved(m, train, k, 8, rng)
    for t in range(6):
        assert value[t] == pytest.approx(best_by_hand(m, train[t], k))
        assert len({m.origin[i] for i in sets[t]}) == k and train[t][m.origin[sets[t]]].all()


def test_equal_halves_do_not_swap_for_ever():
    r = rows(6, 6, 0.0)
    r["distance"] = np.where(r["segment_id"] == r["candidate"], 0.0, 0.38344906550000001)
    value, sets = P.solved(P.Matrix(r), np.ones((3, 6), bool), 2, 4, np.random.default_rng(1))
    assert sets.tolist() == [[0, 1]] * 3 and np.allclose(value, 0.3834490655 * 4 / 6)


def test_geometry_and_agreement_of_a_set_with_itself():
    m = P.Matrix(rows(missing=0.0))
    sets = np.array([[0, 4, 7]])
    far = P.geometry(m, sets, sets[:, ::-1])
    assert far["match_mean"][0] == far["hausdorff"][0] == 0 and far["mapping"][0].tolist() == [2, 1, 0]
    slot = P.evaluated(m, np.arange(9)[None], sets, 0.0)["slot"]
    same = P.agreement(slot, 2 - slot, far["mapping"], 3)
    assert same["agreement"][0] == same["ari"][0] == same["cluster_jaccard_min"][0] == 1.0


def test_trials_match_the_long_form(spark):
    """The same costs, objectives and scales as the long table's; every repetition, size and k that the children allow."""
    r = rows(children=12)
    df = spark.createDataFrame(r.assign(part="p"))
    m = P.Matrix(r)
    long = {(x["child"], x["candidate"]): x["cost"] for x in T.filled_costs(T.cost_matrix(df, ["part"]), ["part"]).collect()}
    assert all(long[c, s] == pytest.approx(m.cost[i, j]) for i, c in enumerate(m.children) for j, s in enumerate(m.ids))
    scales = T.group_scales(df, ["part"]).first()
    assert scales["between"] == pytest.approx(m.between) and scales["within"] == pytest.approx(m.within)
    found = P.trials(df, ["part"], [1, 2], [3, 5], 4, 3).cache()
    assert {(x["scheme"], x["n_children"], x["k"]) for x in found.collect()} == {("primary_h3", n, k) for n in (3, 5, 9) for k in (1, 2)}
    assert found.count() == 24 and found.where("n_children = maximum AND (excess <> 0 OR NOT exact_match)").count() == 0
    again = P.trials(df.repartition(5), ["part"], [1, 2], [3, 5], 4, 3)
    assert sorted(map(str, again.collect())) == sorted(map(str, found.collect()))
    full = P.full_solutions(df, ["part"], [2]).collect()
    assert sum(x["n_assigned"] for x in full) == 12 and full[0]["objective"] == pytest.approx(best_by_hand(m, np.ones(12, bool), 2))
    stable = P.assignment_stability(df, ["part"], [1, 2], 4).collect()
    assert len(stable) == 24 and all(sum(x["shares"]) == pytest.approx(1) and 0 <= x["entropy_normalized"] <= 1 and x["together"][x["child"]] == 1 for x in stable)
    gained = resampling.paired_gains(found, ["part"]).withColumn("set_id", F.array_join("ids", "|"))
    curve = study.curves(gained, ["part", "n_children", "k"], ["holdout_loss"], ["support_ok"], "set_id").collect()
    assert len(curve) == 6 and all(x["repetitions"] == 4 for x in curve)


def test_matrices_too_large_to_pack_are_told_apart(spark, monkeypatch):
    df = spark.createDataFrame(pd.concat([rows(6).assign(part="a"), rows(9).assign(part="b")]))
    monkeypatch.setattr(P, "MOST_CLIPS", 6)
    small, large = P.packed_matrices(df, ["part"])
    assert {r[0] for r in small.select("part").distinct().collect()} == {"a"} and {r[0] for r in large.select("part").distinct().collect()} == {"b"}


def test_select_k_and_policies(spark):
    columns = "g string, k int, support_rate double, dominant boolean, loss_mean double, loss_se double, gain_median double, p90_mean double, geometry_median double, ari_median double"
    strict4 = [("x", k, 1.0, None, 1.0 - 0.1 * k if k <= 4 else 0.6, 0.01, 0.2, 1.0, 0.1, 0.9) for k in range(1, 6)]
    poor = [("y", k, 0.1, None, 1.0, 0.1, 0.0, 1.0, 0.5, 0.1) for k in range(1, 6)]
    curve = spark.createDataFrame(strict4 + poor, columns)
    got = {r["g"]: r for r in study.select_k(curve, ["g"]).collect()}
    assert (got["x"]["selected_k"], got["x"]["selected_k_cap3"], got["x"]["status"]) == (4, 3, "four_templates_preferred") and got["x"]["reason"].startswith("research_extension")
    assert (got["y"]["selected_k"], got["y"]["status"]) == (1, "insufficient_support")
    policies = {(r["g"], r["policy"]): r["selected_k"] for r in study.k_policies(curve, study.select_k(curve, ["g"]), ["g"]).collect()}
    assert len(policies) == 8 and policies["x", "adaptive_operational"] == 4 and policies["x", "cap_k3"] == 3


def test_a_part_of_the_trials_is_the_same_as_in_the_whole():
    m = P.Matrix(rows(20, 16))
    whole = pd.concat(P.matrix_trials(m, "p", [1, 2, 3], [3, 5], 4, 3, 7))
    part = pd.concat(P.matrix_trials(m, "p", [1, 2, 3], [], 4, 3, 7, "primary_h3"))
    same = whole[(whole["scheme"] == "primary_h3") & (whole["n_children"] == whole["maximum"])]
    pd.testing.assert_frame_equal(part.reset_index(drop=True), same.reset_index(drop=True))
    two = pd.concat(P.matrix_trials(m, "p", [2], [3, 5], 4, 3, 7))
    pd.testing.assert_frame_equal(two.reset_index(drop=True), whole[whole["k"] == 2].reset_index(drop=True))
    assert set(whole["scheme"]) == {"primary_h3", "secondary_h20"} and len(whole) == 4 * 3 * 6


def test_all_trials_of_a_k_are_refined_at_once(monkeypatch):
    calls, keep = [], P._refined
    monkeypatch.setattr(P, "_refined", lambda m, train, *rest: calls.append(len(train)) or keep(m, train, *rest))
    m = P.Matrix(rows(20, 16))
    found = pd.concat(P.matrix_trials(m, "p", [1, 2], [3, 5], 4, 3, 7))
    assert calls == [24, 24] and len(found) == 48
    monkeypatch.setattr(P, "MOST_CELLS", 500)
    small = pd.concat(P.matrix_trials(m, "p", [1, 2], [3, 5], 4, 3, 7))
    by = ["scheme", "n_children", "k", "repetition"]
    pd.testing.assert_frame_equal(small.sort_values(by).reset_index(drop=True), found.sort_values(by).reset_index(drop=True))


def test_packed_templates_are_those_of_the_long_form(spark):
    """With equal distances, so that ties are settled alike, and a matrix with fewer children than templates."""
    parts = [rows(15, 8, 0.1, s).assign(part=f"p{s}") for s in range(3)] + [rows(4, 2, 0.0).assign(part="few")]
    df = spark.createDataFrame(pd.concat(parts).assign(distance=lambda x: x["distance"].round(1)))
    cost = T.filled_costs(T.cost_matrix(df, ["part"]), ["part"]).cache()
    long = T.solved_templates(cost, ["part"], 3)
    got = P.solved_templates(df, ["part"], 3)
    line = ["part", "slot", "candidate", "candidate_child"]
    assert sorted(map(tuple, got.select(*line).collect())) == sorted(map(tuple, long.select(*line).collect()))
    worth = {r["part"]: r["objective"] for r in T.objectives(cost, long, ["part"]).collect()}
    assert all(r["objective"] == pytest.approx(worth[r["part"]]) for r in got.collect())


def test_curves_in_tasks_are_those_of_the_trials(spark):
    """Also where a number is unknown in some or all trials, and with one matrix that has too few children for the second scheme."""
    numbers = ["holdout_loss", "margin", "match_mean_between", "gain_vs_previous_k", "gain_per_child_normalized", "reduction_vs_k1"]
    df = spark.createDataFrame(pd.concat([rows(20, 16, 0.2).assign(part="a"), rows(9, 6, 0.0).assign(part="b")]))
    found = resampling.paired_gains(P.trials(df, ["part"], [1, 2, 4], [3, 5], 4, 3), ["part"])
    found = found.withColumn("gain_per_child_normalized", F.col("gain_per_child") / F.when(F.col("between") > 0, F.col("between"))).withColumn("set_id", F.array_join("ids", "|"))
    by = ["part", "scheme", "n_children", "maximum", "k"]
    more = found.groupBy(*by).agg(F.percentile(F.abs("gain_per_child_normalized"), F.lit(0.5)).alias("marginal"), F.first("between").alias("between"), F.avg("jaccard").alias("jaccard_mean"), F.avg("near_overlap").alias("near_overlap_mean"))
    wanted = study.curves(found, by, numbers, ["support_ok", "exact_match"], "set_id").join(more, by).toPandas().sort_values(by).reset_index(drop=True)
    got = P.curves(df, ["part"], numbers, [1, 2, 4], [3, 5], 4, 3).toPandas().sort_values(by).reset_index(drop=True)
    assert len(got) == 18 and got["margin_mean"].isna().any() and got["gain_vs_previous_k_mean"].notna().any()
    pd.testing.assert_frame_equal(got, wanted[got.columns], check_dtype=False, atol=1e-12)


def test_selected_clips_are_those_of_the_trials(spark):
    df = spark.createDataFrame(rows(20, 16).assign(part="a"))
    by = ["part", "scheme", "n_children", "k"]
    wanted = study.selection_frequency(P.trials(df, ["part"], [1, 3], [3, 5], 4, 3), by, df.select("part", "segment_id").distinct(), ["part"])
    got = P.selected(df, ["part"], [1, 3], [3, 5], 4, 3)
    assert got.count() == 12 * 20 and sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.select(*got.columns).collect()))


def test_a_matrix_in_files_gives_the_same_trials(monkeypatch):
    """Read a few rows at a time, in any order, with its pairs and arrays in files."""
    long = rows(20, 16, 0.1)
    pairs = long[long["segment_id"] < long["candidate"]].rename(columns={"segment_id": "a", "candidate": "b"})[["a", "b", "distance"]]
    named = long[["segment_id", "child"]].drop_duplicates().rename(columns={"segment_id": "a", "child": "b"}).assign(distance=np.nan)
    mixed = pd.concat([pairs, named]).sample(frac=1.0, random_state=3)
    wanted = pd.concat(P.matrix_trials(P.Matrix(long), "p", [1, 2, 3], [3, 5], 4, 3, 7))
    monkeypatch.setattr(P, "MOST_BYTES", 100)
    m = P.Matrix.streamed(mixed[at : at + 7] for at in range(0, len(mixed), 7))
    assert isinstance(m.known.base, np.memmap) and isinstance(m.cost.base, np.memmap)
    pd.testing.assert_frame_equal(pd.concat(P.matrix_trials(m, "p", [1, 2, 3], [3, 5], 4, 3, 7)), wanted)


@pytest.mark.parametrize("query", ["study_template_catalog", "study_trial_curves", "study_trial_k", "study_trial_n", "study_trial_policies", "study_trials"])
def test_queries_do_not_depend_on_the_size_of_a_matrix(spark, monkeypatch, query):
    monkeypatch.setattr(plans, "KS", [1, 2])
    monkeypatch.setattr(plans, "REPETITIONS", 2)
    rows = lambda: sorted(map(str, plans.QUERIES[query](spark, "/root/testdata/sf0.001").collect()))
    wanted = rows()
    monkeypatch.setattr(P, "MOST_CLIPS", 4)
    assert wanted and rows() == wanted
