import random
from collections import Counter

from kinespan.llm import consensus

CLASSES = ["PASS", "REVIEW", "FAIL"]


def simulated(seed=5):
    """Labels by careful, careless and guessing annotators, and the truth."""
    rng = random.Random(seed)
    skill = {f"a{i}": s for i, s in enumerate([0.96] * 5 + [0.75] * 4 + [0.34] * 8)}
    truth, rows = {}, []
    for i in range(500):
        t = truth[f"i{i}"] = rng.choices(CLASSES, [0.5, 0.3, 0.2])[0]
        for a in rng.sample(sorted(skill), 6):
            rows.append((f"i{i}", a, t if rng.random() < skill[a] else rng.choice([c for c in CLASSES if c != t])))
    return rows, truth, skill


def test_better_than_majority_and_reliabilities_in_order(spark):
    rows, truth, skill = simulated()
    df = spark.createDataFrame([(i, a, s, 1) for i, a, s in rows], "item string, annotator string, label string, m0 int")
    items, annotators = consensus.consensus(df, "item", "annotator", "label", CLASSES)
    got = {r["item"]: r["label"] for r in items.collect()}
    right = sum(got[i] == t for i, t in truth.items())
    votes = {}
    for i, _, s in rows:
        votes.setdefault(i, Counter())[s] += 1
    majority = sum(max(v, key=lambda c: (v[c], c)) == truth[i] for i, v in votes.items())
    assert right > majority and right / len(truth) > 0.9
    own = {r["annotator"]: r["reliability"] for r in annotators.collect()}
    assert min(own[f"a{i}"] for i in range(5)) > max(own[f"a{i}"] for i in range(9, 17))


def test_nulls_repeats_other_labels_and_ties(spark):
    rows = [("i", "a", "PASS"), ("i", "a", "PASS"), ("i", "b", "PASS"), ("j", "a", "FAIL"), ("k", None, "PASS"), (None, "a", "PASS"), ("l", "a", None), ("m", "a", "LATER")]
    items, annotators = consensus.consensus(spark.createDataFrame(rows, "item string, annotator string, label string"), "item", "annotator", "label", CLASSES)
    got = {r["item"]: (r["n_labels"], r["agreement"]) for r in items.collect()}
    assert got == {"i": (2, 1.0), "j": (1, None)}
    assert dict(items.select("item", "label").collect())["i"] == "PASS"
    assert {r["annotator"]: r["n_labels"] for r in annotators.collect()} == {"a": 2, "b": 1}


def test_salted_annotators_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(simulated(6)[0][:600], "item string, annotator string, label string")
    take = lambda: {r["item"]: (r["label"], round(r["confidence"], 6)) for r in consensus.consensus(df, "item", "annotator", "label", CLASSES)[0].collect()}
    plain = take()
    monkeypatch.setattr(consensus, "BROADCAST_HABITS", 0)
    assert take() == plain


def test_empty(spark):
    empty = spark.createDataFrame([], "item string, annotator string, label string")
    items, annotators = consensus.consensus(empty, "item", "annotator", "label", CLASSES)
    assert items.count() == 0 and annotators.count() == 0
    assert consensus.krippendorff_alpha(empty, "item", "annotator", "label").first()["alpha"] is None


def test_alpha_is_one_for_agreement(spark):
    df = spark.createDataFrame([("i", "a", "x"), ("i", "b", "x"), ("j", "a", "y"), ("j", "b", "y"), ("k", "a", "x")], "i string, a string, l string")
    r = consensus.krippendorff_alpha(df, "i", "a", "l").first()
    assert (r["n_items"], r["n_labels"], r["alpha"]) == (2, 4, 1.0)
