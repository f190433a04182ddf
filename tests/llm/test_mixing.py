import random

import numpy as np
from pyspark.sql import functions as F

from kinespan.llm import mixing


def best_sum(lengths, counts, budget):
    reach = {0}
    for n, c in zip(lengths, counts):
        reach = {r + n * i for r in reach for i in range(c + 1) if r + n * i <= budget}
    return max(reach)


def test_fit_reaches_the_best_sum():
    rng = random.Random(8)
    for _ in range(200):
        lengths = np.array(sorted(rng.sample(range(1, 40), rng.randrange(1, 7))))
        counts = np.array([rng.randrange(1, 6) for _ in lengths])
        budget = rng.randrange(0, int((lengths * counts).sum()) + 5)
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert int((lengths * take).sum()) <= budget
        assert int((lengths * take).sum()) == best_sum(lengths, counts, budget)


def test_fit_reaches_the_best_sum_of_long_documents():
    rng = random.Random(12)
    for _ in range(200):
        lengths = np.array(sorted(rng.sample(range(100, 40_001), rng.randrange(3, 8))))
        counts = np.array([rng.randrange(1, 4) for _ in lengths])
        budget = rng.randrange(0, int((lengths * counts).sum()))
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and int((lengths * take).sum()) == best_sum(lengths, counts, budget)
    assert (np.array([7, 50_000, 70_001]) * mixing.fit(np.array([7, 50_000, 70_001]), np.array([3, 3, 3]), 275_000)).sum() == best_sum([7, 50_000, 70_001], [3, 3, 3], 275_000)


def test_fit_of_many_documents_gives_back_of_the_even_share(monkeypatch):
    """A budget far over the window: the sum is met, and lengths keep about the same share."""
    monkeypatch.setattr(mixing, "WINDOW", 1000)
    lengths = np.arange(3, 400, 2)
    counts = np.full(len(lengths), 500)
    budget = int((lengths * counts).sum()) // 3 + 1
    take = mixing.fit(lengths, counts, budget)
    assert int((lengths * take).sum()) == budget and (take <= counts).all()
    assert abs(take / counts - 1 / 3).mean() < 0.05


def test_fit_with_a_rest_beyond_the_window(monkeypatch):
    monkeypatch.setattr(mixing, "WINDOW", 50)
    lengths, counts = np.array([3, 7, 100, 900]), np.array([40, 30, 20, 3])
    take = mixing.fit(lengths, counts, 3500)
    assert int((lengths * take).sum()) == 3500


def documents(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["big", "big", "big", "Mid", "small"]), rng.randrange(0, 60)) for i in range(900)]
    rows += [(1000 + i, "big", 17) for i in range(500)]  # a third are of one source and length
    return rows, spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def test_shares_caps_and_repeats(spark):
    rows, df = documents(spark)
    targets = spark.createDataFrame([("B-I-G", 60.0, 1), ("mid", 25.0, 3), ("small", 15.0, 2), ("none", 0.0, 2)], "source string, target_weight double, max_repeats int")
    sized = mixing.sized_documents(df, targets)
    budget = mixing.budgets(sized, targets)
    drawn = mixing.draw(sized, budget)
    assert drawn.count() == drawn.select("doc_id").distinct().count()
    caps = {"big": 1, "mid": 3, "small": 2}
    for r in drawn.groupBy("source").agg(F.max("copies").alias("c")).collect():
        assert r["c"] <= caps[r["source"]]
    have = {k: sum(n for _, s, n in rows if s.lower() == k) for k in caps}
    total = sum(have.values())
    reached = {r["source"]: r for r in mixing.reached_shares(drawn, budget).collect()}
    for name, key, weight in (("B-I-G", "big", 0.6), ("mid", "mid", 0.25), ("small", "small", 0.15)):
        want = min(int(weight * total), caps[key] * have[key])
        assert reached[name]["n_tokens"] == want
    assert reached["none"]["n_tokens"] == 0
    short = {k for k, r in reached.items() if r["short"]}
    assert short == {n for n, k, w in (("B-I-G", "big", 0.6), ("mid", "mid", 0.25), ("small", "small", 0.15)) if caps[k] * have[k] < w * total}
    again = mixing.draw(sized.repartition(5), budget)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, drawn.collect()))
    other = mixing.draw(sized, budget, seed=1)
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, drawn.collect()))


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "a", None), (3, "a", 4), (4, "unlisted", 3)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", None, 1), (None, 5.0, 1), ("b", 2.0, None)], "source string, target_weight double, max_repeats int")
    sized = mixing.sized_documents(df.na.fill(0, ["n_tokens"]), targets)
    budget = mixing.budgets(sized, targets)
    assert mixing.draw(sized, budget).count() == 0
    got = {r["source"]: r["n_tokens"] for r in mixing.reached_shares(mixing.draw(sized, budget), budget).collect()}
    assert got == {"a": 0, "b": 0}
    assert mixing.draw(sized.where("false"), mixing.budgets(sized.where("false"), targets)).count() == 0


def test_long_documents_are_given_back_where_they_miss_the_budget():
    assert mixing.fit(np.array([45_000, 50_000, 60_000]), np.array([1, 1, 1]), 95_000).tolist() == [1, 1, 0]
    rng = random.Random(11)
    for _ in range(30):
        lengths = np.array(sorted(rng.sample(range(20_001, 90_000), 6)))
        counts = np.array([rng.randrange(1, 3) for _ in lengths])
        budget = rng.randrange(20_001, int((lengths * counts).sum()))
        take = mixing.fit(lengths, counts, budget)
        assert (take <= counts).all() and int((lengths * take).sum()) == best_sum(lengths, counts, budget)
