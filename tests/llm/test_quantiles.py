import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespan.llm import quantiles

WANTED = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


def table(spark, n=4000):
    rng = random.Random(4)
    bad = [None, float("nan"), float("inf"), float("-inf"), -1.0]
    rows = []
    for _ in range(n):
        v = rng.choice(bad) if rng.random() < 0.05 else rng.choice([round(rng.lognormvariate(0, 1), 2), rng.random(), 0.0, 1e-300, 4e6 * rng.random(), 1e300])
        rows.append((rng.choice("aab") if rng.random() > 0.02 else None, v, rng.randrange(5)))
    return rows, spark.createDataFrame(rows, "grp string, value double, percentile int")


def expected(rows):
    out = {}
    for g in "ab":
        v = np.array([x for k, x, _ in rows if k == g and x is not None and np.isfinite(x)])
        for p in WANTED:
            out[g, p] = np.quantile(v, p)
    return out


@pytest.mark.parametrize("part", [None, "percentile"])
def test_exact(spark, part):
    rows, df = table(spark)
    found = quantiles.percentiles(df, F.col("grp"), F.col("value"), WANTED, F.col(part) if part else None)
    got = {(r["grp"], r["percentile"]): r["value"] for r in found.collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12, abs=1e-300)


def test_salted_intervals_give_the_same(spark, monkeypatch):
    rows, df = table(spark, 800)
    plain = sorted(map(tuple, quantiles.percentiles(df, F.col("grp"), F.col("value"), WANTED).collect()))
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, quantiles.percentiles(df, F.col("grp"), F.col("value"), WANTED).collect())) == plain


def test_tolerance_bounds_the_error(spark):
    df = spark.range(10_001).select(F.lit("g").alias("g"), (F.col("id") / 7).alias("v"))
    got = quantiles.percentiles(df, F.col("g"), F.col("v"), [0.5], tolerance=3.0).first()["value"]
    assert abs(got - 5000 / 7) <= 3.0


def test_ties_single_values_and_empty(spark):
    df = spark.createDataFrame([("t", 2.0)] * 50 + [("one", 3.0)], "g string, v double")
    got = {(r["grp"], r["percentile"]): (r["value"], r["n_values"]) for r in quantiles.percentiles(df, F.col("g"), F.col("v"), [0.1, 0.5]).collect()}
    assert got == {("t", 0.1): (2.0, 50), ("t", 0.5): (2.0, 50), ("one", 0.1): (3.0, 1), ("one", 0.5): (3.0, 1)}
    assert quantiles.percentiles(df.where("false"), F.col("g"), F.col("v"), [0.5]).count() == 0
    with pytest.raises(ValueError):
        quantiles.percentiles(df, F.col("g"), F.col("v"), [1.5])
