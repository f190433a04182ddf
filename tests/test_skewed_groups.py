import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespan.operators import skewed_groups as S


def rows(n=3000, seed=1):
    rng = random.Random(seed)
    bad = [None, float("nan"), float("inf"), -1.0]
    keys = [("hot", "x")] * 20 + [(f"k{i}", rng.choice(["x", None])) for i in range(30)] + [(None, "x")]
    return [(*rng.choice(keys), rng.choice(bad) if rng.random() < 0.1 else round(rng.random() * 9, 3), f"m{rng.randrange(50)}" if rng.random() > 0.05 else None, f"m{rng.randrange(50)}", 1) for _ in range(n)]


def by_hand(data):
    out = {}
    for a, b, v, m, o, _ in data:
        g = out.setdefault((a, b), [0, set(), []])
        g[0] += 1
        g[1] |= {x for x in (m, o) if x is not None}
        if v is not None and np.isfinite(v) and v >= 0:
            g[2].append(v)
    return {k: (n, len(m), len(v), min(v, default=None), sum(v) / len(v) if v else None) for k, (n, m, v) in out.items()}


def found(df):
    got = S.dense_group_statistics(df, ["code", "block"], "v", ["m", "o"])
    assert got.columns == ["code", "block", "n_rows", "n_members", "n_usable", "min_value", "mean_value"]
    return {(r[0], r[1]): tuple(r[2:]) for r in got.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k, x in a.items():
        assert x[:4] == b[k][:4] and x[4] == pytest.approx(b[k][4])


SCHEMA = "code string, block string, v double, m string, o string, n_rows int"


def test_matches_brute_force(spark):
    data = rows()
    same(found(spark.createDataFrame(data, SCHEMA)), by_hand(data))


def test_many_small_blocks_and_salted_dictionary(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(S, "CELLS", 1)
    data = rows(800, 2)
    same(found(spark.createDataFrame(data, SCHEMA)), by_hand(data))


def test_spellings_of_a_key_count_together(spark):
    df = spark.createDataFrame([(" a", 1.0, "m"), ("A", 2.0, "m"), ("b", 3.0, "n"), (None, 4.0, "n")], "k string, v double, m string")
    got = S.dense_group_statistics(df, ["k"], "v", ["m"], [F.lower(F.trim("k"))])
    assert {tuple(r) for r in got.collect()} == {("a", 2, 1, 2, 1.0, 1.5), ("b", 1, 1, 1, 3.0, 3.0), (None, 1, 1, 1, 4.0, 4.0)}
    assert {r["k"] for r in S.heavy_groups(got, share=0.5).collect()} == {"a"}


def test_several_blocks(spark):
    df = spark.range(20_000).selectExpr("id % 9000 AS code", "cast(null AS string) AS block", "double(id) AS v", "string(id % 7) AS m", "'z' AS o")
    got = S.dense_group_statistics(df, ["code"], "v", ["m", "o"])
    assert got.count() == 9000
    r = got.where("code = 8999").first()
    assert (r["n_rows"], r["n_members"], r["min_value"], r["mean_value"]) == (2, 3, 8999.0, 13499.0)


def test_empty_and_heavy(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert found(df.where("false")) == {}
    heavy = S.heavy_groups(S.dense_group_statistics(df, ["code", "block"], "v", ["m", "o"]), df.count(), 0.05)
    assert {tuple(r)[:2] for r in heavy.collect()} == {("hot", "x")}
    with pytest.raises(ValueError):
        S.dense_group_statistics(df, ["n_rows"], "v", ["m"])


def test_codes_are_dense(spark):
    codes, n = S.dense_codes(spark.range(500).selectExpr("string(id % 120) AS k"))
    assert n == 120 and sorted(r["code"] for r in codes.collect()) == list(range(120))
