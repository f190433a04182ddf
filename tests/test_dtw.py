import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespan.operators import dtw


def packed(a):
    return [[None if not np.isfinite(v) else float(v) for v in f] for f in a.reshape(len(a), -1)]


def sequence(seed, n=None, missing=0.1, joints=5):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n or rng.integers(3, 9), joints, 2))
    a[rng.random(a.shape[:2]) < missing] = np.nan
    return a


def naive(a, b, support=0.5):
    joints = a.shape[1]
    total = np.full((len(a) + 1, len(b) + 1), np.inf)
    total[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            ok = np.isfinite(a[i]).all(axis=1) & np.isfinite(b[j]).all(axis=1)
            cost = np.inf if ok.sum() < np.ceil(support * joints) else np.sqrt(((a[i][ok] - b[j][ok]) ** 2).sum() * joints / ok.sum())
            total[i + 1, j + 1] = cost + min(total[i, j], total[i, j + 1], total[i + 1, j])
    return total[-1, -1] / (len(a) + len(b))


def test_support():
    assert dtw.required_joints(17) == 9 and dtw.required_joints(4) == 2
    for bad in (0, 1.1, -1):
        with pytest.raises(ValueError):
            dtw.required_joints(17, bad)


def test_local_cost():
    zeros, ones = np.zeros((1, 17, 2)), np.ones((1, 17, 2))
    assert dtw.frame_costs(zeros, ones)[0, 0] == pytest.approx(np.sqrt(34))
    ones[0, :5] = np.nan
    assert dtw.frame_costs(zeros, ones)[0, 0] == pytest.approx(np.sqrt(34))
    ones[0, :9] = np.nan
    assert dtw.frame_costs(zeros, ones)[0, 0] == np.inf
    with pytest.raises(ValueError):
        dtw.frame_costs(zeros, np.ones((1, 4, 2)))


def test_three_forms_agree(spark):
    pairs = [(sequence(i, missing=m), sequence(100 + i, missing=m)) for i, m in enumerate([0, 0.1, 0.2, 0.4] * 10)]
    df = spark.createDataFrame([(i, packed(a), packed(b)) for i, (a, b) in enumerate(pairs)], "i int, a array<array<double>>, b array<array<double>>")
    got = df.select("i", dtw.dtw_distance()("a", "b").alias("udf"), dtw.dtw_expression(F.col("a"), F.col("b")).alias("sql"), dtw.dtw_path()("a", "b").alias("path")).collect()
    abstained = 0
    for r in got:
        want = naive(*pairs[r["i"]])
        if not np.isfinite(want):
            abstained += 1
            assert r["udf"] is None and r["sql"] is None and r["path"] == []
            continue
        assert r["udf"] == pytest.approx(want, rel=1e-12) and r["sql"] == pytest.approx(want, rel=1e-12)
        a, b = pairs[r["i"]]
        assert (r["path"][0]["i"], r["path"][0]["j"]) == (0, 0) and (r["path"][-1]["i"], r["path"][-1]["j"]) == (len(a) - 1, len(b) - 1)
        assert sum(s["cost"] for s in r["path"]) / (len(a) + len(b)) == pytest.approx(want)
    assert 0 < abstained < len(got)


def test_itself_is_zero_and_one_bad_frame_abstains():
    a = sequence(1, 8, 0.0, 17)
    assert dtw.distance(a, a) == 0
    b = sequence(2, 9, 0.0, 17)
    b[4, :10] = np.nan
    assert dtw.distance(a, b) is None


def test_diagonal_comes_first():
    assert dtw.path(np.zeros((3, 3))) == [(0, 0), (1, 1), (2, 2)]
    assert dtw.path(np.zeros((2, 3))) == [(0, 0), (0, 1), (1, 2)]
    assert dtw.path(np.full((2, 2), np.inf)) == []


def test_null_empty_and_registered(spark):
    df = spark.createDataFrame([(None, [[1.0, 1.0]]), ([], [[1.0, 1.0]]), ([[0.0, 0.0]], [[3.0, 4.0]])], "a array<array<double>>, b array<array<double>>")
    assert [r[0] for r in df.select(dtw.dtw_distance()("a", "b")).collect()] == [None, None, 2.5]
    dtw.register(spark)
    df.createOrReplaceTempView("pairs")
    assert spark.sql("SELECT max(dtw_distance(a, b)) FROM pairs").first()[0] == 2.5


def test_pairs_of_groups(spark):
    rows = [(g, f"s{i}", packed(sequence(i, 4, 0.0))) for g, n in (("x", 4), ("y", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, segment_id string, frames array<array<double>>")
    assert dtw.pair_distances(df, ["g"]).count() == 6
    assert {tuple(r) for r in dtw.pair_counts(df, ["g"]).collect()} == {("x", 4, 6), ("y", 1, 0)}


@pytest.mark.parametrize("block", [2, 5, 64])
def test_tiles_make_every_pair_once(spark, block):
    """Groups of several blocks, a null group, 17 joints, 20 to 40 frames: each unordered pair once, with the distance of the pair by itself."""
    made = {(g, f"s{i:02d}"): sequence(i + 50 * len(g or ""), int(20 + i * 7 % 21), 0.1, 17) for g, n in (("x", 13), ("yy", 2), (None, 3)) for i in range(n)}
    made["x", "s03"][4, :10] = np.nan  # abstains with most
    df = spark.createDataFrame([(g, s, packed(a)) for (g, s), a in made.items()], "g string, segment_id string, frames array<array<double>>")
    got = dtw.pair_distances(df, ["g"], block=block).collect()
    assert len(got) == len({(r["g"], r["segment_id_a"], r["segment_id_b"]) for r in got}) == 78 + 1 + 3
    for r in got:
        assert r["segment_id_a"] < r["segment_id_b"]
        want = dtw.distance(made[r["g"], r["segment_id_a"]], made[r["g"], r["segment_id_b"]])
        assert (r["distance"] is None) if want is None else r["distance"] == pytest.approx(want, rel=1e-12)
    assert any(r["distance"] is None for r in got)


def test_joints_must_agree_within_a_pair():
    a, b = sequence(1, 4, 0.0, 5), sequence(2, 5, 0.0, 4)
    i = np.arange(2)
    assert np.isfinite(dtw.distances([a, b], [a, b], i, i)).all()
    with pytest.raises(ValueError):
        dtw.distances([a, b], [b, a], i, i)
