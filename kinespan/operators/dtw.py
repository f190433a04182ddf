"""Distances of motion sequences that have missing joints: dynamic time warping with abstention.

Two frames cost sqrt(J / k * sum of squared differences) over the k joints that both have, and
cannot meet if k is under the required support. Costs add up along the best path without a window,
divided by the sum of both lengths. Without an admissible path there is no distance: null, never 0.

A sequence is an array of frames, each an array x0, y0, x1, y1, ... with null for missing.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespan.workspace import spread, written

SUPPORT = 0.5
#: Segments of a block: a task makes the pairs of two blocks.
TILE = 64
#: Groups whose sizes are broadcast at most.
BROADCAST_GROUPS = 100_000
#: Pairs whose costs are summed together.
BATCH = 128
#: What results are stamped with.
METRIC_VERSION, CONDITIONING_VERSION = "joint_overlap_v1", "missing_safe_v1"


def required_joints(joints: int, support: float = SUPPORT) -> int:
    """The least number of common joints: ceil(support * joints)."""
    if not 0 < support <= 1:
        raise ValueError("support must lie in (0, 1]")
    return ceil(support * joints)


def local_cost(a: Column, b: Column, support: float = SUPPORT) -> Column:
    """The cost of two frames as a column expression; infinite where their common joints are too few."""
    joints = F.size(a) / 2
    pairs = F.transform(F.sequence(F.lit(0), joints.cast("int") - 1), lambda j: F.struct(
        F.get(a, 2 * j).alias("ax"), F.get(a, 2 * j + 1).alias("ay"), F.get(b, 2 * j).alias("bx"), F.get(b, 2 * j + 1).alias("by")))
    shared = F.filter(pairs, lambda p: p["ax"].isNotNull() & p["ay"].isNotNull() & p["bx"].isNotNull() & p["by"].isNotNull())
    square = lambda d: d * d
    total = F.aggregate(shared, F.lit(0.0), lambda t, p: t + square(p["ax"] - p["bx"]) + square(p["ay"] - p["by"]))
    enough = F.size(shared) >= F.ceil(joints * support)
    return F.when(enough, F.sqrt(total * joints / F.size(shared))).otherwise(F.lit(float("inf")))


def dtw_expression(a: Column, b: Column, support: float = SUPPORT) -> Column:
    """The distance as nested aggregates: an independent form of `dtw_distance` for checks and small tables."""
    inf = F.lit(float("inf"))
    first = F.concat(F.array(F.lit(0.0)), F.array_repeat(inf, F.size(b)))

    def next_row(row: Column, frame: Column) -> Column:
        steps = F.sequence(F.lit(0), F.size(b) - 1)
        return F.aggregate(
            steps, F.array(inf),
            lambda done, j: F.concat(done, F.array(local_cost(frame, F.get(b, j), support) + F.least(F.get(row, j + 1), F.element_at(done, -1), F.get(row, j)))),
        )

    last = F.element_at(F.aggregate(a, first, next_row), -1)
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some & (last < inf), last / (F.size(a) + F.size(b)))


def _stack(sequence) -> np.ndarray | None:
    """A packed sequence as (frames, joints, 2) with NaN for missing; None for a missing or an empty one."""
    if sequence is None or not len(sequence):
        return None
    out = np.array([np.asarray(f, dtype=np.float64) for f in sequence])
    return out.reshape(len(out), -1, 2)


def frame_costs(a: np.ndarray, b: np.ndarray, support: float = SUPPORT) -> np.ndarray:
    """All local costs of two sequences (frames, joints, 2)."""
    if a.shape[1:] != b.shape[1:] or not a.shape[1]:
        raise ValueError("sequences must have the same joints")
    seen_a, seen_b = np.isfinite(a).all(axis=2), np.isfinite(b).all(axis=2)
    both = seen_a.astype(float) @ seen_b.astype(float).T
    x, y = np.where(seen_a[..., None], a, 0.0), np.where(seen_b[..., None], b, 0.0)
    gap = x[:, None] - y[None]
    total = np.einsum("ijkc,ijkc,ik,jk->ij", gap, gap, seen_a.astype(float), seen_b.astype(float))
    with np.errstate(divide="ignore", invalid="ignore"):
        cost = np.sqrt(total * a.shape[1] / both)
    return np.where(both >= required_joints(a.shape[1], support), cost, np.inf)


def accumulated(cost: np.ndarray) -> np.ndarray:
    """Accumulated costs with a border row and column, filled diagonal by diagonal."""
    n, m = cost.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0.0
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        j = d - i
        best = np.minimum(np.minimum(total[i, j + 1], total[i + 1, j]), total[i, j])
        total[i + 1, j + 1] = cost[i, j] + best
    return total


def distance(a: np.ndarray, b: np.ndarray, support: float = SUPPORT) -> float | None:
    """The distance of two sequences; None where there is no admissible path.

    A frame that cannot meet any frame of the other side, or corners that cannot, settle it without the sums.
    """
    cost = frame_costs(a, b, support)
    can = np.isfinite(cost)
    if not (can[0, 0] and can[-1, -1] and can.any(axis=1).all() and can.any(axis=0).all()):
        return None
    last = accumulated(cost)[-1, -1]
    return float(last / sum(cost.shape)) if np.isfinite(last) else None


def path(cost: np.ndarray) -> list[tuple[int, int]]:
    """The best path through the costs from the first to the last frames; among equal steps the diagonal comes first, then the step in the first sequence."""
    total = accumulated(cost)
    if not np.isfinite(total[-1, -1]):
        return []
    i, j = cost.shape
    steps = []
    while i or j:
        steps.append((i - 1, j - 1))
        before = [(i - 1, j - 1), (i - 1, j), (i, j - 1)]
        i, j = min((p for p in before if min(p) >= 0), key=lambda p: total[p])
    return steps[::-1]


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates (sequence, frame, 2, joint) with 0 for missing, what is there (sequence, frame, joint), and lengths."""
    size = np.array([len(s) for s in sequences])
    xy = np.zeros((len(sequences), int(size.max()), 2, sequences[0].shape[1]))
    there = np.zeros((len(sequences), int(size.max()), sequences[0].shape[1]), bool)
    for i, s in enumerate(sequences):
        ok = np.isfinite(s).all(axis=2)
        there[i, : len(s)] = ok
        xy[i, : len(s)] = np.where(ok[..., None], s, 0.0).transpose(0, 2, 1)
    return xy, there, size


def distances(left: list[np.ndarray | None], right: list[np.ndarray | None], i: np.ndarray, j: np.ndarray, support: float = SUPPORT) -> np.ndarray:
    """The distances of the pairs `left[i]`, `right[j]`, NaN for none: as `distance`, for BATCH pairs of like length at a time."""
    out = np.full(len(i), np.nan)
    (n, k), (m, l) = (np.array([(0, 0) if s is None else s.shape[:2] for s in side], np.int64).reshape(-1, 2).T for side in (left, right))
    order = np.flatnonzero((n[i] > 0) & (m[j] > 0))
    if (k[i[order]] != l[j[order]]).any() or (k[i[order]] == 0).any():
        raise ValueError("sequences must have the same joints")
    order = order[np.lexsort((m[j[order]], n[i[order]], k[i[order]]))]
    cuts = np.flatnonzero(np.diff(k[i[order]])) + 1
    for part in (p[at : at + BATCH] for p in np.split(order, cuts) for at in range(0, len(p), BATCH)):
        a, b = np.unique(i[part], return_inverse=True), np.unique(j[part], return_inverse=True)
        out[part] = _batch(_padded([left[x] for x in a[0]]), _padded([right[x] for x in b[0]]), a[1], b[1], support)
    return out


def _batch(left: tuple, right: tuple, i: np.ndarray, j: np.ndarray, support: float) -> np.ndarray:
    (xa, ta, na), (xb, tb, nb) = left, right
    joints = ta.shape[2]
    shape = (len(i), ta.shape[1], tb.shape[1])
    both, total = np.zeros(shape), np.zeros(shape)
    for k in range(joints):
        mask = ta[i, :, None, k] & tb[j, None, :, k]
        both += mask
        gap = xa[i, :, None, 0, k] - xb[j, None, :, 0, k]
        square = gap * gap
        gap = xa[i, :, None, 1, k] - xb[j, None, :, 1, k]
        square += gap * gap
        total += square * mask
    with np.errstate(divide="ignore", invalid="ignore"):
        cost = np.where(both >= required_joints(joints, support), np.sqrt(total * joints / both), np.inf)
    n, m = shape[1:]
    sums = np.full((len(i), n + 1, m + 1), np.inf)
    sums[:, 0, 0] = 0.0
    # padding lies beyond each pair's own last cell and is never on the way to it
    for d in range(n + m - 1):
        r = np.arange(max(0, d - m + 1), min(n, d + 1))
        c = d - r
        best = np.minimum(np.minimum(sums[:, r, c + 1], sums[:, r + 1, c]), sums[:, r, c])
        sums[:, r + 1, c + 1] = cost[:, r, c] + best
    last = sums[np.arange(len(i)), na[i], nb[j]]
    return np.where(np.isfinite(last), last / (na[i] + nb[j]), np.nan)


def dtw_distance(support: float = SUPPORT):
    """A pandas UDF (a, b) -> distance; null for a missing or an empty sequence and for an abstention."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        found = distances([_stack(s) for s in a], [_stack(s) for s in b], np.arange(len(a)), np.arange(len(b)), support) if len(a) else np.zeros(0)
        return pd.Series(found, dtype="float64").where(np.isfinite(found), None)

    return run


def dtw_path(support: float = SUPPORT):
    """A pandas UDF (a, b) -> array of steps (i, j, cost); empty for an abstention, null for a missing sequence."""

    @F.pandas_udf("array<struct<i:int,j:int,cost:double>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(a, b):
            left, right = _stack(p), _stack(q)
            if left is None or right is None:
                out.append(None)
                continue
            cost = frame_costs(left, right, support)
            out.append([{"i": i, "j": j, "cost": float(cost[i, j])} for i, j in path(cost)])
        return pd.Series(out)

    return run


def register(spark: SparkSession, support: float = SUPPORT) -> None:
    """Makes `dtw_distance` and `dtw_path` callable from SQL."""
    spark.udf.register("dtw_distance", dtw_distance(support))
    spark.udf.register("dtw_path", dtw_path(support))


def _tile(names: list[str], support: float):
    """Of a tile's sequences, of side `a` and side `b`, all distances that are asked for."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["_side"] == "a"].sort_values("segment_id"), rows[rows["_side"] == "b"].sort_values("segment_id")
        ids_a, ids_b = a["segment_id"].to_numpy(object), b["segment_id"].to_numpy(object)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij"))
        if len(i) and rows["_same"].iloc[0]:  # one block with itself: each pair once
            keep = ids_a[i] < ids_b[j]
            i, j = i[keep], j[keep]
        found = distances([_stack(s) for s in a["frames"]], [_stack(s) for s in b["frames"]], i, j, support) if len(i) else np.zeros(0)
        first, second = ids_a[i], ids_b[j]
        swap = np.array([x > y for x, y in zip(first, second)], bool)
        first, second = np.where(swap, second, first), np.where(swap, first, second)
        out = pd.DataFrame({"segment_id_a": first, "segment_id_b": second, "distance": pd.Series(found, dtype="float64").where(np.isfinite(found), None)})
        for c in names:
            out[c] = rows[c].iloc[0]
        return out[[*names, "segment_id_a", "segment_id_b", "distance"]]

    return run


def pair_distances(sequences: DataFrame, groups: list[str], support: float = SUPPORT, block: int = TILE) -> DataFrame:
    """`groups`, `segment_id_a`, `segment_id_b`, `distance` for every unordered pair of a group's segments, null for an abstention.

    `sequences`: `groups`, `segment_id` (once in a group), `frames`. Pairs are what is asked for here. A group's
    segments are hashed into blocks of about `block`; a task gets two blocks, or one with itself, and makes
    their pairs. So a sequence is sent once for each block of its group, not once for each pair, and the
    largest group's pairs are shared by as many tasks as it has pairs of blocks. A null in a group column is a group of its own.
    """
    rows = sequences.select(*groups, "segment_id", "frames").where("segment_id IS NOT NULL")
    sizes = written(rows.groupBy(*groups).agg(F.greatest(F.ceil(F.count("*") / F.lit(block)), F.lit(1)).cast("int").alias("_blocks")), "sizes")
    same = reduce(lambda x, y: x & y, [F.col(f"r.`{g}`").eqNullSafe(F.col(f"s.`{g}`")) for g in groups])
    met = rows.alias("r").join((F.broadcast(sizes) if sizes.count() <= BROADCAST_GROUPS else sizes).alias("s"), same)
    placed = met.select(*[F.col(f"r.`{g}`").alias(g) for g in groups], "segment_id", "frames", "_blocks").withColumn("_block", F.pmod(F.xxhash64("segment_id"), F.col("_blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("_blocks") - 1)
    # against blocks from its own on a segment is on side a, against those up to its own on side b
    tiles = F.flatten(F.transform(others, lambda o: F.array_compact(F.array(
        F.when(o >= F.col("_block"), F.struct(F.col("_block").alias("_a"), o.alias("_b"), F.lit("a").alias("_side"))),
        F.when(o <= F.col("_block"), F.struct(o.alias("_a"), F.col("_block").alias("_b"), F.lit("b").alias("_side"))),
    ))))
    sent = placed.select(*groups, "segment_id", "frames", F.explode(tiles).alias("_t")).select(*groups, "segment_id", "frames", "_t.*").withColumn("_same", F.col("_a") == F.col("_b"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in groups) + ", segment_id_a string, segment_id_b string, distance double"
    tiles_in_all = sizes.agg(F.sum(F.col("_blocks").cast("long") * (F.col("_blocks") + 1) / 2)).first()[0] or 0
    return spread(sent, [*groups, "_a", "_b"], int(tiles_in_all)).groupBy(*groups, "_a", "_b").applyInPandas(_tile(groups, support), schema)


def planned_distances(plan: DataFrame, sequences: DataFrame, support: float = SUPPORT, pairs_of_task: int = TILE * TILE) -> DataFrame:
    """`segment_id`, `reference_id`, `distance` of every different pair of `plan` whose sequences both exist, null for an abstention.

    `sequences`: `segment_id` (once), `frames`. Both sides' ids are hashed into blocks, so many that two of them
    share about `pairs_of_task` pairs; a sequence is sent once to each pair of blocks that needs it.
    """
    pairs = written(plan.select("segment_id", "reference_id").na.drop().distinct(), "pairs")
    side = max(1, ceil((pairs.count() / pairs_of_task) ** 0.5))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    asked = pairs.select(block("segment_id").alias("_a"), block("reference_id").alias("_b"), "segment_id", "reference_id")
    ends = asked.select("_a", "_b", F.explode(F.array("segment_id", "reference_id")).alias("segment_id")).distinct()
    sent = ends.join(sequences.select("segment_id", "frames"), "segment_id").select(F.col("_a").alias("_c"), F.col("_b").alias("_d"), "segment_id", "frames")

    def run(wanted: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        at = {s: n for n, s in enumerate(held["segment_id"])}
        wanted = wanted[wanted["segment_id"].isin(at) & wanted["reference_id"].isin(at)]
        made = [_stack(s) for s in held["frames"]]
        i, j = (wanted[c].map(at).to_numpy(np.int64) for c in ("segment_id", "reference_id"))
        found = distances(made, made, i, j, support) if len(i) else np.zeros(0)
        return pd.DataFrame({"segment_id": wanted["segment_id"].to_numpy(object), "reference_id": wanted["reference_id"].to_numpy(object), "distance": pd.Series(found, dtype="float64").where(np.isfinite(found), None)})

    asked, sent = spread(asked, ["_a", "_b"], side * side), spread(sent, ["_c", "_d"], side * side)
    return asked.groupBy("_a", "_b").cogroup(sent.groupBy("_c", "_d")).applyInPandas(run, "segment_id string, reference_id string, distance double")


def pair_counts(segments: DataFrame, groups: list[str]) -> DataFrame:
    """`groups`, `n_clips`, `n_pairs`: the index of what `pair_distances` gives, without making the pairs."""
    n = F.col("n_clips")
    return segments.groupBy(*groups).agg(F.count_distinct("segment_id").alias("n_clips")).withColumn("n_pairs", (n * (n - 1) / 2).cast("long"))
