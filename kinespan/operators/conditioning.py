"""Conditioning of poses: validity, short gaps, centring, scale.

A pose table has a row per segment, frame and joint: `segment_id`, `frame`, `joint`, `x`, `y`,
`confidence`. Missing values are null from here on; NaN and infinite coordinates count as missing.
Joints, thresholds and pairs are parameters with the 17-joint layout as default.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The 17 joints in order.
JOINTS = [
    "nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow",
    "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle",
]
#: The hips, and the pairs of shoulders and hips whose distances give the scale.
HIPS = (11, 12)
TORSO = ((5, 6), (11, 12), (5, 11), (6, 12), (5, 12), (6, 11))
CONFIDENCE = 0.30
LONGEST_GAP = 3


def finite(c: Column) -> Column:
    """True for a number that is not null, NaN or infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def is_valid(x: Column, y: Column, confidence: Column, threshold: float = CONFIDENCE) -> Column:
    """True for an observation with finite coordinates and enough confidence that is not the undetected (0, 0)."""
    seen = finite(x) & finite(y) & finite(confidence) & (confidence >= threshold) & ~((x == 0) & (y == 0))
    return F.coalesce(seen, F.lit(False))


def fill_gaps(pose: DataFrame, threshold: float = CONFIDENCE, longest: int = LONGEST_GAP) -> DataFrame:
    """`pose` with invalid coordinates null, gaps of at most `longest` frames inside filled linearly, and `valid`.

    Neighbours are the joint's valid frames before and after; edges and longer gaps stay missing.
    """
    ok = is_valid(F.col("x"), F.col("y"), F.col("confidence"), threshold)
    masked = pose.withColumn("valid", ok).withColumn("x", F.when(F.col("valid"), F.col("x"))).withColumn("y", F.when(F.col("valid"), F.col("y")))
    joint = Window.partitionBy("segment_id", "joint").orderBy("frame")
    before, after = joint.rowsBetween(Window.unboundedPreceding, -1), joint.rowsBetween(1, Window.unboundedFollowing)
    known = F.when(F.col("valid"), F.struct("frame", "x", "y"))
    near = masked.withColumn("_a", F.last(known, True).over(before)).withColumn("_b", F.first(known, True).over(after))
    fill = ~F.col("valid") & (F.col("_b.frame") - F.col("_a.frame") - 1 <= longest)
    part = (F.col("frame") - F.col("_a.frame")) / (F.col("_b.frame") - F.col("_a.frame"))
    line = lambda c: F.when(fill, F.col(f"_a.{c}") + (F.col(f"_b.{c}") - F.col(f"_a.{c}")) * part).otherwise(F.col(c))
    return near.select(
        "segment_id", "frame", "joint", line("x").alias("x"), line("y").alias("y"), "confidence",
        (F.col("valid") | F.coalesce(fill, F.lit(False))).alias("valid"),
    )


def _root(where: Callable[[Column], Column], hips: Sequence[int]) -> tuple[Column, Column, Column]:
    """Origin and its source of a frame; `where` makes an aggregate of it, over a group or a window."""
    hip = F.col("joint").isin(*hips)
    mean = lambda c, of: where(F.avg(F.when(of & F.col("valid"), F.col(c))))
    hx, hy, vx, vy = mean("x", hip), mean("y", hip), mean("x", F.lit(True)), mean("y", F.lit(True))
    return F.coalesce(hx, vx), F.coalesce(hy, vy), F.when(hx.isNotNull(), "hips").when(vx.isNotNull(), "visible").otherwise("none")


def root_origins(filled: DataFrame, hips: Sequence[int] = HIPS) -> DataFrame:
    """`segment_id`, `frame`, `root_x`, `root_y`, `root_source`: the mean of the valid hips, else of all visible joints.

    `root_source` is `hips`, `visible` or `none`.
    """
    x, y, source = _root(lambda c: c, hips)
    return filled.groupBy("segment_id", "frame").agg(x.alias("root_x"), y.alias("root_y"), source.alias("root_source"))


def torso_scales(filled: DataFrame, pairs: Sequence[tuple[int, int]] = TORSO) -> DataFrame:
    """`segment_id`, `scale`, `scale_fallback`: the median torso distance, else the diagonal of all visible points; at least 1.

    The joints of a frame come together in one small map, so no join of the pose table with itself is needed.
    """
    named = sorted({j for p in pairs for j in p})
    at = [F.max(F.when((F.col("joint") == j) & F.col("valid"), F.struct("x", "y"))).alias(f"j{j}") for j in named]
    seen = F.col("valid")
    frames = filled.groupBy("segment_id", "frame").agg(
        *at, *[f(F.when(seen, F.col(c))).alias(n) for n, f, c in (("x0", F.min, "x"), ("x1", F.max, "x"), ("y0", F.min, "y"), ("y1", F.max, "y"))]
    )
    length = [F.hypot(F.col(f"j{a}.x") - F.col(f"j{b}.x"), F.col(f"j{a}.y") - F.col(f"j{b}.y")) for a, b in pairs]
    # all lengths of one recording, in one row
    all_lengths = F.array_sort(F.flatten(F.collect_list(F.filter(F.array(*length), lambda d: d > 1e-6))))
    whole = frames.groupBy("segment_id").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), all_lengths.alias("d"))
    n = F.size("d")
    median = F.when(n > 0, (F.get("d", F.floor((n - 1) / 2).cast("int")) + F.get("d", F.floor(n / 2).cast("int"))) / 2)
    diagonal = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return whole.withColumn("median", median).select(
        "segment_id", F.greatest(F.coalesce("median", diagonal, F.lit(1.0)), F.lit(1.0)).alias("scale"), F.col("median").isNull().alias("scale_fallback")
    )


def normalized(filled: DataFrame, roots: DataFrame, scales: DataFrame) -> DataFrame:
    """`filled` centred on the root and divided by the scale, as floats; missing stays missing."""
    return _scaled(filled.join(roots, ["segment_id", "frame"]), scales)


def _scaled(rooted: DataFrame, scales: DataFrame) -> DataFrame:
    met = rooted.join(scales, "segment_id")
    place = lambda c: F.when(F.col("valid"), (F.col(c) - F.col(f"root_{c}")) / F.col("scale")).cast("float")
    return met.select("segment_id", "frame", "joint", place("x").alias("x"), place("y").alias("y"), "confidence", "valid")


def diagnostics(filled: DataFrame, roots: DataFrame, scales: DataFrame) -> DataFrame:
    """Per segment: frames, missing share after filling, scale and how often the fallbacks were used."""
    missing = filled.groupBy("segment_id").agg(F.count_distinct("frame").alias("n_frames"), F.avg((~F.col("valid")).cast("double")).alias("missing_share"))
    fallbacks = roots.groupBy("segment_id").agg(
        F.count_if(F.col("root_source") == "visible").alias("root_fallback_frames"), F.count_if(F.col("root_source") == "none").alias("root_no_support_frames")
    )
    return missing.join(fallbacks, "segment_id").join(scales, "segment_id")


def conditioned(pose: DataFrame, hips: Sequence[int] = HIPS, pairs: Sequence[tuple[int, int]] = TORSO, threshold: float = CONFIDENCE, longest: int = LONGEST_GAP) -> tuple[DataFrame, DataFrame]:
    """The normalized pose table and the diagnostics. Segments without rows are in neither.

    The pose table is shuffled once, by segment, which all windows, sums and joins below go on from: a segment is one recording.
    """
    filled = fill_gaps(pose.repartition("segment_id"), threshold, longest)
    roots, scales = root_origins(filled, hips), torso_scales(filled, pairs)
    frame = Window.partitionBy("segment_id", "frame")
    x, y, _ = _root(lambda c: c.over(frame), hips)
    return _scaled(filled.withColumns({"root_x": x, "root_y": y}), scales), diagnostics(filled, roots, scales)


def batch_summary(found: DataFrame) -> DataFrame:
    """One row over `diagnostics`: segments, mean missing share, segments with an alternative root, with the scale's fallback."""
    return found.agg(
        F.count("*").alias("n_segments"), F.avg("missing_share").alias("mean_missing_share"),
        F.count_if(F.col("root_fallback_frames") > 0).alias("n_root_fallback"), F.count_if("scale_fallback").alias("n_scale_fallback"),
    )


def sequences(pose: DataFrame) -> DataFrame:
    """`segment_id`, `n_frames`, `frames`: the table packed as an array of frames, each x0, y0, x1, y1, ... with null for missing.

    A segment is one recording, so its frames fit a row. Frames come in order; joints absent from a frame shift nothing
    only if every frame lists all of them, which `sequence_violations` checks.
    """
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("joint", "x", "y"))), lambda s: F.array(s["x"].cast("double"), s["y"].cast("double"))))
    rows = pose.groupBy("segment_id", "frame").agg(flat.alias("row"))
    packed = rows.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("frame", "row"))).alias("f"))
    return packed.select("segment_id", F.size("f").alias("n_frames"), F.transform("f", lambda s: s["row"]).alias("frames"))


def sequence_violations(packed: DataFrame, joints: int = len(JOINTS), version: str | None = None) -> DataFrame:
    """`segment_id`, `violation` for sequences that must not be compared: no frames, a wrong width, a coordinate that is
    half missing or not finite, another preprocessing version."""
    width = 2 * joints
    bad_number = F.exists("frames", lambda f: F.exists(f, lambda v: v.isNotNull() & (F.isnan(v) | (F.abs(v) == float("inf")))))
    half = F.exists("frames", lambda f: F.exists(F.sequence(F.lit(0), F.lit(joints - 1)), lambda j: F.get(f, 2 * j).isNull() != F.get(f, 2 * j + 1).isNull()))
    checks = [
        F.when(F.col("frames").isNull() | (F.size("frames") == 0), "no_frames"),
        F.when(F.exists("frames", lambda f: F.size(f) != width), "wrong_width"),
        F.when(bad_number, "not_finite"),
        F.when(half, "half_missing"),
    ]
    if version is not None:
        checks.append(F.when(~F.col("preprocessing_version").eqNullSafe(version), "other_version"))
    found = packed.select("segment_id", F.explode(F.array_compact(F.array(*checks))).alias("violation"))
    return found


def joint_subset(frames: Column, joints: Sequence[int]) -> Column:
    """The frames of a packed sequence with the given joints only."""
    return F.transform(frames, lambda f: F.array(*[F.get(f, F.lit(2 * j + i)) for j in joints for i in (0, 1)]))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two normalized pose tables that differ in any value, by key: a null-safe full comparison."""
    a, b = left.alias("a"), right.alias("b")
    keys = ["segment_id", "frame", "joint"]
    met = a.join(b, keys, "full")
    same = F.lit(True)
    for c in ("x", "y", "valid"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return met.where(~same).select(*keys)
