"""Readers and writers of the study's files: manifests, pairs, catalogs, review logs, poses, small reports."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids are always texts; numbers are never inferred.
MANIFEST = "segment_id string, excel_children string, action_code string, age_bin_12m_label string"
COVARIATES = (
    "split string, institution_id string, excel_city string, camera_id string, pose2d_quality_label string, excel_sex string, "
    "duration_seconds double, age_months_final_excel double"
)
INDEX = "action_code string, age_bin_12m_label string, part string, n_clips long, n_pairs long, pairwise_path string"
PAIRS = "segment_id_a string, segment_id_b string, distance double"
PRIMARIES = "action_code string, age_bin_12m_label string, medoid_segment_id string"
TOPK = "action_code string, age_bin_12m_label string, segment_id string, rank int, excel_children string"
REVIEWS = "reviewer_id string, reference_id string, revision long, answers struct<final_status:string,actor_identity:string,failure_reasons:array<string>>"
POSE = "segment_id string, frame int, joint int, x double, y double, confidence double"
#: Rows that a report written by the driver may have.
REPORT_ROWS = 100_000


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file or folder with a header, columns found by name in any order; absent ones and empty fields are null."""
    wanted = spark.createDataFrame([], schema).schema
    found = spark.read.option("header", True).csv(path)
    named = {c.strip().lstrip("﻿"): c for c in found.columns}
    typed = [
        (F.col(f"`{named[f.name]}`").try_cast(f.dataType) if f.name in named else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted if columns is None or f.name in columns
    ]
    return found.select(*typed)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """A log of JSON lines with `position`, by which lines sort as they stand in their files; blank lines are left out.

    Lines that are no JSON objects have nulls, which every reader of the log leaves out.
    """
    text = spark.read.text(path).select("value", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")
    ).alias("position"))
    parsed = text.where(F.trim("value") != "").select(F.from_json("value", REVIEWS).alias("r"), "position")
    return parsed.select("r.*", "position")


def _poses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with np.load(io.BytesIO(content), allow_pickle=False) as data:
                xy, seen = data["keypoints"][:, :, :2].astype(float), data["confidence"].astype(float)
            frames, joints = seen.shape
            yield pd.DataFrame({
                "segment_id": Path(path).stem, "frame": np.repeat(np.arange(frames, dtype=np.int32), joints), "joint": np.tile(np.arange(joints, dtype=np.int32), frames),
                "x": xy[:, :, 0].ravel(), "y": xy[:, :, 1].ravel(), "confidence": seen.ravel(),
            })


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """Pose archives (`keypoints`, `confidence`) of a folder as a pose table; a file's name is its segment. Pickled arrays are refused."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(_poses, POSE)


def _archive(frame: pd.DataFrame) -> bytes:
    wide = frame.sort_values(["frame", "joint"])
    shape = (wide["frame"].nunique(), wide["joint"].nunique())
    out = io.BytesIO()
    np.savez_compressed(
        out, sequence=np.stack([wide["x"].to_numpy(np.float32).reshape(shape), wide["y"].to_numpy(np.float32).reshape(shape)], axis=2),
        valid_mask=wide["valid"].to_numpy(bool).reshape(shape), confidence=wide["confidence"].to_numpy(np.float32).reshape(shape),
    )
    return out.getvalue()


def sequence_archives(pose: DataFrame) -> DataFrame:
    """`segment_id`, `content`: every conditioned segment as a compressed archive. A segment is one recording and fits a task."""
    columns = ["segment_id", "frame", "joint", "x", "y", "confidence", "valid"]

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"segment_id": [key[0]], "content": [_archive(frame)]})

    return pose.select(*columns).groupBy("segment_id").applyInPandas(pack, "segment_id string, content binary")


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A zstd Parquet table, partitioned by `by`; it replaces what was there when it is complete."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one CSV or JSON file, put in place whole; arrays as `a|b`. More than REPORT_ROWS rows are refused."""
    flat = df.select(*[F.array_join(c, "|").alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes])
    rows = flat.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"more than {REPORT_ROWS} rows; write a table instead")
    frame = pd.DataFrame([tuple(r) for r in rows], columns=flat.columns)
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".tmp")
    if target.suffix == ".json":
        records = [{k: None if isinstance(v, float) and v != v else v for k, v in r.items()} for r in frame.to_dict("records")]
        part.write_text(json.dumps(records, ensure_ascii=False, allow_nan=False, default=str), encoding="utf-8")
    else:
        frame.to_csv(part, index=False)
    os.replace(part, target)


def file_fingerprints(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """`path` (relative), `n_bytes`, `sha256` of every file under `path`; files are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    root = path.rstrip("/").replace("file://", "")
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{root}/*", "")
    return files.select(relative.alias("path"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def bundle_fingerprint(files: DataFrame) -> str:
    """One digest of a set of files: of their lines `hash  path` in the order of paths. For bundles of up to a million files."""
    lines = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    text = F.array_join(F.transform(lines, lambda s: F.concat(s["sha256"], F.lit("  "), s["path"], F.lit("\n"))), "")
    return files.agg(F.sha2(text.cast("binary"), 256)).first()[0]


def checked_output(output: str, repository: str) -> str:
    """`output` as an absolute path, made if need be; inside `repository` it is refused, so that private results never get there."""
    target, root = Path(output).resolve(), Path(repository).resolve()
    if target == root or root in target.parents:
        raise SystemExit(f"the output folder {target} must lie outside {root}")
    target.mkdir(parents=True, exist_ok=True)
    return str(target)
