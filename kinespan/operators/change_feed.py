"""A table kept current by a feed of inserts, updates and deletes: bucketed copy-on-write.

The table is a folder. Its rows are hashed by key into buckets, each one sorted file; a version's
manifest says in which folder the files of each bucket lie. Applying changes routes them by the same
hash, merges them into the touched buckets only, writes their replacement and commits a new manifest
that goes on naming the untouched buckets' old files. Readers see the last committed manifest,
whatever else lies there.

The files are those of Spark's bucketed tables, so the merge is a sort-merge join in which neither the
base nor the staged changes are shuffled. A commit creates its manifest only if nobody has: a writer
that comes second merges its changes again, into what the first one left.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespan.functions.labels import BLANKS

#: Columns that the table has beside its keys and payload.
ORDER, ARRIVAL, DELETED, BUCKET = "_order", "_arrival", "_deleted", "_bucket"
#: Bytes of a bucket, about: what one task merges.
BUCKET_BYTES = 128 << 20
LEAST_BUCKETS, MOST_BUCKETS = 8, 100_000
#: Versions whose files stay for readers that began with them.
KEPT_VERSIONS = 2


def buckets_for(n_bytes: int) -> int:
    """Buckets for a table of about so many bytes: a power of two, so that a table that grew is split evenly."""
    n = LEAST_BUCKETS
    while n * BUCKET_BYTES < n_bytes and n < MOST_BUCKETS:
        n *= 2
    return n


def operation(c: Column) -> Column:
    """`i`, `u` or `d` for an operation by word or initial in any case, with outer blanks; null for any other text."""
    initial = F.substring(F.lower(F.trim(c, F.lit(BLANKS))), 1, 1)
    return F.when(F.lower(F.trim(c, F.lit(BLANKS))).isin("i", "insert", "u", "update", "d", "delete"), initial)


def last_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Of the changes to each key the one with the highest order, of several the one that arrived last.

    A plain aggregation with map-side combination: a key with a third of all changes stays one row per task.
    """
    rest = [c for c in changes.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(ORDER, ARRIVAL))
    return changes.groupBy(*keys).agg(top.alias("_last")).select(*keys, "_last.*")


class BucketedTable:
    """A copy-on-write table under `path`, hashed by `keys` into `buckets`; a table that has versions keeps the number it was made with."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = LEAST_BUCKETS):
        self.spark, self.path, self.keys, self._new_buckets = spark, path.rstrip("/"), keys, buckets

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _read(self, version: int) -> dict | None:
        """A version's manifest; None if it is absent or not written to its end."""
        fs, where = self._fs(f"{self.path}/manifest/{version}.json")
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def _numbers(self) -> list[int]:
        """The numbers of all manifests, also of broken ones, which no writer of this class leaves."""
        fs, where = self._fs(f"{self.path}/manifest")
        names = [f.getPath().getName().removesuffix(".json") for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n) for n in names if n.isdigit())

    def versions(self) -> list[int]:
        """The committed versions that are still there, in order."""
        return [n for n in self._numbers() if self._read(n) is not None]

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has files: at most one entry per bucket."""
        version = self.version() if version is None else version
        found = self._read(version) if version else None
        return {int(b): f for b, f in found["folders"].items()} if found else {}

    def _n_buckets(self, version: int) -> int:
        found = self._read(version) if version else None
        return found["buckets"] if found else self._new_buckets

    def _write(self, rows: DataFrame, folder: str, n: int) -> None:
        """`rows`, that lie in `n` partitions by the keys' hash, as one sorted file a bucket."""
        name = f"kinespan_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("path", folder).option("compression", "zstd").bucketBy(n, *self.keys).sortBy(*self.keys).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the session's name for it; the files stay

    def _bucketed(self, folder: str, schema, n: int) -> DataFrame:
        """The files of `folder` as a table of which Spark knows the buckets."""
        name, keys = f"kinespan_{uuid.uuid4().hex}", ", ".join(f"`{k}`" for k in self.keys)
        self.spark.sql(f"CREATE TABLE {name} ({schema.toDDL()}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {n} BUCKETS LOCATION '{folder}'")
        found = self.spark.table(name).select("*")
        found.schema  # noqa: B018  the plan is made while the name is there
        self.spark.sql(f"DROP TABLE {name}")
        return found

    def _base(self, manifest: dict[int, str], which: set[int] | None, n: int) -> DataFrame | None:
        """The rows of the buckets `which`, or of all; each folder read by bucket, without the buckets that later versions replaced."""
        by_folder: dict[str, list[int]] = {}
        for b, f in sorted(manifest.items()):
            if which is None or b in which:
                by_folder.setdefault(f, []).append(b)
        out = None
        for folder, held in sorted(by_folder.items()):
            schema = self.spark.read.parquet(folder).schema
            rows = self._bucketed(folder, schema, n).where(F.col(BUCKET).isin(held))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _merged(self, staged: str, schema, manifest: dict[int, str], touched: set[int], n: int) -> DataFrame:
        """The touched buckets' rows after the staged changes: of a key's two rows the later one."""
        fresh = self._bucketed(staged, schema, n)
        base = self._base(manifest, touched, n)
        if base is None:
            return fresh
        payload = [c for c in fresh.columns if c not in self.keys]
        pack = lambda df, name: df.select(*self.keys, F.struct(*payload).alias(name))
        met = pack(base, "_old").join(pack(fresh, "_new"), self.keys, "full")
        later = F.col("_old").isNull() | (F.struct(f"_new.{ORDER}", f"_new.{ARRIVAL}") > F.struct(f"_old.{ORDER}", f"_old.{ARRIVAL}"))
        row = F.when(F.col("_new").isNotNull() & later, F.col("_new")).otherwise(F.col("_old"))
        return met.select(*self.keys, row.alias("_row")).select(*self.keys, "_row.*").select(*fresh.columns)

    def _commit(self, version: int, folders: dict[int, str], n: int) -> bool:
        """Creates a version's manifest, whole or not at all; False if another writer has."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, draft = self._fs(f"{self.path}/draft-{uuid.uuid4().hex}.json")
        where = fs.makeQualified(self._fs(f"{self.path}/manifest/{version}.json")[1])
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps({"buckets": n, "folders": folders}).encode()))
        stream.close()
        fs.mkdirs(where.getParent())
        no_options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf).rename(fs.makeQualified(draft), where, no_options)
        except Py4JJavaError as error:
            fs.delete(draft, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def apply(self, changes: DataFrame) -> int:
        """Applies changes and returns the new version; the old one when there are none.

        `changes` has the keys, `_order`, `_arrival`, `_deleted` and the payload. Deleted keys stay as
        marked rows, so a change that arrives after the delete but belongs before it finds its place:
        batches may come in any order and more than once, the result is the same. A change that lacks
        part of its key is no change. Only the changes are shuffled, after those of a key were reduced to the last.
        """
        n = self._n_buckets(self.version())
        complete = changes.where(" AND ".join(f"`{k}` IS NOT NULL" for k in self.keys))
        last = last_changes(complete, self.keys).withColumn(BUCKET, F.pmod(F.hash(*self.keys), F.lit(n)))
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        self._write(last.repartition(n, *self.keys), staged, n)
        try:
            touched = {r[0] for r in self.spark.read.schema(last.schema).parquet(staged).select(BUCKET).distinct().collect()}
            while True:
                before = self.version()
                if not touched:
                    return before
                manifest = self.manifest(before)
                data = f"{self.path}/data/{uuid.uuid4().hex}"
                self._write(self._merged(staged, last.schema, manifest, touched, n), data, n)
                after = max(self._numbers(), default=0) + 1 if self.version() == before else before + 1
                if self._commit(after, manifest | dict.fromkeys(touched, data), n):
                    break
                self._delete(data)
        finally:
            self._delete(staged)
        self.expire()
        return after

    def _delete(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    def expire(self, keep: int = KEPT_VERSIONS) -> None:
        """Deletes all but the last `keep` versions, and the folders that only older ones name. What a writer has not committed yet stays."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        needed = {f for v in kept for f in self.manifest(v).values()}
        for v in old:
            for folder in set(self.manifest(v).values()) - needed:
                self._delete(folder)
            self._delete(f"{self.path}/manifest/{v}.json")

    def current(self, schema) -> DataFrame:
        """The present rows; `schema` serves while no version has files."""
        version = self.version()
        rows = self._base(self.manifest(version), None, self._n_buckets(version))
        if rows is None:
            return self.spark.createDataFrame([], schema)
        return rows.where(~F.col(DELETED)).drop(ORDER, ARRIVAL, DELETED, BUCKET)


def review_changes(log: DataFrame) -> DataFrame:
    """The review log as changes for `BucketedTable.apply`.

    Lines without reviewer, reference or revision, and lines whose operation is none of the three, are
    no changes. Reviewers are in lower case and statuses in upper case, without outer blanks; a blank
    reviewer is missing. `line_no` is the order of arrival.
    """
    reviewer = F.lower(F.trim("reviewer_id", F.lit(BLANKS)))
    status = F.upper(F.trim("answers.final_status", F.lit(BLANKS)))
    return log.select(
        F.when(reviewer != "", reviewer).alias("reviewer_id"),
        "reference_id",
        F.col("revision").cast("long").alias(ORDER),
        F.col("line_no").cast("long").alias(ARRIVAL),
        operation(F.col("op")).alias("_op"),
        F.col("revision").cast("long").alias("revision"),
        status.alias("final_status"),
        F.col("answers.actor_identity").alias("actor_identity"),
        F.col("answers.failure_reasons").alias("failure_reasons"),
    ).where("reviewer_id IS NOT NULL AND reference_id IS NOT NULL AND revision IS NOT NULL AND _op IS NOT NULL").withColumn(
        DELETED, F.col("_op") == "d"
    ).drop("_op")
