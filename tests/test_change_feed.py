import random

from pyspark.sql import functions as F

from kinespan.operators.change_feed import DELETED, BucketedTable, buckets_for, last_changes, operation, review_changes

SCHEMA = "line_no long, op string, reviewer_id string, reference_id string, revision long, answers struct<final_status:string,actor_identity:string,failure_reasons:array<string>>"
OPS = ["insert", " Update", "U", "i", "D", "delete ", "Delete", "odd", None]


def log(n=600, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        reviewer = rng.choice(["rev-1", " REV-1 ", "Rev-2", "rev-3", None]) if rng.random() < 0.9 else f"rev-{i}"
        op = rng.choice(OPS)
        answers = None if op and op.strip().lower().startswith("d") else (rng.choice(["pass ", "FAIL", None]), "a", ["r"])
        out.append((i, op, reviewer, rng.choice(["S1", "S2", "S3", None]), rng.choice([0, 1, 2, 3, None]), answers))
    return out


def by_hand(lines):
    last = {}
    for n, op, reviewer, reference, revision, answers in lines:
        kind = (op or "").strip().lower()
        if kind not in {"i", "insert", "u", "update", "d", "delete"} or not (reviewer or "").strip() or reference is None or revision is None:
            continue
        key = (reviewer.strip().lower(), reference)
        if key not in last or (revision, n) >= last[key][0]:
            last[key] = ((revision, n), kind[0] == "d", answers)
    return {k: (r[0], a[0].strip().upper() if a and a[0] else None) for k, (r, gone, a) in last.items() if not gone}


def present(table, changes):
    rows = table.current(changes.drop("_order", "_arrival", DELETED).schema).collect()
    return {(r["reviewer_id"], r["reference_id"]): (r["revision"], r["final_status"]) for r in rows}


def made(spark, tmp_path, buckets=8):
    return BucketedTable(spark, str(tmp_path / "table"), ["reviewer_id", "reference_id"], buckets)


def test_batches_in_any_order_and_again(spark, tmp_path):
    lines = log()
    changes = review_changes(spark.createDataFrame(lines, SCHEMA))
    table = made(spark, tmp_path)
    for nr in (2, 0, 1, 0):  # late, out of order, and once more
        table.apply(changes.where(F.col("_arrival") % 3 == nr))
    assert present(table, changes) == by_hand(lines)
    assert table.version() == 4


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    lines = [(i, "i", f"r{i}", "S", 1, ("PASS", None, None)) for i in range(60)]
    table = made(spark, tmp_path)
    table.apply(review_changes(spark.createDataFrame(lines, SCHEMA)))
    before = table.manifest()
    table.apply(review_changes(spark.createDataFrame([(99, "u", "r7", "S", 2, ("FAIL", None, None))], SCHEMA)))
    after = table.manifest()
    assert before.keys() == after.keys() and sum(before[b] != after[b] for b in before) == 1
    assert table.manifest(1) == before


def test_a_version_without_its_mark_is_not_read(spark, tmp_path):
    table = made(spark, tmp_path)
    changes = review_changes(spark.createDataFrame([(1, "i", "r", "S", 1, ("PASS", None, None))], SCHEMA))
    table.apply(changes)
    (tmp_path / "table/manifest/2.json").write_text('{"buckets": 8, "fol')
    assert table.version() == 1 and present(table, changes) == {("r", "S"): (1, "PASS")}
    assert table.apply(changes) == 3 and present(table, changes) == {("r", "S"): (1, "PASS")}


def test_late_change_does_not_bring_back_a_deleted_row(spark, tmp_path):
    table = made(spark, tmp_path)
    changes = review_changes(spark.createDataFrame([(1, "i", "r", "S", 1, ("PASS", None, None)), (2, "d", "r", "S", 3, None), (3, "u", "r", "S", 2, ("FAIL", None, None))], SCHEMA))
    for n in (1, 2, 3):
        table.apply(changes.where(F.col("_arrival") == n))
    assert present(table, changes) == {}


def test_a_second_writer_merges_again(spark, tmp_path, monkeypatch):
    """Another writer commits while this one has its files ready: both writers' changes are there."""
    schema_changes = review_changes(spark.createDataFrame([(n, "i", f"r{n}", "S", 1, ("PASS", None, None)) for n in range(40)], SCHEMA))
    table, other = made(spark, tmp_path), made(spark, tmp_path)
    first, commit = schema_changes.where("_arrival < 20"), table._commit

    def late(*args):
        monkeypatch.setattr(table, "_commit", commit)
        other.apply(schema_changes.where("_arrival >= 20"))
        return commit(*args)

    monkeypatch.setattr(table, "_commit", late)
    assert table.apply(first) == 2
    assert len(present(table, schema_changes)) == 40 and table.versions() == [1, 2]


def test_superseded_files_go(spark, tmp_path):
    table = made(spark, tmp_path)
    lines = [(n, "u", "r", "S", n, ("PASS", None, None)) for n in range(5)]
    changes = review_changes(spark.createDataFrame(lines, SCHEMA))
    for n in range(5):
        table.apply(changes.where(F.col("_arrival") == n))
    assert table.versions() == [4, 5] and len(list((tmp_path / "table/data").iterdir())) == 2 and not list((tmp_path / "table/staged").iterdir())
    assert present(table, changes) == {("r", "S"): (4, "PASS")}


def test_the_base_is_not_shuffled(spark, tmp_path):
    changes = review_changes(spark.createDataFrame(log(), SCHEMA))
    table = made(spark, tmp_path)
    table.apply(changes.where("_arrival < 300"))
    last = last_changes(changes.where("reviewer_id IS NOT NULL"), table.keys).withColumn("_bucket", F.pmod(F.hash(*table.keys), F.lit(8)))
    table._write(last.repartition(8, *table.keys), str(tmp_path / "staged"), 8)
    merged = table._merged(str(tmp_path / "staged"), last.schema, table.manifest(), set(range(8)), 8)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_buckets_follow_the_size():
    assert buckets_for(0) == 8 and buckets_for(9 * (128 << 20)) == 16 and buckets_for(10**14) >= 65536


def test_empty_feed(spark, tmp_path):
    changes = review_changes(spark.createDataFrame([], SCHEMA))
    table = made(spark, tmp_path)
    assert table.apply(changes) == 0 and present(table, changes) == {}


def test_operations(spark):
    df = spark.createDataFrame([(o,) for o in OPS], "op string")
    assert [r[0] for r in df.select(operation(F.col("op"))).collect()] == ["i", "u", "u", "i", "d", "d", "d", None, None]
