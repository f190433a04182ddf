import json

import numpy as np
import pytest

from kinespan import runs
from kinespan.operators import conditioning, dtw, reporting
from kinespan.sources import files, viewer


def test_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("excel_children,segment_id,other,action_code\n007,S1,x,A01\n7.0,0012,,\n")
    rows = files.read_csv(spark, str(tmp_path / "m.csv"), files.MANIFEST).collect()
    assert [tuple(r) for r in rows] == [("S1", "007", "A01", None), ("0012", "7.0", None, None)]
    assert files.read_csv(spark, str(tmp_path / "m.csv"), files.MANIFEST, ["segment_id"]).columns == ["segment_id"]


def test_reviews_keep_their_order(spark, tmp_path):
    lines = [
        {"reviewer_id": "a", "reference_id": "R", "revision": 2, "answers": {"final_status": "PASS"}}, {"reviewer_id": "b", "reference_id": "R", "revision": 1, "answers": {"final_status": "FAIL"}},
        {"reviewer_id": "a", "reference_id": "R", "revision": 2, "answers": {"final_status": "REVIEW"}},
    ]
    (tmp_path / "log.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\nnot json\n")
    log = files.read_reviews(spark, str(tmp_path / "log.jsonl")).selectExpr("reviewer_id", "reference_id", "revision", "position", "answers.final_status AS final_status")
    assert log.count() == 4
    states = reporting.review_states(log, "position")
    # reviewer b appeared last on the reference, so its state is in force
    assert [tuple(r) for r in states.collect()] == [("R", "b", "FAIL")]
    catalog = spark.createDataFrame([("R",), ("Q",)], "segment_id string")
    assert {tuple(r) for r in reporting.review_tally(catalog, states).collect()} == {("FAIL", 1), ("pendiente", 1)}


def test_archives_there_and_back(spark, tmp_path):
    xy = np.random.default_rng(1).normal(50, 9, size=(6, 17, 3))
    np.savez(tmp_path / "S1.npz", keypoints=xy, confidence=np.full((6, 17), 0.9))
    pose = files.read_poses(spark, str(tmp_path))
    assert pose.count() == 6 * 17 and {r[0] for r in pose.select("segment_id").distinct().collect()} == {"S1"}
    found, _ = conditioning.conditioned(pose)
    content = files.sequence_archives(found).first()["content"]
    with np.load(__import__("io").BytesIO(content)) as data:
        assert data["sequence"].shape == (6, 17, 2) and data["valid_mask"].all()
    np.savez(tmp_path / "bad.npz", keypoints=np.array([{"a": 1}], dtype=object), confidence=np.zeros((1, 17)))
    with pytest.raises(Exception, match="pickle"):
        files.read_poses(spark, str(tmp_path / "bad.npz")).count()


def test_tables_reports_and_fingerprints(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, ["x", "y"]), ("b", float("nan"), None)], "g string, v double, l array<string>")
    files.write_table(df, str(tmp_path / "t"), ["g"])
    assert spark.read.parquet(str(tmp_path / "t")).where("g = 'a'").count() == 1
    files.write_report(df, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == [{"g": "a", "v": 1.5, "l": "x|y"}, {"g": "b", "v": None, "l": None}]
    files.write_report(df, str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_text().startswith("g,v,l\na,1.5,x|y\n") and not list(tmp_path.glob("*.tmp"))
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.txt").write_text("one")
    before = files.bundle_fingerprint(files.file_fingerprints(spark, str(tmp_path / "d")))
    (tmp_path / "d/y.txt").write_text("two")
    assert {r["path"] for r in files.file_fingerprints(spark, str(tmp_path / "d")).collect()} == {"x.txt", "y.txt"}
    assert files.bundle_fingerprint(files.file_fingerprints(spark, str(tmp_path / "d"))) != before
    assert files.bundle_fingerprint(files.file_fingerprints(spark, str(tmp_path / "d"), "x*")) == before


def test_output_guard(tmp_path):
    with pytest.raises(SystemExit):
        files.checked_output(str(tmp_path / "repo/out"), str(tmp_path / "repo"))
    assert files.checked_output(str(tmp_path / "out"), str(tmp_path / "repo")).endswith("out")


def test_viewer():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(5, 17, 2)), rng.normal(size=(7, 17, 2))
    a[2, :10] = np.nan
    data = viewer.payload(a, b)
    assert data["path"] == [] and min(map(min, data["costs"])) == -1
    a[2] = 0
    data = viewer.payload(a, b)
    assert data["path"][0] == [0, 0] and data["path"][-1] == [4, 6]
    text = viewer.page("A <b>", data)
    assert "A &lt;b&gt;" in text and "http" not in text


def test_runs(spark, tmp_path):
    one, two = runs.Settings(), runs.Settings(execution={"workers": 9, "resume": True})
    assert one.fingerprint() == two.fingerprint() != runs.Settings(seed=1).fingerprint()
    (tmp_path / "s.json").write_text('{"grid": [3, 5], "repetitions": 2}')
    assert runs.Settings.load(str(tmp_path / "s.json")).grid == (3, 5)
    (tmp_path / "s.json").write_text('{"grdi": [3]}')
    with pytest.raises(ValueError):
        runs.Settings.load(str(tmp_path / "s.json"))
    runs.open_run(str(tmp_path), "r", one)
    with pytest.raises(FileExistsError):
        runs.open_run(str(tmp_path), "r", one)
    runs.open_run(str(tmp_path), "r", two, resume=True)
    with pytest.raises(ValueError):
        runs.open_run(str(tmp_path), "r", runs.Settings(seed=1), resume=True)
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "g string")
    done = spark.createDataFrame([("a", one.fingerprint()), ("b", "other")], "g string, fingerprint string")
    assert sorted(r["g"] for r in runs.pending(tasks, done, ["g"], two).collect()) == ["b", "c"]


def test_registered_functions(spark):
    dtw.register(spark)
    assert spark.sql("SELECT dtw_path(array(array(0.0D, 0.0D)), array(array(0.0D, 0.0D)))").first()[0][0]["cost"] == 0
