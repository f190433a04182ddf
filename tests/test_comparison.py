import pytest
from pyspark.sql import functions as F

from kinespan.operators import comparison as C
from kinespan.operators import profiles as P
from kinespan.plans import groups, views


@pytest.fixture(scope="module")
def scenario(spark):
    """Four references in two groups, two validation executions; the distance to R4 is an abstention."""
    topk = spark.createDataFrame(
        [("A01", "36_47mo", "R1", 1, "10"), ("A01", "36_47mo", "R2", 2, "11"), ("A01", "48_59mo", "R3", 1, "12"), ("A01", "48_59mo", "R4", 2, "13"), ("A01", "48_59mo", "R4", 2, "13")],
        "action string, age string, segment_id string, rank int, child string",
    )
    main = spark.createDataFrame([("A01", "36_47mo", "R1"), ("A01", "48_59mo", "R3")], "action string, age string, medoid_segment_id string")
    cases = spark.createDataFrame([("V1", "20", "A01", "36_47mo"), ("V2", "21", "A01", "48_59mo")], "segment_id string, child string, action string, age string")
    training = spark.createDataFrame([(f"R{i}", str(9 + i)) for i in range(1, 5)], "segment_id string, child string")
    catalog = C.reference_catalog(topk, main, ["action", "age"])
    asked = C.requests(cases, catalog)
    plan = C.planned(asked, catalog)
    values = [(v, f"R{i}", None if i == 4 else i + (0.5 if v == "V2" else 0.0)) for v in ("V1", "V2") for i in range(1, 5)]
    distances = spark.createDataFrame(values, "segment_id string, reference_id string, distance double")
    known = training.select("segment_id").unionByName(cases.select("segment_id"))
    return dict(topk=topk, main=main, cases=cases, training=training, catalog=catalog, asked=asked, plan=plan, known=known, distances=distances, result=C.with_states(plan, distances, known))


def test_requests_and_plan(scenario):
    states = {(r["segment_id"], r["age_offset"]): (r["state"], r["n_references"]) for r in scenario["asked"].collect()}
    assert states == {
        ("V1", -1): ("fuera_de_dominio_etario", 0), ("V1", 0): ("solicitada", 2), ("V1", 1): ("solicitada", 2),
        ("V2", -1): ("solicitada", 2), ("V2", 0): ("solicitada", 2), ("V2", 1): ("sin_grupo_de_referencia", 0),
    }
    assert scenario["plan"].count() == 8


def test_states_and_controls(spark, scenario):
    found = {(r["segment_id"], r["reference_id"]): r["state"] for r in scenario["result"].collect()}
    assert {k: v for k, v in found.items() if k[1] == "R4"} == {("V1", "R4"): "sin_camino_admisible", ("V2", "R4"): "sin_camino_admisible"}
    assert sum(v == "calculada" for v in found.values()) == 6
    controls = lambda **x: {r["control"]: r["n_violations"] for r in C.separation_controls(*[x.get(k, scenario[k]) for k in ("training", "cases", "catalog", "plan", "result")]).collect()}
    assert set(controls().values()) == {0}
    result = scenario["result"]
    assert controls(result=result.unionByName(result.limit(1)))["duplicate_comparison"] == 1
    assert controls(result=result.where("reference_id <> 'R4'"))["plan_not_observed"] == 2
    assert controls(result=result.withColumn("child", result["reference_child"]))["own_reference"] == 8
    assert controls(training=scenario["training"].where("segment_id <> 'R2'"))["reference_outside_training"] == 1
    assert controls(cases=scenario["cases"].unionByName(spark.createDataFrame([("V3", "11", "A", "x")], scenario["cases"].schema)))["child_in_both"] == 1
    missing = C.with_states(scenario["plan"], scenario["distances"].where("false"), scenario["known"].where("segment_id <> 'R1'"))
    assert {r["reference_id"] for r in missing.where("state = 'sin_secuencia'").collect()} == {"R1"}


def test_catalog_problems(scenario):
    of = lambda catalog, training: {r["problem"]: r["n"] for r in C.catalog_problems(catalog, training, ["action", "age"]).collect()}
    assert set(of(scenario["catalog"], scenario["training"]).values()) == {0}
    half = C.reference_catalog(scenario["topk"], scenario["main"].where("age = '36_47mo'"), ["action", "age"])
    assert of(half, scenario["training"].where("segment_id <> 'R3'")) == {"groups_without_one_primary": 1, "references_outside_training": 1}


def test_unreadable_age_is_a_state(spark, scenario):
    odd = spark.createDataFrame([("V9", None, "A01", "??"), ("V8", None, None, None)], scenario["cases"].schema)
    assert {r["state"] for r in C.requests(odd, scenario["catalog"]).collect()} == {"fuera_de_dominio_etario"}


def test_profiles(scenario):
    found = {(r["segment_id"], r["summary"]): r for r in P.profiles(scenario["result"]).collect()}
    v2 = found["V2", "primaria"]
    assert (v2["d_Y"], v2["d_E"], v2["d_O"]) == (1.5, 3.5, None) and v2["margin_Y_E"] == -2.0 and v2["nearest"] == "Y" and not v2["complete"]
    assert found["V2", "mediana_topk"]["d_E"] is None and found["V2", "mediana_topk"]["d_Y"] == 2.0
    assert found["V1", "minimo_topk"]["d_E"] == 1.0 and found["V1", "minimo_topk"]["d_O"] is None


def test_ties_have_no_nearest_and_count_as_changed(spark):
    rows = [("s", "c", "A", "g", o, "R", True, d, "calculada") for o, d in ((-1, 1.0), (0, 1.0), (1, 2.0))]
    rows += [("t", "c", "A", "g", o, "R", True, d, "calculada") for o, d in ((-1, 3.0), (0, 1.0), (1, 2.0))]
    df = spark.createDataFrame(rows, "segment_id string, child string, action string, age string, age_offset int, reference_id string, is_primary boolean, distance double, state string")
    found = P.profiles(df)
    assert {r["nearest"] for r in found.where("segment_id = 's'").collect()} == {None}
    cover = {r["summary"]: r for r in P.coverage(found).collect()}
    assert cover["primaria"]["n_common"] == 2 and cover["primaria"]["n_changed"] == 1 and cover["primaria"]["nearest_E"] == 1
    roll = {(r["summary"], r["statistic"]): r for r in P.child_action_rollup(found).collect()}
    assert roll["primaria", "media"]["d_Y"] == 2.0 and roll["primaria", "maximo"]["d_O"] == 2.0 and roll["primaria", "media"]["n_executions"] == 2
    part = P.child_action_rollup(P.profiles(df.where("NOT (segment_id = 's' AND age_offset = 1)")))
    assert {r["d_O"] for r in part.collect()} == {None}


def test_two_primaries_give_no_primary_summary(spark):
    rows = [("s", "c", "A", "g", 0, r, True, 1.0, "calculada") for r in ("R1", "R2")]
    df = spark.createDataFrame(rows, "segment_id string, child string, action string, age string, age_offset int, reference_id string, is_primary boolean, distance double, state string")
    got = {r["summary"]: r["d_E"] for r in P.profiles(df).collect()}
    assert got == {"primaria": None, "mediana_topk": 1.0, "minimo_topk": 1.0}
    assert P.profiles(df.where("false")).count() == 0


def test_all_references_of_a_group_are_planned_against(spark):
    """The stored catalog has several matrices a group; each reference of a group that is asked for is in the plan."""
    folder = "/root/testdata/sf0.001"
    plan = groups.expected_comparisons_all(spark, folder).select("action", "target_age", "reference_id").distinct()
    asked = plan.select("action", F.col("target_age").alias("age")).distinct()
    stored = views.topk(spark, folder).join(asked, ["action", "age"]).select("action", "age", "segment_id").distinct()
    assert {tuple(r) for r in plan.collect()} == {tuple(r) for r in stored.collect()}


def test_a_hot_group_is_planned_in_many_tasks(spark, monkeypatch):
    """All requests ask for one group; no task makes most of its comparisons."""
    monkeypatch.setattr(C, "TASK_ROWS", 100, raising=False)
    executions = spark.createDataFrame([(f"s{i}", f"c{i}", "A01", "48_59mo") for i in range(100)], "segment_id string, child string, action string, age string")
    catalog = spark.createDataFrame([("A01", "48_59mo", f"r{i}", f"k{i}", i + 1, i == 0) for i in range(20)], "action string, age string, segment_id string, child string, rank int, is_primary boolean")
    plan = C.planned(C.requests(executions, catalog), catalog)
    per = [r["count"] for r in plan.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 2000 and max(per) < 400


def test_plan_meets_references_a_block_at_a_time(spark):
    """Every request with every reference of its group, and all requests of a group with one block before the next, so that rows repeat closely."""
    catalog = spark.range(600).selectExpr("'A1' AS action", "'36_47mo' AS age", "printf('r%03d', id) AS segment_id", "'c' AS child", "1 AS rank", "id = 0 AS is_primary")
    asked = spark.range(10).selectExpr("printf('s%d', id) AS segment_id", "'k' AS child", "'A1' AS action", "'36_47mo' AS age", "0 AS age_offset", "'36_47mo' AS target_age", "600L AS n_references", "'solicitada' AS state")
    got = [(r["segment_id"], r["reference_id"]) for r in C.planned(asked, catalog).collect()]
    assert sorted(got) == [(f"s{i}", f"r{j:03d}") for i in range(10) for j in range(600)]
    first = got[: 10 * C.BLOCK]
    assert len({s for s, _ in first}) == 10 and len({r for _, r in first}) == C.BLOCK
