from pyspark.sql import functions as F

from kinespan.functions import labels


def applied(spark, f, cases):
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    return {r["c"]: r["v"] for r in df.select("c", f(F.col("c")).alias("v")).collect()}


def test_actions(spark):
    cases = {"A01": "A01", " a7": "A07", "A-09": "A09", "A001": "A01", "A13 ": "A13", "A120": "A120", "Ａ０５": "A05", "A": None, "": None, None: None, "A1B2": None}
    assert applied(spark, labels.action_key, cases) == cases


def test_ages(spark):
    cases = {"36_47mo": "36_47mo", "36-47mo": "36_47mo", "36 a 47 meses": "36_47mo", "60–71 mo": "60_71mo", " 48_59MO": "48_59mo", "48": None, "1_2_3": None, "": None, None: None}
    assert applied(spark, labels.age_key, cases) == cases


def test_children(spark):
    whole = {
        "17": "17", "0017": "17", "17.0": "17", " 17.00 ": "17", "+17": "17", "1.7e1": "17", "1.7E+1": "17", "１７": "17", "\t17\n": "17", "1e3": "1000", "0": None, "-1": None, "12.5": None,
        "1.25e1": None, "nan": None, "?": None, "": None, None: None, "123456789012345678901234567890": "123456789012345678901234567890", "17.": "17",
    }
    assert applied(spark, labels.whole_number_key, whole) == whole
    grouped = {"007": "7", "7.0": "7", "1e3": "1000", "x7": "x7", " a ": "a", "": "desconocido::s", None: "desconocido::s"}
    assert applied(spark, lambda c: labels.child_or_unknown(c, F.lit("s")), grouped) == grouped
    written = {"007": "007", "7.0": "7", "1e3": "1e3", " ": None, None: None}
    assert applied(spark, labels.child_text, written) == written


def test_small_rules(spark):
    assert applied(spark, labels.age_start, {"36_47mo": 36, " 48_59mo ": 48, "36-47mo": None, None: None}) == {"36_47mo": 36, " 48_59mo ": 48, "36-47mo": None, None: None}
    assert applied(spark, labels.split_pipe, {"a| b||c": 0, None: 0}) == {"a| b||c": ["a", "b", "c"], None: []}
    got = spark.range(1, 25).select("id", labels.references_for(F.col("id")).alias("k")).collect()
    assert [r["k"] for r in got] == [1] * 4 + [2] * 5 + [3] * 10 + [4] * 5
