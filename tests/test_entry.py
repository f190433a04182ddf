import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402
from tools.compare import canonical  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
CORE = ["kinespan.plans.problems", "kinespan.plans.motion", "kinespan.plans.groups", "kinespan.plans.templates", "kinespan.plans.study"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p2_found", "p4_found"} <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_llm_is_imported_by_nothing_else():
    root = Path(entry.__file__).parent
    for p in root.glob("kinespan/**/*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "kinespan.llm" not in p.read_text(), p


@pytest.mark.parametrize(
    "name",
    ["p2_found", "p2_group_statistics", "p4_found", "p4_current_reviews", "normalize_pose", "dtw_distance", "dtw_expression_form", "motion_comparisons", "topk_diverse", "matrix_violations",
     "execution_profiles", "coverage_by_summary", "template_assignment", "set_geometry", "study_curves", "study_select_n", "study_size_summary", "review_tally"],
)
def test_against_sql(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cols = sorted(df.columns)
    sql = entry.oracle_sql()[name]
    assert sorted(con.sql(sql).columns) == cols
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})").fetchall()
    assert canonical([tuple(r) for r in df.select(*cols).collect()]) == canonical(want)
