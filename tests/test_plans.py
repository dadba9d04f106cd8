"""Every query of the library against its SQL, and small fixtures of its operators."""

import os
import subprocess
import sys

import pytest
from conftest import SF, rows_of, rows_of_sql

import __spark_entry__
from pagewright.operators import painted, resume
from pagewright.plans import checker, editing, files, geometry, matching, painting, readings, scripts, writing

NEW = (checker, editing, files, geometry, matching, painting, readings, scripts, writing)


@pytest.mark.parametrize(("module", "name"), [(m, n) for m in NEW for n in sorted(m.ORACLE_SQL)])
def test_query_matches_sql(spark, duck, module, name):
    got = rows_of(module.QUERIES[name](spark, SF))
    assert got == rows_of_sql(duck, module.ORACLE_SQL[name])
    assert got or name == "risk_pages"


def test_every_query_of_the_library_has_sql():
    names = {n for m in __spark_entry__.PLANS for n in m.QUERIES}
    assert names == {n for m in __spark_entry__.PLANS for n in m.ORACLE_SQL}


def test_stream_operators_of_broken_streams():
    assert painted.operations("") == [] and painted.operations("(never closed") == [] and painted.operations("<< /A (x") == []
    assert [o[:2] for o in painted.operations("] 1 [2 q 3 Q")] == [("q", ["]", "1"]), ("Q", ["3"])]
    assert [o[0] for o in painted.operations("BI /W 1 ID \x00\x01EIx EI Q")] == ["BI", "ID", "EI", "Q"]
    assert painted.operations("(" * 50_000 + ")" * 50_000 + " Tj")[0][0] == "Tj"


def test_bullet_items_of_several_lists(spark):
    rows = [("a", 0, "• one", 99.0), ("a", 1, "goes on", 12.0), ("a", 2, "Far off", 40.0), ("b", 0, "plain", 99.0), ("b", 1, "•", 12.0), ("b", 2, "two", 12.0)]
    lines = spark.createDataFrame([(*r, 10.0) for r in rows], "doc string, line_no int, text string, gap double, size double")
    got = sorted((r["doc"], r["item"], r["text"]) for r in resume.bullet_items(lines, "doc").collect())
    assert got == [("a", 0, "one goes on"), ("a", 1, "Far off"), ("b", 0, "plain"), ("b", 1, "two")]


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 130 and set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(__spark_entry__.__file__), capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-500:]
