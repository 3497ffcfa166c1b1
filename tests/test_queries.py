"""Every query with SQL against DuckDB on the smallest tables."""

import pytest
from places import DATA, ROOT

from quirelight.queries import ORACLES, QUERIES


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert ours == theirs


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_imports_without_llm(tmp_path):
    import shutil
    import subprocess
    import sys


    shutil.copytree(f"{ROOT}/quirelight", tmp_path / "quirelight", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.queries()) and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_self_joins_have_equality_keys(spark):
    for name in ("headfoot_pairs", "page_numbers"):
        physical = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in physical and "Cartesian" not in physical
