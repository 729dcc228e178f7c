"""Every registered query against the SQL that states its result."""

import math

import duckdb
import pytest

from quillflow.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda t: tuple((v is None, str(type(v)), v) for v in t))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    sql = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_import_needs_no_session_and_no_optional_part(tmp_path, pipeline):
    """A fresh process can list the queries, also where the optional subpackage is gone, with its pipeline or without."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "quillflow"), tmp_path / "quillflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    if pipeline and os.path.exists(os.path.join(root, "corpus_pipeline.py")):
        shutil.copy(os.path.join(root, "corpus_pipeline.py"), tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for where in (root, str(tmp_path)):
        out = subprocess.run([sys.executable, "-c", code], cwd=where, env=env, capture_output=True, text=True, timeout=120)
        assert out.returncode == 0 and int(out.stdout.split()[-2]) >= 100, out.stderr
