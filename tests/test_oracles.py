"""Every registered panel query against its SQL, on the smallest tables."""

import math

import pytest

from gridsift import queries

FOLDER = "/root/testdata/sf0.001"


def plain(df):
    df = df[sorted(df.columns)]
    rows = [tuple(None if x is None or x != x else round(x, 5) if isinstance(x, float) else x for x in r) for r in df.astype(object).itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) & set(queries.ORACLES)))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, FOLDER)
    want = duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got.toPandas()), plain(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-5)) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


def test_every_oracle_has_a_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_nothing_but_the_entry_needs_the_training_data_package():
    import pathlib

    root = pathlib.Path(queries.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "gridsift.llm" not in path.read_text()


def test_entry_works_without_the_training_data_package(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(queries.__file__).resolve().parents[2]
    shutil.copytree(root / "gridsift", tmp_path / "gridsift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert not [n for n in q if n.startswith('op') or n == 'pipeline'] and set(e.oracle_sql()) <= set(q) and len(q) > 60"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)
