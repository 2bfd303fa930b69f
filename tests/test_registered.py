"""Every registered query of the grid engine against its SQL; and the entry points with and without the subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def same(got, want):
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda df: sorted(map(tuple, df[columns].astype(object).values.tolist()), key=repr)
    assert order(got) == order(want)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, sql, name):
    same(catalog.QUERIES[name](spark, DATA).toPandas(), sql.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["raw_read", "raw_read_transposed"])
def test_raw_images_with_a_short_last_line(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{DATA}/events.parquet' WHERE event_id < 250) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    same(catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(catalog.ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 1000
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert str(ROOT) in spark.sparkContext.environment["PYTHONPATH"]  # workers can import the package


def test_entry_without_the_pipeline(tmp_path):
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    (tmp_path / "gridloom").symlink_to(ROOT / "gridloom")
    there = (ROOT / "gridloom" / "llm").exists()
    code = f"import __spark_entry__ as e; q = e.queries(); assert any(k.startswith('op') for k in q) == {there} and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_entry_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "gridloom"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    package = tmp_path / "gridloom"
    package.mkdir()
    for p in (ROOT / "gridloom").iterdir():
        if p.name != "llm":
            (package / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'jacobi_clamp' in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
