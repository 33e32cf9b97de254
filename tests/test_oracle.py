"""Every query with SQL against DuckDB on the smallest tables, and that all is there without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quarry import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def rows(got, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in got)


@pytest.mark.skipif(not Path(DIR).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, db, name):
    df = registry.queries()[name](spark, DIR)
    want = db.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


def test_nothing_else_imports_llm():
    root = Path(registry.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "quarry.llm" not in f.read_text(), f


def test_entry_without_llm(tmp_path):
    root = Path(registry.__file__).parent.parent
    for f in (root / "quarry").rglob("*.py"):
        if "llm" not in f.parts:
            to = tmp_path / f.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(f.read_text())
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(x in ('pipeline', 'op1_mixing') for x in q))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:" + ":".join(p for p in sys.path if "site-packages" in p)})
    assert said.returncode == 0, said.stderr
    n, has = said.stdout.split()
    assert int(n) > 40 and has == "False"
