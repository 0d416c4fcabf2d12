"""Every registered query against its SQL in DuckDB."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from assaylake.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert rows == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_optional_subpackage(tmp_path):
    root = Path(entry.__file__).parent
    (tmp_path / "assaylake").mkdir()
    for p in (root / "assaylake").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "assaylake" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'measurement_search' in q and not [x for x in q if x[:2] == 'op']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {str(tmp_path)!r}); {code}"], check=True, cwd=tmp_path)
