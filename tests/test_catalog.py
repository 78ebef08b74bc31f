"""Every registered query against its SQL on sf0.001, and the entry without the corpus operators."""

import datetime
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tessera import catalog

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(plain(v) for v in r) for r in cur.fetchall()]
    got = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_without_the_corpus_operators(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("tessera", ".git", "corpus_pipeline.py", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "tessera").mkdir()
    for p in (ROOT / "tessera").iterdir():
        if p.name != "llm":
            (tmp_path / "tessera" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})


def test_flagship(spark):
    row = catalog.flagship(spark, SF).collect()
    assert len(row) == 1 and row[0]["n"] > 0 and not isinstance(row[0]["n"], datetime.date)
