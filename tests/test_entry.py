import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from siftprint.plans import oracle as sql
from siftprint.plans import queries as plans
from siftprint.session import info, ship

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_queries_are_their_sql(spark, small, name):
    ship(spark)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    rel = con.sql(sql.oracle_sql()[name])
    want = Counter(map(tuple, rel.fetchall()))
    got = plans.queries()[name](spark, small)
    assert sorted(got.columns) == sorted(rel.columns)
    assert Counter(map(tuple, got.select(*rel.columns).collect())) == want and want


def test_every_query_has_sql():
    assert plans.queries().keys() == sql.oracle_sql().keys()


def test_entry_without_the_optional_parts(tmp_path):
    for p in ("__spark_entry__.py", "siftprint"):
        src = ROOT / p
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / p)
    shutil.rmtree(tmp_path / "siftprint" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(plans.queries())), "False", str(len(plans.queries()))]


def test_nothing_else_imports_the_optional_part():
    for p in (ROOT / "siftprint").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p


def test_info(spark):
    assert info(spark)["master"] == "local[4]" and info(spark)["spark"] == spark.version
