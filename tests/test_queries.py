"""Every registered query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from weir.plans import registry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    got = registry.QUERIES[name](spark, SF_DIR)
    columns = sorted(got.columns)
    rows = sorted(tuple(_plain(r[c]) for c in columns) for r in got.collect())
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    names = ", ".join(f'"{c}"' for c in columns)
    want = sorted(tuple(map(_plain, r)) for r in con.execute(f"SELECT {names} FROM ({registry.ORACLE_SQL[name]})").fetchall())
    assert rows == want


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_nothing_else_needs_the_training_data_operators():
    root = Path(__file__).parent.parent / "weir"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "llm import" not in f.read_text() and "import corpus_pipeline" not in f.read_text(), f
