"""Every query of the catalog against its SQL in DuckDB."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from seqscan.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return float(x) if isinstance(x, decimal.Decimal) else x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


@pytest.fixture(scope="module")
def con(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", catalog.oracle_sql())
def test_same_as_sql(spark, sf_dir, con, name):
    df = catalog.queries()[name](spark, sf_dir)
    found = con.sql(catalog.oracle_sql()[name])
    assert sorted(found.columns) == sorted(df.columns)
    got = sorted(tuple(map(plain, (r[c] for c in sorted(df.columns)))) for r in df.collect())
    want = sorted(tuple(map(plain, r)) for r in found.project(", ".join(f'"{c}"' for c in sorted(df.columns))).fetchall())
    assert got == want and got
    kinds = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string"}
    assert [kinds[str(t)] for _, t in sorted(zip(found.columns, found.types))] == [t for _, t in sorted(df.dtypes)]


def test_entry_module_lists_everything():
    assert set(catalog.queries()) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_no_other_part_imports_llm():
    top = os.path.dirname(os.path.abspath(entry_module.__file__))
    for folder, _, names in os.walk(f"{top}/seqscan"):
        for n in names:
            if n.endswith(".py") and "/llm" not in folder:
                assert "seqscan.llm" not in open(f"{folder}/{n}").read()
