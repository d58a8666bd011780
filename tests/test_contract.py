"""The entry points, the queries against their SQL in DuckDB, and the separation of the optional folder."""

import ast
import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tessera.plans import catalogue, serving  # noqa: F401

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
SLOW = {"field_postings", "keyword_score_topk", "coverage_filter"}


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(set(catalogue.SQL) - SLOW))
def test_query_matches_sql(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    answer = oracle.execute(catalogue.SQL[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == expected


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_nothing_else_imports_the_optional_folder():
    optional = "tessera." + "llm"
    for path in glob.glob(f"{ROOT}/tessera/**/*.py", recursive=True) + glob.glob(f"{ROOT}/bench.py"):
        if "/llm/" in path:
            continue
        for node in ast.walk(ast.parse(open(path).read())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(optional) or n == "corpus_pipeline" for n in names), path
