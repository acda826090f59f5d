"""Registered queries of the subpackage against their SQL."""

import ast
import importlib
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from braidlake.llm import llm_queries as Q

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = Q.QUERIES[name](spark, FOLDER).toPandas(), con.execute(Q.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist())) and len(want)


def test_all_are_registered():
    assert set(Q.QUERIES) <= set(entry.queries()) and set(Q.ORACLE) <= set(entry.oracle_sql())


def test_shapes(spark):
    kinds = {"p1_found": "field string, rec_a bigint, rec_b bigint", "p3_found": "rec_id bigint, start_pos bigint, end_pos bigint", "p7_found": "doc_id bigint, item_id bigint"}
    for name, want in kinds.items():
        assert ", ".join(f"{c} {t}" for c, t in Q.QUERIES[name](spark, FOLDER).dtypes) == want


def test_nothing_else_imports_the_subpackage():
    root = Path(importlib.import_module("braidlake").__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in x for x in names), p
