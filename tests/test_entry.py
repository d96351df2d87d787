"""The driver's contract over the smallest tables, and that the engine stands without llm."""

import ast
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from sluicebox import queries as engine

SF = "/root/testdata/sf0.001"


def norm(rows):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query_matches_sql(spark, name):
    got = engine.queries()[name](spark, SF)
    con = duckdb.connect()
    for p in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    expected = con.sql(engine.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert norm(map(tuple, got.select(*columns).collect())) == norm(expected.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_llm():
    root = pathlib.Path(__file__).parent.parent / "sluicebox"
    for path in root.rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


def queries_of_orders(spark, folder, name, keys):
    """Whether a query gives its SQL's rows on orders of these keys, all of one status."""
    path = f"{folder.removeprefix('file://')}/orders.parquet"
    duckdb.sql(f"copy (select unnest({keys})::bigint as o_orderkey, o_orderkey % 97 as o_custkey, 'O' as o_orderstatus, '1-URGENT' as o_orderpriority) to '{path}' (format parquet)")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{path}'")
    got, expected = engine.queries()[name](spark, folder), con.sql(engine.ORACLE[name])
    columns = sorted(got.columns)
    return norm(map(tuple, got.select(*columns).collect())) == norm(expected.select(*columns).fetchall())


def test_merge_where_moved_ids_exist(spark, folder):
    assert queries_of_orders(spark, folder, "merge_result", [5, 10, 12, 1000005, 1000010, 1000012, 2000005])


def test_upsert_where_moved_keys_exist(spark, folder):
    assert queries_of_orders(spark, folder, "upsert_rows", [1, 9, 18, 36, 5000009, 5000018, 5000036, 10000036])
