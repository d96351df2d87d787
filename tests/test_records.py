"""Specs, projections, reads and pages."""

import pytest
from pyspark.sql import types as T

from sluicebox.errors import UnmatchedColumns
from sluicebox.functions.types import spark_type, widened
from sluicebox.sources.reader import Page, Query, Reader, among, equal_to, native_placeholders, paged, records, vendor_placeholders
from sluicebox.spec import ColumnSpec, TableSpec, field_case, flatten, in_case, match, nest, project

FOO = TableSpec("foo", (ColumnSpec("FooId", "int", primary_key=True), ColumnSpec("FooName"), ColumnSpec("Desc")))


@pytest.fixture(scope="module")
def t12(spark):
    rows = [(1, "John", "desc1", 101), (2, "Bruce", "desc2", 102), (3, "Name - 1", "desc3", 102), (4, "Name - 2", "desc4", 102), (5, "Name - 3", "desc5", 101)]
    return spark.createDataFrame(rows, "foo_id int, foo_name string, desc string, unk int")


def test_types():
    assert spark_type("decimal(7,2)") == T.DecimalType(7, 2)
    assert spark_type("decimal") == T.DoubleType()
    assert spark_type("varchar(20)") == T.StringType()
    assert spark_type("uint64") == T.DecimalType(20, 0)
    assert spark_type("binary") == T.BinaryType()
    assert spark_type("character varying") == T.StringType()
    assert spark_type("no such type") == T.StringType()
    assert widened(T.IntegerType()) == T.LongType()


def test_three_tiers_of_names():
    found = match(["foo_id", "FOONAME", "Desc", "x"], FOO)
    assert found.fields == {"FooId": "foo_id", "FooName": "FOONAME", "Desc": "Desc"}
    assert found.unmatched == ["x"]


def test_first_field_wins():
    spec = TableSpec("t", (ColumnSpec("a", "int", ("id",)), ColumnSpec("b", "int", ("id", "other"))))
    assert match(["id"], spec).fields == {"a": "id"}


def test_unmatched_is_an_error_or_residual(t12):
    with pytest.raises(UnmatchedColumns) as e:
        project(t12, FOO)
    assert e.value.columns == ["unk"]
    rows = project(t12, FOO, residual="rest").orderBy("FooId").collect()
    assert [r.rest["unk"] for r in rows] == ["101", "102", "102", "102", "101"]


def test_sequence_needs_identity():
    with pytest.raises(ValueError):
        ColumnSpec("x", sequence="s")


def test_identities_last_and_only():
    spec = TableSpec("t", (ColumnSpec("id", "int"), ColumnSpec("a"), ColumnSpec("b"), ColumnSpec("hidden", transient=True)))
    assert spec.identities == ["id"]
    assert spec.schema.names == ["id", "a", "b"]
    again = TableSpec.from_schema("t", spec.schema)
    assert again.identities == ["id"]


def test_write_columns(spark):
    spec = TableSpec("t", (ColumnSpec("id", "int"), ColumnSpec("a"), ColumnSpec("b")))
    df = spark.createDataFrame([(1, "x", "y")], "id int, a string, b string")
    assert spec.write_columns(df).columns == ["a", "b", "id"]
    assert spec.write_columns(df, ["B"]).columns == ["b", "id"]
    assert spec.keys_only(df).columns == ["id"]
    assert spec.declared(df).columns == ["id", "a", "b"]


def test_cases():
    assert field_case(["FOO_ID"]) == "upper_"
    assert in_case("FooID", "lower_") == "foo_id"
    assert in_case("foo_id", "camel") == "FooId"


def test_nest_and_flatten(spark):
    df = spark.createDataFrame([(1, 2, "x")], "id int, foo_id int, foo_name string")
    out = nest(df, "foo_", "foo")
    assert out.first().foo.asDict() == {"id": 2, "name": "x"}
    assert flatten(out, "foo", "foo_").first() == df.first()


def test_placeholders():
    assert vendor_placeholders("a = ? and b = '?' and c = ?", "postgresql") == "a = $1 and b = '?' and c = $2"
    assert vendor_placeholders("a = ?", "sqlserver") == "a = @p1"
    assert vendor_placeholders("a = ?", "mysql") == "a = ?"
    assert native_placeholders("a = $1 and b = '$2'", "postgresql") == "a = :p1 and b = '$2'"


def test_reader(spark, t12):
    t12.createOrReplaceTempView("t12")
    said = []
    reader = Reader(spark, "select foo_id, foo_name, desc from t12 where foo_id > ?", FOO, show_sql=said.append)
    assert sorted(r.FooId for r in reader.rows([3]).collect()) == [4, 5]
    assert sorted(r.FooId for r in reader.rows([4]).collect()) == [5]
    assert said and reader.columns([1]).names == ["FooId", "FooName", "Desc"]
    assert reader.first([100]) is None
    assert next(reader.maps([4])) == {"FooId": 5, "FooName": "Name - 3", "Desc": "desc5"}
    assert next(reader.tuples([4])) == (5, "Name - 3", "desc5")
    assert Reader(spark, t12, keep="foo_id = 2").rows().count() == 1
    assert Query("select 1 as x").on(spark).first().x == 1


@pytest.mark.parametrize(("offset", "limit", "ids"), [(1, 2, [3, 4, 5]), (10, 0, []), (0, 0, [1, 2, 3, 4, 5]), (0, 2, [1, 2, 3, 5])])
def test_pages(t12, offset, limit, ids):
    page = Page("UNK", keys=[101, 102], offset=offset, limit=limit, order=["foo_id"])
    assert sorted(r.foo_id for r in paged(t12, page).collect()) == ids


def test_page_pushes_its_limit(t12, capsys):
    paged(t12, Page("unk", offset=1, limit=2, order=["foo_id"])).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_single_key(t12):
    assert paged(t12, Page("unk", keys=[102], limit=1, order=["foo_id"])).count() == 1
    assert paged(t12, Page("unk", keys=[102], limit=1, order=["foo_id"], legacy_single_key=True)).count() == 3


def test_keys(spark, t12):
    assert among(t12, ["foo_id", "unk"], [(1, 101), (2, 101)]).count() == 1
    assert among(t12, ["foo_id"], list(range(2000))).count() == 5
    assert among(t12, ["foo_name"], ["John"]).count() == 1
    assert among(t12, ["foo_id"], []).count() == 0
    assert among(t12, ["foo_id"], spark.createDataFrame([(1,), (1,)], "k int")).count() == 1
    assert equal_to(t12, UNK=102, foo_name="").count() == 3


def test_records(spark):
    class Foo:
        FooId, FooName, Desc = 3, "z", None

    df = records(spark, [{"FooId": 1, "FooName": "x"}, (2, "y", "d"), Foo()], FOO)
    assert [tuple(r) for r in df.orderBy("FooId").collect()] == [(1, "x", None), (2, "y", "d"), (3, "z", None)]
    assert records(spark, {"FooId": 1}, FOO).count() == 1
    assert records(spark, df, FOO) is df


def test_json_and_bit(spark):
    spec = TableSpec("t", (ColumnSpec("id", "int"), ColumnSpec("o", T.StructType([T.StructField("Id", T.IntegerType())]), json=True), ColumnSpec("b", "bit", bit=True)))
    df = spark.createDataFrame([(1, '{"Id":7}', bytearray(b"\x01")), (2, "", bytearray(b"\x00"))], "id int, o string, b binary")
    a, b = project(df, spec).orderBy("id").collect()
    assert (a.o.Id, a.b, b.o, b.b) == (7, True, None, False)




def test_among_compares_values(spark):
    df = spark.createDataFrame([(1.0, 1), (1.5, 2), (2.0, 3)], "d double, i long")
    assert [r.d for r in among(df, ["d"], [1]).collect()] == [1.0]
    assert [r.d for r in among(df, ["d"], [1.5, 2]).collect()] == [1.5, 2.0]
    assert [r.i for r in among(df, ["i"], [1.5, 2.0]).collect()] == [2]
    assert among(df, ["i"], [1.5]).count() == 0
