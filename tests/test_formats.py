"""Formats, cache, dictionary and streaming."""

import os

import pytest
from pyspark.sql import types as T

from sluicebox.errors import UnsupportedKind
from sluicebox.operators import changes
from sluicebox.operators.cache import Breaker, QueryCache, fingerprint, index_by, normal_sql
from sluicebox.operators.tables import Table
from sluicebox.plans.catalog import DIALECTS, Dictionary, Kind, Product, best_version, detect
from sluicebox.sources import formats
from sluicebox.sources.reader import Query
from sluicebox.spec import ColumnSpec, TableSpec
from sluicebox.streaming.batcher import BatchConfig, batched_insert


def test_escaping(spark):
    df = spark.createDataFrame([("\\", "\\,"), ("\\'", "\\'#")], "a string, b string")
    fmt = formats.TextFormat(field=",", record="#", quote="'", escape="\\")
    lines = [r.line for r in formats.text_lines(df, fmt).collect()]
    assert "#".join(lines) == r"""'\\','\\\,'#'\\\'','\\\'\#'"""


def test_nulls_and_children(spark):
    schema = "ID int, Name string, Foo array<struct<ID:int,Name:string,Price:double>>"
    df = spark.createDataFrame([(1, "Boo", [(2, "Foo - 1", 125.0), (3, "Foo - 2", 250.0)]), (2, "Bar", None)], schema)
    flat = formats.flattened(df)
    assert flat.columns == ["ID", "Name", "Foo.ID", "Foo.Name", "Foo.Price"]
    lines = sorted(r.line for r in formats.text_lines(flat).collect())
    assert lines == ['1,"Boo",2,"Foo - 1",125', '1,"Boo",3,"Foo - 2",250', '2,"Bar",null,null,null']
    back = formats.nested(flat, many={"Foo": ["ID", "Name", "Price"]}, by=["ID"])
    assert sorted((r.ID, len(r.Foo)) for r in back.collect()) == [(1, 2), (2, 0)]
    assert {len(r.Foo) for r in formats.nested(flat, many={"Foo": ["ID", "Name", "Price"]}).collect() if r.Foo} == {1}


def test_depth(spark):
    df = spark.createDataFrame([(1, "Boo", [(2, "Foo - 1", 125.0), (3, "Foo - 2", 250.0)])], "ID int, Name string, Foos array<struct<ID:int,Name:string,Price:double>>")
    inner = formats.TextFormat(field="#", record="|", quote="'")
    line = formats.depth_lines(df, formats.TextFormat(), {"Foos": inner}).first().line
    assert line == """1,"Boo",'Foos.ID'#'Foos.Name'#'Foos.Price'|2#'Foo - 1'#125|3#'Foo - 2'#250"""


def test_time_and_header(spark):
    df = spark.sql("select timestamp'2019-01-02 00:00:00' as t")
    assert formats.text_lines(df).first().line == '"2019-01-02T00:00:00Z"'
    assert formats.TextFormat(case="lower_").header(["FooID", "Name"]) == '"foo_id","name"'


def test_nullify(spark):
    df = spark.createDataFrame([(0, "", 0.0)], "a int, b string, c double")
    assert formats.text_lines(df).first().line == '0,"",0'
    fmt = formats.TextFormat(nullify_empty=frozenset("abc"))
    assert formats.text_lines(df, fmt).first().line == "null,null,null"


def test_text_round_trip(spark, folder):
    df = spark.createDataFrame([(1, "x,y", 1.5), (2, None, 0.0)], "ID int, Name string, Price double")
    path = folder + "/csv"
    df.coalesce(1).write.option("header", True).option("nullValue", "null").csv(path)
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("price", T.DoubleType())])
    assert sorted(map(tuple, formats.read_text(spark, path, schema).collect())) == [(1, "x,y", 1.5), (2, None, 0.0)]
    assert formats.headers(spark, path) == ["ID", "Name", "Price"]
    with pytest.raises(KeyError):
        formats.read_text(spark, path, T.StructType([T.StructField("id", T.IntegerType())]))


def test_json_and_parquet(spark, folder):
    df = spark.createDataFrame([(1, 7.1, "A1"), (2, None, "A2")], "ID int, V double, N string")
    assert [r.line for r in formats.json_lines(df).collect()] == ['{"ID":1,"V":7.1,"N":"A1"}', '{"ID":2,"V":null,"N":"A2"}']
    formats.write_parquet(df, folder + "/p")
    assert sorted(map(tuple, spark.read.parquet(folder + "/p").collect())) == sorted(map(tuple, df.collect()))
    assert any(".zstd.parquet" in f for f in os.listdir(folder.removeprefix("file://") + "/p"))
    assert formats.load(df, folder + "/l", "json", columns=["n", "id", "other"]) == 2
    assert sorted(spark.read.json(folder + "/l").columns) == ["ID", "N"]
    formats.write_text(df, folder + "/t")
    assert spark.read.text(folder + "/t").count() == 2


def test_cache(spark, folder):
    spark.range(10).selectExpr("id", "id % 3 as k").createOrReplaceTempView("nums")
    now = [100.0]
    cache = QueryCache(spark, folder + "/cache", ttl=60, clock=lambda: now[0])
    query = Query("select id, k from nums where id >= ?", [2])
    assert cache.read(query).count() == 8 and cache.stats.kind == "write"
    spark.range(3).selectExpr("id", "id % 3 as k").createOrReplaceTempView("nums")
    assert cache.read(Query("SELECT id,  k from nums where id >= ?".replace(",  ", ", "), [2])).count() == 8
    assert cache.stats.kind == "lazy" and cache.stats.hits == 1
    assert cache.read(Query(query.sql, [1])).count() == 2 and cache.stats.kind == "write"
    assert cache.read(query, refresh=True).count() == 1
    now[0] += 61
    assert cache.read(query).count() == 1 and cache.stats.kind == "write"
    spark.range(3).selectExpr("id", "string(id) as k").createOrReplaceTempView("nums")
    assert cache.read(query).schema["k"].dataType == T.StringType() and cache.stats.kind == "write"


def test_warm_cache(spark, folder):
    spark.range(10).selectExpr("id", "nullif(id % 3, 2) as k").createOrReplaceTempView("keys")
    cache = QueryCache(spark, folder + "/cache")
    query = Query("select id, k from keys")
    assert cache.warm(query, "K") == 2
    out = cache.read(query).where("k in (0)")
    assert cache.stats.kind == "warm" and out.count() == 4
    assert "PartitionFilters: [isnotnull" in out._jdf.queryExecution().toString()


def test_broken_cache(spark):
    cache = QueryCache(spark, "nosuchfs://x/y", breaker=Breaker(limit=1))
    assert cache.read(Query("select 1 as a")).count() == 1 and cache.stats.error
    assert not cache.breaker.closed
    assert Breaker(limit=1, reset_after=0, failures=1, since=-1).closed


def test_fingerprints():
    assert normal_sql(" select  A\n from T where x = 'A  B' ") == "select a from t where x = 'A  B'"
    assert fingerprint("select 1") == fingerprint("SELECT  1") != fingerprint("select 1", [1])


def test_index(spark):
    df = spark.createDataFrame([(1, 2), (1, 1), (None, 5), (2, 3)], "k int, v int")
    assert {r.k: [x.v for x in r.bucket] for r in index_by(df, "k").collect()} == {1: [1, 2], 2: [3]}
    assert index_by(df.where("k = 1"), None).first().n == 2


def test_dictionary(spark):
    spark.sql("create table if not exists emp (id int, name string, salary decimal(7,2)) using parquet")
    d = Dictionary(spark)
    d.declare(TableSpec("emp", (ColumnSpec("id", "int", autoincrement=True, primary_key=True), ColumnSpec("name", unique=True), ColumnSpec("dept", "int", ref_table="dept"))))
    for kind in Kind:
        if kind not in (Kind.TABLE, Kind.VIEW):
            assert d.info(kind, name="emp").columns
    assert d.info("table", name="emp").where("COLUMN_KEY = 'PRI'").first().COLUMN_NAME == "id"
    assert d.info("table", name="emp").where("COLUMN_NAME = 'salary'").first().NUMERIC_SCALE == 2
    assert d.info("foreign_keys").first().REFERENCED_TABLE_NAME == "dept"
    assert d.info("constraints").count() == 3
    assert "emp" in [r.TABLE_NAME for r in d.info("tables").collect()]
    assert d.info("sequence_next_value", name="s").first().SEQUENCE_VALUE == 1
    assert d.info("sequence_next_value", name="s").first().SEQUENCE_VALUE == 2
    assert d.info("lock_get", name="l").first().SUCCESS == 1
    assert d.info("lock_get", name="l").first().SUCCESS == 0
    assert d.info("lock_release", name="l").first().SUCCESS == 1
    d.info("foreign_keys_check_off")
    assert not d.check_references
    assert d.session("k") is d.session("k")
    with pytest.raises(UnsupportedKind):
        d.info("nothing")
    spark.sql("drop table emp")


def test_products(spark):
    assert Product.parse("PostgreSQL 13.4 (Debian)") == Product("PostgreSQL", 13, 4, 0)
    assert Product.parse("8.0.26-log", "mysql") == Product("mysql", 8, 0, 26)
    assert detect(spark).name == "spark" and detect(spark, "jdbc:postgresql://h/db").name == "postgresql"
    assert best_version({(1, 0): "a", (3, 33): "b"}, Product("x", 3, 8)) == "b"
    assert best_version({(1, 0): "a"}, Product("x", 9, 9)) == "a"
    assert DIALECTS["postgresql"].placeholder == "$"


def test_stream(spark, folder):
    spec = TableSpec("s", (ColumnSpec("id", "int", autoincrement=True, primary_key=True), ColumnSpec("name")))
    table = Table(spark, folder + "/s")
    table.replace(spark.createDataFrame([], "id int, name string"))
    for i in range(3):
        spark.createDataFrame([(0, f"n{i}{j}") for j in range(4)], "id int, name string").coalesce(1).write.mode("append").json(folder + "/in")
    stream = spark.readStream.schema("id int, name string").option("maxFilesPerTrigger", 1).json(folder + "/in")
    seen = []
    query = batched_insert(stream, changes.Writer(table, spec), folder + "/cp", BatchConfig(once=True, batch=2), lambda b, n: seen.append(n))
    query.awaitTermination(120)
    assert sum(seen) == 12 and len(seen) == 3
    assert sorted(r.id for r in table.read().collect()) == list(range(1, 13))


def test_text_reads_what_it_writes(spark, folder):
    rows = [(1, "c,d"), (2, 'line\nbreak "quoted" \\ end\\'), (3, None), (4, ""), (5, "null"), (6, ",\n\\,")]
    df = spark.createDataFrame(rows, "id long, v string")
    formats.write_text(df, f"{folder}/own")
    assert sorted(map(tuple, formats.read_text(spark, f"{folder}/own", df.schema, header=False).collect())) == rows
    fmt = formats.TextFormat()
    lines = [fmt.header(["v", "id"]), '"a\\,b",7']
    spark.createDataFrame([("\n".join(lines),)], "v string").coalesce(1).write.text(f"{folder}/named")
    assert formats.headers(spark, f"{folder}/named") == ["v", "id"]
    assert [tuple(r) for r in formats.read_text(spark, f"{folder}/named", df.schema).collect()] == [(7, "a,b")]
