"""Tables, sequences, writes, merges and validation."""

import pytest
from pyspark.sql import functions as F

from sluicebox.errors import ConstraintViolation, DuplicateKey, MissingIdentity
from sluicebox.operators import changes, merge, sequences, validate
from sluicebox.operators.tables import Table
from sluicebox.spec import ColumnSpec, TableSpec

FOO = TableSpec("foo", (ColumnSpec("foo_id", "int", primary_key=True, autoincrement=True), ColumnSpec("foo_name"), ColumnSpec("bar", "int")))
SCHEMA = "foo_id int, foo_name string, bar int"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, folder):
    t = Table(spark, folder + "/foo")
    t.replace(spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], SCHEMA))
    return t


@pytest.mark.parametrize(("value", "inc", "start", "n", "out"), [(1, 1, 1, 3, 4), (1, 2, 3, 1, 5), (7, 2, 3, 3, 13), (1, 2, 3, 3, 9), (25, 10, 5, 2, 45), (5, 10, 15, 2, 35), (3, 10, 5, 2, 25), (13, 10, 5, 2, 35)])
def test_next_value(value, inc, start, n, out):
    assert sequences.Sequence(value, inc, start).next_value(n) == out


@pytest.mark.parametrize(("value", "inc", "start", "n", "out"), [(4, 1, 1, 3, 1), (35, 10, 5, 1, 25), (35, 10, 5, 2, 15), (5, 10, 15, 2, 15), (38, 10, 5, 2, 15), (12, 5, 2, 1, 7), (250, 50, 100, 3, 100), (10, 1, 1, 4, 6)])
def test_min_value(value, inc, start, n, out):
    assert sequences.Sequence(value, inc, start).min_value(n) == out


def test_ids_for_zero_only(spark):
    df = spark.createDataFrame([(0, "x", 1), (9, "y", 2), (None, "z", 3)], SCHEMA)
    assert rows_of(sequences.assign_ids(df, "foo_id", 5, 10, ["bar"])) == [(5, "x", 1), (9, "y", 2), (15, "z", 3)]


def test_numbers_across_partitions(spark):
    out = sequences.numbered(spark.range(0, 1000, 1, 7).withColumn("k", F.col("id") * -1), "n", ["k"]).collect()
    assert sorted((r.n, r.id) for r in out) == [(i, 999 - i) for i in range(1000)]


def test_reserve():
    r = sequences.Registry()
    assert r.reserve("s", 3, lambda: 6).value == 7
    assert r.reserve("s", 1).value == 10


def test_insert_assigns_ids(spark, table):
    writer = changes.Writer(table, FOO, batch=2)
    done = writer.insert(spark.createDataFrame([(0, "d", 4), (0, "e", 5), (0, "f", 6)], SCHEMA))
    assert (done.affected, done.last_id) == (3, 6)
    assert [r[0] for r in rows_of(table.read())] == [1, 2, 3, 4, 5, 6]


def test_insert_duplicate(spark, table):
    writer = changes.Writer(table, FOO)
    with pytest.raises(DuplicateKey):
        writer.insert(spark.createDataFrame([(3, "x", 0)], SCHEMA))
    writer.insert(spark.createDataFrame([(3, "x", 0), (9, "y", 1)], SCHEMA), on_duplicate="update")
    assert rows_of(table.read()) == [(1, "a", 1), (2, "b", 2), (3, "x", 0), (9, "y", 1)]


def test_update_and_presence(spark, table):
    writer = changes.Writer(table, FOO)
    assert writer.update(spark.createDataFrame([(1, "A", 10), (7, "none", 1)], SCHEMA)).affected == 1
    marked = spark.createDataFrame([(2, "B", 20, (True, False)), (3, "C", 30, (False, False))], SCHEMA + ", has struct<foo_name:boolean,bar:boolean>")
    assert writer.update(marked, "has").affected == 1
    assert rows_of(table.read()) == [(1, "A", 10), (2, "B", 2), (3, "c", 3)]


def test_composite_key(spark):
    old = spark.createDataFrame([("u1", "google", "old"), ("u1", "github", "keep")], "u string, p string, t string")
    new = changes.updated(old, spark.createDataFrame([("u1", "google", "new")], "u string, p string, t string"), ["u", "p"])
    assert rows_of(new) == [("u1", "github", "keep"), ("u1", "google", "new")]


def test_delete(spark, table):
    writer = changes.Writer(table, FOO)
    assert writer.delete(spark.createDataFrame([(1, None, None), (3, None, None), (8, None, None)], SCHEMA)).affected == 2
    assert rows_of(table.read()) == [(2, "b", 2)]
    with pytest.raises(MissingIdentity):
        changes.Writer(table, TableSpec("t", (ColumnSpec("x"),))).delete(spark.createDataFrame([("x",)], "x string"))


def test_defaults_and_hooks(spark, table):
    writer = changes.Writer(table, FOO, defaults={"bar": "42"}, before=[lambda d: d.withColumn("foo_name", F.upper("foo_name"))])
    writer.insert(spark.createDataFrame([(0, "d", 0)], SCHEMA))
    assert rows_of(table.read())[-1] == (4, "D", 42)


RULE = "ID int, TAG string, ENTITY string, ENTITY_ID bigint, FEATURE_VALUE string"


@pytest.fixture
def rules(spark, folder):
    t = Table(spark, folder + "/rule")
    t.replace(spark.createDataFrame([(2, "CAMP:1", "CAMP", 1, "1"), (1, "CREA:2", "CREA", 2, "2"), (3, "CAMP:303", "CAMP", 303, "303")], RULE))
    return t


KEY = ["ENTITY", "ENTITY_ID", "FEATURE_VALUE"]


def test_merge_insert_delete(spark, rules):
    source = spark.createDataFrame([(0, "CREA:2", "CREA", 2, "2"), (0, "CAMP:304", "CAMP", 304, "304"), (0, "CAMP:4", "CAMP", 4, "4"), (0, "CAMP:4", "CAMP", 4, "6")], RULE)
    result = merge.Merge(rules, merge.MergeConfig(KEY, "ID")).run(source)
    assert (result.inserted, result.deleted, result.kept, result.affected) == (3, 2, 1, 5)
    got = rows_of(rules.read())
    assert (1, "CREA:2", "CREA", 2, "2") in got and sorted(r[0] for r in got) == [1, 4, 5, 6]
    assert result.report().startswith("delete: 2")


def test_merge_with_updates(spark, rules):
    source = spark.createDataFrame([(2, "CAMP:1", "CAMP", 1, "changed"), (1, "CREA:2", "CREA", 2, "2"), (0, "new", "X", 9, "9")], RULE)
    result = merge.Merge(rules, merge.MergeConfig(KEY, "ID", strategy="insert+update+delete")).run(source)
    assert (result.inserted, result.updated, result.deleted, result.kept) == (1, 1, 1, 1)
    assert sorted(r[0] for r in rows_of(rules.read())) == [1, 2, 4]


@pytest.mark.parametrize("strategy", ["insert+delete", "insert+update+delete", "upsert+delete"])
def test_merge_empty_sides(spark, rules, strategy):
    config = merge.MergeConfig(KEY, "ID", strategy=strategy)
    empty = spark.createDataFrame([], RULE)
    assert merge.Merge(rules, config).run(empty).deleted == 3
    assert rules.read().count() == 0
    source = spark.createDataFrame([(0, "a", "A", 1, "1")], RULE)
    assert merge.Merge(rules, config).run(source).inserted == 1


def test_merge_duplicates_and_null_keys(spark):
    target = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, k string")
    source = spark.createDataFrame([(0, "a", 1), (0, "a", 2), (0, None, 3)], "id int, k string, pos int")
    found = merge.classify(source, target, merge.MergeConfig(["k"], "id", position="pos"))
    got = sorted((r.action, r.src.pos if r.src else None, r.dst.id if r.dst else None) for r in found.collect())
    assert got == [("delete", None, 2), ("keep", 2, 1), ("keep", 3, 3)]


def test_merge_repeated_source_ids(spark, rules):
    source = spark.createDataFrame([(7, "a", "A", 1, "1"), (7, "b", "B", 1, "1")], RULE)
    with pytest.raises(DuplicateKey):
        merge.Merge(rules, merge.MergeConfig(KEY, "ID", strategy="upsert+delete")).run(source)
    assert rules.read().count() == 3


def test_merge_keys_property(spark, rules):
    source = spark.range(50).selectExpr("0 as ID", "'t' as TAG", "'E' as ENTITY", "id % 20 as ENTITY_ID", "string(id % 20) as FEATURE_VALUE")
    merge.Merge(rules, merge.MergeConfig(KEY, "ID")).run(source)
    assert rows_of(rules.read().select(*KEY)) == rows_of(source.select(*KEY).distinct())


def test_merge_config():
    with pytest.raises(ValueError):
        merge.MergeConfig([])
    with pytest.raises(ValueError):
        merge.MergeConfig(["a"], order=("insert",))


def test_unique(spark):
    rows = spark.createDataFrame([(1, 1, "key1"), (2, 2, "key1"), (3, 1, "key2")], "id int, dep int, unk string")
    spec = TableSpec("t", (ColumnSpec("id", "int", primary_key=True), ColumnSpec("dep", "int"), ColumnSpec("unk", unique=True, unique_within="dep")))
    for record, bad in (((4, 1, "key2"), 1), ((3, 1, "key2"), 0), ((5, 2, "key2"), 0)):
        df = spark.createDataFrame([record], "id int, dep int, unk string")
        assert validate.validate(df, spec, {"t": rows}).violations.count() == bad
    many = spark.createDataFrame([(4, 1, "key2"), (5, 2, "key1")], "id int, dep int, unk string")
    assert validate.validate(many, spec, {"t": rows}).violations.count() == 2


def test_references_and_required(spark):
    dept = spark.createDataFrame([(1, "Admin")], "id int, name string")
    spec = TableSpec("e", (ColumnSpec("id", "int"), ColumnSpec("dept_id", "int", ref_table="dept", ref_column="id", error="no dept $value"), ColumnSpec("name", required=True)))
    df = spark.createDataFrame([(1, 2, "x"), (2, 1, None), (3, None, "y")], "id int, dept_id int, name string")
    found = validate.validate(df, spec, {"dept": dept}, validate.Options(location="root"))
    assert rows_of(found.violations.select("Location", "Message", "Check")) == [("root[1].dept_id", "no dept 2", "refKey"), ("root[2].name", "is null", "notnull")]
    assert found.text() == "root[1].dept_id no dept 2,root[2].name is null"
    with pytest.raises(ConstraintViolation):
        found.raise_if_failed()
    off = validate.Options(reference=False, required=False)
    assert not validate.validate(df, spec, {"dept": dept}, off).failed


def test_presence_gates_checks(spark):
    spec = TableSpec("e", (ColumnSpec("id", "int"), ColumnSpec("name", required=True)))
    df = spark.createDataFrame([(1, None, (False,)), (2, None, (True,))], "id int, name string, has struct<name:boolean>")
    assert validate.validate(df, spec, {}, validate.Options(present="has")).violations.count() == 1


def test_nested_records(spark):
    child = TableSpec("c", (ColumnSpec("id", "int"), ColumnSpec("name", required=True)))
    spec = TableSpec("p", (ColumnSpec("id", "int"),))
    df = spark.createDataFrame([(1, [(1, "a"), (2, None)])], "id int, kids array<struct<id:int,name:string>>")
    found = validate.validate(df, spec, {}, validate.Options(location="root"), children={"kids": child})
    assert found.violations.first().Location == "root[1].kids[1].name"
    assert not validate.validate(df, spec, {}, validate.Options(shallow=True), children={"kids": child}).failed


def test_last_by_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, at int, v string")
    assert rows_of(changes.last_by_key(df, ["k"], "at")) == [("a", 2, "y"), ("b", 1, "z")]


def test_equal_target_rows_are_deleted(spark):
    """Of equal target rows one is kept and each further copy is a deletion."""
    columns = "id long, k string"
    source, target = spark.createDataFrame([(1, "a"), (None, None)], columns), spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "b"), (2, "b"), (None, None)], columns)
    for strategy in ("insert+delete", "insert+update+delete"):
        found = merge.classify(source, target, merge.MergeConfig(["k"], "id", strategy=strategy))
        assert sorted(r.action for r in found.collect()) == ["delete"] * 4 + ["keep"] * 2


def test_repeated_change_records(spark, table):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    twice = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id long, v string, at int")
    assert sorted(map(tuple, changes.updated(old, twice, ["id"], position="at").select("id", "v").collect())) == [(1, "b"), (2, "y")]


def test_named_insert_lands_once(spark, folder):
    spec = TableSpec("t", (ColumnSpec("id", "bigint", primary_key=True), ColumnSpec("v", "string")))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    held = Table(spark, f"{folder}/once", rows.schema)
    writer = changes.Writer(held, spec)
    assert [writer.insert(rows, once="b7").affected for _ in range(2)] == [2, 0]
    # a try that broke before it was marked leaves files, which the next one replaces
    held._fs.delete(held._path(f"{held.path}/_batches/b7"), True)
    held.append_once(rows, "b7")
    assert held.read().count() == 2
    version = held.version
    held.replace(rows)
    assert held.version != version and held.read().count() == 2
