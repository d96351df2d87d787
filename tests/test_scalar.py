"""Conversion and formatting of values."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.functions import scalar


def one(spark, c, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" if isinstance(v, str) or v is None else f"{k} {'double' if isinstance(v, float) else 'bigint'}" for k, v in columns.items()))
    return df.select(c.alias("x")).first().x


def test_text_to_value(spark):
    assert one(spark, scalar.to_value(F.col("a"), T.IntegerType()), a="") == 0
    assert one(spark, scalar.to_value(F.col("a"), T.IntegerType()), a="x") is None
    assert one(spark, scalar.to_value(F.col("a"), T.DoubleType()), a="1.5") == 1.5
    assert one(spark, scalar.to_value(F.col("a"), T.BooleanType()), a="T") is True
    assert str(one(spark, scalar.to_value(F.col("a"), T.TimestampType()), a="2019-01-02T03:04:05Z")) == "2019-01-02 03:04:05"
    assert one(spark, scalar.to_value(F.col("a"), T.ArrayType(T.IntegerType())), a="[1,2]") == [1, 2]


def test_float_text(spark):
    for value, text in ((250.0, "250"), (1.5, "1.5"), (0.0, "0"), (1e20, "100000000000000000000"), (-7.25, "-7.25")):
        assert one(spark, scalar.float_text(F.col("a")), a=value) == text
    assert one(spark, scalar.float_text(F.col("a"), 2), a=1234.5) == "1234.50"


def test_layouts():
    assert scalar.layout_pattern("2006-01-02T15:04:05Z07:00") == scalar.RFC3339
    assert scalar.layout_pattern("02 Jan 2006") == "dd MMM yyyy"


def test_zero(spark):
    assert one(spark, scalar.is_zero(F.col("a"), T.StringType()), a="") is True
    assert one(spark, scalar.is_zero(F.col("a"), T.LongType()), a=3) is False
    assert one(spark, scalar.nullify_empty(F.col("a"), T.LongType()), a=0) is None


def test_json(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert df.select(scalar.encode_json(F.struct("a", "b")).alias("x")).first().x == '{"a":1,"b":null}'
    assert one(spark, scalar.decode_json(F.col("a"), "x int"), a="") is None


def test_message(spark):
    assert one(spark, scalar.message("bad '$value'$coma again", F.col("a")), a="v") == "bad 'v', again"


def test_float_text_without_exponent(spark):
    from sluicebox.functions import scalar

    cases = {1e-20: "0." + "0" * 19 + "1", 1.5e-11: "0.000000000015", 1e300: "1" + "0" * 300, -2.5e10: "-25000000000", 1.2345678e7: "12345678", 1.23456789e7: "12345678.9", 0.0: "0", 100.0: "100", -0.25: "-0.25", 123.456: "123.456"}
    df = spark.createDataFrame([(k,) for k in cases], "x double")
    assert {r.x: r.t for r in df.select("x", scalar.float_text(F.col("x")).alias("t")).collect()} == cases
