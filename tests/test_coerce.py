import datetime as dt

from pyspark.sql import functions as F

from cohorta.functions.coerce import blank_to_null, email_domain, epoch_or_timestamp, safe_cast, safe_int


def test_coercion_table(spark):
    # FIXTURES.md §7 cases
    df = spark.createDataFrame([("3.7",), ("12.50",), ("300",), (" 5 ",), ("",), ("1e3",), ("-2.5",),
                                ("9007199254740993",), (None,)], "x string")
    got = [tuple(r) for r in df.select(safe_int(F.col("x"), "tinyint"), safe_int(F.col("x"), "integer"),
                                       safe_int(F.col("x"), "bigint")).collect()]
    assert got == [(4, 4, 4), (13, 13, 13), (None, 300, 300), (5, 5, 5), (None, None, None),
                   (None, 1000, 1000), (-3, -3, -3), (None, None, 9007199254740993), (None, None, None)]


def test_epoch_and_text_timestamps(spark):
    df = spark.createDataFrame([("2020",), ("1700000000",), ("99999",), ("2022-01-01T08:30:00",),
                                ("2023-05-05 10:00:00",), ("abc",)], "x string")
    got = [r[0] for r in df.select(epoch_or_timestamp(F.col("x"))).collect()]
    assert got == [None, dt.datetime(2023, 11, 14, 22, 13, 20), None, dt.datetime(2022, 1, 1, 8, 30),
                   dt.datetime(2023, 5, 5, 10, 0), None]


def test_domain_and_blank(spark):
    df = spark.createDataFrame([("abc", None), ("a@b@c", None), ("x@y.z", "given"), ("  ", None)], "e string, d string")
    got = [tuple(r) for r in df.select(email_domain(F.col("e"), F.col("d")), blank_to_null(F.col("e"))).collect()]
    assert got == [(None, "abc"), ("b", "a@b@c"), ("given", "x@y.z"), (None, None)]


def test_bad_cells_become_null(spark):
    cells = ["0x" + "F" * 20, "0b" + "1" * 70, "0x00000000000000000001F", "0x7FFFFFFFFFFFFFFF", "0x8000000000000000", "0b101"]
    df = spark.createDataFrame([(c,) for c in cells], "x string")
    assert [r[0] for r in df.select(safe_int(F.col("x"))).collect()] == [None, None, 31, 2**63 - 1, None, 5]
    df = spark.createDataFrame([("1700000000000000",), ("2020-05",), ("10:30",), ("2020-05-06 10:30",), ("2020-13-06",)], "x string")
    assert [r[0] for r in df.select(epoch_or_timestamp(F.col("x"))).collect()] == [
        None, None, None, dt.datetime(2020, 5, 6, 10, 30), None]
    df = spark.createDataFrame([("2020",), ("2020-05",), ("2020-05-06",), ("x",)], "x string")
    assert [r[0] for r in df.select(safe_cast(F.col("x"), "date")).collect()] == [None, None, dt.date(2020, 5, 6), None]
