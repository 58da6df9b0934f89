import pytest
from pyspark.sql import functions as F

from tidemark.functions import normalize as N


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,day", [
    ("2001-04-07", "2001-04-07"), ("20010407", "2001-04-07"), ("2001/04/07", "2001-04-07"), (" 2001/4/7 ", "2001-04-07"), ("2001-04-07 00:00:00", "2001-04-07"),
    ("2001-04-07T09:30", "2001-04-07"), ("", None), ("   ", None), ("2001", None), ("2001-13-01", None), ("x", None), (None, None), ("20010407.0", "2001-04-07"),
])
def test_day(spark, text, day):
    got = value(spark, N.day(F.lit(text).cast("string")))
    assert (got and got.isoformat()) == day


@pytest.mark.parametrize("text,millis", [
    ("093100000", 34260000), ("93100000", 34260000), ("93100000.0", 34260000), ("0931", 34260000), ("931", 34260000), ("093100", 34260000), ("93100", 34260000),
    ("09:31:00", 34260000), ("9:31", 34260000), ("09:31:00.250", 34260250), (" 093100000 ", 34260000), ("100000000.0", 36000000), ("096100000", None),
    ("250000000", None), ("", None), ("abc", None), (None, None), ("-93100000", None), ("12", None),
])
def test_clock(spark, text, millis):
    assert value(spark, N.clock(F.lit(text).cast("string"))) == millis


@pytest.mark.parametrize("text,symbol", [
    ("600001.SH", "600001.SH"), ("600001.sh", "600001.SH"), ("sh.600001", "600001.SH"), ("SH600001", "600001.SH"), ("600001", "600001.SH"), ("900001", "900001.SH"),
    ("500001", "500001.SH"), ("430001", "430001.BJ"), ("830001", "830001.BJ"), ("000001", "000001.SZ"), ("300001", "300001.SZ"), (" 600001.SH ", "600001.SH"), ("", None), (None, None), ("odd", "ODD"),
])
def test_symbol(spark, text, symbol):
    assert value(spark, N.symbol(F.lit(text).cast("string"))) == symbol


@pytest.mark.parametrize("text,flag", [("1", True), ("1.0", True), ("T", True), ("yes", True), (" 0 ", False), ("N", False), ("FALSE", False), ("null", None), ("--", None), ("", None), (None, None)])
def test_flag(spark, text, flag):
    assert value(spark, N.flag(F.lit(text).cast("string"))) == flag


@pytest.mark.parametrize("text,folded", [("ＳＴ　光电", "ST光电"), (" st\xa0a ", "STA"), ("  ", None), (None, None), ("ﬁ", "FI")])
def test_fold(spark, text, folded):
    assert value(spark, N.fold_text(F.lit(text).cast("string"))) == folded


@pytest.mark.parametrize("minute,ordinal", [("0930", None), ("0931", 0), ("1130", 119), ("1131", None), ("1300", None), ("1301", 120), ("1500", 239), ("1501", None)])
def test_session(spark, minute, ordinal):
    assert value(spark, N.session_ordinal(N.clock(F.lit(minute)))) == ordinal
    assert value(spark, N.session_ordinal(N.clock(F.lit(minute + "59999")))) == ordinal


@pytest.mark.parametrize("number,fine", [(1.5, 1.5), (float("nan"), None), (float("inf"), None), (-float("inf"), None), (None, None)])
def test_finite(spark, number, fine):
    assert value(spark, N.finite(F.lit(number).cast("double"))) == fine
