from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import display as D
from millrace.functions import text as X


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [(" a b \t", "a b"), (" \t", None), ("　x ", "x"), ("a\x07b\nc", "ab\nc"), (None, None), ("", None), ("\x01 x", " x"), ("\x01 ", None), ("\u00a0a\u3000", "a")])
def test_normalized(spark, raw, want):
    assert one(spark, X.normalized(F.lit(raw).cast("string"))) == want


def test_cut_at_character(spark):
    assert one(spark, X.cut_bytes(F.lit("é" * 300))) == "é" * 250
    assert one(spark, X.cut_bytes(F.lit("a" + "漢" * 200))) == "a" + "漢" * 166
    assert one(spark, X.cut_bytes(F.lit("a" * 501))) == "a" * 500 and one(spark, X.cut_bytes(F.lit("ok"))) == "ok"


@pytest.mark.parametrize("raw, want", [("2025-01-23T14:16:16.517", datetime(2025, 1, 23, 14, 16, 16)), ("nothing like a time", None), (None, None)])
def test_whole_seconds(spark, raw, want):
    assert one(spark, X.whole_seconds(F.lit(raw).cast("string"))) == want


def test_date_only(spark):
    assert one(spark, X.date_only(F.lit("2026-06-25 09:49:29"))) == datetime(2026, 6, 25)


@pytest.mark.parametrize("raw, want", [("1,234.5", 1234.5), (" 7 ", 7), ("x", 0), (None, 0), ("", 0)])
def test_amount(spark, raw, want):
    assert float(one(spark, X.amount(F.lit(raw).cast("string")))) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("see http://user:pw@host/x", "see http://***:***@host/x"),
        ("Authorization: Bearer abc, next", "authorization: ***, next"),
        ("got bearer abc;", "got Bearer ***;"),
        ("password='a b' token=xyz secret : q", "password=*** token=*** secret:***"),
        ("nothing here", "nothing here"),
    ],
)
def test_redacted(spark, raw, want):
    assert one(spark, X.redacted(F.lit(raw))) == want


def test_instants_and_lists(spark):
    assert one(spark, X.parsed_instant(F.lit("2025-03-01T08:00:00+08:00"))) == datetime(2025, 3, 1)
    assert one(spark, X.parsed_instant(F.lit("2025-03-01 08:00:00"))) == datetime(2025, 3, 1)
    assert one(spark, X.plain_stamp(F.lit("2025-03-01T08:00:00.123+08:00"))) == "2025-03-01 08:00:00"
    assert one(spark, X.text_list(F.lit('["a","b"]'))) == ["a", "b"] and one(spark, X.text_list(F.lit("a"))) == ["a"] and one(spark, X.text_list(F.lit(" "))) == []
    assert one(spark, X.comma_list(F.lit(" a, ,b ,"))) == ["a", "b"] and one(spark, X.before_slash(F.lit("n /x/y"))) == "n"


@pytest.mark.parametrize("seconds, want", [(None, "-"), (-1, "-"), (59.4, "59秒"), (61, "1分1秒"), (3661, "1时1分")])
def test_duration(spark, seconds, want):
    assert one(spark, D.duration_text(F.lit(seconds).cast("double"))) == want


def test_rates(spark):
    i = lambda n: F.lit(n)
    assert one(spark, D.rate_text(i(0), i(0))) == "--" and one(spark, D.rate_text(i(3), i(3))) == "100%" and one(spark, D.rate_text(i(1), i(3))) == "33%"
    assert one(spark, D.change_percent(i(3), i(2))) == 50 and one(spark, D.change_percent(i(3), i(0))) is None
    assert one(spark, D.percent_or(i(0), i(0), 100)) == 100 and one(spark, D.whole_percent(i(1), i(3))) == 33 and one(spark, D.whole_percent(i(1), i(0))) == 0
    assert [one(spark, D.health(i(x))) for x in (80, 79, 49)] == ["good", "warning", "error"]
    assert one(spark, D.money(F.lit(1234.5))) == "¥1,234.50" and one(spark, D.shortened(F.lit("a" * 101))) == "a" * 100 + "..."
