import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyreach.functions import bands, text, time
from tallyreach.functions.cleaning import (
    blank_to_null,
    null_tokens,
    to_double,
    to_int,
    to_timestamp,
)


def values(spark, inputs, expression, kind="string"):
    rows = spark.createDataFrame(list(enumerate(inputs)), f"n int, v {kind}")
    found = rows.select("n", expression(F.col("v")).alias("x")).collect()
    return [row["x"] for row in sorted(found, key=lambda row: row["n"])]


def test_null_tokens_match_before_trimming(spark):
    inputs = ["", "\\N", "null", "NULL", " null ", " ", "Null", None]
    assert values(spark, inputs, null_tokens) == [None] * 4 + [" null ", " ", "Null", None]
    trimmed = values(spark, inputs, lambda v: blank_to_null(null_tokens(v)))
    assert trimmed == [None] * 4 + ["null", None, "Null", None]


def test_trim_takes_unicode_spaces_but_not_tabs(spark):
    inputs = [" \u00a0\u3000 a b \u2003", "\ta ", " \u00a0 "]
    assert values(spark, inputs, blank_to_null) == ["a b", "\ta", None]


def test_to_int(spark):
    cases = {
        "3.7": 4, "2.5": 3, "-2.5": -3, " 5 ": 5, "1e3": 1000, "99999999999": None, "abc": None,
        "nan": None, "inf": None, "1d": None, "1_000": 1000, "2147483647.4": 2147483647,
        "2147483647.5": None, "-0.4": 0, "": None,
    }
    assert values(spark, list(cases), to_int) == list(cases.values())


def test_to_double(spark):
    cases = {
        ".5": 0.5, "5.": 5.0, "1e3": 1000.0, "1d": None, "1f": None, "1D ": None,
        "inf": math.inf, "-inf": -math.inf, "Infinity": math.inf, "abc": None, "1_0.5": 10.5,
        "_1": None,
    }
    assert values(spark, list(cases), to_double) == list(cases.values())
    assert math.isnan(values(spark, ["nan"], to_double)[0])


def test_to_timestamp(spark):
    day, ten = datetime(2010, 8, 1), datetime(2010, 8, 1, 10)
    cases = {
        "2010-08-01": day,
        "2010-8-1 1:2:3": datetime(2010, 8, 1, 1, 2, 3),
        "2010-08-01 10:00": ten,
        "2010-08-01T10:00:00Z": ten,
        "2010-08-01 10:00:00+01:00": ten,
        "2010-08-01 10:00:00.25": datetime(2010, 8, 1, 10, 0, 0, 250000),
        "2010/08/01 10:00:00": ten,
        "2010 08 01": day,
        " 2010-08-01 10:00:00": ten,
        "2010-08-01   10:00:00": ten,
        "2010-08-01 24:00:00": datetime(2010, 8, 2),
        "2010-08-01 24:00:01": None,
        "2010/08-01": None,
        "2010-13-01": None,
        "2010-02-30": None,
        "2010": None,
        "2010-08": None,
        " 2010-08-01 ": None,
        "2010-08-01 10": None,
        "2010-08-01\n": None,
        "junk": None,
        "": None,
    }
    assert values(spark, list(cases), to_timestamp) == list(cases.values())


def test_text_measures(spark):
    sample = "héllo wörld_1 #tag"
    assert values(spark, [sample], lambda v: text.text_measures(v)["word_count"]) == [5]
    tagged = ["a<b\nc>d<>e", None, "<p>", "1 < 2"]
    assert values(spark, tagged, text.strip_tags) == ["a d<>e", "", " ", "1 < 2"]
    tags = ["a #x_1 #é ## #b"]
    assert values(spark, tags, lambda v: text.text_measures(v)["hashtag_count"]) == [2]
    links = ["http://a https://b ftp://"]
    assert values(spark, links, lambda v: text.text_measures(v)["url_count"]) == [2]
    wide = ["\U0001f600a"]
    assert values(spark, wide, lambda v: text.text_measures(v)["character_count"]) == [2]


@pytest.mark.parametrize(
    "which, numbers, names",
    [
        (
            bands.TEXT_LENGTH,
            [0, 1, 79, 80, 199, 200, 499, 500],
            "empty short short medium medium long long very_long",
        ),
        (
            bands.TIME_OF_DAY,
            [0, 5, 6, 11, 12, 17, 18, 23, None],
            "night night morning morning afternoon afternoon evening evening evening",
        ),
        (
            bands.FOLLOWERS,
            [None, 0, 1, 9, 10, 99, 100, 999, 1000],
            "unknown 0 1-9 1-9 10-99 10-99 100-999 100-999 1000+",
        ),
        (
            bands.ACTIVITY,
            [1, 9, 10, 99, 100, 999, 1000, None],
            "1-9 1-9 10-99 10-99 100-999 100-999 1000+ 1000+",
        ),
    ],
)
def test_bands(spark, which, numbers, names):
    assert values(spark, numbers, which.of, "int") == names.split()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_calendar_does_not_depend_on_the_zone(spark, zone, request):
    spark.conf.set("spark.sql.session.timeZone", zone)
    request.addfinalizer(lambda: spark.conf.set("spark.sql.session.timeZone", "UTC"))
    days = [datetime(2010, 8, 1, 23, 59), datetime(2010, 8, 2), datetime(2010, 8, 7), None]
    kind = "timestamp_ntz"
    assert values(spark, ["2010-08-01 23:30:00+05:00"], to_timestamp) == [
        datetime(2010, 8, 1, 23, 30)
    ]
    assert values(spark, days, time.iso_weekday, kind) == [7, 1, 6, None]
    assert values(spark, days, time.is_weekend, kind) == [True, False, True, None]
    assert values(spark, days, time.weekday_name, kind) == ["Sunday", "Monday", "Saturday", None]
    assert values(spark, days, time.hour, kind) == [23, 0, 0, None]


def test_window_is_half_open_and_never_null(spark):
    days = [datetime(2010, 7, 31, 23), datetime(2010, 8, 1), datetime(2010, 10, 1), None]
    inside = values(
        spark,
        days,
        lambda v: time.in_window(v, time.moment("2010-08-01"), time.moment("2010-10-01")),
        "timestamp_ntz",
    )
    assert inside == [False, True, False, False]
