from datetime import date

from pyspark.sql import functions as F

from spindrift.functions import calendar, encode, labels
from spindrift.functions.numeric import clip, exact_avg, ratio, round_half_up, uniform
from spindrift.sources import parameters as P


def test_ratio_and_rounding(spark, rows):
    df = spark.createDataFrame([(1.0, 0.0), (2.675, 1.0)], "a double, b double")
    assert rows(df.select(round_half_up(ratio(F.col("a"), F.col("b")), 2).alias("x"))) == [(2.68,), (None,)]


def test_exact_average_ignores_nulls(spark, rows):
    df = spark.createDataFrame([(0.1,), (0.2,), (None,)], "a double")
    assert rows(df.agg(exact_avg(F.col("a")).alias("x"))) == [(0.15,)]


def test_ordinal_codes_and_unknown_values(spark, rows):
    df = spark.createDataFrame([("Basic",), ("Platinum",), ("VIP",), (None,)], "t string")
    got = df.select("t", encode.ordinal(F.col("t"), P.TIERS).alias("c")).collect()
    assert {r["t"]: r["c"] for r in got} == {"Basic": 0, "Platinum": 4, "VIP": None, None: None}


def test_vocabulary_is_an_argument(spark, rows):
    df = spark.createDataFrame([("VIP",), ("Moderate",)], "t string")
    got = rows(df.select(encode.ordinal(F.col("t"), ("Low", "Medium", "High", "VIP")).alias("c")))
    assert got == [(3,), (None,)]


def test_decode_with_default(spark, rows):
    df = spark.createDataFrame([(0,), (9,)], "c int")
    assert rows(df.select(encode.decode(F.col("c"), {0: "zero"}, "Unknown"))) == [("Unknown",), ("zero",)]


def test_bins_at_their_edges(spark):
    bets = spark.createDataFrame([(2.0,), (2.01,), (4.0,), (7.0,), (7.01,), (None,)], "b double")
    got = [r[0] for r in bets.select(encode.bet_category(F.col("b"))).collect()]
    assert got == ["Low", "Medium", "Medium", "High", "VeryHigh", None]
    rates = spark.createDataFrame([(79.99,), (80.0,), (85.0,), (90.0,), (95.0,)], "w double")
    got = [r[0] for r in rates.select(encode.win_rate_category(F.col("w"))).collect()]
    assert got == ["Very_Low", "Low", "Medium", "High", "Very_High"]


def test_both_weekday_conventions(spark):
    df = spark.createDataFrame([(date(2024, 1, 7),), (date(2024, 1, 8),)], "d date")
    got = [
        tuple(r)
        for r in df.select(
            calendar.dow_sun0(F.col("d")), calendar.dow_mon0(F.col("d")), calendar.is_weekend(F.col("d"))
        ).collect()
    ]
    assert got == [(0, 6, 1), (1, 0, 0)]


def test_uniform_is_repeatable_and_even(spark):
    df = spark.range(20000).select(uniform("id", salt="t").alias("u"), uniform("id", salt="other").alias("v"))
    stats = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.corr("u", "v")).first()
    assert 0 <= stats[0] < 0.001 and 0.999 < stats[1] < 1
    assert abs(stats[2] - 0.5) < 0.01 and abs(stats[3]) < 0.03
    again = spark.range(20000).repartition(7).select(uniform("id", salt="t").alias("u"))
    assert df.select("u").exceptAll(again).count() == 0


def test_clip_and_labels(spark):
    df = spark.createDataFrame([(5.0, 34), (-5.0, 40)], "x double, age int")
    got = [
        tuple(r)
        for r in df.select(
            clip(F.col("x"), -1.0, 1.0),
            labels.decade_label(F.col("age")),
            labels.denomination_label(F.lit(0.25)),
            labels.thousands(F.lit(1234567)),
        ).collect()
    ]
    assert got == [(1.0, "30s", "$0.25", "1,234,567"), (-1.0, "40s", "$0.25", "1,234,567")]
    assert labels.clean_header('"score"') == "SCORE"
    assert labels.share_column(0.25) == "pct_0_25" and labels.share_column(100.0) == "pct_100_0"
