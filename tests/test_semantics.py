"""One small table per missing-value or text rule."""

import pytest
from pyspark.sql import functions as F

from snapline.functions import na, rand, text
from snapline.operators.sorting import arrange


def one(spark, sql, column):
    return spark.sql(f"SELECT * FROM VALUES {sql}").select(column.alias("x")).collect()[0].x


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame(
        [("a", 1.0), ("a", None), ("b", -2.0), ("b", 3.0), ("c", -1.0)], "g string, x double"
    )


def test_sums_and_means_pass_nulls_on(numbers, rows):
    out = numbers.groupBy("g").agg(na.na_sum("x").alias("s"), na.na_mean("x").alias("m"))
    assert rows(out) == [("a", None, None), ("b", 1.0, 0.5), ("c", -1.0, -1.0)]


def test_sum_over_no_rows_is_zero(numbers):
    assert numbers.where("g = 'zz'").agg(na.na_sum("x").alias("s")).collect()[0].s == 0


def test_positive_sum(numbers, rows):
    out = numbers.groupBy("g").agg(na.na_sum_positive("x").alias("s"))
    assert rows(out) == [("a", None), ("b", 3.0), ("c", 0.0)]


def test_distinct_counts_null_once(spark):
    df = spark.createDataFrame([(1,), (None,), (None,), (2,), (1,)], "x int")
    assert df.agg(na.n_distinct_na("x").alias("n")).collect()[0].n == 3
    assert df.where("x is not null").agg(na.n_distinct_na("x").alias("n")).collect()[0].n == 2
    assert df.where("false").agg(na.n_distinct_na("x").alias("n")).collect()[0].n == 0


def test_floor_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (4.0,)], "x double")
    assert [r.y for r in df.select(na.floor_at("x", -2).alias("y")).collect()] == [None, -2.0, 4.0]
    assert [r.y for r in df.select(na.cap_at("x", 1).alias("y")).collect()] == [None, -5.0, 1.0]


def test_ratio_by_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (3, 2)], "a int, b int")
    assert [r.y for r in df.select(na.safe_ratio("a", "b").alias("y")).collect()] == [None, None, 1.5]


def test_conditional_and_membership_with_null(spark):
    df = spark.createDataFrame([(None,), ("p",), ("q",)], "x string")
    out = df.select(
        na.if_else(F.col("x") == "p", 1, 2).alias("i"), na.is_in("x", ["p"]).alias("m"), na.not_in("x", ["p"]).alias("n"),
        na.present("x").alias("e"),
    ).collect()
    assert [tuple(r) for r in out] == [(None, False, True, False), (1, True, False, True), (2, False, True, True)]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r.y for r in df.select(na.half_even("x").alias("y")).collect()] == [0.0, 2.0, 2.0, 0.0]
    table = spark.createDataFrame([(1, 2.5, "t")], "i int, d double, s string")
    assert tuple(na.round_numeric(table).collect()[0]) == (1, 2.0, "t")


def test_fill_numeric_leaves_text(spark):
    df = spark.createDataFrame([(None, None, None)], "i int, d double, s string")
    assert tuple(na.fill_numeric(df).collect()[0]) == (0, 0.0, None)
    assert tuple(na.fill_numeric(df, subset=["d"]).collect()[0]) == (None, 0.0, None)


def test_correlation_is_null_when_a_column_has_a_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None)], "x double, y double")
    got = df.agg(na.na_corr("x", "y").alias("a"), na.na_corr("x", "x").alias("b")).collect()[0]
    assert got.a is None and got.b == pytest.approx(1.0)


def test_display_formats(spark):
    df = spark.createDataFrame([(0.1234,), (None,)], "x double")
    got = df.select(na.percent_text("x").alias("p"), na.number_text("x").alias("n")).collect()
    assert [tuple(r) for r in got] == [("12.3%", "0.1"), ("", "")]


def test_sorting_puts_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert [r.x for r in arrange(df, "x").collect()] == [1, 2, None]
    assert [r.x for r in arrange(df, "-x").collect()] == [2, 1, None]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("Allen Robinson", "Allen Robinson II"),
        ("Allen Robinson II", "Allen Robinson II"),
        ("D.J. Moore", "DJ Moore"),
        ("DxJx Moore", "DJ Moore"),
        ("Marvin Jones", "Marvin Jones Jr."),
        ("Marvin Jones Jr.", "Marvin Jones Jr. Jr."),
        ("Kenneth Walker III", "Kenneth Walker III"),
        ("Jeffrey Wilson", "Jeff Wilson Jr."),
        ("Nick Chubb", "Nick Chubb"),
    ],
)
def test_name_rules(spark, given, wanted):
    df = spark.createDataFrame([(given,)], "x string")
    assert df.select(text.apply_rules("x").alias("y")).collect()[0].y == wanted


def test_standard_names(spark, rows):
    df = spark.createDataFrame(
        [("Taysom Hill", "LA", "QB"), ("D.J. Chark", "KC", "WR")], "name string, team string, position string"
    )
    assert rows(text.standard_names(df)) == [("DJ Chark Jr.", "KC", "WR"), ("Taysom Hill", "LAR", "TE")]


@pytest.mark.parametrize(
    "label, wanted",
    [("A.J. Dillon 12", "A.J. Dillon"), ("49ers 5", "49ers"), ("Ja'Marr Chase 1 x", "Ja'Marr Chase"), ("Nobody", None), (None, None)],
)
def test_label_reading(spark, label, wanted):
    df = spark.createDataFrame([(label,)], "x string")
    assert df.select(text.player_from_label("x").alias("y")).collect()[0].y == wanted


def test_first_match_only(spark):
    df = spark.createDataFrame([("a- B c- D",), ("none",)], "x string")
    got = df.select(text.remove_first("x", "- [A-z]+").alias("r"), text.extract_first("x", "- [A-z]+").alias("e")).collect()
    assert [tuple(r) for r in got] == [("a c- D", "- B"), ("none", None)]


def test_trim_takes_tabs(spark):
    df = spark.createDataFrame([("\t a b \n",)], "x string")
    assert df.select(text.trim_space("x").alias("y")).collect()[0].y == "a b"


def test_header_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`My Proj` int, `my.proj` int, `TD%` int, stdDev int")
    assert text.clean_names(df).columns == ["my_proj", "my_proj_2", "td_percent", "std_dev"]


def test_pattern_select_ignores_case(spark):
    df = spark.createDataFrame([(1, 2, 3)], "QB int, my_qb int, te int")
    assert text.columns_containing(df, ["qb"]) == ["QB", "my_qb"]
    assert text.columns_containing(df, ["qb", "te"], but_not="MY") == ["QB", "te"]


def test_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(500).selectExpr("id", "cast(id as string) as name")
    draw = rand.std_normal(7, ["id", "name"]).alias("z")
    a = [r.z for r in df.repartition(1).select("id", draw).orderBy("id").collect()]
    b = [r.z for r in df.repartition(8).select("id", draw).orderBy("id").collect()]
    assert a == b and len(set(a)) == 500
    assert abs(sum(a) / 500) < 0.15 and 0.85 < sum(z * z for z in a) / 500 < 1.15
