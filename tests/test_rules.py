"""Rules that the queries' fixtures don't reach."""

from pyspark.sql import functions as F

from plumbline.functions import dates, predicates, text
from plumbline.operators import evaluation, ledger, matching, verdicts


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("r")).first().r


def test_normalize_keeps_sharp_s_and_folds_width(spark):
    assert one(spark, text.normalize, "Ｑ ß a　b") == "QßAB"
    assert one(spark, text.normalize, None) == ""


def test_two_digit_years_are_not_expanded(spark):
    assert str(one(spark, dates.parse_date, "26.3.14")) == "0026-03-14"


def test_page_bounds():
    assert ledger.page_bounds(0, 0) == (0, 20)
    assert ledger.page_bounds(3, 900) == (1000, 500)


def test_quantities(spark):
    shown = spark.sql("SELECT explode(array(1.0D, 2.5D, 0.00004D, -3.0D, 1.23456D)) AS v").select(ledger.format_quantity(F.col("v")).alias("s")).collect()
    assert [r.s for r in shown] == ["1", "2.5", "0", "-3", "1.2346"]


def test_no_truth_gives_no_rates(spark):
    rows = spark.createDataFrame([("Matched", None, None)], "state string, truth string, human string")
    assert tuple(evaluation.truth_rates(rows).first()) == (None, None, None)


def test_p95_of_two_is_the_least(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 9.0)], "k string, v double")
    assert evaluation.biased_p95(rows, ["k"], "v").first().p95 == 1.0


def test_rollup_of_nothing_is_unknown(spark):
    rows = spark.createDataFrame([("m", None, None)], "mark string, state string, human string")
    assert verdicts.rollup(rows, ["mark"]).first().state == "Unknown"


def test_edit_join_finds_insertions_and_swaps_nothing(spark):
    a = spark.createDataFrame([("ABCDEF",), ("short",)], "x string")
    b = spark.createDataFrame([("ABCDEFG",), ("ABCDFE",), ("ABXDEF",), ("ABCDEF",)], "y string")
    got = {(r.y, r.distance) for r in matching.edit_join(a, b, "x", "y").collect()}
    assert got == {("ABCDEFG", 1), ("ABXDEF", 1), ("ABCDEF", 0)}


def test_classify_uses_context(spark):
    plain = one(spark, predicates.classify, "200512")
    context = spark.sql("SELECT '200512' AS s").select(predicates.classify(F.col("s"), near_label=F.lit(True)).alias("r")).first().r
    assert (plain, context) == ("dim", "text")
