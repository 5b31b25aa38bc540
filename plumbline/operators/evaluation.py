"""Evaluation: rates, recall and false verdicts against truth, percentiles by their several rules, run-to-run differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which states count, decide, and count as seen.
COUNTED = ("Matched", "Missing", "Wrong", "LowConfidence", "NotDetected")
DECISIVE = ("Matched", "Missing", "Wrong")
SEEN = ("Matched", "LowConfidence")


def percent(part: Column, whole: Column) -> Column:
    """Percent to one decimal, half to even; null of nothing."""
    return F.when(whole != 0, F.bround(part * 100.0 / whole, 1))


def rates(verdicts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """judged, decisive_rate and not_detected_rate of the counted verdicts."""
    pool = verdicts.where(F.col("state").isin(*COUNTED))
    n = F.count(F.lit(1))
    return pool.groupBy(*by).agg(
        n.alias("judged"), percent(F.count_if(F.col("state").isin(*DECISIVE)), n).alias("decisive_rate"), percent(F.count_if(F.col("state") == "NotDetected"), n).alias("not_detected_rate")
    )


def truth_rates(verdicts: DataFrame) -> DataFrame:
    """One row: recall, false_red_rate and false_green_rate, each null without labelled verdicts.

    verdicts: state, truth (the case's label: present, missing, offscreen; null if unlabelled), human (a review, which
    counts where there is no label).
    """
    mapped = F.when(F.col("human") == "HumanPresent", "present").when(F.col("human") == "HumanMissing", "missing").when(F.col("human") == "HumanWrongPart", "offscreen")
    truth, state = F.coalesce(F.col("truth"), mapped), F.col("state")
    known = truth.isin("present", "missing")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return verdicts.agg(
        percent(n((truth == "present") & state.isin(*SEEN)), n(truth == "present")).alias("recall"),
        percent(n((state == "Missing") & (truth == "present")), n((state == "Missing") & known)).alias("false_red_rate"),
        percent(n((state == "Matched") & (truth == "missing")), n((state == "Matched") & known)).alias("false_green_rate"),
    )


def ranked_value(df: DataFrame, by: Sequence[str], value: str, position: Column, name: str) -> DataFrame:
    """Of each group the value at a position (from 1, a function of n) in sorted order."""
    order = Window.partitionBy(*by).orderBy(value)
    ranked = df.where(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return ranked.where(F.col("__r") == position).select(*by, F.col(value).alias(name))


def biased_p95(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """sorted[max(0, int(0.95 n) - 1)]: not interpolated, and the least of two."""
    return ranked_value(df, by, value, F.greatest(F.lit(1), F.floor(F.col("n") * 0.95)), "p95")


def capped_percentile(df: DataFrame, by: Sequence[str], value: str, p: float) -> DataFrame:
    """sorted[min(n - 1, int(n p))]."""
    return ranked_value(df, by, value, F.least(F.col("n") - 1, F.floor(F.col("n") * p)) + 1, "percentile")


def quartiles(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """sorted[n // 4] and sorted[3 n // 4]."""
    low = ranked_value(df, by, value, F.floor(F.col("n") / 4) + 1, "q1")
    return low.join(ranked_value(df, by, value, F.floor(F.col("n") * 3 / 4) + 1, "q3"), list(by))


def median_of_medians(df: DataFrame, case: str, value: str) -> DataFrame:
    return df.groupBy(case).agg(F.median(value).alias("m")).agg(F.median("m").alias("median"))


def signature(df: DataFrame, by: Sequence[str], text: str, confidence: str) -> DataFrame:
    """The multiset of a group's texts with confidences to three decimals, as one sorted text."""
    item = F.concat_ws("@", F.col(text), F.format_string("%.3f", F.bround(confidence, 3)))
    return df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(item)), ";").alias("signature"))


def run_diff(base: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys whose values differ between two runs, missing ones included: was, now."""
    b = base.select(*keys, F.col(value).alias("was"))
    n = new.select(*keys, F.col(value).alias("now"))
    return b.join(n, list(keys), "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))


def counter_difference(base: DataFrame, new: DataFrame, value: str) -> DataFrame:
    """How much more often each value occurs in new, where it does."""
    b = base.groupBy(value).agg(F.count(F.lit(1)).alias("__b"))
    n = new.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    return n.join(b, value, "left").withColumn("more", F.col("__n") - F.coalesce("__b", F.lit(0))).where("more > 0").select(value, "more")


def reviews_by_mark(reviews: DataFrame, records: DataFrame) -> DataFrame:
    """The last review of each mark of a photo: reviews joined to their records, the newest wins."""
    joined = reviews.join(records, "record_id")
    return joined.groupBy("profile", "photo", "mark_key").agg(F.max_by("human", "review_id").alias("human"))
