"""Evaluation queries: events are verdicts and latencies, labels are truths, orders are two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation
from .registry import query, table
from .verdicts import VERDICTS_SQL, rows


@query("AG16", f"WITH {VERDICTS_SQL} SELECT photo, count(*) AS judged, round_even(count(*) FILTER (state IN ('Matched', 'Missing', 'Wrong')) * 100.0::DOUBLE / count(*), 1) AS decisive_rate, round_even(count(*) FILTER (state = 'NotDetected') * 100.0::DOUBLE / count(*), 1) AS not_detected_rate FROM vd GROUP BY photo")
def eval_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.rates(rows(spark, sf_dir), ["photo"])


@query(
    "AG17",
    f"""WITH {VERDICTS_SQL}, t AS (SELECT state, CASE event_id % 11 WHEN 0 THEN 'present' WHEN 1 THEN 'missing' WHEN 2 THEN 'offscreen' ELSE CASE human WHEN 'HumanPresent' THEN 'present' WHEN 'HumanMissing' THEN 'missing' WHEN 'HumanWrongPart' THEN 'offscreen' END END AS truth FROM vd)
    SELECT round_even(count(*) FILTER (truth = 'present' AND state IN ('Matched', 'LowConfidence')) * 100.0::DOUBLE / count(*) FILTER (truth = 'present'), 1) AS recall,
    round_even(count(*) FILTER (truth = 'present' AND state = 'Missing') * 100.0::DOUBLE / count(*) FILTER (truth IN ('present', 'missing') AND state = 'Missing'), 1) AS false_red_rate,
    round_even(count(*) FILTER (truth = 'missing' AND state = 'Matched') * 100.0::DOUBLE / count(*) FILTER (truth IN ('present', 'missing') AND state = 'Matched'), 1) AS false_green_rate FROM t""",
)
def truth_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and false verdicts; a case's label goes before a review."""
    k = F.col("event_id") % 11
    truth = F.when(k == 0, "present").when(k == 1, "missing").when(k == 2, "offscreen")
    return evaluation.truth_rates(rows(spark, sf_dir).withColumn("truth", truth))


@query("AG18", "WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, median(value) AS p50, max(value) FILTER (r = greatest(1, floor(0.95 * n))) AS p95 FROM s GROUP BY user_id")
def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "value")
    return e.groupBy("user_id").agg(F.median("value").alias("p50")).join(evaluation.biased_p95(e, ["user_id"], "value"), "user_id")


@query(
    "AG25",
    """WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, max(value) FILTER (r = least(n - 1, floor(n * 0.9)) + 1) AS p90, max(value) FILTER (r = n // 4 + 1) AS q1, max(value) FILTER (r = 3 * n // 4 + 1) AS q3 FROM s GROUP BY user_id""",
)
def other_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "value")
    p = evaluation.capped_percentile(e, ["user_id"], "value", 0.9).withColumnRenamed("percentile", "p90")
    return p.join(evaluation.quartiles(e, ["user_id"], "value"), "user_id")


@query("AG26", "SELECT median(m) AS median FROM (SELECT median(value) AS m FROM events GROUP BY user_id)")
def median_of_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.median_of_medians(table(spark, sf_dir, "events"), "user_id", "value")


@query("AG19", "SELECT user_id, list_sort(list(value))[len(list(value)) // 2 + 1] AS upper FROM events GROUP BY user_id")
def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.geometry import upper_median

    return table(spark, sf_dir, "events").groupBy("user_id").agg(upper_median(F.col("value")).alias("upper"))


@query("AG28", "SELECT user_id, string_agg(s, ';' ORDER BY s) AS signature FROM (SELECT user_id, event_type || '@' || printf('%.3f', round_even(value, 3)) AS s FROM events) GROUP BY user_id")
def run_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.signature(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value")


RUNS_SQL = "b AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 > 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 > 0)"


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return o.where("k % 5 > 0"), o.where("k % 7 > 0").withColumn("s", F.when(F.col("k") % 9 == 0, "X").otherwise(F.col("s")))


@query("JN16", f"WITH {RUNS_SQL} SELECT coalesce(b.k, n.k) AS k, b.s AS was, n.s AS now FROM b FULL JOIN n ON b.k = n.k WHERE b.s IS DISTINCT FROM n.s")
def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.run_diff(*runs(spark, sf_dir), ["k"], "s")


@query("ST4", f"WITH {RUNS_SQL} SELECT k FROM b WHERE k IN (SELECT k FROM n)")
def common_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new = runs(spark, sf_dir)
    return base.join(new, "k", "left_semi").select("k")


@query("ST5", f"WITH {RUNS_SQL}, c AS (SELECT s, count(*) AS n FROM n GROUP BY s), d AS (SELECT s, count(*) AS n FROM b GROUP BY s) SELECT c.s, c.n - coalesce(d.n, 0) AS more FROM c LEFT JOIN d ON d.s = c.s WHERE c.n > coalesce(d.n, 0)")
def counter_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.counter_difference(*runs(spark, sf_dir), "s")


@query("TK8", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 5")
def slowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("value"), "event_id").limit(5).select("event_id", "value")


@query("JN3", "SELECT o_custkey AS profile, o_orderstatus AS photo, (l_linenumber % 3)::VARCHAR AS mark_key, arg_max(l_returnflag, l_orderkey * 100 + l_linenumber * 10 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS human FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3")
def reviews_by_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    reviews = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), (F.col("l_linenumber") % 3).cast("string").alias("mark_key"), F.col("l_returnflag").alias("human"), (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + flag).alias("review_id"))
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("profile"), F.col("o_orderstatus").alias("photo"))
    return evaluation.reviews_by_mark(reviews, records)
