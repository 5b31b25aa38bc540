"""Defect-log queries: orders are the log (date, priority as line, customer as model, status as stage)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import defects
from .registry import query, table

LOG_SQL = """d AS (SELECT o_orderkey AS row, o_orderdate::DATE AS day, o_orderpriority AS line, 'M ' || (o_custkey % 50)::VARCHAR AS model,
  CASE o_orderstatus WHEN 'F' THEN 'ipqc' WHEN 'O' THEN 'QA' ELSE 'other' END AS stage FROM orders)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.when(F.col("o_orderstatus") == "F", "ipqc").when(F.col("o_orderstatus") == "O", "QA").otherwise("other")
    model = F.concat(F.lit("M "), (F.col("o_custkey") % 50).cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("line"), model.alias("model"), stage.alias("stage"))


DIRTY = """VALUES ('A', 1, '日期', '线别', '型号', 'IPQC'), ('A', 2, '2026-03-14', 'L1', 'AB 1', 'ipqc'), ('A', 3, '2026/3/14', '', 'ab1', 'QA'), ('A', 4, '2026.3.4', 'L2', 'AB1', 'qa'),
  ('A', 5, '2026年3月5日', 'L1', 'X', 'QA'), ('A', 6, '46095', 'L1', 'X', 'other'), ('A', 7, '20226.3.14', 'L1', 'X', 'QA'), ('A', 8, '2026-02-30', 'L1', 'X', 'QA'),
  ('A', 9, '2026-03-14T10:00:00', 'L1', 'Y', 'QA'), ('A', 10, '', '', '', ''), ('A', 11, '合计', '', '', '12'), ('A', 12, '3-14', 'L1', 'Y', 'QA'), ('SMT', 2, '2026-03-14', 'L1', 'Z', 'QA'),
  ('B', 2, '2026-1-2', 'L3', '', 'QA'), ('B', 3, CAST(NULL AS STRING), 'L3', 'Q', CAST(NULL AS STRING))"""


def dirty_rows(spark: SparkSession) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM {DIRTY} AS t(sheet, row, date, line, model, stage)")
    return rows.select("*", *(F.lit(None).cast("string").alias(c) for c in defects.COLUMNS if c not in rows.columns))


def _duckdb(rows: str) -> str:
    return rows.replace("STRING", "VARCHAR")


@query("AG8", f"WITH {LOG_SQL} SELECT line, model, count(*) FILTER (upper(stage) = 'IPQC') AS ipqc, count(*) FILTER (upper(stage) = 'QA') AS qa, count(*) AS total FROM d GROUP BY line, model")
def defect_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.pivot(log(spark, sf_dir))


@query("AG9 DT2", f"WITH {LOG_SQL} SELECT strftime(day, '%Y-%m') AS month, line, model, count(*) FILTER (upper(stage) = 'IPQC') AS ipqc, count(*) FILTER (upper(stage) = 'QA') AS qa, count(*) AS total FROM d GROUP BY ALL")
def defect_pivot_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.pivot(log(spark, sf_dir), by_month=True)


@query("AG9", f"WITH {LOG_SQL} SELECT line, first_row, row_number() OVER (ORDER BY first_row, line)::INT AS position FROM (SELECT line, min(row) AS first_row FROM d GROUP BY line)")
def line_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.line_order(log(spark, sf_dir), "row")


@query("AG7", f"WITH {LOG_SQL} SELECT strftime(day, '%Y-%m') AS month, count(*) AS n FROM d GROUP BY 1")
def month_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.month_histogram(log(spark, sf_dir))


@query("AG7 ST3", f"WITH {LOG_SQL} SELECT min(day) AS first_day, max(day) AS last_day, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines, array_to_string(list_sort(list_distinct(list_concat(list(DISTINCT upper(stage)), ['IPQC', 'QA']))), ',') AS stages FROM d")
def defect_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.meta(log(spark, sf_dir)).select("first_day", "last_day", F.array_join("lines", ",").alias("lines"), F.array_join("stages", ",").alias("stages"))


@query("FLT3 SF7", f"WITH {LOG_SQL} SELECT row, model, day FROM d WHERE contains(lower(replace(model, ' ', '')), 'm1') AND strftime(day, '%Y-%m') = '1995-03'")
def defect_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.search(log(spark, sf_dir), " M 1", "1995-03").select("row", "model", "day")


@query(
    "DT1",
    """SELECT * FROM (VALUES ('2026-03-14', DATE '2026-03-14'), ('2026/3/14', DATE '2026-03-14'), ('2026.3.4', DATE '2026-03-04'), ('2026年3月5日', DATE '2026-03-05'), ('46095', DATE '2026-03-14'),
    ('20226.3.14', DATE '2026-03-14'), ('2026-02-30', NULL), ('2026-03-14T10:00:00', DATE '2026-03-14'), ('3-14', NULL), ('', NULL), ('合计', NULL), ('2026-1-2', DATE '2026-01-02'), ('日期', NULL)) AS t(raw, day)""",
)
def date_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty_rows(spark).where("date IS NOT NULL").select(F.col("date").alias("raw")).distinct()
    return rows.select("raw", dates.parse_date(F.col("raw")).alias("day"))


@query("DT1", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def date_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date of orders written in one of five ways comes back."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    serial = F.datediff(day.cast("date"), F.to_date(F.lit(dates.SERIAL_EPOCH))).cast("string")
    text = F.when(k == 0, F.date_format(day, "yyyy/M/d")).when(k == 1, F.date_format(day, "yyyy.MM.dd")).when(k == 2, F.date_format(day, "yyyy年M月d日")).when(k == 3, serial).otherwise(F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(text).alias("day"))


@query("DT2 DT3 DT4", "SELECT o_orderkey, year(d)::VARCHAR || '年' || month(d)::VARCHAR || '月' AS label, (date_trunc('month', d) - INTERVAL 1 MONTH)::DATE AS previous, d::TIMESTAMP AS starts, d::TIMESTAMP + INTERVAL 86399 SECOND AS ends FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
def month_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    text = day.cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.month_label(day).alias("label"), dates.previous_month(day).alias("previous"), dates.day_start(text).alias("starts"), dates.day_end(text).alias("ends"))


@query("SRC3 FLT4", _duckdb(f"SELECT sheet, row, coalesce(date = '日期' AND model = '型号', false) AS header FROM ({DIRTY}) AS t(sheet, row, date, line, model, stage) WHERE NOT (coalesce(date, '') = '' AND coalesce(line, '') = '' AND coalesce(model, '') = '' AND coalesce(stage, '') = '') AND coalesce(date, '') NOT LIKE '合计%'"))
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = defects.data_rows(dirty_rows(spark))
    return kept.select("sheet", "row", F.coalesce(defects.is_header(F.col("date"), F.col("model")), F.lit(False)).alias("header"))


@query("SRC4", "SELECT * FROM (VALUES ('日期', 0), ('线别', 1), ('型号', 2), ('IPQC', 3)) AS t(name, position)")
def header_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.header_positions(dirty_rows(spark).where("sheet = 'A'"), "row", ["date", "line", "model", "stage"])


@query("SRC5", "SELECT * FROM (VALUES ('valid', 'A', 7), ('error', 'A', 3), ('error', 'B', 2)) AS t(part, sheet, n)")
def upload_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, bad = defects.upload(dirty_rows(spark))
    both = valid.select(F.lit("valid").alias("part"), "sheet").unionAll(bad.select(F.lit("error").alias("part"), "sheet"))
    return both.groupBy("part", "sheet").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("TK6 MU11", f"WITH {LOG_SQL} SELECT row, row_number() OVER (ORDER BY day, row % 2, row)::INT AS position FROM d")
def import_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old (even) and new (odd) rows merged by day; the position shows the order."""
    rows = log(spark, sf_dir).withColumn("seq", F.col("row")).withColumn("date", F.col("day").cast("string"))
    return defects.merge(rows.where("row % 2 = 0"), rows.where("row % 2 = 1")).select("row", "position")


@query("MU9", "SELECT o_orderkey AS was, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey)::INT AS row FROM orders WHERE o_orderkey % 7 <> 0")
def bulk_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left after a batch delete, numbered anew in each sheet."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("sheet"), F.col("o_orderkey").alias("row"), F.col("o_orderkey").alias("was"))
    return defects.delete_rows(rows, rows.where("row % 7 = 0")).select("was", "row")
