"""Defect log: reading dirty sheets, filters, month statistics, pivots, merging and deleting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_key, parse_date

# The log's columns, its header words, and the mark of subtotal rows.
COLUMNS = ("date", "line", "model", "reason", "qty", "stage", "image", "handle")
HEADER_DATE, HEADER_MODEL, SUBTOTAL, BLANK_LINE = "日期", "型号", "合计", "未填写"
SKIPPED_SHEET = "SMT"
DEFAULT_STAGES = ("IPQC", "QA")


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""


def data_rows(sheet: DataFrame, cells: Sequence[str] = COLUMNS) -> DataFrame:
    """Rows with any cell, but without a cell that starts with the subtotal mark."""
    blank = reduce(lambda a, b: a & b, [_blank(F.col(c)) for c in cells])
    subtotal = reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(c).cast("string")).startswith(SUBTOTAL), F.lit(False)) for c in cells])
    return sheet.where(~blank & ~subtotal)


def header_positions(sheet: DataFrame, row: str, cells: Sequence[str], date_name: str = HEADER_DATE, model_name: str = HEADER_MODEL) -> DataFrame:
    """name and position of every cell of the header: the first of rows 1 to 6 that has both names; first cells win."""
    texts = F.array(*[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in cells])
    rows = sheet.where(F.col(row).between(1, 6)).select(row, texts.alias("texts"))
    header = rows.where(F.array_contains("texts", date_name) & F.array_contains("texts", model_name)).agg(F.min_by("texts", row).alias("texts"))
    return header.select(F.posexplode("texts").alias("position", "name")).where("name <> ''").groupBy("name").agg(F.min("position").alias("position"))


def is_header(date: Column, model: Column) -> Column:
    """A header that was typed among the data."""
    return (F.trim(date) == HEADER_DATE) & (F.trim(model) == HEADER_MODEL)


def norm_model(model: Column) -> Column:
    return F.lower(F.regexp_replace(model, r"\s", ""))


def upload(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) rows of all sheets but the skipped one; a row needs a readable date and a model."""
    kept = data_rows(rows.where(F.upper(F.trim("sheet")) != SKIPPED_SHEET)).withColumn("day", parse_date(F.col("date")))
    valid = F.col("day").isNotNull() & ~_blank(F.col("model"))
    return kept.where(valid), kept.where(~valid)


def search(log: DataFrame, model: str | None = None, month: str | None = None, day: str = "day") -> DataFrame:
    """Rows whose model contains model (white space and case aside) and whose month is month; null dates have none."""
    found = F.lit(True)
    if model:
        found = found & norm_model(F.col("model")).contains("".join(model.split()).lower())
    if month:
        found = found & F.coalesce(month_key(F.col(day)) == month, F.lit(False))
    return log.where(found)


def month_histogram(log: DataFrame, day: str = "day") -> DataFrame:
    return log.where(F.col(day).isNotNull()).groupBy(month_key(F.col(day)).alias("month")).agg(F.count(F.lit(1)).alias("n"))


def meta(log: DataFrame, day: str = "day") -> DataFrame:
    """One row: first and last day, and the sorted lines and stages, stages with the defaults among them."""
    defaults = F.array(*map(F.lit, DEFAULT_STAGES))
    stages = F.array_sort(F.array_union(F.collect_set(F.upper(F.trim("stage"))), defaults))
    return log.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.array_sort(F.collect_set("line")).alias("lines"), stages.alias("stages"))


def pivot(log: DataFrame, by_month: bool = False, day: str = "day") -> DataFrame:
    """Rows (not quantities) by line and model, and month if asked: ipqc, qa, total; a blank line has a name of its own."""
    line = F.when(_blank(F.col("line")), F.lit(BLANK_LINE)).otherwise(F.trim("line")).alias("line")
    stage = F.upper(F.trim("stage"))
    keys = [*([month_key(F.col(day)).alias("month")] if by_month else []), line, F.coalesce(F.trim("model"), F.lit("")).alias("model")]
    counts = [F.count_if(stage == s).alias(s.lower()) for s in DEFAULT_STAGES]
    return log.groupBy(*keys).agg(*counts, F.count(F.lit(1)).alias("total"))


def line_order(log: DataFrame, row: str) -> DataFrame:
    """Lines by first appearance, numbered from 1; the window runs over one row for each line."""
    first = log.groupBy("line").agg(F.min(row).alias("first_row"))
    return first.withColumn("position", F.row_number().over(Window.orderBy("first_row", "line")))


def merge(old: DataFrame, new: DataFrame, day: str = "day") -> DataFrame:
    """Old and new rows with their position: header rows first, then by day, rows without one last, else as they came (seq).

    Positions are counted within each day and moved by the rows of the days before, of which there is one row a day; no
    sort runs over all rows.
    """
    rows = old.withColumn("source", F.lit(0)).unionByName(new.withColumn("source", F.lit(1)))
    rows = rows.withColumn("header", F.coalesce(is_header(F.col("date"), F.col("model")), F.lit(False)))
    days = rows.groupBy(F.col("header").alias("__header"), F.col(day).alias("__day")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy(F.desc("__header"), F.asc_nulls_last("__day")).rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("__header", "__day", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("header", day).orderBy("source", "seq"))
    numbered = rows.withColumn("__within", within).join(days, (F.col("header") == F.col("__header")) & F.col(day).eqNullSafe(F.col("__day")))
    return numbered.withColumn("position", (F.col("__before") + F.col("__within")).cast("int")).drop("__header", "__day", "__before", "__within")


def delete_rows(log: DataFrame, gone: DataFrame, row: str = "row") -> DataFrame:
    """log without the rows named in gone; the others are numbered anew from 1 within each sheet."""
    left = log.join(gone.select("sheet", row).distinct(), ["sheet", row], "left_anti")
    return left.withColumn(row, F.row_number().over(Window.partitionBy("sheet").orderBy(row)))
