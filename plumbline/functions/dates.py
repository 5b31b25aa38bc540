"""Dates out of dirty text, month keys, day bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day 0 of spreadsheet serial numbers.
SERIAL_EPOCH = "1899-12-30"


def parse_date(raw: Column) -> Column:
    """A date from text, else null.

    Blank is null; a plain number is a spreadsheet serial; otherwise what follows a space or "T" goes, the separators
    / - and the year, month and day signs count as points, three parts are needed, and a year of five digits that starts
    with 202 loses its third one. Two-digit years stay as they are, so they are no dates of this century.
    """
    text = F.trim(raw)
    day = F.split(F.split(text, "[ T]")[0], r"[./\-年月日]")
    parts = F.filter(day, lambda p: p != "")
    year = F.when(parts[0].rlike("^202[0-9]{2}$"), F.concat(F.substring(parts[0], 1, 2), F.substring(parts[0], 4, 2))).otherwise(parts[0])
    whole = F.size(parts) >= 3
    numeric = whole & year.rlike("^[0-9]{1,4}$") & F.get(parts, F.lit(1)).rlike("^[0-9]{1,2}$") & F.get(parts, F.lit(2)).rlike("^[0-9]{1,2}$")
    built = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(2)), 2, "0"))
    number = text.try_cast("double")
    by_number = F.date_add(F.to_date(F.lit(SERIAL_EPOCH)), F.floor(number).cast("int"))
    return F.when(number.between(1, 2_900_000), by_number).when(numeric, built.try_cast("date"))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_label(day: Column) -> Column:
    """Year and month without a leading zero."""
    return F.concat(F.year(day).cast("string"), F.lit("年"), F.month(day).cast("string"), F.lit("月"))


def previous_month(day: Column) -> Column:
    """The first day of the month before."""
    return F.add_months(F.trunc(day, "MM"), -1)


def day_start(day: Column) -> Column:
    return F.to_timestamp_ntz(F.concat(day, F.lit(" 00:00:00")))


def day_end(day: Column) -> Column:
    return F.to_timestamp_ntz(F.concat(day, F.lit(" 23:59:59")))
