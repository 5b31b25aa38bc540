"""Stock ledger: signed sums, running balances, latest movement, paged search, export, counters, guarded inserts.

A ledger is a fact table of movements (a material, a direction, a quantity, an order within the material) and a dimension
of materials. Quantities are doubles. Every direction but "out" adds to the stock.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType


def signed(quantity: Column, direction: Column) -> Column:
    """The quantity, negative if it goes out."""
    return F.when(direction == "out", -quantity).otherwise(quantity)


def normalize_direction(raw: Column) -> Column:
    """"in" or "out" from their synonyms; null for anything else."""
    s = F.lower(F.trim(raw))
    return F.when(s.isin("in", "入库", "入", "i", "+"), F.lit("in")).when(s.isin("out", "出库", "出", "o", "-"), F.lit("out"))


def stock(moves: DataFrame, by: Sequence[str], quantity: str = "qty", direction: str = "direction") -> DataFrame:
    """Stock and number of movements of every material; 0 if all quantities are null."""
    total = F.sum(signed(F.col(quantity), F.col(direction)))
    return moves.groupBy(*by).agg(F.coalesce(total, F.lit(0.0)).alias("stock"), F.count(F.lit(1)).alias("movements"))


def running_balance(moves: DataFrame, material: str, order: Sequence[str], quantity: str = "qty", direction: str = "direction") -> DataFrame:
    """moves with balance: the material's stock after each movement."""
    frame = Window.partitionBy(material).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return moves.withColumn("balance", F.sum(signed(F.col(quantity), F.col(direction))).over(frame))


def newest(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The n first rows in order of every group (of all rows, if by is empty: then without a window)."""
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")


def latest(moves: DataFrame, material: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Of every material, the columns of its last movement."""
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return moves.groupBy(material).agg(last.alias("__last")).select(material, *(F.col(f"__last.{c}").alias(f"last_{c}") for c in columns))


def keyword(columns: Sequence[str], word: str) -> Column:
    """Any column contains word, ASCII case aside; % and _ in it are wildcards; a blank word holds everywhere."""
    word = word.strip()
    if not word:
        return F.lit(True)
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).cast("string"), F.lit("")).ilike(f"%{word}%")
    return found


def movement_filter(handler: str | None = None, direction: str | None = None, first_day: str | None = None, last_day: str | None = None) -> Column:
    """The given conditions together; days are inclusive; a direction other than "in" and "out" is no condition."""
    found = F.lit(True)
    if handler:
        found = found & (F.col("handler") == handler)
    if direction in ("in", "out"):
        found = found & (F.col("direction") == direction)
    if first_day:
        found = found & (F.col("occurred_at") >= F.lit(f"{first_day} 00:00:00").cast("timestamp_ntz"))
    if last_day:
        found = found & (F.col("occurred_at") <= F.lit(f"{last_day} 23:59:59").cast("timestamp_ntz"))
    return found


def page_bounds(page: int, size: int) -> tuple[int, int]:
    """(offset, limit) of a page: pages start at 1; a size below 1 is 20, one over 500 is 500."""
    size = 20 if size < 1 else min(size, 500)
    return (max(page, 1) - 1) * size, size


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    offset, limit = page_bounds(number, size)
    return df.orderBy(*order).offset(offset).limit(limit)


def format_quantity(value: Column) -> Column:
    """Whole numbers without a fraction, others with up to four decimals, half to even."""
    whole = F.bround(value, 0)
    text = F.format_string("%.4f", F.bround(value, 4))
    return F.when(F.abs(value - whole) < 1e-9, whole.cast("long").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ""))


def count_uses(events: DataFrame, name: str, at: str) -> DataFrame:
    """What an upserted counter holds after all events: uses and last time of every name."""
    return events.groupBy(name).agg(F.count(F.lit(1)).alias("use_count"), F.max(at).alias("last_used_at"))


def rename_merge(dimension: DataFrame, renames: DataFrame, name: str = "name") -> DataFrame:
    """Rename by (old, new) and merge equal names: counts add up, the latest time stays."""
    renamed = dimension.join(renames, dimension[name] == renames["old"], "left").withColumn("__name", F.coalesce("new", name))
    return renamed.groupBy(F.col("__name").alias(name)).agg(F.sum("use_count").alias("use_count"), F.max("last_used_at").alias("last_used_at"))


def guard(moves: DataFrame, material: str, order: Sequence[str], quantity: str = "qty", direction: str = "direction", tolerance: float = 1e-9) -> DataFrame:
    """moves with accepted and balance (after the movement), booked one after another in each material's order.

    What goes out is refused if it exceeds the stock by more than tolerance, and isn't booked then; anything else is
    booked. Whether a movement is refused depends on all before it, so a material's movements are one sequence: rows are
    sorted by material within partitions and read as a stream, so that only the running stock is held. A null quantity
    counts as 0.
    """
    rows = moves.withColumn("__signed", F.coalesce(signed(F.col(quantity), F.col(direction)), F.lit(0.0)).cast("double")).withColumn("__out", F.coalesce(F.col(direction) == "out", F.lit(False)))
    ordered = rows.withColumn("__material", F.xxhash64(material)).repartition(material).sortWithinPartitions(material, *order)
    schema = StructType([*moves.schema.fields, StructField("accepted", BooleanType()), StructField("balance", DoubleType())])
    n = len(moves.columns)

    def book(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stock = None, 0.0
        for batch in batches:
            change, goes_out, keys = (batch.column(n + k).to_numpy(zero_copy_only=False) for k in range(3))
            accepted, balance = np.ones(len(keys), dtype=bool), np.empty(len(keys))
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if keys[a] != key:
                    key, stock = keys[a], 0.0
                at = a
                while at < b:
                    sums = np.cumsum(np.concatenate([[stock], change[at:b]]))[1:]
                    short = np.flatnonzero(goes_out[at:b] & (sums < -tolerance))
                    stop = at + int(short[0]) if len(short) else b
                    balance[at:stop] = sums[: stop - at]
                    stock = float(sums[stop - at - 1]) if stop > at else stock
                    if stop < b:
                        accepted[stop], balance[stop] = False, stock
                    at = stop + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(accepted), pa.array(balance)], names=schema.names)

    return ordered.mapInArrow(book, schema)


def split_valid(batch: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, other rows with the failed checks' names): each row stands or falls by itself."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    checked = batch.withColumn("errors", failed)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)
