"""Ledger queries: line items are the movements, parts the materials, suppliers the handlers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger
from .registry import query, table

ID = ("l_orderkey", "l_linenumber")
#: Order of a part's movements; the last two tell apart what the first two leave equal.
ORDER = (*ID, "l_extendedprice", "l_shipdate")
MOVES_SQL = """m AS (SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice, l_shipdate, l_suppkey::VARCHAR AS handler, l_quantity AS qty, l_shipdate AS occurred_at,
  CASE WHEN l_returnflag = 'R' THEN 'out' ELSE 'in' END AS direction, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS s FROM lineitem)"""


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    direction = F.when(F.col("l_returnflag") == "R", F.lit("out")).otherwise(F.lit("in"))
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_partkey", *ORDER, F.col("l_suppkey").cast("string").alias("handler"), F.col("l_quantity").alias("qty"), F.col("l_shipdate").alias("occurred_at"), direction.alias("direction"))


@query("SRC1 AG1 AG2", f"WITH {MOVES_SQL} SELECT l_partkey, coalesce(sum(s), 0) AS stock, count(*) AS movements FROM m GROUP BY l_partkey")
def stock_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.stock(moves(spark, sf_dir), ["l_partkey"])


@query("WN1", f"WITH {MOVES_SQL} SELECT l_partkey, l_orderkey, l_linenumber, direction, qty, sum(s) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_shipdate ROWS UNBOUNDED PRECEDING) AS balance FROM m")
def running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.running_balance(moves(spark, sf_dir), "l_partkey", ORDER).select("l_partkey", *ID, "direction", "qty", "balance")


@query(
    "WN1 TK2",
    f"""WITH {MOVES_SQL}, b AS (SELECT l_partkey, l_orderkey, l_linenumber, sum(s) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_shipdate ROWS UNBOUNDED PRECEDING) AS balance,
      row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_shipdate DESC) AS r FROM m)
    SELECT l_partkey, l_orderkey, l_linenumber, balance FROM b WHERE r <= 5""",
)
def newest_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest movements of a part, with balances over all of its movements."""
    balanced = ledger.running_balance(moves(spark, sf_dir), "l_partkey", ORDER)
    return ledger.newest(balanced, ["l_partkey"], [F.desc(c) for c in ORDER], 5).select("l_partkey", *ID, "balance")


@query(
    "FLT2 WN2 JN1 SNK1",
    f"""WITH {MOVES_SQL} SELECT p_name, l_partkey, l_orderkey, l_linenumber, handler, qty, sum(s) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_shipdate ROWS UNBOUNDED PRECEDING) AS balance
    FROM m JOIN part ON p_partkey = l_partkey WHERE occurred_at >= '1995-01-01 00:00:00' AND occurred_at <= '1996-12-31 23:59:59'""",
)
def ledger_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements of two years with balances over the filtered rows only."""
    kept = moves(spark, sf_dir).where(ledger.movement_filter(first_day="1995-01-01", last_day="1996-12-31"))
    balanced = ledger.running_balance(kept, "l_partkey", ORDER)
    return balanced.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select("p_name", "l_partkey", *ID, "handler", "qty", "balance")


@query(
    "FLT2 WN2",
    f"""WITH {MOVES_SQL} SELECT l_partkey, l_orderkey, l_linenumber, sum(s) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_shipdate ROWS UNBOUNDED PRECEDING) AS balance
    FROM m WHERE handler = '7' AND direction = 'out'""",
)
def filtered_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = moves(spark, sf_dir).where(ledger.movement_filter(handler="7", direction="out"))
    return ledger.running_balance(kept, "l_partkey", ORDER).select("l_partkey", *ID, "balance")


@query("WN3", f"WITH {MOVES_SQL} SELECT l_partkey, arg_max(occurred_at, (l_orderkey, l_linenumber, l_extendedprice, l_shipdate)) AS last_occurred_at, arg_max(handler, (l_orderkey, l_linenumber, l_extendedprice, l_shipdate)) AS last_handler FROM m GROUP BY l_partkey")
def last_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(moves(spark, sf_dir), "l_partkey", ORDER, ["occurred_at", "handler"])


@query(
    "FLT1 TK1 WN3 AG1",
    f"""WITH {MOVES_SQL}, s AS (SELECT l_partkey, sum(s) AS stock, arg_max(occurred_at, (l_orderkey, l_linenumber, l_extendedprice, l_shipdate)) AS last_at FROM m GROUP BY l_partkey)
    SELECT p_partkey, p_name, p_brand, coalesce(stock, 0) AS stock, last_at FROM part LEFT JOIN s ON l_partkey = p_partkey
    WHERE p_name ILIKE '%an%' OR p_brand ILIKE '%an%' OR p_type ILIKE '%an%' ORDER BY last_at DESC NULLS LAST, p_partkey DESC LIMIT 20 OFFSET 20""",
)
def material_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of a keyword search, most recently moved first."""
    m = moves(spark, sf_dir)
    moved = ledger.stock(m, ["l_partkey"]).join(ledger.latest(m, "l_partkey", ORDER, ["occurred_at"]), "l_partkey")
    found = table(spark, sf_dir, "part").where(ledger.keyword(["p_name", "p_brand", "p_type"], " an "))
    rows = found.join(moved, F.col("p_partkey") == F.col("l_partkey"), "left")
    rows = rows.select("p_partkey", "p_name", "p_brand", F.coalesce("stock", F.lit(0.0)).alias("stock"), F.col("last_occurred_at").alias("last_at"))
    return ledger.page(rows, [F.desc_nulls_last("last_at"), F.desc("p_partkey")], 2, 20)


@query("FLT1", "SELECT count(*) AS found, count(*) FILTER (p_name ILIKE '%s_l%' OR p_brand ILIKE '%s_l%') AS wild FROM part")
def keyword_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank keyword finds all; _ and % in a keyword are wildcards."""
    part = table(spark, sf_dir, "part")
    return part.agg(F.count_if(ledger.keyword(["p_name"], "  ")).alias("found"), F.count_if(ledger.keyword(["p_name", "p_brand"], "s_l")).alias("wild"))


@query("SRC2", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 17")
def material_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey = 17").select("p_partkey", "p_name", "p_brand")


@query("AG6", "SELECT (SELECT count(*) FROM part) AS materials, (SELECT count(*) FROM lineitem) AS records, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS handlers")
def module_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three one-row aggregates side by side."""
    items = table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("l_suppkey").alias("handlers"))
    return table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("materials")).join(items, F.lit(True)).select("materials", "records", "handlers")


@query(
    "PRJ1 PRJ2",
    """SELECT l_orderkey, l_linenumber, CASE WHEN abs(v - round_even(v, 0)) < 1e-9 THEN round_even(v, 0)::BIGINT::VARCHAR ELSE rtrim(rtrim(printf('%.4f', round_even(v, 4)), '0'), '.') END AS shown,
    CASE WHEN l_returnflag = 'R' THEN 'out' WHEN l_returnflag = 'A' THEN 'in' END AS direction FROM (SELECT *, l_quantity * (1 + l_tax) AS v FROM lineitem)""",
)
def movement_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("l_returnflag") == "R", F.lit(" OUT ")).when(F.col("l_returnflag") == "A", F.lit("入库")).otherwise(F.lit("?"))
    value = F.col("l_quantity") * (1 + F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select(*ID, ledger.format_quantity(value).alias("shown"), ledger.normalize_direction(raw).alias("direction"))


@query("MU1 TK2", "SELECT user_id, count(*) AS use_count, max(ts) AS last_used_at FROM events GROUP BY user_id ORDER BY last_used_at DESC, user_id LIMIT 50")
def handler_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = ledger.count_uses(table(spark, sf_dir, "events"), "user_id", "ts")
    return ledger.newest(used, [], [F.desc("last_used_at"), F.asc("user_id")], 50)


@query(
    "MU2",
    """SELECT name, sum(n)::BIGINT AS use_count, max(t) AS last_used_at FROM (SELECT CASE WHEN event_type = 'view' THEN 'click' ELSE event_type END AS name, count(*) AS n, max(ts) AS t FROM events GROUP BY event_type) GROUP BY name""",
)
def handler_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = ledger.count_uses(table(spark, sf_dir, "events").withColumnRenamed("event_type", "name"), "name", "ts")
    return ledger.rename_merge(used, spark.sql("SELECT 'view' AS old, 'click' AS new"))


@query(
    "MU3",
    f"""WITH RECURSIVE {MOVES_SQL}, o AS MATERIALIZED (SELECT l_partkey, l_orderkey, l_linenumber, s, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_shipdate) AS k FROM m),
    b AS (SELECT l_partkey, 0::BIGINT AS k, 0::BIGINT AS l_orderkey, 0::INT AS l_linenumber, true AS accepted, 0::DOUBLE AS stock FROM o WHERE k = 1 UNION ALL
      SELECT o.l_partkey, o.k, o.l_orderkey, o.l_linenumber::INT, NOT (o.s < 0 AND -o.s - b.stock > 1e-9), CASE WHEN o.s < 0 AND -o.s - b.stock > 1e-9 THEN b.stock ELSE b.stock + o.s END FROM b JOIN o ON o.l_partkey = b.l_partkey AND o.k = b.k + 1)
    SELECT l_partkey, l_orderkey, l_linenumber, accepted, round(stock, 6) AS stock FROM b WHERE k > 0""",
)
def stock_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which movements are booked when nothing may go out that isn't there, and the stock after each."""
    booked = ledger.guard(moves(spark, sf_dir), "l_partkey", ORDER)
    return booked.select("l_partkey", *ID, "accepted", F.round("balance", 6).alias("stock"))


@query(
    "MU4",
    """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size < 5 THEN 'size' END, CASE WHEN p_retailprice > 1500 THEN 'price' END], lambda x: x IS NOT NULL), ',') AS errors FROM part WHERE p_size < 5 OR p_retailprice > 1500""",
)
def batch_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a batch that fail, each with its reasons; the others aren't touched."""
    _, bad = ledger.split_valid(table(spark, sf_dir, "part"), {"size": F.col("p_size") >= 5, "price": F.col("p_retailprice") <= 1500})
    return bad.select("p_partkey", F.array_join("errors", ",").alias("errors"))


@query("MU8", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 30")
def usage_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring buffer keeps the newest thirty."""
    return ledger.newest(table(spark, sf_dir, "events"), [], [F.desc("event_id")], 30).select("event_id", "user_id", "event_type")
