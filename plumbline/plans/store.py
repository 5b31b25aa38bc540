"""Store queries: parts are marks and profiles, orders are records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from .registry import query, table


@query(
    "AG20 JS2",
    """WITH r AS (SELECT p_brand, p_partkey::VARCHAR || '|' || p_name || '|' || p_type || '|' || CASE WHEN p_size = 1 THEN '-' ELSE printf('%.4f', p_size / 61.0) || ',' || printf('%.4f', p_size / 131.0) || ',0.5000,0.2500' END AS s FROM part)
    SELECT p_brand, upper(sha256(string_agg(s, chr(10) ORDER BY s))) AS fingerprint FROM r GROUP BY p_brand""",
)
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_size") != 1, F.col("p_size"))
    box = store.box_text(size / 61.0, size / 131.0, F.lit(0.5), F.lit(0.25))
    return store.fingerprint(table(spark, sf_dir, "part"), ["p_brand"], [F.col("p_partkey"), F.col("p_name"), F.col("p_type"), box])


TREE_SQL = "tr AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 50 THEN p_partkey % 60 + 1 END AS parent, p_size % 5 > 0 AS active, p_brand, p_type FROM part)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.when(k > 50, k % 60 + 1).alias("parent"), (F.col("p_size") % 5 > 0).alias("active"), "p_brand", "p_type")


@query(
    "FLT6 JN4",
    f"""WITH RECURSIVE {TREE_SQL}, up AS (SELECT id, active AS ok, parent FROM tr UNION ALL SELECT up.id, coalesce(tr.active, false), tr.parent FROM up LEFT JOIN tr ON tr.id = up.parent WHERE up.parent IS NOT NULL)
    SELECT id, bool_and(ok) AS effective FROM up GROUP BY id""",
)
def effective_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.effectively_active(tree(spark, sf_dir), "id", "parent", "active").select("id", "effective")


@query("JN4", f"WITH {TREE_SQL}, few AS (SELECT * FROM tr WHERE id % 3 > 0) SELECT a.id, b.id AS parent FROM few AS a LEFT JOIN few AS b ON b.id = a.parent")
def mark_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.roots(tree(spark, sf_dir).where("id % 3 > 0"), "id", "parent").select("id", "parent")


@query("FLT5 AG4", f"WITH {TREE_SQL} SELECT p_brand AS view, count(*) AS n FROM tr WHERE parent IS NULL AND active AND p_brand <> 'Brand#11' GROUP BY p_brand ORDER BY n DESC, view")
def view_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = tree(spark, sf_dir).where("parent IS NULL AND active AND p_brand <> 'Brand#11'")
    return top.groupBy(F.col("p_brand").alias("view")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "view")


@query("AG3", "SELECT p_type AS rule_id, count(*) AS n FROM part GROUP BY p_type ORDER BY p_type")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("rule_id")).agg(F.count(F.lit(1)).alias("n")).orderBy("rule_id")


@query("AG5", "SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey, o_orderstatus")
def distinct_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.distinct_pairs(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey", ["o_orderpriority"])


@query(
    "WN5",
    """WITH w AS (SELECT unnest(['red anvil', 'smal', 'blue', 'nothing', 're', 'l']) AS wanted), c AS (SELECT wanted, p_name AS found, p_partkey AS id, CASE WHEN p_name = wanted THEN 0 ELSE 1 END AS tier FROM w JOIN part ON starts_with(p_name, wanted)),
    r AS (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY tier, id DESC) AS r FROM c) SELECT wanted, found, id, tier FROM r WHERE r = 1""",
)
def latest_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.sql("SELECT explode(array('red anvil', 'smal', 'blue', 'nothing', 're', 'l')) AS wanted")
    return store.latest_profile(table(spark, sf_dir, "part"), wanted, "p_name", "p_partkey")


@query("JN2", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 5000")
def record_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000")
    o = table(spark, sf_dir, "orders")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").select("o_orderkey", "c_mktsegment")


@query("JN5 TK7", "SELECT o_orderkey, coalesce(array_to_string(list(l_returnflag ORDER BY l_linenumber, l_returnflag) FILTER (l_returnflag IS NOT NULL), ','), '') AS elements FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def block_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
    return store.attach(o, e, "o_orderkey", "l_linenumber", "l_returnflag").select("o_orderkey", F.array_join("elements", ",").alias("elements"))


@query("MU5", "SELECT p_brand, p_partkey, p_retailprice FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 3) UNION ALL SELECT p_brand, p_partkey, p_retailprice + 1 FROM part WHERE p_size = 3")
def replace_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size")
    new = p.where("p_size = 3").withColumn("p_retailprice", F.col("p_retailprice") + 1)
    return store.replace_partitions(p, new, ["p_brand"]).select("p_brand", "p_partkey", "p_retailprice")


@query("MU6", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_partkey % 4 > 0 THEN 'approved' END AS review FROM part")
def kept_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    old = p.where("p_partkey % 4 > 0").select("p_partkey", F.col("p_size").alias("fingerprint"), F.lit("approved").alias("review"))
    new = p.select("p_partkey", (F.col("p_size") + F.col("p_size") % 2).alias("fingerprint"))
    return store.keep_reviews(old, new, "p_partkey").select("p_partkey", "review")


@query("MU7", "SELECT user_id, event_type, max(event_id) AS review_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def review_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete and insert: the newest row of a key stands."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("review_id"), F.max_by("value", "event_id").alias("value"))


@query("MU10", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS children FROM orders WHERE o_custkey % 10 > 0")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    left, kids = store.cascade_delete(o, li, o.where("o_custkey % 10 = 0"), "o_orderkey", "l_orderkey")
    n = kids.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return left.join(n, left["o_orderkey"] == n["l_orderkey"], "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("children"))


@query("MU12", "SELECT p_partkey, CASE WHEN p_name = 'red anvil' THEN 'RED' ELSE p_name END AS p_name FROM part WHERE p_name <> 'small anvil'")
def overridden_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    drops, new = spark.sql("SELECT 'small anvil' AS k"), spark.sql("SELECT 'red anvil' AS k, 'RED' AS replacement")
    return store.override(table(spark, sf_dir, "part").withColumn("k", F.col("p_name")), drops, new, "k", "p_name").select("p_partkey", "p_name")


@query("JS1 SRC7", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.K')) AS k, CASE WHEN json_valid(props) AND json_type(props) = 'ARRAY' THEN json_array_length(props) ELSE 0 END::INT AS n FROM events")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", store.json_field(F.col("props"), "k", "K").alias("k"), store.json_array_length(F.col("props")).alias("n"))


@query("TK5", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20 AND event_type = 'error'")
def cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the newest twenty are looked at."""
    e = table(spark, sf_dir, "events")
    return store.newest_then(e, ["user_id"], [F.desc("event_id")], 20, F.col("event_type") == "error").select("event_id", "user_id")


@query(
    "AG27 TK7",
    """WITH s AS (SELECT o_custkey AS block, o_orderkey AS id, substr(o_orderpriority, 1, 1) AS text, (o_orderkey % 13) / 20.0::DOUBLE AS y, (o_orderkey % 17) / 20.0::DOUBLE AS x, o_orderkey % 4 AS angle FROM orders)
    SELECT block, string_agg(text, '' ORDER BY y, x, id) AS text, min(x) AS x, round(max(x + 0.1) - min(x), 9) AS w, arg_min(angle, (y, x, id)) AS angle FROM s GROUP BY block""",
)
def text_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    spans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("block"), k.alias("id"), F.substring("o_orderpriority", 1, 1).alias("text"), ((k % 13) / 20.0).alias("y"), ((k % 17) / 20.0).alias("x"), F.lit(0.1).alias("w"), F.lit(0.05).alias("h"), (k % 4).alias("angle"))
    return store.text_runs(spans, ["block"]).select("block", "text", "x", F.round("w", 9).alias("w"), "angle")
