"""Source and sink queries: tables are written in a format, and what is read back is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path
from ..sources import readers
from .registry import query, table


@query("SRC6", "SELECT r_regionkey AS id, r_name AS name, list_sort(list(n_name)) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def versioned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document for each region, parsed under its schema version."""
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("nations"))
    docs = table(spark, sf_dir, "region").join(nations, "r_regionkey").select(F.lit("region/1").alias("schema"), F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), "nations")
    path = fresh_path(spark, "documents")
    docs.write.json(path)
    return readers.documents(spark, path, "schema string, id int, name string, nations array<string>", "region/1", lines=True).drop("schema")


@query("SRC8", "SELECT event_type, count(*) AS files, 0::BIGINT AS errors FROM (SELECT DISTINCT event_type, event_id % 3 AS part FROM events) GROUP BY event_type")
def directory_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files below a folder, with one folder for each type of event and three files in each."""
    path = fresh_path(spark, "sweep")
    table(spark, sf_dir, "events").withColumn("part", F.col("event_id") % 3).repartition(1).write.partitionBy("event_type", "part").json(path)
    found = readers.sweep(spark, path).withColumn("event_type", F.regexp_extract("path", "event_type=([^/]*)/", 1))
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("files"), F.count("error").alias("errors"))


@query("SRC9", "SELECT c_custkey::VARCHAR AS case_id, c_name || ', \"' || c_mktsegment || '\"' AS text, CASE WHEN c_custkey % 3 > 0 THEN 'present' END AS truth FROM customer")
def truth_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A truth sheet with commas, quotes and empty cells, exported and imported."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("case_id"), F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("text"), F.when(F.col("c_custkey") % 3 > 0, "present").alias("truth"))
    path = fresh_path(spark, "truth")
    readers.write_truth_sheet(rows, path)
    return readers.truth_sheet(spark, path)


@query("SNK2", "SELECT o_orderpriority AS line, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS ipqc FROM orders GROUP BY o_orderpriority")
def analysis_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An analysis as a report file, read back with its types."""
    report = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("line")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("ipqc"))
    path = fresh_path(spark, "report")
    readers.export(report, path, "csv")
    return spark.read.schema(report.schema).option("header", True).csv(path)


@query("SNK3", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 1")
def published_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table published twice: readers get the second version."""
    root = fresh_path(spark, "book")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    readers.publish(nations, root, "nations")
    readers.publish(readers.current(spark, root, "nations").where("n_regionkey <> 1").select("n_nationkey", "n_name"), root, "nations")
    return readers.current(spark, root, "nations")
