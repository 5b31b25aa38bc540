"""Sources and sinks: tables, JSON documents with a schema version, truth sheets, sweeps, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table; columns and filters reach the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, path: str, schema: StructType | str, version: str, lines: bool = False) -> DataFrame:
    """JSON documents, one a file (or a line), of exactly this schema version: a broken document or another version fails the read."""
    df = spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    wrong = F.raise_error(F.concat(F.lit("unknown schema version "), F.coalesce(F.col("schema"), F.lit("null"))))
    return df.withColumn("schema", F.when(F.col("schema") == version, F.col("schema")).otherwise(wrong.cast("string")))


def tolerant_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON documents with what can't be read as null."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def truth_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A truth sheet in CSV with a header; a byte-order mark is no part of the first name."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def write_truth_sheet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)


def sweep(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """path, bytes and error of every matching file below path; unreadable content is an error, not a stop.

    Spark's file sources leave empty files out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.when(F.length("content") < F.col("length"), "cut off").alias("error"))


def publish(df: DataFrame, root: str, name: str) -> str:
    """Write a new version of a table beside the old ones, then move the pointer to it; the version's path.

    One writer at a time: the lock is a file that only one can create, and it is an error if it is there. Readers see the
    old version or the new one, since the pointer is one small file that is renamed into place. Its second line is the
    version before, which stays as the backup; older ones stay until somebody removes them.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    path = lambda p: hadoop.Path(p)
    files = path(root).getFileSystem(conf)
    files.mkdirs(path(root))
    lock, pointer, fresh = (path(f"{root}/{name}.{end}") for end in ("lock", "current", f"{uuid.uuid4().hex}.next"))
    files.create(lock, False).close()
    try:
        version = f"{root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(version)
        lines = [version, *([spark.read.option("wholetext", True).text(pointer.toString()).first()[0].split("\n")[0]] if files.exists(pointer) else [])]
        out = files.create(fresh, False)
        out.write("\n".join(lines).encode())
        out.close()
        overwrite = getattr(hadoop, "Options$Rename")
        how = spark.sparkContext._gateway.new_array(overwrite, 1)
        how[0] = overwrite.OVERWRITE
        hadoop.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(fresh), files.makeQualified(pointer), how)
    finally:
        files.delete(lock, False)
    return version


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The version that the pointer names."""
    return spark.read.parquet(spark.read.option("wholetext", True).text(f"{root}/{name}.current").first()[0].split("\n")[0])


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Write a report: csv with a header, json lines, or parquet."""
    writer = df.write.mode("overwrite")
    {"csv": lambda: writer.option("header", True).csv(path), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[kind]()
