"""Extension: the ledger as a stream. What the batch operators compute, kept up to date as movements arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import signed


def stock_stream(moves: DataFrame, material: str) -> DataFrame:
    """Stock and movements of every material; for the update or complete mode."""
    return moves.groupBy(material).agg(F.sum(signed(F.col("qty"), F.col("direction"))).alias("stock"), F.count(F.lit(1)).alias("movements"))


def windowed_flow(moves: DataFrame, at: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Signed flow by time window; movements later than the watermark are dropped."""
    flow = F.sum(signed(F.col("qty"), F.col("direction"))).alias("flow")
    return moves.withWatermark(at, late).groupBy(F.window(at, width).alias("window")).agg(flow)


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Process what is there into a Parquet folder (append) or an in-memory table (otherwise), then stop: a batch job."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.format("parquet").start(sink) if mode == "append" else writer.format("memory").queryName(sink).start()


def read_moves(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
