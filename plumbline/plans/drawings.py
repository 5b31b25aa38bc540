"""Drawing queries: events and parts are readings, blocks, fragments and shapes of a page for each user or brand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, drawings
from .clusters import dense_cells
from .geometry import boxes
from .registry import query, table


@query("AG21", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN event_id % 10 > 0 THEN floor(value / 50) ELSE 0 END DESC, event_id) AS r FROM events) WHERE r = 1")
def best_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most confident of equal readings, with many ties."""
    e = table(spark, sf_dir, "events").withColumn("conf", F.when(F.col("event_id") % 10 > 0, F.floor(F.col("value") / 50)).cast("double"))
    return drawings.best_readings(e, ["user_id", "event_type"], "conf", "event_id").select("user_id", "event_type", "event_id", "value")


@query(
    "V15",
    """WITH e AS (SELECT event_id % 997 AS block, ['text', 'dim', 'note', 'qr', 'text', 'meta'][event_id % 6 + 1] AS kind, CASE WHEN event_id % 5 > 0 THEN event_type ELSE '' END AS text, event_id % 4 = 0 AS participate, CASE WHEN event_id % 3 > 0 THEN floor(value) / 500 END AS conf FROM events WHERE event_id % 997 % 3 > 0),
    f AS (SELECT *, participate AND text <> '' AS part FROM e), g AS (SELECT block, bool_or(part OR kind = 'qr') AS a, bool_or(kind IN ('dim', 'note', 'meta')) AS o, bool_or(part AND conf > 0 AND conf < 0.6) AS l FROM f GROUP BY block),
    b AS (SELECT DISTINCT event_id % 997 AS block FROM events), j AS (SELECT block, coalesce(a, false) AS a, coalesce(o, false) AS o, coalesce(l, false) AS l, coalesce(a, false) AND block % 7 = 0 AS forced FROM b LEFT JOIN g USING (block))
    SELECT block, a AND NOT forced AS has_marking, CASE WHEN a AND NOT forced THEN NULL WHEN forced THEN 'override_forced_empty' WHEN block % 4 > 1 AND NOT o THEN 'ocr_noise_only' WHEN o OR block % 5 > 2 THEN 'all_dim_note' WHEN block % 2 = 0 THEN 'ocr_empty' ELSE 'no_text_layer' END AS empty_reason, l AS low_conf FROM j""",
)
def block_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks are remainders of event ids; the elements of every third block are left out, so that some are empty."""
    e, block = F.col("event_id"), F.col("event_id") % 997
    events = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, ("text", "dim", "note", "qr", "text", "meta"))), (e % 6 + 1).cast("int"))
    elements = events.where(block % 3 > 0).select(block.alias("block"), kind.alias("kind"), F.when(e % 5 > 0, F.col("event_type")).otherwise("").alias("text"), (e % 4 == 0).alias("participate"), F.when(e % 3 > 0, F.floor("value") / 500).alias("conf"))
    b = F.col("block")
    blocks = events.select(block.alias("block")).distinct().select("block", F.when(b % 7 == 0, 0).alias("override"), (b % 2 == 0).alias("ocr_on"), F.when(b % 5 > 2, 3).otherwise(0).alias("ocr_raw"), F.when(b % 4 > 1, 1).otherwise(0).alias("ocr_noise"))
    return drawings.marking_flags(blocks, elements).select("block", "has_marking", "empty_reason", "low_conf")


@query(
    "JN12",
    """WITH b AS (SELECT user_id AS page, event_id, (event_id % 83 * 10)::DOUBLE AS x, (event_id % 79 * 10)::DOUBLE AS y, (20 + event_id % 7 * 10)::DOUBLE AS w, (20 + event_id % 5 * 10)::DOUBLE AS h FROM events),
    d AS (SELECT i.page, i.event_id AS image, o.event_id AS word, sqrt((i.x + i.w / 2 - o.x - o.w / 2) ** 2 + (i.y + i.h / 2 - o.y - o.h / 2) ** 2) AS d, greatest(i.w, i.h) * 2.5 AS far FROM b AS i JOIN b AS o ON o.page = i.page AND i.event_id % 5 = 0 AND o.event_id % 5 > 0)
    SELECT page, image, arg_min(word, (d, word)) AS word, round(min(d), 6) AS distance FROM d WHERE d <= far GROUP BY page, image""",
)
def nearest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image (every fifth box) with the nearest word (the other boxes' centres) within 2.5 times its size; whole numbers."""
    e = F.col("event_id")
    b = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), "event_id", *(v.cast("double").alias(k) for k, v in (("x", e % 83 * 10), ("y", e % 79 * 10), ("w", e % 7 * 10 + 20), ("h", e % 5 * 10 + 20))))
    images = b.where("event_id % 5 = 0").select("page", F.col("event_id").alias("image"), *"xywh")
    words = b.where("event_id % 5 > 0").select("page", F.col("event_id").alias("word"), (F.col("x") + F.col("w") / 2).alias("wx"), (F.col("y") + F.col("h") / 2).alias("wy"))
    return drawings.nearest_words(images, words, "page", "image", "word").select("page", "image", "word", F.round("distance", 6).alias("distance"))


@query("WN9")
def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of lines on a photo for each user; their order decides, so there is no SQL."""
    e = F.col("event_id")
    x, y = (e % 83) * 12, F.floor(e % 79 / 4) * 40
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("text"), (F.col("value") / 500).alias("conf"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 60.0).alias("x1"), (y + 20.0).alias("y1"), F.lit(1000.0).alias("width"), F.lit(1000.0).alias("height"))
    return drawings.merge_fragments(rows, "user_id", "event_id")


@query("V17 SF15 SF16")
def parsed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records on an image for each user, from its rows of text; what a record takes depends on those before it."""
    e = F.col("event_id")
    code = F.lpad((e * 7919 % 10**10).cast("string"), 10, "1")
    text = F.when(e % 5 == 0, F.concat(F.lit("子件编码："), code)).when(e % 5 == 1, F.concat(code, F.lit(" "), F.col("event_type"))).when(e % 5 == 2, F.concat(F.lit("名称 "), F.col("event_type"))).when(e % 5 == 3, F.lit("2026-03-14")).otherwise(F.col("event_type"))
    return drawings.parse_records(table(spark, sf_dir, "events").select(F.col("user_id").alias("image"), e.alias("row"), text.alias("text")))


@query("V2")
def same_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks without those that a more confident one stands for."""
    e = F.col("event_id")
    marks = boxes(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_id")
    return drawings.same_spots(
        marks.select(
            F.col("page").alias("drawing"), e.alias("id"), F.lit("Text").alias("type"), F.col("event_type").alias("text"), F.lit(0).alias("page"), (e % 2).cast("string").alias("view"), F.array((e % 9).cast("string")).alias("spans"), F.array().cast("array<string>").alias("images"),
            *"xywh", F.floor(F.col("value") / 100).cast("double").alias("confidence"),
        )
    ).select("drawing", "id")


@query("CC8")
def corridor_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of dense cells cut along corridors between the user's boxes, ten cells of 24 to a side."""
    cells = clusters.grid_components(dense_cells(spark, sf_dir), "page", 10).select("page", F.col("cluster").alias("component"), "r", "c")
    shapes = boxes(spark, sf_dir).select("page", (F.col("x") * 240).alias("x0"), (F.col("y") * 240).alias("y0"), ((F.col("x") + F.col("w")) * 240).alias("x1"), ((F.col("y") + F.col("h")) * 240).alias("y1"))
    return drawings.split_corridors(cells, shapes, "page", "component")


@query("CC11")
def xy_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's page as one seed, cut where four boxes or more lie on both sides of an empty band."""
    shapes = boxes(spark, sf_dir).select("page", (F.col("x") * 1000).alias("x0"), (F.col("y") * 1000).alias("y0"), (F.col("x") * 1000 + F.col("w") * 300).alias("x1"), (F.col("y") * 1000 + F.col("h") * 300).alias("y1"))
    seeds = shapes.select("page").distinct().select("page", F.lit(1).alias("seed"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(900.0).alias("x1"), F.lit(850.0).alias("y1"))
    return drawings.xy_cut(seeds, shapes, "page", "seed", least=4)
