"""Mark queries over literal drawings; the results follow from the rules by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import marks
from .registry import query
from .text import CLAUSE

SCOPE_CLAUSE = "技术要求:1、上盖顶部、二维码处均使用激光打标."
TEXTS = (
    (1, 1, "LOW VOLTAGE禁止强电地暖阀", 0.4, 0.4), (1, 3, "服务热线：4008601111", 0.4, 0.5), (1, 4, "PC-P1HEQ2", 0.5, 0.5), (1, 5, "12±0.5", 0.5, 0.5), (1, 6, "更改MAC地址打标A/22", 0.5, 0.5), (1, 7, "YORK", 0.5, 0.6),
    (1, 10, "注：内容以实际生产为准", 0.5, 0.7), (2, 1, "PC-P1HEQ2 服务热线400", 0.5, 0.5), (2, 2, "YORK", 0.5, 0.6), (2, 3, "点检模式1", 0.5, 0.6), (2, 4, "QHSGK", 0.95, 0.6), (2, 5, "ABX 开", 0.5, 0.5), (2, 6, "12±0.5", 0.5, 0.5),
    (2, 7, "二维码", 0.2, 0.2), (2, 8, "二维码格式：", 0.8, 0.8), (2, 9, "DC I5", 0.1, 0.4), (3, 1, "上盖", 0.5, 0.5),
)
#: Images by their place in hundredths of the page, and pixels.
IMAGES = ((2, 1, 18, 24, 4, 4, 200, 30), (2, 2, 50, 30, 4, 4, 100, 100), (2, 3, 40, 30, 4, 4, 200, 30), (2, 4, 78, 84, 4, 4, 100, 100), (2, 5, 60, 30, 4, 4, 40, 40))
READINGS = ((2, 1, " HISENSE ", 0.95), (2, 2, "YCWA15NCWQ", 0.0), (2, 3, " ", 0.9), (3, 1, "8888", 0.6))


def drawings(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    texts = ", ".join(f"({d}L, {b}L, '{s}', {x}D, {y}D, {x * 100}D, {y * 100}D)" for d, b, s, x, y in TEXTS)
    images = ", ".join(f"({d}L, {i}L, {x}D, {y}D, {w}D, {h}D, {a}, {b})" for d, i, x, y, w, h, a, b in IMAGES)
    readings = ", ".join(f"({d}L, {i}L, '{s}', {c}D)" for d, i, s, c in READINGS)
    return (
        spark.sql(f"SELECT * FROM VALUES (1L, '{CLAUSE}'), (3L, '{SCOPE_CLAUSE}') AS t(drawing, text)"),
        spark.sql(f"SELECT * FROM VALUES {texts} AS t(drawing, block, text, nx, ny, cx, cy)"),
        spark.sql(f"SELECT * FROM VALUES {images} AS t(drawing, image, x, y, w, h, width, height)"),
        spark.sql(f"SELECT * FROM VALUES {readings} AS t(drawing, reading, text, conf)"),
    )


@query(
    "V1 V3 JN11 JN12",
    """SELECT * FROM (VALUES (1, 1, 'R1', '禁止强电', 0.95, NULL), (1, 1, 'R1', '地暖阀', 0.95, NULL), (1, 3, 'R1', '服务热线', 0.95, NULL), (1, -1, 'R1-noloc', 'MAC地址', 0.30, NULL), (1, -1, 'R1-noloc', '按键', 0.30, NULL),
    (2, 1, 'R2', '服务热线', 0.75, NULL), (2, 1, 'R2-model', 'PC-P1HEQ2', 0.85, NULL), (2, 9, 'R2-ambiguous', 'DC15/24V', 0.50, NULL), (2, 2, 'R4', 'YORK', 0.35, NULL), (2, 3, 'R4', '点检模式1', 0.35, 'display'), (2, 5, 'R4', 'ABX 开', 0.35, 'short'),
    (2, 7, 'R4', '二维码', 0.35, NULL), (2, -1, 'R3-qr', NULL, 0.90, NULL), (2, -1, 'R3-qr', NULL, 0.65, NULL), (2, -1, 'R3-icon', NULL, 0.50, NULL), (2, -1, 'R3-icon', NULL, 0.50, NULL),
    (2, -1, 'R5-vision', 'HISENSE', 0.80, NULL), (2, -1, 'R5-vision', 'YCWA15NCWQ', 0.50, NULL), (3, -1, 'R5-vision', '8888', 0.60, 'digits'), (3, -1, 'R1-scope', '上盖顶部', 0.40, NULL)) AS t(drawing, block, rule, name, confidence, exclude_reason)""",
)
def mark_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = marks.exclude_polluted(marks.candidates(*drawings(spark)))
    return found.select(F.col("drawing").cast("int").alias("drawing"), F.col("block").cast("int").alias("block"), "rule", "name", F.col("confidence").cast("decimal(3,2)").alias("confidence"), "exclude_reason")


@query(
    "V2 V18 V19",
    """SELECT * FROM (VALUES (1, 1, 'R1-group', '禁止强电+地暖阀', 'Group', '注：内容以实际生产为准'), (1, 3, 'R1', '服务热线', 'Text', '注：内容以实际生产为准'), (1, -1, 'R1-noloc', 'MAC地址', 'Text', '注：内容以实际生产为准'), (1, -1, 'R1-noloc', '按键', 'Text', '注：内容以实际生产为准'),
    (3, -1, 'R1-scope', '上盖顶部', 'Group', NULL)) AS t(drawing, block, rule, text, type, condition)""",
)
def mark_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses, texts, _, _ = drawings(spark)
    kept = marks.dedupe(marks.candidates(clauses, texts)).where("drawing <> 2")
    out = marks.with_condition(marks.emit_grouped(kept), texts)
    return out.select(F.col("drawing").cast("int").alias("drawing"), F.col("block").cast("int").alias("block"), "rule", "text", "type", "condition")
