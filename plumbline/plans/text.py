"""Text queries: keys and rules over names, conversations, benchmark texts, and literal drawing texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions import text as t
from .registry import query, table

SAMPLES = (
    "服务热线：4008601111", "MAC:A42985377FA0", "LOW VOLTAGE禁止强电", "12±0.5", "1:1", "88", "PC-P1HEQ2", "C-XXXX-XXXX", "市 场 部", "更改MAC地址打标A/22", "增加上盖镭雕", "24.03.18", "√", "JT-010-F-9",
    "YCWA15NCWQ", "4008601111", "QHSGK", "8888", "点检模式冲突", "二维码格式：", "为二维码，生产规则为设备ID", "(2.6)", "(400-620-6607)", "200512", "1250001", "83. 2", "RK+n 2", "GD", "开/关", "02-HYXC-VH01GZ",
    "上盖顶部", "按键丝印", "Ø12", "R5", "90°", "YORK", "Q", "", "注意事项", "版本：", "内容以实际生产为准", "地暖阀",
)


def samples(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"({k}, '{s}')" for k, s in enumerate(SAMPLES))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(id, s)")


def expected(rows: dict[str, tuple]) -> str:
    """SQL with the results that the rules give, worked out by hand from their definitions."""
    values = ", ".join("(" + ", ".join(["'" + s + "'", *("NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" for v in r)]) + ")" for s, r in rows.items())
    return values


TEXTS_SQL = "x AS (SELECT p_partkey AS id, p_name AS s FROM part UNION ALL SELECT c_custkey + 10000000, c_name FROM customer UNION ALL SELECT item_id + 20000000, text FROM benchmark)"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("s"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey") + 10000000, "c_name")
    return part.unionAll(customer).unionAll(table(spark, sf_dir, "benchmark").select(F.col("item_id") + 20000000, "text"))


@query(
    "SF1 SF2 SF3",
    f"""WITH {TEXTS_SQL}, n AS (SELECT id, upper(replace(regexp_replace(s, '\\s', '', 'g'), 'ß', '\u0001')) AS n FROM x), k AS (SELECT id, replace(n, '\u0001', 'ß') AS normal, regexp_replace(n, '[^A-Z0-9]', '', 'g') AS loose FROM n)
    SELECT id, normal, loose, translate(loose, 'OILBSZG', '0118526') AS ambiguous FROM k""",
)
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir).withColumn("normal", t.normalize(F.col("s"))).withColumn("loose", t.loose_key(F.col("normal")))
    return rows.select("id", "normal", "loose", t.ambiguous_key(F.col("loose")).alias("ambiguous"))


@query(
    "SF4 SF5 SF6 SF7 SF23 SF24",
    f"""WITH {TEXTS_SQL} SELECT id, regexp_replace(lower(s), '[^\\p{{L}}\\p{{Nd}}]', '', 'g') AS clean, regexp_replace(lower(s), '[^0-9a-z]', '', 'g') AS name_key,
    regexp_replace(lower(s), '[\\s\\-_.,:;()\\[\\]/\\\\|''"]', '', 'g') AS comparable, regexp_replace(lower(s), '[^0-9a-z\\x{{4E00}}-\\x{{9FFF}}]', '', 'g') AS core,
    regexp_replace(s, '\\s', '', 'g') AS no_space, lower(regexp_replace(s, '\\s', '', 'g')) AS model, replace(replace(replace(upper(replace(s, 'ß', 'SS')), ' ', ''), '_', ''), '-', '') AS etl FROM x""",
)
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    forms = {"clean": t.clean, "name_key": t.name_key, "comparable": t.comparable, "core": t.core, "no_space": t.no_space, "etl": t.etl_key}
    return texts(spark, sf_dir).select("id", *(f(s).alias(k) for k, f in forms.items()), F.lower(t.no_space(s)).alias("model"))


LADDER = {"PC-P1HEQ2|PC-P1HEQ2": "Exact", "pc p1heq2|PC-P1HEQ2": "Normalized", "PC-P1HEQ2|PC-PIHEQ2": "Ambiguous", "ＭＡＣ地址|MAC地址": "Normalized", "A|B": "None", "| ": "None", "QHSGK|QH5GK": "Ambiguous", "-|_": "None"}
CONTAINS = {"LOW VOLTAGE禁止强电|禁止强电": "Exact", "low voltage|LOWVOLTAGE": "Normalized", "MAC:A42985377FA0|A4298537": "Exact", "P1HEQ2 X|PIHEQ2": "Ambiguous", "abc|": "None", "abc|d": "None"}


def _pairs(spark: SparkSession, pairs: dict[str, str]) -> DataFrame:
    values = ", ".join("('{}', '{}')".format(*k.split("|")) for k in pairs)
    rows = spark.sql(f"SELECT * FROM VALUES {values} AS t(a, b)")
    return rows.withColumn("na", t.normalize(F.col("a"))).withColumn("nb", t.normalize(F.col("b")))


@query("SF8", "SELECT * FROM (VALUES {}) AS t(a, b, level)".format(", ".join("('{}', '{}', '{}')".format(*k.split("|"), v) for k, v in LADDER.items())))
def compare_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, LADDER)
    return rows.select("a", "b", t.compare(*(F.col(c) for c in ("a", "b", "na", "nb"))).alias("level"))


@query("SF9", "SELECT * FROM (VALUES {}) AS t(a, b, level)".format(", ".join("('{}', '{}', '{}')".format(*k.split("|"), v) for k, v in CONTAINS.items())))
def contains_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, CONTAINS)
    return rows.select("a", "b", t.contains(*(F.col(c) for c in ("a", "b", "na", "nb"))).alias("level"))


RULES = {
    "dimension": (p.is_dimension, ("12±0.5", "1:1", "88", "24.03.18", "4008601111", "8888", "(2.6)", "(400-620-6607)", "200512", "1250001", "R5", "90°", "JT-010-F-9")),
    "revision": (p.is_revision_note, ("更改MAC地址打标A/22", "增加上盖镭雕")),
    "serial": (p.is_serial_like, ("12±0.5", "24.03.18", "4008601111", "(400-620-6607)", "200512", "1250001", "83. 2", "MAC:A42985377FA0")),
    "model_code": (p.is_model_code_like, ("MAC:A42985377FA0", "PC-P1HEQ2", "JT-010-F-9", "YCWA15NCWQ", "02-HYXC-VH01GZ", "更改MAC地址打标A/22", "服务热线：4008601111")),
    "location": (p.is_location_phrase, ("增加上盖镭雕", "上盖顶部", "按键丝印")),
    "label": (p.is_label, ("服务热线：4008601111", "二维码格式：", "为二维码，生产规则为设备ID", "更改MAC地址打标A/22", "版本：")),
    "conditional": (lambda s: s.contains("以实际") | s.contains("按实际"), ("内容以实际生产为准",)),
    "qr_word": (lambda s: p.any_word(s, ("二维码", "QR", "QRCODE"), fold=True), ("二维码格式：", "为二维码，生产规则为设备ID")),
}


@query(
    "FLT9 FLT10 FLT11 FLT13 FLT14 SF18",
    "SELECT * FROM (VALUES {}) AS t(rule, s)".format(", ".join(f"('{rule}', '{s}')" for rule, (_, hits) in RULES.items() for s in hits)),
)
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sample texts each rule holds for."""
    rows = samples(spark).withColumn("rules", F.array_compact(F.array(*[F.when(F.coalesce(rule(F.col("s")), F.lit(False)), F.lit(name)) for name, (rule, _) in RULES.items()])))
    return rows.select(F.explode("rules").alias("rule"), "s")


#: What the rules say of every sample, worked out by hand: the samples that aren't plain text, that are no valid reading, that are polluted.
CLASSES = {"12±0.5": "dim", "88": "meta", "24.03.18": "meta", "4008601111": "meta", "8888": "dim", "(2.6)": "dim", "200512": "dim", "1250001": "meta", "83. 2": "dim", "Ø12": "dim", "R5": "dim", "90°": "dim", "增加上盖镭雕": "note", "按键丝印": "note", "注意事项": "note", "内容以实际生产为准": "note"}
INVALID = ("1:1", "88", "√", "RK+n 2", "GD", "Ø12", "R5", "90°", "Q", "")
POLLUTED = {"二维码格式：": "format", "为二维码，生产规则为设备ID": "prose", "内容以实际生产为准": "prose", "点检模式冲突": "display", "8888": "digits", "开/关": "short"}


@query("SF19 FLT9", "SELECT * FROM (VALUES {}) AS t(s, class)".format(", ".join(f"('{s}', '{CLASSES.get(s, 'text')}')" for s in SAMPLES)))
def text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark).select("s", p.classify(F.col("s")).alias("class"))


@query("SF20", "SELECT unnest([{}]) AS s".format(", ".join(f"'{s}'" for s in SAMPLES if s not in INVALID)))
def valid_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark).where(p.is_valid_reading(F.col("s"))).select("s")


@query("FLT9 V3", "SELECT * FROM (VALUES {}) AS t(s, reason)".format(", ".join("('{}', {})".format(s, f"'{POLLUTED[s]}'" if s in POLLUTED else "NULL") for s in SAMPLES)))
def pollution_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark).select("s", p.pollution(F.col("s")).alias("reason"))


@query("FLT12 FLT15", "SELECT event_id, (x > 0.88 OR y > 0.90) AS title_band, array_to_string(list_filter([CASE WHEN value < 64 THEN 'small' END, CASE WHEN value < 100 AND event_id % 3 < 2 THEN 'blur' END], lambda r: r IS NOT NULL), ',') AS reasons FROM (SELECT event_id, value, (event_id % 100) / 100.0 AS x, (event_id % 97) / 97.0 AS y FROM events)")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title band by position, and why a photo is unusable (here side and sharpness from the value)."""
    e = table(spark, sf_dir, "events")
    x, y = (F.col("event_id") % 100) / 100.0, (F.col("event_id") % 97) / 97.0
    read = F.when(F.col("event_id") % 3 == 2, F.lit(3)).otherwise(F.lit(0))
    reasons = p.quality_reasons(F.col("value") * 10, F.col("value"), F.lit(0.5), F.lit(0.5), F.lit(100), read)
    return e.select("event_id", p.in_title_band(x, y).alias("title_band"), F.array_join(reasons, ",").alias("reasons"))


@query("SF10", "SELECT c_custkey, s_suppkey, levenshtein(c_name, s_name)::INT AS distance FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 10 = s_suppkey % 10")
def edit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    near = (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("c_custkey") % 10 == F.col("s_suppkey") % 10)
    return c.join(s, near).select("c_custkey", "s_suppkey", F.levenshtein("c_name", "s_name").alias("distance"))


@query("SF11 SF22", "SELECT item_id, CASE WHEN length(text) <= 60 THEN text ELSE substr(text, 1, 59) || '…' END AS short, (length(text) - length(replace(text, ' ', ''))) >= 20 AS spaced FROM (SELECT item_id, trim(text) AS text FROM benchmark)")
def clipped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", t.clip(text, 60).alias("short"), t.placeholders(F.translate(F.trim(text), " ", "口")).isNotNull().alias("x"), (F.length(F.trim(text)) - F.length(F.replace(F.trim(text), F.lit(" "), F.lit(""))) >= 20).alias("spaced")).drop("x")


CLAUSE = "技术要求:1、最终成品不可有变形现象,2、未标注的公差按GB/T 1804-M.3、MAC地址、服务热线、按键和禁止强电、地暖阀处均使用激光打标，灰色效果。"


@query("SF12 SF13", "SELECT * FROM (VALUES ('MAC地址', 'MAC地址,MAC'), ('服务热线', '服务热线,热线,HOTLINE'), ('按键', '按键'), ('禁止强电', '禁止强电,LOWVOLTAGE,LOW VOLTAGE,禁止接入强电,POWERLINEISFORBIDDEN'), ('地暖阀', '地暖阀')) AS t(item, keys)")
def clause_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that a clause declares, each with the texts it may appear as."""
    items = spark.sql(f"SELECT '{CLAUSE}' AS clause").select(F.explode(t.clause_items(F.col("clause"))).alias("sentence"))
    parts = items.select(t.declared(t.strip_clause_number(F.col("sentence"))).alias("part")).where("part IS NOT NULL")
    return parts.select(F.explode(t.split_items(F.col("part"))).alias("item")).select("item", F.array_join(t.match_keys(F.col("item")), ",").alias("keys"))


@query("SF14 SF17 SF18", "SELECT * FROM (VALUES ('PC-P1HEQ2 上盖 x', 'PC-P1HEQ2', '上盖', 'TopCover'), ('ab-cd12-ef 侧面接线', 'AB-CD12-EF', '侧面', 'Side'), ('A-1', '', NULL, 'Unspecified')) AS t(s, codes, word, view)")
def codes_and_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql("SELECT * FROM VALUES ('PC-P1HEQ2 上盖 x'), ('ab-cd12-ef 侧面接线'), ('A-1') AS t(s)").withColumn("word", t.view_word(F.col("s")))
    return rows.select("s", F.array_join(t.model_codes(F.col("s")), ",").alias("codes"), "word", t.view_of(F.col("word")).alias("view"))


@query(
    "SF15 SF16",
    """SELECT * FROM (VALUES ('1102040009 包装箱 大号', '1102040009', '包装箱 大号', true), ('1102040009213050206 包装箱', '1102040009', '包装箱', true), ('子件名称：螺丝 M3', '', '螺丝 M3', true), ('2026-03-14', '', '', false),
    ('经手人：张三', '', '', false), ('1102040009 215010116 垫片', '1102040009', '垫片', true), ('12345678901', '', '', false)) AS t(s, code, info, meaningful)""",
)
def material_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql("SELECT * FROM VALUES ('1102040009 包装箱 大号'), ('1102040009213050206 包装箱'), ('子件名称：螺丝 M3'), ('2026-03-14'), ('经手人：张三'), ('1102040009 215010116 垫片'), ('12345678901') AS t(s)")
    info = t.strip_designator(t.clean_info(F.col("s")))
    return rows.select("s", t.item_code(F.col("s")).alias("code"), info.alias("info"), t.meaningful_info(info).alias("meaningful"))


@query(
    "SF21 WN10",
    """WITH g AS (SELECT p_brand, list(p_name ORDER BY p_partkey) AS names FROM part GROUP BY p_brand),
    c AS (SELECT p_brand, list_transform(names, lambda n: CASE WHEN length(n) <= 40 THEN n ELSE substr(n, 1, 39) || '…' END) AS names FROM g),
    k AS (SELECT p_brand, names, len(list_filter(range(1, len(names) + 1), lambda i: length(array_to_string(names[1:i], '｜')) <= 112)) AS n FROM c)
    SELECT p_brand, array_to_string(names[1:n], '｜') AS name FROM k""",
)
def block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a group joined in order within a budget."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"])
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(names.alias("names")).select("p_brand", t.build_name(F.col("names")).alias("name"))


@query("V14", "SELECT * FROM (VALUES (1, 'Nameplate'), (2, 'TopView'), (3, 'QrFace'), (4, 'Back'), (5, 'Front'), (6, 'Side'), (7, 'Unspecified'), (8, 'PcbBoard')) AS t(id, hint)")
def view_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(
        """SELECT * FROM VALUES (1, array('服务热线 400'), 1.0D, 3.0D, 0, 10), (2, array('上盖'), 1.0D, 9.0D, 0, 10), (3, CAST(array() AS array<string>), 1.0D, 3.0D, 2, 10), (4, array('low voltage'), 1.0D, 9.0D, 0, 1),
        (5, array('x'), 1.0D, 9.0D, 0, 1), (6, array('x'), 0.2D, 9.0D, 0, 1), (7, array('x'), 1.0D, 2.0D, 0, 1), (8, array('R12', 'C204 555'), 1.0D, 2.0D, 0, 300) AS t(id, texts, ratio, area, images, drawings)"""
    )
    return rows.select("id", p.view_hint(*(F.col(c) for c in ("texts", "ratio", "area", "images", "drawings"))).alias("hint"))
