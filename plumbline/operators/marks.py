"""Marks out of a drawing's texts: rules that emit candidates, grouping, conditions, deduplication.

Each rule is a frame of candidates; they are unioned in rule order, so a mark knows the rule and the evidence it came
from. R1: an item that a clause declares, at the first text that it occurs in (without one it stays unlocated; a place
instead of a content is a scope); R2: known content in a text; R2-model: model codes of the texts that R1 and R2 found; R3:
images, as codes or icons; R4: on drawings that declare nothing, texts that look like marks, outside the title band; R5:
readings of outlined text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions import text as t

# Confidences of the rules, words of codes and notes, limits for images, and the length of a condition.
CONFIDENCE = {"R1": 0.95, "R2": 0.75, "R2-model": 0.85, "R4": 0.35}
SCOPE, NOT_LOCATED, AMBIGUOUS = 0.40, 0.30, {"R1": 0.55, "R2": 0.50, "R4": 0.30}
CODE_WORDS, CODE_NAME, CODE_FORMAT = ("二维码", "QR", "QRCODE"), "二维码", "格式"
NOTE_WORDS, CONDITION_WORDS = ("注：", "注:", "说明"), ("以实际", "按实际")
NEAR_IMAGE, SQUARE, LEAST_PIXELS = 2.5, (0.75, 1.33), 48
CODE_CONFIDENCE, RASTER_CONFIDENCE, ICON_CONFIDENCE = 0.90, 0.65, 0.50
READ_CONFIDENCE, UNKNOWN_CONFIDENCE = 0.80, 0.5
CONDITION_LENGTH = 60


def declared_items(clauses: DataFrame) -> DataFrame:
    """drawing, item and seq (order of its first mention) of everything that the clauses (drawing, text) declare."""
    sentences = clauses.select("drawing", F.posexplode(t.clause_items(F.col("text"))).alias("__s", "s")).where(p.any_word(F.col("s"), p.PROCESS_WORDS))
    parts = sentences.select("drawing", "__s", t.declared(t.strip_clause_number(F.col("s"))).alias("part")).where("part IS NOT NULL")
    items = parts.select("drawing", "__s", F.posexplode(t.split_items(F.col("part"))).alias("__i", "item"))
    return items.groupBy("drawing", "item").agg(F.min(F.col("__s") * 1000 + F.col("__i")).alias("seq"))


def _level(keyed: DataFrame) -> Column:
    """How key occurs in text (None, Ambiguous, ...); needs their normal forms."""
    return t.contains(F.col("text"), F.col("key"), F.col("__text"), F.col("__key"))


def _marks(df: DataFrame, rule: str, name: Column, confidence: Column, *, text: Column | None = None, kind: str | Column = "Text", seq: str | None = "seq") -> DataFrame:
    block = F.col("block") if "block" in df.columns else F.lit(-1)
    kinds = F.lit(kind) if isinstance(kind, str) else kind
    order = F.col(seq).cast("long") if seq else F.lit(0).cast("long")
    return df.select("drawing", block.cast("long").alias("block"), F.lit(rule).alias("rule"), name.alias("name"), (text if text is not None else F.col("text")).alias("text"), confidence.cast("double").alias("confidence"), kinds.alias("kind"), order.alias("seq"))


def candidates(clauses: DataFrame, texts: DataFrame, images: DataFrame | None = None, readings: DataFrame | None = None) -> DataFrame:
    """drawing, block (-1 without one), rule, name, text, confidence, kind and seq of all rules.

    clauses: drawing, text; texts: drawing, block, text, nx, ny (and cx, cy on the page where there are images); images:
    drawing, image, x, y, w, h (on the page), width, height (pixels); readings: drawing, reading, text, conf. Items, keys
    and blocks meet within their drawing, which has few. A rule that only ambiguous characters satisfy is marked so.
    """
    usable = texts.where((F.coalesce("text", F.lit("")) != "") & ~p.is_revision_note(F.col("text")) & ~p.is_dimension(F.col("text"))).withColumn("__text", t.normalize(F.col("text")))
    declared = declared_items(clauses)
    items = declared.where(~p.any_word(F.col("item"), CODE_WORDS, fold=True))
    scopes = items.where(p.is_location_phrase(F.col("item")))
    none = F.lit(None).cast("string")
    scope = _marks(scopes, "R1-scope", F.col("item"), F.lit(SCOPE), text=none, kind="Group")
    wanted = items.where(~p.is_location_phrase(F.col("item")))
    keyed = wanted.select("drawing", "item", "seq", F.posexplode(t.match_keys(F.col("item"))).alias("__k", "key")).withColumn("__key", t.normalize(F.col("key")))
    hits = keyed.join(usable.select("drawing", "block", "text", "__text"), "drawing")
    hits = hits.withColumn("level", _level(hits)).where("level <> 'None'")
    found = hits.groupBy("drawing", "item", "seq").agg(F.min_by(F.struct("block", "text", "level"), F.struct("__k", "block")).alias("h")).select("drawing", "item", "seq", "h.*")
    vague = F.col("level") == "Ambiguous"
    graded = lambda rule: F.when(vague, AMBIGUOUS[rule]).otherwise(CONFIDENCE[rule])
    r1 = found.select("drawing", F.col("block").cast("long").alias("block"), F.when(vague, "R1-ambiguous").otherwise("R1").alias("rule"), F.col("item").alias("name"), "text", graded("R1").alias("confidence"), F.lit("Text").alias("kind"), F.col("seq").cast("long").alias("seq"))
    missing = wanted.join(found, ["drawing", "item"], "left_anti")
    noloc = _marks(missing, "R1-noloc", F.col("item"), F.lit(NOT_LOCATED), text=none)
    forms = [(k, n, f) for n, (k, words) in enumerate(t.KNOWN_CONTENT.items()) if k != CODE_NAME for f in words]
    known = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(n).alias("seq"), F.lit(i).alias("__k"), F.lit(f).alias("key")) for i, (k, n, f) in enumerate(forms)]))
    spelled = usable.select("drawing", "block", "text", "__text", known.alias("f")).select("drawing", "block", "text", "__text", "f.*").withColumn("__key", t.normalize(F.col("key")))
    spelled = spelled.withColumn("level", _level(spelled)).where("level <> 'None'")
    by_name = spelled.groupBy("drawing", "block", "name", "seq").agg(F.min_by(F.struct("text", "level"), "__k").alias("h")).select("drawing", "block", "name", "seq", "h.*")
    covered = found.select("drawing", "block", F.col("item").alias("name"))
    r2 = by_name.join(covered, ["drawing", "block", "name"], "left_anti")
    r2 = r2.select("drawing", F.col("block").cast("long").alias("block"), F.when(vague, "R2-ambiguous").otherwise("R2").alias("rule"), "name", "text", graded("R2").alias("confidence"), F.lit("Text").alias("kind"), F.col("seq").cast("long").alias("seq"))
    confirmed = r1.unionAll(r2).select("drawing", "block", "text").distinct()
    model = confirmed.select("drawing", "block", "text", F.explode(F.array_distinct(t.model_codes(F.col("text")))).alias("name"))
    model = _marks(model, "R2-model", F.col("name"), F.lit(CONFIDENCE["R2-model"]), seq=None)
    note = p.any_word(F.col("text"), NOTE_WORDS + CONDITION_WORDS) | p.is_format_declaration(F.col("text"))
    plain = usable.where(~p.is_noise(F.col("text")) & p.is_mark_like(F.col("text")) & ~note & ~p.in_title_band(F.col("nx"), F.col("ny")))
    plain = plain.join(declared.select("drawing").distinct(), "drawing", "left_anti").join(r2.select("drawing", "block").distinct(), ["drawing", "block"], "left_anti")
    r4 = _marks(plain, "R4", F.col("text"), F.lit(CONFIDENCE["R4"]), seq="block")
    out = scope.unionAll(r1).unionAll(noloc).unionAll(r2).unionAll(model).unionAll(r4)
    if images is not None:
        out = out.unionAll(image_marks(images, texts))
    if readings is not None:
        read = readings.withColumn("text", F.trim("text")).where("text <> ''")
        conf = F.least(F.when(F.col("conf") > 0, F.col("conf")).otherwise(UNKNOWN_CONFIDENCE), F.lit(READ_CONFIDENCE))
        out = out.unionAll(_marks(read, "R5-vision", F.col("text"), conf, seq="reading"))
    return out


def image_marks(images: DataFrame, texts: DataFrame) -> DataFrame:
    """Codes and icons among a drawing's images: a code if the nearest text with a word for it lies within 2.5 times the
    image's longer side, or if it is a square raster; the example beside a note on the code's format is left out."""
    words = texts.where(p.any_word(F.col("text"), CODE_WORDS, fold=True)).select("drawing", F.col("text").alias("__word"), "cx", "cy", "block")
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    d = F.sqrt((F.col("cx") - cx) ** 2 + (F.col("cy") - cy) ** 2)
    near = images.join(words, "drawing").groupBy("drawing", "image").agg(F.min(F.struct(d.alias("d"), F.col("block").alias("b"), F.col("__word").alias("word"))).alias("n"))
    side = F.greatest("w", "h")
    seen = images.join(near, ["drawing", "image"], "left").withColumn("evidence", F.coalesce((side > 0) & (F.col("n.d") <= side * NEAR_IMAGE), F.lit(False)))
    kept = seen.where(~(F.col("evidence") & F.coalesce(F.col("n.word").contains(CODE_FORMAT), F.lit(False))))
    raster = F.coalesce((F.col("width") / F.col("height")).between(*SQUARE) & (F.least("width", "height") >= LEAST_PIXELS), F.lit(False))
    code = F.col("evidence") | raster
    conf = F.when(F.col("evidence"), CODE_CONFIDENCE).when(raster, RASTER_CONFIDENCE).otherwise(ICON_CONFIDENCE)
    out = _marks(kept, "R3", F.lit(None).cast("string"), conf, text=F.lit(None).cast("string"), kind=F.when(code, "Qr").otherwise("Icon"), seq="image")
    return out.withColumn("rule", F.when(F.col("kind") == "Qr", "R3-qr").otherwise("R3-icon"))


def exclude_polluted(marks: DataFrame) -> DataFrame:
    """marks with excluded and why: only the low-confidence rules' marks can be polluted."""
    reason = F.when(F.col("rule").startswith("R4") | (F.col("rule") == "R5-vision"), p.pollution(F.col("text")))
    return marks.withColumn("exclude_reason", reason).withColumn("excluded", reason.isNotNull())


def emit_grouped(marks: DataFrame) -> DataFrame:
    """Marks of R1, R2 and R4 on one block as one: a group of several, with their names in order joined by + and the least
    confidence; all other marks are leaves of their own."""
    base = F.regexp_replace("rule", "-ambiguous$", "")
    grouped = marks.withColumn("__base", base).where(F.col("__base").isin("R1", "R2", "R4") & (F.col("block") >= 0))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]), "+")
    out = grouped.groupBy("drawing", "block", "__base").agg(names.alias("text"), F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("items"), F.min("rule").alias("rule"))
    many = F.col("items") > 1
    out = out.select("drawing", "block", F.when(many, F.concat("__base", F.lit("-group"))).otherwise(F.col("rule")).alias("rule"), "text", "confidence", "items", F.when(many, "Group").otherwise("Text").alias("type"))
    single = marks.where(~(base.isin("R1", "R2", "R4") & (F.col("block") >= 0))).select("drawing", "block", "rule", F.col("name").alias("text"), "confidence", F.lit(1).cast("long").alias("items"), F.col("kind").alias("type"))
    return out.unionAll(single)


def with_condition(marks: DataFrame, texts: DataFrame) -> DataFrame:
    """marks with the first conditional note of their drawing, cut to 60 characters; null without one."""
    notes = texts.where(p.any_word(F.col("text"), NOTE_WORDS) & p.any_word(F.col("text"), CONDITION_WORDS))
    first = notes.groupBy("drawing").agg(F.min_by(t.clip(F.col("text"), CONDITION_LENGTH), "block").alias("condition"))
    return marks.join(first, "drawing", "left")


def dedupe(marks: DataFrame) -> DataFrame:
    """Of marks with one drawing, name and block, the most confident (the first rule of equal ones); images stay."""
    order = Window.partitionBy("drawing", "name", "block", F.when(F.col("name").isNull(), F.col("seq"))).orderBy(F.desc("confidence"), "rule")
    return marks.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
