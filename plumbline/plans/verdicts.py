"""Verdict queries: events are verdicts of marks on photos, line items are observed marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import verdicts
from .registry import query, table

VERDICTS_SQL = """vd AS (SELECT event_id, user_id AS photo, event_id % 40 AS mark, CASE event_type WHEN 'click' THEN 'Matched' WHEN 'view' THEN 'Matched' WHEN 'purchase' THEN 'LowConfidence' WHEN 'signup' THEN 'NotDetected' ELSE 'Missing' END AS state,
  CASE WHEN event_id % 23 = 0 THEN 'HumanPresent' WHEN event_id % 29 = 0 THEN 'HumanMissing' WHEN event_id % 31 = 0 THEN 'HumanWrongPart' WHEN event_id % 37 = 0 THEN 'HumanUnsure' END AS human, value / 500 AS confidence FROM events)"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, t = F.col("event_id"), F.col("event_type")
    state = F.when(t.isin("click", "view"), "Matched").when(t == "purchase", "LowConfidence").when(t == "signup", "NotDetected").otherwise("Missing")
    human = F.when(e % 23 == 0, "HumanPresent").when(e % 29 == 0, "HumanMissing").when(e % 31 == 0, "HumanWrongPart").when(e % 37 == 0, "HumanUnsure")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("photo"), (e % 40).alias("mark"), state.alias("state"), human.alias("human"), (F.col("value") / 500).alias("confidence"))


@query(
    "V7 AG11",
    f"""WITH {VERDICTS_SQL}, s AS (SELECT photo, mark, list(DISTINCT state) AS s, list(DISTINCT human) FILTER (human IS NOT NULL) AS h FROM vd GROUP BY photo, mark)
    SELECT photo, mark, CASE WHEN h IS NOT NULL THEN CASE WHEN list_contains(h, 'HumanMissing') THEN 'Missing' WHEN list_contains(h, 'HumanWrongPart') THEN 'Wrong' WHEN h = ['HumanPresent'] THEN 'Matched' ELSE 'NeedReview' END
      WHEN s = ['Matched'] THEN 'Matched' WHEN list_has_any(s, ['Missing', 'NotComparable']) THEN 'Missing' WHEN list_contains(s, 'LowConfidence') THEN 'LowConfidence' WHEN list_contains(s, 'NotDetected') THEN 'NotDetected' ELSE 'NeedReview' END AS state FROM s""",
)
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.rollup(rows(spark, sf_dir), ["photo", "mark"])


@query(
    "AG12 V18",
    f"""WITH {VERDICTS_SQL} SELECT photo, CASE WHEN bool_and(state = 'Matched') THEN 'Matched' WHEN bool_or(state = 'NotComparable') THEN 'NotComparable' WHEN bool_or(state = 'Missing') THEN 'Missing' WHEN bool_or(state = 'ProcessingError') THEN 'ProcessingError'
    WHEN bool_or(state = 'NotDetected') THEN 'NotDetected' ELSE 'LowConfidence' END AS state, min(confidence) AS confidence, count(*) AS children FROM vd GROUP BY photo""",
)
def group_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.group_state(rows(spark, sf_dir), "photo")


@query("AG10", f"WITH {VERDICTS_SQL} SELECT mark, state, count(*) AS n FROM vd GROUP BY mark, state")
def state_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.state_histogram(rows(spark, sf_dir), ["mark"])


@query(
    "JN6 JN7 V13 WN4",
    f"""WITH {VERDICTS_SQL}, r AS (SELECT photo, mark, arg_max(human, event_id) AS human FROM vd WHERE human IS NOT NULL GROUP BY photo, mark)
    SELECT event_id, state, r.human, CASE WHEN r.human IS NULL THEN NULL WHEN r.human = 'HumanPresent' THEN state IN ('Matched', 'Extra') WHEN r.human = 'HumanMissing' THEN state = 'Missing' WHEN r.human = 'HumanWrongPart' THEN state IN ('NotDetected', 'NotComparable') ELSE false END AS agreed
    FROM vd LEFT JOIN r USING (photo, mark)""",
)
def review_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verdict with the newest review of its mark, and whether both agree."""
    v = rows(spark, sf_dir)
    reviews = v.where("human IS NOT NULL").withColumn("mark_key", F.col("mark").cast("string"))
    last = verdicts.latest_reviews(reviews, ["photo", "mark"], ["event_id"])
    return verdicts.overlay(v.drop("human"), last, ["photo", "mark"]).select("event_id", "state", "human", "agreed")


OBSERVED_SQL = """ob AS (SELECT l_orderkey, l_linenumber, l_extendedprice, CASE l_returnflag WHEN 'A' THEN 'Text' WHEN 'N' THEN 'Qr' ELSE 'Icon' END AS type, (l_partkey % 4)::INT AS rank, CASE WHEN l_partkey % 5 > 0 THEN l_discount * 2 END AS off, 0.1::DOUBLE AS tol,
  l_suppkey % 3 = 0 AS near, l_suppkey % 4 = 0 AS blind, l_linenumber % 4 > 0 AS any_text, l_quantity > 10 AS readable, l_partkey % 3 = 0 AS found, l_tax * 4 AS nearest, CASE WHEN l_partkey % 2 = 0 THEN l_tax * 4 + l_discount END AS second, l_suppkey % 5 > 0 AS trusted,
  l_suppkey % 2 = 0 AS any_code, l_quantity < 5 AS degraded, l_discount / 2 AS ink, l_quantity = 50 AS excluded, l_quantity < 49 AS required, l_linenumber < 7 AS usable, l_suppkey % 11 > 0 AS region, CASE WHEN l_partkey % 7 > 0 THEN l_partkey % 2 = 0 END AS covered, l_tax * 10 AS mark_confidence FROM lineitem),
  s1 AS (SELECT *, CASE WHEN excluded OR NOT required THEN 'NotApplicable' WHEN NOT usable OR NOT region THEN 'NotComparable'
    WHEN type = 'Text' THEN CASE WHEN NOT any_text THEN CASE WHEN blind THEN 'LowConfidence' WHEN readable THEN 'NotDetected' ELSE 'Missing' END WHEN rank >= 2 AND (off IS NULL OR off <= tol) THEN 'Matched' WHEN rank >= 1 OR near THEN 'LowConfidence' ELSE 'Missing' END
    WHEN type = 'Qr' THEN CASE WHEN found THEN CASE WHEN off IS NULL OR off <= tol * 2 THEN 'Matched' ELSE 'LowConfidence' END WHEN nearest <= tol * 2 THEN CASE WHEN second IS NULL OR CASE WHEN second > 1e-9 THEN nearest / second ELSE 0 END <= 0.60 THEN 'Matched' ELSE 'LowConfidence' END
      WHEN NOT trusted AND any_code THEN 'LowConfidence' WHEN degraded THEN 'NotComparable' ELSE 'LowConfidence' END
    ELSE CASE WHEN NOT trusted THEN 'LowConfidence' WHEN ink >= 0.02 THEN 'Matched' ELSE 'Missing' END END AS s FROM ob),
  s2 AS (SELECT *, CASE WHEN covered IS NOT NULL AND NOT covered AND s IN ('Missing', 'NotDetected') THEN 'NotApplicable' ELSE s END AS state,
    CASE type WHEN 'Text' THEN [0.60, 0.45, 0.85, 0.95][rank + 1] WHEN 'Qr' THEN CASE WHEN found THEN 0.90 ELSE 0.60 END ELSE 0.70 END::DOUBLE AS base FROM s1),
  s3 AS (SELECT *, CASE s WHEN 'Matched' THEN base WHEN 'NotApplicable' THEN 1.0 WHEN 'LowConfidence' THEN least(base, 0.55) WHEN 'NotDetected' THEN least(base, 0.30) WHEN 'Missing' THEN least(base, 0.70) WHEN 'NotComparable' THEN least(base, 0.10) ELSE 0 END
    * CASE WHEN off IS NOT NULL AND s IN ('Matched', 'LowConfidence') THEN least(greatest(1 - least(1, off / (2 * tol)), 0.5), 1) ELSE 1 END * CASE WHEN trusted THEN 1 ELSE 0.70 END * CASE WHEN degraded AND type = 'Qr' THEN 0.85 ELSE 1 END * CASE WHEN blind AND NOT any_text THEN 0.80 ELSE 1 END
    * CASE WHEN mark_confidence > 0 THEN 0.85 + 0.15 * least(greatest(mark_confidence, 0), 1) ELSE 1 END AS c FROM s2)"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    kind = F.when(c("l_returnflag") == "A", "Text").when(c("l_returnflag") == "N", "Qr").otherwise("Icon")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", kind.alias("type"), (c("l_partkey") % 4).cast("int").alias("rank"), F.when(c("l_partkey") % 5 > 0, c("l_discount") * 2).alias("off"), F.lit(0.1).alias("tol"),
        (c("l_suppkey") % 3 == 0).alias("near"), (c("l_suppkey") % 4 == 0).alias("blind"), (c("l_linenumber") % 4 > 0).alias("any_text"), (c("l_quantity") > 10).alias("readable"), (c("l_partkey") % 3 == 0).alias("found"),
        (c("l_tax") * 4).alias("nearest"), F.when(c("l_partkey") % 2 == 0, c("l_tax") * 4 + c("l_discount")).alias("second"), (c("l_suppkey") % 5 > 0).alias("trusted"), (c("l_suppkey") % 2 == 0).alias("any_code"), (c("l_quantity") < 5).alias("degraded"),
        (c("l_discount") / 2).alias("ink"), (c("l_quantity") == 50).alias("excluded"), (c("l_quantity") < 49).alias("required"), (c("l_linenumber") < 7).alias("usable"), (c("l_suppkey") % 11 > 0).alias("region"),
        F.when(c("l_partkey") % 7 > 0, c("l_partkey") % 2 == 0).alias("covered"), (c("l_tax") * 10).alias("mark_confidence"),
    )


@query("V9 V11 GE13", f"WITH {OBSERVED_SQL} SELECT l_orderkey, l_linenumber, l_extendedprice, type, state, floor(CASE WHEN state = 'NotApplicable' THEN 1.0 ELSE round(least(greatest(c, 0), 1), 4) END * 10 + 1e-6)::BIGINT AS tenths FROM s3")
def verify_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision tree and the confidence model (in tenths) over every observed mark."""
    judged = verdicts.verify(observed(spark, sf_dir))
    return judged.select("l_orderkey", "l_linenumber", "l_extendedprice", "type", "state", F.floor(F.col("confidence") * 10 + 1e-6).alias("tenths"))


@query("V11", "SELECT event_id, (event_id % 83) / 64.0::DOUBLE + 0.0625 BETWEEN 0.1875 - 0.06::DOUBLE AND 0.1875 + 0.3125 + 0.06::DOUBLE AND (event_id % 79) / 64.0::DOUBLE + 0.0625 BETWEEN 0.3125 - 0.06::DOUBLE AND 0.3125 + 0.25 + 0.06::DOUBLE AS covered FROM events")
def part_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes at multiples of 1/64, which are exact, against a subject."""
    e = F.col("event_id")
    box = g.Box((e % 83) / 64.0, (e % 79) / 64.0, F.lit(0.125), F.lit(0.125))
    return table(spark, sf_dir, "events").select("event_id", verdicts.covered(box, g.Box(*map(F.lit, (0.1875, 0.3125, 0.3125, 0.25)))).alias("covered"))


@query("V9 JN17")
def code_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code marks (every third event of a user) and the codes (the others) that they take; what one takes no other can."""
    e = F.col("event_id")
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("photo"), "event_id", ((e % 83) / 83.0).alias("x"), ((e % 79) / 79.0).alias("y"))
    marks = p.where("event_id % 3 = 0").select("photo", e.alias("mark"), F.col("x").alias("ex"), F.col("y").alias("ey"), F.lit(0.03).alias("tol"), (e % 5 == 0).alias("found"), (e % 2 == 0).alias("trusted"))
    return verdicts.claim_codes(marks, p.where("event_id % 3 > 0").select("photo", e.alias("code"), F.col("x").alias("cx"), F.col("y").alias("cy")), "photo")


@query(
    "V10",
    """WITH p AS (SELECT event_id, user_id, (event_id % 83) / 100.0::DOUBLE AS cx, (event_id % 79) / 100.0::DOUBLE AS cy, event_id % 2 AS side FROM events)
    SELECT a.event_id, 'Extra' AS state, 0.40::DOUBLE AS confidence FROM p AS a WHERE side = 0 AND NOT EXISTS (SELECT 1 FROM p AS m WHERE m.side = 1 AND m.user_id = a.user_id AND sqrt((a.cx - m.cx) ** 2 + (a.cy - m.cy) ** 2) <= 0.2)""",
)
def undeclared_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    p = table(spark, sf_dir, "events").select("event_id", "user_id", ((e % 83) / 100.0).alias("cx"), ((e % 79) / 100.0).alias("cy"), (e % 2).alias("side"))
    return verdicts.undeclared_codes(p.where("side = 0"), p.where("side = 1"), "user_id").select("event_id", "state", "confidence")


@query(
    "V12",
    """WITH p AS (SELECT event_id, user_id, (event_id % 83) / 100.0::DOUBLE AS ex, (event_id % 79) / 100.0::DOUBLE AS ey, (event_id % 83) / 100.0::DOUBLE + 0.05 + value / 5000 AS ox, (event_id % 79) / 100.0::DOUBLE - 0.03 AS oy, CASE WHEN event_type = 'click' THEN 'Missing' ELSE 'LowConfidence' END AS state FROM events),
    m AS (SELECT user_id, median(ox - ex) AS mx, median(oy - ey) AS my FROM p GROUP BY user_id), o AS (SELECT user_id, avg(ox - ex) AS dx, avg(oy - ey) AS dy FROM p JOIN m USING (user_id) WHERE sqrt((ox - ex - mx) ** 2 + (oy - ey - my) ** 2) <= 0.25 GROUP BY user_id HAVING count(*) >= 2)
    SELECT event_id, CASE WHEN state = 'LowConfidence' AND sqrt((ex + dx - ox) ** 2 + (ey + dy - oy) ** 2) <= 0.02 THEN 'Matched' ELSE state END AS state FROM p LEFT JOIN o USING (user_id)""",
)
def realigned_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks that the photo's common offset explains are matched after all."""
    from ..operators.geometry import consensus

    e = F.col("event_id")
    x, y = (e % 83) / 100.0, (e % 79) / 100.0
    state = F.when(F.col("event_type") == "click", "Missing").otherwise("LowConfidence")
    p = table(spark, sf_dir, "events").select("event_id", "user_id", x.alias("ex"), y.alias("ey"), (x + 0.05 + F.col("value") / 5000).alias("ox"), (y - 0.03).alias("oy"), state.alias("state"))
    offsets = consensus(p.select("user_id", (F.col("ox") - F.col("ex")).alias("dx"), (F.col("oy") - F.col("ey")).alias("dy")), "user_id")
    return verdicts.realign(p, offsets, "user_id", 0.02).select("event_id", "state")
