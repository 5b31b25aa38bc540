"""Verdicts: the decision tree of a mark, roll-ups over photos and groups, overlays and agreement with people."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

# Limits of the decision tree.
ICON_INK, CODE_RATIO, SUBJECT_MARGIN, EXTRA_CONFIDENCE = 0.02, 0.60, 0.06, 0.40
AGREES = {"HumanPresent": ("Matched", "Extra"), "HumanMissing": ("Missing",), "HumanWrongPart": ("NotDetected", "NotComparable")}


def rollup(verdicts: DataFrame, by: list[str], state: str = "state", human: str = "human") -> DataFrame:
    """One state for each mark over all its photos: people first, then the system's states by priority."""
    s, h = F.collect_set(state), F.collect_set(human)
    sets = verdicts.groupBy(*by).agg(s.alias("s"), h.alias("h"))

    def any_of(c: str, *names: str) -> Column:
        return F.arrays_overlap(F.col(c), F.array(*map(F.lit, names)))

    def only(c: str, name: str) -> Column:
        return (F.size(c) == 1) & F.array_contains(c, name)

    people = F.when(any_of("h", "HumanMissing"), "Missing").when(any_of("h", "HumanWrongPart"), "Wrong").when(only("h", "HumanPresent"), "Matched").otherwise("NeedReview")
    system = (
        F.when(F.size("s") == 0, "Unknown")
        .when(only("s", "Matched"), "Matched")
        .when(any_of("s", "Missing", "NotComparable"), "Missing")
        .when(any_of("s", "LowConfidence"), "LowConfidence")
        .when(any_of("s", "NotDetected"), "NotDetected")
        .otherwise("NeedReview")
    )
    return sets.select(*by, F.when(F.size("h") > 0, people).otherwise(system).alias("state"))


def group_state(children: DataFrame, group: str) -> DataFrame:
    """The state of a group from its children's, their least confidence, and how many there are."""
    has = lambda s: F.bool_or(F.col("state") == s)
    state = F.when(F.bool_and(F.col("state") == "Matched"), "Matched")
    for s in ("NotComparable", "Missing", "ProcessingError", "NotDetected"):
        state = state.when(has(s), s)
    return children.groupBy(group).agg(state.otherwise("LowConfidence").alias("state"), F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("children"))


def state_histogram(verdicts: DataFrame, by: list[str]) -> DataFrame:
    return verdicts.groupBy(*by, "state").agg(F.count(F.lit(1)).alias("n"))


def latest_reviews(reviews: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest review of each key; marks that nobody declared (extra#) have no memory."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return reviews.where(~F.col("mark_key").startswith("extra#")).withColumn("__r", last).where("__r = 1").drop("__r")


def overlay(verdicts: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """verdicts with what people said, and whether the system agrees (null without a review)."""
    joined = verdicts.join(reviews.select(*keys, "human"), keys, "left")
    return joined.withColumn("agreed", agrees(F.col("human"), F.col("state")))


def agrees(human: Column, state: Column) -> Column:
    agreed = F.when(human.isNull(), F.lit(None).cast("boolean"))
    for k, states in AGREES.items():
        agreed = agreed.when(human == k, state.isin(*states))
    return agreed.otherwise(False)


def text_state(rank: Column, off: Column, tol: Column, near: Column, blind: Column, any_text: Column, readable: Column) -> Column:
    """State of a text mark: rank 3 exact, 2 normalised, 1 ambiguous, 0 no match in its region; near and blind are what
    the whole photo shows of it (a near reading, a match)."""
    none_read = F.when(blind, "LowConfidence").when(readable, "NotDetected").otherwise("Missing")
    read = (
        F.when((rank >= 2) & (off.isNull() | (off <= tol)), "Matched")
        .when(rank >= 1, "LowConfidence")
        .when(near, "LowConfidence")
        .otherwise("Missing")
    )
    return F.when(~any_text, none_read).otherwise(read)


def code_state(found: Column, off: Column, tol: Column, nearest: Column, second: Column, trusted: Column, any_code: Column, degraded: Column) -> Column:
    """State of a code mark: found where it is expected, else the nearest unclaimed code of the photo."""
    clear = second.isNull() | (F.when(second > 1e-9, nearest / second).otherwise(0.0) <= CODE_RATIO)
    return (
        F.when(found, F.when(off.isNull() | (off <= tol * 2), "Matched").otherwise("LowConfidence"))
        .when(nearest <= tol * 2, F.when(clear, "Matched").otherwise("LowConfidence"))
        .when(~trusted & any_code, "LowConfidence")
        .when(degraded, "NotComparable")
        .otherwise("LowConfidence")
    )


def icon_state(ink: Column, trusted: Column) -> Column:
    """State of an icon mark: only whether there is ink, and only where the place can be trusted."""
    return F.when(~trusted, "LowConfidence").when(F.coalesce(ink, F.lit(0.0)) >= ICON_INK, "Matched").otherwise("Missing")


def verify(rows: DataFrame) -> DataFrame:
    """rows (one for each mark and photo, with what was observed) with state and confidence.

    Excluded and optional marks don't apply; without a usable photo or a region there is no comparison; then text, code
    and icon marks have their own rules. What is missing outside the photographed part doesn't apply either.
    """
    c = F.col
    by_type = (
        F.when(c("type") == "Text", text_state(c("rank"), c("off"), c("tol"), c("near"), c("blind"), c("any_text"), c("readable")))
        .when(c("type") == "Qr", code_state(c("found"), c("off"), c("tol"), c("nearest"), c("second"), c("trusted"), c("any_code"), c("degraded")))
        .when(c("type") == "Icon", icon_state(c("ink"), c("trusted")))
        .otherwise("ProcessingError")
    )
    state = F.when(c("excluded") | ~c("required"), "NotApplicable").when(~c("usable") | ~c("region"), "NotComparable").otherwise(by_type)
    out = rows.withColumn("__state", state)
    uncovered = c("covered").isNotNull() & ~c("covered") & c("__state").isin("Missing", "NotDetected")
    level = F.when(c("type") == "Text", F.element_at(F.array(*map(F.lit, ("None", "Ambiguous", "Normalized", "Exact"))), c("rank") + 1)).when(c("type") == "Qr", F.when(c("found"), "Qr").otherwise("QrBlind")).otherwise("Icon")
    out = out.withColumn("state", F.when(uncovered, "NotApplicable").otherwise(c("__state")))
    conf = g.confidence(level, c("__state"), c("off"), c("tol"), c("trusted"), c("degraded") & (c("type") == "Qr"), c("blind") & ~c("any_text"), c("mark_confidence"))
    return out.withColumn("confidence", F.when(c("state") == "NotApplicable", 1.0).otherwise(conf)).drop("__state")


def covered(box: g.Box, subject: g.Box) -> Column:
    """Whether a box's centre lies in the photographed subject with its margin."""
    x, y = box.centre
    m = SUBJECT_MARGIN
    return x.between(subject.x - m, subject.x + subject.w + m) & y.between(subject.y - m, subject.y + subject.h + m)


def claim_codes(marks: DataFrame, codes: DataFrame, photo: str) -> DataFrame:
    """photo, mark, code, nearest, second and any_code: which code of its photo each code mark takes.

    marks: photo, mark, ex, ey (where it is expected), tol, found (decoded in place: such a mark takes none), trusted;
    codes: photo, code, cx, cy. In the order of marks, one takes the nearest code within twice its tolerance that is still
    free; second is the distance of the next free one. A mark without any takes the first free code if its place isn't
    trusted, which only says that there is one (any_code). What one takes no other can, so a photo's marks, which are few,
    are one step.
    """
    kinds = dict(marks.dtypes) | {"code": dict(codes.dtypes)["code"]}

    def step(own: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        free = {r.code: (r.cx, r.cy) for r in seen.sort_values("code").itertuples()}
        out = []
        for m in own.sort_values("mark").itertuples():
            near = sorted((math.hypot(m.ex - x, m.ey - y), c) for c, (x, y) in free.items())
            near = [] if m.found or pd.isna(m.ex) or pd.isna(m.ey) else [n for n in near if n[0] <= 2 * m.tol]
            loose = not near and not m.found and not m.trusted and bool(free)
            code = near[0][1] if near else next(iter(free)) if loose else None
            free.pop(code, None)
            out.append((getattr(m, photo), m.mark, code, near[0][0] if near else None, near[1][0] if len(near) > 1 else None, loose))
        return pd.DataFrame(out, columns=[photo, "mark", "code", "nearest", "second", "any_code"])

    schema = f"{photo} {kinds[photo]}, mark {kinds['mark']}, code {kinds['code']}, nearest double, second double, any_code boolean"
    return marks.groupBy(photo).cogroup(codes.groupBy(photo)).applyInPandas(step, schema)


def undeclared_codes(codes: DataFrame, marks: DataFrame, photo: str, tol: float = g.VIEW_TOLERANCE) -> DataFrame:
    """Codes of a photo that lie within twice the tolerance of no code mark: extra, of confidence 0.40.

    Marks are dealt into the nine cells around theirs, of twice the tolerance, so a code meets only marks nearby.
    """
    far = 2 * tol
    cell = lambda c: F.floor(F.col(c) / far)
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    m = marks.select(F.col(photo).alias("__p"), F.col("cx").alias("mx"), F.col("cy").alias("my"), (cell("cx")).alias("__x"), cell("cy").alias("__y"), steps.alias("__s"))
    m = m.select("__p", "mx", "my", (F.col("__x") + F.col("__s.a")).alias("__x"), (F.col("__y") + F.col("__s.b")).alias("__y"))
    near = (F.col(photo) == F.col("__p")) & (cell("cx") == F.col("__x")) & (cell("cy") == F.col("__y")) & (g.distance((F.col("cx"), F.col("cy")), (F.col("mx"), F.col("my"))) <= far)
    return codes.join(m, near, "left_anti").withColumn("state", F.lit("Extra")).withColumn("confidence", F.lit(EXTRA_CONFIDENCE))


def realign(rows: DataFrame, offsets: DataFrame, by: str, tol: float) -> DataFrame:
    """Second pass: marks not matched become Matched where the group's common offset brings them within tol."""
    joined = rows.join(offsets.select(by, F.col("dx").alias("__dx"), F.col("dy").alias("__dy")), by, "left")
    off = g.distance((F.col("ex") + F.col("__dx"), F.col("ey") + F.col("__dy")), (F.col("ox"), F.col("oy")))
    up = F.coalesce((F.col("state") == "LowConfidence") & (off <= tol), F.lit(False))
    return joined.withColumn("realigned", up).withColumn("state", F.when(up, "Matched").otherwise(F.col("state"))).drop("__dx", "__dy")
