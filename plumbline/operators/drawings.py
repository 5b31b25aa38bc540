"""What a drawing's blocks and a photo's readings are made of: best readings, merged lines, flags, records, cuts of pages.

Steps that depend on the order of a page's few shapes run in pandas, page by page; the rest is declared.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

# Limits of the rules for readings, corridors and cuts.
LOW_CONFIDENCE = 0.60
MERGE_GAP, MERGE_DY = 0.012, 0.010
GRID, LEAST_CELLS, CORRIDOR, COVERED, EDGE_NEAR, EDGE_FAR, THIN, DEPTH = 24.0, 3, 2.0, 0.40, 2.0, 8.0, 3.0, 4
CUT_GAP, CUT_SPAN, CUT_MARGIN, CUT_VECTORS, CUT_STEP, FOLD = 7.5, 8.0, 0.08, 60, 2.0, 0.40


def best_readings(readings: DataFrame, by: list[str], confidence: str, order: str) -> DataFrame:
    """Of the readings with one text, the most confident, the first in order of equal ones; null counts as 0."""
    first = Window.partitionBy(*by).orderBy(F.desc(F.coalesce(F.col(confidence), F.lit(0.0))), order)
    return readings.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")


def marking_flags(blocks: DataFrame, elements: DataFrame) -> DataFrame:
    """blocks (block, override, ocr_on, ocr_raw, ocr_noise) with has_marking, empty_reason and low_conf.

    elements: block, kind, text, participate, conf. A block has markings if a participating element has a text or there is
    a code or an icon, unless an override says it has none. low_conf says that a participating text was read with less
    than 0.60; a confidence that is null or 0 isn't one.
    """
    part = F.col("participate") & (F.coalesce("text", F.lit("")) != "")
    conf = F.when(F.coalesce("conf", F.lit(0.0)) == 0, 1.0).otherwise(F.col("conf"))
    seen = elements.groupBy("block").agg(
        F.bool_or(part | F.col("kind").isin("qr", "icon")).alias("__any"), F.bool_or(F.col("kind").isin("dim", "note", "meta")).alias("__other"), F.bool_or(part & (conf < LOW_CONFIDENCE)).alias("__low")
    )
    no = lambda c: F.coalesce(c, F.lit(False))
    forced = no(F.col("__any")) & no(F.col("override") == 0)
    marked = no(F.col("__any")) & ~forced
    reason = (
        F.when(marked, F.lit(None).cast("string"))
        .when(forced, "override_forced_empty")
        .when((F.col("ocr_noise") > 0) & ~no(F.col("__other")), "ocr_noise_only")
        .when(no(F.col("__other")) | (F.col("ocr_raw") > 0), "all_dim_note")
        .when(F.col("ocr_on"), "ocr_empty")
        .otherwise("no_text_layer")
    )
    joined = blocks.join(seen, "block", "left")
    return joined.select(*blocks.columns, marked.alias("has_marking"), reason.alias("empty_reason"), no(F.col("__low")).alias("low_conf"))


def _glued(left: str, right: str) -> str:
    """Two pieces of a line: with a space between, but not beside an ideograph or one of : / -."""
    if not left or not right:
        return left + right
    ends = left[-1] + right[0]
    return left + ("" if re.search("[一-鿿:：/-]", ends) else " ") + right


def merge_fragments(texts: DataFrame, page: str, key: str) -> DataFrame:
    """Texts of a page (page, key, text, conf, x0, y0, x1, y1, width and height of the page) with fragments of a line as one.

    From top to bottom and left to right a fragment joins the first line whose upper and lower edges are within 0.010 of the
    height and whose end is at most 0.012 of the width before it. The line has its first fragment's key, the box around
    all, and the least confidence.
    """
    kinds = dict(texts.dtypes)

    def step(group: pd.DataFrame) -> pd.DataFrame:
        gap, dy = group["width"].iloc[0] * MERGE_GAP, group["height"].iloc[0] * MERGE_DY
        lines: list[dict] = []
        for r in sorted(group.to_dict("records"), key=lambda r: (round(r["y0"] / max(dy, 1)), r["x0"], r[key])):
            m = next((m for m in lines if abs(r["y0"] - m["y0"]) <= dy and abs(r["y1"] - m["y1"]) <= dy and r["x0"] - m["x1"] <= gap), None)
            if m is None:
                lines.append(r | {"n": 1})
                continue
            m |= {"text": _glued(m["text"], r["text"]), "conf": min(m["conf"], r["conf"]), "n": m["n"] + 1}
            m |= {c: f(m[c], r[c]) for c, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max))}
        return pd.DataFrame(lines)[[page, key, "n", "text", "conf", "x0", "y0", "x1", "y1"]]

    return texts.groupBy(page).applyInPandas(step, f"{page} {kinds[page]}, {key} {kinds[key]}, n long, text string, conf double, x0 double, y0 double, x1 double, y1 double")


def parse_records(rows: DataFrame) -> DataFrame:
    """image, seq, code and info of the records on an image, from its text rows (image, row, text).

    Two rows or more with a code: each is a record, with the text beside its code, else that of the next row below, or
    the next above, that has none and isn't taken. Otherwise one record: what stands beside a label, else the first code
    and all that is a name.
    """
    text = F.col("text")
    has = lambda labels: F.exists(F.array(*map(F.lit, labels)), lambda w: text.contains(w))
    name = lambda c: F.when(t.meaningful_info(t.strip_designator(t.clean_info(c))), t.strip_designator(t.clean_info(c))).otherwise("")
    beside = t.item_code(t.strip_label(text, t.CODE_LABELS))
    prepared = rows.where(text.isNotNull()).select(
        "image", "row", t.item_code(text).alias("code"), F.coalesce(name(text), F.lit("")).alias("info"),
        F.when(has(t.CODE_LABELS), F.when(beside != "", beside).otherwise(t.item_code(text))).otherwise("").alias("label_code"), F.when(has(t.NAME_LABELS), name(t.strip_label(text, t.NAME_LABELS))).otherwise("").alias("label_info"),
    )
    kind = dict(rows.dtypes)["image"]

    def step(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("row").to_dict("records")
        coded = [k for k, r in enumerate(g) if r["code"]]
        found = []
        if len(coded) >= 2:
            free = {k for k, r in enumerate(g) if r["info"] and not r["code"]}
            for k in coded:
                info = g[k]["info"]
                near = None if info else next((j for j in [*range(k + 1, len(g)), *range(k - 1, -1, -1)] if j in free), None)
                if near is not None:
                    free.discard(near)
                    info = g[near]["info"]
                found.append((g[k]["code"], info))
        else:
            first = lambda c: next((r[c] for r in g if r[c]), "")
            every = re.sub(r"\s{2,}", " ", " ".join(r["info"] for r in g if r["info"]).strip())
            found.append((first("label_code") or first("code"), first("label_info") or every))
        return pd.DataFrame([(g[0]["image"], k, *x) for k, x in enumerate(found)], columns=["image", "seq", "code", "info"])

    return prepared.groupBy("image").applyInPandas(step, f"image {kind}, seq long, code string, info string")


def same_spots(marks: DataFrame) -> DataFrame:
    """marks without duplicates: drawing, id, type, text, page, view, spans, images, x, y, w, h, confidence.

    From the most confident down (by id of equal ones) a mark goes if one that stays has its type, text and page, and either
    its spans (its images, if that one has no spans), or its view and a box with an overlap of 0.9.
    """

    def step(group: pd.DataFrame) -> pd.DataFrame:
        stay: list[dict] = []
        for m in sorted(group.to_dict("records"), key=lambda m: (-m["confidence"], m["id"])):
            m |= {c: tuple(m[c]) if m[c] is not None else () for c in ("spans", "images")}
            if not any((k["spans"] == m["spans"] if k["spans"] else k["images"] == m["images"]) or (k["view"] == m["view"] and _overlap(k, m) >= 0.9) for k in stay):
                stay.append(m)
        return pd.DataFrame(stay)[["drawing", "id"]]

    kinds = dict(marks.dtypes)
    kept = marks.groupBy("drawing", "type", "text", "page").applyInPandas(step, f"drawing {kinds['drawing']}, id {kinds['id']}")
    return marks.join(kept, ["drawing", "id"], "left_semi")


def _overlap(a: dict, b: dict) -> float:
    if any(pd.isna(m[c]) for m in (a, b) for c in "xywh") or min(a["w"], a["h"], b["w"], b["h"]) <= 0:
        return 0.0
    w = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    both = w * h if w > 0 and h > 0 else 0.0
    return both / (a["w"] * a["h"] + b["w"] * b["h"] - both)


def nearest_words(images: DataFrame, words: DataFrame, page: str, image: str, word: str, reach: float = 2.5) -> DataFrame:
    """page, image, word and distance: the nearest word (page, word, wx, wy) to the centre of an image (x, y, w, h), within
    reach times its longer side; equal distances go to the least word. Images meet the words of the cells in their reach."""
    size = images.agg(F.avg(F.greatest("w", "h") * reach)).first()[0] or 1.0
    cx, cy, far = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.greatest("w", "h") * reach
    around = lambda c: F.explode(F.sequence(F.floor((c - far) / size), F.floor((c + far) / size)))
    left = images.withColumn("__c", around(cx)).withColumn("__r", around(cy)).select(page, image, "__c", "__r", cx.alias("__x"), cy.alias("__y"), far.alias("__far"))
    right = words.select(page, word, "wx", "wy", F.floor(F.col("wx") / size).alias("__c"), F.floor(F.col("wy") / size).alias("__r"))
    d = F.sqrt((F.col("__x") - F.col("wx")) ** 2 + (F.col("__y") - F.col("wy")) ** 2)
    met = left.join(right, [page, "__c", "__r"]).withColumn("__d", d).where("__d <= __far")
    best = met.groupBy(page, image).agg(F.min(F.struct("__d", word)).alias("b"))
    return best.select(page, image, F.col(f"b.{word}").alias(word), F.col("b.__d").alias("distance"))


def _union(spans: np.ndarray) -> float:
    """The length that intervals (start, stop) cover together."""
    if not len(spans):
        return 0.0
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.concatenate([[-np.inf], np.maximum.accumulate(spans[:, 1])[:-1]])
    return float(np.maximum(spans[:, 1] - np.maximum(spans[:, 0], reach), 0).sum())


def _corridor(cells: np.ndarray, rects: np.ndarray, axis: int) -> np.ndarray | None:
    """Which cells lie before the widest corridor across an axis (0 rows, 1 columns); None without one.

    A corridor is a band without edges, 2 wide at least, in the middle 70 % of the cells' box; rectangles that cross it
    cover less than 0.40 of the other side; a thin line half as long runs along either border; and both halves have three
    cells in two rows.
    """
    low, high = cells.min(axis=0) * GRID, (cells.max(axis=0) + 1) * GRID
    other = 1 - axis
    span, across = high[axis] - low[axis], high[other] - low[other]
    start, stop = rects[:, 1 - axis], rects[:, 3 - axis]  # rects are x0, y0, x1, y1
    side = rects[:, [1 - other, 3 - other]]
    line = (stop - start <= THIN) & (side[:, 1] - side[:, 0] >= 0.5 * across)
    edges = np.unique(np.concatenate([start, stop]))
    best = None
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a < CORRIDOR or a <= low[axis] + 0.15 * span or b >= high[axis] - 0.15 * span or (best and b - a <= best[0]):
            continue
        middle = (a + b) / 2
        if _union(side[(start < middle) & (middle < stop)]) / across >= COVERED:
            continue
        above = line & (stop >= a - EDGE_NEAR) & (stop <= a + EDGE_FAR)
        below = line & (start >= b - EDGE_FAR) & (start <= b + EDGE_NEAR)
        before = (cells[:, axis] + 0.5) * GRID < middle
        halves = cells[before, axis], cells[~before, axis]
        if above.any() and below.any() and all(len(h) >= LEAST_CELLS and len(np.unique(h)) >= 2 for h in halves):
            best = (b - a, before)
    return best[1] if best else None


def _split(cells: np.ndarray, rects: np.ndarray, depth: int = 0) -> list[np.ndarray]:
    if len(cells) < 2 * LEAST_CELLS or depth >= DEPTH:
        return [cells]
    x0, y0, x1, y1 = cells[:, 1].min() * GRID, cells[:, 0].min() * GRID, (cells[:, 1].max() + 1) * GRID, (cells[:, 0].max() + 1) * GRID
    near = rects[(rects[:, 2] >= x0 - 6) & (rects[:, 0] <= x1 + 6) & (rects[:, 3] >= y0 - 6) & (rects[:, 1] <= y1 + 6)]
    for axis in (0, 1):
        before = _corridor(cells, near, axis)
        if before is not None:
            return [part for half in (cells[before], cells[~before]) for part in _split(half, near, depth + 1)]
    return [cells]


def split_corridors(cells: DataFrame, rects: DataFrame, page: str, component: str) -> DataFrame:
    """page, component, part, r and c: components of grid cells cut along the corridors between the rectangles of their page
    (x0, y0, x1, y1), rows first, the widest corridor first, four deep at most."""
    kinds = dict(cells.dtypes)

    def step(own: pd.DataFrame, shapes: pd.DataFrame) -> pd.DataFrame:
        boxes = shapes[["x0", "y0", "x1", "y1"]].to_numpy(float).reshape(-1, 4)
        out = []
        for name, group in own.groupby(component, sort=True):
            grid = group[["r", "c"]].sort_values(["r", "c"]).to_numpy()
            out += [(own[page].iloc[0], name, k, r, c) for k, part in enumerate(_split(grid, boxes)) for r, c in part.tolist()]
        return pd.DataFrame(out, columns=[page, component, "part", "r", "c"])

    return cells.groupBy(page).cogroup(rects.groupBy(page)).applyInPandas(step, f"{page} {kinds[page]}, {component} {kinds[component]}, part long, r long, c long")


def _bands(box: np.ndarray, rects: np.ndarray, axis: int) -> list[float]:
    """The middles of the empty bands across an axis (0 x, 1 y) of a box, in steps of 2, away from its margins."""
    low, high = box[axis], box[axis + 2]
    span = high - low
    if span < 3 * CUT_GAP:
        return []
    solid = rects[np.maximum(rects[:, 2] - rects[:, 0], rects[:, 3] - rects[:, 1]) >= CUT_SPAN]
    n = int(span / CUT_STEP) + 1
    first = np.maximum(0, ((solid[:, axis] - 0.5 - low) / CUT_STEP).astype(int))
    last = np.maximum(np.minimum(n - 1, ((solid[:, axis + 2] + 0.5 - low) / CUT_STEP).astype(int)), first)
    marks = np.zeros(n + 2, dtype=int)
    np.add.at(marks, np.minimum(first, n), 1)
    np.add.at(marks, np.minimum(last + 1, n + 1), -1)
    empty = np.concatenate([[False], np.cumsum(marks)[:n] == 0, [False]])
    turns = np.flatnonzero(empty[1:] != empty[:-1]).reshape(-1, 2)
    found = [(low + a * CUT_STEP, low + b * CUT_STEP) for a, b in turns.tolist()]
    return [(a + b) / 2 for a, b in found if b - a >= CUT_GAP and a > low + CUT_MARGIN * span and b < high - CUT_MARGIN * span]


def _inside(box: np.ndarray, rects: np.ndarray) -> np.ndarray:
    return rects[(rects[:, 2] >= box[0]) & (rects[:, 0] <= box[2]) & (rects[:, 3] >= box[1]) & (rects[:, 1] <= box[3])]


def _cut(box: np.ndarray, rects: np.ndarray, least: int, depth: int = 0) -> list[np.ndarray]:
    """A box cut along its empty bands, x first, if two pieces or more have enough rectangles; poorer pieces go to the
    piece before them, or to the first that is rich enough."""
    if depth >= DEPTH:
        return [box]
    for axis in (0, 1):
        edges = [box[axis], *_bands(box, _inside(box, rects), axis), box[axis + 2]]
        pieces = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            piece = box.copy()
            piece[axis], piece[axis + 2] = a, b
            pieces.append(piece)
        rich = [k for k, p in enumerate(pieces) if len(_inside(p, rects)) >= least]
        if len(rich) < 2:
            continue
        starts = [0, *rich[1:]]
        joined = []
        for a, b in zip(starts, [*starts[1:], len(pieces)], strict=True):
            piece = pieces[a].copy()
            piece[axis + 2] = pieces[b - 1][axis + 2]
            joined.append(piece)
        return [p for piece in joined for p in _cut(piece, rects, least, depth + 1)]
    return [box]


def _folded(boxes: list[np.ndarray]) -> list[np.ndarray]:
    """Boxes that share 0.40 of the smaller one with another become one, until none do."""
    todo, done = list(boxes), []
    while todo:
        box = todo.pop(0)
        host = next((k for k, other in enumerate(todo) if _contained(box, other) >= FOLD), None)
        if host is None:
            done.append(box)
            continue
        other = todo.pop(host)
        todo = [np.concatenate([np.minimum(box[:2], other[:2]), np.maximum(box[2:], other[2:])]), *done, *todo]
        done = []
    return done


def _contained(a: np.ndarray, b: np.ndarray) -> float:
    w, h = np.minimum(a[2:], b[2:]) - np.maximum(a[:2], b[:2])
    least = min(np.prod(a[2:] - a[:2]), np.prod(b[2:] - b[:2]))
    return float(w * h / max(least, 1e-9)) if w > 0 and h > 0 else 0.0


def xy_cut(seeds: DataFrame, rects: DataFrame, page: str, seed: str, least: int = CUT_VECTORS) -> DataFrame:
    """page, piece, x0, y0, x1, y1 and n (rectangles touched): seed boxes cut along empty bands of 7.5 or more, four deep,
    where two pieces or more touch least rectangles; what lies in another for 0.40 or more is folded into it."""
    kinds = dict(seeds.dtypes)

    def step(own: pd.DataFrame, shapes: pd.DataFrame) -> pd.DataFrame:
        boxes = shapes[["x0", "y0", "x1", "y1"]].to_numpy(float).reshape(-1, 4)
        cut = [p for s in own.sort_values(seed)[["x0", "y0", "x1", "y1"]].to_numpy(float) for p in _cut(s, boxes, least)]
        out = [(own[page].iloc[0], k, *box.tolist(), len(_inside(box, boxes))) for k, box in enumerate(_folded(cut))]
        return pd.DataFrame(out, columns=[page, "piece", "x0", "y0", "x1", "y1", "n"])

    return seeds.groupBy(page).cogroup(rects.groupBy(page)).applyInPandas(step, f"{page} {kinds[page]}, piece long, x0 double, y0 double, x1 double, y1 double, n long")
