"""Clusters of drawing items: components of grids and boxes, growth, gaps, density, merges.

Components come from contraction rounds on edge tables (each a groupBy and two joins, written to the shared folder); what depends on the order of few shapes on one page runs in pandas, page by page.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, written
from .components import components
from .geometry import upper_median


def label(items: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """items with cluster, the least key of their component; items without edges are their own."""
    scratch = Scratch(items.sparkSession)
    roots = components(edges, scratch)
    least = roots.groupBy("root").agg(F.min("node").alias("__least"))
    found = written(roots.join(least, "root").select(F.col("node").alias("__node"), "__least"), "labels")
    scratch.clear()
    return items.join(found, items[key] == found["__node"], "left").select(*items.columns, F.coalesce("__least", key).alias("cluster"))


def cell_clusters(points: DataFrame, key: str, page: str, eps: float) -> DataFrame:
    """Clusters of points whose cells of size eps touch: whole neighbourhoods are joined, without a distance test."""
    cells = points.withColumn("__cx", F.floor(F.col("x") / eps)).withColumn("__cy", F.floor(F.col("y") / eps))
    head = cells.groupBy(page, "__cx", "__cy").agg(F.min(key).alias("__head"))
    inside = cells.join(head, [page, "__cx", "__cy"]).select(F.col(key).alias("a"), F.col("__head").alias("b"))
    return label(points, inside.unionAll(_neighbours(head, page, "__cx", "__cy", "__head")), key)


def _neighbours(cells: DataFrame, page: str, x: str, y: str, key: str) -> DataFrame:
    """Edges between the keys of 8-neighbouring cells."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, -1), (1, 0), (1, 1), (0, 1))])
    moved = cells.withColumn("__s", F.explode(steps))
    moved = moved.select(page, (F.col(x) + F.col("__s.a")).alias(x), (F.col(y) + F.col("__s.b")).alias(y), F.col(key).alias("a"))
    return moved.join(cells.select(page, x, y, F.col(key).alias("b")), [page, x, y]).select("a", "b")


def _cell_size(boxes: DataFrame, least: float) -> float:
    """A side for grid cells that boxes cover few of: their mean extent, and least if that is more."""
    mean = boxes.agg(F.avg(F.greatest("w", "h"))).first()[0]
    return max(mean or 0.0, least) or 1.0


def _covered(boxes: DataFrame, size: float, pad: float = 0.0) -> DataFrame:
    """boxes with each cell (__c, __r) of the grid that they touch when padded."""
    cols = F.sequence(F.floor((F.col("x") - pad) / size), F.floor((F.col("x") + F.col("w") + pad) / size))
    rows = F.sequence(F.floor((F.col("y") - pad) / size), F.floor((F.col("y") + F.col("h") + pad) / size))
    return boxes.withColumn("__c", F.explode(cols)).withColumn("__r", F.explode(rows))


def rect_clusters(boxes: DataFrame, key: str, page: str, gap: float) -> DataFrame:
    """Clusters of boxes with a horizontal and a vertical gap of at most gap: joined on the cells their padded boxes cover."""
    placed = _covered(boxes, _cell_size(boxes, 4 * gap), gap / 2 + 1e-9)
    a, b = (placed.select(F.col(page).alias("page"), "__c", "__r", F.col(key).alias(side), *(F.col(k).alias(side + k) for k in "xywh")) for side in "ab")
    pairs = a.join(b, ["page", "__c", "__r"]).where("a < b")
    dx = F.greatest(F.col("ax"), F.col("bx")) - F.least(F.col("ax") + F.col("aw"), F.col("bx") + F.col("bw"))
    dy = F.greatest(F.col("ay"), F.col("by")) - F.least(F.col("ay") + F.col("ah"), F.col("by") + F.col("bh"))
    return label(boxes, pairs.where((dx <= gap) & (dy <= gap)).select("a", "b"), key)


def kept_leftovers(clustered: DataFrame, page: str, page_area: float, least_items: int = 2, least_share: float = 0.001) -> DataFrame:
    """Boxes around clusters of leftover items (page, cluster, kind, x, y, w, h) that are worth a block of their own: with
    an image, or with least_items items or more on least_share of the page or more."""
    around = clustered.groupBy(page, "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "image").alias("n_images"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("__r"), F.max(F.col("y") + F.col("h")).alias("__b")
    )
    out = around.withColumn("w", F.col("__r") - F.col("x")).withColumn("h", F.col("__b") - F.col("y")).drop("__r", "__b")
    return out.where((F.col("n_images") > 0) | ((F.col("n") >= least_items) & (F.col("w") * F.col("h") >= least_share * page_area)))


def grid_components(cells: DataFrame, page: str, columns: int) -> DataFrame:
    """8-connected components of grid cells (r, c) of a page, with their sizes and ranks by size.

    cluster is the number (r * columns + c) of the component's first cell on its page.
    """
    keyed = cells.withColumn("__key", F.struct(F.col(page).alias("p"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")))
    out = label(keyed, _neighbours(keyed, page, "c", "r", "__key"), "__key").drop("__key")
    out = out.withColumn("cluster", F.col("cluster.r") * columns + F.col("cluster.c"))
    sizes = out.groupBy(page, "cluster").agg(F.count(F.lit(1)).alias("size"))
    rank = F.row_number().over(Window.partitionBy(page).orderBy(F.desc("size"), "cluster"))
    return out.join(sizes.withColumn("rank", rank), [page, "cluster"])


def grow(cells: DataFrame, page: str, steps: int = 2, least: int = 4) -> DataFrame:
    """Weak cells next to a component join it, at most steps away; the component with the least label keeps a cell.

    cells: page, r, c, n, cluster (null if weak). Returns all cells with what they belong to.
    """
    owned = cells.where("cluster IS NOT NULL").select(page, "r", "c", "cluster")
    weak = cells.where(F.col("cluster").isNull() & (F.col("n") >= least)).select(page, "r", "c")
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    front = owned
    for _ in range(steps):
        reach = front.withColumn("__s", F.explode(around)).select(page, (F.col("r") + F.col("__s.a")).alias("r"), (F.col("c") + F.col("__s.b")).alias("c"), "cluster")
        front = weak.join(reach, [page, "r", "c"]).groupBy(page, "r", "c").agg(F.min("cluster").alias("cluster"))
        owned = owned.unionAll(front)
        weak = weak.join(front, [page, "r", "c"], "left_anti")
    return owned.unionAll(weak.withColumn("cluster", F.lit(None).cast("long")))


def place_orphans(cells: DataFrame, cores: DataFrame, page: str, columns: int, least: int = 6, share: float = 0.5, zones: DataFrame | None = None) -> DataFrame:
    """Cells (page, r, c, cluster) after growth with what becomes of those that nothing claimed (cluster is null).

    Unclaimed cells that touch form components; of those with least cells or more, one that lies in a grown component's box
    for half or more is part of it (of the component of the best rank, if of several), others are seeds of their own,
    orphans. Smaller ones go, and so do those that touch a zone (page, x0, y0, x1, y1, in cells). cores: page, cluster, rank.
    """
    box = [F.min("c").alias("x0"), F.min("r").alias("y0"), (F.max("c") + 1).alias("x1"), (F.max("r") + 1).alias("y1")]
    owned = cells.where("cluster IS NOT NULL").select(page, "r", "c", "cluster")
    loose = grid_components(cells.where("cluster IS NULL").select(page, "r", "c"), page, columns).where(F.col("size") >= least).select(page, "r", "c", F.col("cluster").alias("label"))
    found = loose.groupBy(page, "label").agg(*box)
    if zones is not None:
        z = zones.select(F.col(page).alias("__p"), *(F.col(k).alias(f"z{k}") for k in ("x0", "y0", "x1", "y1")))
        touches = (F.col(page) == F.col("__p")) & (F.col("x1") > F.col("zx0")) & (F.col("x0") < F.col("zx1")) & (F.col("y1") > F.col("zy0")) & (F.col("y0") < F.col("zy1"))
        found = found.join(z, touches, "left_anti")
    grown = owned.groupBy(page, "cluster").agg(*box).join(cores.select(page, "cluster", "rank").distinct(), [page, "cluster"])
    g = grown.select(page, "cluster", "rank", *(F.col(k).alias(f"g{k}") for k in ("x0", "y0", "x1", "y1")))
    across = lambda k: F.greatest(F.least(f"{k}1", f"g{k}1") - F.greatest(f"{k}0", f"g{k}0"), F.lit(0))
    inside = across("x") * across("y") >= share * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    hosts = found.join(g, page).where(inside).groupBy(page, "label").agg(F.min_by("cluster", "rank").alias("host"))
    placed = loose.join(found.select(page, "label"), [page, "label"]).join(hosts, [page, "label"], "left")
    orphans = placed.select(page, "r", "c", F.coalesce("host", "label").alias("cluster"), F.col("host").isNull().alias("orphan"))
    return owned.withColumn("orphan", F.lit(False)).unionByName(orphans)


def gap_islands(rows: DataFrame, by: list[str], value: str, most: float | Column, order: list[str] | None = None) -> DataFrame:
    """rows with island: numbered from 1, a new one where value exceeds the row's before by more than most."""
    w = Window.partitionBy(*by).orderBy(value, *(order or []))
    limit = most if isinstance(most, Column) else F.lit(most)
    new = F.when(F.col(value) - F.lag(value).over(w) > limit, 1).otherwise(0)
    return rows.withColumn("__new", new).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("__new")


def largest_gap(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The widest gap between neighbouring values of a group and where it starts (the first of equal ones)."""
    gap = F.lead(value).over(Window.partitionBy(*by).orderBy(value)) - F.col(value)
    gaps = rows.withColumn("gap", gap).where("gap IS NOT NULL")
    best = F.max(F.struct(F.col("gap"), (-F.col(value)).alias("at")))
    return gaps.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.gap").alias("gap"), (-F.col("b.at")).alias("starts"))


def dash_chains(segments: DataFrame, by: list[str], most_gap: float = 14, least_count: int = 3, least_span: float = 50, most_share: float = 0.35) -> DataFrame:
    """Dashed lines: segments (pos, start, stop) of one direction and position, with small gaps, enough of them, and short ones."""
    bucket = F.round(F.col("pos") * 2).cast("long")
    rows = segments.withColumn("bucket", bucket)
    w = Window.partitionBy(*by, "bucket").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") - reach > most_gap, 1).otherwise(0)
    chained = rows.withColumn("__new", new).withColumn("chain", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = chained.groupBy(*by, "bucket", "chain").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.max(F.col("stop") - F.col("start")).alias("longest"))
    span = F.col("stop") - F.col("start")
    return found.where((F.col("n") >= least_count) & (span >= least_span) & (F.col("longest") <= most_share * span))


def uncovered_bands(segments: DataFrame, by: list[str]) -> DataFrame:
    """Bands between the union of a group's intervals (start, stop): gap_start and gap_stop."""
    w = Window.partitionBy(*by).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return segments.withColumn("gap_start", reach).where(F.col("start") > F.col("gap_start")).select(*by, "gap_start", F.col("start").alias("gap_stop"))


def per_page(shapes: DataFrame, page: str, step: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run an order-dependent step on the shapes of one page; a page is bounded by what a drawing holds."""
    return shapes.groupBy(page).applyInPandas(step, schema)


def _iou(a, b) -> tuple[float, float]:  # noqa: ANN001
    """(intersection over union, intersection over the smaller box)."""
    w = min(a.x + a.w, b.x + b.w) - max(a.x, b.x)
    h = min(a.y + a.h, b.y + b.h) - max(a.y, b.y)
    both = w * h if w > 0 and h > 0 else 0.0
    sizes = a.w * a.h, b.w * b.h
    return (both / (sum(sizes) - both) if both else 0.0), (both / min(sizes) if both and min(sizes) > 0 else 0.0)


def merge_seeds(boxes: DataFrame, page: str, key: str, least_iou: float = 0.5, least_inside: float = 0.85) -> DataFrame:
    """page, key and seed: boxes by falling area, each joined to the first earlier seed that it overlaps or lies in."""

    def step(group: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(group.itertuples(), key=lambda r: (-r.w * r.h, getattr(r, key)))
        seeds, out = [], []
        for r in rows:
            host = next((s for s in seeds if _iou(s, r)[0] >= least_iou or _iou(s, r)[1] >= least_inside), None)
            if host is None:
                seeds.append(r)
            out.append((getattr(r, page), getattr(r, key), getattr(host or r, key)))
        return pd.DataFrame(out, columns=[page, key, "seed"])

    kinds = dict(boxes.dtypes)
    return per_page(boxes, page, step, f"{page} {kinds[page]}, {key} {kinds[key]}, seed {kinds[key]}")


def reading_rows(lines: DataFrame, page: str, key: str, factor: float = 0.5, least: float = 4.5) -> DataFrame:
    """page, key and row: lines by their centre, each joining the row whose running mean is near, else a new one."""

    def step(group: pd.DataFrame) -> pd.DataFrame:
        tol = max(factor * float(group["h"].median()), least)
        rows: list[list[float]] = []
        out = []
        for r in sorted(group.itertuples(), key=lambda r: (r.y + r.h / 2, r.x, getattr(r, key))):
            centre = r.y + r.h / 2
            k = next((k for k, row in enumerate(rows) if abs(sum(row) / len(row) - centre) <= tol), None)
            if k is None:
                k = len(rows)
                rows.append([])
            rows[k].append(centre)
            out.append((getattr(r, page), getattr(r, key), k))
        return pd.DataFrame(out, columns=[page, key, "row"])

    kinds = dict(lines.dtypes)
    return per_page(lines, page, step, f"{page} {kinds[page]}, {key} {kinds[key]}, row long")


def owners(items: DataFrame, boxes: DataFrame, page: str, item: str, box: str) -> DataFrame:
    """item and box of every item whose centre lies in a box, the nearest centre if in several; small boxes own nothing.

    An item meets the boxes that cover its centre's grid cell only.
    """
    big = boxes.where((F.least("w", "h") >= 30) & (F.col("w") * F.col("h") >= 4000))
    size = _cell_size(big, 30.0)
    b = _covered(big, size).select(page, "__c", "__r", F.col(box), *(F.col(k).alias(f"b{k}") for k in "xywh"))
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    inside = cx.between(F.col("bx"), F.col("bx") + F.col("bw")) & cy.between(F.col("by"), F.col("by") + F.col("bh"))
    d = (cx - F.col("bx") - F.col("bw") / 2) ** 2 + (cy - F.col("by") - F.col("bh") / 2) ** 2
    at = items.withColumn("__c", F.floor(cx / size)).withColumn("__r", F.floor(cy / size))
    return at.join(b, [page, "__c", "__r"]).where(inside).groupBy(page, item).agg(F.min(F.struct(d.alias("d"), F.col(box).alias("box"))).alias("b")).select(page, item, F.col("b.box").alias(box))


def attach_vectors(vectors: DataFrame, seeds: DataFrame, page: str, key: str, seed: str, most: float = 60.0) -> DataFrame:
    """page, seed, n and the box around each seed (page, seed, x, y, w, h) and the vectors whose nearest seed it is.

    The distance of a vector is that of its centre to the seed's box, most at most; equal distances go to the least seed.
    Vectors meet the seeds whose boxes, padded by most, cover their centre's grid cell.
    """
    size = _cell_size(seeds, 2 * most)
    s = _covered(seeds, size, most).select(page, "__c", "__r", F.col(seed), *(F.col(k).alias(f"s{k}") for k in "xywh"))
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    out = lambda c, a, n: F.greatest(F.col(a) - c, c - F.col(a) - F.col(n), F.lit(0.0))
    d = F.hypot(out(cx, "sx", "sw"), out(cy, "sy", "sh"))
    met = vectors.withColumn("__c", F.floor(cx / size)).withColumn("__r", F.floor(cy / size)).join(s, [page, "__c", "__r"]).withColumn("__d", d).where(F.col("__d") <= most)
    nearest = met.groupBy(page, key).agg(F.min(F.struct("__d", seed)).alias("b"), *(F.first(k).alias(k) for k in "xywh")).select(page, F.col(f"b.{seed}").alias(seed), *"xywh", F.lit(1).alias("__n"))
    grown = seeds.select(page, seed, *"xywh", F.lit(0).alias("__n")).unionByName(nearest)
    box = grown.groupBy(page, seed).agg(F.sum("__n").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("__r"), F.max(F.col("y") + F.col("h")).alias("__b"))
    return box.select(page, seed, "n", "x", "y", (F.col("__r") - F.col("x")).alias("w"), (F.col("__b") - F.col("y")).alias("h"))


#: Rows and clusters of a screen menu in median heights, its least items and rows, and its largest share of a block.
MENU_ROW, MENU_GAP, MENU_ITEMS, MENU_ROWS, MENU_SHARE = 1.5, 10.0, 8, 3, 0.25


def gray_menus(elements: DataFrame, block: str, element: str) -> DataFrame:
    """elements (block, element, x, y, w, h, participate, block_area) without screen menus: participate is false for these,
    and menu says so.

    The participating elements of a block, by their centres from top to bottom, fall into clusters at gaps of more than 10
    median heights and into rows at gaps of more than 1.5; a cluster of 8 elements or more, in 3 rows or more, on a quarter
    of the block at most is a menu. Should that leave a block of 8 or more with nothing, it is split at its widest gap, and
    a side of fewer than 8 takes part after all: keys beside a screen.
    """
    cy = F.col("y") + F.col("h") / 2
    heights = elements.where("participate").groupBy(block).agg(upper_median(F.greatest("h", F.lit(1.0))).alias("__m"), F.count(F.lit(1)).alias("__before"))
    rows = elements.join(heights, block, "left").withColumn("__cy", cy)
    taking = rows.where("participate")
    down = Window.partitionBy(block).orderBy("__cy", element)
    taking = taking.withColumn("__d", F.col("__cy") - F.lag("__cy").over(down)).withColumn("__new", F.when(F.col("__d") > MENU_GAP * F.col("__m"), 1).otherwise(0))
    taking = taking.withColumn("__c", F.sum("__new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    breaks = F.count_if((F.col("__d") > MENU_ROW * F.col("__m")) & (F.col("__new") == 0))
    area = (F.max(F.col("x") + F.col("w")) - F.min("x")) * (F.max(F.col("y") + F.col("h")) - F.min("y"))
    found = taking.groupBy(block, "__c").agg(F.count(F.lit(1)).alias("n"), (breaks + 1).alias("n_rows"), area.alias("area"), F.first("block_area").alias("whole"), F.collect_list(element).alias("e"))
    menus = found.where((F.col("n") >= MENU_ITEMS) & (F.col("n_rows") >= MENU_ROWS) & (F.col("area") <= MENU_SHARE * F.greatest("whole", F.lit(1.0))))
    menus = menus.select(block, F.explode("e").alias(element), F.lit(True).alias("__menu"))
    judged = rows.join(menus, [block, element], "left").withColumn("__menu", F.coalesce("__menu", F.lit(False)))
    judged = judged.withColumn("__after", F.col("participate") & ~F.col("__menu"))
    whole = Window.partitionBy(block)
    judged = judged.withColumn("__pos", F.row_number().over(down)).withColumn("__gap", F.col("__cy") - F.lag("__cy").over(down)).withColumn("__widest", F.max("__gap").over(whole))
    judged = judged.withColumn("__top", F.col("__pos") < F.min(F.when(F.col("__gap") == F.col("__widest"), F.col("__pos"))).over(whole))
    side = F.count(F.lit(1)).over(Window.partitionBy(block, "__top"))
    rescued = (F.coalesce("__before", F.lit(0)) >= MENU_ITEMS) & ~F.col("__left") & (F.col("__side") < MENU_ITEMS)
    judged = judged.withColumn("__side", side).withColumn("__left", F.bool_or("__after").over(whole)).withColumn("__back", F.coalesce(rescued, F.lit(False)))
    kept = [c for c in elements.columns if c != "participate"]
    return judged.select(*kept, (F.col("__after") | F.col("__back")).alias("participate"), (F.col("__menu") & ~F.col("__back")).alias("menu"))


def bridge_merge(parts: DataFrame, lines: DataFrame, page: str, key: str, line: str, most_gap: float, least_reach: float, thickness: float) -> DataFrame:
    """parts (page, key, x, y, w, h, n) with cluster: disjoint neighbours that a thin line (page, line, x, y, w, h) joins are one.

    Two parts are joined if they share 0.7 of the lesser extent in a row or a column, lie at most most_gap apart, have
    sizes n within a ratio of 0.30, and one line at most thickness thick reaches into both, least_reach in total. Lines
    meet the parts that cover a grid cell with them, so pairs come from shared lines, not from all parts of a page.
    """
    size = _cell_size(parts, most_gap)
    thin = _covered(lines.where((F.col("w") <= thickness) | (F.col("h") <= thickness)), size).select(page, "__c", "__r", F.col(line).alias("__line"), *(F.col(k).alias(f"l{k}") for k in "xywh"))
    touch = (F.col("lx") <= F.col("x") + F.col("w")) & (F.col("x") <= F.col("lx") + F.col("lw")) & (F.col("ly") <= F.col("y") + F.col("h")) & (F.col("y") <= F.col("ly") + F.col("lh"))
    met = _covered(parts, size).join(thin, [page, "__c", "__r"]).where(touch).dropDuplicates([page, key, "__line"])
    a, b = (met.select(page, "__line", F.col(key).alias(s), *(F.col(k).alias(s + k) for k in ("x", "y", "w", "h", "n")), *([F.col(k) for k in ("lx", "ly", "lw", "lh")] if s == "a" else [])) for s in ("a", "b"))
    p = a.join(b, [page, "__line"]).where("a < b")

    def shared(k: str, size: str) -> Column:
        return F.least(F.col(f"a{k}") + F.col(f"a{size}"), F.col(f"b{k}") + F.col(f"b{size}")) - F.greatest(F.col(f"a{k}"), F.col(f"b{k}"))

    def reach(k: str, size: str) -> Column:
        stop, start = ([F.least(F.col(f"l{k}") + F.col(f"l{size}"), F.col(f"{s}{k}") + F.col(f"{s}{size}")) for s in "ab"], [F.greatest(F.col(f"l{k}"), F.col(f"{s}{k}")) for s in "ab"])
        return stop[0] - start[0] + stop[1] - start[1]  # in this order: other sums differ in their last bit, which decides at the limit

    sx, sy = shared("x", "w"), shared("y", "h")
    row = sy >= 0.7 * F.least("ah", "bh")
    column = sx >= 0.7 * F.least("aw", "bw")
    into = F.when(row, reach("x", "w")).otherwise(reach("y", "h"))
    alike = F.least("an", "bn") >= 0.30 * F.greatest("an", "bn")
    joined = p.where(~((sx > 0) & (sy > 0)) & (row | column) & (F.greatest(-sx, -sy) <= most_gap) & alike & (into >= least_reach))
    return label(parts, joined.select("a", "b"), key)


def exclusion_zones(notes: DataFrame, page: str, key: str, gap: float = 30, least: int = 2) -> DataFrame:
    """Boxes around groups of note sentences at most gap apart, of least sentences or more."""
    grouped = rect_clusters(notes, key, page, gap)
    zone = grouped.groupBy(page, "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("b")
    )
    return zone.where(F.col("n") >= least).select(page, "cluster", "n", "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("b") - F.col("y")).alias("h"))
