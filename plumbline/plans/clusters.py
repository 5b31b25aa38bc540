"""Cluster queries: events and line items are boxes and points of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters
from ..operators import geometry as op
from .geometry import BOXES_SQL, boxes
from .registry import query, table

REACH = """{name} AS (SELECT {key} AS node, {key} AS other FROM {items} UNION SELECT node, b FROM {name} JOIN edges ON a = other)"""


def _clustered(edges: str, key: str = "event_id") -> str:
    return f"WITH RECURSIVE {BOXES_SQL}, s AS MATERIALIZED (SELECT * FROM bx), edges AS MATERIALIZED ({edges}), " + REACH.format(name="reach", key=key, items="s") + f", cl AS (SELECT node AS {key}, min(other) AS cluster FROM reach GROUP BY node)"


def _near(gap: float) -> str:
    return f"SELECT a.event_id AS a, b.event_id AS b FROM s AS a JOIN s AS b ON a.page = b.page AND a.event_id <> b.event_id AND greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w) <= {gap} AND greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h) <= {gap}"


@query("CC1", _clustered("SELECT a.event_id AS a, b.event_id AS b FROM s AS a JOIN s AS b ON a.page = b.page AND abs(floor(a.x / 0.04) - floor(b.x / 0.04)) <= 1 AND abs(floor(a.y / 0.04) - floor(b.y / 0.04)) <= 1 AND a.event_id <> b.event_id") + " SELECT event_id, cluster FROM cl")
def cell_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cell_clusters(boxes(spark, sf_dir), "event_id", "page", 0.04).select("event_id", "cluster")


@query("CC2", _clustered(_near(0.013)) + " SELECT event_id, cluster FROM cl")
def rect_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.rect_clusters(boxes(spark, sf_dir), "event_id", "page", 0.013).select("event_id", "cluster")


@query(
    "CC13",
    _clustered(_near(0.013))
    + """ SELECT page, cluster, count(*) AS n, count(*) FILTER (event_id % 9 = 0) AS n_images, min(x) AS x, min(y) AS y, round(max(x + w) - min(x), 9) AS w, round(max(y + h) - min(y), 9) AS h FROM bx JOIN cl USING (event_id) GROUP BY page, cluster
      HAVING count(*) FILTER (event_id % 9 = 0) > 0 OR (count(*) >= 2 AND (max(x + w) - min(x)) * (max(y + h) - min(y)) >= 0.005)""",
)
def leftover_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of leftovers that are kept: with an image, or several items on half a percent of the page."""
    found = clusters.rect_clusters(boxes(spark, sf_dir), "event_id", "page", 0.013)
    kept = clusters.kept_leftovers(found.withColumn("kind", F.when(F.col("event_id") % 9 == 0, "image").otherwise("text")), "page", 1.0, least_share=0.005)
    return kept.select("page", "cluster", "n", "n_images", "x", "y", F.round("w", 9).alias("w"), F.round("h", 9).alias("h"))


CELLS_SQL = """cc AS (SELECT page, unnest(range(floor(x * 10)::INT, least(9, floor((x + w) * 10)::INT) + 1)) AS c, y, h FROM bx), rc AS (SELECT page, c, unnest(range(floor(y * 10)::INT, least(9, floor((y + h) * 10)::INT) + 1)) AS r FROM cc),
  g AS MATERIALIZED (SELECT page, r, c, count(*) AS n, page * 100 + r * 10 + c AS k FROM rc GROUP BY page, r, c HAVING count(*) >= 2), st AS MATERIALIZED (SELECT * FROM g WHERE n >= 3)"""
STRONG_SQL = CELLS_SQL + """, edges AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM st AS a JOIN st AS b ON a.page = b.page AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.k <> b.k),
  reach AS (SELECT k AS node, k AS other FROM st UNION SELECT node, b FROM reach JOIN edges ON a = other), cl AS (SELECT node AS k, min(other) % 100 AS cluster FROM reach GROUP BY node)"""


def dense_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.grid_density(boxes(spark, sf_dir), ["page"], 10, 10, strong=3, weak=2)


@query(
    "CC3",
    f"""WITH RECURSIVE {BOXES_SQL}, {STRONG_SQL}, z AS (SELECT page, cluster, count(*) AS size FROM st JOIN cl USING (k) GROUP BY page, cluster), rk AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY size DESC, cluster)::INT AS rank FROM z)
    SELECT st.page, st.r::INT AS r, st.c::INT AS c, cl.cluster, rk.size, rk.rank FROM st JOIN cl USING (k) JOIN rk ON rk.page = st.page AND rk.cluster = cl.cluster""",
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.grid_components(dense_cells(spark, sf_dir).where("strong"), "page", 10).select("page", "r", "c", "cluster", "size", "rank")


GROWN_SQL = STRONG_SQL + """, w AS (SELECT * FROM g WHERE n < 3), o0 AS (SELECT page, r, c, cluster FROM st JOIN cl USING (k)),
    f1 AS (SELECT w.page, w.r, w.c, min(cluster) AS cluster FROM w JOIN o0 ON o0.page = w.page AND abs(o0.r - w.r) <= 1 AND abs(o0.c - w.c) <= 1 GROUP BY ALL),
    w2 AS (SELECT page, r, c FROM w EXCEPT SELECT page, r, c FROM f1), f2 AS (SELECT w2.page, w2.r, w2.c, min(cluster) AS cluster FROM w2 JOIN f1 ON f1.page = w2.page AND abs(f1.r - w2.r) <= 1 AND abs(f1.c - w2.c) <= 1 GROUP BY ALL)"""


@query("CC4", f"WITH RECURSIVE {BOXES_SQL}, {GROWN_SQL} SELECT page, r::INT AS r, c::INT AS c, cluster FROM (SELECT * FROM o0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT page, r, c, NULL FROM (SELECT page, r, c FROM w2 EXCEPT SELECT page, r, c FROM f2))")
def weak_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = dense_cells(spark, sf_dir)
    owned = clusters.grid_components(cells.where("strong"), "page", 10).select("page", "r", "c", "n", "cluster")
    weak = cells.where("NOT strong").select("page", "r", "c", "n", F.lit(None).cast("long").alias("cluster"))
    return clusters.grow(owned.unionAll(weak), "page", least=2).select("page", "r", "c", "cluster")


@query(
    "CC4",
    f"""WITH RECURSIVE {BOXES_SQL}, {GROWN_SQL}, un AS MATERIALIZED (SELECT page, r, c, page * 100 + r * 10 + c AS k FROM (SELECT page, r, c FROM w2 EXCEPT SELECT page, r, c FROM f2)),
    e2 AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM un AS a JOIN un AS b ON a.page = b.page AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.k <> b.k), reach2 AS (SELECT k AS node, k AS other FROM un UNION SELECT node, b FROM reach2 JOIN e2 ON a = other),
    ol AS (SELECT node AS k, min(other) % 100 AS label FROM reach2 GROUP BY node), oc AS (SELECT page, label, min(c) AS x0, max(c) + 1 AS x1, min(r) AS y0, max(r) + 1 AS y1 FROM un JOIN ol USING (k) GROUP BY page, label HAVING count(*) >= 2),
    ow AS (SELECT * FROM o0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2), gb AS (SELECT page, cluster, min(c) AS x0, max(c) + 1 AS x1, min(r) AS y0, max(r) + 1 AS y1 FROM ow GROUP BY page, cluster),
    z AS (SELECT page, cluster, row_number() OVER (PARTITION BY page ORDER BY count(*) DESC, cluster) AS rank FROM o0 GROUP BY page, cluster),
    ho AS (SELECT oc.page, label, arg_min(gb.cluster, rank) AS host FROM oc JOIN gb USING (page) JOIN z ON z.page = gb.page AND z.cluster = gb.cluster
      WHERE greatest(least(oc.x1, gb.x1) - greatest(oc.x0, gb.x0), 0) * greatest(least(oc.y1, gb.y1) - greatest(oc.y0, gb.y0), 0) >= 0.5 * (oc.x1 - oc.x0) * (oc.y1 - oc.y0) GROUP BY oc.page, label)
    SELECT page, r::INT AS r, c::INT AS c, cluster::BIGINT AS cluster, false AS orphan FROM ow UNION ALL SELECT un.page, un.r::INT, un.c::INT, coalesce(host, oc.label)::BIGINT, host IS NULL FROM un JOIN ol USING (k) JOIN oc ON oc.page = un.page AND oc.label = ol.label LEFT JOIN ho ON ho.page = oc.page AND ho.label = oc.label""",
)
def orphan_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak cells that no component reached: folded into a component whose box holds them, or seeds of their own."""
    cells = dense_cells(spark, sf_dir)
    owned = clusters.grid_components(cells.where("strong"), "page", 10)
    weak = cells.where("NOT strong").select("page", "r", "c", "n", F.lit(None).cast("long").alias("cluster"))
    grown = clusters.grow(owned.select("page", "r", "c", "n", "cluster").unionAll(weak), "page", least=2)
    return clusters.place_orphans(grown, owned, "page", 10, least=2).select("page", "r", "c", F.col("cluster").cast("long").alias("cluster"), "orphan")


@query("WN6", "SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT + 1 AS island FROM (SELECT event_id, user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 36000 THEN 1 ELSE 0 END AS new FROM (SELECT event_id, user_id, epoch_us(ts) / 1000000.0 AS t FROM events))")
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return clusters.gap_islands(e, ["user_id"], "t", 36000.0, ["event_id"]).select("event_id", "user_id", "island")


@query("WN8", "WITH g AS (SELECT user_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY value) - value AS gap FROM events) SELECT user_id, max(gap) AS gap, arg_max(value, (gap, -value)) AS starts FROM g WHERE gap IS NOT NULL GROUP BY user_id")
def largest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.largest_gap(table(spark, sf_dir, "events"), ["user_id"], "value")


SEGMENTS_SQL = "sg AS (SELECT l_suppkey AS page, l_quantity % 10 AS pos, l_extendedprice / 20 AS start, l_extendedprice / 20 + 4 + l_linenumber AS stop FROM lineitem)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("page"), (F.col("l_quantity") % 10).alias("pos"), (F.col("l_extendedprice") / 20).alias("start"), (F.col("l_extendedprice") / 20 + 4 + F.col("l_linenumber")).alias("stop"))


@query(
    "CC5",
    f"""WITH {SEGMENTS_SQL}, b AS (SELECT *, round(pos * 2)::BIGINT AS bucket FROM sg), r AS (SELECT *, max(stop) OVER (PARTITION BY page, bucket ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
    k AS (SELECT *, sum(CASE WHEN start - reach > 14 THEN 1 ELSE 0 END) OVER (PARTITION BY page, bucket ORDER BY start, stop ROWS UNBOUNDED PRECEDING)::BIGINT AS chain FROM r)
    SELECT page, bucket, count(*) AS n, round(min(start), 6) AS start, round(max(stop), 6) AS stop FROM k GROUP BY page, bucket, chain HAVING count(*) >= 3 AND max(stop) - min(start) >= 50 AND max(stop - start) <= 0.35 * (max(stop) - min(start))""",
)
def dash_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.dash_chains(segments(spark, sf_dir), ["page"])
    return found.select("page", "bucket", "n", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"))


@query("CC8", f"WITH {SEGMENTS_SQL}, r AS (SELECT *, max(stop) OVER (PARTITION BY page ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sg) SELECT page, round(reach, 6) AS gap_start, round(start, 6) AS gap_stop FROM r WHERE start > reach")
def uncovered_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.uncovered_bands(segments(spark, sf_dir), ["page"])
    return found.select("page", F.round("gap_start", 6).alias("gap_start"), F.round("gap_stop", 6).alias("gap_stop"))


@query(
    "CC12",
    f"""WITH {BOXES_SQL}, i AS (SELECT page, event_id, x * 1000 AS x, y * 1000 AS y, w * 1000 AS w, h * 1000 AS h FROM bx WHERE event_id % 10 <> 1), b AS (SELECT page, event_id AS box, x * 1000 AS bx, y * 1000 AS by0, w * 4000 AS bw, h * 4000 AS bh FROM bx WHERE event_id % 10 = 1),
    o AS (SELECT i.page, event_id, min(((x + w / 2 - bx - bw / 2) ** 2 + (y + h / 2 - by0 - bh / 2) ** 2, box)) AS best FROM i JOIN b USING (page) WHERE least(bw, bh) >= 30 AND bw * bh >= 4000 AND x + w / 2 BETWEEN bx AND bx + bw AND y + h / 2 BETWEEN by0 AND by0 + bh GROUP BY i.page, event_id)
    SELECT page, event_id, best[2] AS box FROM o""",
)
def item_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which box (every tenth event, enlarged) owns an item (the others): the nearest of those that hold its centre."""
    b = boxes(spark, sf_dir).drop("user_id")
    items = b.where("event_id % 10 <> 1").select("page", "event_id", *((F.col(k) * 1000).alias(k) for k in "xywh"))
    big = b.where("event_id % 10 = 1").select("page", F.col("event_id").alias("box"), *((F.col(k) * (1000 if k in "xy" else 4000)).alias(k) for k in "xywh"))
    return clusters.owners(items, big, "page", "event_id", "box")


@query(
    "CC10",
    f"""WITH {BOXES_SQL}, v AS (SELECT page, event_id, x * 1000 AS x, y * 1000 AS y, w * 1000 AS w, h * 1000 AS h FROM bx WHERE event_id % 10 <> 1), s AS (SELECT page, event_id AS seed, x * 1000 AS x, y * 1000 AS y, w * 1000 AS w, h * 1000 AS h FROM bx WHERE event_id % 10 = 1),
    d AS (SELECT v.*, seed, greatest(s.x - v.x - v.w / 2, v.x + v.w / 2 - s.x - s.w, 0) AS dx, greatest(s.y - v.y - v.h / 2, v.y + v.h / 2 - s.y - s.h, 0) AS dy FROM v JOIN s USING (page)),
    n AS (SELECT page, event_id, arg_min(seed, (sqrt(dx * dx + dy * dy), seed)) AS seed, any_value(x) AS x, any_value(y) AS y, any_value(w) AS w, any_value(h) AS h FROM d WHERE sqrt(dx * dx + dy * dy) <= 60 GROUP BY page, event_id),
    al AS (SELECT page, seed, x, y, w, h, 0 AS n FROM s UNION ALL SELECT page, seed, x, y, w, h, 1 FROM n)
    SELECT page, seed, sum(n)::BIGINT AS n, round(min(x), 6) AS x, round(min(y), 6) AS y, round(max(x + w) - min(x), 6) AS w, round(max(y + h) - min(y), 6) AS h FROM al GROUP BY page, seed""",
)
def grown_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed boxes (every tenth event) with the other events as vectors attached to the nearest within 60."""
    b = boxes(spark, sf_dir).select("page", "event_id", *((F.col(k) * 1000).alias(k) for k in "xywh"))
    grown = clusters.attach_vectors(b.where("event_id % 10 <> 1"), b.where("event_id % 10 = 1").withColumnRenamed("event_id", "seed"), "page", "event_id", "seed")
    return grown.select("page", "seed", "n", *(F.round(k, 6).alias(k) for k in "xywh"))


@query(
    "V16 WN6 WN8",
    """WITH e AS (SELECT user_id, event_id, (event_id % 83 * 4)::DOUBLE AS x, (event_id % 79 // 8 * CASE WHEN user_id % 2 = 0 THEN 70 ELSE 50 END + event_id % 3 + CASE WHEN user_id % 3 = 0 AND event_id % 11 = 0 THEN 900 ELSE 0 END)::DOUBLE AS y, 50.0::DOUBLE AS w, (10 + event_id % 3 * 10)::DOUBLE AS h, event_id % 13 > 0 AS participate FROM events),
    m AS (SELECT user_id, list_sort(list(h))[len(list(h)) // 2 + 1] AS m, count(*) AS n0 FROM e WHERE participate GROUP BY user_id), t AS (SELECT e.*, m, y + h / 2 AS cy, y + h / 2 - lag(y + h / 2) OVER (PARTITION BY user_id ORDER BY y + h / 2, event_id) AS d FROM e JOIN m USING (user_id) WHERE participate),
    c AS (SELECT *, sum(CASE WHEN d > 10 * m THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY cy, event_id ROWS UNBOUNDED PRECEDING) AS c FROM t),
    g AS (SELECT user_id, c FROM c GROUP BY user_id, c HAVING count(*) >= 8 AND 1 + count(*) FILTER (d > 1.5 * m AND d <= 10 * m) >= 3 AND (max(x + w) - min(x)) * (max(y + h) - min(y)) <= 250000),
    j AS (SELECT e.user_id, e.event_id, e.y + e.h / 2 AS cy, n0, g.c IS NOT NULL AS menu, e.participate AND g.c IS NULL AS stays FROM e LEFT JOIN m USING (user_id) LEFT JOIN c ON c.user_id = e.user_id AND c.event_id = e.event_id LEFT JOIN g ON g.user_id = c.user_id AND g.c = c.c),
    p AS (SELECT *, row_number() OVER w AS pos, cy - lag(cy) OVER w AS gap, bool_or(stays) OVER (PARTITION BY user_id) AS rest FROM j WINDOW w AS (PARTITION BY user_id ORDER BY cy, event_id)),
    s AS (SELECT user_id, arg_min(pos, (-gap, pos)) AS cut FROM p WHERE gap IS NOT NULL GROUP BY user_id), q AS (SELECT p.*, coalesce(pos < cut, true) AS top, count(*) OVER (PARTITION BY p.user_id, coalesce(pos < cut, true)) AS side FROM p LEFT JOIN s USING (user_id)),
    r AS (SELECT *, coalesce(n0, 0) >= 8 AND NOT rest AND side < 8 AS back FROM q)
    SELECT user_id, event_id, stays OR back AS participate, menu AND NOT back AS menu FROM r""",
)
def menu_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events on a block of 1000 by 1000: rows of a menu, on every second block too tall, on every third with keys below."""
    e, user = F.col("event_id"), F.col("user_id")
    y = F.floor(e % 79 / 8) * F.when(user % 2 == 0, 70).otherwise(50) + e % 3 + F.when((user % 3 == 0) & (e % 11 == 0), 900).otherwise(0)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (e % 83 * 4).cast("double").alias("x"), y.cast("double").alias("y"), F.lit(50.0).alias("w"), (e % 3 * 10 + 10).cast("double").alias("h"), (e % 13 > 0).alias("participate"), F.lit(1e6).alias("block_area"))
    return clusters.gray_menus(rows, "user_id", "event_id").select("user_id", "event_id", "participate", "menu")


@query("CC9")
def seed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.merge_seeds(boxes(spark, sf_dir).drop("user_id"), "page", "event_id")


@query("WN7")
def reading_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.reading_rows(boxes(spark, sf_dir).drop("user_id"), "page", "event_id", least=0.01)


@query("CC6 AG13", _clustered(_near(0.007)) + " SELECT page, cluster, count(*) AS n, min(x) AS x, round(max(x + w) - min(x), 9) AS w FROM bx JOIN cl USING (event_id) GROUP BY page, cluster HAVING count(*) >= 2")
def exclusion_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.exclusion_zones(boxes(spark, sf_dir), "page", "event_id", 0.007).select("page", "cluster", "n", "x", F.round("w", 9).alias("w"))


BRIDGE_SQL = """pt AS MATERIALIZED (SELECT page, event_id, x * 0.8 AS x, y * 0.8 AS y, w, h, 1 + event_id % 4 AS n FROM bx WHERE event_id % 3 <> 1), ln AS (SELECT page, event_id AS line, x * 0.7 AS lx, y * 0.8 + 0.01 AS ly, w * 5 AS lw, 0.001::DOUBLE AS lh FROM bx WHERE event_id % 3 = 1),
  mt AS (SELECT pt.*, line, lx, ly, lw, lh FROM pt JOIN ln USING (page) WHERE lx <= x + w AND x <= lx + lw AND ly <= y + h AND y <= ly + lh),
  pr AS (SELECT a.event_id AS a, b.event_id AS b, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS sx, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS sy, least(a.h, b.h) AS mh, least(a.w, b.w) AS mw, a.n AS na, b.n AS nb,
    least(a.lx + a.lw, a.x + a.w) - greatest(a.lx, a.x) + least(a.lx + a.lw, b.x + b.w) - greatest(a.lx, b.x) AS ix, least(a.ly + a.lh, a.y + a.h) - greatest(a.ly, a.y) + least(a.ly + a.lh, b.y + b.h) - greatest(a.ly, b.y) AS iy
    FROM mt AS a JOIN mt AS b ON a.page = b.page AND a.line = b.line AND a.event_id < b.event_id),
  ok AS (SELECT a, b FROM pr WHERE NOT (sx > 0 AND sy > 0) AND (sy >= 0.7 * mh OR sx >= 0.7 * mw) AND greatest(-sx, -sy) <= 0.05 AND least(na, nb) >= 0.30 * greatest(na, nb) AND CASE WHEN sy >= 0.7 * mh THEN ix ELSE iy END >= 0.03),
  edges AS MATERIALIZED (SELECT a, b FROM ok UNION SELECT b, a FROM ok)"""


@query("CC7", f"WITH RECURSIVE {BOXES_SQL}, {BRIDGE_SQL}, {REACH.format(name='reach', key='event_id', items='pt')} SELECT node AS event_id, min(other) AS cluster FROM reach GROUP BY node")
def bridge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event is a line, the others are parts."""
    b = boxes(spark, sf_dir).drop("user_id")
    parts = b.where("event_id % 3 <> 1").select("page", "event_id", (F.col("x") * 0.8).alias("x"), (F.col("y") * 0.8).alias("y"), "w", "h", (1 + F.col("event_id") % 4).alias("n"))
    lines = b.where("event_id % 3 = 1").select("page", F.col("event_id").alias("line"), (F.col("x") * 0.7).alias("x"), (F.col("y") * 0.8 + 0.01).alias("y"), (F.col("w") * 5).alias("w"), F.lit(0.001).alias("h"))
    return clusters.bridge_merge(parts, lines, "page", "event_id", "line", 0.05, 0.03, 0.003).select("event_id", "cluster")
