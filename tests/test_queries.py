"""Every query of the engine against its SQL, and those without SQL against brute force."""

import itertools
import os

import pytest
from oracle import SF, duckdb_rows, spark_rows

from plumbline.plans import registry

registry.load()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(registry.QUERIES[name](spark, SF)) == duckdb_rows(registry.SQL[name])


def same_on(spark, folder, name, table, rows):
    """Whether a query equals its SQL on a table of these rows."""
    rows.write.parquet(f"{folder}/{table}.parquet", mode="overwrite")
    one = rows.toPandas()
    os.makedirs(f"{folder}/plain", exist_ok=True)
    one.to_parquet(f"{folder}/plain/{table}.parquet")
    got = spark_rows(registry.QUERIES[name](spark, str(folder)))
    return got[1] and got == duckdb_rows(registry.SQL[name], f"{folder}/plain")


def test_groups_with_too_few_codes_have_no_assignment(spark, tmp_path):
    rows = [(k, 0, [((k * 37) % 11) / 8.0, (k * 5 % 7) / 8.0, (k * 13 % 9) / 8.0, (k * 3 % 5) / 8.0]) for k in range(16)]
    assert same_on(spark, tmp_path, "assignment", "embeddings", spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))


def test_totals_that_round_to_the_same_are_equal(spark):
    from plumbline.operators.geometry import _best

    cost = {(i, j): d for i in range(4) for j, d in enumerate((0.1, 0.4, 0.3, 2.3))}
    totals = {c: ((cost[0, c[0]] + cost[1, c[1]]) + cost[2, c[2]]) + cost[3, c[3]] for c in itertools.permutations(range(4))}
    assert _best([0, 1, 2, 3], [0, 1, 2, 3], cost) == list(enumerate(min(totals, key=lambda c: (totals[c], c))))


def test_bridges_at_the_least_reach_are_as_in_sql(spark, tmp_path):
    events = [(k, 7) for k in (1122098, 1156226, 1185772, 2105404, 2172476, 2175873)]
    assert same_on(spark, tmp_path, "bridge_merge", "events", spark.createDataFrame(events, "event_id long, user_id long"))


def test_close_texts_are_compared_once_and_never_broadcast(spark):
    from plumbline.operators.matching import edit_join

    texts = [(1, "ABCDEF"), (2, "ABCDEF"), (2, "ABCDEF"), (3, "ABCDEG"), (4, "ABCDE"), (5, "ABCDEFF"), (6, "BACDEF"), (7, None)]
    rows = spark.createDataFrame(texts, "id long, x string")
    joined = edit_join(rows.withColumnRenamed("id", "a"), rows.select(rows.id.alias("b"), rows.x.alias("y")), "x", "y").where("a < b")
    assert sorted((r.a, r.b, r.distance) for r in joined.collect()) == [(1, 2, 0), (1, 2, 0), (1, 3, 1), (1, 5, 1), (2, 3, 1), (2, 3, 1), (2, 5, 1), (2, 5, 1)]
    plan = joined._jdf.queryExecution().optimizedPlan().toString() + joined._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_extras_are_looked_up_from_the_photos_own_texts(spark):
    from plumbline.operators.matching import extras

    photos = spark.createDataFrame([(p, k, t, t) for p, ts in ((1, ("INPUT", "VALVES", "XY", "GONE")), (2, ("INPUT", "OTHER", "A12345"))) for k, t in enumerate(ts)], "photo long, ordinal long, key string, text string")
    judged = spark.createDataFrame([(1, "IN", "green", None), (1, "VALVE", "red", None), (1, "Q", "green", "GONE"), (2, "IN", "gray", None), (2, "OTHERS", "red", None)], "photo long, key string, colour string, photo_text string")
    found = extras(photos, judged)
    assert sorted((r.photo, r.key, r.colour) for r in found.collect()) == [(1, "XY", "yellow"), (2, "A12345", "gray"), (2, "INPUT", "yellow")]
    assert "Join LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()  # keys of all photos aren't joined with texts of all photos


def test_common_offsets_are_the_same_in_any_order_of_rows(spark):
    from plumbline.operators.geometry import consensus

    orders = list(itertools.permutations((0.1, 0.2, 0.3)))
    rows = spark.createDataFrame([(g, d, -d) for g, o in enumerate(orders) for d in o], "g long, dx double, dy double").coalesce(1)
    got = consensus(rows, "g").collect()
    assert len(got) == 6 and {(r.n, r.dx, r.dy) for r in got} == {(3, 0.6 / 3, -0.6 / 3)}
    far = spark.createDataFrame([(1, 1e30, 0.0), (1, 1e30, 0.0), (2, float("nan"), 0.0), (2, 1.0, 0.0), (2, 1.0, 0.0)], "g long, dx double, dy double")
    assert sorted((r.g, r.n, r.dx) for r in consensus(far, "g").collect()) == [(1, 2, 1e30), (2, 2, 1.0)]


def test_every_query_names_its_operators():
    assert set(registry.OPERATORS) == set(registry.QUERIES)


def test_assignment_is_the_best_of_all(spark):
    from plumbline.operators.geometry import assign

    cost = {(1, 7): 0.3, (1, 8): 0.1, (2, 7): 0.9, (2, 8): 0.2, (3, 7): 0.25}
    rows = [("g", i, j, d) for (i, j), d in cost.items()] + [("h", 1, 1, 5.0)]
    got = assign(spark.createDataFrame(rows, "g string, i long, j long, d double"), "g").collect()
    best = min((sum(cost[p] for p in zip(c, (7, 8)) if p in cost), c) for c in itertools.permutations((1, 2, 3), 2) if all(p in cost for p in zip(c, (7, 8))))
    assert sorted((r.i, r.j) for r in got if r.g == "g") == sorted(zip(best[1], (7, 8)))
    assert [(r.i, r.j) for r in got if r.g == "h"] == [(1, 1)]


def test_large_assignment_is_greedy_and_one_to_one(spark):
    from plumbline.operators.geometry import assign

    rows = [("g", i, j, abs(i - j) + i / 100) for i in range(10) for j in range(10)]
    got = assign(spark.createDataFrame(rows, "g string, i long, j long, d double"), "g").collect()
    assert sorted((r.i, r.j) for r in got) == [(k, k) for k in range(10)]


def test_page_steps(spark):
    from plumbline.operators import clusters

    rows = [(1, 1, 0.0, 0.0, 1.0, 1.0), (1, 2, 0.1, 0.0, 0.9, 1.0), (1, 3, 5.0, 0.0, 1.0, 1.0), (1, 4, 5.2, 0.2, 0.3, 0.3)]
    boxes = spark.createDataFrame(rows, "page long, id long, x double, y double, w double, h double")
    assert {r.id: r.seed for r in clusters.merge_seeds(boxes, "page", "id").collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    lines = {r.id: r.row for r in clusters.reading_rows(boxes, "page", "id", least=0.05).collect()}
    assert lines[1] == lines[2] == lines[3]


def test_missing_elements_are_placed_by_the_found_ones(spark):
    from plumbline.operators.matching import place_missing

    def row(block, k, u, v, found):
        return (block, k, u, v, 0.1, 0.1, 0.5 * u + 0.2 if found else None, 0.4 * v + 0.1 if found else None, not found)

    rows = [row(1, k, u, v, True) for k, (u, v) in enumerate([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0)])] + [row(1, 9, 0.5, 0.5, False)]
    rows += [row(2, 1, 0.0, 0.0, True), row(2, 2, 1.0, 1.0, True), row(2, 3, 0.5, 0.5, False), row(3, 1, 0.3, 0.3, True), row(3, 2, 0.4, 0.4, False)]
    kinds = "block long, element long, u double, v double, bw double, bh double, px double, py double, missing boolean"
    got = {(r.block, r.element): (round(r.x + r.w / 2, 6), round(r.y + r.h / 2, 6), r.level) for r in place_missing(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {(1, 9): (0.45, 0.3, "L2"), (2, 3): (0.45, 0.3, "L1")}


def test_components_of_an_ascending_path_take_few_rounds(spark, monkeypatch):
    from plumbline.operators import components
    from plumbline.session import Scratch

    edges = spark.range(4999).selectExpr("id AS a", "id + 1 AS b").union(spark.range(6000, 6100).selectExpr("6000L AS a", "id AS b"))
    scratch = Scratch(spark)
    found = components.components(edges, scratch)
    assert sorted(found.groupBy("root").count().toPandas()["count"]) == [100, 5000]
    assert len(scratch.paths) <= 70  # about two tables a round, and the merged ones
    scratch.clear()


def test_nothing_goes_out_that_is_not_there(spark):
    from plumbline.operators import ledger

    rows = [("a", 1, "out", 5.0), ("a", 2, "in", 10.0), ("a", 3, "out", 4.0), ("a", 4, "out", 7.0), ("a", 5, "out", 6.0), ("b", 1, "in", None), ("b", 2, "out", 1e-10), (None, 1, "in", 2.0), (None, 2, "out", 3.0)]
    got = ledger.guard(spark.createDataFrame(rows, "m string, k int, direction string, qty double"), "m", ["k"]).collect()
    assert {(r.m, r.k): (r.accepted, round(r.balance, 6)) for r in got} == {
        ("a", 1): (False, 0.0), ("a", 2): (True, 10.0), ("a", 3): (True, 6.0), ("a", 4): (False, 6.0), ("a", 5): (True, 0.0), ("b", 1): (True, 0.0), ("b", 2): (True, 0.0), (None, 1): (True, 2.0), (None, 2): (False, 2.0)
    }
    assert ledger.guard(spark.createDataFrame([], "m string, k int, direction string, qty double"), "m", ["k"]).count() == 0


def test_ancestors_of_any_depth_and_short_keys(spark):
    from plumbline.operators import store

    nodes = spark.createDataFrame([(k, k - 1 if k else None, k != 7) for k in range(40)] + [(90, 91, True), (95, None, True)], "id long, up long, active boolean")
    assert {r.id for r in store.effectively_active(nodes, "id", "up", "active").where("effective").collect()} == {*range(7), 95}
    with pytest.raises(ValueError, match="cycle"):
        store.effectively_active(spark.createDataFrame([(1, 2, True), (2, 1, True)], "id long, up long, active boolean"), "id", "up", "active")
    profiles = spark.createDataFrame([(1, "ABCDEF"), (2, "ABX"), (3, "AB C")], "id long, k string")
    wanted = spark.createDataFrame([("AB",), ("ABX",), ("Z",)], "wanted string")
    assert {r.wanted: (r.found, r.id, r.tier) for r in store.latest_profile(profiles, wanted, "k", "id").collect()} == {"AB": ("AB C", 3, 1), "ABX": ("ABX", 2, 0)}


def test_clauses_of_many_items_lose_none(spark):
    from pyspark.sql import functions as F

    from plumbline.functions.text import clause_items

    clause = "x:" + ";".join(f"{k % 99 + 1}、item {k}" for k in range(1500))
    assert spark.range(1).select(F.size(clause_items(F.lit(clause))).alias("n")).first().n == 1500


def test_contained_texts_equal_brute_force(spark):
    import random

    from plumbline.operators.matching import contains_join

    random.seed(1)
    hosts = [(k, "".join(random.choices("ab c,é\n", k=random.randint(0, 40)))) for k in range(150)] + [(900, None)]
    needles = [(k, "".join(random.choices("ab c,é", k=random.randint(0, 7)))) for k in range(150)] + [(900, None)]
    h, n = spark.createDataFrame(hosts, "h long, text string"), spark.createDataFrame(needles, "n long, needle string")
    got = [(r.h, r.n) for r in contains_join(h, n, "text", "needle", "h", "n", least=3).collect()]
    assert sorted(got) == sorted((a, b) for a, t in hosts for b, s in needles if t and s and len(s) >= 3 and s in t)


def test_fragments_of_a_line_are_merged(spark):
    from plumbline.operators import drawings

    rows = [(1, 1, "服务热线", 0.9, 10.0, 100.0, 110.0, 120.0), (1, 2, "4008", 0.8, 115.0, 102.0, 160.0, 121.0), (1, 3, "far", 0.7, 300.0, 100.0, 340.0, 120.0), (1, 4, "LOW", 0.9, 10.0, 200.0, 50.0, 220.0), (1, 5, "VOLTAGE", 0.6, 55.0, 200.0, 120.0, 220.0), (2, 6, "MAC:", 0.5, 0.0, 0.0, 40.0, 9.0), (2, 7, "A4", 0.6, 41.0, 0.0, 60.0, 9.0)]
    texts = spark.createDataFrame([(*r, 1000.0, 800.0) for r in rows], "page long, id long, text string, conf double, x0 double, y0 double, x1 double, y1 double, width double, height double")
    got = {r.id: (r.n, r.text, r.conf, r.x1) for r in drawings.merge_fragments(texts, "page", "id").collect()}
    assert got == {1: (2, "服务热线4008", 0.8, 160.0), 3: (1, "far", 0.7, 340.0), 4: (2, "LOW VOLTAGE", 0.6, 120.0), 6: (2, "MAC:A4", 0.5, 60.0)}


def test_records_of_an_image(spark):
    from plumbline.operators import drawings

    images = {
        1: ["子件编码：1102040009", "子件名称：包装箱 大号", "2026-03-14"],
        2: ["1102040009 包装箱", "1102040010", "垫片", "1102040011"],
        3: ["螺丝 M3", "1102040009", "经手人：张三"],
        4: ["1102040009", "上盖", "1102040010"],
        5: ["数量", ""],
    }
    rows = spark.createDataFrame([(i, k, s) for i, r in images.items() for k, s in enumerate(r)], "image long, row long, text string")
    got = sorted((r.image, r.seq, r.code, r.info) for r in drawings.parse_records(rows).collect())
    assert got == [
        (1, 0, "1102040009", "包装箱 大号"), (2, 0, "1102040009", "包装箱"), (2, 1, "1102040010", "垫片"), (2, 2, "1102040011", ""), (3, 0, "1102040009", "螺丝 M3"),
        (4, 0, "1102040009", "上盖"), (4, 1, "1102040010", ""), (5, 0, "", ""),
    ]


def test_corridors_and_cuts(spark):
    from plumbline.operators import drawings

    cells = spark.createDataFrame([(1, 1, r, c) for r in (0, 1, 2, 4, 5, 6) for c in range(3)] + [(2, 5, r, c) for r in range(6) for c in range(2)], "page long, comp long, r long, c long")
    lines = [(1, 0.0, 72.0, 72.0, 73.0), (1, 0.0, 95.0, 72.0, 96.0), (1, 5.0, 0.0, 60.0, 60.0), (1, 5.0, 100.0, 60.0, 165.0), (2, 0.0, 0.0, 48.0, 144.0)]
    rects = spark.createDataFrame(lines, "page long, x0 double, y0 double, x1 double, y1 double")
    got = {(r.page, r.r, r.c): r.part for r in drawings.split_corridors(cells, rects, "page", "comp").collect()}
    assert len(got) == 30 and {got[1, r, c] for r in (0, 1, 2) for c in range(3)} == {0} and {got[1, r, c] for r in (4, 5, 6) for c in range(3)} == {1} and {v for k, v in got.items() if k[0] == 2} == {0}
    seeds = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0), (1, 2, 90.0, 10.0, 101.0, 20.0)], "page long, seed long, x0 double, y0 double, x1 double, y1 double")
    shapes = spark.createDataFrame([(1, x + 0.0, y * 20.0, x + 10.0, y * 20.0 + 20) for x in (0, 20, 30, 70, 85) for y in range(5)], "page long, x0 double, y0 double, x1 double, y1 double")
    pieces = sorted((r.x0, r.x1, r.n) for r in drawings.xy_cut(seeds, shapes, "page", "seed", least=6).collect())
    assert pieces == [(0.0, 55.0, 15), (55.0, 101.0, 10)]


def test_marks_of_one_spot_are_one(spark):
    from plumbline.operators import drawings

    def mark(i, spans, images, view, x, conf, text="t"):
        return (1, i, "Text", text, 0, view, spans, images, x, 0.0, 1.0, 1.0, conf)

    rows = [mark(1, ["a"], [], "v", 0.0, 0.5), mark(2, ["a"], [], "w", 9.0, 0.9), mark(3, ["b"], [], "w", 9.01, 0.4), mark(4, ["b"], [], "v", 9.0, 0.4), mark(5, [], ["i"], "x", 50.0, 0.9), mark(6, [], ["i"], "y", 60.0, 0.9), mark(7, ["a"], [], "w", 9.0, 0.1, "other")]
    marks = spark.createDataFrame(rows, "drawing long, id long, type string, text string, page int, view string, spans array<string>, images array<string>, x double, y double, w double, h double, confidence double")
    assert sorted(r.id for r in drawings.same_spots(marks).collect()) == [2, 4, 5, 7]


def test_codes_are_taken_once(spark):
    from plumbline.operators import verdicts

    marks = [("p", 1, 0.1, 0.1, 0.05, False, True), ("p", 2, 0.12, 0.1, 0.05, False, True), ("p", 3, 0.1, 0.1, 0.05, True, True), ("p", 4, 0.9, 0.9, 0.05, False, False), ("p", 5, 0.9, 0.9, 0.05, False, False), ("p", 6, None, 0.9, 0.05, False, True), ("q", 7, 0.5, 0.5, 0.05, False, False)]
    codes = [("p", 11, 0.13, 0.1), ("p", 12, 0.15, 0.1), ("p", 13, 0.5, 0.5), ("r", 14, 0.1, 0.1)]
    m = spark.createDataFrame(marks, "photo string, mark long, ex double, ey double, tol double, found boolean, trusted boolean")
    got = {r.mark: (r.code, r.nearest and round(r.nearest, 6), r.second and round(r.second, 6), r.any_code) for r in verdicts.claim_codes(m, spark.createDataFrame(codes, "photo string, code long, cx double, cy double"), "photo").collect()}
    assert got == {1: (11, 0.03, 0.05, False), 2: (12, 0.03, None, False), 3: (None, None, None, False), 4: (13, None, None, True), 5: (None, None, None, False), 6: (None, None, None, False), 7: (None, None, None, False)}


def test_queries_without_sql_run(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.SQL)):
        assert registry.QUERIES[name](spark, SF).count() >= 0


@pytest.mark.parametrize("name", ["seed_merge", "reading_rows"])
def test_page_queries_without_sql_see_all_events(spark, name):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = registry.QUERIES[name](spark, SF)
    assert sorted(r.event_id for r in got.select("event_id").collect()) == sorted(r.event_id for r in events.select("event_id").collect())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
