"""Record store: trees, fingerprints, latest versions, snapshots, overrides, tolerant JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, written


def fingerprint(df: DataFrame, by: list[str], cells: list[Column]) -> DataFrame:
    """SHA-256 (upper hex) of each group's rows: cells joined by |, rows in binary order joined by line breaks."""
    row = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells])
    text = F.array_join(F.array_sort(F.collect_list(row)), "\n")
    return df.groupBy(*by).agg(F.upper(F.sha2(text, 256)).alias("fingerprint"))


def box_text(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A box as four numbers of four decimals, "-" if any is null."""
    parts = [F.format_string("%.4f", c) for c in (x, y, w, h)]
    return F.when(x.isNull() | y.isNull() | w.isNull() | h.isNull(), "-").otherwise(F.concat_ws(",", *parts))


def roots(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """nodes with parent nulled where it doesn't exist: orphans become roots."""
    known = nodes.select(F.col(key).alias("__known")).distinct()
    joined = nodes.join(known, nodes[parent] == known["__known"], "left")
    return joined.withColumn(parent, F.when(F.col("__known").isNotNull(), F.col(parent))).drop("__known")


def effectively_active(nodes: DataFrame, key: str, parent: str, active: str) -> DataFrame:
    """nodes with effective: active, and so is every ancestor. A parent that doesn't exist makes its children inactive.

    Each round a node learns of twice as many ancestors, so a tree of depth d takes log2(d) rounds, each written out; only
    nodes that have ancestors left go into the next. A cycle of parents is an error.
    """
    scratch = Scratch(nodes.sparkSession)
    count, rounds = nodes.count(), 0
    known = nodes.select(F.col(key).alias("__k"), F.coalesce(F.col(active), F.lit(False)).alias("__a"), F.col(parent).alias("__up"))
    while not known.where("__up IS NOT NULL").isEmpty():
        if 1 << rounds > 2 * count:
            raise ValueError("the parents form a cycle")
        above = known.select(F.col("__k").alias("__key"), F.col("__a").alias("__above"), F.col("__up").alias("__next"))
        joined = known.join(above, F.col("__up") == F.col("__key"), "left")
        ok = F.col("__a") & (F.col("__up").isNull() | F.coalesce("__above", F.lit(False)))
        known = scratch.written(joined.select("__k", ok.alias("__a"), F.when(ok, F.col("__next")).alias("__up")), "ancestors")
        rounds += 1
    out = nodes.join(known.select("__k", F.col("__a").alias("effective")), nodes[key] == F.col("__k")).drop("__k")
    return out if not rounds else _kept(out, scratch)


def _kept(df: DataFrame, scratch: Scratch) -> DataFrame:
    """df written out, so that the tables it comes from can go."""
    out = written(df, "kept")
    scratch.clear()
    return out


def latest_profile(profiles: DataFrame, wanted: DataFrame, key: str, order: str) -> DataFrame:
    """For every wanted key the newest profile of exactly that key, else of one that starts with it.

    Profiles are joined on their starts of the lengths that wanted keys have.
    """
    lengths = wanted.agg(F.collect_set(F.length("wanted")).alias("__lengths"))
    p = profiles.select(F.col(key).alias("__key"), F.col(order).alias("__order")).join(F.broadcast(lengths))
    starts = F.transform(F.filter("__lengths", lambda n: n <= F.length("__key")), lambda n: F.substring(F.col("__key"), F.lit(1), n))
    joined = p.select("__key", "__order", F.explode(starts).alias("wanted")).join(wanted.select("wanted").distinct(), "wanted")
    tier = F.when(F.col("__key") == F.col("wanted"), 0).otherwise(1)
    best = joined.groupBy("wanted").agg(F.min_by(F.struct("__key", "__order", tier.alias("tier")), F.struct(tier, -F.col("__order"))).alias("b"))
    return best.select("wanted", F.col("b.__key").alias("found"), F.col("b.__order").alias("id"), "b.tier")


def attach(blocks: DataFrame, elements: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """blocks with their elements' texts in order; none is an empty list."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda e: e[text])
    grouped = elements.groupBy(key).agg(texts.alias("elements"))
    return blocks.join(grouped, key, "left").withColumn("elements", F.coalesce("elements", F.expr("CAST(array() AS array<string>)")))


def replace_partitions(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """old without the partitions that new has, and new: the snapshot after a replacement."""
    return old.join(new.select(*by).distinct(), by, "left_anti").unionByName(new)


def keep_reviews(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new with the review of the old row of its key where the fingerprints agree."""
    o = old.select(F.col(key).alias("__key"), F.col("fingerprint").alias("__fp"), F.col("review").alias("__review"))
    joined = new.join(o, new[key] == o["__key"], "left")
    return joined.withColumn("review", F.when(F.col("fingerprint") == F.col("__fp"), F.col("__review"))).drop("__key", "__fp", "__review")


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the rows of the parents in gone."""
    ids = gone.select(F.col(key).alias("__gone")).distinct()
    return parents.join(ids, parents[key] == ids["__gone"], "left_anti"), children.join(ids, children[child_key] == ids["__gone"], "left_anti")


def override(elements: DataFrame, drops: DataFrame, replacements: DataFrame, key: str, text: str) -> DataFrame:
    """elements without dropped keys, with replaced texts."""
    kept = elements.join(drops.select(key).distinct(), key, "left_anti")
    return kept.join(replacements.select(key, F.col("replacement")), key, "left").withColumn(text, F.coalesce("replacement", text)).drop("replacement")


def json_array_length(text: Column) -> Column:
    """Length of a JSON array; 0 for anything else."""
    return F.coalesce(F.json_array_length(text), F.lit(0))


def json_field(text: Column, *names: str) -> Column:
    """The first of the names that the JSON object has (as text); null for broken documents."""
    return F.coalesce(*[F.get_json_object(text, f"$.{n}") for n in names])


def newest_then(df: DataFrame, by: list[str], order: list[Column], n: int, condition: Column) -> DataFrame:
    """The condition among the newest n rows of a group only: the limit comes first."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__r", rank).where(F.col("__r") <= n).where(condition).drop("__r")


def distinct_pairs(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row for each pair, with its least order and the columns of that row."""
    first = F.min_by(F.struct(*columns), order)
    return df.groupBy(*by).agg(F.min(order).alias(order), first.alias("__f")).select(*by, order, *(F.col(f"__f.{c}").alias(c) for c in columns))


def text_runs(spans: DataFrame, by: list[str]) -> DataFrame:
    """Spans of a block in reading order: joined text, the box around them, and the first angle."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "id", "text", "angle")))
    grouped = spans.groupBy(*by).agg(ordered.alias("s"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("b"))
    text = F.array_join(F.transform("s", lambda s: s["text"]), "")
    return grouped.select(*by, text.alias("text"), "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("b") - F.col("y")).alias("h"), F.col("s")[0]["angle"].alias("angle"))
