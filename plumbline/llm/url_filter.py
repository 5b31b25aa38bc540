"""URL filter in DataFrame functions only: rules by host and path, and a classifier on hashed character n-grams.

The classifier is a logistic regression over the hashed character n-grams of host and path, trained on the small table
of labelled URLs below (or any other): Spark computes the n-grams' buckets, the driver fits one weight for each bucket,
and scoring sums the weights with array functions. A URL is judged by itself; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
GRAMS = (3, 4, 5)
#: Gradient steps, their size, and the ridge penalty of the fit.
STEPS, RATE, PENALTY = 400, 2.0, 1e-3
#: A URL is blocked from this probability on.
THRESHOLD = 0.7

# The labelled hosts, invented; labelled_urls() builds the URL table from them.
BLOCKED = (
    "casino-royal", "best-casino", "casino24", "online-casino", "casino-bonus", "big-win", "win-prize", "winners-lotto",
    "poker-bets", "bonus-bets", "sports-bets", "bet-now", "bets365x", "free-spins", "cheap-tablets", "buy-pills",
    "pills-online", "pills-shop", "discount-pharma", "weight-loss-pills", "cheap-meds", "cheap-watches", "cheap-loans", "adult-cams",
    "adult-zone", "xxx-tube", "adult-dating", "sexy-cams", "porn-hub-x", "hot-adult", "spam-mail", "spam-king",
    "link-farm", "content-farm", "spam-links", "seo-farm", "click-farm", "ads-server", "track-clicks", "ad-track",
    "ads-network", "ads-tracker", "click-track", "popads", "free-gift-cards", "free-money", "get-rich-quick", "crypto-giveaway",
    "free-iphone", "payday-loan", "warez-crack", "torrent-crack", "phish-login", "malware-download", "hot-deals-now", "spam-blog",
)
ALLOWED = (
    "news", "dailynews", "gardening", "weather", "library", "university", "museum", "school",
    "encyclopedia", "archive", "recipes", "health", "travel", "city", "government", "results",
    "maps", "history", "science", "forum", "music", "theatre", "station", "bank",
    "hospital", "teacher", "thinking", "notes", "weather-station", "the-hen", "thread", "ton",
    "nation", "mothers", "others", "reading", "thesis", "ration", "thorn", "anthem",
    "thunder", "brother", "rathole", "caution", "stone", "weaver", "lantern", "gather",
    "sand", "father", "hearth", "then", "leather", "ribbon", "heather", "erhart",
)
PREFIXES = ("", "www.", "blog.", "m.")
SUFFIXES = (".example.com", ".example.net", ".example.org", ".test")
PATHS = ("", "/", "/en/1", "/fr/25.html", "/de/376/", "/es/848", "/en/7", "/article/2024/a-b", "/about")


@dataclass(frozen=True)
class Rule:
    """Holds for host and its subdomains where the URL's path starts with path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty for null or without "://"."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; empty for null or without "://"."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def buckets(host: Column, path: Column) -> Column:
    """Buckets of the n-grams of "^host/path$", one for each occurrence."""
    text = F.concat(F.lit("^"), host, path, F.lit("$"))

    def grams(n: int) -> Column:
        """One pass over the text finds the n-gram at every position."""
        return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)))

    return F.flatten(F.array(*map(grams, GRAMS)))


@dataclass(frozen=True)
class UrlModel:
    """One weight for each bucket, and the intercept."""

    weights: tuple[float, ...]
    intercept: float

    def probability(self, host: Column, path: Column) -> Column:
        """How likely the URL is one to block: the logistic of the n-grams' mean weight."""
        weights = F.expr(f"array({','.join(f'{w:.6g}D' for w in self.weights)})")
        found = buckets(host, path)
        total = F.aggregate(F.transform(found, lambda b: F.element_at(weights, (b + 1).cast("int"))), F.lit(0.0), lambda a, b: a + b)
        return 1 / (1 + F.exp(-(total / F.greatest(F.size(found), F.lit(1)) + self.intercept)))


def labelled_urls(blocked: tuple[str, ...] = BLOCKED, allowed: tuple[str, ...] = ALLOWED) -> list[tuple[str, int]]:
    """Five URLs of every host, 1 for hosts to block: prefixes, suffixes and paths go round alike in both classes."""
    return [
        ("https://" + PREFIXES[(k + j) % len(PREFIXES)] + host + SUFFIXES[(k + 2 * j) % len(SUFFIXES)] + PATHS[(k + j) % len(PATHS)], label)
        for hosts, label in ((blocked, 1), (allowed, 0))
        for k, host in enumerate(hosts)
        for j in range(5)
    ]


def train(spark: SparkSession, rows: list[tuple[str, int]] | None = None) -> UrlModel:
    """Fit on labelled URLs; the table is small and given, so the driver fits it."""
    values = ", ".join("('{}', {})".format(u.replace("\\", "\\\\").replace("'", "\\'"), y) for u, y in rows or labelled_urls())
    labelled = spark.sql(f"SELECT * FROM VALUES {values} AS t(url, y)")
    got = labelled.select(buckets(host_of(F.col("url")), path_of(F.col("url"))).alias("b"), "y").collect()
    x = np.zeros((len(got), BUCKETS))
    for k, row in enumerate(got):
        np.add.at(x[k], row.b, 1 / max(1, len(row.b)))
    y = np.array([row.y for row in got], dtype=float)
    scale = float(np.sqrt((x**2).sum(axis=1)).mean()) or 1.0
    weights, intercept = np.zeros(BUCKETS), 0.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(x @ weights / scale + intercept)))
        weights -= RATE * (x.T @ (p - y) / scale / len(y) * 10 + PENALTY * weights)
        intercept -= 0.1 * float((p - y).mean())
    return UrlModel(tuple(weights / scale), intercept)


def judge(pages: DataFrame, model: UrlModel, rules: list[Rule], *, url: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """pages with host, path, rule (name of the longest fitting rule, else null), block_probability and verdict.

    The verdict is the rule's, else "block" from the model's threshold on and "allow" below it. A URL that is null or
    has no "://" has an empty host and path, fits no rule, and is allowed. Of rules equally long, the first in
    alphabetical order wins. Rules are a short list (each is an expression of the plan). Columns with the new names are
    replaced, the URL's own as well if it has such a name; rows are neither merged nor dropped.
    """
    kept = pages.withColumn("__url", F.col(url)).drop("host", "path", "rule", "block_probability", "verdict")
    parts = kept.withColumn("host", host_of(F.col("__url"))).withColumn("path", path_of(F.col("__url"))).drop("__url")
    host, path = F.col("host"), F.col("path")
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    rule = F.coalesce(*[F.when(r.fits(host, path), F.lit(r.name)) for r in ordered], F.lit(None).cast("string"))
    by_rule = F.coalesce(*[F.when(F.col("rule") == r.name, F.lit(r.verdict)) for r in ordered], F.lit(None).cast("string"))
    scored = parts.withColumn("rule", rule).withColumn("block_probability", F.when((host == "") & (path == ""), F.lit(0.0)).otherwise(model.probability(host, path)))
    return scored.withColumn("verdict", F.coalesce(by_rule, F.when(F.col("block_probability") >= threshold, F.lit("block")).otherwise(F.lit("allow"))))
