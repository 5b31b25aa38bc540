"""N-gram Jaccard join with signature trees.

A document's set is the set of its word shingles. Documents with equal sets are one class from the start. Two sets of
Jaccard similarity t share a token among the first n - ceil(t n) + 1 of each in any common order; so sets that share such
a prefix token form a group, and all links lie inside groups. The order is by hash, with tokens that many sets hold last:
these are counted over all documents, and only the order depends on them, never the result.

Inside a group the sets are leaves of a signature tree: a node holds the OR of its leaves' token bitmaps, their range of
sizes, and how many tokens its bitmaps hide at most. A dual traversal drops a pair of nodes when its sizes are too far
apart or when the most that the bitmaps allow in common is too little, and also when both are one component already. What is
left are candidate pairs, also bounded by where the token stands in both sets. A group reports only a spanning forest of
them, never all its pairs. The forests' components are families: any two linked sets are in one. A family's sets then
meet once, whole, in a second signature tree with larger bitmaps, whose leaves are compared token by token; it reports a
spanning forest of true links. So no link between different components is lost.

Groups of more than GROUP_BYTES, and families of more than FAMILY_BYTES, are dealt out as pairs of chunks, so that a task
holds two chunks at a time. Both count all that a set takes up in a worker: tokens, bitmaps, and SET_BYTES for the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import Scratch, written
from .common import LOWER, SPACE_BYTES, bounded_batches, map_batches, mix, ragged, schema_with, shingle_hashes, span_hashes, text_slices, word_spans

WORDS = 5
PERCENT = 80
#: Tokens whose hash is in this lowest share are counted; prefixes rarely reach beyond.
COUNTED_SHARE = 0.2
#: A counted token that more sets hold comes last in the order; of more than COMMON_TOKENS such, the most common do.
COMMON_SETS = 64
COMMON_TOKENS = 400_000
BITS = 2048
#: What a set takes up in a worker besides its tokens and bitmaps.
SET_BYTES = 256
GROUP_BYTES = 4 << 20
#: Sets of more tokens also carry a bitmap of their prefix, as the bitmap of all tokens fills up.
LONG_SET = 1000
#: Size of the filter that finds the documents whose full sets are needed.
FILTER_BITS = 1 << 25
FAMILY_BYTES = 12 << 20
LEAF_SETS = 16
FANOUT = 8
#: Groups of up to this many sets are compared by lag, many at once, as single leaves.
SMALL_GROUP = 24


def token_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, token) of all distinct shingles, sorted; a token is a 62-bit hash."""
    data = LOWER[data]
    start, end, first = word_spans(data, offsets, SPACE_BYTES)
    hashes = span_hashes(data, start, end)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    tokens = shingle_hashes(hashes, words)
    at = np.flatnonzero(doc[: len(tokens)] == doc[words - 1 :][: len(tokens)])
    docs, found = [doc[at]], [tokens[at]]
    for n in range(1, words):
        short = np.flatnonzero(count == n)
        if len(short):
            total = np.full(len(short), n, dtype=np.uint64)
            for k in range(n):
                total = mix(total + hashes[first[short] + k])
            docs.append(short)
            found.append(total)
    doc, token = np.concatenate(docs), np.concatenate(found) >> np.uint64(2)
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    return doc[new], token[new]


def _common_tokens(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """Counted tokens that more than COMMON_SETS documents hold, at most COMMON_TOKENS of them."""
    below = np.uint64(int(COUNTED_SHARE * (1 << 62)))

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in text_slices(batch, 0):
            _, token = token_sets(data, offsets, words)
            token, count = np.unique(token[token < below], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count.astype(np.int64))], names=["token", "n"])

    counts = map_batches(docs.select(text), step, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") > COMMON_SETS).orderBy(F.desc("n"), "token").limit(COMMON_TOKENS).select("token").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _sets(docs: DataFrame, key: str, text: str, words: int, percent: int, common: np.ndarray) -> DataFrame:
    """key, hash of the text, node (digest of the set, 0 for an empty one), n, prefix, bits, more and edge of every document.

    The prefix has tokens as their ranks in the common order: the hash itself, or with bit 62 set for common tokens.
    more is a bitmap of a long set's prefix, edge the last rank of the prefix.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)
    rows = docs.select(key, F.xxhash64(text).alias(_COPY), F.col(text).alias("__text"))
    schema = schema_with(rows.select(key, _COPY), "node long, n long, prefix array<long>, bits binary, more binary, edge long")
    below = np.uint64(int(COUNTED_SHARE * (1 << 62)))
    last = np.uint64(1 << 62)

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part, data, offsets in text_slices(batch, 2):
            doc, token = token_sets(data, offsets, words)
            first = np.searchsorted(doc, np.arange(part.num_rows + 1))
            n = np.diff(first)
            node = set_digests(token, first)
            bits = np.zeros((part.num_rows, BITS // 64), dtype=np.uint64)
            place = mix(token) & np.uint64(BITS - 1)
            np.bitwise_or.at(bits, (doc, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
            rank = token.copy()
            if len(known):
                low = np.flatnonzero(token < below)
                at = np.searchsorted(known, token[low])
                at[at == len(known)] = 0
                rank[low[known[at] == token[low]]] |= last
            order = np.lexsort((rank, doc))
            size = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
            take = np.arange(len(doc)) - first[doc] < size[doc]
            ranks = rank[order][take]
            ends = np.concatenate([[0], np.cumsum(size)])
            prefix = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ranks.view(np.int64)))
            raw = pa.array([bits[k].tobytes() for k in range(part.num_rows)], pa.binary())
            more = pa.array([_bitmap(ranks[ends[k] : ends[k + 1]]) if n[k] > LONG_SET else None for k in range(part.num_rows)], pa.binary())
            edge = pa.array([int(ranks[ends[k + 1] - 1]) if size[k] else 0 for k in range(part.num_rows)], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node.view(np.int64)), pa.array(n.astype(np.int64)), prefix, raw, more, edge], names=schema.names)

    return map_batches(rows, step, schema)


def _bitmap(tokens: np.ndarray) -> bytes:
    """A bitmap of eight bits or more for each token; its size is a power of two."""
    size = max(BITS, 1 << (8 * len(tokens) - 1).bit_length())
    place = mix(tokens) & np.uint64(size - 1)
    bits = np.zeros(size // 64, dtype=np.uint64)
    np.bitwise_or.at(bits, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return bits.tobytes()


class LongSets:
    """What the bitmaps of long sets' prefixes rule out.

    Up to the lesser edge the set with that edge is known whole: it has its prefix there, of which no more than the
    common bits and the tokens that its own bits hide can be in the other set; the rest of it may be.
    """

    def __init__(self, n: np.ndarray, more: list[memoryview | None], edge: np.ndarray, percent: int) -> None:
        self.n, self.more, self.edge, self.percent = n, more, edge, percent

    def possible(self, i: int, j: int) -> bool:
        if self.more[i] is None or self.more[j] is None:
            return True
        if self.edge[i] > self.edge[j]:
            i, j = j, i
        a, b = (np.frombuffer(self.more[k], dtype=np.uint64) for k in (i, j))
        size = min(len(a), len(b))
        a, b = (np.bitwise_or.reduce(x.reshape(-1, size), axis=0) for x in (a, b))
        n = int(self.n[i])
        prefix = n - (self.percent * n + 99) // 100 + 1
        hidden = prefix - int(np.bitwise_count(a).sum())
        most = int(np.bitwise_count(a & b).sum()) + hidden + n - prefix
        return (100 + self.percent) * most >= self.percent * (n + int(self.n[j]))


def linked(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of tokens are similar enough."""
    both = len(np.intersect1d(u, v, assume_unique=True))
    return 100 * both >= percent * (len(u) + len(v) - both)


class Group:
    """The sets of a group, smallest first, and their components so far; with tokens, pairs are verified at once."""

    def __init__(self, node: np.ndarray, n: np.ndarray, bits: np.ndarray, left: np.ndarray, percent: int, tokens: list[np.ndarray] | None = None, long: LongSets | None = None) -> None:
        self.long = long
        self.node, self.n, self.bits, self.left, self.percent, self.tokens = node, n, bits, left, percent, tokens
        self.slack = n - np.bitwise_count(bits).sum(axis=1)
        self.label = np.arange(len(n))
        self.members = [[k] for k in range(len(n))]
        self.found: list[tuple[int, int]] = []

    def _needed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return -(-self.percent * (a + b) // (100 + self.percent))

    def _join(self, i: int, j: int) -> None:
        """Make one component of the two sets' components; the smaller one gets the other's label."""
        x, y = sorted((int(self.label[i]), int(self.label[j])), key=lambda k: -len(self.members[k]))
        self.label[self.members[y]] = x
        self.members[x] += self.members[y]
        self.members[y] = []

    def _leaves(self, a: slice, b: slice) -> None:
        """Report the candidate pairs between two leaves (or inside one)."""
        if (self.label[a] == self.label[b][0]).all() and (self.label[b] == self.label[b][0]).all():
            return
        both = np.bitwise_count(self.bits[a, None, :] & self.bits[None, b, :]).sum(axis=2)
        x, y = self.n[a, None], self.n[None, b]
        most = np.minimum(both + np.minimum(self.slack[a, None], self.slack[None, b]), np.minimum(self.left[a, None], self.left[None, b]))
        good = (most >= self._needed(x, y)) & (100 * np.minimum(x, y) >= self.percent * np.maximum(x, y))
        for i, j in zip(*np.nonzero(good), strict=True):
            i, j = int(i) + a.start, int(j) + b.start
            if i < j and self.label[i] != self.label[j] and (self.long is None or self.long.possible(i, j)) and (self.tokens is None or linked(self.tokens[i], self.tokens[j], self.percent)):
                self.found.append((i, j))
                self._join(i, j)

    def traverse(self) -> list[tuple[int, int]]:
        """Dual traversal of the signature tree: a spanning forest of the candidate (or verified) pairs of positions."""
        starts = np.arange(0, len(self.n), LEAF_SETS)
        tree = [self._level(starts, self.bits, self.n, self.n, self.slack)]
        while len(tree[-1][1]) > 1:
            bits, low, high, slack = tree[-1]
            tree.append(self._level(np.arange(0, len(low), FANOUT), bits, low, high, slack))
        stack = [(len(tree) - 1, 0, 0)]
        while stack:
            level, a, b = stack.pop()
            bits, low, high, slack = tree[level]
            if 100 * high[a] < self.percent * low[b] or 100 * high[b] < self.percent * low[a]:
                continue
            if a != b and int(np.bitwise_count(bits[a] & bits[b]).sum()) + min(slack[a], slack[b]) < self._needed(low[a], low[b]):
                continue
            if level == 0:
                end = len(self.n)
                self._leaves(slice(a * LEAF_SETS, min(end, (a + 1) * LEAF_SETS)), slice(b * LEAF_SETS, min(end, (b + 1) * LEAF_SETS)))
                continue
            below = len(tree[level - 1][1])
            left, right = (range(k * FANOUT, min(below, (k + 1) * FANOUT)) for k in (a, b))
            stack.extend((level - 1, i, j) for i in reversed(left) for j in reversed(right) if i <= j)
        return self.found

    @staticmethod
    def _level(starts: np.ndarray, bits: np.ndarray, low: np.ndarray, high: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, ...]:
        return (
            np.bitwise_or.reduceat(bits, starts, axis=0),
            np.minimum.reduceat(low, starts),
            np.maximum.reduceat(high, starts),
            np.maximum.reduceat(slack, starts),
        )


def _small_groups(group: np.ndarray, n: np.ndarray, bits: np.ndarray, left: np.ndarray, percent: int, long: LongSets) -> list[tuple[int, int]]:
    """Spanning forests of the candidate pairs inside many small groups, which stand one after another."""
    slack = n - np.bitwise_count(bits).sum(axis=1)
    pairs = []
    for lag in range(1, SMALL_GROUP):
        i = np.flatnonzero(group[lag:] == group[:-lag]) if len(group) > lag else np.zeros(0, dtype=np.int64)
        if not len(i):
            break
        j = i + lag
        fits = 100 * n[i] >= percent * n[j]
        i, j = i[fits], j[fits]
        most = np.minimum(np.bitwise_count(bits[i] & bits[j]).sum(axis=1) + np.minimum(slack[i], slack[j]), np.minimum(left[i], left[j]))
        good = most >= -(-percent * (n[i] + n[j]) // (100 + percent))
        pairs.append(np.column_stack([i[good], j[good]]))
    found = np.concatenate(pairs) if pairs else np.zeros((0, 2), dtype=np.int64)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    kept = []
    for i, j in found[np.lexsort((found[:, 1], found[:, 0]))].tolist():
        a, b = find(i), find(j)
        if a != b and long.possible(i, j):
            root[b] = a
            kept.append((i, j))
    return kept


EDGES = "a long, b long"


def _candidates(members: DataFrame, percent: int) -> DataFrame:
    """Forests of candidate pairs (a < b) of the groups in members: token, size, node, n, bits, pos, more, edge."""
    chunks = F.ceil(F.col("size") / GROUP_BYTES).cast("int")
    dealt = (
        members.withColumn("m", chunks)
        .withColumn("c", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .select("token", F.least("c", "other").alias("p"), F.greatest("c", "other").alias("q"), "node", "n", "bits", "pos", "more", "edge")
    )
    ordered = bounded_batches(dealt).repartition("token", "p", "q").sortWithinPartitions("token", "p", "q", "n", "node")
    return ordered.mapInArrow(lambda batches: _by_group(batches, lambda b: _solve(b, percent)), EDGES)


def _by_group(batches: Iterator[pa.RecordBatch], solve: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Run solve on whole groups of rows that agree in the first three columns; rows come sorted by them."""
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = _keys(batch)
        change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        if pending and (_keys(pending[-1].slice(pending[-1].num_rows - 1))[0] != key[0]).any():
            yield from solve(pending)
            pending = []
        if len(change):
            cut = int(change[-1])
            yield from solve([*pending, batch.slice(0, cut)])
            pending = [batch.slice(cut)]
        else:
            pending.append(batch)
    if pending:
        yield from solve(pending)


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])


def _solve(batches: list[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    key = np.concatenate([_keys(b) for b in batches])
    node, n, pos, edge = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in batches]) for k in (3, 4, 6, 8))
    more = [m for b in batches for m in _buffers(b.column(7))]
    left = n - pos
    bits = np.concatenate([_bits(b.column(5)) for b in batches])
    start = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
    size = np.diff(start)
    pairs = []
    small = np.flatnonzero((size > 1) & (size <= SMALL_GROUP))
    if len(small):
        at = np.concatenate([np.arange(start[k], start[k + 1]) for k in small])
        which = np.repeat(small, size[small])
        pairs += [(at[i], at[j]) for i, j in _small_groups(which, n[at], bits[at], left[at], percent, LongSets(n[at], [more[k] for k in at], edge[at], percent))]
    for k in np.flatnonzero(size > SMALL_GROUP):
        s = slice(start[k], start[k + 1])
        pairs += [(i + s.start, j + s.start) for i, j in Group(node[s], n[s], bits[s], left[s], percent, long=LongSets(n[s], more[s], edge[s], percent)).traverse()]
    yield from _edges(node, pairs)


def _bits(column: pa.Array) -> np.ndarray:
    """The rows' bitmaps of BITS bits, read in place."""
    return np.frombuffer(column.buffers()[2], dtype=np.uint64, count=len(column) * BITS // 64, offset=_offsets(column)[0]).reshape(-1, BITS // 64)


def _offsets(column: pa.Array) -> list[int]:
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].tolist()


def _buffers(column: pa.Array) -> list[memoryview | None]:
    """The rows' bytes without a copy; None for null."""
    if column.null_count == len(column):
        return [None] * len(column)
    data, at = memoryview(column.buffers()[2]), _offsets(column)
    return [data[a:b] if valid else None for valid, a, b in zip(column.is_valid().to_pylist(), at[:-1], at[1:], strict=True)]


def _edges(node: np.ndarray, pairs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if pairs:
        i, j = np.array(pairs, dtype=np.int64).T
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])


def _links(members: DataFrame, percent: int) -> DataFrame:
    """Forests of the links (a < b) of the families in members: family, node, tokens."""
    size = F.octet_length("tokens") + F.greatest(F.octet_length("tokens") / 2, F.lit(128)) + SET_BYTES
    sizes = members.groupBy("family").agg(F.ceil(F.sum(size) / FAMILY_BYTES).cast("int").alias("m"))
    dealt = (
        members.join(sizes, "family")
        .withColumn("c", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .select("family", F.least("c", "other").alias("p"), F.greatest("c", "other").alias("q"), "node", "tokens")
    )
    ordered = bounded_batches(dealt).repartition("family", "p", "q").sortWithinPartitions("family", "p", "q", F.octet_length("tokens"), "node")
    return ordered.mapInArrow(lambda batches: _by_group(batches, lambda b: _solve_families(b, percent)), EDGES)


def _solve_families(batches: list[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    key = np.concatenate([_keys(b) for b in batches])
    node = np.concatenate([b.column(3).to_numpy(zero_copy_only=False) for b in batches])
    tokens = [np.frombuffer(t, dtype=np.uint64) for b in batches for t in _buffers(b.column(4))]
    n = np.array([len(t) for t in tokens])
    start = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
    pairs = []
    for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        if b - a == 2:
            pairs += [(a, a + 1)] if linked(tokens[a], tokens[a + 1], percent) else []
        elif b - a > 2:
            size = min(1 << 16, max(1 << 10, 1 << int(16 * n[a:b].mean()).bit_length()))
            bits = np.zeros((b - a, size // 64), dtype=np.uint64)
            for k in range(a, b):
                place = mix(tokens[k]) & np.uint64(size - 1)
                np.bitwise_or.at(bits[k - a], (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
            group = Group(node[a:b], n[a:b], bits, n[a:b], percent, tokens[a:b])
            pairs += [(i + a, j + a) for i, j in group.traverse()]
    yield from _edges(node, pairs)


def _filter(df: DataFrame, place: Column) -> Broadcast:
    """FILTER_BITS bits, with those at df's places set: a broadcast whose size doesn't depend on the data."""
    mark = F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS int))")).alias("mark")
    found = df.select(place.cast("long").alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(mark).toArrow()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bits[found.column("word").to_numpy()] = found.column("mark").to_numpy()
    return df.sparkSession.sparkContext.broadcast(bits)


def _posting(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """node, pos and token of the prefixes' tokens that are in groups, and of a few others."""
    shared = _filter(groups, F.col("token").bitwiseAND(F.lit(FILTER_BITS - 1)))

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(1)
        token = lists.flatten().to_numpy(zero_copy_only=False)
        count = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        place = token & (FILTER_BITS - 1)
        keep = np.flatnonzero((shared.value[place >> 6] >> (place & 63)) & 1)
        node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), count)
        pos = ragged(np.zeros(len(count), dtype=np.int64), count)
        yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(pos[keep]), pa.array(token[keep])], names=["node", "pos", "token"])

    return map_batches(classes.select("node", "prefix"), step, "node long, pos long, token long")


def _full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """node and tokens (sorted 64-bit numbers) of the documents in wanted (node, rep), and of a few others.

    A Bloom filter of FILTER_BITS bits over the wanted keys keeps most other documents' texts from being read further;
    its size doesn't depend on the data, and what passes it wrongly joins no edge.
    """
    shared = _filter(wanted, F.pmod(F.xxhash64(F.lit(7), "rep"), F.lit(FILTER_BITS)))
    rows = docs.select(F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(FILTER_BITS)).alias("__place"), F.col(text).alias("__text"))

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        place = batch.column(0).to_numpy(zero_copy_only=False)
        keep = (shared.value[place >> 6] >> (place & 63)) & 1
        for part, data, offsets in text_slices(batch.filter(pa.array(keep == 1)), 1):
            doc, token = token_sets(data, offsets, words)
            first = np.searchsorted(doc, np.arange(part.num_rows + 1))
            node = set_digests(token, first)
            at = np.flatnonzero(np.diff(first))
            blobs = [token[first[k] : first[k + 1]].tobytes() for k in at]
            yield pa.RecordBatch.from_arrays([pa.array(node[at].view(np.int64)), pa.array(blobs, pa.binary())], names=["node", "tokens"])

    return map_batches(rows, step, "node long, tokens binary").dropDuplicates(["node"])


def set_digests(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit digest of every set of tokens, 0 for an empty one."""
    n = np.diff(first)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(token), dtype=np.uint64)])
    node = mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64))
    node[n == 0] = 0
    return node


#: Names that the columns of docs don't have.
_COPY, _KEY, _TEXT_COPY = "__copy", "__key", "__text_copy"


def find_groups(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_shingles (size of its set), component_id (the least key it is linked to).

    Words are runs of characters other than space and U+0009 to U+000D, with A-Z lower-cased. A text of fewer than words
    words has its whole sequence as its only shingle; null and empty texts have none and are linked with nothing, so
    component_id is their own key. Links are pairs with 100 * |intersection| >= percent * |union|; component_id is the
    least key reachable by links. Rows with equal sets are linked; repeated rows stay. Rows that share a key but no text
    count as documents of their own. Null keys are never the least. Tokens are 62-bit hashes of shingles, and sets count
    as equal when their 64-bit digests are.
    """
    return _labelled(docs.select(key, text), words, percent, key, text).drop(_COPY)


def _labelled(docs: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """What find_groups() returns, with a hash of the text."""
    scratch = Scratch(docs.sparkSession)
    common = _common_tokens(docs, text, words)
    wide = Scratch(docs.sparkSession)
    sets = wide.written(_sets(docs, key, text, words, percent, common), "sets")
    first = F.first(F.struct("n", "prefix", "bits", "more", "edge")).alias("s")
    grouped = sets.where("n > 0").groupBy("node").agg(F.min(key).alias("rep"), first)
    classes = scratch.written(grouped.select("node", "rep", "s.n", "s.prefix", "s.bits", "s.more", "s.edge"), "classes")
    sets = scratch.written(sets.select(key, _COPY, "node", "n"), "digests")
    wide.clear()
    posting = classes.select("node", (F.coalesce(F.octet_length("more"), F.lit(0)) + BITS // 8 + SET_BYTES).alias("bytes"), F.explode("prefix").alias("token"))
    signature = [F.count(F.lit(1)).alias("df"), F.sum("bytes").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")]
    groups = posting.groupBy("token").agg(*signature).where("df > 1").groupBy("df", "x", "y").agg(F.min("token").alias("token"), F.max("size").alias("size"))
    groups = scratch.written(groups.select("token", "size"), "groups")
    members = _posting(classes, groups).join(groups, "token").join(classes.select("node", "n", "bits", "more", "edge"), "node")
    members = scratch.written(members.select("token", "size", "node", "n", "bits", "pos", "more", "edge"), "members")
    candidates = _candidates(members, percent).distinct()
    families = scratch.written(components(candidates, scratch).select("node", F.col("root").alias("family")), "families")
    full = _full_sets(docs, families.join(classes.select("node", "rep"), "node"), key, text, words)
    links = _links(scratch.written(full.join(families, "node"), "full"), percent)
    roots = components(links, scratch)
    placed = classes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = scratch.written(placed.join(least, "root").select("node", "component_id"), "labels")
    found = sets.join(labels, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(key)).alias("component_id")
    out = written(found.select(key, F.col("n").alias("n_shingles"), component, _COPY), "components")
    scratch.clear()
    return out


def keep_one(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group, that of the least key.

    A document is known by its key and its text: rows that agree in both stay or go together, and one that resembles a
    document of another text under the same least key stays with it. A document with a null key goes if it is linked to
    one with a key, and stays otherwise, since nothing tells the documents without a key apart. Empty and null texts stay.
    """
    found = _labelled(docs.select(key, text), words, percent, key, text)
    kept = found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias(_KEY), F.col(_COPY).alias(_TEXT_COPY)).distinct()
    same = F.col(key).eqNullSafe(F.col(_KEY)) & (F.xxhash64(text) == F.col(_TEXT_COPY))
    return docs.join(kept, same, "left_semi").select(*docs.columns)
