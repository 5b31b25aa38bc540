"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of N consecutive words. A window's tokens are its word pairs, ordered by how
rare they are in the corpus. Since the whole window has to occur, a prefix of one token is enough: a document that lacks
the window's rarest pair can't hold it. Where that pair occurs, its offset in the window fixes where the window would
start (the positional bound); it has to lie within the document (the length bound); then the words are compared one by
one (verification).

The benchmark is the query set, in blocks of BLOCK_WORDS words: a block's index is broadcast, and all documents are
mapped against it one block at a time, so that documents are never shuffled and memory is bounded by a block and LOAD_BYTES
of documents. The corpus is read once for the counts of COUNTED_BLOCKS blocks, and once more to find the windows of all.
Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_BYTES, LOWER, bounded_batches, map_batches, mix, ragged, schema_with, shingle_hashes, span_hashes, text_bytes, text_slices, word_spans

WINDOW_WORDS = 10
#: Words of benchmark text in one broadcast block; its index takes about 200 bytes a word.
BLOCK_WORDS = 200_000
#: Blocks whose tokens are counted in one pass over the corpus.
COUNTED_BLOCKS = 10
#: Bytes of documents that several blocks are loaded for, one after another.
LOAD_BYTES = 32 << 20
#: Words in a token of the prefix join.
TOKEN_WORDS = 2


@dataclass
class Block:
    """Windows of a part of the benchmark, as arrays."""

    words: np.ndarray  # hashes of all windows' words, window after window
    first: np.ndarray  # where a window's words start in words
    length: np.ndarray  # how many it has
    item: np.ndarray  # its item, as an index into items
    items: list[str]
    token: np.ndarray | None = None  # sorted: each window's rarest token
    window: np.ndarray | None = None  # whose it is
    offset: np.ndarray | None = None  # and where it stands there

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (token, window, offset)."""
        found = [(pair_tokens(self.words[f : f + n]), w) for w, (f, n) in enumerate(zip(self.first, self.length, strict=True))]
        return (
            np.concatenate([t for t, _ in found]),
            np.concatenate([np.full(len(t), w) for t, w in found]),
            np.concatenate([np.arange(len(t)) for t, _ in found]),
        )


def pair_tokens(words: np.ndarray) -> np.ndarray:
    """The token at every word: the pair that starts there; a lone word is its own token."""
    return shingle_hashes(words, TOKEN_WORDS) if len(words) >= TOKEN_WORDS else mix(words)


def _text_tokens(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """pair_tokens of every text at once; a pair that would cross texts counts as the lone last word."""
    out = mix(words)
    if len(words) >= TOKEN_WORDS:
        pairs = shingle_hashes(words, TOKEN_WORDS)
        inner = np.ones(len(words), dtype=bool)
        inner[first[1:][first[1:] > 0] - 1] = False
        inner[len(pairs) :] = False
        out[inner] = pairs[inner[: len(pairs)]]
    return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    start, end, first = word_spans(data, offsets, ALNUM_BYTES)
    return span_hashes(data, start, end), first


def blocks(benchmark: DataFrame, window: int = WINDOW_WORDS, item: str = "item_id", text: str = "text") -> Iterator[Block]:
    """The benchmark's windows, block by block; the driver holds one block at a time."""
    pending: list[tuple[str, np.ndarray]] = []
    size = 0
    for row in benchmark.select(F.col(item).cast("string"), text).where(F.col(text).isNotNull() & F.col(item).isNotNull()).toLocalIterator():
        words, _ = _words(*text_bytes(pa.array([row[1]])))
        if len(words):
            pending.append((row[0], words))
            size += len(words)
        if size >= BLOCK_WORDS:
            yield _block(pending, window)
            pending, size = [], 0
    if pending:
        yield _block(pending, window)


def _block(texts: list[tuple[str, np.ndarray]], window: int) -> Block:
    items = sorted({i for i, _ in texts})
    number = {i: k for k, i in enumerate(items)}
    rows = {(number[i], w[k : k + window].tobytes()) for i, w in texts for k in range(max(1, len(w) - window + 1))}
    kept = sorted(rows)
    words = [np.frombuffer(w, dtype=np.uint64) for _, w in kept]
    length = np.array([len(w) for w in words])
    return Block(np.concatenate(words), np.cumsum(length) - length, length, np.array([i for i, _ in kept]), items)


def token_counts(docs: DataFrame, tokens: np.ndarray, text: str = "text") -> dict[int, int]:
    """How often each of the given tokens occurs in all texts; as many rows as tokens come to the driver at most."""
    shared = docs.sparkSession.sparkContext.broadcast(np.unique(tokens))

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts = np.zeros(len(known), dtype=np.int64)
        for _, data, offsets in text_slices(batch, 0):
            found = _text_tokens(*_words(data, offsets))
            at = np.searchsorted(known, found)
            at[at == len(known)] = 0
            counts += np.bincount(at[known[at] == found], minlength=len(known))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["token", "n"])

    rows = map_batches(docs.select(text), step, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {int(shared.value[r.token]): r.n for r in rows}


def with_prefixes(block: Block, counts: dict[int, int]) -> Block:
    """The block with each window's prefix: its rarest token, the first of equally rare ones."""
    token, window, offset = block.tokens()
    rarity = np.array([counts.get(int(t), 0) for t in token])
    order = np.lexsort((offset, rarity, window))
    first = order[np.unique(window[order], return_index=True)[1]]
    first = first[np.argsort(token[first], kind="stable")]
    block.token, block.window, block.offset = token[first], window[first], offset[first]
    return block


def _entries(found: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(position, entry of the block's tokens) for every token of a text that the block has."""
    low = np.searchsorted(block.token, found, side="left")
    maybe = np.flatnonzero((low < len(block.token)) & (block.token[np.minimum(low, len(block.token) - 1)] == found))
    low = low[maybe]
    count = np.searchsorted(block.token, found[maybe], side="right") - low
    return np.repeat(maybe, count), ragged(low, count)


def _hits(words: np.ndarray, first: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(start, window) of every occurrence of the block's windows."""
    at, entry = _entries(_text_tokens(words, first), block)
    if (block.length == 1).any():  # a window of one word has that word as its token, wherever it stands in a text
        lone, lone_entry = _entries(mix(words), block)
        one = block.length[block.window[lone_entry]] == 1
        longer = block.length[block.window[entry]] > 1
        at, entry = np.concatenate([at[longer], lone[one]]), np.concatenate([entry[longer], lone_entry[one]])
    window = block.window[entry]
    start = at - block.offset[entry]
    doc = np.searchsorted(first, at, side="right") - 1
    fits = (start >= first[doc]) & (start + block.length[window] <= first[doc + 1])
    start, window = start[fits], window[fits]
    for k in range(int(block.length.max(initial=0))):
        longer = block.length[window] > k
        same = ~longer
        same[longer] = words[start[longer] + k] == block.words[block.first[window[longer]] + k]
        start, window = start[same], window[same]
    return start, window


def _load(shared: Broadcast) -> Block:
    """A broadcast block, which the worker doesn't keep: one block is in memory at a time."""
    block = shared.value
    shared.__dict__.pop("_value", None)
    return block


def _shared_blocks(docs: DataFrame, found: Iterator[Block], text: str) -> list[Broadcast]:
    """Every block with its prefixes, broadcast; COUNTED_BLOCKS of them are on the driver at a time."""
    context, shared = docs.sparkSession.sparkContext, []
    while group := list(islice(found, COUNTED_BLOCKS)):
        counts = token_counts(docs, np.concatenate([b.tokens()[0] for b in group]), text)
        shared += [context.broadcast(with_prefixes(b, counts)) for b in group]
    return shared


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW_WORDS, key: str = "doc_id", text: str = "text", item: str = "item_id", keep: list[str] | None = None, prefix: str = ""
) -> DataFrame:
    """One row per row of docs: key (or the columns keep), n_words, n_hit, n_items, items, and hit_starts and hit_ends,
    the numbers of the first word of each hit span and of the word after it.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. An item's text
    of fewer than window words is one window; one without words, or null, has none. Null and empty documents have no
    words and no hits. Repeated rows stay repeated. Items with the same id count once, by their id as text; items
    without an id are left out. An empty benchmark hits nothing. Other columns of docs are ignored unless in keep; where these clash with
    the new names, prefix goes before the new ones.
    """
    shared = _shared_blocks(docs, blocks(benchmark, window, item, text), text)
    keep = [key] if keep is None else keep
    n = len(keep)
    kinds = {"n_words": "long", "n_hit": "long", "n_items": "long", "items": "array<string>", "hit_starts": "array<long>", "hit_ends": "array<long>"}
    schema = schema_with(docs.select(*keep), ", ".join(f"`{prefix}{c}` {kind}" for c, kind in kinds.items()))
    long_list = pa.list_(pa.int64())

    def judge(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(part, *_words(data, offsets)) for batch in batches for part, data, offsets in text_slices(batch, n)]
        spans: list[list[list[tuple[int, int]]]] = [[[] for _ in range(part.num_rows)] for part, _, _ in parts]
        items: list[list[set[str]]] = [[set() for _ in range(part.num_rows)] for part, _, _ in parts]
        for handle in shared:
            block = handle.value if len(shared) == 1 else _load(handle)
            for k, (_, words, first) in enumerate(parts):
                start, hit = _hits(words, first, block)
                doc = np.searchsorted(first, start, side="right") - 1
                for d, s, w in zip(doc.tolist(), (start - first[doc]).tolist(), hit.tolist(), strict=True):
                    spans[k][d].append((s, s + int(block.length[w])))
                    items[k][d].add(block.items[block.item[w]])
        for k, (part, _, first) in enumerate(parts):
            merged = [_merged(x) for x in spans[k]]
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[:n],
                    pa.array(np.diff(first)),
                    pa.array([sum(e - s for s, e in x) for x in merged], pa.int64()),
                    pa.array([len(x) for x in items[k]], pa.int64()),
                    pa.array([sorted(x) for x in items[k]], pa.list_(pa.string())),
                    pa.array([[s for s, _ in x] for x in merged], long_list),
                    pa.array([[e for _, e in x] for x in merged], long_list),
                ],
                names=schema.names,
            )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size = [], 0
        for batch in batches:
            if batch.num_rows:
                pending.append(batch)
                size += batch.nbytes
            if pending and (len(shared) < 2 or size >= LOAD_BYTES):
                yield from judge(pending)
                pending, size = [], 0
        if pending:
            yield from judge(pending)

    return bounded_batches(docs.select(*keep, F.col(text).alias("__text"))).mapInArrow(each, schema)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """docs without the documents in which a benchmark window occurs; same columns."""
    return find_contamination(docs, benchmark, keep=docs.columns, prefix="__hits_", **options).where("__hits_n_hit = 0").select(*docs.columns)
