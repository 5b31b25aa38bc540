"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Best-fit decreasing puts the longest piece first, each into the open sequence with the least room that still holds it.
Pieces of one length are interchangeable, so the order of events depends on how many pieces there are of each length and
on nothing else: at most `capacity` counts come to the driver, whatever the corpus. A segment tree over remaining
capacities finds the tightest class of open sequences in logarithmic time, and whole runs of equal pieces go into whole
runs of equal sequences at once. The plan says, for each length, which ranks go into which sequences; every piece finds
its place from its rank among the pieces of its length. Ranks come from salted windows, so that a length that a third of
all pieces have is spread over all tasks.
"""

from __future__ import annotations

import os
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACE_BYTES, map_batches, ragged, schema_with, span_hashes, text_slices, word_spans, written

CAPACITY = 2048
END_ID = 0
#: Words that a worker keeps the ids of; beyond, it starts anew.
CACHE_WORDS = 1_000_000


class CapacityTree:
    """A segment tree over capacities 0 to n: which of them have open sequences."""

    def __init__(self, n: int) -> None:
        self.leaves = 1 << n.bit_length()
        self.open = [False] * (2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        k = self.leaves + capacity
        self.open[k] = is_open
        while k > 1:
            k //= 2
            self.open[k] = self.open[2 * k] or self.open[2 * k + 1]

    def tightest(self, length: int) -> int | None:
        """The least open capacity of at least length."""
        k = self.leaves + length
        if self.open[k]:
            return length
        while k > 1:
            if k % 2 == 0 and self.open[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.open[2 * k] else 2 * k + 1
                return k - self.leaves
            k //= 2
        return None


@dataclass(frozen=True)
class Plan:
    """Runs of equal pieces, by length and first rank: per_sequence pieces go into each of a run's sequences."""

    capacity: int
    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    per_sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks (from 0)."""
        lengths, first = np.unique(self.length, return_index=True)
        stop = np.append(first[1:], len(self.length))
        sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
        order = np.argsort(length, kind="stable")
        present, begins = np.unique(length[order], return_index=True)
        for value, rows in zip(present, np.split(order, begins[1:]), strict=True):
            k = int(np.searchsorted(lengths, value))
            run = np.searchsorted(self.rank[first[k] : stop[k]], rank[rows], side="right") - 1 + first[k]
            turn, within = np.divmod(rank[rows] - self.rank[run], self.per_sequence[run])
            sequence[rows] = self.sequence[run] + turn
            offset[rows] = self.offset[run] + within * value
        return sequence, offset


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """The plan for counts[length] pieces of each length from 1 to capacity."""
    tree, rooms, runs, opened = CapacityTree(capacity), defaultdict(deque), [], 0
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, available = capacity, opened, left
            else:
                first, available = rooms[room].popleft()
            each = min(room // length, left)
            used = min(available, left // each)
            if room == capacity and first == opened:
                opened += used
            elif used < available:
                rooms[room].appendleft((first + used, available - used))
            tree.set(room, bool(rooms[room]))
            rest = room - each * length
            if rest:
                rooms[rest].append((first, used))
                tree.set(rest, True)
            runs.append((length, rank, first, each, capacity - room))
            rank += used * each
            left -= used * each
    runs.sort()
    return Plan(capacity, *(np.array([r[k] for r in runs], dtype=np.int64) for k in range(5)), opened)


_MARKS = np.zeros(256, dtype=bool)
_MARKS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True
#: Marks at a word's end that are stepped over one by one.
MARK_STEPS = 16
#: How the tokenizer's special tokens start, which it finds before it lower-cases.
MARK = b"<|"


class WordEncoder:
    """Ids of texts, word by word, for a tokenizer that lower-cases, drops white space and tells letters from marks.

    White space ends a word for it, and so does a mark after an ASCII letter or digit; so a text's ids are its words'
    ids, and each word is encoded once.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.first = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Add words whose sorted hashes aren't known yet."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        count = np.array([len(x) for x in found], dtype=np.int64)
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], dtype=np.uint32)])
        at = np.searchsorted(self.known, hashes)
        self.known, self.first, self.count = (np.insert(old, at, new) for old, new in ((self.known, hashes), (self.first, first), (self.count, count)))

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where hashes are among the known ones, and which aren't."""
        if not len(self.known):
            return np.zeros(len(hashes), dtype=np.int64), np.arange(len(hashes))
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        return at, np.flatnonzero(self.known[at] != hashes)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, END_ID after each, and n + 1 offsets into them."""
        start, end, text_word = word_spans(data, offsets, SPACE_BYTES)
        if MARK not in data.tobytes():
            data = LOWER[data]
            start, end = _split_marks(data, start, end)
            text_word = np.searchsorted(start, offsets)
        hashes, example, back = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        _, new = self._find(hashes)
        if len(self.known) + len(new) > CACHE_WORDS:
            self._clear()
            new = np.arange(len(hashes))
        if len(new):
            raw = data.tobytes()
            self._learn(hashes[new], [raw[start[k] : end[k]].decode() for k in example[new]])
        at, _ = self._find(hashes)
        word_count = self.count[at][back]
        ids = self.ids[ragged(self.first[at][back], word_count)]
        upto = np.concatenate([[0], np.cumsum(word_count)])[text_word]
        stops = upto[1:] + np.arange(1, len(offsets))
        out = np.full(len(ids) + len(offsets) - 1, END_ID, dtype=np.uint32)
        own = np.ones(len(out), dtype=bool)
        own[stops - 1] = False
        out[own] = ids
        return out, np.concatenate([[0], stops])


def _split_marks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with the ASCII marks at their end as words of their own, where an ASCII letter or digit stands before."""
    word = np.flatnonzero(_MARKS[data[end - 1]])
    low, cut = start[word], end[word] - 1
    going = np.arange(len(word))
    for _ in range(MARK_STEPS):
        going = going[cut[going] > low[going]]
        going = going[_MARKS[data[cut[going] - 1]]]
        if not len(going):
            break
        cut[going] -= 1
    else:  # a long run of marks: all at once
        cut = np.maximum(low, np.maximum.accumulate(np.where(_MARKS[data], -1, np.arange(len(data))))[end[word] - 1] + 1)
    inside = (cut > low) & _ALNUM[data[cut - 1]]
    word, cut = word[inside], cut[inside]
    return np.insert(start, word + 1, cut), np.insert(end, word, cut)


_encoders: dict[str, WordEncoder] = {}


def tokenize(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per piece: the columns keep (doc_id), piece, start, length, and ids as little-endian 32-bit numbers.

    A document's ids are those of its text and END_ID after them, so a null, empty or blank text is one piece of one id.
    Documents of more than capacity ids are cut every capacity ids. Repeated rows are tokenised again. Kept columns with
    the new names are replaced. The tokenizer's file must be at tokenizer_path on every executor.
    """
    keep = ["doc_id"] if keep is None else [k for k in keep if k not in ("piece", "start", "length", "ids")]
    n = len(keep)
    schema = schema_with(docs.select(*keep), "piece int, start long, length long, ids binary")

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = WordEncoder(tokenizer_path)
        for part, data, offsets in text_slices(batch, n):
            ids, first = _encoders[tokenizer_path].encode(data, offsets)
            pieces = -(-np.diff(first) // capacity)
            row = np.repeat(np.arange(part.num_rows), pieces)
            piece = ragged(np.zeros(len(pieces), dtype=np.int64), pieces)
            start = piece * capacity
            length = np.minimum(capacity, np.diff(first)[row] - start)
            raw = ids.astype("<u4").tobytes()
            begin = 4 * (first[row] + start)
            cut = [raw[a : a + 4 * k] for a, k in zip(begin.tolist(), length.tolist(), strict=True)]
            taken = [c.take(pa.array(row)) for c in part.columns[:n]]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(cut, pa.binary())], names=schema.names)

    return map_batches(docs.select(*keep, F.col(text).alias("__text")), step, schema)


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, length: str = "length", salts: int | None = None) -> DataFrame:
    """pieces with sequence_id and offset: where each piece stands in which sequence.

    Lengths are 1 to capacity. Pieces stand gapless from offset 0. Which of several pieces of one length goes where
    follows from their hash and columns; equal rows are interchangeable. pieces is read twice, so it should be a table.
    Columns named sequence_id or offset are replaced.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    plan = spark.sparkContext.broadcast(best_fit_decreasing(counts, capacity))
    salts = salts or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("__hash", F.xxhash64(*pieces.columns)).withColumn("__salt", F.pmod("__hash", F.lit(salts)))
    sizes = salted.groupBy(F.col(length).alias("__length"), F.col("__salt").alias("__group")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__length", "__group", (F.sum("__n").over(Window.partitionBy("__length").orderBy("__group")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy(length, "__salt").orderBy("__hash", *pieces.columns))
    ranked = (
        salted.withColumn("__within", within)
        .join(before, (F.col(length) == F.col("__length")) & (F.col("__salt") == F.col("__group")))
        .select(*pieces.columns, (F.col("__before") + F.col("__within") - 1).alias("__rank"))
    )
    at = pieces.columns.index(length)
    schema = schema_with(pieces, "sequence_id long, offset long")

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sequence, offset = plan.value.place(batch.column(at).to_numpy(zero_copy_only=False), batch.column(len(schema) - 2).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return map_batches(ranked, step, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """tokenize() and pack(): every piece of docs with ids_crc32 (of its ids' bytes), sequence_id and offset."""
    pieces = tokenize(docs, tokenizer_path, capacity=capacity, text=text, keep=keep)
    return pack(written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces"), capacity=capacity)
