"""What the text operators share: Arrow batches in bounded slices, and vectorised words.

Words are found on UTF-8 bytes, since every separator the operators use is ASCII: a byte table says which bytes belong
to words, and numpy finds the runs. A word's hash is a polynomial over its bytes, mixed to 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructType

from ..session import Scratch, fresh_path, written

__all__ = ["Scratch", "fresh_path", "written"]

#: Bytes of text that one numpy step handles; a single longer text is handled alone.
SLICE_BYTES = 1 << 19
#: Bytes of an Arrow batch on its way to Python; a single longer row is a batch of its own.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"

SPACE_BYTES = np.ones(256, dtype=bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_BYTES = np.zeros(256, dtype=bool)
ALNUM_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to limit at most, or that have one row."""
    ends = np.cumsum(sizes)
    row = 0
    while row < len(sizes):
        stop = int(np.searchsorted(ends, (ends[row - 1] if row else 0) + limit, side="right"))
        stop = max(stop, row + 1)
        yield row, stop
        row = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and n + 1 offsets into them; null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def text_slices(batch: pa.RecordBatch, column: int | str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in row ranges of bounded bytes, each with its texts' bytes and offsets."""
    data, offsets = text_bytes(batch.column(column))
    for row, stop in slices(np.diff(offsets)):
        yield batch.slice(row, stop - row), data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]


def schema_with(df: DataFrame, ddl: str) -> StructType:
    """df's columns and those of ddl."""
    return StructType([*df.schema.fields, *DataType.fromDDL(ddl).fields])


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, once its session is set to Arrow batches of BATCH_BYTES at most: 10,000 texts would be hundreds of MB."""
    conf = df.sparkSession.conf
    now = conf.get(_BATCHES).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(_BATCHES, str(BATCH_BYTES))
    return df


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Apply step to every Arrow batch of df."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return bounded_batches(df).mapInArrow(each, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def within(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes told apart by text, from mixed hashes and the numbers of their texts."""
    return mix(hashes * _BASE + doc.astype(np.uint64))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each text's first word (n + 1 numbers). No word crosses two texts."""
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span; spans are in order and don't overlap."""
    out = np.empty(len(start), dtype=np.uint64)
    cuts = np.searchsorted(start, np.arange(0, len(data) + SLICE_BYTES, SLICE_BYTES))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        first, last = int(start[a]), int(end[b - 1])
        sums = np.zeros(last - first + 1, dtype=np.uint64)
        np.cumsum((data[first:last].astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, last - first), out=sums[1:])
        s, e = start[a:b] - first, end[a:b] - first
        out[a:b] = mix((sums[e] - sums[s]) * _power("down", _BASE_INVERSE, last - first)[s] + (e - s).astype(np.uint64))
    return out


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words, from the words' hashes; len(words) - n + 1 of them."""
    total = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for k in range(n):
        total = total * _BASE + words[k : k + len(total)]
    return mix(total)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... (counts[i] of them) for every i, one after another."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, counts)
