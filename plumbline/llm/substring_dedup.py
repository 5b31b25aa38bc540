"""Repeated passages by sliding sentence spans.

A clause of more than PIECE_WORDS words is cut into pieces at words that its content picks (the least hash of each
PIECE_WORDS consecutive words), so that text with few marks or none has runs as well: any 51 consecutive words hold one.
From every sentence on, the shortest run of at least MIN_SENTENCES sentences and MIN_WORDS words is hashed. Where a run
starts and ends depends on nothing before it, so a passage has the same runs in every document that holds it. Runs are
counted globally (partial counts first, so a passage that a third of all documents share is one row for each task), and
the runs that occur again are joined back; sentences that a run covers anywhere but at its first place are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import LOWER, SPACE_BYTES, map_batches, mix, ragged, schema_with, span_hashes, text_slices, word_spans

MIN_SENTENCES = 3
MIN_WORDS = 20
#: Bytes that end a sentence or clause at the end of a word.
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?;:,"]] = True
#: Bytes of closing quotes and brackets that may follow such a mark, and other marks and closing quotes as UTF-8 numbers.
_CLOSERS = np.zeros(256, dtype=bool)
_CLOSERS[[ord(c) for c in "\"')]}"]] = True
_FAR_ENDS, _FAR_CLOSERS = (np.array([int.from_bytes(c.encode(), "big") for c in marks]) for marks in ("。．！？；：，、。…।॥؟،؛۔", "”’»」』）】"))
#: Words in a piece of a long clause, at most. With runs of 3 sentences and 20 words, any 5 * PIECE_WORDS + 1 words hold a run.
PIECE_WORDS = 10
#: Runs with the most places, whose rows are spread over SALTS tasks each where places meet first places; no other run can
#: have more than a HOT_RUNS-th of all places.
HOT_RUNS = 4096
SALTS = 64
_P = np.uint64(0xD6E8FEB86659FD93)
_P_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


@dataclass
class Sentences:
    """The sentences of several texts, and each one's run."""

    doc: np.ndarray
    begin: np.ndarray  # first byte
    stop: np.ndarray  # byte after it and the white space that follows
    words: np.ndarray  # number of words
    first: np.ndarray  # each text's first sentence, n + 1 numbers
    last: np.ndarray  # last sentence of the run from here, -1 if the text ends before
    high: np.ndarray  # the run's hash, twice
    low: np.ndarray


def _tail(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last character of every span, as a number of its UTF-8 bytes, and how many bytes it has; 3 at most."""
    code = data[stop - 1].astype(np.int64)
    size = np.ones(len(stop), dtype=np.int64)
    for k in (2, 3):
        more = np.flatnonzero((code >> 8 * (k - 2) & 0xC0 == 0x80) & (stop - start >= k) & (size == k - 1))
        code[more] += data[stop[more] - k].astype(np.int64) << 8 * (k - 1)
        size[more] = k
    return code, size


def _marked(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a word ends in a mark, once up to two closing quotes or brackets are taken off."""
    out = _ENDS[data[end - 1]]
    at = np.flatnonzero(_CLOSERS[data[end - 1]] | (data[end - 1] >= 0x80))
    stop = end[at]
    for _ in range(3):
        code, size = _tail(data, start[at], stop)
        out[at] |= np.isin(code, _FAR_ENDS) | ((size == 1) & _ENDS[code & 0xFF])
        more = (((size == 1) & _CLOSERS[code & 0xFF]) | np.isin(code, _FAR_CLOSERS)) & (stop - size > start[at])
        at, stop = at[more], (stop - size)[more]
    return out


def _picked(words: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """In clauses of more than PIECE_WORDS words, the last of the least hashes of every PIECE_WORDS consecutive words.

    Two picked words are PIECE_WORDS apart at most, and so are the first from the clause's start and the last from its
    end; whether a word is picked depends on the words around it only, so a passage's inner cuts are the same everywhere.
    """
    close = np.flatnonzero(closes)
    length = np.diff(close, prepend=-1)
    long = length > PIECE_WORDS
    windows = np.where(long, length - PIECE_WORDS + 1, 0)
    at = ragged(close - length + 1, windows)
    best, least = at.copy(), words[at]
    for k in range(1, PIECE_WORDS):
        new = words[at + k]
        lower = new <= least
        best[lower], least[lower] = at[lower] + k, new[lower]
    return best


def sentences(data: np.ndarray, offsets: np.ndarray, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> Sentences:
    """A sentence ends with a word that ends in a mark (. ! ? ; : , or one of other scripts, closing quotes aside), that
    stands before a line break or the text's end, or that is picked in a long clause."""
    start, end, text_word = word_spans(data, offsets, SPACE_BYTES)
    n = len(start)
    word_doc = np.repeat(np.arange(len(offsets) - 1), np.diff(text_word))
    newlines = np.concatenate([[0], np.cumsum(data == 0x0A)])
    closes = np.ones(n, dtype=bool)
    if n > 1:
        closes[:-1] = _marked(data, start[:-1], end[:-1]) | (newlines[start[1:]] > newlines[end[:-1]]) | (word_doc[1:] != word_doc[:-1])
    words = span_hashes(LOWER[data], start, end)
    closes[_picked(words, closes)] = True
    last_word = np.flatnonzero(closes)
    first_word = np.concatenate([[0], last_word[:-1] + 1])[: len(last_word)]
    doc = word_doc[first_word]
    begin = start[first_word]
    stop = np.concatenate([begin[1:], [len(data)]])[: len(begin)]
    stop = np.minimum(stop, offsets[doc + 1])
    first = np.searchsorted(first_word, text_word)
    count = len(first_word)
    reach = np.maximum(np.arange(count) + min_sentences - 1, np.searchsorted(last_word, first_word + min_words - 1))
    inside = reach < count
    last = np.where(inside, reach, -1)
    inside[inside] = doc[last[inside]] == doc[inside]
    last = np.where(inside, last, -1)
    hashes = []
    for salt in (np.uint64(0), np.uint64(0xA0761D6478BD642F)):
        up = np.full(n + 1, _P, dtype=np.uint64)
        down = np.full(n + 1, _P_INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(words + salt) * up[:n], out=sums[1:])
        a, b = first_word, np.where(last >= 0, last_word[last] + 1 if count else 0, first_word)
        hashes.append(mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
    return Sentences(doc, begin, stop, last_word - first_word + 1, first, last, *hashes)


def runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """high, low, key, __copy (hash of the text) and sentence (its first one's number) of every run."""
    rows = docs.select(key, F.xxhash64(text).alias("__copy"), F.col(text).alias("__text"))
    schema = schema_with(rows.select(key, "__copy"), "sentence int, high long, low long")

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_slices(batch, 2):
            s = sentences(data, offsets, min_sentences, min_words)
            at = np.flatnonzero(s.last >= 0)
            row = pa.array(s.doc[at])
            number = (at - s.first[s.doc[at]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(row), part.column(1).take(row), pa.array(number), pa.array(s.high[at].view(np.int64)), pa.array(s.low[at].view(np.int64))], names=schema.names
            )

    return map_batches(rows, step, schema)


def remove_repeated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated passages cut out of text, and n_sentences, n_removed (sentences) and n_removed_words.

    The first place of a run is that of the least (key, hash of the text, sentence number), so what is removed doesn't
    depend on how rows are dealt out. Words are compared with A-Z lower-cased, white space not at all. A text with fewer
    sentences or words than a run needs is left alone; null stays null. Rows that agree in key and text are one document
    and are treated alike. Other columns keep their values; those with the new names are replaced.
    """
    kept = docs.drop("n_sentences", "n_removed", "n_removed_words")
    spans = runs(kept, key=key, text=text, min_sentences=min_sentences, min_words=min_words)
    place = F.struct(F.col(key), F.col("__copy"), F.col("sentence"))
    again = spans.groupBy("high", "low").agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    again = written(again, "repeated")
    hot = written(again.orderBy(F.desc("__n"), "high", "low").limit(HOT_RUNS).select("high", "low", F.lit(SALTS).alias("__salts")), "hot")
    salted = spans.join(F.broadcast(hot), ["high", "low"], "left").withColumn("__salt", F.pmod(F.xxhash64(place), F.coalesce("__salts", F.lit(1))))
    first = again.join(F.broadcast(hot), ["high", "low"], "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__salts", F.lit(1)).cast("long") - 1)))
    hits = (
        salted.join(first.select("high", "low", "__salt", "__first"), ["high", "low", "__salt"])
        .where(~place.eqNullSafe(F.col("__first")))
        .groupBy(F.col(key).alias("__key"), F.col("__copy").alias("__hit_copy"))
        .agg(F.collect_set("sentence").alias("__hits"))
    )
    joined = kept.withColumn("__copy", F.xxhash64(text)).join(hits, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__copy") == F.col("__hit_copy")), "left")
    rows = joined.select(*kept.columns, "__hits")
    at, n = kept.columns.index(text), len(kept.columns)
    schema = schema_with(kept, "n_sentences long, n_removed long, n_removed_words long")

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_slices(batch, at):
            s = sentences(data, offsets, min_sentences, min_words)
            gone = np.zeros(len(s.doc) + 1, dtype=np.int64)
            for row, hits in enumerate(part.column(n).to_pylist()):
                for k in hits or ():
                    gone[s.first[row] + k] += 1
                    gone[s.last[s.first[row] + k] + 1] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            old = part.column(at)
            texts = [old[row].as_py() if not gone[s.first[row] : s.first[row + 1]].any() else _cut(data, offsets, s, gone, row) for row in range(part.num_rows)]
            counts = [np.diff(s.first), *(np.diff(np.concatenate([[0], np.cumsum(x)])[s.first]) for x in (gone, gone * s.words))]
            columns = [pa.array(texts, old.type) if k == at else part.column(k) for k in range(n)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c.astype(np.int64)) for c in counts)], names=schema.names)

    return map_batches(rows, step, schema)


def _cut(data: np.ndarray, offsets: np.ndarray, s: Sentences, gone: np.ndarray, row: int) -> str:
    a, b = s.first[row], s.first[row + 1]
    lead = data[offsets[row] : s.begin[a]].tobytes()
    return (lead + b"".join(data[s.begin[k] : s.stop[k]].tobytes() for k in range(a, b) if not gone[k])).decode()
