"""Quality rules: counts of words and lines, and compression bands.

A text's zstandard ratio (compressed bytes to bytes) is held against limits for its length, and so is the ratio of every
fixed chunk of it: too low is repetitive, too high is not language. Everything of a text is computed in one map over the
documents; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import SPACE_BYTES, map_batches, schema_with, shingle_hashes, span_hashes, text_slices, within, word_spans

#: (bytes below which the row holds, least ratio, largest ratio) for whole texts at LEVEL.
WHOLE_BANDS = (
    (256, 0.30, 2.00),
    (512, 0.38, 0.95),
    (1024, 0.36, 0.85),
    (2048, 0.32, 0.80),
    (4096, 0.29, 0.75),
    (8192, 0.26, 0.72),
    (32768, 0.22, 0.70),
    (1 << 62, 0.15, 0.70),
)
LEVEL = 3
CHUNK_BYTES = 1024
#: A last chunk of fewer bytes isn't judged.
LEAST_CHUNK_BYTES = 512
CHUNK_BAND = (0.28, 0.85)
#: At most this share of a text's chunks may lie outside CHUNK_BAND.
CHUNK_SHARE = 0.25
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules and of the bands."""

    min_words: int = 50
    max_repeat_percent: int = 50
    whole_bands: tuple[tuple[int, float, float], ...] = WHOLE_BANDS
    chunk_bytes: int = CHUNK_BYTES
    least_chunk_bytes: int = LEAST_CHUNK_BYTES
    chunk_band: tuple[float, float] = CHUNK_BAND
    chunk_share: float = CHUNK_SHARE


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of flags between each pair of neighbouring positions."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[at])


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Of every text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (see apply_rules)."""
    start, end, first = word_spans(data, offsets, SPACE_BYTES)
    in_word = SPACE_BYTES[data]
    out = {
        "n_words": np.diff(first),
        "word_chars": _sums(in_word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _sums(_SYMBOLS[data], offsets),
    }
    newline = np.flatnonzero(data == 0x0A)
    line_start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], newline + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.concatenate([line_start[1:], [len(data)]])[: len(line_start)]
    line_end = line_end - (data[np.maximum(line_end - 1, 0)] == 0x0A)
    with_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[with_word], line_end[with_word]
    doc = np.searchsorted(offsets, line_start, side="right") - 1
    key = within(span_hashes(data, line_start, line_end), doc)
    again = np.ones(len(key), dtype=bool)
    again[np.unique(key, return_index=True)[1]] = False
    out["n_dup_lines"] = np.bincount(doc[again], minlength=len(offsets) - 1)
    words = span_hashes(data, start, end)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    if len(words) >= 3:
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        whole = np.flatnonzero(doc[:-2] == doc[2:])
        key = within(shingle_hashes(words, 3)[whole], doc[whole])
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = whole[count[back] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + 3, -1)
    out["n_repeat_words"] = _sums(np.cumsum(covered)[: len(words)] > 0, first)
    return out


def _ratio(codec: zstandard.ZstdCompressor, part: bytes) -> float:
    return len(codec.compress(part)) / max(1, len(part))


def bands(text: bytes, rules: Rules, codec: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of chunks outside their band, and whether both are within limits."""
    ratio = _ratio(codec, text)
    low, high = next((a, b) for below, a, b in rules.whole_bands if len(text) < below)
    chunks = [text[k : k + rules.chunk_bytes] for k in range(0, len(text), rules.chunk_bytes)]
    judged = [_ratio(codec, c) for c in chunks if len(c) >= rules.least_chunk_bytes]
    outside = sum(not rules.chunk_band[0] <= r <= rules.chunk_band[1] for r in judged) / max(1, len(judged))
    return ratio, outside, low <= ratio <= high and outside <= rules.chunk_share


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FOUND = {c: "long" for c in COUNTS} | {"base_failed": "boolean", "whole_ratio": "double", "chunks_outside": "double", "kept": "boolean"}


def apply_rules(docs: DataFrame, rules: Rules | None = None, *, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """One row per row of docs: key (or the columns keep) and the columns of FOUND.

    Words are runs of characters other than space and U+0009 to U+000D. word_chars: their code points. n_symbols: the
    characters # * $ % & | < >. n_dup_lines: lines (split at \\n) with a word that equal an earlier line of the text.
    n_repeat_words: words inside a window of three that occurs twice or more in the text. base_failed: fewer than
    min_words words, or more than max_repeat_percent of the words in n_repeat_words. kept: not base_failed, and within
    the bands. A null or empty text has no words, and so fails; repeated rows stay; other columns are ignored unless in
    keep (prefix goes before the new names, should these clash). Windows and lines are compared by 64-bit hashes.
    """
    rules = rules or Rules()
    keep = [key] if keep is None else keep
    n = len(keep)
    schema = schema_with(docs.select(*keep), ", ".join(f"`{prefix}{c}` {kind}" for c, kind in FOUND.items()))

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        for part, data, offsets in text_slices(batch, n):
            counts = base_counts(data, offsets)
            failed = (counts["n_words"] < rules.min_words) | (100 * counts["n_repeat_words"] > rules.max_repeat_percent * counts["n_words"])
            judged = [bands(data[a:b].tobytes(), rules, codec) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            ratio, outside, within = (np.array(x) for x in zip(*judged, strict=True))
            arrays = [*(counts[f].astype(np.int64) for f in COUNTS), failed, ratio.astype(float), outside.astype(float), within & ~failed]
            yield pa.RecordBatch.from_arrays([*part.columns[:n], *map(pa.array, arrays)], names=schema.names)

    return map_batches(docs.selectExpr(*[f"`{k}`" for k in keep], f"`{text}` AS __text"), step, schema)
