"""Compression classifier: zstandard dictionaries from good and bad texts, and a calibrated score from sizes.

A text is compressed with the dictionary of the good texts, with that of the bad ones, and without any. The normalised
difference of the first two sizes says which labelled texts it is like; a logistic curve over that difference, the plain
ratio and the length turns it into a probability. Training sees a bounded sample of labelled rows; scoring reads every
whole text once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import written
from .common import map_batches

#: Bounds of the training sample: labelled rows of each class, and bytes of their texts together.
SAMPLE_ROWS = 2400
SAMPLE_BYTES = 24 << 20
DICTIONARY_BYTES = 65_536
LEVEL = 3
#: Ridge penalty of the calibration.
PENALTY = 1.0


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries, and the logistic curve over the sizes' features."""

    good: bytes
    bad: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, texts: list[bytes]) -> np.ndarray:
        return _curve(features(texts, self.good, self.bad), self.centre, self.scale, self.weights)


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)


def features(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """Of every text: normalised size difference, plain ratio, log length, and their products."""
    by_good, by_bad, plain = _compressor(good), _compressor(bad), _compressor(b"")
    sizes = np.array([(len(by_good.compress(t)), len(by_bad.compress(t)), len(plain.compress(t)), len(t)) for t in texts], dtype=float).reshape(-1, 4)
    difference = (sizes[:, 1] - sizes[:, 0]) / (sizes[:, 1] + sizes[:, 0])
    ratio = sizes[:, 2] / (sizes[:, 3] + 16)
    length = np.log1p(sizes[:, 3])
    return np.column_stack([difference, ratio, length, difference**2, ratio**2, difference * ratio, ratio * length, difference * length])


def _curve(x: np.ndarray, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = np.column_stack([np.ones(len(x)), np.clip((x - centre) / scale, -8, 8)]) @ weights
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Penalised logistic regression by damped Newton steps."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    design = np.column_stack([np.ones(len(x)), np.clip((x - centre) / scale, -8, 8)])
    ridge = np.diag([0.0, *[PENALTY] * x.shape[1]])
    weights = np.zeros(design.shape[1])

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float(np.logaddexp(0, z).sum() - y @ z + w @ ridge @ w / 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (p - y) + ridge @ weights
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge + 1e-8 * np.eye(len(weights))
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while size > 1e-4 and loss(weights - size * step) > loss(weights):
            size /= 2
        weights = weights - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return centre, scale, weights


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where the texts are too few to train on, no dictionary."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b""


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "quality", key: str = "doc_id") -> QualityModel | None:
    """Fit on the labelled texts; None unless both classes have two of them.

    The sample is, of each class, the SAMPLE_ROWS keys with the least hash, and of these, in that order, the whole texts
    of SAMPLE_BYTES bytes together, which is all that comes to the driver. Keys without a text, or with an empty one, fall
    out. A key labelled twice counts with its larger label; of a key's several texts the least is taken. Even rows make
    the dictionaries, odd ones the calibration, which so sees texts that are in neither dictionary.
    """
    one = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    order = [F.xxhash64("k"), "k"]
    keys = one.where("y = 0").orderBy(*order).limit(SAMPLE_ROWS).unionAll(one.where("y = 1").orderBy(*order).limit(SAMPLE_ROWS))
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") > 0).join(F.broadcast(keys), "k")
    chosen = written(found.groupBy("k").agg(F.min("t").alias("t"), F.first("y").alias("y")), "sample")
    bytes_so_far = F.sum(F.octet_length("t")).over(Window.partitionBy("y").orderBy(*order))
    within = chosen.select("k", "y", bytes_so_far.alias("n")).where(F.col("n") <= SAMPLE_BYTES).select("k")
    rows = chosen.join(F.broadcast(within), "k").collect()
    sample = {y: [r.t.encode() for r in sorted(rows, key=lambda r: r.k) if r.y == y] for y in (0, 1)}
    if min(map(len, sample.values())) < 2:
        return None
    good, bad = (_dictionary(sample[y][::2]) for y in (1, 0))
    held = sample[1][1::2] + sample[0][1::2]
    truth = np.array([1.0] * len(sample[1][1::2]) + [0.0] * len(sample[0][1::2]))
    return QualityModel(good, bad, *_calibrate(features(held, good, bad), truth))


def held_out(key: Column) -> Column:
    """Rows that never train: crc32 of the key as text is divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(True))


def score_quality(docs: DataFrame, model: QualityModel | None, *, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a column score, 0 to 1: how likely its label is 1. A column of that name is replaced.

    Null and empty texts are scored as empty ones. Without a model every score is 0.5. Rows are neither merged nor
    dropped, so repeated rows have equal scores.
    """
    kept = docs.drop(score)
    if model is None:
        return kept.withColumn(score, F.lit(0.5))

    schema = StructType([*kept.schema.fields, StructField(score, DoubleType())])

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column(batch.schema.get_field_index(text))
        found = np.concatenate([model.score([t.encode() if t is not None else b"" for t in column[a : a + 500].to_pylist()]) for a in range(0, len(column), 500)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, score])

    return map_batches(kept, step, schema)
