"""A quality classifier by compression: two zstandard dictionaries, from good and from bad text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certjobs.llm.common import labelled_sample, spread_blocks, text_of, usable_labels

#: Labelled rows of each class that the dictionaries and the calibration are fitted on, and blocks of each, spread over its
#: whole text.
SAMPLE_ROWS = 3000
SAMPLE_BLOCKS = 16
#: Bytes of a dictionary, bytes compressed at a time, and the compression level.
DICTIONARY = 128 << 10
BLOCK = 512
LEVEL = 3


def _blocks(raw: bytes) -> list[bytes]:
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


def _dictionary(texts: list[list[str]]) -> bytes:
    parts = [b for t in texts for s in t for b in _blocks(s.encode()) if len(b) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on: the text itself serves
        return b"".join(parts)[:DICTIONARY]


class CompressionScore:
    """The share of bytes saved by the good text's dictionary against the bad text's, as a probability."""

    def __init__(self, good: bytes, bad: bytes, slope: float = 0.0, shift: float = 0.0):
        self.good, self.bad, self.slope, self.shift = good, bad, slope, shift

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("good", "bad", "slope", "shift")}

    @cached_property
    def _pair(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
        return out

    def difference(self, text: str | None) -> float:
        """(size with the bad dictionary - size with the good one) / bytes, over the whole text in blocks."""
        return self.of_blocks(_blocks((text or "").encode()))

    def of_blocks(self, blocks: list[bytes]) -> float:
        total = sum(map(len, blocks))
        if not total:
            return 0.0
        good, bad = self._pair
        return sum(len(bad.compress(b)) - len(good.compress(b)) for b in blocks) / total

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * self.difference(text) + self.shift))))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic curve, by damped Newton steps with a light ridge on the scaled slope."""
    scale = float(x.std()) or 1.0
    z, a, b = x / scale, 0.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        r, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        ga, gb = (r * z).sum() + 0.01 * a, r.sum()
        haa, hab, hbb = (h * z * z).sum() + 0.01, (h * z).sum(), h.sum()
        det = haa * hbb - hab * hab
        step = np.clip(np.array([(hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det]), -2, 2) if det > 0 else np.zeros(2)
        a, b = a - step[0], b - step[1]
    return float(a / scale), float(b)


def fit_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = SAMPLE_ROWS, blocks: int = SAMPLE_BLOCKS) -> CompressionScore:
    """Dictionaries from one half of a bounded labelled sample, the calibration from the other half, weighted so that
    the classes count as often as they are labelled outside the held-out fold; no held-out label is read. Without rows of both
    classes the score is a constant."""
    texts = labelled_sample(docs, labels, target, rows, True, spread_blocks(text_of(), BLOCK, blocks))
    sample = sorted((r["k"], r["t"], r["y"]) for r in texts.collect())  # at most 2 * rows * blocks * BLOCK code points
    counts = {r["y"]: r["n"] for r in usable_labels(labels, target).groupBy("y").agg(F.count("*").alias("n")).collect()}  # two values
    by = {c: [t for _, t, y in sample if y == c] for c in (0, 1)}
    if min(len(by[0]), len(by[1])) < 2:
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return CompressionScore(b"", b"", 0.0, math.log(share / (1 - share)))
    model = CompressionScore(*(_dictionary(by[c][::2]) for c in (1, 0)))
    rest = [(t, c) for c in (0, 1) for t in by[c][1::2]]
    y = np.array([c for _, c in rest], float)
    weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    model.slope, model.shift = fit_logistic(np.array([model.of_blocks([b for s in t for b in _blocks(s.encode())]) for t, _ in rest]), y, weight * len(y) / weight.sum())
    return model


def score_quality(docs: DataFrame, model: CompressionScore, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability ``name`` that a text is good; an existing column of that name is replaced.

    Every whole text is compressed, block by block. Null counts as empty; an empty text gets the score of no difference.
    """
    base = docs.drop(name)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            found = pa.array([shipped.value.score(t.as_py()) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(name, T.DoubleType())]))
