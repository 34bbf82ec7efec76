"""Hashes that a large share of all documents hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certjobs.llm.words import Words, signed, slices


def frequent_hashes(texts: DataFrame, kind: np.ndarray, lower: bool, per_row: Callable[[Words, int], np.ndarray], share: float) -> np.ndarray:
    """Hashes that at least ``share`` of the rows hold, counted over every row of the single column of ``texts``.

    A hash that ``share`` of all rows hold is held by as large a share of the rows of some task; so each task passes on
    those counts only. The result has at most (hashes per row) / ``share`` entries, whatever the size of the table, and is
    sorted. Hashes that are rare in some tasks may be counted a little low, so one just above ``share`` can be left out:
    use the result to spread or order work, not to decide results.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, rows = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        pending: list[np.ndarray] = []
        held = 0

        def fold() -> None:
            nonlocal keys, counts, held
            new, n = np.unique(np.concatenate(pending) if pending else np.empty(0, np.uint64), return_counts=True)
            both, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), len(both)).astype(np.int64)
            keys = both
            pending.clear()
            held = 0
            if len(keys) > 1_000_000:  # lossy counting: what is far below the share goes
                keep = counts > max(1, rows * share / 4)
                keys, counts = keys[keep], counts[keep]

        for batch in batches:
            for w in slices(batch.column(0), kind, lower, 1 << 20):
                rows += w.rows
                for r in range(w.rows):
                    h = per_row(w, r)
                    pending.append(h)
                    held += len(h)
                if held > 500_000:
                    fold()
        fold()
        keep = counts >= max(3, rows * share)
        yield pa.RecordBatch.from_arrays([pa.array(signed(keys[keep])), pa.array(counts[keep])], ["hash", "n"])

    total = texts.count()
    found = texts.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(3, total * share / 2))
    return np.sort(np.array([r["hash"] for r in found.select("hash").collect()], np.int64).view(np.uint64))


def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which ``values`` are in the sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values
