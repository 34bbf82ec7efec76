"""Page quality from gray pixels, and the preprocessing it calls for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The decision's thresholds.
SHARPEN_BELOW, DENOISE_ABOVE, CLAHE_BELOW, ADAPTIVE_ABOVE = 100.0, 300.0, 55.0, 8.0
LEAST_SKEW, MOST_SKEW = 0.3, 15.0
METRICS = "doc_id long, page_no int, blur double, contrast double, illumination double"


def metrics(gray: np.ndarray, grid: int = 8) -> tuple[float, float, float]:
    """Variance of the four-neighbour Laplacian (edges mirrored without repeating the border), standard deviation, and the
    standard deviation of block means."""
    x = gray.astype(float)
    h, w = x.shape
    p = np.pad(x, ((1, 1) if h > 1 else (0, 0), (1, 1) if w > 1 else (0, 0)), mode="reflect")
    p = np.pad(p, ((0, 0) if h > 1 else (1, 1), (0, 0) if w > 1 else (1, 1)), mode="edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * x
    bh, bw = max(1, h // grid), max(1, w // grid)
    means = [x[i : i + bh, j : j + bw].mean() for i in range(0, h, bh) for j in range(0, w, bw)]
    return float(lap.var()), float(x.std()), float(np.std(means)) if len(means) > 1 else 0.0


def page_quality(pages: DataFrame) -> DataFrame:
    """Metrics of pages (doc_id, page_no, h, w, gray: one byte a pixel, row by row). Pages without pixels, or with a number of
    them that does not fit, have null metrics."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, p, h, w, raw in batch[["doc_id", "page_no", "h", "w", "gray"]].itertuples(index=False):
                fits = raw is not None and h and w and len(raw) == h * w
                rows.append((d, p, *(metrics(np.frombuffer(raw, np.uint8).reshape(int(h), int(w))) if fits else (None, None, None))))
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "blur", "contrast", "illumination"])

    return pages.select("doc_id", "page_no", "h", "w", "gray").mapInPandas(run, METRICS)


def skew_angle(raw: Column) -> Column:
    """The correction for a measured angle: folded into (-45, 45], turned round; 0 if too small or implausible."""
    folded = F.pmod(raw, F.lit(90.0))
    angle = -F.when(folded > 45, folded - 90).otherwise(folded)
    return F.when((F.abs(angle) < LEAST_SKEW) | (F.abs(angle) > MOST_SKEW), 0.0).otherwise(angle)


def preprocessing_plan(measured: DataFrame) -> DataFrame:
    """``measured`` (blur, contrast, illumination, angle) with ``steps`` in order and ``layout_threshold``."""
    angle = skew_angle(F.col("angle"))
    steps = F.array(
        F.lit("grayscale"),
        F.lit("border_removal"),
        F.when(angle != 0, F.concat(F.lit("deskew("), F.format_string("%.2f", angle), F.lit("deg)"))),
        F.when(F.col("blur") < SHARPEN_BELOW, F.concat(F.lit("sharpen(blur_score="), F.format_string("%.0f", F.col("blur")), F.lit(")"))),
        F.when(F.col("contrast") < CLAHE_BELOW, F.lit("clahe_contrast")),
        F.when(F.col("blur") > DENOISE_ABOVE, F.lit("denoise")),
    )
    return measured.withColumns(
        {"steps": F.filter(steps, lambda s: s.isNotNull()), "layout_threshold": F.when(F.col("illumination") > ADAPTIVE_ABOVE, "adaptive").otherwise("otsu")}
    )
