"""Conversations as pieces of rows in order, so that no task has to hold a whole conversation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certjobs.llm.common import written

#: Most rows of one piece.
PIECE = 256
TURN = T.StructType([T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("present", T.BooleanType())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = np.asarray(batch.column("conv").to_numpy(zero_copy_only=False))
        runs = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1, [n]])
        sizes = np.diff(runs)
        edge = sizes > PIECE
        edge[[0, -1]] = True  # it may go on in the batch, or the task, before or after
        cuts = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(runs[:-1], runs[1:], strict=True)])
        of = np.searchsorted(runs, cuts, "right") - 1
        turns = pa.StructArray.from_arrays([batch.column(f.name) for f in TURN.fields], [f.name for f in TURN.fields])
        lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, n), pa.int32()), turns)
        heads, at = pa.array(cuts), (np.int64(part) << 33) + count + np.arange(len(cuts))
        count += len(cuts)
        first = [batch.column(c).take(heads) for c in ("conv", "conv_id")]
        yield pa.RecordBatch.from_arrays([*first, pa.array(np.full(len(cuts), part, np.int64)), pa.array(at), pa.array(edge[of]), lists], ["conv", "conv_id", "part", "at", "edge", "turns"])


def pieces(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """The rows (conv_id, turn, role, text) in order, as a written table of pieces: conv (a text that stands for conv_id, null
    included), conv_id, part, at, edge, turns (turn, role, text, present).

    Order: by turn, nulls first; rows of one turn by role, then by a hash of the text, equal rows next to each other. Rows are
    dealt by ranges of that order, so a conversation that holds a third of all rows is spread over a third of the tasks. A
    conversation without ``edge`` is one piece. One with it may have several, of PIECE rows at most: in the order of ``at``, those
    of one ``part`` come from one task. ``present`` marks rows that count; the others only keep their conversation in the table.
    """
    text = F.col("text").cast("string")
    keyed = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("\0")).alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"),
        (F.lit(True) if present is None else present).alias("present"), F.xxhash64(text).alias("mark"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("mark"), F.col("row")]
    schema = T.StructType(
        [T.StructField("conv", T.StringType()), keyed.schema["conv_id"], T.StructField("part", T.LongType()), T.StructField("at", T.LongType())]
        + [T.StructField("edge", T.BooleanType()), T.StructField("turns", T.ArrayType(TURN))]
    )
    return written(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pack, schema), "pieces")
