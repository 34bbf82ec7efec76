"""Packing by power-of-two decomposition: every document is cut into pieces whose lengths are powers of two."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certjobs.llm.common import written

#: Most tokens of a sequence.
MOST = 2048
#: Rows of one bucket and sub-key that are numbered together, on average.
NUMBERED = 1_000_000

#: Runs without a word boundary from which on a text goes to the tokenizers library: white space, or anything else.
_RUN = re.compile(r"(?<!\s)\s{512}|(?<!\S)\S{4096}")  # looked for where a run begins only, so each character is read once

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


class Ids:
    """Ids of whole texts under a byte-level vocabulary, as little-endian unsigned 32-bit bytes.

    The ids are those of the tokenizers library for ``file``. That library itself encodes texts that hold a special token's
    string or a long run (``_RUN``), on which the other encoder fails or slows down; any other text gets the same ids, several
    times faster, from the same vocabulary as ranks (``ranks``). The tests compare both on every code point and on such runs.
    """

    def __init__(self, file: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(file)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def of(self, text: str) -> bytes:
        if _RUN.search(text) or any(s in text for s in self.special):
            ids = self.slow.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=1)
def _ids(file: str, ranks: str) -> Ids:
    return Ids(file, ranks)


def powers(total: int, most: int = MOST) -> list[int]:
    """Lengths of the pieces of ``total`` tokens: as many of ``most`` as fit, then the binary digits of the rest."""
    out = [most] * (total // most)
    rest, bit = total % most, most >> 1
    while bit:
        if rest & bit:
            out.append(bit)
        bit >>= 1
    return out


def tokenizer_files() -> tuple[str, str]:
    """The vocabulary for the tokenizers library, and the same as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, files: tuple[str, str], key: str = "doc_id", text: str = "text", end: int = 1, most: int = MOST, keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and, on request, ``ids``.

    A document is the ids of its whole text, then ``end``. Null counts as empty: such a document is the ``end`` id
    alone. ``most`` must be a power of two.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, closing = _ids(*files), np.array([end], "<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "")
            for at in range(0, len(keys), 64):
                rows: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                for k, own_text in zip(keys[at : at + 64], texts.slice(at, 64).to_pylist(), strict=True):
                    raw, start = ids.of(own_text) + closing, 0
                    for n in powers(len(raw) // 4, most):
                        own = raw[4 * start : 4 * (start + n)]
                        for name, value in zip(rows, (k, start, n, zlib.crc32(own), len(raw) // 4, own if keep_ids else None), strict=True):
                            rows[name].append(value)
                        start += n
                types = [*[pa.int64()] * 5, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], list(rows))

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, files: tuple[str, str] | None = None, key: str = "doc_id", text: str = "text", end: int = 1, most: int = MOST, keep_ids: bool = False) -> DataFrame:
    """``pieces`` with ``bucket`` (log2 of the length), ``sequence_id`` and ``offset``.

    Each piece is a sequence of its own, exactly as long as a power of two, so no sequence crosses documents and none
    needs padding; a bucket holds the sequences of one length, so a batch drawn from one bucket is rectangular.
    Sequence ids are gapless from 0, bucket after bucket. They are dealt by numbering the rows of each bucket and
    sub-key and adding the rows of all earlier ones, so no bucket meets in one task.

    An empty table gives no rows. Rows that repeat a key are packed each for itself.
    """
    if most & (most - 1):
        raise ValueError("most must be a power of two")
    cut = written(pieces(docs, files or tokenizer_files(), key, text, end, most, keep_ids), "pieces")
    salts = max(1, cut.count() // NUMBERED + 1) * 64
    bucket = F.round(F.log2("length")).cast("int")
    rows = cut.withColumn("bucket", bucket).withColumn("__salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    # at most 12 buckets x salts rows, and salts follows the number of pieces only as one in NUMBERED / 64
    counts = rows.groupBy("bucket", "__salt").agg(F.count("*").alias("n"))
    before = counts.selectExpr(
        "bucket", "__salt", "sum(n) OVER (PARTITION BY bucket ORDER BY __salt) - n AS __within", "sum(n) OVER (PARTITION BY bucket) AS __all"
    )
    totals = before.groupBy("bucket").agg(F.first("__all").alias("n")).selectExpr("bucket", "sum(n) OVER (ORDER BY bucket) - n AS __earlier")
    offsets = before.join(totals, "bucket").select("bucket", "__salt", (F.col("__within") + F.col("__earlier")).alias("__base"))
    numbered = rows.selectExpr("*", "row_number() OVER (PARTITION BY bucket, __salt ORDER BY doc_id, start, ids_crc32) - 1 AS __n")
    joined = numbered.join(offsets, ["bucket", "__salt"])
    return joined.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("__base") + F.col("__n")).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), "bucket", *(["ids"] if keep_ids else []),
    )
