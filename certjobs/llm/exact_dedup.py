"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certjobs.llm.common import attach, gate, gate_bits, passing, text_of, written

#: Code points hashed in the second refinement step.
PREFIX = 64


def _shared_slots(rows: DataFrame, slot: Column) -> DataFrame:
    """Slots that at least two rows fall into."""
    return rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).filter("n > 1").select("slot")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``keep_id``, ``group_size``, ``kept`` and what ``carry`` names.

    Texts are equal when they are identical; null counts as empty. The row with the largest key of a group stays.

    Refinement: (1) lengths that one document alone has are settled; (2) of the rest, pairs of length and prefix hash
    that one document alone has are settled; (3) only what is left gets its whole text hashed (SHA-256) and grouped.
    Steps 1 and 2 pass a document on if another one falls into its slot of a gate (``gate_bits``: eight bits for each document,
    32 MB at most), so they only ever pass too many, never too few; beyond 268 million documents a gate passes more and
    more, and the full hash settles the rest. Text is never shuffled: what moves is keys, lengths and hashes.

    Rows that repeat a key count as rows: of equal rows with the same largest key all are ``kept``. A null key is the
    smallest. An empty table gives no rows; empty texts are one group.
    """
    body, bits = text_of(text), gate_bits(docs.count())
    long_slot = F.pmod(F.xxhash64(F.octet_length(body)), F.lit(bits))
    start_slot = F.pmod(F.xxhash64(F.octet_length(body), F.substring(body, 1, PREFIX)), F.lit(bits))
    lengths = written(gate(_shared_slots(docs, long_slot)), "lengths")
    starts = written(gate(_shared_slots(passing(docs.select(text), long_slot, lengths).filter("__pass"), start_slot)), "starts")
    # equal texts have equal lengths and beginnings, so the second gate decides alone
    named = docs.select(F.col(key).alias("__key"), body.alias("__text"), *(carry or []))
    own_slot = F.pmod(F.xxhash64(F.octet_length("__text"), F.substring("__text", 1, PREFIX)), F.lit(bits))
    marked = passing(named, own_slot, starts)
    carried = [c for c in named.columns if c not in ("__key", "__text")]
    full = F.when(F.col("__pass"), F.unhex(F.sha2("__text", 256))).alias("__hash")
    rows = written(marked.select("__key", F.octet_length("__text").alias("__len"), full, *carried), "hashed")
    groups = (
        rows.filter(F.col("__hash").isNotNull())
        .groupBy("__len", "__hash")
        .agg(F.max("__key").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )
    joined = attach(rows, groups, ["__len", "__hash"], "group_size")
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    keep = F.when(F.col("group_size").isNull(), F.col("__key")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("__key").alias(key), keep.alias("keep_id"), size.alias("group_size"), keep.eqNullSafe(F.col("__key")).alias("kept"), *carried
    )
