"""Benchmark decontamination: a hash set of normalised benchmark n-grams, scanned over every text's word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certjobs.llm.common import attach, gate, gate_bits, passing, text_of, written
from certjobs.llm.words import ALNUM, Words, grams, mix, signed, slices

#: Consecutive words of a window.
WINDOW = 10
#: Windows that may be broadcast (28 bytes each beside the items' texts, so some 64 MB); a larger benchmark is joined by a
#: shuffle on the window hashes.
BROADCAST_WINDOWS = 1_500_000

#: Texts of one window that meet its items in one task, where the benchmark is joined.
SPREAD = 10_000

#: Fixed value: a word of the lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("clean_text", T.StringType()),
    ]
)


def item_windows(words: Words, row: int, window: int) -> tuple[int, int, int]:
    """(first word, number of windows, words of a window) of a benchmark item."""
    a, b = int(words.cuts[row]), int(words.cuts[row + 1])
    size = min(window, b - a)
    return a, (b - a - size + 1 if size else 0), size


class WindowSet:
    """The windows of all items as flat arrays: by window length, sorted hashes with the bytes (words joined by one blank) and
    the item of each. A window takes 28 bytes beside its item's text, which is held once."""

    def __init__(self, items: list[str], texts: list[str | None], window: int):
        self.items, parts, base = items, [], 0
        rows: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for w in slices(pa.array(texts, pa.large_string()), ALNUM, True):
            for r in range(w.rows):
                a, n, size = item_windows(w, r, window)
                if not n:
                    continue
                words = [w.word(i) for i in range(a, a + n + size - 1)]
                ends = np.cumsum([len(x) + 1 for x in words])
                starts = np.concatenate([[0], ends[:-1]])
                hashes = grams(w.hashes[a : a + n + size - 1], size)
                rows.setdefault(size, []).append((hashes, base + starts[:n], (ends[size - 1 :] - starts[:n] - 1).astype(np.int32), np.full(n, w.first + r, np.int32)))
                parts.append(b" ".join(words) + b" ")
                base += int(ends[-1])
        self.text = b"".join(parts)
        self.by_size = {}
        for size, found in rows.items():
            keys, *rest = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.argsort(keys, kind="stable")
            self.by_size[size] = (keys[order], *(c[order] for c in rest), self._bits(keys))

    @staticmethod
    def _bits(keys: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << 20, bool)
        bits[keys & np.uint64((1 << 20) - 1)] = True
        return bits

    def scan(self, w: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words lie in an occurrence of a window, and the items found by row."""
        edge, items = np.zeros(len(w.hashes) + 1, np.int64), {}
        for size, (keys, starts, lengths, owners, bits) in self.by_size.items():
            g = grams(w.hashes, size)
            at = np.flatnonzero(bits[g & np.uint64((1 << 20) - 1)])
            low = np.searchsorted(keys, g[at])
            high = np.searchsorted(keys, g[at], "right")
            rows = np.searchsorted(w.cuts, at, "right") - 1
            inside = (low < high) & (at + size <= w.cuts[rows + 1])
            for i, lo, hi, r in zip(at[inside].tolist(), low[inside].tolist(), high[inside].tolist(), rows[inside].tolist(), strict=True):
                own = b" ".join([w.word(x) for x in range(i, i + size)])
                same = [k for k in range(lo, hi) if lengths[k] == len(own) and self.text.startswith(own, int(starts[k]))]
                if same:
                    edge[i] += 1
                    edge[i + size] -= 1
                    items.setdefault(r, set()).update(self.items[owners[k]] for k in same)
        return np.cumsum(edge[:-1]) > 0, items


def _without_words(value: str, hit: np.ndarray) -> str:
    """A text without its hit words; what stands between words stays."""
    raw = np.frombuffer(value.encode(), np.uint8)
    alone = next(slices(pa.array([value], pa.large_string()), ALNUM, True))
    edge = np.zeros(len(raw) + 1, np.int64)
    edge[alone.starts[: len(hit)][hit]] += 1
    np.add.at(edge, alone.ends[: len(hit)][hit], -1)
    return raw[np.cumsum(edge[:-1]) == 0].tobytes().decode()


def _added(batch: pa.RecordBatch, text: str, found: WindowSet, clean: bool) -> list[pa.Array]:
    n_words, n_hit, items, cleaned = [], [], [], []
    for w in slices(batch.column(batch.schema.get_field_index(text)), ALNUM, True):
        hit, owners = found.scan(w)
        total = np.concatenate([[0], np.cumsum(hit)])
        n_words.append(np.diff(w.cuts))
        counts = total[w.cuts[1:]] - total[w.cuts[:-1]]
        n_hit.append(counts)
        items += [sorted(owners.get(r, ())) for r in range(w.rows)]
        for r in range(w.rows) if clean else ():
            value = batch.column(batch.schema.get_field_index(text))[w.first + r].as_py()
            cleaned.append(_without_words(value, hit[int(w.cuts[r]) : int(w.cuts[r + 1])]) if counts[r] and value else value)
    join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    return [
        pa.array(join(n_words), pa.int64()),
        pa.array(join(n_hit), pa.int64()),
        pa.array(items, pa.list_(pa.string())),
        pa.array(cleaned if clean else [None] * len(items), pa.string()),
    ]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, clean: bool = False, broadcast_windows: int = BROADCAST_WINDOWS, spread: int = SPREAD,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (ids of the benchmark items found, as sorted strings) and, where
    ``clean`` is set, ``clean_text`` (the text without the hit words).

    Words are runs of letters and digits of the lower-cased text. A window is ``window`` consecutive words of an item;
    an item with fewer words is one window. A word inside an occurrence of a window is hit; every hash hit is verified
    word by word, and removal works alike whatever the benchmark's size. Null and empty texts have no words, null stays null; an empty benchmark hits nothing; items with null ids or without
    words are left out; repeated rows are judged alike. Added columns replace columns of the same names.

    The benchmark is measured first: up to ``broadcast_windows`` windows (a word may begin one) and sixteen bytes of text for each,
    they go to every task; beyond that, the windows of both sides meet in a shuffle on their hash and their words. There a
    window that very many documents hold is no hot key, as each distinct window comes once from the items and meets the
    documents' windows by ``attach``.
    """
    items = benchmark.select(F.col(item).cast("string").alias("item"), text_of(item_text).alias("text")).filter("item IS NOT NULL")
    size = items.agg(F.sum(F.greatest(F.lit(1), F.size(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))))).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    size = max(size["n"] or 0, (size["b"] or 0) // 16)
    base = docs.drop(*[f.name for f in ADDED])
    if size > broadcast_windows:
        return _by_shuffle(base, items, text, window, clean, spread)
    rows = items.collect()
    found = docs.sparkSession.sparkContext.broadcast(WindowSet([r["item"] for r in rows], [r["text"] for r in rows], window))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = _added(batch, text, found.value, clean)
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *ADDED.names])

    return base.mapInArrow(scan, T.StructType([*base.schema.fields, *ADDED.fields]))


def _windows(rows: DataFrame, window: int, sizes: list[int] | None) -> DataFrame:
    """Windows of (id, text) rows: (id, at, h, words), h from the length and the words; of items if ``sizes`` is None."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for w in slices(batch.column(1), ALNUM, True):
                for r in range(w.rows):
                    a, b = int(w.cuts[r]), int(w.cuts[r + 1])
                    for size in sizes if sizes is not None else [min(window, b - a)]:
                        if size and b - a >= size:
                            h = signed(mix(grams(w.hashes[a:b], size) + np.uint64(size)))
                            for k in range(0, len(h), 20_000):
                                n = len(h[k : k + 20_000])
                                words = [b" ".join([w.word(x) for x in range(a + i, a + i + size)]) for i in range(k, k + n)]
                                yield pa.RecordBatch.from_arrays(
                                    [pa.repeat(ids[w.first + r], n), pa.array(np.arange(k, k + n)), pa.repeat(pa.scalar(size, pa.int32()), n), pa.array(h[k : k + n]), pa.array(words, pa.binary())],
                                    ["id", "at", "size", "h", "words"],
                                )

    return rows.mapInArrow(emit, "id string, at long, size int, h long, words binary")


def _by_shuffle(base: DataFrame, items: DataFrame, text: str, window: int, clean: bool, spread: int) -> DataFrame:
    """The same for a benchmark too large to broadcast. Equal texts are scanned once, by their SHA-256; every hit is a hit word by
    word, as the words are part of the key."""
    owned = written(_windows(items.select("item", "text"), window, None), "windows")
    sizes = [r["size"] for r in owned.select("size").distinct().collect()]  # at most ``window`` values
    marked = base.withColumn("__sha", F.sha2(text_of(text), 256))
    texts = marked.groupBy("__sha").agg(F.first(text_of(text)).alias("text"))
    bits = gate_bits(owned.count())
    slot = F.pmod(F.col("h"), F.lit(bits))
    gates = gate(owned.select(slot.alias("slot")).distinct())  # spares writing windows that no item has
    found = written(passing(_windows(texts, window, sizes), slot, gates).filter("__pass").drop("__pass"), "scanned")
    key = ["size", "h", "words"]
    uses = found.join(owned.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.count("*").alias("uses"))
    uses = written(uses, "uses")
    hits = written(attach(found, uses, key, "uses").filter("uses IS NOT NULL"), "hits")
    spans = hits.groupBy("id").agg(F.collect_set(F.struct("at", "size")).alias("spans"))
    # a window's texts and its items meet as pairs; the texts of one in many texts are spread over parts, and its items repeated for each
    parts = F.ceil(F.col("uses") / spread).cast("int")
    held = hits.select("id", *key, F.pmod(F.xxhash64("id"), parts).cast("int").alias("part")).distinct()
    owners = owned.select(F.col("id").alias("item"), *key).distinct().join(uses, key).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("uses")
    pairs = held.join(owners, [*key, "part"]).select("id", "item").distinct()
    items_of = pairs.groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, cleaned = [], [], []
            for w in slices(batch.column(1), ALNUM, True):
                for r in range(w.rows):
                    n, row = int(w.cuts[r + 1] - w.cuts[r]), w.first + r
                    edge = np.zeros(n + 1, np.int64)
                    for span in batch.column(2)[row].as_py() or ():
                        edge[span["at"]] += 1
                        edge[span["at"] + span["size"]] -= 1
                    hit = np.cumsum(edge[:-1]) > 0
                    n_words.append(n)
                    n_hit.append(int(hit.sum()))
                    value = batch.column(1)[row].as_py() if clean else None
                    cleaned.append(_without_words(value, hit) if value and n_hit[-1] else value)
            made = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(cleaned, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["__sha", "n_words", "n_hit", "clean_text"])

    judged = texts.join(spans.withColumnRenamed("id", "__sha"), "__sha", "left").select("__sha", "text", "spans")
    judged = judged.mapInArrow(judge, "__sha string, n_words long, n_hit long, clean_text string").join(items_of.withColumnRenamed("id", "__sha"), "__sha", "left")
    out = marked.join(judged, "__sha", "left").withColumns(
        {"items": F.coalesce("items", F.array().cast("array<string>")), "clean_text": F.when(F.col(text).isNotNull(), F.col("clean_text"))}
    )
    return out.select(*base.columns, *ADDED.names)
