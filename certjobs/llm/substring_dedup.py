"""Removal of word sequences that earlier documents hold, over prefix-partitioned suffix trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certjobs.llm.common import NONE, attach, text_of, written
from certjobs.llm.frequent import among, frequent_hashes
from certjobs.llm.words import NOT_SPACE, Words, grams, signed, slices

#: Words of a window, and of the anchor inside it.
WINDOW = 13
ANCHOR = 6
#: Anchors that a larger share of the documents hold are dealt apart.
HOT = 1 / 1000
#: Documents of one anchor, and bytes of their windows, that a task sorts at once; groups beyond either are split by the longest
#: prefix, the window itself.
GROUP = 5000
GROUP_BYTES = 8 << 20
#: Sub-keys that the rows of a large group's window are spread over: one for so many documents, and so many at least.
SALT_ROWS = 50_000
SALTS = 64
#: Texts that a task remembers in order to pass on few copies.
REMEMBERED = 1 << 18


def anchors(hashes: np.ndarray, window: int, size: int) -> np.ndarray:
    """The anchor of each window: the smallest hash of a ``size``-gram in it. Equal windows have equal anchors."""
    g = grams(hashes, size)
    inside = window - size + 1
    if len(g) < inside:
        return np.empty(0, np.uint64)
    least = g[: len(g) - inside + 1].copy()
    for k in range(1, inside):
        np.minimum(least, g[k : k + len(least)], out=least)
    return least


def _turns(a: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)


def _own_anchors(window: int, size: int):
    def per_row(w: Words, r: int) -> np.ndarray:
        a = anchors(w.hashes[w.cuts[r] : w.cuts[r + 1]], window, size)
        return np.unique(a[_turns(a)])

    return per_row


def _sized_anchors(w: Words, r: int, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors of a row and the bytes of the windows that each serves."""
    b, e = int(w.cuts[r]), int(w.cuts[r + 1])
    a = anchors(w.hashes[b:e], window, size)
    if not len(a):
        return a, np.empty(0, np.int64)
    first = _turns(a)
    held = np.add.reduceat((w.ends[b + window - 1 : e] - w.starts[b : e - window + 1]).astype(np.int64), first)
    keys, at = np.unique(a[first], return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, held)
    return keys, total


#: ASCII white space to blanks, byte by byte.
_BLANKS = bytes(0x20 if 0x09 <= c <= 0x0D else c for c in range(256))


def joined_words(w: Words, first: int, last: int, plain: bool) -> bytes:
    """Words ``first`` to ``last`` of the slice, joined by one blank; ``plain`` says that one byte stands between any two."""
    if plain:
        return w.buf[w.starts[first] : w.ends[last]].tobytes().translate(_BLANKS)
    return b" ".join([w.word(j) for j in range(first, last + 1)])


def _is_plain(w: Words, a: int, b: int) -> bool:
    return bool((w.starts[a + 1 : b] - w.ends[a : b - 1] == 1).all())


def _emit_anchors(window: int, size: int, hot: np.ndarray):
    """(d, h, text) -> (d, h, a, n, hot): the distinct anchors of each document with the bytes of their windows. Of equal texts
    that a task remembers, only those with a smaller key than all before them pass, so the one with the smallest key always does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}
        for batch in batches:
            ds, hs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for d, h in zip(ds, hs, strict=True):
                keep.append(d < least.get(h, d + 1))
                if keep[-1]:
                    if len(least) >= REMEMBERED:
                        least.clear()
                    least[h] = d
            batch = batch.filter(pa.array(keep, pa.bool_()))
            d, h = (np.asarray(batch.column(c)) for c in (0, 1))
            for w in slices(batch.column(2), NOT_SPACE, False) if batch.num_rows else ():
                each, held = zip(*[_sized_anchors(w, r, window, size) for r in range(w.rows)], strict=True)
                n, a = [len(x) for x in each], np.concatenate(each)
                rows = slice(w.first, w.first + w.rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(d[rows], n)), pa.array(np.repeat(h[rows], n)), pa.array(signed(a)), pa.array(np.concatenate(held)), pa.array(among(a, hot))],
                    ["d", "h", "a", "n", "hot"],
                )

    return run


def shared_hashes(by_text: bool, group_bytes: int = GROUP_BYTES):
    """Rows (d, h, a, n, hot) in order of a -> (d, h, a, large) of the hashes ``a`` that two rows hold (two rows with different h,
    if ``by_text``).

    At most GROUP rows wait at a time: a group that outgrows them is large, and so is one whose sum of n is above ``group_bytes``, however
    few its rows are. Hot ones are large without a look.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, h, out = [], [], {"d": [], "h": [], "a": [], "large": []}
        current, flushed, held = None, False, 0

        def put(ds, hs, a, large) -> None:
            out["d"] += ds
            out["h"] += hs
            out["a"] += [a] * len(ds)
            out["large"] += [large] * len(ds)

        def close() -> None:
            nonlocal d, h
            if d and (flushed or len(d) > 1 and (not by_text or len(set(h)) > 1)):
                put(d, h, current, flushed or held > group_bytes)
            d, h = [], []

        def batch_of() -> pa.RecordBatch:
            made = [pa.array(out[n], pa.int64()) for n in ("d", "h", "a")] + [pa.array(out["large"], pa.bool_())]
            for v in out.values():
                v.clear()
            return pa.RecordBatch.from_arrays(made, list(out))

        for batch in batches:
            hot = np.asarray(batch.column(4))
            ds, hs, a, ns = (np.asarray(batch.column(c)) for c in (0, 1, 2, 3))
            if hot.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[hot]) for x in (ds, hs, a)] + [pa.array(np.ones(int(hot.sum()), bool))], list(out))
            ds, hs, a, ns = ds[~hot], hs[~hot], a[~hot], ns[~hot]
            if len(a):
                # hashes of one row only, neither first nor last of the batch, are settled at once
                edge = np.concatenate([[True], a[1:] != a[:-1], [True]])
                alone = edge[:-1] & edge[1:]
                alone[0] = alone[-1] = False
                for x, y, z, n in zip(*(v[~alone].tolist() for v in (ds, hs, a, ns)), strict=True):
                    if z != current:
                        close()
                        current, flushed, held = z, False, 0
                    held += n
                    d.append(x)
                    h.append(y)
                    if len(d) > GROUP:
                        put(d, h, z, True)
                        d, h, flushed = [], [], True
            if len(out["d"]) > 20_000:
                yield batch_of()
        close()
        yield batch_of()

    return run


RUNS = "a long, d long, h long, at int, words string"


def _runs(window: int, size: int, apart: bool):
    """(d, h, text, shared) -> for each occurrence of a shared anchor the words of the windows it serves, as one run, or, if
    ``apart``, as a run for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ds, hs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: dict[str, list] = {n: [] for n in ("a", "d", "h", "at", "words")}
            for w in slices(batch.column(2), NOT_SPACE, False):
                for r in range(w.rows):
                    i, b = w.first + r, int(w.cuts[r])
                    keys = anchors(w.hashes[b : w.cuts[r + 1]], window, size)
                    if not len(keys):
                        continue
                    first = _turns(keys)
                    until = np.append(first[1:], len(keys))
                    shared = np.sort(np.asarray(batch.column(3)[i].values).view(np.uint64))
                    chosen = np.flatnonzero(among(keys[first], shared))
                    plain = _is_plain(w, b, int(w.cuts[r + 1]))
                    for s, e, a in zip(first[chosen].tolist(), until[chosen].tolist(), signed(keys[first[chosen]]).tolist(), strict=True):
                        for x, y in [(p, p + 1) for p in range(s, e)] if apart else [(s, e)]:
                            rows["a"].append(a)
                            rows["d"].append(ds[i])
                            rows["h"].append(hs[i])
                            rows["at"].append(x)
                            rows["words"].append(joined_words(w, b + x, b + y + window - 2, plain))
                            if len(rows["a"]) > 20_000:
                                yield _batch(rows)
            yield _batch(rows)

    return run


def _batch(rows: dict[str, list]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    made = [pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)]
    out = pa.RecordBatch.from_arrays(made, list(rows))
    for v in rows.values():
        v.clear()
    return out


def deep_nodes(group: list[tuple[int, int, int, str]], window: int) -> Iterator[tuple[int, int, int]]:
    """Suffixes of runs (d, h, at, words) that lie below a node of depth ``window`` with a smaller document: (d, h, at).

    The suffixes of the runs, each cut after ``window`` words, are the leaves of the group's subtree; sorted, the leaves
    below one node are neighbours. A node at depth ``window`` is a stretch of equal neighbours.
    """
    leaves = []
    for d, h, at, words in group:
        parts = words.split(" ")
        leaves += [(" ".join(parts[i : i + window]), d, h, at + i) for i in range(len(parts) - window + 1)]
    leaves.sort()
    node, least = None, 0
    for words, d, h, at in leaves:
        if words != node:
            node, least = words, d  # leaves of a node come in order of their documents
        elif least < d:
            yield d, h, at


def _trees(window: int):
    """Runs in order of a -> (d, h, at) of the windows that an earlier document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group = None, []
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for a, d, h, at, words in zip(*(batch.column(c).to_pylist() for c in ("a", "d", "h", "at", "words")), strict=True):
                if a != current:
                    found += deep_nodes(group, window)
                    current, group = a, []
                group.append((d, h, at, words))
            yield _found(found)
        yield _found(list(deep_nodes(group, window)))

    return run


def _found(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], ["d", "h", "at"])


JUDGED = T.StructType(
    [T.StructField("d", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
)


def _judge(window: int):
    """(d, h, text, rep, starts) -> the words that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ds, reps, starts = batch.column(0), batch.column(3), batch.column(4)
            for w in slices(batch.column(2), NOT_SPACE, False):
                rows: list[tuple[int, int, int, str]] = []
                for r in range(w.rows):
                    i, a, b = w.first + r, int(w.cuts[r]), int(w.cuts[r + 1])
                    n, gone = b - a, np.zeros(b - a + 1, np.int64)
                    if n >= window and reps[i].as_py() != ds[i].as_py():
                        gone[0] += 1  # a copy of an earlier document
                    elif starts[i].is_valid:
                        at = np.unique(np.array(starts[i].as_py(), np.int64))
                        gone[at] += 1
                        np.add.at(gone, at + window, -1)
                    keep = np.cumsum(gone[:-1]) == 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
                    plain = n > 0 and _is_plain(w, a, b)
                    text = b" ".join([joined_words(w, a + x, a + y - 1, plain) for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                    rows.append((ds[i].as_py(), n, n - int(keep.sum()), text.decode()))
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], JUDGED.names)

    return run


def substring_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_words``, ``n_removed`` and ``kept_text`` (the words left, joined by one blank).

    Words are separated by ASCII white space. A word goes if it lies in a window of ``window`` words that also starts in a
    document with a smaller key; windows are judged on the input. Null and empty texts have no words; a null key counts
    as the smallest; rows with equal keys remove nothing from each other; an empty table gives no rows.

    Equal texts are settled first, by their MD5: all but the one with the smallest key lose all windows. Of the others, each
    window goes to the group of its anchor, and only groups that two documents share are looked at: their runs of words
    meet in one shuffle, where the suffixes of a group are sorted into the leaves of its subtree, whose nodes at
    depth ``window`` are the repeats. A group of too many documents, or of windows of too many bytes, as when a few texts repeat
    one line many times, is split by the longest prefix, the window itself: then a minimum over each window, combined before its shuffle, takes the place of the sort. The joins of
    texts with what was found about them share one exchange by key.
    """
    none = F.coalesce(F.col(key).cast("long"), F.lit(NONE))
    rows = docs.select(none.alias("d"), F.xxhash64(text_of(text)).alias("h"), text_of(text).alias("text"))
    hot = frequent_hashes(rows.select("text"), NOT_SPACE, False, _own_anchors(window, anchor), HOT)

    marked = docs.select(none.alias("d"), F.xxhash64(text_of(text)).alias("h"), F.unhex(F.md5(text_of(text))).alias("c"))
    classes = marked.groupBy("c").agg(F.min("d").alias("rep"), F.count("*").alias("size"))
    info = written(attach(marked, classes, ["c"], "size").groupBy("d", "h").agg(F.min("rep").alias("rep")), "copies")

    emitted = rows.mapInArrow(_emit_anchors(window, anchor, hot), "d long, h long, a long, n long, hot boolean")
    dealt = emitted.withColumn("p", F.when(F.col("hot"), F.xxhash64("d", "h", "a")).otherwise(F.col("a")))
    held = dealt.repartition("p").drop("p").sortWithinPartitions("a").mapInArrow(shared_hashes(True, group_bytes), "d long, h long, a long, large boolean")
    shared = written(held, "shared").join(info.filter("rep = d").select("d", "h"), ["d", "h"], "left_semi")

    def runs(large: bool) -> DataFrame:
        own = shared.filter(F.col("large") == large).groupBy("d", "h").agg(F.collect_list("a").alias("shared"))
        return rows.join(own, ["d", "h"]).select("d", "h", "text", "shared").mapInArrow(_runs(window, anchor, large), RUNS)

    small = runs(False).repartition("a").sortWithinPartitions("a").mapInArrow(_trees(window), "d long, h long, at int")
    spread = F.pmod(F.xxhash64("d", "h"), F.lit(max(SALTS, info.count() // SALT_ROWS))).cast("int")
    windows = runs(True).select("d", "h", "at", F.unhex(F.md5("words")).alias("w"), spread.alias("s"))
    starts = small.unionByName(_repeated(windows)).groupBy("d", "h").agg(F.collect_list("at").alias("starts"))

    joined = rows.join(info, ["d", "h"]).join(starts, ["d", "h"], "left").select("d", "h", "text", "rep", "starts")
    out = joined.mapInArrow(_judge(window), JUDGED)
    return out.select(F.when(F.col("d") != NONE, F.col("d")).alias(key), "n_words", "n_removed", "kept_text")


def _repeated(windows: DataFrame) -> DataFrame:
    """Windows of large groups that an earlier document holds. A window's rows are spread over sub-keys, and its minimum is
    repeated for each sub-key in use, as any window may be hot."""
    repeated = windows.groupBy("w").agg(F.min("d").alias("least"), F.max("d").alias("most"), F.collect_set("s").alias("s"))
    copies = repeated.filter("least < most").select("w", F.explode("s").alias("s"), "least")
    return windows.join(copies, ["w", "s"]).filter("least < d").select("d", "h", "at")
