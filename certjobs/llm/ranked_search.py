"""Ranked lexical search over a clustered index: documents in the order of a recursive graph bisection, cut into shards with a
bound on what each term can score in them; shards are visited by their bounds until no other can reach the ten best.

Items (the queries) are taken in blocks of at most BLOCK_TERMS terms, so what tasks know of them is bounded; for each block one
index is built over the block's terms:

1. Every whole text becomes its length and the counts of the block's terms; these vectors are written.
2. The bisection is fitted on at most SAMPLE documents (chosen by a hash of their ids): halves of each group swap documents while that
   shortens the gaps between documents of one term. What is left of it is, for each group, a preference of each term for one half.
   All documents go down that tree, so each has a place in the new order, by leaf and length.
3. The order is cut into shards of at most SHARD documents; a large leaf (copies of one text, say) gives many. A shard is one row with
   its postings, what each posting scores, and for each term the most that any of its documents scores.
4. For each item the FIRST shards with the highest bounds are visited; the tenth best score then rules out all shards whose bound is
   below it. All others are visited, so the result is exact. A bound equal to that score rules nothing out, as equal scores are told
   apart by doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from certjobs.llm.common import written
from certjobs.llm.words import ALNUM, release, slices

BLOCK_TERMS = 1 << 18
SAMPLE, LEAF, MOST_DEPTH, ROUNDS = 20_000, 64, 8, 12
#: Terms beyond so many share a preference in the tree (but nothing else).
FEATURES = 1 << 13
SHARD, FIRST, BEST = 512, 8, 10
#: Shards named one by one in a scan's filter; if more are needed, all are read.
LISTED = 2000


@dataclass
class Items:
    """A block of items: their ids, the hashes of their terms (sorted), and for item i the terms ``terms[cuts[i]:cuts[i + 1]]`` with how
    often each occurs in the item."""

    ids: list
    vocabulary: np.ndarray
    cuts: np.ndarray
    terms: np.ndarray
    times: np.ndarray


def _block(ids: list, found: list[np.ndarray]) -> Items:
    vocabulary = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
    each = [np.unique(np.searchsorted(vocabulary, h), return_counts=True) for h in found]
    cuts = np.cumsum([0] + [len(t) for t, _ in each])
    flat = lambda k: np.concatenate([e[k] for e in each]).astype(np.int64) if each else np.empty(0, np.int64)
    return Items(ids, vocabulary, cuts, flat(0), flat(1))


def blocks(items: DataFrame) -> Iterator[Items]:
    """The items (item_id, text) in blocks; an item without terms is left out, as nothing scores for it."""
    ids, found, held = [], [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        for w in slices(pa.array([row["text"] or ""]), ALNUM, True):
            if not len(w.hashes):
                continue
            ids.append(row["item_id"])
            found.append(w.hashes)
            held += len(w.hashes)
        if held > BLOCK_TERMS:
            yield _block(ids, found)
            ids, found, held = [], [], 0
    if ids:
        yield _block(ids, found)


# ---- vectors and statistics


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of values[cuts[i]:cuts[i + 1]]."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[cuts[1:]] - total[cuts[:-1]]


def _lists(cuts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, values) of a list column."""
    offsets = column.offsets.to_numpy()
    return (offsets - offsets[0]).astype(np.int64), column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy()


def vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs): each document's number of terms, and which of ``vocabulary`` it has how often. Terms are told apart by
    64-bit hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column(1), ALNUM, True):
                at = np.minimum(np.searchsorted(vocabulary, w.hashes), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[at] == w.hashes)
                row = np.searchsorted(w.cuts, hit, "right") - 1
                keys, tfs = np.unique(row * len(vocabulary) + at[hit], return_counts=True)
                cuts = np.searchsorted(keys, np.arange(w.rows + 1) * len(vocabulary))
                arrays = [batch.column(0).slice(w.first, w.rows), pa.array(np.diff(w.cuts), pa.int64()), _lists(cuts, keys % len(vocabulary), pa.int32()), _lists(cuts, tfs, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "terms", "tfs"])
        release()

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("terms", ints), T.StructField("tfs", ints)])
    return written(docs.select("doc_id", "text").mapInArrow(count, schema), "vectors")


def statistics(rows: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(documents with terms, all their terms, documents that hold each term), summed within tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size + 2, np.int64)
        for batch in batches:
            n = batch.column(0).to_numpy()
            held[size:] += [(n > 0).sum(), n.sum()]
            held[:size] += np.bincount(_flat(batch.column(1))[1], minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some])], ["term", "held"])

    found = rows.select("n", "terms").mapInArrow(count, "term int, held long").groupBy("term").agg(F.sum("held").alias("held"))
    out = np.zeros(size + 2, np.int64)
    for r in found.collect():  # at most one row a term of the block
        out[r["term"]] = r["held"]
    return int(out[size]), int(out[size + 1]), out[:size]


# ---- recursive graph bisection


def _gap_cost(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What it costs to write down d documents among n by their gaps."""
    return d * (np.log2(np.maximum(n, 1)) - np.log2(d + 1))


def _swapped(group: np.ndarray, side: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Sides after the documents that gain most have changed places, in pairs, as long as a pair gains."""
    rank = np.empty(len(group), np.int64)
    order = np.lexsort((-gain, side, group))
    keys = (group * 2 + side)[order]
    starts = np.searchsorted(keys, keys)
    rank[order] = np.arange(len(order)) - starts
    place = group * len(group) + rank
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    _, i, j = np.intersect1d(place[left], place[right], return_indices=True)
    pair = gain[left[i]] + gain[right[j]] > 1e-9
    out = side.copy()
    out[left[i[pair]]], out[right[j[pair]]] = 1, 0
    return out


def bisection(cuts: np.ndarray, terms: np.ndarray, features: int, depth: int) -> list[np.ndarray]:
    """For each level a table (group, feature): how much more a document with that feature costs in the group's first half."""
    docs = len(cuts) - 1
    sizes = np.diff(cuts)
    of = np.repeat(np.arange(docs), sizes)
    order = np.lexsort((sizes, np.where(sizes > 0, terms[np.minimum(cuts[:-1], max(len(terms) - 1, 0))] if len(terms) else 0, -1)))
    place = np.empty(docs, np.int64)
    place[order] = np.arange(docs)
    group, tables = np.zeros(docs, np.int64), []
    for level in range(depth):
        groups = 1 << level
        by = np.lexsort((place, group))
        starts = np.searchsorted(group[by], np.arange(groups + 1))
        half = (starts[:-1] + starts[1:]) // 2
        side = np.empty(docs, np.int64)
        side[by] = np.arange(docs) >= half[group[by]]
        for _ in range(ROUNDS):
            held, n = _degrees(group, side, of, terms, groups, features)
            now = _gap_cost(n[:, 0], held[:, 0]) + _gap_cost(n[:, 1], held[:, 1])
            gains = [
                now - _gap_cost(n[:, 0], np.maximum(held[:, 0] - 1, 0)) - _gap_cost(n[:, 1], held[:, 1] + 1),
                now - _gap_cost(n[:, 0], held[:, 0] + 1) - _gap_cost(n[:, 1], np.maximum(held[:, 1] - 1, 0)),
            ]
            cell = group[of] * features + terms
            gain = _sums(np.where(side[of] == 0, gains[0].ravel()[cell], gains[1].ravel()[cell]), cuts)
            changed = _swapped(group, side, gain)
            if (changed != side).sum() <= docs // 200:
                break
            side = changed
        held, n = _degrees(group, side, of, terms, groups, features)
        more = [_gap_cost(n[:, h] + 1, held[:, h] + 1) - _gap_cost(n[:, h] + 1, held[:, h]) for h in (0, 1)]
        tables.append((more[0] - more[1]).astype(np.float32))
        group = group * 2 + side
    return tables


def _degrees(group: np.ndarray, side: np.ndarray, of: np.ndarray, terms: np.ndarray, groups: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents with each feature by group and half, documents by group and half)."""
    at = group * 2 + side
    held = np.bincount(at[of] * features + terms, minlength=groups * 2 * features).reshape(groups, 2, features)
    return held, np.bincount(at, minlength=groups * 2).reshape(groups, 2, 1)


def leaves(tables: list[np.ndarray], cuts: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The leaf of each document: at each level into the half where its terms cost less."""
    node = np.zeros(len(cuts) - 1, np.int64)
    of = np.repeat(np.arange(len(node)), np.diff(cuts))
    for table in tables:
        node = node * 2 + (_sums(table[node[of], terms].astype(np.float64), cuts) > 0)
    return node


def fitted(rows: DataFrame, documents: int, size: int) -> list[np.ndarray]:
    """The bisection's tables, from a sample of at most SAMPLE vectors."""
    some = rows.filter("size(terms) > 0")
    if documents > SAMPLE:
        share = max(1, round((1 << 30) * SAMPLE / documents))
        some = some.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(1 << 30)) < share)
    sample = some.select("terms").limit(SAMPLE).toArrow().column("terms").combine_chunks()
    depth = min(MOST_DEPTH, max(0, int(math.log2(max(len(sample), 1) / LEAF))), max(0, round(math.log2(max(documents, 1) / SHARD))))
    if not depth:
        return []
    cuts, terms = _flat(sample)
    features = min(size, FEATURES)
    return bisection(cuts, terms.astype(np.int64) % features, features, depth)


# ---- shards


def shards(rows: DataFrame, tables: list[np.ndarray], documents: int, total: int) -> DataFrame:
    """The index: one row a shard, written. ``docs`` are its doc_ids, ``terms`` its terms, ``tops`` the most that each scores;
    ``posts[starts[i]:starts[i + 1]]`` are the places in ``docs`` that hold term i and ``gains`` what they score, before the term's weight."""
    spark = rows.sparkSession
    tree = spark.sparkContext.broadcast(tables)  # at most 2^MOST_DEPTH * FEATURES numbers

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, terms = _flat(batch.column("terms"))
            found = leaves(tree.value, cuts, terms.astype(np.int64) % tree.value[0].shape[1]) if tree.value else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, "leaf"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, n = batch.column("leaf").to_numpy(), batch.column("n").to_numpy()
            cuts, terms = _flat(batch.column("terms"))
            tfs = _flat(batch.column("tfs"))[1].astype(np.int64)
            m = 25 + 75 * n * documents // total
            gains = 1_000_000_000 * tfs // (1000 * tfs + 8 * np.repeat(m, np.diff(cuts)))
            runs = np.concatenate([[0], np.flatnonzero(leaf[1:] != leaf[:-1]) + 1, [len(leaf)]])
            bounds = np.append(np.concatenate([np.arange(a, b, SHARD) for a, b in zip(runs[:-1], runs[1:], strict=True)]), len(leaf))
            out: dict[str, list] = {c: [] for c in ("terms", "tops", "starts", "posts", "gains")}
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                at = slice(cuts[a], cuts[b])
                order = np.argsort(terms[at], kind="stable")
                posts = np.repeat(np.arange(b - a), np.diff(cuts[a : b + 1]))[order]
                kinds, starts = np.unique(terms[at][order], return_index=True)
                gained = gains[at][order]
                for c, v in zip(out, (kinds, np.maximum.reduceat(gained, starts), np.append(starts, len(posts)), posts, gained), strict=True):
                    out[c].append(v)
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), batch.column("doc_id"))
            columns = [_lists(np.cumsum([0] + [len(v) for v in vs]), np.concatenate(vs), pa.int32()) for vs in out.values()]
            keys = (np.int64(part) << 32) + made + np.arange(len(bounds) - 1)
            made += len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys), ids, *columns], ["shard", "docs", *out])

    leafed = rows.filter("size(terms) > 0").mapInArrow(placed, rows.schema.add("leaf", T.IntegerType()))
    # the row's number parts documents that are alike in all else, so that no range holds more than its share
    order = ["leaf", "n", "row"]
    sorted_rows = leafed.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ints = ["terms", "tops", "starts", "posts", "gains"]
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("docs", T.ArrayType(rows.schema["doc_id"].dataType))] + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ints])
    return written(sorted_rows.mapInArrow(packed, schema), "shards")


# ---- search


class Search:
    """What tasks know of a block of items: weights of their terms, and the scores that shards have to reach."""

    def __init__(self, items: Items, weights: np.ndarray) -> None:
        self.cuts, self.terms, self.gain, self.size = items.cuts, items.terms, items.times * weights[items.terms], len(weights)
        self.least = np.ones(len(items.ids), np.int64)
        self.seen: dict[int, set[int]] = {}

    def bounds(self, terms: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """The most that any document of a shard can score, for each item."""
        top = np.zeros(self.size, np.int64)
        top[terms] = tops
        return _sums(self.gain * top[self.terms], self.cuts)

    def scores(self, item: int, shard: dict) -> np.ndarray:
        out = np.zeros(len(shard["docs"]), np.int64)
        at = slice(self.cuts[item], self.cuts[item + 1])
        own = self.terms[at]
        place = np.minimum(np.searchsorted(shard["terms"], own), len(shard["terms"]) - 1)
        for k in np.flatnonzero(shard["terms"][place] == own):
            a, b = shard["starts"][place[k]], shard["starts"][place[k] + 1]
            out[shard["posts"][a:b]] += self.gain[at][k] * shard["gains"][a:b]
        return out


def _low(doc_id) -> tuple:
    return (doc_id is not None, doc_id)


def _ten(found: list[tuple[int, object]]) -> list[tuple[int, object]]:
    return sorted(found, key=lambda x: (-x[0], _low(x[1])))[:BEST]


def _rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    flat = {c: _flat(batch.column(c)) for c in ("terms", "tops", "starts", "posts", "gains")}
    for i, shard in enumerate(batch.column("shard").to_pylist()):
        yield {"shard": shard, "docs": batch.column("docs")[i].values, **{c: values[cuts[i] : cuts[i + 1]] for c, (cuts, values) in flat.items()}}


def _visit(search: Search, wanted: dict[int, list[int]] | None, kind: T.StructField):
    """Score shards for items: those of ``wanted`` by shard, or all whose bound reaches ``least`` and that have not been seen. A
    task returns at most BEST rows an item."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, best = search.least.copy(), {}
        for batch in batches:
            for shard in _rows_of(batch):
                if wanted is not None:
                    items = wanted.get(shard["shard"], [])
                else:
                    seen = search.seen.get(shard["shard"], ())
                    items = [i for i in np.flatnonzero(search.bounds(shard["terms"], shard["tops"]) >= least).tolist() if i not in seen]
                for i in items:
                    scores = search.scores(i, shard)
                    good = np.flatnonzero(scores >= least[i])
                    if len(good) > BEST:  # all that reach the tenth best of these, ties included
                        good = good[scores[good] >= np.partition(scores[good], -BEST)[-BEST]]
                    if len(good):
                        ids = shard["docs"].take(pa.array(good)).to_pylist()
                        best[i] = _ten(best.get(i, []) + list(zip(scores[good].tolist(), ids, strict=True)))
                        if len(best[i]) == BEST:
                            least[i] = max(least[i], best[i][-1][0])
        flat = [(i, s, d) for i, found in best.items() for s, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], pa.int64()), pa.array([f[2] for f in flat], kind)], ["item", "score", "doc_id"])

    return visit


def _best(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= BEST)


def _listed(index: DataFrame, keys: list[int]) -> DataFrame:
    return index.filter(F.col("shard").isin(keys)) if len(keys) <= LISTED else index


def _search_block(docs: DataFrame, items: Items) -> DataFrame | None:
    size = len(items.vocabulary)
    rows = vectors(docs, items.vocabulary)
    documents, total, held = statistics(rows, size)
    if not documents:
        return None
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(h) + 1))) for h in held], np.int64)
    index = shards(rows, fitted(rows, documents, size), documents, total)
    search = Search(items, weights)
    kind = index.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("score", T.LongType()), T.StructField("doc_id", kind)])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, keys = np.empty((0, len(search.least)), np.int64), np.empty(0, np.int64)
        for batch in batches:
            (tc, terms), (_, tops) = _flat(batch.column("terms")), _flat(batch.column("tops"))
            new = np.array([search.bounds(terms[a:b], tops[a:b]) for a, b in zip(tc[:-1], tc[1:], strict=True)]).reshape(-1, len(search.least))
            both, named = np.concatenate([bounds, new]), np.concatenate([keys, batch.column("shard").to_numpy()])
            top = np.unique(np.argsort(-both, axis=0, kind="stable")[:FIRST])
            bounds, keys = both[top], named[top]
        chosen = [(i, int(keys[k]), int(bounds[k, i])) for i in range(len(search.least)) for k in np.argsort(-bounds[:, i], kind="stable")[:FIRST] if bounds[k, i] > 0]
        yield pa.RecordBatch.from_arrays([pa.array([c[j] for c in chosen], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "shard", "bound"])

    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "shard")
    first = index.select("shard", "terms", "tops").mapInArrow(heads, "item int, shard long, bound long").withColumn("k", F.row_number().over(by_bound)).filter(F.col("k") <= FIRST)
    wanted: dict[int, list[int]] = {}
    for r in first.collect():  # at most FIRST rows an item of the block
        wanted.setdefault(r["shard"], []).append(r["item"])
    if not wanted:
        return None
    arrow = to_arrow_type(kind)
    begun = written(_best(_listed(index, list(wanted)).mapInArrow(_visit(search, wanted, arrow), schema)).drop("rank"), "begun")
    for r in begun.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == BEST).collect():
        search.least[r["item"]] = r["least"]
    search.seen = {s: set(i) for s, i in wanted.items()}

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (tc, terms), (_, tops) = _flat(batch.column("terms")), _flat(batch.column("tops"))
            keys = batch.column("shard").to_pylist()
            open_ = [k for k, a, b in zip(keys, tc[:-1], tc[1:], strict=True) if set(np.flatnonzero(search.bounds(terms[a:b], tops[a:b]) >= search.least).tolist()) - search.seen.get(k, set())]
            yield pa.RecordBatch.from_arrays([pa.array(open_, pa.int64())], ["shard"])

    left = [r["shard"] for r in index.select("shard", "terms", "tops").mapInArrow(reaching, "shard long").limit(LISTED + 1).collect()]
    rest = _listed(index, left).mapInArrow(_visit(search, None, arrow), schema)
    names = docs.sparkSession.createDataFrame([(i, v) for i, v in enumerate(items.ids)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", _kind(items.ids))]))
    return _best(begun.unionByName(rest)).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def _kind(ids: list) -> T.DataType:
    return T.LongType() if all(i is None or isinstance(i, int) for i in ids) else T.StringType()


def ranked_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The BEST documents of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Terms are runs of ASCII letters and digits and of all other characters, A-Z lower-cased. Null and empty texts have none: such
    documents are in no result and count in no statistic, such items have no rows. Equal scores go by doc_id, null first; repeated
    rows are documents (or items) of their own; scores above zero only. Other columns are not read.
    """
    out = None
    for block in blocks(items):
        found = _search_block(docs, block)
        out = found if out is None else out if found is None else out.unionByName(found)
    if out is not None:
        return out
    schema = T.StructType([items.schema["item_id"], T.StructField("rank", T.IntegerType()), docs.schema["doc_id"], T.StructField("score", T.LongType())])
    return docs.sparkSession.createDataFrame([], schema)
