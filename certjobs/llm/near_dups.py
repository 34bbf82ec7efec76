"""N-gram Jaccard join over a token-group matrix: exact links between texts, and the components they make."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certjobs.llm.common import NONE, attach, components, forget, gate_bits, text_of, without, written
from certjobs.llm.frequent import among, frequent_hashes
from certjobs.llm.words import NOT_SPACE, Words, grams, mix, signed, slices, whole

#: Words of a shingle, and the least similarity in hundredths.
SHINGLE = 5
LEAST = 80
#: Shingles that a larger share of the documents hold come last in every order, and are dealt apart.
HOT = 1 / 2000
#: Independent minima by which documents are first put into groups, and how many must agree.
MINIMA = 8
AGREEING = 4
#: Least bits of the gate that spares taking texts apart which no candidate needs (2 MB); it grows with the candidates, to 32 MB.
GATE_BITS = 1 << 24
#: Bytes of text that a task takes apart at a time.
STEP = 1 << 20
#: Sets of one document's partners that a task compares together, on average, and members of a list that meet together.
PAIRS = 256
BLOCK = 500

_SEEDS = mix(np.arange(101, 101 + MINIMA, dtype=np.uint64))


def shingles(w: Words, r: int, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a row: of ``size`` words, or of all its words if they are fewer."""
    h = w.hashes[w.cuts[r] : w.cuts[r + 1]]
    return np.unique(grams(h, min(size, len(h)))) if len(h) else np.empty(0, np.uint64)


def least_overlap(n: int, least: int) -> int:
    """Common elements that a set of ``n`` needs at least with any set it links to; such a set has as many elements at least."""
    return (least * n + 99) // 100


def needed_hits(n: int, least: int) -> int:
    """Common elements asked for within a prefix; grows with ``n``."""
    return min(least_overlap(n, least), 1 + n // 10)


def prefix_length(n: int, least: int) -> int:
    """With the elements of all sets in one order, each of the first h common elements of two linked sets lies in the first
    n - least_overlap + h elements of each (behind it come the other common ones, least_overlap - h at least). So the prefixes
    of two linked sets have as many common elements as the lesser of their two ``needed_hits``."""
    return n - least_overlap(n, least) + needed_hits(n, least)


def prefix_bound(n: int, least: int) -> int:
    """Elements of its prefix that a linked set has in the prefix of another set at least: a partner has ``least_overlap``
    elements or more, and ``needed_hits`` grows with the size."""
    return needed_hits(least_overlap(n, least), least)


SKETCH = "d long, tag long, u long, n int, pre array<long>, hot array<long>"


def _sketch(size: int, least: int, frequent: np.ndarray):
    """(d, text, tag) -> a hash of the row's whole set (u), the set's size, and its prefix (rare shingles, then hot ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column(0)
            for w in slices(batch.column(1), NOT_SPACE, True, STEP):
                cols: list[list] = [[] for _ in range(4)]
                for r in range(w.rows):
                    s = shingles(w, r, size)
                    hot = among(s, frequent)
                    ordered = np.concatenate([s[~hot], s[hot]])[: prefix_length(len(s), least)]
                    rare = min(len(ordered), int((~hot).sum()))
                    for c, v in zip(cols, (_identity(s), len(s), signed(ordered[:rare]), signed(ordered[rare:])), strict=True):
                        c.append(v)
                types = [pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 2]
                made = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
                own = slice(w.first, w.first + w.rows)
                yield pa.RecordBatch.from_arrays([d[own], batch.column(2)[own], *made], ["d", "tag", "u", "n", "pre", "hot"])

    return run


def _minima(s: np.ndarray) -> np.ndarray:
    return signed(np.array([mix(s ^ k).min() for k in _SEEDS if len(s)], np.uint64))


def _identity(s: np.ndarray) -> int:
    return int(signed(np.array([whole(s, 0x2545F4914F6CDD1D)], np.uint64))[0])


def _shared(least: int):
    """Rows (w, n, u) in order -> partial counts (u, k) of the shingles that another set holds too whose size lets the two link;
    repeated rows count once. In order of size a set has such a partner if its next neighbour on either side is one, so nothing
    is held but the last set seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_ = None, False  # open_: the last row of the batch before is not known to be shared yet
        for batch in batches:
            w, n, u = (np.asarray(batch.column(i)) for i in range(3))
            counted = [np.empty(0, np.int64)]
            if len(w):
                new = np.ones(len(w), bool)
                new[1:] = (w[1:] != w[:-1]) | (u[1:] != u[:-1])
                new[0] = last is None or (w[0], u[0]) != (last[0], last[2])
                w, n, u = w[new], n[new].astype(np.int64), u[new]
            if len(w):
                fits = np.zeros(len(w), bool)
                fits[1:] = (w[1:] == w[:-1]) & (100 * n[:-1] >= least * n[1:])
                fits[0] = last is not None and w[0] == last[0] and 100 * last[1] >= least * n[0]
                if open_ and fits[0]:
                    counted.append(np.array([last[2]]))
                counted.append(u[fits | np.append(fits[1:], False)])
                last, open_ = (int(w[-1]), int(n[-1]), int(u[-1])), not bool(fits[-1])
            ids, k = np.unique(np.concatenate(counted), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(k, pa.int64())], ["u", "k"])

    return run


def _gate(ids: DataFrame, size: int) -> np.ndarray:
    """A bitmap of ``size`` bits that has the slot of every id, gathered as parts of 4 KB."""
    slot = F.pmod(F.xxhash64("d"), F.lit(size)) + 1  # the first bitmap holds 1 to 32768
    parts = ids.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for r in parts.collect():
        raw = np.frombuffer(r["bits"], np.uint8)
        bits[(r["part"] - 1) * 4096 :][: len(raw)] |= raw
    return bits


def _sets(size: int, bits: np.ndarray, frequent: np.ndarray):
    """(d, slot, text) -> the whole sets (rare shingles and hot ones) and their minima, for the rows whose slot the gate has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.asarray(batch.column(1))
            batch = batch.filter(pa.array((bits[slot >> 3] >> (slot & 7)) & 1 == 1))
            for w in slices(batch.column(2), NOT_SPACE, True, STEP) if batch.num_rows else ():
                sets = [shingles(w, r, size) for r in range(w.rows)]
                hot = [among(s, frequent) for s in sets]
                made = [
                    pa.array([_identity(s) for s in sets], pa.int64()), pa.array([signed(s[~h]) for s, h in zip(sets, hot, strict=True)], pa.list_(pa.int64())),
                    pa.array([signed(s[h]) for s, h in zip(sets, hot, strict=True)], pa.list_(pa.int64())), pa.array([_minima(s) for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0)[w.first : w.first + w.rows], *made], ["d", "u", "rare", "hot", "mins"])

    return run


def _linked(least: int):
    """Rows (a, part, b, set) in order, each ``a``'s own set (b null) before its partners' -> the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of = np.empty(0, np.int64), None
        for batch in batches:
            a, b, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for i in range(len(a)):
                s = np.asarray(batch.column(3)[i].values)
                if b[i] is None:
                    own, of = np.sort(s), a[i]
                elif a[i] == of:
                    both = int(among(s, own).sum())
                    if both and 100 * both >= least * (len(s) + len(own) - both):
                        out.append((a[i], b[i]))
            cols = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) of a written table whose whole sets link. The set of ``a`` is shipped once for each PAIRS of its partners."""
    asked = written(pairs.groupBy("a").agg((F.floor(F.count("*") / PAIRS) + 1).cast("int").alias("parts")), "asked")
    ids = written(pairs.select(F.col("a").alias("u")).union(pairs.select("b")).distinct(), "ids")
    used = written(sets.join(ids, "u", "left_semi").select("u", F.concat("rare", "hot").alias("set")), "used")
    own = used.join(asked, F.col("u") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "set")
    others = pairs.join(asked, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    others = others.join(used, F.col("b") == F.col("u")).select("a", "part", "b", "set")
    both = own.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return both.mapInArrow(_linked(least), "a long, b long").distinct()


def _lo(n: Column, least: int) -> Column:
    """``least_overlap`` as a column."""
    return F.floor((F.lit(least) * n + 99) / 100)


def _bound(n: Column, least: int) -> Column:
    """``prefix_bound`` as a column."""
    return F.least(_lo(_lo(n, least), least), F.lit(1) + F.floor(_lo(n, least) / 10))


def _possible(n: Column, m: Column, room: Column, least: int) -> Column:
    """Whether two sets of ``n`` and ``m`` elements may link if at most ``room`` of them are common: a link has
    ``least / (100 + least)`` of the sum of both sizes in common at least."""
    return (F.lit(100 + least) * room >= F.lit(least) * (n + m)) & (F.lit(100) * F.least(n, m) >= F.lit(least) * F.greatest(n, m))


def token_groups(sets: DataFrame, sizes: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """The token-group matrix: a row (w, u, n, room, l) for each shingle w of a set u that another group holds too, and another
    set of a size that lets the two link (in order of size, one of its two neighbours then).

    ``l`` names the list of the sets that hold w, so shingles with equal lists have one name. ``room`` is the number of shared
    shingles of u from w on, in one order of all shingles (rare before frequent): two sets whose first common shingle is w
    have no more than the lesser room in common. Sets that share fewer than ``least_overlap`` shingles with other groups are
    ruled out.
    """
    placed = sets.withColumn("n", (F.size("rare") + F.size("hot")).cast("long")).join(nodes.select(F.col("node").alias("u"), "component"), "u", "left")
    group = F.coalesce("component", "u").alias("c")
    facts = {"low": F.min("c"), "high": F.max("c"), "df": F.count("*"), "sig": F.sum(F.xxhash64("u").cast("decimal(38,0)"))}
    named = F.xxhash64("df", F.col("sig").cast("string")).alias("l")
    # the group is named after the shuffle, which is narrower for the nulls
    rare = placed.select("u", "component", "n", F.explode("rare").alias("w")).repartition("w").select("u", "n", "w", group)
    of_w = Window.partitionBy("w")
    by_size = of_w.orderBy("n", "u")
    fits = (100 * F.lag("n").over(by_size) >= least * F.col("n")) | (100 * F.col("n") >= least * F.lead("n").over(by_size))
    rare = rare.select("*", fits.alias("fits"), *[v.over(of_w).alias(k) for k, v in facts.items()]).filter("fits AND low < high").select("u", "w", "df", named)
    often = placed.select("u", group, F.explode("hot").alias("w"))
    # hot shingles are at most (shingles per row) / HOT, whatever the size of the table
    lists = often.groupBy("w").agg(*[v.alias(k) for k, v in facts.items()]).filter("low < high").select("w", "df", named)
    often = often.join(F.broadcast(lists), "w").select("u", "w", (F.col("df") + (1 << 40)).alias("df"), "l")
    of_u = Window.partitionBy("u")
    ranked = rare.unionByName(often).select("*", F.count("*").over(of_u).alias("k"), F.row_number().over(of_u.orderBy("df", "w")).alias("at"))
    kept = ranked.join(sizes.select("u", F.col("n").cast("long").alias("n")), "u").filter(F.col("k") >= _lo(F.col("n"), least))
    return kept.select("w", "u", "n", (F.col("k") - F.col("at") + 1).alias("room"), "l")


def _meet(least: int):
    """Rows (l, x, y, own, u, n, c, room) in order of l, x, y -> the pairs (a, b) of a list's blocks x and y that may link."""

    def pairs(rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x, y, own, u, n, c, room = rows
        order = np.argsort(n, kind="stable")
        own, u, n, c, room = own[order], u[order], n[order], c[order], room[order]
        until = np.searchsorted(n, 100 * n // least, "right")  # a partner's set is larger by no more than this
        for i in range(len(u)):
            s = slice(i + 1, int(until[i]))
            fits = (c[s] != c[i]) & ((100 + least) * np.minimum(room[s], room[i]) >= least * (n[s] + n[i]))
            if x[0] != y[0]:
                fits &= own[s] != own[i]
            b = u[s][fits]
            if len(b):
                yield np.minimum(b, u[i]), np.maximum(b, u[i])

    def batch_of(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        cols = [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(2)]
        parts.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    def closed(waiting: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for a, b in pairs([np.concatenate(c) for c in zip(*waiting, strict=True)]):
            parts.append((a, b))
            held += len(a)
            if held > 50_000:
                yield batch_of(parts)
                held = 0
        yield batch_of(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting = None, []
        for batch in batches:
            cols = [np.asarray(batch.column(i)) for i in range(8)]
            if not batch.num_rows:
                continue
            keys = cols[:3]
            turn = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
            for s, e in zip(turn, np.append(turn[1:], batch.num_rows), strict=True):
                key = tuple(int(k[s]) for k in keys)
                if key != current:
                    if waiting:
                        yield from closed(waiting)
                    current, waiting = key, []
                waiting.append([c[s:e] for c in cols[1:]])
        if waiting:
            yield from closed(waiting)

    return run


def candidates(matrix: DataFrame, leaders: bool, least: int) -> DataFrame:
    """Pairs (a, b, ca, cb) of sets in different groups which the matrix does not rule out: each set of a list with the one of
    the most room (``leaders``), or all pairs that have room. Lists are dealt in blocks of BLOCK sets."""
    lists = matrix.filter(F.col("room") >= _lo(F.col("n"), least)).groupBy("l", "u").agg(F.max("room").alias("room"), F.first("n").cast("long").alias("n"), F.first("c").alias("c"))
    lists = written(lists, "lists")
    if leaders:
        heads = lists.groupBy("l").agg(F.max(F.struct("room", "n", "u", "c")).alias("top"), F.count("*").alias("size")).filter("size > 1")
        met = attach(lists, heads, ["l"], "size").filter(F.col("top").isNotNull() & (F.col("c") != F.col("top.c")))
        met = met.filter(_possible(F.col("n"), F.col("top.n"), F.least("room", "top.room"), least))
        return met.select(F.least("u", "top.u").alias("a"), F.greatest("u", "top.u").alias("b")).distinct()
    sizes = lists.groupBy("l").agg(F.count("*").alias("size")).filter("size > 1")
    dealt = attach(lists, sizes, ["l"], "size").filter(F.col("size").isNotNull()).withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = dealt.select("l", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "u", "n", "c", "room")
    return keyed.repartition("l", "x", "y").sortWithinPartitions("l", "x", "y").mapInArrow(_meet(least), "a long, b long").distinct()


def opened(pairs: DataFrame, matrix: DataFrame, least: int) -> DataFrame:
    """Of the pairs, those where each of the two sets has enough in common with the token union of the other's group."""
    place = matrix.groupBy("u").agg(F.first("n").alias("n"), F.first("c").alias("c"))
    side = lambda one, other: (
        pairs.select(one, other).join(place.select(F.col("u").alias(other), "c"), other).select(F.col(one).alias("u"), F.col("c").alias("g"), F.col(other).alias("o"))
    )
    asked = written(side("a", "b").unionByName(side("b", "a")), "asked")
    # only the rows of sets and groups that are asked about go on
    groups = written(asked.select("g").distinct(), "groups")
    unions = matrix.select("w", F.col("c").alias("g")).join(groups, "g", "left_semi").distinct()
    shared = matrix.select("w", "u", "n").join(written(asked.select("u", "g").distinct(), "bounds"), "u").join(unions, ["w", "g"])
    kept = shared.groupBy("u", "g").agg(F.countDistinct("w").alias("k"), F.first("n").alias("n")).filter(F.col("k") >= _lo(F.col("n"), least))
    open_ = asked.join(kept.select("u", "g"), ["u", "g"]).select("u", "o")
    both = pairs.join(open_.select(F.col("u").alias("a"), F.col("o").alias("b")), ["a", "b"], "left_semi")
    return both.join(open_.select(F.col("u").alias("b"), F.col("o").alias("a")), ["a", "b"], "left_semi").select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, least: int = LEAST, tag: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_shingles``, ``component_id``, the smallest key reachable by links, ``group_id``, which
    names the component (null for texts without words), and ``tag``, if one is given, a long by which rows can be told apart.

    Words are separated by ASCII white space, A to Z lower-cased. Two texts link when the common shingles are at least
    ``least`` hundredths of all shingles of both. Null and empty texts have no shingles and link with nothing. Rows
    that repeat a key are judged each by its own text; a null key counts as the smallest; an empty table gives no rows.

    Steps: (1) rows with equal sets are one class, of which one row stands for all; (2) only classes whose prefix has enough
    shingles in the prefixes of others of a fitting size (``prefix_bound``) go on, with whole sets; (3) those whose minima agree with the first
    of their bucket make the first groups, once the two whole sets are found to link; (4) the token-group matrix bounds what a
    set has in common with all other groups, with any set of a list (``room``), and with a single group's token union; only
    what passes is opened, which is to say that whole sets are compared. Lists first meet their leader, so that groups
    grow, then all pairs that are left. Links inside a group add nothing to components, so they are not listed; no
    link between groups is lost.
    """
    none = F.coalesce(F.col(key).cast("long"), F.lit(NONE))
    texts = docs.select(none.alias("d"), text_of(text).alias("text"), (F.lit(0) if tag is None else tag).cast("long").alias("tag"))
    per_row: Callable[[Words, int], np.ndarray] = lambda w, r: shingles(w, r, size)
    frequent = frequent_hashes(texts.select("text"), NOT_SPACE, True, per_row, HOT)
    sketch = written(texts.mapInArrow(_sketch(size, least, frequent), SKETCH), "sketch")

    per_class = [F.min("d").alias("rep"), F.count("*").alias("size"), F.max(F.size("hot")).alias("hot")]
    classes = written(sketch.filter("n > 0").groupBy("u", "n").agg(*per_class), "classes")
    rare = sketch.select(F.explode("pre").alias("w"), "n", "u")
    counts = rare.repartition("w").sortWithinPartitions("w", "n", "u").mapInArrow(_shared(least), "u long, k long").groupBy("u").agg(F.sum("k").alias("k"))
    enough = F.coalesce("k", F.lit(0)) + F.col("hot") >= _bound(F.col("n"), least)  # hot shingles count as shared without a look
    alive = written(classes.join(counts, "u", "left").filter(enough).select("u", "n", "rep"), "alive")
    narrow = written(sketch.select("d", "tag", "u", "n"), "rows")
    forget(sketch)  # prefixes are a third of all shingles

    bits = max(GATE_BITS, gate_bits(alive.count()))
    slot = F.pmod(F.xxhash64("d"), F.lit(bits)).alias("slot")
    made = _sets(size, _gate(alive.select(F.col("rep").alias("d")), bits), frequent)
    passed = written(texts.select("d", slot, "text").mapInArrow(made, "d long, u long, rare array<long>, hot array<long>, mins array<long>"), "passed")
    # what the gate let through besides is known by ids alone, so that whole sets are not shuffled to drop it
    gone = written(passed.select("d", "u").join(alive.select(F.col("rep").alias("d"), "u"), ["d", "u"], "left_anti"), "gone")
    sets = written(without(passed, gone, {"d": F.col("d"), "u": F.col("u")}).drop("d"), "sets")
    forget(passed)

    minima = sets.select("u", (F.size("rare") + F.size("hot")).alias("n"), F.posexplode("mins").alias("j", "v"))
    heads = minima.groupBy("j", "v").agg(F.min(F.struct("u", "n")).alias("head"), F.count("*").alias("size")).filter("size > 1")
    star = attach(minima, heads, ["j", "v"], "size").filter(F.col("head").isNotNull() & (F.col("u") != F.col("head.u")))
    star = star.filter(_possible(F.col("n"), F.col("head.n"), F.least("n", "head.n"), least)).groupBy(F.col("head.u").alias("a"), F.col("u").alias("b")).agg(F.count("*").alias("k"))
    tried = written(star.filter(F.col("k") >= AGREEING).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "star")

    links = written(verify(tried, sets, least), "links")
    nodes = components(links)
    tokens = written(token_groups(sets, alive, nodes, least), "matrix")
    for leaders in (True, False):
        placed = tokens.join(nodes.select(F.col("node").alias("u"), "component"), "u", "left")
        matrix = placed.select("w", "u", "n", F.coalesce("component", "u").alias("c"), "room", "l")
        pairs = written(candidates(matrix, leaders, least).join(tried, ["a", "b"], "left_anti"), "candidates")
        pairs = written(opened(pairs, matrix, least), "opened")
        if pairs.isEmpty():
            continue
        tried = tried.unionByName(pairs)
        links = links.unionByName(written(verify(pairs, sets, least), "links"))
        nodes = components(links)

    grouped = written(nodes.withColumnRenamed("node", "u").join(classes, "u"), "grouped")
    smallest = grouped.groupBy("component").agg(F.min("rep").alias("smallest"), F.count("*").alias("members"))
    named = attach(grouped.select("u", "n", "component"), smallest, ["component"], "members").select("u", "n", "smallest", F.col("component").alias("group"))
    joined = classes.join(named, ["u", "n"], "left").select("u", "n", "size", F.coalesce("smallest", "rep").alias("component"), F.coalesce("group", "u").alias("group"))
    out = attach(narrow.select("d", "tag", "u", "n"), joined, ["u", "n"], "size")
    real = lambda c: F.when(c != NONE, c)
    return out.select(real(F.col("d")).alias(key), F.col("n").cast("long").alias("n_shingles"), real(F.coalesce("component", "d")).alias("component_id"), F.col("group").alias("group_id"), *([] if tag is None else ["tag"]))
