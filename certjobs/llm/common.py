"""What the corpus operators share: the shared folder, written intermediates, skew-safe joins and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group with more than this share of all grouped rows counts as hot; so at most 1 / HOT_SHARE groups are hot.
HOT_SHARE = 1 / 1000
#: Groups of no more rows than this are never hot.
FEW = 100
#: A null key, which counts as the smallest.
NONE = -(1 << 63)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share. Where none is set, as in tests, a new one is made
    in local mode; on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Tables that this driver has written to the shared folder, in order.
_TABLES: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back, so that lost executors cost no
    recomputation of earlier steps."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` returns, written; the tables that were written on the way there are deleted."""
    before = len(_TABLES)
    out = written(make(), label)
    for path in _TABLES[before:-1]:
        _delete(out.sparkSession, path)
    del _TABLES[before:-1]
    return out


def forget(table: DataFrame) -> None:
    """Delete a table that ``written`` gave, once nothing reads it any more."""
    files = table.inputFiles()
    if files:
        _delete(table.sparkSession, files[0].rsplit("/", 1)[0])


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bits of a gate: so many for each row, within these bounds (the upper one is 32 MB).
BITS_PER_ROW, LEAST_BITS, MOST_BITS = 8, 1 << 16, 1 << 28


def gate_bits(rows: int) -> int:
    """Bits of a gate for so many rows: the next power of two."""
    return max(LEAST_BITS, min(MOST_BITS, 1 << (BITS_PER_ROW * max(rows, 1) - 1).bit_length()))


def gate(slots: DataFrame) -> DataFrame:
    """The slots of the single column ``slot`` as bitmaps: (part, bits), 32,768 slots a row; so at most MOST_BITS / 8 bytes."""
    at = F.col("slot") + 1  # the first bitmap holds 1 to 32768
    return slots.groupBy(F.bitmap_bucket_number(at).alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits"))


def passing(rows: DataFrame, slot: Column, bitmaps: DataFrame) -> DataFrame:
    """``rows`` with ``__pass``: whether the gate has the row's slot. Gates are broadcast, as their size is bounded."""
    joined = rows.withColumn("__slot", slot).join(F.broadcast(bitmaps), F.bitmap_bucket_number(F.col("__slot") + 1) == F.col("__part"), "left")
    byte = F.conv(F.hex(F.substring("__bits", (F.pmod(F.col("__slot"), F.lit(32768)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(__byte, cast(pmod(__slot, 8) AS int)) & 1")
    marked = joined.withColumn("__byte", F.when(F.col("__part").isNotNull(), byte)).withColumn("__pass", F.coalesce(bit == 1, F.lit(False)))
    return marked.drop("__slot", "__part", "__bits", "__byte")


def without(rows: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``rows`` without those whose ``keys`` (null-safe) the written table ``gone`` has.

    Only rows that a gate over ``gone`` lets through meet it in a join; all others pass as they are, so whole texts are not
    shuffled to drop a few.
    """
    count = gone.count()
    if not count:
        return rows
    bits = gate_bits(count)
    slot = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(bits))
    marked = passing(rows, slot(keys.values()), gate(gone.select(slot([F.col(k) for k in keys]).alias("slot")).distinct()))
    listed = gone.select(*[F.col(k).alias(f"__gone_{k}") for k in keys]).distinct()
    same = [c.eqNullSafe(F.col(f"__gone_{k}")) for k, c in keys.items()]
    some = marked.filter("__pass").join(listed, same, "left_anti")
    return marked.filter("NOT __pass").unionByName(some).drop("__pass")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Left join of ``rows`` to one row per group, safe against hot groups.

    ``groups`` has one row per ``keys`` with its number of rows in ``size``; it is written once. Groups above HOT_SHARE of
    all grouped rows (at most 1 / HOT_SHARE of them, so the broadcast is bounded) meet their rows by broadcast, and these rows
    never enter the shuffle; the rows of all other groups meet in a shuffle whose largest key holds HOT_SHARE of the rows.
    Rows with a null in ``keys`` match nothing and are kept.
    """
    groups = written(groups, "groups")
    total = groups.agg(F.sum(size).alias("n")).first()["n"] or 0
    limit = max(total * HOT_SHARE, FEW)
    hot = groups.filter(F.col(size) > limit)
    if hot.isEmpty():
        return rows.join(groups, keys, "left")
    often = rows.join(F.broadcast(hot), keys, "inner")
    seldom = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.filter(F.col(size) <= limit), keys, "left")
    return often.unionByName(seldom)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (node, component), component the smallest node.

    Alternating large-star and small-star steps; each round is written to the shared folder. The work per node
    is a minimum (pre-aggregated before the shuffle), so a node with very many neighbours fills no single task.
    """
    pairs = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("size"))
        # large star: neighbours above the node move to the lowest of its neighbourhood
        large = attach(both, low, ["a"], "size").filter("b > a").select(F.col("low").alias("a"), "b")
        large = written(large.filter("a <> b").distinct(), "large")
        # small star: neighbours below the node, and the node itself, move to the lowest of them
        below = large.groupBy("b").agg(F.min("a").alias("low"), F.count("*").alias("size"))
        small = attach(large, below, ["b"], "size").select(F.col("low").alias("x"), F.col("a").alias("y"))
        own = below.select(F.col("low").alias("x"), F.col("b").alias("y"))
        pairs = written(small.union(own).filter("x <> y").distinct().toDF("a", "b"), "stars")
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == (state["n"], state["h"]):
            break
        before = (state["n"], state["h"])
    else:
        raise RuntimeError("components did not settle")
    nodes = pairs.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.union(pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


#: Share of labelled rows that no model learns from: those whose crc32(doc_id as text) has this remainder by FOLDS.
FOLDS = 5


def held_out(key: str = "doc_id") -> Column:
    """True for rows that models must not learn from; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == 0, F.lit(False))


def usable_labels(labels: DataFrame, target: str, key: str = "doc_id") -> DataFrame:
    """The labels that a model may learn from: one row (key, y) for each key outside the held-out fold, y 0 or 1."""
    return labels.filter(~held_out(key)).filter(F.col(key).isNotNull() & F.col(target).isin(0, 1)).groupBy(key).agg(F.max(target).alias("y"))


def spread_blocks(text: Column, size: int, most: int) -> Column:
    """At most ``most`` blocks of ``size`` code points, spread evenly over the whole text; all of them where there are no more."""
    n = F.ceil(F.length(text) / size).cast("int")
    taken = F.least(n, F.lit(most))
    at = F.transform(F.sequence(F.lit(0), F.greatest(taken, F.lit(1)) - 1), lambda i: F.floor(i * n / F.greatest(taken, F.lit(1))).cast("int"))
    return F.transform(at, lambda i: F.substring(text, i * size + 1, F.lit(size)))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, most: int, by_class: bool, text: Column, key: str = "doc_id") -> DataFrame:
    """A bounded sample of labelled rows outside the held-out fold, to fit a classifier on: (k, t, y).

    At most ``most`` rows (of each class, if ``by_class``), the first by a hash of their keys; ``text`` is what is taken of each.
    Only fitting uses it; scoring reads every row and whole texts."""
    usable = usable_labels(labels, target, key)
    order = [F.xxhash64(key), F.col(key)]
    if by_class:
        chosen = usable.filter("y = 0").orderBy(*order).limit(most).union(usable.filter("y = 1").orderBy(*order).limit(most))
    else:
        chosen = usable.orderBy(*order).limit(most)
    # at most 2 * most keys and labels, so the broadcast is bounded
    return docs.join(F.broadcast(chosen), key).select(F.col(key).alias("k"), text.alias("t"), F.col("y").cast("int").alias("y"))
