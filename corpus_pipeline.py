"""From raw documents to training sequences: five stages, each a Spark job over all that the one before it kept.

A row is known by its doc_id (which may be null) and a hash of its text, so rows that share a doc_id are judged each by its own
text, and rows without one are kept or dropped like any other. Of rows that are alike in both, exact deduplication keeps one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certjobs.llm.common import attach, forget, read_table, settled, text_of, without, written
from certjobs.llm.decontaminate import decontaminate
from certjobs.llm.exact_dedup import exact_dedup
from certjobs.llm.near_dups import near_duplicates
from certjobs.llm.packing import pack
from certjobs.llm.quality import fit_quality, score_quality

#: Documents with a lower quality score go.
LEAST_QUALITY = 0.3


#: Most documents that go to a Python worker at once: batches hold whole texts, and a worker and its JVM each several copies of one.
BATCH_ROWS = 2000


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, min(BATCH_ROWS, int(spark.conf.get(name)) if int(spark.conf.get(name)) > 0 else BATCH_ROWS))


def _row() -> dict[str, Column]:
    return {"doc_id": F.col("doc_id"), "tag": F.xxhash64(text_of())}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the compression classifier rejects."""
    _small_batches(spark)
    model = fit_quality(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return score_quality(docs, model, name="__score").filter(F.col("__score") >= LEAST_QUALITY).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of equal texts the one with the largest doc_id; null counts as empty and as the smallest doc_id. Of several rows with
    that text and that doc_id one stays, whatever else they hold."""
    judged = settled(lambda: exact_dedup(docs, carry=[_row()["tag"].alias("tag")]), "judged")
    gone = settled(lambda: judged.filter("NOT kept").select("doc_id", "tag").distinct(), "gone")
    again = settled(lambda: judged.filter("kept").groupBy("doc_id", "tag").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "tag"), "again")
    left = without(docs, gone, _row())
    if again.isEmpty():
        return left
    single = without(left, again, _row())
    named = again.select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (_row()["tag"] == F.col("__tag"))
    # one row of each, combined before the shuffle
    one = left.join(named, same, "left_semi").groupBy(F.col("doc_id").alias("__id"), _row()["tag"].alias("__tag")).agg(F.first(F.struct(*docs.columns)).alias("r"))
    return single.unionByName(one.select("r.*"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each component of near duplicates the document with the smallest doc_id (null is the smallest; ties by the hash
    of the text). Texts without words are no near duplicates and stay."""
    _small_batches(spark)
    found = settled(lambda: near_duplicates(docs, tag=_row()["tag"]).filter("group_id IS NOT NULL").select("doc_id", "tag", "group_id"), "components")

    def others() -> DataFrame:
        row = F.struct("doc_id", "tag")
        heads = found.groupBy("group_id").agg(F.min(row).alias("head"), F.count("*").alias("size")).filter("size > 1")
        joined = attach(found, heads, ["group_id"], "size").filter("head IS NOT NULL")
        return joined.filter(~row.eqNullSafe(F.col("head"))).select("doc_id", "tag").distinct()

    return without(docs, settled(others, "gone"), _row())


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    _small_batches(spark)
    own = docs.toDF(*[f"own_{c}" for c in docs.columns])  # so that no column of documents is taken for an added one
    found = decontaminate(own, read_table(spark, sf_dir, "benchmark"), text="own_text")
    return found.filter("n_hit = 0").select(*own.columns).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut into sequences of a power of two tokens."""
    _small_batches(spark)
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("ngram_jaccard", near), ("decontamination", clean), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over what the one before it kept; a stage's table goes once the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return docs


#: SQL cannot express the quality classifier; the tests hold each stage against a plain version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
