"""Continuous extraction of arriving pages, and live job progress from status events."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from certjobs.operators.fields import extract_fields, long_fields
from certjobs.operators.pages import classify_pages
from certjobs.operators.tables import WAITING, progress_of
from certjobs.sources.io import PAGES
from certjobs.streaming.documents import keyed_state


def read_page_stream(spark: SparkSession, path: str, file_format: str = "parquet", files: int | None = None) -> DataFrame:
    """Pages as they arrive in a folder."""
    reader = spark.readStream.schema(PAGES).format(file_format)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).load(path)


def extract_page_stream(pages: DataFrame) -> DataFrame:
    """Field rows of each front page, page by page: stateless, so append mode and no watermark. Works on batches alike."""
    front = classify_pages(pages).filter("page_type = 'certificate_front'")
    page = F.struct("page_no", "image_width", "image_height", "lines")
    return long_fields(extract_fields(front.select("doc_id", "page_no", page.alias("page1")), keep=["page_no"]), keep=["page_no"])


def merge_status(state: DataFrame, events: DataFrame) -> DataFrame:
    """The newest status of each document (doc_id, job_id, status, ts); an older event never replaces a newer one. Ties of
    time go to the status that comes last by name."""
    newest = F.max_by(F.struct("job_id", "status", "ts"), F.struct("ts", "status"))
    both = state.select("doc_id", "job_id", "status", "ts").unionByName(events.select("doc_id", "job_id", "status", "ts"))
    return both.groupBy("doc_id").agg(newest.alias("x")).select("doc_id", "x.*")


#: The newest status of a document.
STATUS = T.StructType([T.StructField("job_id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("at", T.LongType())])


class Newest(StatefulProcessor):
    """Keeps a document's newest status and gives what changes: one less of what was counted before, one more of what is now."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", STATUS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.newest.get() if self.newest.exists() else None
        rank = lambda x: (x is not None, x[2] if x else 0, x[1] if x else "")
        now = max([before, *((r["job_id"], r["status"], r["at"]) for r in rows)], key=rank)
        if now is before:
            return
        self.newest.update(tuple(now))
        for row, n in ((before, -1), (now, 1)):
            if row is not None:
                yield Row(job_id=row[0], status=row[1], n=n)

    def close(self) -> None:
        pass


#: After so many batches the counts are written whole and the batches before are deleted.
COMPACT = 16
COUNTS = "job_id long, total long, done long, failed long, waiting long"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/counts")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getName()) for f in files.listStatus(at)) if files.exists(at) else []


def job_counts(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The newest counts of each job (those before a batch): of its rows in the batches that are kept, the last."""
    paths = [f"{folder}/counts/{n}" for n in _versions(spark, folder) if before is None or n < before]
    if not paths:
        return spark.createDataFrame([], COUNTS)
    rows = spark.read.schema(f"{COUNTS}, version long").parquet(*paths)
    names = [c for c in rows.columns if c not in ("job_id", "version")]
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*names), "version").alias("x")).select("job_id", "x.*")


def changes(events: DataFrame) -> DataFrame:
    """(job_id, status, n) of a stream of status events (doc_id, job_id, status, ts): what each document's newest status moves."""
    timed = events.select("doc_id", "job_id", "status", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return timed.groupBy("doc_id").transformWithState(Newest(), "job_id long, status string, n int", "Append", "None")


def start_progress(events: DataFrame, folder: str, name: str = "progress", until_done: bool = False):
    """Keep the jobs' counts under ``folder`` up to date with a stream of status events; read them with ``live_progress``.

    The newest status of each document is keyed state, saved as changes; a batch writes the counts of the jobs that it changes and
    nothing else. A batch that is run again takes the counts before it and writes the same. Late events change nothing. With
    ``until_done`` it ends once all events that are there have been read.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        one = lambda *kinds: F.sum(F.when(F.col("status").isin(*kinds), F.col("n")).otherwise(0))
        moved = batch.groupBy("job_id").agg(F.sum("n").alias("d0"), one("done").alias("d1"), one("failed").alias("d2"), one(*WAITING).alias("d3"))
        old = job_counts(spark, folder, number)
        if number % COMPACT == COMPACT - 1:  # all jobs, so that the batches before are not needed any more
            joined = old.join(moved, "job_id", "full")
        else:
            joined = moved.join(old, "job_id", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        now = [(zero(F.col(c)) + zero(F.col(f"d{i}"))).alias(c) for i, c in enumerate(("total", "done", "failed", "waiting"))]
        joined.select("job_id", *now, F.lit(number).cast("long").alias("version")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/counts/{number}")
        whole = (number // COMPACT) * COMPACT - 1  # the last whole one of an earlier batch, which is committed
        for n in _versions(spark, folder):
            if n < whole:
                _delete(spark, f"{folder}/counts/{n}")

    with keyed_state(events.sparkSession, until_done):
        writer = changes(events).writeStream.queryName(name).option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").foreachBatch(merge)
        return (writer.trigger(availableNow=True) if until_done else writer).start()


def live_progress(jobs: DataFrame, folder: str) -> DataFrame:
    """Progress of all jobs as the stream has left it."""
    return progress_of(jobs, job_counts(jobs.sparkSession, folder).withColumnRenamed("total", "n"))
