"""Streams against the same rows at rest: whole documents in any order of pages, progress with late events, restarts in between."""

import os

import pytest
from pyspark.sql import functions as F

from certjobs.jobs import extraction
from certjobs.operators.pages import classify_pages, route_nested, route_pages
from certjobs.operators.tables import job_progress
from certjobs.sources import derived, io
from certjobs.streaming import documents, progress
from tests.test_extraction import HOLDER, SENTENCE, page

SMALL = "/root/testdata/sf0.001"


def text(rows, *columns):
    return sorted(str(tuple(r)) for r in (rows.select(*columns) if columns else rows).collect())


def test_routing_within_a_row_is_routing(spark):
    pages = derived.spoilt_pages(spark, SMALL).unionByName(spark.createDataFrame([page(-1, 2), page(-1, None), page(-1, None), page(-2, 3), page(-2, 3), page(-2, 3), page(-3, 1, ("CERT NO", (0, 0, 1, 1)))], io.PAGES))
    nested = pages.groupBy("doc_id").agg(F.collect_list(F.struct("page_no", "image_width", "image_height", "lines")).alias("pages"))
    columns = ["doc_id", "num_pages", "error"]
    whole = route_pages(classify_pages(pages))
    assert text(route_nested(nested), *columns) == text(whole, *columns)
    fine = [*columns, "page1", "page2"]
    assert text(route_nested(nested).filter("error IS NULL"), *fine) == text(whole.filter("error IS NULL"), *fine)


def test_text_is_judged_alike_within_a_row(spark):
    blank = [(1, 1, 10, 10, None), (1, 2, 10, 10, [(0, None, 0.9, 0.0, 0.0, 1.0, 1.0)]), (2, 1, 10, 10, []), (2, None, 10, 10, [(0, "x", 0.9, 0.0, 0.0, 1.0, 1.0)])]
    pages = derived.spoilt_pages(spark, SMALL).filter("doc_id > 2").unionByName(spark.createDataFrame(blank, io.PAGES))
    nested = pages.groupBy("doc_id").agg(F.collect_list(F.struct("page_no", "image_width", "image_height", "lines")).alias("pages"))
    got = text(route_nested(nested), "doc_id", "no_text")
    assert got == text(route_pages(classify_pages(pages)), "doc_id", "no_text") and "(1, True)" in got and "(2, False)" in got and "(26, True)" in got


def run_to_end(start):
    query = start()
    assert query.awaitTermination(60) and query.exception() is None


def test_whole_documents_on_a_stream(spark, tmp_path):
    """Pages of all documents dealt over files without order, half of them before a restart."""
    pages = derived.certificate_pages(spark, SMALL).filter("doc_id % 7 < 2")
    count = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("of_pages"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    dealt = pages.join(count, "doc_id").withColumn("part", F.pmod(F.hash("doc_id", "page_no", F.lit(3)), F.lit(6)))
    dealt = dealt.select(*documents.ARRIVING.names, "part").persist()
    for half in ("part < 3", "part >= 3"):
        dealt.filter(half).repartition(3, "part").drop("part").write.mode("append").parquet(source)
        run_to_end(lambda: documents.start_extraction(documents.read_arriving(spark, source, files=2), out, until_done=True))
    got = extraction.tables_of(spark.read.parquet(f"{out}/documents"))
    want = extraction.tables_of(extraction.complete(extraction.routed(pages)))
    for name, rows in want.items():
        assert text(got[name].select(*rows.columns)) == text(rows), name
    assert got["documents"].count() == count.count() > 200


def test_documents_that_never_are_complete(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    front = [("Cert.No.OB7", (20, 20, 200, 50)), ("CERT NO", (0, 0, 1, 1)), *HOLDER, SENTENCE]
    spark.createDataFrame([(*page(1, 1, *front), 2), (*page(2, 1, *front), 1)], documents.ARRIVING).coalesce(1).write.parquet(source)
    start = lambda: documents.start_extraction(documents.read_arriving(spark, source), out, wait="1 second", until_done=True)
    run_to_end(start)
    assert [r["doc_id"] for r in spark.read.parquet(f"{out}/documents").collect()] == [2]
    import time

    time.sleep(1.5)
    more = [(*page(2, 2, *front), 2), (*page(3, 1, *front), 1)]  # a page of a document that is gone is left out
    spark.createDataFrame(more, documents.ARRIVING).coalesce(1).write.mode("append").parquet(source)
    run_to_end(start)
    run_to_end(start)
    got = {r["doc_id"]: r["num_pages"] for r in spark.read.parquet(f"{out}/documents").collect()}
    assert got == {1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("compact", [2, 16])
def test_progress_from_changes(spark, tmp_path, monkeypatch, compact):
    monkeypatch.setattr(progress, "COMPACT", compact)
    events = derived.status_events(spark, SMALL).withColumn("part", F.pmod(F.hash("doc_id", "ts", F.lit(1)), F.lit(4))).persist()
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    schema = events.drop("part").schema
    for n in range(4):  # in no order of time, so many events are late
        events.filter(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(source)
        run_to_end(lambda: progress.start_progress(spark.readStream.schema(schema).parquet(source), folder, until_done=True))
    jobs = derived.jobs(spark, SMALL)
    want = job_progress(jobs, progress.merge_status(events.filter("false").drop("part"), events.drop("part")))
    assert text(progress.live_progress(jobs, folder).select(*want.columns)) == text(want)
    kept = sorted(map(int, (n for n in os.listdir(f"{folder}/counts"))))
    assert kept == (list(range(4)) if compact == 16 else [1, 2, 3])


def test_a_batch_writes_the_jobs_that_it_changes(spark, tmp_path):
    make = lambda *r: spark.createDataFrame(list(r), "doc_id long, job_id long, status string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    steps = [[(i, i % 10, "pending", 1) for i in range(100)], [(1, 1, "done", 5), (1, 1, "failed", 4)], [(1, 2, "done", 6), (3, 3, "pending", 0)]]
    for rows in steps:
        make(*rows).coalesce(1).write.mode("append").parquet(source)
        run_to_end(lambda: progress.start_progress(spark.readStream.schema(make(*rows).schema).parquet(source), folder, until_done=True))
    written = [{r["job_id"]: (r["total"], r["done"], r["waiting"]) for r in spark.read.parquet(f"{folder}/counts/{n}").collect()} for n in range(3)]
    assert len(written[0]) == 10 and written[1] == {1: (10, 1, 9)} and written[2] == {1: (9, 0, 9), 2: (11, 1, 10)}
