"""Progress, reviews, deletes, uploads, streams, pixels."""

import json
import os

import numpy as np
from pyspark.sql import functions as F

from certjobs.jobs.queries import extraction_errors
from certjobs.operators import quality, report, tables
from certjobs.operators.pages import page_errors, page_findings
from certjobs.sources import io
from certjobs.streaming.progress import extract_page_stream, merge_status, read_page_stream
from tests.test_extraction import HOLDER, SENTENCE, page


def test_progress(spark):
    jobs = spark.createDataFrame([(1, "running"), (2, "paused"), (3, "queued")], "job_id long, status string")
    docs = spark.createDataFrame([(1, 1, "done"), (2, 1, "failed"), (3, 1, "done"), (4, 2, "done")], "doc_id long, job_id long, status string")
    got = tables.job_progress(jobs, docs)
    rows = {r["job_id"]: (r["total"], r["done"], r["failed"], r["waiting"], r["percent"]) for r in got.collect()}
    assert rows == {1: (3, 2, 1, 0, 100), 2: (1, 1, 0, 0, 100), 3: (0, 0, 0, 0, 0)}
    ended = {r["job_id"]: r["status"] for r in tables.complete_jobs(got, F.current_timestamp()).collect()}
    assert ended == {1: "complete", 2: "paused", 3: "complete"}


def test_reviews(spark):
    fields = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "doc_id long, field_name string, value string")
    rows = [(1, "a", True, "v1", "u", 1), (1, "a", False, None, "w", 3), (1, "a", True, None, "v", 2)]
    reviews = spark.createDataFrame(rows, "doc_id long, field_name string, has_value boolean, reviewed_value string, reviewed_by string, t long").withColumn("reviewed_at", F.timestamp_seconds("t"))
    got = {r["doc_id"]: r for r in tables.effective_values(tables.review_overlay(fields, reviews)).collect()}
    assert got[1]["reviewed"] and got[1]["reviewed_value"] is None and got[1]["reviewed_by"] == "w" and got[1]["has_value"] and got[1]["effective_value"] == "x"
    assert not got[2]["reviewed"] and got[2]["effective_value"] == "y"


def test_delete(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    left = tables.bulk_delete({"t": ids(1, 1, 2, 3)}, ids(1, 3, 9), ids(1, 2))
    assert sorted(r["doc_id"] for r in left["t"].collect()) == [2, 3]


def test_uploads(spark):
    rows = [("virus.exe", 1), ("a b(1).PDF", 5), ("big.png", 26_214_401), (".pdf", 1), ("x.tar.gz", 1)]
    accepted, rejected = io.validate_uploads(spark.createDataFrame(rows, "filename string, length long"))
    assert [(r["safe_name"], r["file_type"]) for r in accepted.collect()] == [("a_b1.PDF", "pdf")]
    assert {r["filename"]: r["reason"] for r in rejected.collect()} == {
        "virus.exe": "Unsupported file type .exe", "big.png": "File exceeds maximum upload size", ".pdf": "Unsupported file type ", "x.tar.gz": "Unsupported file type .gz"
    }


def test_stream_is_batch(spark, tmp_path):
    rows = [page(i, 1, ("Cert.No.OB%d" % i, (20, 20, 200, 50)), ("CERT NO", (0, 0, 1, 1)), *HOLDER, SENTENCE) for i in range(6)]
    folder = os.path.join(tmp_path, "pages")
    spark.createDataFrame(rows, io.PAGES).repartition(3).write.parquet(folder)
    stream = extract_page_stream(read_page_stream(spark, folder, files=1)).writeStream.format("memory").queryName("streamed").outputMode("append").start()
    stream.processAllAvailable()
    stream.stop()
    whole = extract_page_stream(io.read_pages(spark, folder))
    assert sorted(map(tuple, spark.table("streamed").collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert whole.count() == 54


def test_status_merge(spark):
    make = lambda *r: spark.createDataFrame(list(r), "doc_id long, job_id long, status string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    state = merge_status(make((1, 1, "done", 5), (2, 1, "pending", 1)), make((1, 1, "pending", 4), (2, 1, "failed", 2)))
    assert {r["doc_id"]: r["status"] for r in state.collect()} == {1: "done", 2: "failed"}


def test_page_quality(spark):
    flat, noisy = np.full((16, 16), 200, np.uint8), (np.indices((16, 16)).sum(0) % 2 * 255).astype(np.uint8)
    rows = [(1, 1, 16, 16, flat.tobytes()), (2, 1, 16, 16, noisy.tobytes()), (3, 1, 16, 16, b"short"), (4, 1, 16, 16, None)]
    got = {r["doc_id"]: r for r in quality.page_quality(spark.createDataFrame([(a, b, c, d, bytearray(e) if e else None) for a, b, c, d, e in rows], "doc_id long, page_no int, h int, w int, gray binary")).collect()}
    assert (got[1]["blur"], got[1]["contrast"], got[1]["illumination"]) == (0.0, 0.0, 0.0)
    assert got[2]["blur"] == 1020.0**2 and got[2]["contrast"] == 127.5 and got[3]["blur"] is None and got[4]["blur"] is None
    plan = quality.preprocessing_plan(spark.createDataFrame([(50.0, 40.0, 9.0, 84.0), (400.0, 60.0, 1.0, 0.1)], "blur double, contrast double, illumination double, angle double")).collect()
    assert plan[0]["steps"] == ["grayscale", "border_removal", "deskew(6.00deg)", "sharpen(blur_score=50)", "clahe_contrast"] and plan[0]["layout_threshold"] == "adaptive"
    assert plan[1]["steps"] == ["grayscale", "border_removal", "denoise"]


def test_exports(spark, tmp_path):
    docs = spark.createDataFrame([(2, "b.pdf", "failed", "ocr", "E", "m"), (1, "a.pdf", "done", None, None, None)], "doc_id long, original_filename string, status string, error_stage string, error_type string, error_message string")
    out = os.path.join(tmp_path, "failed")
    io.write_csv(tables.export_failed(docs), out, one_file=True)
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".csv"))
    assert text == "File name,Error Stage,Error Type,Error Message\nb.pdf,ocr,E,m\n"


def test_manifest(spark, tmp_path):
    os.makedirs(tmp_path / "a" / "b")
    for name, size in (("a/x.pdf", 3), ("a/b/y z.PNG", 2), ("a/b/empty.pdf", 0), ("a/b/v.exe", 1)):
        (tmp_path / name).write_bytes(b"x" * size)
    found = io.read_manifest(spark, str(tmp_path))
    assert sorted((r["filename"], r["length"]) for r in found.collect()) == [("v.exe", 1), ("x.pdf", 3), ("y z.PNG", 2)]
    accepted, _ = io.validate_uploads(found)
    assert sorted((r["safe_name"], r["file_type"], r["status"]) for r in accepted.collect()) == [("x.pdf", "pdf", "pending"), ("y_z.PNG", "png", "pending")]
    jobs = spark.createDataFrame([(7, "queued")], "job_id long, status string")
    pending = accepted.select(F.xxhash64("path").alias("doc_id"), F.lit(7).cast("long").alias("job_id"), "status")
    assert [(r["total"], r["waiting"], r["percent"]) for r in tables.job_progress(jobs, pending).collect()] == [(2, 2, 0)]
    assert tables.work_selection(jobs, pending).count() == 2


def test_read_pages_composes(spark, tmp_path):
    folder = os.path.join(tmp_path, "pages")
    rows = [page(1, 1, ("ﬁve １２ cafe\u0301", (0, 0, 1, 1)), ("b", (0, 2, 1, 3))), page(1, 2, ("c", (0, 0, 1, 1)))]
    spark.createDataFrame(rows, io.PAGES).write.parquet(folder)
    for compose, first in ((False, "ﬁve １２ cafe\u0301"), (True, "five 12 caf\u00e9")):
        got = {r["page_no"]: r for r in io.read_pages(spark, folder, compose=compose).collect()}
        assert [x["text"] for x in got[1]["lines"]] == [first, "b"] and got[2]["image_width"] == 1000 and got[1]["lines"][0]["confidence"] == 0.95
    assert io.read_pages(spark, folder).dtypes == io.read_pages(spark, folder, compose=True).dtypes == spark.createDataFrame([], io.PAGES).dtypes


def test_report_json(spark, tmp_path):
    certs = spark.createDataFrame([(1, "1.pdf", "passed", ""), (2, "2.pdf", "failed", "x")], "doc_id long, source_file string, validation_status string, validation_flags string")
    fields = spark.createDataFrame([(1, "b", None, 0.0, "regex", True), (1, "a", "v", 0.5, "ocr", False)], "doc_id long, field_name string, value string, confidence double, source string, needs_review boolean")
    counts = spark.createDataFrame([(1, 3, 1)], "doc_id long, transfer_rows long, transfer_rows_needing_review long")
    records = report.accuracy_records(certs, fields, counts, spark.createDataFrame([(1, 2)], "doc_id long, num_pages long"))
    want = [
        {"file": "1.pdf", "num_pages": 2, "fields": {"a": {"value": "v", "confidence": 0.5, "source": "ocr", "needs_review": False}, "b": {"value": None, "confidence": 0.0, "source": "regex", "needs_review": True}},
         "validation_status": "passed", "validation_flags": "", "transfer_rows": 3, "transfer_rows_needing_review": 1},
        {"file": "2.pdf", "num_pages": None, "fields": None, "validation_status": "failed", "validation_flags": "x", "transfer_rows": 0, "transfer_rows_needing_review": 0},
    ]
    assert sorted((json.loads(r["value"]) for r in report.report_json(records).collect()), key=lambda r: r["file"]) == want
    folder = os.path.join(tmp_path, "json")
    io.write_json(records, folder)
    lines = [x for f in os.listdir(folder) if f.endswith(".json") for x in open(os.path.join(folder, f))]
    assert sorted(map(json.loads, lines), key=lambda r: r["file"]) == want


def test_page_errors(spark):
    line = [(0, "x", 0.9, 0.0, 0.0, 1.0, 1.0)]
    rows = [
        (1, 1, 10, 10, line), (2, 1, 10, 10, line), (2, 1, None, 10, []), (3, 1, 10, 0, line), (3, 2, 10, 10, line), (4, 1, 10, 10, [(0, " ", 0.9, 0.0, 0.0, 1.0, 1.0), (1, None, 0.9, 0.0, 0.0, 1.0, 1.0)]),
        (4, 2, 10, 10, None), (5, None, 10, 10, line), (6, 1, 10, 10, []), (6, 2, 10, 10, line), (9, 1, 10, 10, None),
    ]
    documents = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7, 7)], "doc_id long")
    got = {r["doc_id"]: (r["stage"], r["type"], r["message"]) for r in page_errors(documents, spark.createDataFrame(rows, io.PAGES)).collect()}
    assert got == {
        2: ("PDF_CONVERSION", "PageNumber", "1 page numbers missing or repeated"), 3: ("OCR", "PageSize", "1 pages without size"),
        5: ("PDF_CONVERSION", "PageNumber", "1 page numbers missing or repeated"), 7: ("PDF_CONVERSION", "NoPages", "no pages"),
    }
    assert page_errors(documents, spark.createDataFrame([], io.PAGES)).count() == 7


def test_page_findings_name_documents_without_text(spark):
    line = lambda *texts: [(i, t, 0.9, 0.0, 0.0, 1.0, 1.0) for i, t in enumerate(texts)]
    rows = [
        (1, 1, 10, 10, line("x")), (2, 1, 10, 10, line(" ", None)), (2, 2, 10, 10, None), (3, 1, 10, 10, []), (3, 2, 10, 10, []), (3, 3, 10, 10, line("", "x")),
        (4, 1, None, 10, []), (5, 1, 10, 10, line("\t\u00a0\u3000")), (6, 1, 10, 10, line(".")), (9, 1, 10, 10, []), (8, None, 10, 10, []), (8, None, 10, 10, []),
    ]
    documents = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7, 7, 8)], "doc_id long")
    found = page_findings(documents, spark.createDataFrame(rows, io.PAGES))
    got = {r["doc_id"]: (r["type"], r["warning_type"], r["warning_message"]) for r in found.collect()}
    none = ("NoText", "no text on any page")
    assert got == {2: (None, *none), 4: ("PageSize", *none), 5: (None, *none), 7: ("NoPages", None, None), 8: ("PageNumber", *none)}
    out = {r["doc_id"]: (r["status"], r["warning_type"]) for r in tables.document_outcomes(documents.distinct(), found).collect()}
    assert out == {1: ("done", None), 2: ("done", "NoText"), 3: ("done", None), 4: ("failed", "NoText"), 5: ("done", "NoText"), 6: ("done", None), 7: ("failed", None), 8: ("failed", "NoText")}
    assert page_findings(documents, spark.createDataFrame([], io.PAGES)).filter("warning_type IS NOT NULL").count() == 0


def test_extraction_errors_judge_text(spark):
    """Every document whose lines are gone is told from those that have text."""
    got = extraction_errors(spark, "/root/testdata/sf0.001").filter("doc_id > 0")
    silent = {r["doc_id"] for r in got.filter("warning_type = 'NoText' AND warning_message = 'no text on any page'").collect()}
    every = {r["doc_id"]: r["status"] for r in got.collect()}
    assert len(every) > 1000 and silent == {d for d in every if d % 13 == 0} and {every[d] for d in silent} == {"done", "failed"}


def test_clear_job_keeps_documents_without_job(spark):
    docs = spark.createDataFrame([(1, 3), (2, 4), (3, None)], "doc_id long, job_id long")
    out = tables.clear_job({"t": docs.select("doc_id")}, docs, spark.createDataFrame([(3, 5), (4, 6)], "job_id long, total_files int"), 3)
    assert sorted(r["doc_id"] for r in out["documents"].collect()) == sorted(r["doc_id"] for r in out["t"].collect()) == [2, 3]
    assert {r["job_id"]: r["total_files"] for r in out["jobs"].collect()} == {3: 0, 4: 6}
