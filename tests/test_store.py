"""Stored results by job: two jobs, a re-run, a clear, deletes, and plans without exchanges of stored rows."""

from pyspark.sql import functions as F

from certjobs.functions.geometry import cell_hits, region_hits, template_regions
from certjobs.jobs import extraction
from certjobs.operators import report, tables
from certjobs.sources import derived
from certjobs.sources.store import Store, store_run

SMALL = "/root/testdata/sf0.001"


def job(spark, number, pages=None):
    docs = derived.documents(spark, SMALL).filter(F.col("job_id") == number).persist()
    own = derived.certificate_pages(spark, SMALL).join(docs.select("doc_id"), "doc_id", "left_semi")
    return extraction.complete(extraction.routed(own if pages is None else own.filter(pages), docs)), docs


def counts(store):
    return {(n, r["job_id"]): r["count"] for n, rows in store.tables().items() for r in rows.groupBy("job_id").count().collect()}


def test_jobs_in_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), buckets=3)
    for number in (3, 4):
        store_run(store, job(spark, number)[0], extraction.tables_of, [number])
    first = counts(store)
    assert {j for _, j in first} == {3, 4} and first["fields", 4] == 9 * first["certificates", 4] and first["documents", 3] == first["certificates", 3]
    store_run(store, job(spark, 4)[0], extraction.tables_of, [4])
    assert counts(store) == first
    store_run(store, job(spark, 4, "page_no = 1 AND doc_id % 10 <> 0")[0], extraction.tables_of, [4])  # no ledgers any more
    after = counts(store)
    assert ("transfers", 4) not in after and after["transfers", 3] == first["transfers", 3] and after["documents", 4] == first["documents", 4]
    failed = store.table("documents", 4).filter("status = 'failed'")
    assert failed.count() == first["documents", 4] - after["certificates", 4] and {r["error_type"] for r in failed.collect()} == {"NoPages"}

    again = Store(spark, str(tmp_path / "store"))
    assert again.buckets == 3 and counts(again) == after
    out = again.tables()
    nested = tables.nested_results(*(out[n] for n in ("certificates", "fields", "transfers", "outcomes")))
    left = again.without(again.table("documents").filter("doc_id % 3 = 0"))["fields"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for rows in (nested, left):
            assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        assert nested.count() == after["certificates", 3] + after["certificates", 4]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # pages by key follow one another without a gap
    whole, last, seen = [r["doc_id"] for r in again.table("certificates", 3).orderBy("doc_id").collect()], None, []
    while page := [r["doc_id"] for r in tables.page_after(again.table("certificates", 3), last, 7).collect()]:
        seen, last = seen + page, page[-1]
    assert seen == whole
    # deleted certificates go with their children, and only theirs
    gone = {r["doc_id"] for r in again.table("certificates", 3).filter("doc_id % 2 = 0").collect()}
    again.delete(again.table("documents").filter("doc_id % 2 = 0"), again.table("documents", 3))
    now = counts(again)
    assert now["certificates", 3] == first["certificates", 3] - len(gone) and now["certificates", 4] == after["certificates", 4] and now["documents", 3] == first["documents", 3]
    assert not gone & {r["doc_id"] for r in again.table("outcomes").collect()}
    again.clear(3)
    assert {j for _, j in counts(again)} == {4}


def test_merged_summaries_are_the_summary(spark):
    rows = [(j, j * 10 + i, f, f"v{i}" if i % 3 else None, (i + j) / 20, i % 2 == 0) for j in range(4) for i in range(6) for f in ("a", "b")]
    fields = spark.createDataFrame(rows, "job_id long, doc_id long, field_name string, value string, confidence double, needs_review boolean")
    parts = report.field_partials(fields.filter("job_id < 2"))
    parts = report.replace_partials(parts, report.field_partials(fields.filter("job_id >= 1")))  # job 1 once more
    text = lambda rows: sorted(map(str, rows.collect()))
    assert text(report.merged_summary(parts)) == text(report.field_summary(fields))
    assert text(report.merged_summary(parts.filter("job_id <> 2"))) == text(report.field_summary(fields.filter("job_id <> 2")))


def test_cells_find_what_boxes_find(spark):
    """Also on region borders, beyond the page's edges, and with one layout for each line's page."""
    spots = [(-0.3, 0.5), (0.0, 0.0), (0.13, 0.5), (0.15, 0.12), (0.5, 0.05), (0.95, 1.0), (1.2, 1.3), (0.2, 0.07), (0.7, 0.7), (0.4999999, 0.15)]
    rows = [(i, 1, 0, 1000, 1000, p, 1000 * x, 1000 * y, 1000 * x, 1000 * y, 5) for i, (x, y) in enumerate(spots) for p in (1, 2)]
    lines = spark.createDataFrame(rows, "doc_id long, page_no int, line_no int, image_width int, image_height int, layout_page int, x1 double, y1 double, x2 double, y2 double, layout_id long")
    layouts = template_regions(spark).withColumn("layout_id", F.explode(F.array(F.lit(5).cast("long"), F.lit(6).cast("long"))))
    text = lambda rows: sorted(str(tuple(r)) for r in rows.select("doc_id", "page_no", "line_no", "region").collect())
    found = cell_hits(lines, layouts)
    assert text(found) == text(region_hits(lines, template_regions(spark))) and found.count() > 20
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
