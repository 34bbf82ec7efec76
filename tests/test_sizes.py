"""What makes queries grow: parts of expressions evaluated twice, passes over the pages, and what is written on the way."""

import re

import pytest
from pyspark.sql import functions as F

from certjobs.functions import dates, geometry, steps
from certjobs.functions import text as text_
from certjobs.jobs import extraction
from certjobs.jobs import queries as q
from certjobs.operators import fields as fields_
from certjobs.operators import pages as pages_
from certjobs.operators import report, transfers
from certjobs.sources import derived, io

SF = "/root/testdata/sf0.001"


def uses(rows, name: str) -> int:
    """How often the analysed plan's expressions name a column."""
    return len(re.findall(rf"\b{name}#\d+", rows._jdf.queryExecution().analyzed().toString().split("\n")[0]))


def scans(rows) -> int:
    """How often what is left to run reads the ledger's items."""
    return rows._jdf.queryExecution().optimizedPlan().toString().count("l_linenumber#")


def rows_of(rows) -> list:
    return sorted(map(str, rows.collect()))


def test_once_evaluates_its_argument_once(spark):
    rows = spark.range(5).select(steps.once(F.col("id") + 1, lambda v: v * v + F.when(v > 3, v).otherwise(-v)).alias("x"))
    assert [r["x"] for r in rows.collect()] == [0, 2, 6, 20, 30]
    assert spark.range(1).select(steps.once(F.lit(None).cast("int"), lambda v: F.coalesce(v, F.lit(7))).alias("x")).first()["x"] == 7


def test_a_date_is_read_from_one_evaluation_of_its_text(spark):
    rows = spark.createDataFrame([("14th August 1967",)], "said string")
    assert uses(rows.select(dates.normalize_date(F.col("said"))), "said") == 1


def test_a_label_evaluates_its_text_once(spark):
    rows = spark.createDataFrame([("a.b",)], "said string")
    assert uses(rows.select(text_.looks_numeric(F.col("said"))), "said") == 1


@pytest.mark.parametrize(
    ("said", "iso"),
    [
        ("2024-02-29", "2024-02-29"), ("2023-02-29", None), ("31/04/1999", None), ("04/31/1999", None), ("4/31/1999", None), ("12/31/1999", "1999-12-31"), ("31-12-1999", "1999-12-31"), ("1/2-1999", "1999-02-01"),
        ("1900-02-29", None), ("2000-02-29", "2000-02-29"), ("1849-01-01", None), ("2035-12-31", "2035-12-31"), ("0000-00-00 1/1/1999", None), ("5 Foo 1999, 7/8/2001", "2001-08-07"),
        ("3  March　 1950", "1950-03-03"), ("٣ March 1950", None), ("1ſt Auguſt 1950", None), ("12 day of Sept. 1950 2/2/1951", "1950-09-12"), ("", None), (None, None), ("a-b", None),
    ],
)
def test_dates_of_all_forms(spark, said, iso):
    assert spark.createDataFrame([(said,)], "c string").select(dates.normalize_date(F.col("c")).alias("d")).first()["d"] == iso


@pytest.mark.parametrize("said", ["", " ", "a  b", " a\tb ", "a b", "\x1c\x1d a \x85", " x　　y", "café  1", "plain text", "a​b", "\x00 a", "~ !"])
def test_white_space_is_as_the_pattern_has_it(spark, said):
    rows = spark.createDataFrame([(said,)], "c string")
    plain = F.trim(F.regexp_replace(F.col("c"), text_.WHITE, " "))
    got = rows.select(text_.normalize_whitespace(F.col("c")).alias("a"), plain.alias("b"), text_.collapse_label(F.col("c")).alias("l"), F.regexp_replace(F.upper(plain), "[.:]", "").alias("m")).first()
    assert got["a"] == got["b"] and got["l"] == got["m"]


def test_one_field_does_not_read_the_others(spark):
    docs = extraction.routed(derived.certificate_pages(spark, SF))
    one = extraction.extracted(docs, names=["share_type"])
    assert "distinctive_numbers" not in one._jdf.queryExecution().analyzed().toString()
    assert rows_of(one.select("doc_id", "share_type")) == rows_of(extraction.extracted(docs).select("doc_id", "share_type"))


def test_counts_of_are_the_rows_of_the_tables(spark):
    found = extraction.complete(extraction.routed(derived.spoilt_pages(spark, SF), derived.documents(spark, SF)))
    counted = extraction.counts_of(found)
    assert scans(counted) == scans(found)
    out = extraction.tables_of(found)
    for name, column in (("fields", "n_fields"), ("transfers", "n_transfers")):
        assert rows_of(counted.filter(F.col(column) > 0).select("doc_id", column)) == rows_of(out[name].groupBy("doc_id").agg(F.count("*").alias(column)))
    assert rows_of(counted.filter("has_certificate").select("doc_id", "needs_review")) == rows_of(out["certificates"].select("doc_id", "needs_review"))
    assert counted.count() == derived.documents(spark, SF).count()


def test_failure_isolation_is_one_pass(spark):
    assert scans(q.failure_isolation(spark, SF)) == scans(extraction.complete(extraction.routed(derived.spoilt_pages(spark, SF))))


def test_accuracy_rows_are_one_pass_without_a_join_of_fields(spark):
    assert scans(q.accuracy_rows(spark, SF)) == scans(q.fields_long(spark, SF))


@pytest.mark.parametrize("name", ["accuracy_records", "job_results", "merged_summary"])
def test_what_is_sorted_or_used_twice_is_worked_out_before(spark, name):
    assert scans(q.QUERIES[name](spark, SF)) == 0


def test_records_within_rows_are_those_of_the_tables(spark):
    found = q._kept(spark, extraction.complete(extraction.routed(derived.certificate_pages(spark, SF))))
    out = extraction.tables_of(found)
    plain = report.accuracy_records(out["certificates"], out["fields"], transfers.transfer_counts(out["transfers"]), found)
    text = lambda rows: rows.select("*", F.to_json("fields").alias("f")).drop("fields").select("file", "num_pages", "validation_status", "validation_flags", "transfer_rows", "transfer_rows_needing_review", "f")
    assert rows_of(text(report.records_of(found))) == rows_of(text(plain))


def test_needed_holds_what_the_tables_are_made_of(spark):
    found = extraction.complete(extraction.routed(derived.certificate_pages(spark, SF)))
    some = extraction.needed(found, ("documents", "transfers"))
    assert "cells" in some.columns and not {"fields", "outcomes", "company_name"} & set(some.columns)
    for name in extraction.TABLES:
        assert rows_of(extraction.tables_of(extraction.needed(found, (name,)), (name,))[name]) == rows_of(extraction.tables_of(found)[name]), name


@pytest.mark.parametrize("name", ["export_csv_rows", "results_after", "search_by_index"])
def test_one_stored_table_is_not_staged(spark, name, monkeypatch):
    monkeypatch.setattr(q, "store_run", lambda *_: pytest.fail("staged"))
    assert q.QUERIES[name](spark, SF).count() > 0 or name == "results_after"


def test_stores_of_several_tables_stage_only_what_these_need(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(q, "store_run", lambda store, rows, tables_of, jobs: staged.append(rows.columns) or (_ for _ in ()).throw(InterruptedError))
    for name, left_out in (("clear_job", {"fields", "outcomes", "company_name"}), ("bulk_delete", set()), ("nested_results", set())):
        with pytest.raises(InterruptedError):
            q.QUERIES[name](spark, SF)
        assert not left_out & set(staged[-1]), name


@pytest.mark.parametrize("name", ["facets", "series_consistency"])
def test_what_needs_no_ledger_entry_reads_none(spark, name):
    assert "ledger_folio_no" not in q.QUERIES[name](spark, SF)._jdf.queryExecution().analyzed().toString()


def test_a_nested_page_is_labelled_once(spark):
    docs = spark.createDataFrame([], "doc_id long, pages array<struct<page_no:int,image_width:int,image_height:int,lines:array<struct<line_no:int,text:string,confidence:double,x1:double,y1:double,x2:double,y2:double>>>>")
    assert pages_.route_nested(docs)._jdf.queryExecution().analyzed().toString().count("upper(") <= 2


def test_pages_are_written_compressed_and_read_again(spark, tmp_path):
    pages = derived.certificate_pages(spark, SF)
    io.write_json(pages, str(tmp_path / "pages"), compression="gzip")
    written = list((tmp_path / "pages").glob("part-*"))
    assert written and all(p.name.endswith(".json.gz") for p in written)
    plain = sum(len(r["value"]) + 1 for r in pages.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).collect())
    assert sum(p.stat().st_size for p in written) < plain / 4
    assert rows_of(io.read_pages(spark, str(tmp_path / "pages"), "json")) == rows_of(pages)


def test_layouts_move_a_row_a_page_and_a_row_a_layout(spark):
    rows = q.many_layouts(spark, SF)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.index("explode(__lines")
    assert "explode(__regions" in plan and plan.find("Join", joined) > joined  # taken apart behind the join, not before it
    assert "gx" not in plan


def test_layout_hits_are_the_cell_hits(spark):
    line = "line_no int, text string, confidence double, x1 double, y1 double, x2 double, y2 double"
    lines = [(i, "t", 0.9, x, y, x + 40.0, y + 20.0) for i, (x, y) in enumerate([(20.0, 20.0), (430.0, 650.0), (-400.0, 10.0), (980.0, 2100.0), (930.0, 480.0), (0.0, 710.0)])]
    pages = spark.createDataFrame([(d, p, 1000, 1000, p, d % 3, lines) for d in range(6) for p in (1, 2)] + [(9, 1, None, 1000, 1, 0, lines), (10, 1, 1000, 1000, 1, 0, None)],
        f"doc_id long, page_no int, image_width int, image_height int, layout_page int, layout_id long, lines array<struct<{line.replace(' ', ':').replace(',:', ',')}>>")
    shift = F.col("layout_id") * 0.03
    layouts = spark.range(2).withColumnRenamed("id", "layout_id").crossJoin(geometry.template_regions(spark)).withColumn("x1", F.col("x1") + shift).withColumn("x2", F.col("x2") + shift)
    apart = pages.select("*", F.explode("lines").alias("x")).select("doc_id", "page_no", "image_width", "image_height", "layout_page", "layout_id", "x.*")
    got = geometry.layout_hits(pages, layouts)
    assert got.columns == geometry.cell_hits(apart, layouts).columns
    assert rows_of(got) == rows_of(geometry.cell_hits(apart, layouts)) and got.count() > 0


def test_fields_of_odd_pages_are_unchanged(spark):
    said = "is the regiſtered holder(s) of ONE HUNDRED fully paid Ordinary Shares of Rupees Ten each this Fourteenth DAY of August 1967"
    lines = [(0, "CERTIFICATE NO. KB12", 0.9, 20.0, 20.0, 200.0, 50.0), (1, None, 0.5, 0.0, 0.0, 1.0, 1.0), (2, said, 0.8, 100.0, 540.0, 700.0, 560.0)]
    line = "struct<line_no:int,text:string,confidence:double,x1:double,y1:double,x2:double,y2:double>"
    docs = spark.createDataFrame([(1, (1, 1000, 1000, lines)), (2, None)], f"doc_id long, page1 struct<page_no:int,image_width:int,image_height:int,lines:array<{line}>>")
    got = {r["doc_id"]: r for r in fields_.extract_fields(docs).collect()}
    assert got[1]["date_of_issue"]["value"] == "1967-08-14" and got[1]["number_of_shares"]["value"] == "100" and got[1]["share_type"]["value"] == "Ordinary" and got[1]["face_value"]["value"] == "10"
    assert got[1]["certificate_no"]["value"] is None and got[1]["company_name"]["value"] is None  # a Kelvin sign is no letter of a number
    assert all(got[2][n] is None for n in fields_.NAMES)
