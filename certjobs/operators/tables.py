"""Operators on the persisted tables: progress, listings, exports, deletes, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WAITING = ["pending", "processing"]
#: The export's labels by column.
EXPORT = {
    "source_file": "File name", "certificate_no": "Certificate No", "company_name": "Company Name", "share_holder_name": "First Share Holder Name",
    "number_of_shares": "No of Shares", "face_value": "Face Value Per Share", "share_type": "Share Type", "distinctive_from": "From Distinctive No",
    "distinctive_to": "To Distinctive No", "date_of_issue": "Date of Issue", "present_share_holder_name": "Present Share Holder Name",
    "present_transfer_date": "Present Transfer Date", "present_folio_no": "Present Folio No", "registered_folio_no": "Registered Folio No",
    "validation_status": "Validation Status", "validation_flags": "Validation Flags", "needs_review": "Needs Review", "overall_confidence": "Overall Confidence",
}
FAILED_EXPORT = {"original_filename": "File name", "error_stage": "Error Stage", "error_type": "Error Type", "error_message": "Error Message"}
#: The listing's labels by column.
LISTING = {
    "source_file": "File", "company_name": "Name of Share", "present_folio_no": "Folio No", "registered_folio_no": "Registered Folio No", "certificate_no": "Certificate No",
    "share_holder_name": "Name of Share Holder", "number_of_shares": "No of Shares", "face_value": "Face Value / Share", "share_type": "Share Type",
}
SEARCHED = ["certificate_no", "company_name", "share_holder_name", "source_file"]


def job_progress(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Counts of each job's documents in one pass (pre-aggregated before its shuffle), and the percentage finished."""
    counts = documents.groupBy("job_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status").isin(WAITING)).alias("waiting"),
    )
    return progress_of(jobs, counts)


def progress_of(jobs: DataFrame, counts: DataFrame) -> DataFrame:
    """Jobs with their counts (job_id, n, done, failed, waiting), zero where there are none, and the percentage finished."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    joined = jobs.join(counts, "job_id", "left")
    total, done, failed = (zero(F.col(c)) for c in ("n", "done", "failed"))
    percent = F.when(total == 0, 0).otherwise(F.floor((done + failed) * 100 / total + 0.5)).cast("int")
    return joined.select(*jobs.columns, total.alias("total"), done.alias("done"), failed.alias("failed"), zero(F.col("waiting")).alias("waiting"), percent.alias("percent"))


def complete_jobs(progress: DataFrame, now: Column) -> DataFrame:
    """Jobs with nothing waiting are complete, unless paused or stopped."""
    ends = (F.col("waiting") == 0) & ~F.col("status").isin("paused", "stopped")
    return progress.withColumn("finished_at", F.when(ends, now)).withColumn("status", F.when(ends, "complete").otherwise(F.col("status")))


def work_selection(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Pending documents of jobs that are neither paused nor stopped."""
    return documents.filter("status = 'pending'").join(jobs.filter(~F.col("status").isin("paused", "stopped")).select("job_id"), "job_id", "left_semi")


def document_outcomes(documents: DataFrame, errors: DataFrame) -> DataFrame:
    """Documents with what went wrong (doc_id, stage, type, message; stages lower-cased): failed if anything did, done otherwise."""
    joined = documents.drop("status", "error_stage", "error_type", "error_message").join(errors, "doc_id", "left")
    return joined.select(
        *[c for c in joined.columns if c not in ("stage", "type", "message")], F.when(F.col("stage").isNull(), "done").otherwise("failed").alias("status"),
        F.lower("stage").alias("error_stage"), F.col("type").alias("error_type"), F.col("message").alias("error_message"),
    )


def job_results(certs: DataFrame, documents: DataFrame, jobs: DataFrame, owner: str, job_id: int | None = None, review_only: bool = False) -> DataFrame:
    """Certificates of an owner's jobs, ordered by id. Page through them with ``page_of``."""
    mine = documents.join(jobs.filter(F.col("owner") == owner).select("job_id"), "job_id", "left_semi").select("doc_id", "job_id")
    mine = mine if job_id is None else mine.filter(F.col("job_id") == job_id)
    found = certs.join(mine, "doc_id")
    return (found.filter("needs_review") if review_only else found).orderBy("doc_id")


def page_of(ordered: DataFrame, number: int, size: int = 100) -> DataFrame:
    """Page ``number`` (from 1) of an ordered listing."""
    return ordered.offset((number - 1) * size).limit(size)


def page_after(rows: DataFrame, after: int | None = None, size: int = 100) -> DataFrame:
    """The page of ``rows`` by doc_id that comes behind the last one of the page before. Of stored tables, which are sorted by doc_id
    within files, only row groups that reach beyond ``after`` are read, and each task passes on ``size`` rows at most; so a
    page costs the same wherever it is, and nothing is sorted whole."""
    return (rows if after is None else rows.filter(F.col("doc_id") > after)).orderBy("doc_id").limit(size)


def nested_results(certs: DataFrame, fields: DataFrame, transfers: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Certificates with their fields, transfers and outcomes as sorted arrays; each child is grouped before its join."""

    def child(rows: DataFrame, first: str, name: str) -> DataFrame:
        rest = [c for c in rows.columns if c not in ("doc_id", first)]
        return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(first, *rest))).alias(name))

    out = certs.drop("outcomes")
    for rows, first, name in ((fields, "field_name", "fields_detail"), (transfers, "row_index", "transfers"), (outcomes, "rule_order", "validation_results")):
        out = out.join(child(rows, first, name), "doc_id", "left")
    return out


def filter_results(certs: DataFrame, failed_only: bool = False, review_only: bool = False, flag_text: str | None = None) -> DataFrame:
    out = certs.filter("validation_status = 'failed'") if failed_only else certs
    out = out.filter("needs_review") if review_only else out
    return out if flag_text is None else out.filter(F.coalesce("validation_flags", F.lit("")).contains(flag_text))


def search(certs: DataFrame, text: str, review: bool | None = None, status: str | None = None, share_type: str | None = None) -> DataFrame:
    """Every word of ``text`` occurs in one of the searched columns, whatever its case."""
    out = certs
    for word in text.lower().split():
        out = out.filter(sum((F.coalesce(F.lower(c).contains(word), F.lit(False)).cast("int") for c in SEARCHED), F.lit(0)) > 0)
    for column, wanted in (("needs_review", review), ("validation_status", status), ("share_type", share_type)):
        out = out if wanted is None else out.filter(F.col(column) == wanted)
    return out


def facets(certs: DataFrame) -> DataFrame:
    """Counts by review flag, status and share type, all at once: (facet, value, n)."""
    each = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in ("needs_review", "validation_status", "share_type")])
    return certs.select(F.explode(each).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def rule_facet(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("rule_name", "passed").agg(F.count("*").alias("n"))


def bulk_delete(tables: dict[str, DataFrame], ids: DataFrame, owned: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the certificates in ``ids`` (doc_id) that are in ``owned``; children go with them."""
    gone = ids.join(owned.select("doc_id"), "doc_id", "left_semi").select("doc_id").distinct()
    return {name: rows.join(gone, "doc_id", "left_anti") for name, rows in tables.items()}


def clear_job(tables: dict[str, DataFrame], documents: DataFrame, jobs: DataFrame, job_id: int) -> dict[str, DataFrame]:
    """All of a job's documents and what belongs to them go; the job's total becomes zero."""
    gone = documents.filter(F.col("job_id") == job_id).select("doc_id")
    out = {name: rows.join(gone, "doc_id", "left_anti") for name, rows in tables.items()}
    total = F.when(F.col("job_id") == job_id, 0).otherwise(F.col("total_files")).cast("int")
    return out | {"documents": documents.filter(~F.col("job_id").eqNullSafe(job_id)), "jobs": jobs.withColumn("total_files", total)}


def review_overlay(fields: DataFrame, reviews: DataFrame) -> DataFrame:
    """Fields with the latest review; the value is that of the last review that set one (``has_value``), null included."""
    key = ["doc_id", "field_name"]
    # ties of time go to the later reviewer's name, then the larger value, so that the result is one
    when = F.struct("reviewed_at", "reviewed_by", "reviewed_value")
    last = reviews.groupBy(*key).agg(
        F.max_by(F.struct("reviewed_by", "reviewed_at"), when).alias("last"), F.max(F.when(F.col("has_value"), when)).alias("set"), F.lit(True).alias("reviewed")
    )
    joined = fields.join(last, key, "left")
    return joined.select(
        *fields.columns, F.coalesce("reviewed", F.lit(False)).alias("reviewed"), F.col("set.reviewed_value").alias("reviewed_value"), F.col("last.reviewed_by").alias("reviewed_by"),
        F.col("last.reviewed_at").alias("reviewed_at"), F.col("set").isNotNull().alias("has_value"),
    )


def effective_values(reviewed: DataFrame) -> DataFrame:
    """The reviewed value where a review set one that is not null, else the extracted one."""
    return reviewed.withColumn("effective_value", F.coalesce(F.when(F.col("reviewed"), F.col("reviewed_value")), F.col("value")))


def latest_review(reviews: DataFrame) -> DataFrame:
    """The newest review of each field by ranking, with its position among the field's reviews."""
    back = Window.partitionBy("doc_id", "field_name").orderBy(F.desc("reviewed_at"), F.desc("reviewed_by"), F.desc_nulls_last("reviewed_value"))
    return reviews.withColumn("rank", F.row_number().over(back)).filter("rank = 1").drop("rank")


def _text(c: str, kind: str) -> Column:
    """How the export writes a value: true and false capitalised, null as empty."""
    value = F.initcap(F.col(c).cast("string")) if kind == "boolean" else F.col(c).cast("string")
    return F.coalesce(value, F.lit(""))


def export_certificates(certs: DataFrame) -> DataFrame:
    """The export's 18 labelled columns as text, ordered by id."""
    full = certs if "registered_folio_no" in certs.columns else certs.withColumn("registered_folio_no", F.lit(None).cast("string"))
    kinds = dict(full.dtypes)
    return full.orderBy("doc_id").select(*[_text(c, kinds[c]).alias(label) for c, label in EXPORT.items()])


def export_failed(documents: DataFrame) -> DataFrame:
    """Failed documents' four labelled columns, ordered by id."""
    return documents.filter("status = 'failed'").orderBy("doc_id").select(*[F.coalesce(c, F.lit("")).alias(label) for c, label in FAILED_EXPORT.items()])


def listing(certs: DataFrame) -> DataFrame:
    """The listing's nine labelled columns and the status text."""
    full = certs if "registered_folio_no" in certs.columns else certs.withColumn("registered_folio_no", F.lit(None).cast("string"))
    return full.select(*[F.col(c).alias(label) for c, label in LISTING.items()], F.when(F.col("needs_review"), "Needs review").otherwise("OK").alias("Status"))
