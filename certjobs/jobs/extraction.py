"""The whole extraction: pages to the six tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certjobs.operators import fields as fields_
from certjobs.operators import pages as pages_
from certjobs.operators import rules, transfers

#: What is known of a document beside its pages.
KNOWN = ["num_pages", "page_number", "source_file"]


def routed(pages: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Documents with their two pages: doc_id, num_pages, page_number, source_file, page1, page2 and error. One shuffle of pages, on
    doc_id. ``documents`` (doc_id, original_filename and, as it may be, job_id) names the files; each of its documents is
    there then, one without pages with that error."""
    docs = pages_.route_pages(pages_.classify_pages(pages))
    if documents is None:
        docs = docs.withColumn("source_file", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")))
    else:
        names = documents.select("doc_id", F.col("original_filename").alias("source_file"), *_job(documents))
        docs = names.join(docs, "doc_id", "left").withColumn("error", F.when(F.col("num_pages").isNull(), pages_.no_pages()).otherwise(F.col("error")))
    return docs.withColumn("page_number", F.col("page1.page_no"))


def _job(rows: DataFrame) -> list[str]:
    return [c for c in ("job_id",) if c in rows.columns]


def extracted(docs: DataFrame, ledger: bool = False, names: list[str] | None = None) -> DataFrame:
    """Routed documents that can be extracted with the nine field structs: doc_id, num_pages, page_number, source_file (and job_id) and
    the fields (without ``ledger`` those of ``names`` only, if given); with ``ledger`` also what the last ledger entry says. Narrow: the
    ledger is read within the row."""
    known, fine = [*KNOWN, *_job(docs)], docs.filter("error IS NULL")
    if not ledger:
        return fields_.extract_fields(fine, keep=known, names=names)
    present = transfers.present_holder(transfers.ledger_cells(fine, keep=[*known, "page1"]), keep=[*known, "page1"])
    return fields_.extract_fields(present, keep=[*known, *rules.PRESENT])


def outcomes(docs: DataFrame) -> DataFrame:
    """The document table's part of routed documents: what became of each, with stages in lower case."""
    e = F.col("error")
    return docs.select(
        "doc_id", *_job(docs), F.col("source_file").alias("original_filename"), F.coalesce("num_pages", F.lit(0)).alias("num_pages"), F.when(e.isNull(), "done").otherwise("failed").alias("status"),
        F.lower(e["stage"]).alias("error_stage"), e["type"].alias("error_type"), e["message"].alias("error_message"),
    )


TABLES = ("certificates", "fields", "transfers", "outcomes", "documents")


def run(pages: DataFrame, documents: DataFrame | None = None, validate_transfers: bool = False, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """documents, certificates, fields, transfers and outcomes of all documents (those of ``names``), lazily; with their job_id, if
    ``documents`` has it.

    What fails is judged along the way: a failed document is in ``documents`` with its error and in no other table. Each table is one
    pass over the pages, with the one shuffle of routing (and that of ``documents``). If several are used, write ``complete`` once and
    take them from it.
    """
    docs = routed(pages, documents)
    fine, job = docs.filter("error IS NULL"), _job(docs)

    def certificates(ledger: bool) -> DataFrame:
        return rules.certificates(extracted(docs, ledger), validate_transfers=validate_transfers, keep=job)

    made = {
        "certificates": lambda: certificates(ledger=True).drop("outcomes"), "fields": lambda: fields_.long_fields(extracted(docs), keep=job),
        "transfers": lambda: transfers.transfer_rows(fine, keep=job), "outcomes": lambda: rules.outcome_rows(certificates(ledger=validate_transfers), keep=job),
        "documents": lambda: outcomes(docs),
    }
    return {name: made[name]() for name in names}


def complete(docs: DataFrame, validate_transfers: bool = False) -> DataFrame:
    """All that extraction finds, one row for each routed document: what is known of it, its error, the nine field structs, the ledger's
    ``cells``, the certificate's columns as ``certificate`` and its ``outcomes``; these are null where the document failed. Write it
    once and take all tables from it with ``tables_of``."""
    known = [*KNOWN, "error", *_job(docs)]
    page = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    fine = docs.select("doc_id", *known, page("page1"), page("page2"))
    cells = transfers.ledger_cells(fine, keep=[*known, "page1"])
    present = transfers.present_holder(cells, keep=[*known, "page1", "cells"])
    wide = fields_.extract_fields(present, keep=[*known, "cells", *rules.PRESENT]).withColumn("fields", F.struct(*fields_.NAMES))
    return rules.certificates(wide, validate_transfers=validate_transfers, keep=["num_pages", "error", "cells", "fields", *_job(docs)])


def tables_of(rows: DataFrame, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The tables of ``run`` (those of ``names``), each a narrow projection of what ``complete`` has found."""
    fine, job = rows.filter("error IS NULL"), _job(rows)
    made = {
        "certificates": lambda: fine.drop("num_pages", "error", "cells", "fields", "outcomes"), "fields": lambda: fields_.long_fields(fine.select("doc_id", *job, "fields.*"), keep=job),
        "transfers": lambda: transfers.entries(fine, keep=job), "outcomes": lambda: rules.outcome_rows(fine, keep=job), "documents": lambda: outcomes(rows),
    }
    return {name: made[name]() for name in names}


def needed(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """What ``complete`` has found without what no table of ``names`` is made of, so that less is written for them."""
    beside = {"fields": "fields", "cells": "transfers", "outcomes": "outcomes"}
    base = ["doc_id", *KNOWN, "error", *_job(rows)]
    return rows.select(*[c for c in rows.columns if c in base or (beside[c] in names if c in beside else "certificates" in names)])


def counts_of(rows: DataFrame) -> DataFrame:
    """What each document has in the tables of ``complete``'s findings: doc_id, has_certificate, n_fields, n_transfers and its certificate's
    needs_review; nothing if it failed. Counted within its row."""
    fine, long = F.col("error").isNull(), lambda c: F.coalesce(F.array_size(c), F.lit(0)).cast("long")
    own = F.filter(F.array(*[F.col(f"fields.{n}") for n in fields_.NAMES]), lambda f: f.isNotNull())
    return rows.select(
        "doc_id", fine.alias("has_certificate"), long(F.when(fine, own)).alias("n_fields"), long(F.when(fine, F.col("cells"))).alias("n_transfers"),
        F.coalesce(F.when(fine, F.col("needs_review")), F.lit(False)).alias("needs_review"),
    )
