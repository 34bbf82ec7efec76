"""Page classification and the choice of each document's two pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certjobs.functions.steps import computed, once
from certjobs.functions.text import collapse_label, has_text

#: Keywords of the two kinds of page.
FRONT_KEYWORDS = ["THIS IS TO CERTIFY", "CERTIFICATE NO", "CERT NO", "REGISTERED OFFICE", "AUTHORISED CAPITAL", "DISTINCTIVE NUMBERS", "NO OF SHARES"]
LEDGER_KEYWORDS = ["MEMORANDUM OF TRANSFERS", "MEMORANDUM OF TRANSFER", "TRANSFEREE", "TRANSFEREE'S NAME", "LEDGER FOLIO", "DATE OF TRANSFER"]


def _hits(text: Column, keywords: list[str]) -> Column:
    return sum((text.contains(k).cast("int") for k in keywords), F.lit(0))


def page_type(front_hits: Column, ledger_hits: Column) -> Column:
    return F.when((ledger_hits > 0) & (ledger_hits >= front_hits), "transfer_ledger").when(front_hits > 0, "certificate_front").otherwise("unknown")


def classify_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with ``front_hits``, ``ledger_hits`` and ``page_type``; a narrow projection.

    A page is a ledger if it has ledger keywords, and at least as many as front keywords.
    """
    label = collapse_label(F.array_join(F.transform(F.array_sort("lines"), lambda x: F.coalesce(x["text"], F.lit(""))), " "))
    hit = pages.withColumn("__label", label).withColumns({"front_hits": _hits(F.col("__label"), FRONT_KEYWORDS), "ledger_hits": _hits(F.col("__label"), LEDGER_KEYWORDS)})
    return hit.withColumn("page_type", page_type(F.col("front_hits"), F.col("ledger_hits"))).drop("__label")


def _error(stage: str, kind: str, message: Column) -> Column:
    return F.struct(F.lit(stage).alias("stage"), F.lit(kind).alias("type"), message.alias("message"))


def no_pages() -> Column:
    """The error of a document that has no pages."""
    return _error("PDF_CONVERSION", "NoPages", F.lit("no pages"))


def _said(lines: Column) -> Column:
    return F.coalesce(F.exists(lines, lambda x: has_text(x["text"])), F.lit(False))


def route_pages(classified: DataFrame) -> DataFrame:
    """One row per document: ``num_pages``, ``page1`` and ``page2`` (structs of page_no, image_width, image_height, lines),
    ``error`` (stage, type, message), which is null for a document that can be extracted, and ``no_text``, which is true if none
    of its pages, used or not, has a line with text.

    Page 2 is the first ledger page; page 1 the first page that is not that one, whatever its type. A document fails if a page number
    is missing or used twice (stage PDF_CONVERSION) or if a page has no size (OCR), in this order; one without any text does not
    fail, its fields are empty. One shuffle, on doc_id; pages of neither kind are dropped right after the window, but the first page
    of each document stays so that no failed document is lost.
    """
    doc = Window.partitionBy("doc_id")
    alike = Window.partitionBy("doc_id", "page_no").orderBy("page_no")  # on the partitioning and order of the document's
    size = F.coalesce((F.col("image_width") > 0) & (F.col("image_height") > 0), F.lit(False))
    repeated = (F.col("__nth") == 2) & F.col("page_no").isNotNull()
    # told before the shuffle, so that lines which nothing else needs are not moved for it
    seen = classified.withColumn("__said", _said(F.col("lines"))).withColumn("__nth", F.row_number().over(alike)).withColumns({
        "__p2": F.min(F.when(F.col("page_type") == "transfer_ledger", F.col("page_no"))).over(doc), "num_pages": F.count("*").over(doc),
        "__repeated": F.count_if(repeated).over(doc) + F.max(F.col("page_no").isNull().cast("int")).over(doc), "__unsized": F.count_if(~size).over(doc),
        "__least": F.min("page_no").over(doc), "__texts": F.count_if("__said").over(doc),
    })
    other = F.min(F.when(~F.col("page_no").eqNullSafe(F.col("__p2")), F.col("page_no"))).over(doc)
    chosen = seen.withColumn("__p1", other).filter((F.col("page_no") == F.col("__p1")) | (F.col("page_no") == F.col("__p2")) | F.col("page_no").eqNullSafe(F.col("__least")))
    page = F.struct("page_no", "image_width", "image_height", "lines")
    counted = lambda c, what: F.concat(F.first(c).cast("string"), F.lit(what))
    error = F.when(F.first("__repeated") > 0, _error("PDF_CONVERSION", "PageNumber", counted("__repeated", " page numbers missing or repeated"))).when(
        F.first("__unsized") > 0, _error("OCR", "PageSize", counted("__unsized", " pages without size"))
    )
    return chosen.groupBy("doc_id").agg(
        F.first("num_pages").alias("num_pages"),
        F.first(F.when(F.col("page_no") == F.col("__p1"), page), ignorenulls=True).alias("page1"),
        F.first(F.when(F.col("page_no") == F.col("__p2"), page), ignorenulls=True).alias("page2"),
        error.alias("error"),
        (F.first("__texts") == 0).alias("no_text"),
    )


def route_nested(docs: DataFrame) -> DataFrame:
    """``route_pages`` for documents that have all their pages in one row (doc_id, pages): without a shuffle."""
    first = lambda c: F.get(c, 0)
    text = lambda p: collapse_label(F.array_join(F.transform(F.array_sort(p["lines"]), lambda x: F.coalesce(x["text"], F.lit(""))), " "))
    ordered = F.array_sort("pages")  # by page_no, which comes first; nulls first
    hits = lambda label: F.struct(_hits(label, FRONT_KEYWORDS).alias("front"), _hits(label, LEDGER_KEYWORDS).alias("ledger"))
    kind = lambda p: once(once(text(p), hits), lambda n: page_type(n["front"], n["ledger"]))
    known = lambda p: p["page_no"].isNotNull()
    seen = computed(docs, ["doc_id"], {"__pages": ordered})
    seen = computed(seen, ["doc_id", "__pages"], {"__kinds": F.transform("__pages", kind)})
    pages = F.col("__pages")
    ledger = F.get(F.filter(F.transform(pages, lambda p, i: F.when(known(p) & (F.get("__kinds", i) == "transfer_ledger"), p)), lambda p: p.isNotNull()), 0)
    seen = computed(seen, ["doc_id", "__pages"], {"page2": ledger})
    other = first(F.filter(pages, lambda p: known(p) & ~p["page_no"].eqNullSafe(F.col("page2.page_no"))))
    numbers = F.filter(F.transform(pages, lambda p: p["page_no"]), lambda n: n.isNotNull())
    twice = lambda n, i: (i > 0) & n.eqNullSafe(F.get(numbers, i - 1)) & ~n.eqNullSafe(F.get(numbers, i - 2))
    repeated = F.size(F.filter(numbers, twice)) + F.when(F.size(numbers) < F.size(pages), 1).otherwise(0)
    sized = lambda p: F.coalesce((p["image_width"] > 0) & (p["image_height"] > 0), F.lit(False))
    unsized = F.size(F.filter(pages, lambda p: ~sized(p)))
    counted = lambda c, what: F.concat(c.cast("string"), F.lit(what))
    error = F.when(repeated > 0, _error("PDF_CONVERSION", "PageNumber", counted(repeated, " page numbers missing or repeated"))).when(
        unsized > 0, _error("OCR", "PageSize", counted(unsized, " pages without size"))
    )
    no_text = ~F.exists(pages, lambda p: _said(p["lines"]))
    return seen.select("doc_id", F.size(pages).cast("long").alias("num_pages"), other.alias("page1"), "page2", error.alias("error"), no_text.alias("no_text"))


def page_findings(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """What all of their pages say against documents: (doc_id, stage, type, message) with the first error, which keeps a document from
    being extracted, null where there is none, and (warning_type, warning_message), which does not: no page has any text, so all
    fields will be empty and for review. One row for each of ``documents`` that has either; one without pages has the error only."""
    routed = route_pages(classify_pages(pages)).select("doc_id", F.lit(True).alias("any"), "error", "no_text")
    found = documents.select("doc_id").distinct().join(routed, "doc_id", "left")
    judged = found.withColumn("e", F.when(F.col("any").isNull(), no_pages()).otherwise(F.col("error"))).filter("e IS NOT NULL OR no_text")
    warning = lambda text: F.when(F.col("no_text"), text)
    return judged.select("doc_id", "e.*", warning("NoText").alias("warning_type"), warning("no text on any page").alias("warning_message"))


def page_errors(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """What keeps documents from being extracted: (doc_id, stage, type, message), for each of ``documents`` its first error only."""
    return page_findings(documents, pages).filter("stage IS NOT NULL").select("doc_id", "stage", "type", "message")
