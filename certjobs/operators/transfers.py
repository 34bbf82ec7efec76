"""The transfer ledger of page 2: header removal, row clustering, cells, and what the last row says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certjobs.functions.dates import normalize_date
from certjobs.functions.geometry import COLUMN_FIELDS, center, table_column
from certjobs.functions.steps import computed, once
from certjobs.functions.text import collapse_label, has_any, strip_noise

#: Header keywords, the header band, the gap that starts a row, the threshold of review.
HEADER = ["DATE OF", "TRANSFER NO", "TRANSFEREE", "LEDGER", "FOLIO", "SIGNATURE", "AUTHORIS", "MEMORANDUM OF TRANSFERS"]
HEADER_BAND, ROW_GAP, THRESHOLD = 0.10, 0.045, 0.70
FIELDS = list(COLUMN_FIELDS.values())


def is_header(text: Column, cy: Column) -> Column:
    return (cy <= HEADER_BAND) | once(collapse_label(text), lambda label: has_any(label, HEADER))


def _placed(lines: Column, width: Column, height: Column) -> Column:
    """The lines that are not headers, from the top, as an array of structs."""

    def line(x: Column) -> Column:
        mid, text = (x["y1"] + x["y2"]) / 2, F.coalesce(x["text"], F.lit(""))
        cx, cy = center(x["x1"], x["x2"], width), center(x["y1"], x["y2"], height)
        return F.struct(
            mid.alias("mid"), x["line_no"].alias("line_no"), x["x1"].alias("x1"), text.alias("text"), x["confidence"].alias("confidence"), cy.alias("cy"), cx.alias("cx")
        )

    body = F.filter(F.transform(lines, line), lambda x: ~F.coalesce(is_header(x["text"], x["cy"]), F.lit(True)))
    return F.array_sort(body)


def _with_columns(placed: Column) -> Column:
    return F.transform(placed, lambda x: F.struct(*[x[n].alias(n) for n in ("mid", "line_no", "x1", "text", "confidence", "cy")], table_column(x["cx"]).alias("field")))


def _starts(placed: Column) -> Column:
    """Where rows start (from 0): at the first line, and at each that lies more than ROW_GAP below the line before it; so rows chain."""
    below = lambda i: F.coalesce(F.get(placed, i)["cy"] - F.get(placed, i - 1)["cy"] > ROW_GAP, F.lit(False))
    every = F.when(F.size(placed) > 0, F.sequence(F.lit(0), F.size(placed) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: (i == 0) | below(i))


def ledger_clusters(docs: DataFrame, page: str = "page2", keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, what ``keep`` names, and the page's lines in clusters: ``clusters``, an array of arrays of lines with their column
    (``field``), whose positions are the rows' numbers. Everything stays within the document's row; null without the page."""
    return computed(docs, ["doc_id", *(keep or [])], {"clusters": _clusters(F.col(page))})


def _clusters(page: Column) -> Column:
    def cut(lines: Column) -> Column:
        end = lambda starts, k: F.coalesce(F.get(starts, k + 1), F.size(lines))
        return once(_starts(lines), lambda starts: F.transform(starts, lambda at, k: F.slice(lines, at + 1, end(starts, k) - at)))

    return F.when(page.isNotNull(), once(_with_columns(_placed(page["lines"], page["image_width"], page["image_height"])), cut))


def ledger_lines(docs: DataFrame, page: str = "page2") -> DataFrame:
    """The page's lines that are not headers, with their column and the number of their cluster (``row_index``)."""
    rows = ledger_clusters(docs, page).select("doc_id", F.posexplode("clusters").alias("row_index", "lines"))
    return rows.select("doc_id", "row_index", F.explode("lines").alias("x")).select("doc_id", "row_index", "x.line_no", "x.text", "x.confidence", "x.field")


def ledger_cells(docs: DataFrame, page: str = "page2", keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, what ``keep`` names, and ``cells``: an array with each plausible row's number, its five texts and their lowest
    confidences. Clusters without a transferee (two characters) and without a date are left out, but keep their number."""
    kept = ["doc_id", *(keep or [])]

    def cell(lines: Column, field: str) -> tuple[Column, Column]:
        own = F.filter(lines, lambda x: x["field"] == field)
        across = F.array_sort(F.transform(own, lambda x: F.struct(x["x1"].alias("x1"), x["mid"].alias("mid"), x["line_no"].alias("line_no"), x["text"].alias("text"))))
        text = once(strip_noise(F.array_join(F.transform(across, lambda x: x["text"]), " ")), lambda v: F.when(v != "", v))
        return text.alias(field), F.array_min(F.transform(own, lambda x: x["confidence"])).alias(f"c_{field}")

    def row(lines: Column, k: Column) -> Column:
        parts = [cell(lines, f) for f in FIELDS]
        return F.struct(k.cast("int").alias("row_index"), *[t for t, _ in parts], *[c for _, c in parts])

    plausible = lambda r: (F.length(F.coalesce(r["transferee_name"], F.lit(""))) >= 2) | r["transfer_date"].isNotNull()
    return computed(docs, kept, {"cells": F.filter(F.transform(_clusters(F.col(page)), row), plausible)})


def transfer_rows(docs: DataFrame, page: str = "page2", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """One row per plausible ledger entry, with what ``keep`` names; a date that does not parse is kept as read and flagged."""
    return entries(ledger_cells(docs, page, keep), threshold, keep)


def entries(cells: DataFrame, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The transfer table of documents with their ``cells``."""
    kept, marks = ["doc_id", *(keep or [])], ["row_index", *[f"c_{f}" for f in FIELDS]]
    read = cells.select(*kept, F.explode("cells").alias("x")).select(*kept, "x.*")
    read = computed(read, [*kept, *marks, *FIELDS], {"__iso": normalize_date(F.col("transfer_date"))})
    unread = F.col("transfer_date").isNotNull() & F.col("__iso").isNull()
    confidence = _confidence({f: F.col(f"c_{f}") for f in FIELDS}, unread)
    return read.select(
        *kept, "row_index", F.coalesce("__iso", "transfer_date").alias("transfer_date"), *FIELDS[1:], confidence.alias("confidence"),
        ((confidence < threshold) | F.col("__iso").isNull()).alias("needs_review"),
    )


def _confidence(cell: dict[str, Column], unread: Column) -> Column:
    """An entry's: the mean of its cells', where a date that does not parse counts as nothing."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cell.values()), F.lit(0.0))
    return F.round(total / (sum((c.isNotNull().cast("int") for c in cell.values()), F.lit(0)) + unread.cast("int")), 4)


def counts_within(cells: Column, threshold: float = THRESHOLD) -> tuple[Column, Column]:
    """``transfer_counts`` of a document's ``cells`` within its row: entries, and those for review; zero without any."""

    def review(x: Column) -> Column:
        doubted = lambda iso: iso.isNull() | (_confidence({f: x[f"c_{f}"] for f in FIELDS}, x["transfer_date"].isNotNull() & iso.isNull()) < threshold)
        return F.coalesce(once(normalize_date(x["transfer_date"]), doubted), F.lit(False))

    count = lambda c: F.coalesce(F.array_size(c), F.lit(0)).cast("long")
    return count(cells), count(F.filter(cells, review))


def present_holder(cells: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Per document what the entry furthest down the ledger (not the latest by date) says: present holder, date and folio, null
    without entries. Within the document's row."""
    kept = ["doc_id", *(keep or [])]
    last = cells.select(*kept, F.get("cells", F.size("cells") - 1).alias("x"))
    dated = computed(last, [*kept, "x"], {"__iso": normalize_date(F.col("x.transfer_date"))})
    return dated.select(
        *kept, F.col("x.transferee_name").alias("present_share_holder_name"), F.coalesce("__iso", "x.transfer_date").alias("present_transfer_date"),
        F.col("x.ledger_folio_no").alias("present_folio_no"),
    )


def latest_transfers(transfers: DataFrame) -> DataFrame:
    """``present_holder`` of a transfer table at rest, for documents with entries."""
    last = F.max_by(F.struct("transferee_name", "transfer_date", "ledger_folio_no"), "row_index")
    rows = transfers.groupBy("doc_id").agg(last.alias("x"))
    return rows.select(
        "doc_id", F.col("x.transferee_name").alias("present_share_holder_name"), F.col("x.transfer_date").alias("present_transfer_date"), F.col("x.ledger_folio_no").alias("present_folio_no")
    )


def transfer_counts(transfers: DataFrame) -> DataFrame:
    return transfers.groupBy("doc_id").agg(F.count("*").alias("transfer_rows"), F.count_if("needs_review").alias("transfer_rows_needing_review"))


def transfer_history(transfers: DataFrame, separator: str = "; ") -> DataFrame:
    """Holders and folios of each document in ledger order; absent ones are left out."""

    def joined(name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("row_index", F.col(name).alias("v")))))
        return F.array_join(F.transform(rows, lambda x: x["v"]), separator)

    return transfers.groupBy("doc_id").agg(joined("transferee_name").alias("holder_history"), joined("ledger_folio_no").alias("folio_history"))
