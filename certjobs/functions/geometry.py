"""Boxes, regions of the layout, and table columns, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Normalised regions (x1, y1, x2, y2) of the two pages.
PAGE_1 = {
    "certificate_number": (0.0, 0.0, 0.20, 0.07),
    "number_of_shares_box": (0.80, 0.0, 1.0, 0.07),
    "company_name": (0.08, 0.10, 0.92, 0.26),
    "registered_office": (0.10, 0.26, 0.90, 0.31),
    "authorised_capital": (0.08, 0.31, 0.92, 0.35),
    "holder_name": (0.10, 0.44, 0.80, 0.53),
    "shares_and_face_value": (0.08, 0.53, 0.95, 0.64),
    "issue_date": (0.08, 0.63, 0.75, 0.71),
    "distinctive_numbers": (0.05, 0.735, 0.45, 0.80),
    "signatures": (0.50, 0.71, 0.98, 0.92),
}
PAGE_2 = {
    "transfer_table": (0.0, 0.05, 1.0, 1.0),
    "transfer_table_header": (0.0, 0.05, 1.0, 0.10),
    "column_date": (0.0, 0.0, 0.13, 1.0),
    "column_transfer_no": (0.13, 0.0, 0.25, 1.0),
    "column_transferee": (0.25, 0.0, 0.66, 1.0),
    "column_ledger_folio": (0.66, 0.0, 0.80, 1.0),
    "column_signature": (0.80, 0.0, 1.0, 1.0),
}
#: The ledger's fields by column, in the order in which columns are tried.
COLUMN_FIELDS = {
    "column_date": "transfer_date",
    "column_transfer_no": "transfer_no",
    "column_transferee": "transferee_name",
    "column_ledger_folio": "ledger_folio_no",
    "column_signature": "authorised_signature",
}
TOLERANCE = 0.05


def center(low: Column, high: Column, side: Column) -> Column:
    return ((low + high) / 2) / side


def in_region(line: Column, width: Column, height: Column, region: str, page: int = 1, tolerance: float = TOLERANCE) -> Column:
    """The centre of a line's box lies in a region widened by ``tolerance``, bounds included; false for an unknown region."""
    box = (PAGE_1 if page == 1 else PAGE_2).get(region)
    if box is None:
        return F.lit(False)
    x1, y1, x2, y2 = box
    cx, cy = center(line["x1"], line["x2"], width), center(line["y1"], line["y2"], height)
    return cx.between(x1 - tolerance, x2 + tolerance) & cy.between(y1 - tolerance, y2 + tolerance)


def table_column(cx: Column) -> Column:
    """The ledger field of a token by its horizontal centre: the first column that holds it, bounds included; else the
    column with the nearest edge, if that is less than a page away; else the transferee."""
    fields = [(name, PAGE_2[column]) for column, name in COLUMN_FIELDS.items()]
    out = F.when(F.lit(False), F.lit(""))
    for name, (x1, _, x2, _) in fields:
        out = out.when(cx.between(x1, x2), F.lit(name))
    near = F.array_min(F.array(*[F.struct(F.least(F.abs(cx - x1), F.abs(cx - x2)).alias("gap"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, (x1, _, x2, _)) in enumerate(fields)]))
    return out.when(near["gap"] < 1, near["n"]).otherwise(F.lit("transferee_name"))


def template_regions(spark: SparkSession) -> DataFrame:
    """The layout as a table: page, region, x1, y1, x2, y2."""
    rows = [(page, name, *box) for page, regions in ((1, PAGE_1), (2, PAGE_2)) for name, box in regions.items()]
    return spark.createDataFrame(rows, "page int, region string, x1 double, y1 double, x2 double, y2 double")


def region_hits(lines: DataFrame, regions: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Every region that each exploded line lies in: a range join against the layout.

    ``regions`` is the fixed layout (17 rows), broadcast as such; lines are never shuffled.
    """
    cx, cy = center(F.col("l.x1"), F.col("l.x2"), F.col("l.image_width")), center(F.col("l.y1"), F.col("l.y2"), F.col("l.image_height"))
    inside = cx.between(F.col("r.x1") - tolerance, F.col("r.x2") + tolerance) & cy.between(F.col("r.y1") - tolerance, F.col("r.y2") + tolerance)
    joined = lines.alias("l").join(F.broadcast(regions.alias("r")), inside & (F.col("l.layout_page") == F.col("r.page")))
    return joined.select("l.doc_id", "l.page_no", "l.line_no", "r.region")


def layout_hits(pages: DataFrame, layouts: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``region_hits`` of pages with nested lines for any number of layouts, each of at most some hundred regions (``cell_hits`` is for
    larger ones): a page meets its own layout (``layout_id``, ``layout_page``) as one row, and lines and regions are taken apart behind
    the join. What is moved is a page's line numbers and centres, and each layout once."""
    cx, cy = (lambda x: center(x["x1"], x["x2"], F.col("image_width"))), (lambda x: center(x["y1"], x["y2"], F.col("image_height")))
    centres = F.transform("lines", lambda x: F.struct(x["line_no"].alias("line_no"), cx(x).alias("cx"), cy(x).alias("cy")))
    lines = pages.select("doc_id", "page_no", "layout_id", F.col("layout_page").alias("page"), centres.alias("__lines"))
    whole = layouts.groupBy("layout_id", "page").agg(F.collect_list(F.struct("region", *[F.col(c) for c in ("x1", "y1", "x2", "y2")])).alias("__regions"))
    met = lines.join(whole, ["layout_id", "page"]).select("doc_id", "page_no", "layout_id", "__regions", F.explode("__lines").alias("l"))
    pairs = met.select("doc_id", "page_no", "layout_id", "l", F.explode("__regions").alias("r"))
    inside = F.col("l.cx").between(F.col("r.x1") - tolerance, F.col("r.x2") + tolerance) & F.col("l.cy").between(F.col("r.y1") - tolerance, F.col("r.y2") + tolerance)
    return pairs.filter(inside).select("doc_id", "page_no", "l.line_no", "layout_id", "r.region")


def cell_hits(lines: DataFrame, layouts: DataFrame, tolerance: float = TOLERANCE, cells: int = 10) -> DataFrame:
    """``region_hits`` for any number of layouts: each line meets the regions of its own layout (``layout_id``) and page that reach into
    the cell of a grid where its centre lies. An equi-join on layout, page and cell; boxes are compared for what meets there only.

    A region has a row for each cell that it reaches into, with the tolerance, at most ``cells + 2`` squared; cells beyond the page's
    edges are one each. Lines are compared with the regions of one cell, so each pair meets once.
    """
    cell = lambda v: F.greatest(F.lit(-1), F.least(F.lit(cells), F.floor(v * cells))).cast("int")
    reach = lambda low, high: F.sequence(cell(F.col(low) - tolerance), cell(F.col(high) + tolerance))
    wide = layouts.withColumn("gx", F.explode(reach("x1", "x2"))).withColumn("gy", F.explode(reach("y1", "y2"))).alias("r")
    cx, cy = center(F.col("x1"), F.col("x2"), F.col("image_width")), center(F.col("y1"), F.col("y2"), F.col("image_height"))
    placed = lines.withColumns({"cx": cx, "cy": cy}).withColumns({"gx": cell(F.col("cx")), "gy": cell(F.col("cy"))}).alias("l")
    same = (F.col("l.layout_id") == F.col("r.layout_id")) & (F.col("l.layout_page") == F.col("r.page")) & (F.col("l.gx") == F.col("r.gx")) & (F.col("l.gy") == F.col("r.gy"))
    inside = F.col("l.cx").between(F.col("r.x1") - tolerance, F.col("r.x2") + tolerance) & F.col("l.cy").between(F.col("r.y1") - tolerance, F.col("r.y2") + tolerance)
    return placed.join(wide, same & inside).select("l.doc_id", "l.page_no", "l.line_no", "l.layout_id", "r.region")
