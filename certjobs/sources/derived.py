"""Certificates derived from the order tables: one document per order, one ledger row per item, and the tables around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARES = ["TEN", "TWENTY FIVE", "ONE HUNDRED", "TWO HUNDRED AND FIFTY", "ONE LAKH"]
COUNTS = [10, 25, 100, 250, 100000]
JOBS = 40
SIDE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line(no: int | Column, text: Column, confidence: Column, x1: float | Column, y1: float | Column, x2: float | Column, y2: float | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    box = [lit(v).cast("double").alias(n) for n, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))]
    return F.struct(lit(no).cast("int").alias("line_no"), text.cast("string").alias("text"), confidence.cast("double").alias("confidence"), *box)


def _conf(k: Column) -> Column:
    return F.lit(0.80) + (k % 20) / F.lit(100.0)


def front_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, lines) of each order's front page."""
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    o = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k, c = F.col("o_orderkey"), _conf(F.col("o_orderkey"))
    pick = (k % 5).cast("int")
    words = F.get(F.array(*map(F.lit, SHARES)), pick)
    count = F.get(F.array(*map(F.lit, COUNTS)), pick)
    low = F.lit(1000) + k * 10
    high = low + count - 1 + F.when(k % 4 == 0, 1).otherwise(0)
    date = F.when(k % 3 == 0, "this Fourteenth day of August 1967").when(k % 3 == 1, "14th August 1967").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    lines = [
        line(0, F.when(k % 7 == 0, "faded").otherwise(F.concat(F.lit("Cert.No.OB"), k.cast("string"))), c, 20, 20, 200, 50),
        line(1, F.concat("n_name", F.when(k % 11 == 0, " METALS").otherwise(" METALS LTD")), c, 100, 120, 900, 200),
        line(2, F.lit("THIS IS TO CERTIFY THAT"), c, 100, 440, 500, 460),
        line(3, F.when(k % 3 == 0, "1/21").otherwise(""), c, 100, 470, 150, 490),
        line(4, F.col("c_name"), c, 100, 490, 600, 510),
        line(5, F.concat(F.lit("is/are the registered holder(s) of "), words), c, 100, 540, 700, 560),
        line(6, F.when(k % 13 == 0, "fully paid Ordinary Equity of Rupees").otherwise(F.concat(F.lit("fully paid Ordinary (Equity) Shares of Rupees "), F.when(k % 2 == 0, "Ten").otherwise("100"), F.lit(" each"))), c, 100, 580, 900, 600),
        line(7, date, c, 100, 650, 500, 670),
        line(8, low.cast("string"), c, 60, 758, 190, 778),
        F.when(k % 6 != 0, line(9, high.cast("string"), c, 330, 758, 460, 778)),
    ]
    return o.select(k.alias("k"), F.filter(F.array(*lines), lambda x: x.isNotNull()).alias("lines"))


def ledger_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, lines) of the ledger of each order with items."""
    items, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    numbered = items.select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", (F.row_number().over(order) - 1).alias("r"))
    rows = numbered.join(supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    k, r = F.col("l_orderkey"), F.col("r")
    y = F.lit(130) + r * F.when(k % 17 == 0, 40).otherwise(50)
    shift = F.when(k % 23 == 0, 360).otherwise(0)

    def token(t: int, text: Column, x1: Column | int, x2: Column | int) -> Column:
        made = line(F.lit(2) + r * 5 + t, text, _conf(k + r + t), x1, y, x2, y + 18)
        return made if t == 3 else F.when((k + r) % 19 != 0, made)

    tokens = [
        token(0, F.when((k + r) % 9 == 0, "illegible").otherwise(F.date_format("l_shipdate", "dd/MM/yyyy")), 20, 110),
        token(1, (r + 1).cast("string"), 150, 230),
        token(2, F.col("s_name"), 300, 600),
        token(3, F.concat(F.lit("F"), (F.col("l_partkey") % 1000).cast("string")), F.lit(680) + shift, F.lit(780) + shift),
        token(4, F.lit("SIGNED"), 850, 950),
    ]
    each = rows.select(k.alias("k"), F.filter(F.array(*tokens), lambda x: x.isNotNull()).alias("t"))
    return each.groupBy("k").agg(F.flatten(F.collect_list("t")).alias("lines"))


def header_lines(k: Column) -> Column:
    return F.array(line(0, F.lit("MEMORANDUM OF TRANSFERS"), F.lit(0.9), 300, 20, 700, 40), line(1, F.lit("Transferee"), F.lit(0.9), 300, 60, 500, 80))


def certificate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in the canonical form: front and ledger; for every tenth order a ledger, a bare ledger head, then the front. An
    order without items has a bare ledger head if its number is even, and no second page if it is odd."""
    joined = front_pages(spark, sf_dir).join(ledger_pages(spark, sf_dir).withColumnRenamed("lines", "ledger"), "k", "left")
    k, head = F.col("k"), header_lines(F.col("k"))
    body = F.when(F.col("ledger").isNotNull(), F.concat(head, F.col("ledger"))).when(k % 2 == 0, head)
    page = lambda no, lines: F.struct(F.lit(no).alias("page_no"), lines.alias("lines"))
    turned = F.array(page(1, F.coalesce(body, head)), page(2, head), page(3, F.col("lines")))
    usual = F.filter(F.array(page(1, F.col("lines")), page(2, body)), lambda p: p["lines"].isNotNull())
    pages = joined.select(k.alias("doc_id"), F.explode(F.when(k % 10 == 0, turned).otherwise(usual)).alias("p"))
    return pages.select("doc_id", "p.page_no", F.lit(SIDE).alias("image_width"), F.lit(SIDE).alias("image_height"), "p.lines")


def spoilt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages, with all of some documents' pages numbered alike, without a size, or without text."""
    k = F.col("doc_id")
    return certificate_pages(spark, sf_dir).withColumns({
        "page_no": F.when(k % 19 == 0, 1).otherwise(F.col("page_no")), "image_width": F.when(k % 17 != 0, F.col("image_width")),
        "lines": F.when(k % 13 == 0, F.filter("lines", lambda x: F.lit(False))).otherwise(F.col("lines")),
    })


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table: job by customer, status by the order's."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed").when(k % 5 == 0, "processing").otherwise("pending")
    failed = F.col("o_orderstatus") == "P"
    return o.select(
        k.alias("doc_id"), (F.col("o_custkey") % JOBS).alias("job_id"), F.concat(k.cast("string"), F.lit(".pdf")).alias("original_filename"), status.alias("status"),
        F.when(failed, F.when(k % 2 == 0, "ocr").otherwise("extraction")).alias("error_stage"), F.when(failed, "ValueError").alias("error_type"),
        F.when(failed, F.concat(F.lit("page "), (k % 3).cast("string"))).alias("error_message"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job table; the last job of each eight has no documents."""
    ids = table(spark, sf_dir, "orders").select((F.col("o_custkey") % JOBS).alias("job_id")).distinct()
    both = ids.union(ids.filter("job_id % 8 = 7").select((F.col("job_id") + 1000).alias("job_id")))
    j = F.col("job_id")
    status = F.when(j % 4 == 0, "running").when(j % 4 == 1, "paused").when(j % 4 == 2, "stopped").otherwise("queued")
    return both.select(j, F.concat(F.lit("user"), (j % 3).cast("string")).alias("owner"), status.alias("status"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of fields, from events: some set a value, some a null, some only confirm."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    names = F.array(F.lit("certificate_no"), F.lit("company_name"), F.lit("face_value"))
    return e.select(
        (n % 500).alias("doc_id"), F.get(names, (n % 3).cast("int")).alias("field_name"), (F.col("event_type") != "view").alias("has_value"),
        F.when(F.col("event_type").isin("click", "signup", "purchase"), F.concat(F.lit("v"), (n % 11).cast("string"))).alias("reviewed_value"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("reviewed_by"), F.col("ts").alias("reviewed_at"),
    )


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status events of documents, several for each."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "processing").otherwise("pending")
    return e.select((F.col("event_id") % 3000).alias("doc_id"), (F.col("event_id") % 3000 % JOBS).alias("job_id"), kind.alias("status"), "ts")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names and sizes, from documents of all sorts."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    ends = F.array(*map(F.lit, [".pdf", ".PNG", ".exe", ".tiff", "", ".tar.gz", ".jpeg"]))
    return o.select(F.concat(F.lit(" scan "), k.cast("string"), F.when(k % 4 == 0, "(copy)").otherwise(""), F.get(ends, (k % 7).cast("int"))).alias("filename"), (F.col("o_totalprice") * 80).cast("long").alias("length"))
