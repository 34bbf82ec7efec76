"""Where rows come from and go to: file manifests, recognised lines, tables, CSV and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certjobs.functions.text import nfkc_all

#: What may be uploaded.
EXTENSIONS = ["pdf", "png", "jpg", "jpeg", "tiff", "tif", "webp", "bmp"]
MOST_BYTES = 26_214_400

LINE = T.StructType(
    [T.StructField("line_no", T.IntegerType()), T.StructField("text", T.StringType())] + [T.StructField(n, T.DoubleType()) for n in ("confidence", "x1", "y1", "x2", "y2")]
)
PAGES = T.StructType(
    [T.StructField("doc_id", T.LongType())] + [T.StructField(n, T.IntegerType()) for n in ("page_no", "image_width", "image_height")] + [T.StructField("lines", T.ArrayType(LINE))]
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path``: path, filename, length. Contents are not read. Files without any byte are not listed, as Spark's reader skips them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length")


def extension(name: Column) -> Column:
    """The lower-cased extension with its dot; leading dots of a name begin none."""
    return F.lower(F.regexp_extract(name, r"^\.*[^/]*?[^./][^/]*?(\.[^./]*)$|^$", 1))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(F.replace(F.trim(name), F.lit(" "), F.lit("_")), r"(?U)[^-\w.]", "")


def judge_uploads(manifest: DataFrame) -> DataFrame:
    """``manifest`` (filename, length) with ``reason`` (null if accepted), ``safe_name`` and ``file_type``; type comes before size."""
    ext = extension(F.col("filename"))
    kind = F.regexp_replace(ext, r"^\.", "")
    reason = F.when(~kind.isin(EXTENSIONS), F.concat(F.lit("Unsupported file type "), ext)).when(F.col("length") > MOST_BYTES, "File exceeds maximum upload size")
    return manifest.select("*", reason.alias("reason"), safe_filename(F.col("filename")).alias("safe_name"), kind.alias("file_type"))


def validate_uploads(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files."""
    judged = judge_uploads(manifest)
    accepted = judged.filter("reason IS NULL").drop("reason").withColumn("status", F.lit("pending"))
    return accepted, judged.filter("reason IS NOT NULL").select("filename", "reason")


def fold_lines(lines: DataFrame) -> DataFrame:
    """Pages with nested lines from one row per line; one shuffle on (doc_id, page_no)."""
    line = F.struct("line_no", "text", "confidence", "x1", "y1", "x2", "y2")
    return lines.groupBy("doc_id", "page_no", "image_width", "image_height").agg(F.array_sort(F.collect_list(line)).alias("lines"))


def read_pages(spark: SparkSession, path: str, file_format: str = "parquet", compose: bool = False) -> DataFrame:
    """Pages in the canonical form. ``compose`` applies NFKC to every line, once, here, within the page's row."""
    pages = spark.read.schema(PAGES).format(file_format).load(path)
    if not compose:
        return pages
    texts = pages.withColumn("__texts", nfkc_all(F.transform("lines", lambda x: x["text"])))
    lines = F.transform("lines", lambda x, i: F.struct(*[(F.get("__texts", i) if f.name == "text" else x[f.name]).alias(f.name) for f in LINE]))
    return texts.withColumn("lines", F.array_sort(lines)).drop("__texts")


def write_csv(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header, in the order of ``rows``; one file only if it is asked for."""
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(records: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines; they name every field of every line, so large tables are a fraction of that with ``compression`` "gzip"."""
    records.write.mode("overwrite").option("ignoreNullFields", False).option("compression", compression).json(path)


def write_jdbc(rows: DataFrame, url: str, table: str, options: dict[str, str]) -> None:
    """Append to a relational store through Spark's JDBC writer."""
    rows.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode("append").save()
