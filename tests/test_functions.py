"""Text, number, date and geometry functions on literal cases."""

from pyspark.sql import functions as F

from certjobs.functions import dates, geometry, numbers, text


def column(spark, cases, f, kind="string"):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], f"i int, c {kind}")
    got = {r["i"]: r["v"] for r in rows.select("i", f(F.col("c")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [b for _, b in cases]


def test_text(spark):
    column(spark, [("  Metals   Works \n & Alloys  ", "Metals Works & Alloys"), (None, ""), ("a  b\x1cc", "a b c")], text.normalize_whitespace)
    column(spark, [("ﬁne Ａ", "fine A"), (None, "")], lambda c: text.normalize_whitespace(c, compose=True))
    column(spark, [(" 1608. ", "1608"), (" .:;,-_'\"| ", "")], text.strip_noise)
    column(spark, [("O/B/16O8", "0/8/1608"), ("4425", "4425"), ("ilx", "11x"), (None, None)], text.fix_numeric_ocr)
    column(spark, [("F1VE", "FIVE"), ("TWENTY", "TWENTY")], text.fix_word_ocr)
    column(spark, [("O/B/ 1608", "1608"), (None, "")], text.only_digits)
    column(spark, [(" Cert. No. ", "CERT NO"), ("CERT . NO", "CERT  NO")], text.collapse_label)
    column(spark, [("44O629", True), ("date of 1967", False), ("date 1967", True), ("  ", False), ("1a", True)], text.looks_numeric)


def test_numbers(spark):
    as_int = lambda f: lambda c: f(c).cast("long")
    column(spark, [("25", 25), ("No. of Shares 25", 25), ("12 34", 1234), ("N/A", None), ("", None), (None, None)], as_int(numbers.parse_numeric))
    column(spark, [("Rs. 100.00", 100.0), ("10", 10.0), ("1,250.5", 1250.5), ("x", None)], numbers.parse_decimal)
    cases = [
        ("TWENTY FIVE", 25), ("twenty five", 25), ("TWENTY F1VE", 25), ("ONE HUNDRED", 100), ("ONE THOUSAND", 1000), ("TWO HUNDRED AND FIFTY", 250), ("ONE LAKH", 100000),
        ("hundred", 100), ("zero", 0), ("two crore five lakh", 20500000), ("METALS WORKS", None), ("twenty x", None), ("", None), (None, None), ("and", None),
    ]
    column(spark, cases, numbers.words_to_number)
    column(spark, [("25", 25), ("TWENTY FIVE", 25), ("", None)], as_int(numbers.parse_shares_count))
    column(spark, [("25", 25), (" -7 ", -7), ("1_000", 1000), ("25.7", None), ("", None), (None, None), ("twenty-five", None)], as_int(numbers.safe_int))
    column(spark, [("1.5", 1.5), ("1e3", 1000.0), ("1.0d", None), ("x", None)], numbers.safe_decimal)


def test_dates(spark):
    same = ["14th August 1967", "14 August 1967", "14-08-1967", "14/08/1967", "this 14 day of August 1967", "1967-08-14"]
    other = [
        ("9 OCT 1979", "1979-10-09"), ("35/13/1967", None), ("Given under the Common Seal", None), ("", None), (None, None), ("08/14/1967", "1967-08-14"), ("30/02/1967", None),
        ("1967-13-14 and 14/08/1967", None), ("14 Foo 1967, 15/08/1967", "1967-08-15"), ("14/08/1849", None),
    ]
    column(spark, [(s, "1967-08-14") for s in same] + other, dates.normalize_date)


def test_columns(spark):
    edges = [(0.0, "transfer_date"), (0.13, "transfer_date"), (0.131, "transfer_no"), (0.25, "transfer_no"), (0.66, "transferee_name"), (0.80, "ledger_folio_no"), (1.0, "authorised_signature"),
             (-0.5, "transfer_date"), (1.5, "authorised_signature"), (2.5, "transferee_name")]
    column(spark, edges, geometry.table_column, "double")
