"""Fields, transfers, rules and scores on small pages."""

from pyspark.sql import functions as F

from certjobs.operators import fields, pages, rules, transfers
from certjobs.sources.io import PAGES


def page(doc, no, *lines, conf=0.95):
    rows = [(i, text, (c[0] if c else conf), *map(float, box)) for i, (text, box, *c) in enumerate(lines)]
    return (doc, no, 1000, 1000, rows)


def field_values(spark, *lines):
    docs = spark.createDataFrame([page(1, 1, *lines)], PAGES).select("doc_id", F.struct("page_no", "image_width", "image_height", "lines").alias("page1"))
    return fields.extract_fields(docs).first()


HOLDER = [("THIS IS TO CERTIFY THAT", (100, 440, 500, 460)), ("121", (100, 470, 150, 490)), ("SOME BROTHERS PRIVATE LTD.", (100, 490, 600, 510))]
SENTENCE = ("is/are the registered holder(s) of TWENTY FIVE", (100, 510, 700, 530))


def test_holder(spark):
    got = field_values(spark, *HOLDER, SENTENCE)["share_holder_name"]
    assert (got["value"], got["needs_review"], got["confidence"]) == ("SOME BROTHERS PRIVATE LTD", False, 1.0)
    got = field_values(spark, *HOLDER[:2], SENTENCE)["share_holder_name"]
    assert (got["value"], got["needs_review"], got["confidence"], got["source"]) == (None, True, 0.0, "regex")


def test_number_date_and_empty_page(spark):
    got = field_values(spark, ("Cert.No.OB1608", (20, 20, 200, 50)), ("this Fourteenth day of August 1967", (100, 650, 500, 670)))
    assert got["certificate_no"]["value"] == "OB1608" and got["date_of_issue"]["value"] == "1967-08-14" and got["date_of_issue"]["confidence"] == 0.7
    got = field_values(spark, ("Twenty-first day of June 1970", (100, 650, 500, 670)))
    assert got["date_of_issue"]["value"] == "1970-06-01"  # the ordinal list has no compound
    got = field_values(spark)
    assert all(got[n]["value"] is None and got[n]["needs_review"] for n in fields.NAMES)


def test_distinctive(spark):
    prose = [("Distinctive Numbers", (100, 730, 400, 750)), ("From", (100, 755, 200, 775)), ("To", (300, 755, 400, 775)), ("this Fourteenth day of August 1967", (100, 700, 500, 720))]
    got = field_values(spark, *prose)
    assert got["distinctive_from"]["value"] is None and got["distinctive_to"]["value"] is None
    clean = [("442605", (60, 758, 190, 778), 0.8), ("442629", (330, 758, 460, 778), 0.8)]
    got = field_values(spark, *clean)
    assert (got["distinctive_from"]["value"], got["distinctive_to"]["value"]) == ("442605", "442629") and got["distinctive_from"]["confidence"] == 0.8 * 0.8


def test_sentence(spark):
    box = (100, 540, 700, 560)
    got = field_values(spark, ("registered holder(s) of TWENTY FIVE fully paid Ordinary (Equity) Shares of Rupees Ten each", box))
    assert [got[n]["value"] for n in ("number_of_shares", "share_type", "face_value")] == ["25", "Ordinary (Equity)", "10"]
    got = field_values(spark, ("registered holder(s) of TEN fully paid Ordinary Shares of Rupees 1O each", box))
    assert got["face_value"]["value"] == "1.0"
    got = field_values(spark, ("registered holder(s) of 25 fully paid Ordinary Shares of Rupees 100 each", box))
    assert got["number_of_shares"]["value"] is None and got["face_value"]["value"] is None


def test_routing_and_types(spark):
    ledger, front = ("MEMORANDUM OF TRANSFERS", (0, 0, 10, 10)), ("THIS IS TO CERTIFY", (0, 0, 10, 10))
    rows = [page(1, 1, ledger), page(1, 2, ledger), page(1, 3, front), page(2, 1, ("x", (0, 0, 1, 1))), page(2, 2, ledger), page(3, 1, ledger), page(4, 1, ("CERT NO", (0, 0, 1, 1)), ("TRANSFEREE", (0, 0, 1, 1)))]
    typed = pages.classify_pages(spark.createDataFrame(rows, PAGES))
    assert {(r["doc_id"], r["page_no"]): r["page_type"] for r in typed.collect()}[4, 1] == "transfer_ledger"
    got = {r["doc_id"]: (r["page1"] and r["page1"]["page_no"], r["page2"] and r["page2"]["page_no"], r["num_pages"]) for r in pages.route_pages(typed).collect()}
    assert got == {1: (2, 1, 3), 2: (1, 2, 2), 3: (None, 1, 1), 4: (None, 1, 1)}


def ledger_rows(spark, *lines):
    docs = spark.createDataFrame([page(1, 2, *lines)], PAGES).select("doc_id", F.struct("page_no", "image_width", "image_height", "lines").alias("page2"))
    return [r.asDict() for r in transfers.transfer_rows(docs).orderBy("row_index").collect()]


def at(x, y):
    return (x - 10, y - 9, x + 10, y + 9)


def test_ledger(spark):
    got = ledger_rows(
        spark, ("Transferee", at(400, 300)), ("low", at(400, 50)), ("14/08/1967", at(60, 200)), ("A", at(350, 200)), ("B", at(330, 210)), ("F1", at(700, 200)), ("F2", at(700, 300)),
        ("illegible", at(60, 400)), ("Holder", at(400, 400)), ("chained", at(400, 440)),
    )
    assert [(r["row_index"], r["transfer_date"], r["transferee_name"], r["needs_review"]) for r in got] == [(0, "1967-08-14", "B A", False), (2, "illegible", "Holder chained", True)]
    assert got[1]["confidence"] == round((0.95 + 0.95 + 0.0) / 3, 4)


def test_rules(spark):
    def judged(**v):
        base = dict.fromkeys(["number_of_shares", "face_value", "distinctive_from", "distinctive_to", "date_of_issue"]) | v
        cols = {k: F.lit(x).cast("string") for k, x in base.items()}
        found = rules.outcomes(cols)
        r = spark.range(1).select(found.alias("o"), rules.overall_status(found).alias("s"), rules.flag_summary(found).alias("f")).first()
        return {o["rule_name"]: (o["passed"], o["message"]) for o in r["o"]}, r["s"], r["f"]

    good = dict(number_of_shares="25", face_value="10", distinctive_from="4425", distinctive_to="4449", date_of_issue="1967-08-14")
    assert judged(**good)[1:] == ("passed", "")
    found, status, flags = judged(**good | {"number_of_shares": None})
    assert status == "failed" and "missing" in flags and "distinctive_range_matches_shares" not in found
    assert judged(number_of_shares="twenty-five")[0]["number_of_shares_numeric"] == (False, "Number of shares is not a valid integer")
    assert judged(**good | {"distinctive_to": "4500"})[0]["distinctive_range_matches_shares"] == (False, "To - From + 1 (76) != number_of_shares (25)")
    assert judged(**good | {"present_transfer_date": "1960-01-01"})[0]["transfer_after_issue"][0] is False
    assert judged(**good | {"present_transfer_date": "1967-08-14"})[0]["transfer_after_issue"][0] is True


def test_overall_confidence(spark):
    golden = [0.0, 0.9935, 0.9909, 0.7, 0.75, 0.75, 0.75, 0.4204, 0.0]
    cols = [F.struct(F.lit(c).alias("confidence")) for c in golden]
    assert spark.range(1).select(rules.overall_confidence(cols).alias("c")).first()["c"] == 0.595
