"""Consistency rules, scoring, and the certificate record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certjobs.functions.dates import normalize_date
from certjobs.functions.numbers import safe_decimal, safe_int
from certjobs.functions.steps import computed, once
from certjobs.operators.fields import NAMES

OUTCOME = "struct<rule_order:int,rule_name:string,passed:boolean,message:string>"
THRESHOLD = 0.70


def _outcome(order: int, name: str, passed: Column, message: Column) -> Column:
    return F.struct(F.lit(order).alias("rule_order"), F.lit(name).alias("rule_name"), passed.alias("passed"), F.when(passed, "").otherwise(message).alias("message")).cast(OUTCOME)


def outcomes(value: dict[str, Column]) -> Column:
    """The rules' outcomes, in order, as an array. ``value`` has number_of_shares, face_value, distinctive_from, distinctive_to,
    date_of_issue and, optionally, present_transfer_date, all as text.

    Four outcomes always exist; the match of range and shares needs all three integers, the order of dates both dates.
    """
    parsed = {n: safe_int(value[n]) for n in ("number_of_shares", "distinctive_from", "distinctive_to")}
    parsed |= {"face_value": safe_decimal(value["face_value"])}
    parsed |= {n: normalize_date(value[n]) for n in ("date_of_issue", "present_transfer_date") if n in value}
    return once(F.struct(*[c.alias(n) for n, c in parsed.items()]), lambda read: _judged(value, {n: read[n] for n in parsed}))


def _judged(value: dict[str, Column], read: dict[str, Column]) -> Column:
    """The outcomes of values as text and as they are read."""
    shares, low, high, face, issued = (read[n] for n in ("number_of_shares", "distinctive_from", "distinctive_to", "face_value", "date_of_issue"))
    both = low.isNotNull() & high.isNotNull()
    expected = high - low + 1
    found = [
        _outcome(
            1, "number_of_shares_numeric", shares.isNotNull(),
            F.when(value["number_of_shares"].isNull(), "Number of shares missing").otherwise("Number of shares is not a valid integer"),
        ),
        _outcome(2, "face_value_numeric", face.isNotNull(), F.lit("Face value is not numeric")),
        _outcome(
            3, "distinctive_range_order", F.coalesce(low <= high, F.lit(False)),
            F.when(both, "Distinctive 'From' is greater than 'To'").otherwise("Distinctive numbers missing/unreadable"),
        ),
        F.when(
            both & shares.isNotNull(),
            _outcome(
                4, "distinctive_range_matches_shares", F.coalesce(expected == shares, F.lit(False)),
                F.concat(F.lit("To - From + 1 ("), expected.cast("string"), F.lit(") != number_of_shares ("), shares.cast("string"), F.lit(")")),
            ),
        ),
        _outcome(5, "date_of_issue_valid", issued.isNotNull(), F.lit("Date of issue missing/unparseable")),
    ]
    if "present_transfer_date" in read:
        moved = read["present_transfer_date"]
        later = F.coalesce(moved >= issued, F.lit(False))  # ISO texts, which are ordered as their dates are
        found.append(
            F.when(moved.isNotNull() & issued.isNotNull(), _outcome(6, "transfer_after_issue", later, F.lit("Transfer date is earlier than the certificate's issue date")))
        )
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def overall_status(found: Column) -> Column:
    return F.when(F.size(found) == 0, "unknown").when(F.forall(found, lambda x: x["passed"]), "passed").otherwise("failed")


def flag_summary(found: Column) -> Column:
    return F.array_join(F.transform(F.filter(found, lambda x: ~x["passed"] & (x["message"] != "")), lambda x: x["message"]), "; ")


def overall_confidence(fields: list[Column]) -> Column:
    """The mean over all nine fields, missing ones as zero; 0 without a page."""
    there = fields[0].isNotNull()
    return F.when(there, F.round(sum((f["confidence"] for f in fields), F.lit(0.0)) / len(fields), 4)).otherwise(0.0)


PRESENT = ["present_share_holder_name", "present_transfer_date", "present_folio_no"]


def certificates(wide: DataFrame, threshold: float = THRESHOLD, validate_transfers: bool = False, keep: list[str] | None = None) -> DataFrame:
    """The certificate record of each document in ``wide`` (doc_id, source_file, page_number, the nine field structs and, where the
    ledger was read, the present holder, date and folio), with what ``keep`` names; narrow. The rules look at the front page only,
    unless ``validate_transfers`` is set."""
    ledger = PRESENT[0] in wide.columns
    values = {n: F.col(f"{n}.value") for n in NAMES}
    if validate_transfers and ledger:
        values["present_transfer_date"] = F.col("present_transfer_date")
    judged = computed(wide, wide.columns, {"outcomes": outcomes(values)}).withColumn("validation_status", overall_status(F.col("outcomes")))
    confidence = overall_confidence([F.col(n) for n in NAMES])
    flagged = F.coalesce(F.exists(F.array(*[F.col(f"{n}.needs_review") for n in NAMES]), lambda x: x), F.lit(False))
    return judged.select(
        "doc_id", "company_name.value", "share_type.value", "certificate_no.value", "share_holder_name.value",
        safe_int(values["number_of_shares"]).try_cast("int"), safe_decimal(values["face_value"]).try_cast("decimal(12,2)"),
        "distinctive_from.value", "distinctive_to.value", "date_of_issue.value", "source_file", F.coalesce("page_number", F.lit(1)),
        confidence, (confidence < threshold) | (F.col("validation_status") == "failed") | flagged, "validation_status", flag_summary(F.col("outcomes")), "outcomes",
        *(PRESENT if ledger else [F.lit(None).cast("string").alias(p) for p in PRESENT]), *(keep or []),
    ).toDF(
        "doc_id", "company_name", "share_type", "certificate_no", "share_holder_name", "number_of_shares", "face_value", "distinctive_from", "distinctive_to", "date_of_issue",
        "source_file", "page_number", "overall_confidence", "needs_review", "validation_status", "validation_flags", "outcomes", *PRESENT, *(keep or []),
    )


def outcome_rows(certs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The rule table: one row per certificate and outcome, with what ``keep`` names."""
    kept = ["doc_id", *(keep or [])]
    return certs.select(*kept, F.explode("outcomes").alias("x")).select(*kept, "x.*")
