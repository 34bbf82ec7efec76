"""The nine fields of a certificate's front page, by rules over its lines; narrow expressions, no shuffle."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certjobs.functions.dates import date_in, iso_date, month_of
from certjobs.functions.geometry import center, in_region
from certjobs.functions.numbers import parse_shares_count, words_to_number
from certjobs.functions.steps import computed, once
from certjobs.functions.text import collapse_label, first_match, fix_numeric_ocr, has_any, looks_numeric, normalize_whitespace, only_digits, parts, strip_noise

FIELD = "struct<value:string,confidence:double,source:string,page:int,region:string,needs_review:boolean>"
#: The nine fields in order.
NAMES = [
    "certificate_no", "company_name", "share_holder_name", "date_of_issue", "number_of_shares", "share_type", "face_value", "distinctive_from", "distinctive_to",
]
#: Patterns, excluded words, ordinals, confidences.
CERTIFICATE_NO = r"(?iU)CERT(?:IFICATE)?\.?\s*NO\.?\s*[:\-]?\s*([A-Z0-9/\-]{2,20})"
SERIAL = r"(?U)^\s*\d{1,4}\s*/\s*\d{0,4}\s*\|?\s*"
DAY_OF = r"(?iU)(this\s+)?(\d{1,2}(?:st|nd|rd|th)?|[A-Za-z]+)\s+day\s+of\s+([A-Za-z]+)\.?,?\s*(\d{4})"
SENTENCE = (
    r"(?iU)registered\s+holder.{0,15}?of\s+([A-Z\s]+?)\s+fully\s+paid\s+([A-Za-z()\s]+?)\s+Shares?\s+of\s+Rupees\s+([A-Za-z0-9]+)\s+each"
)
NOT_COMPANY = ["CERT", "NO OF SHARES", "SHARES", "REGISTERED OFFICE", "AUTHORISED"]
COMPANY = ["LTD", "LIMITED", "COMPANY"]
ORDINALS = {
    w: n
    for n, w in enumerate(
        "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth "
        "nineteenth twentieth".split(),
        1,
    )
} | {"thirty-first": 31}
BONUS, SENTENCE_CONFIDENCE, DAY_OF_CONFIDENCE, ANY_DATE_CONFIDENCE, HAND = 0.05, 0.75, 0.7, 0.5, 0.8


def field(value: Column, confidence: Column, source: str, region: str, needs_review: Column) -> Column:
    return F.struct(
        value.cast("string").alias("value"), confidence.cast("double").alias("confidence"), F.lit(source).alias("source"), F.lit(1).alias("page"),
        F.lit(region).alias("region"), needs_review.alias("needs_review"),
    ).cast(FIELD)


def empty(region: str) -> Column:
    """What is not found is null, without confidence, and for review."""
    return field(F.lit(None), F.lit(0.0), "regex", region, F.lit(True))


def _confidence(line: Column, width: Column, height: Column, region: str, extra: Column | None = None) -> Column:
    base = F.round(line["confidence"], 4)
    base = base if extra is None else F.when(extra, F.least(F.lit(1.0), base + 0.1)).otherwise(base)
    return F.least(F.lit(1.0), base + F.when(in_region(line, width, height, region), BONUS).otherwise(0.0))


def _first_match(lines: Column) -> Column:
    """The first line with a certificate number; the pattern is tried where its first letters are."""
    return F.get(F.filter(lines, lambda x: x["label"].contains("CERT") & x["text"].rlike(CERTIFICATE_NO)), F.lit(0))


def certificate_no(line: Column, width: Column, height: Column) -> Column:
    found = field(strip_noise(F.regexp_extract(line["text"], CERTIFICATE_NO, 1)), _confidence(line, width, height, "certificate_number"), "paddleocr", "certificate_number", F.lit(False))
    return F.when(line.isNotNull(), found).otherwise(empty("certificate_number"))


def _banner(lines: Column, height: Column) -> Column:
    """The tallest box of the upper third that can be a company's name; the earliest of equally tall ones."""
    fits = lambda x: (center(x["y1"], x["y2"], height) <= 0.32) & (F.length(x["label"]) >= 4) & ~has_any(x["label"], NOT_COMPANY)
    return F.array_max(F.transform(F.filter(lines, fits), lambda x: F.struct((x["y2"] - x["y1"]).alias("h"), (-x["line_no"]).alias("n"), x.alias("line"))))["line"]


def company_name(line: Column, width: Column, height: Column) -> Column:
    confidence = _confidence(line, width, height, "company_name", has_any(line["label"], COMPANY))
    found = once(confidence, lambda c: field(strip_noise(line["text"]), c, "paddleocr", "company_name", c < 0.5))
    return F.when(line.isNotNull(), found).otherwise(empty("company_name"))


def _named(lines: Column) -> Column:
    """The first of the three lines after CERTIFY THAT that is usable (kind 1) or goes on with the sentence (kind 2)."""
    anchor = F.array_position(F.transform(lines, lambda x: x["label"].contains("CERTIFY THAT")), True)

    def judged(x: Column) -> Column:
        text = F.coalesce(x["text"], F.lit(""))
        bare = strip_noise(F.when(text.contains("/"), F.regexp_replace(text, SERIAL, "")).otherwise(text))

        def kind(value: Column) -> Column:
            named = (F.length(value) >= 3) & (F.length(F.regexp_replace(value, r"[^\p{L}]+", "")) >= 3)
            found = F.when(x["label"] == "", 0).when(has_any(x["label"], ["REGISTERED HOLDER", "IS/ARE"]), 2).when(named, 1).otherwise(0)
            return F.struct(found.alias("kind"), value.alias("value"), x.alias("line"))

        return once(bare, kind)

    after = lambda at: F.when(at > 0, F.slice(lines, at.cast("int") + 1, 3))
    return F.get(F.filter(F.transform(once(anchor, after), judged), lambda s: s["kind"] > 0), F.lit(0))


def holder_name(first: Column, width: Column, height: Column) -> Column:
    found = field(first["value"], _confidence(first["line"], width, height, "holder_name"), "paddleocr", "holder_name", F.lit(False))
    return F.when(first["kind"] == 1, found).otherwise(empty("holder_name"))


def _sentence(text: Column) -> Column:
    """The three groups of the shares sentence, null without it. A plain search for its last word spares most pages the regex."""
    found = F.when(F.upper(text).contains("EACH"), first_match(text, SENTENCE)).otherwise("")
    return once(found, lambda x: F.when(x != "", parts(x, SENTENCE, [1, 2, 3], "/")))


def _said(groups: Column) -> Column:
    """Share count, type and face value, as text, of the sentence's groups."""
    face = groups[2]
    digits = F.regexp_extract(face, r"\d+", 0)
    value = once(digits, lambda x: F.when(x != "", F.concat(x.try_cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(words_to_number(face).cast("string")))
    count = parse_shares_count(groups[0]).cast("string")
    return F.struct(count.alias("number_of_shares"), F.nullif(normalize_whitespace(groups[1]), F.lit("")).alias("share_type"), value.alias("face_value"))


def shares_sentence(said: Column) -> dict[str, Column]:
    """Share count, type and face value from the one sentence that has all three."""
    region = "shares_and_face_value"
    one = lambda v: F.when(v.isNotNull(), field(v, F.lit(SENTENCE_CONFIDENCE), "regex", region, F.lit(False))).otherwise(empty(region))
    return {n: one(said[n]) for n in ("number_of_shares", "share_type", "face_value")}


def _dates(text: Column, strict_ordinals: bool) -> Column:
    """The date after "day of", and the first date of the page. ``strict_ordinals`` refuses ordinals of two words, of which
    only the last would be read ("twenty-first" as the first). The page's dates are looked for where the other is not there."""

    def day(raw: Column) -> Column:
        table = F.create_map(*[F.lit(x) for x in chain.from_iterable(ORDINALS.items())])
        return F.coalesce(F.try_element_at(table, raw), F.nullif(F.regexp_extract(raw, r"^(\d+)(?:st|nd|rd|th)?$", 1), F.lit("")).try_cast("int"))

    read = lambda p: iso_date(once(F.lower(F.get(p, 0)), day), month_of(F.get(p, 1)), F.get(p, 2).try_cast("int"))
    found = F.when(F.upper(text).contains("DAY"), first_match(text, DAY_OF)).otherwise("")
    spoken = once(found, lambda x: F.when(x != "", once(parts(x, DAY_OF, [2, 3, 4], "/"), read)))
    if strict_ordinals:
        spoken = F.when(~text.rlike(r"(?i)(twenty|thirty)[\s-]+[a-z]+\s+day\s+of"), spoken)
    return once(spoken, lambda x: F.struct(x.alias("spoken"), F.when(x.isNull(), date_in(text)).alias("anywhere")))


def issue_date(dates: Column) -> Column:
    one = lambda v, c: field(v, F.lit(c), "regex", "issue_date", F.lit(False))
    spoken, anywhere = dates["spoken"], dates["anywhere"]
    return F.when(spoken.isNotNull(), one(spoken, DAY_OF_CONFIDENCE)).when(anywhere.isNotNull(), one(anywhere, ANY_DATE_CONFIDENCE)).otherwise(empty("issue_date"))


def _numbers(lines: Column, width: Column, height: Column) -> Column:
    """The numbers of the distinctive region, from the top."""
    digits = lambda x: only_digits(fix_numeric_ocr(x["text"]))
    fits = lambda x: in_region(x, width, height, "distinctive_numbers", tolerance=0.02) & looks_numeric(x["text"]) & (F.length(digits(x)) >= 3)
    row = lambda x: F.struct(x["y1"].alias("y1"), x["line_no"].alias("n"), digits(x).alias("digits"), x["confidence"].alias("confidence"))
    return F.array_sort(F.transform(F.filter(lines, fits), row))


def distinctive_numbers(ranked: Column) -> dict[str, Column]:
    """The first two numbers of their region."""

    def one(i: int) -> Column:
        x = F.get(ranked, F.lit(i))
        confidence = F.least(F.lit(1.0), F.round(x["confidence"], 4) * HAND)
        found = once(confidence, lambda c: field(x["digits"], c, "paddleocr", "distinctive_numbers", c < 0.5))
        return F.when(x.isNotNull(), found).otherwise(empty("distinctive_numbers"))

    return {"distinctive_from": one(0), "distinctive_to": one(1)}


#: What each field rests on.
RESTS_ON = {
    "certificate_no": "__cert", "company_name": "__banner", "share_holder_name": "__named", "date_of_issue": "__dates", "number_of_shares": "__groups", "share_type": "__groups",
    "face_value": "__groups", "distinctive_from": "__numbers", "distinctive_to": "__numbers",
}


def extract_fields(docs: DataFrame, page: str = "page1", keep: list[str] | None = None, strict_ordinals: bool = False, names: list[str] | None = None) -> DataFrame:
    """``doc_id``, what ``keep`` names, and a struct column per field (of ``names``, or all); the structs are null where there is no page.

    Nothing is computed twice: lines in order with their labels, and the page's text; then the line or the text that each field rests
    on; then the fields.
    """
    at, kept, names = F.col(page), ["doc_id", *(keep or [])], names or NAMES
    used, w, h = {RESTS_ON[n] for n in names}, at["image_width"], at["image_height"]
    line = lambda x: F.struct(*[x[n].alias(n) for n in ("line_no", "text", "confidence", "x1", "y1", "x2", "y2")], collapse_label(x["text"]).alias("label"))
    text = lambda lines: normalize_whitespace(F.array_join(F.transform(lines, lambda x: F.coalesce(x["text"], F.lit(""))), " "))
    said = lambda full: once(_sentence(full), lambda groups: F.when(groups.isNotNull(), _said(groups)))
    of_lines = {"__cert": _first_match, "__banner": lambda x: _banner(x, h), "__named": _named, "__numbers": lambda x: _numbers(x, w, h)}
    of_text = {"__groups": said, "__dates": lambda x: _dates(x, strict_ordinals)}
    made = {
        "__cert": lambda x: {"certificate_no": certificate_no(x, w, h)}, "__banner": lambda x: {"company_name": company_name(x, w, h)},
        "__named": lambda x: {"share_holder_name": holder_name(x, w, h)}, "__dates": lambda x: {"date_of_issue": issue_date(x)}, "__groups": shares_sentence, "__numbers": distinctive_numbers,
    }

    def picked(lines: Column) -> Column:
        labelled, full = [c for c in of_lines if c in used], [c for c in of_text if c in used]
        parts = [(once(F.transform(lines, line), lambda x: F.struct(*[of_lines[c](x).alias(c) for c in labelled])), labelled)] if labelled else []
        parts += [(once(text(lines), lambda x: F.struct(*[of_text[c](x).alias(c) for c in full])), full)] if full else []
        return F.struct(*[part.alias(f"__{i}") for i, (part, _) in enumerate(parts)])

    def fields(chosen: Column) -> Column:
        groups = [g for g in ([c for c in of_lines if c in used], [c for c in of_text if c in used]) if g]
        found = {n: f for i, group in enumerate(groups) for c in group for n, f in made[c](chosen[f"__{i}"][c]).items()}
        return F.struct(*[F.when(at.isNotNull(), found[n]).alias(n) for n in names])

    return computed(docs, kept, {"__fields": once(once(F.array_sort(at["lines"]), picked), fields)}).select(*kept, "__fields.*")


def long_fields(wide: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per document and field, with what ``keep`` names: the field table. Documents without a front page have no rows."""
    kept = ["doc_id", *(keep or [])]
    each = F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(n).alias("f")) for n in NAMES])
    rows = wide.select(*kept, F.explode(each).alias("x")).filter(F.col("x.f").isNotNull())
    return rows.select(*kept, "x.field_name", "x.f.*")


