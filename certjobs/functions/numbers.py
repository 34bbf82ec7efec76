"""Numbers from digits and from English words, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from certjobs.functions.text import fix_word_ocr, normalize_whitespace, only_digits

#: Number words, and words that say nothing.
ONES = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"hundred": 100, "thousand": 1000, "lakh": 100_000, "lac": 100_000, "crore": 10_000_000}
IGNORED = ["and", "only", "rupees", "rs", "rs.", "shares", "share"]

WORDS = {w: n for n, w in enumerate(ONES)} | {w: 10 * n for n, w in enumerate(TENS, 2)} | SCALES
INTEGER = r"^\s*[+-]?\d+(_\d+)*\s*$"
DECIMAL = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"


def _word_map() -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(WORDS.items())])


def parse_numeric(c: Column) -> Column:
    """All digits of the text as one integer, or null."""
    return F.nullif(only_digits(c), F.lit("")).try_cast("decimal(38,0)")


def parse_decimal(c: Column) -> Column:
    """The first decimal number, thousands commas dropped, or null."""
    return F.nullif(F.regexp_extract(F.replace(F.coalesce(c, F.lit("")), F.lit(","), F.lit("")), r"\d+(\.\d+)?", 0), F.lit("")).try_cast("double")


def words_to_number(c: Column) -> Column:
    """English number words with Indian scales as a long; null if any word is unknown or there is none.

    Digits read in place of letters are repaired inside a word only if the word is not known as it stands. A number beyond a long
    is null.
    """
    tokens = F.regexp_extract_all(F.lower(normalize_whitespace(c)), F.lit("[A-Za-z0-9]+"), F.lit(0))
    said = F.filter(tokens, lambda t: ~t.isin(IGNORED))
    table = _word_map()
    values = F.transform(said, lambda t: F.coalesce(F.try_element_at(table, t), F.try_element_at(table, F.lower(fix_word_ocr(F.upper(t))))).cast("long"))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("total"), zero.alias("current"), F.lit(0).alias("n"))

    def step(s: Column, v: Column) -> Column:
        # an unknown word makes the running number null, and every sum after it
        counted = F.when(s["current"] == 0, F.lit(1).cast("long")).otherwise(s["current"])
        scaled = F.try_multiply(counted, v)
        flushes = F.coalesce(v > 100, F.lit(False))
        return F.struct(
            F.when(flushes, F.try_add(s["total"], scaled)).otherwise(s["total"]).alias("total"),
            F.when(flushes, zero).when(v == 100, scaled).otherwise(F.try_add(s["current"], v)).alias("current"),
            (s["n"] + 1).alias("n"),
        )

    return F.aggregate(values, start, step, lambda s: F.when(s["n"] > 0, F.try_add(s["total"], s["current"])))


def parse_shares_count(c: Column) -> Column:
    """Digits if there are any, number words otherwise."""
    return F.when(F.coalesce(c, F.lit("")).rlike(r"\d"), parse_numeric(c)).otherwise(words_to_number(c).cast("decimal(38,0)"))


def safe_int(c: Column) -> Column:
    """An integer as text (blanks around, sign and single underscores between digits allowed), or null."""
    return F.when(c.rlike(INTEGER), F.replace(F.trim(F.regexp_replace(c, r"\s", "")), F.lit("_"), F.lit("")).try_cast("decimal(38,0)"))


def safe_decimal(c: Column) -> Column:
    """A decimal number as text, or null."""
    return F.when(c.rlike(DECIMAL), F.replace(F.trim(F.regexp_replace(c, r"\s", "")), F.lit("_"), F.lit("")).try_cast("double"))
