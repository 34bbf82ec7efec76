"""Dates to ISO text as column expressions; never a guess."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from certjobs.functions.steps import once
from certjobs.functions.text import first_match, normalize_whitespace, parts

#: Month names and abbreviations, and the years that are believed.
MONTHS = "january february march april may june july august september october november december".split()
MONTH_OF = {m: n for n, m in enumerate(MONTHS, 1)} | {m[:3]: n for n, m in enumerate(MONTHS, 1)} | {"sept": 9}
FIRST_YEAR, LAST_YEAR = 1850, 2035
#: The three forms of a date, tried in this order.
ISO = r"(\d{4})-(\d{1,2})-(\d{1,2})"
TEXTUAL = r"(?iU)(\d{1,2})(?:st|nd|rd|th)?\s+(?:day\s+of\s+)?([A-Za-z]+)\.?,?\s+(\d{4})"
NUMERIC = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})"


def month_of(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(MONTH_OF.items())])
    return F.try_element_at(table, F.lower(name))


def iso_date(day: Column, month: Column, year: Column) -> Column:
    """ISO text of a calendar date, or null if there is no such date or its year is not believed."""

    def made(at: Column) -> Column:
        d, m, y = at["d"], at["m"], at["y"]
        length = F.dayofmonth(F.last_day(F.make_date(y, m, F.lit(1))))
        two = lambda n: F.lpad(n.cast("string"), 2, "0")
        return F.when(y.between(FIRST_YEAR, LAST_YEAR) & m.between(1, 12) & (d >= 1) & (d <= length), F.concat(y.cast("string"), F.lit("-"), two(m), F.lit("-"), two(d)))

    return once(F.struct(day.cast("int").alias("d"), month.cast("int").alias("m"), year.cast("int").alias("y")), made)


def normalize_date(c: Column) -> Column:
    """The first ISO date; else the first day-month-name-year with a known month; else the first numeric date, day first
    (swapped only if the month is above 12 and the day is not). What is found first decides, even if it is no date."""
    return once(normalize_whitespace(c), date_in)


def date_in(text: Column) -> Column:
    """``normalize_date`` of a text whose white space is normalised. Each form is looked for once, and taken apart where it is found."""
    part = lambda p, i: F.get(p, F.lit(i)).try_cast("int")

    def iso(found: Column) -> Column:
        return once(F.split(found, "-"), lambda p: iso_date(part(p, 2), part(p, 1), part(p, 0)))

    def textual(p: Column) -> Column:
        return F.struct(part(p, 0).alias("d"), month_of(F.get(p, F.lit(1))).alias("m"), part(p, 2).alias("y"))

    def numeric(p: Column) -> Column:
        d, m, y = (part(p, i) for i in range(3))
        swap = (m > 12) & (d <= 12)
        return iso_date(F.when(swap, m).otherwise(d), F.when(swap, d).otherwise(m), y)

    in_figures = once(F.regexp_extract(text, NUMERIC, 0), lambda x: F.when(x != "", once(F.split(F.replace(x, F.lit("-"), F.lit("/")), "/"), numeric)))
    spoken = once(first_match(text, TEXTUAL), lambda x: F.when(x != "", once(parts(x, TEXTUAL, [1, 2, 3], "/"), textual)))
    otherwise = once(spoken, lambda t: F.when(t["m"].isNotNull(), iso_date(t["d"], t["m"], t["y"])).otherwise(in_figures))
    return once(F.when(text.contains("-"), F.regexp_extract(text, ISO, 0)).otherwise(""), lambda x: F.when(x != "", iso(x)).otherwise(otherwise))
