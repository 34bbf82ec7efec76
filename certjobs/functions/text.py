"""Text clean-up as column expressions, with one small vectorised helper (NFKC)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from certjobs.functions.steps import once

#: White space as Unicode has it, with the four separators below U+0020.
WHITE = r"(?U)[\s\x1c-\x1f]+"
NOT_WHITE = r"(?U)[^\s\x1c-\x1f]"
#: What may be white space other than the blank; a plain class, several times as fast as Unicode's.
UNPRINTED = r"[^ -~]"
#: Fixed value: characters trimmed off both ends of a value.
NOISE = " .:;,-_'\"|"
#: Letters read in place of digits (O Q D, I L, Z, A, S, G, T, B), and digits in place of letters.
LETTERS, DIGITS = "OQDILZASGTBoqdilzasgtb", "0001124567800011245678"
WORD_DIGITS, WORD_LETTERS = "01458", "OIASB"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition; ASCII and null values pass untouched."""
    return texts.map(_composed)


def _composed(text: str | None) -> str | None:
    return text if text is None or text.isascii() else unicodedata.normalize("NFKC", text)


@F.pandas_udf(ArrayType(StringType()))
def nfkc_all(lists: pd.Series) -> pd.Series:
    """``nfkc`` for lists of texts."""
    return lists.map(lambda texts: None if texts is None else [_composed(t) for t in texts])


def normalize_whitespace(c: Column, compose: bool = False) -> Column:
    """White space collapsed and trimmed, null as empty. ``compose`` adds NFKC: apply it once where rows are read, as a
    Python helper is not skipped inside ``when``. Texts of single blanks and printed ASCII, most of all lines, are only trimmed."""
    if compose:
        return F.trim(F.regexp_replace(F.coalesce(nfkc(c), F.lit("")), WHITE, " "))
    odd = lambda v: v.contains("  ") | v.rlike(UNPRINTED)
    return once(F.coalesce(c, F.lit("")), lambda v: F.trim(F.when(odd(v), F.regexp_replace(v, WHITE, " ")).otherwise(v)))


def is_ascii(c: Column) -> Column:
    """Whether patterns read the text alike with and without Unicode's classes; counts bytes only."""
    return F.octet_length(c) == F.char_length(c)


def first_match(c: Column, pattern: str) -> Column:
    """What a pattern with the flags ``(?iU)`` or ``(?U)`` finds first, empty if nothing. ASCII texts go without Unicode's classes,
    which say the same of them and take several times as long."""
    plain = pattern.replace("(?iU)", "(?i)").replace("(?U)", "")
    return F.when(is_ascii(c), F.regexp_extract(c, plain, 0)).otherwise(F.regexp_extract(c, pattern, 0))


def parts(found: Column, pattern: str, groups: list[int], between: str) -> Column:
    """Groups of a match as an array, from the match by itself; ``between`` is a character that no group has and that patterns take as it is."""
    plain = pattern.replace("(?iU)", "(?i)").replace("(?U)", "")
    said = between.join(f"${g}" for g in groups)
    return F.split(F.when(is_ascii(found), F.regexp_replace(found, plain, said)).otherwise(F.regexp_replace(found, pattern, said)), between)


def has_any(c: Column, texts: list[str]) -> Column:
    """Whether any of the texts occurs."""
    out = F.lit(False)
    for text in texts:
        out = out | c.contains(text)
    return out


def has_text(c: Column) -> Column:
    """Whether anything but white space is there; null has nothing."""
    return F.coalesce(c.rlike(NOT_WHITE), F.lit(False))


def strip_noise(c: Column) -> Column:
    return F.btrim(normalize_whitespace(c), F.lit(NOISE))


def collapse_label(c: Column) -> Column:
    """Upper-cased for keyword matching; full stops and colons go after white space is collapsed."""
    return F.replace(F.replace(F.upper(normalize_whitespace(c)), F.lit("."), F.lit("")), F.lit(":"), F.lit(""))


def fix_numeric_ocr(c: Column) -> Column:
    return F.translate(c, LETTERS, DIGITS)


def fix_word_ocr(c: Column) -> Column:
    return F.translate(c, WORD_DIGITS, WORD_LETTERS)


def only_digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]+", "")


def looks_numeric(c: Column, ratio: float = 0.5) -> Column:
    """At least ``ratio`` of the characters that are not white space are digits, before any repair."""
    solid = F.regexp_replace(F.coalesce(c, F.lit("")), WHITE, "")
    return once(solid, lambda v: (F.length(v) > 0) & (F.length(F.regexp_replace(v, r"\D+", "")) >= ratio * F.length(v)))
