"""Text features. A null reads as the text ``nan`` wherever lengths and words count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scheme keywords and organisation word lists.
SCHEME_KEYWORDS = ["water", "pump", "bore", "well", "spring", "gravity", "pipe"]
ORGANISATION_WORDS = {
    "government": ["government", "ministry", "district", "council", "dwe"],
    "ngo": ["world", "vision", "oxfam", "foundation", "trust", "charity"],
    "religious": ["church", "mission", "christian", "islamic", "religious"],
    "private": ["company", "limited", "ltd", "private", "individual"],
}


def as_text(c: Column) -> Column:
    return F.coalesce(c, F.lit("nan"))


def text_length(c: Column) -> Column:
    return F.length(as_text(c))


def word_count(c: Column) -> Column:
    trimmed = F.regexp_replace(as_text(c), r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def has_digits(c: Column) -> Column:
    return as_text(c).rlike("[0-9]").cast("int")


def has_special(c: Column) -> Column:
    return as_text(c).rlike(r"[^a-zA-Z0-9\s]").cast("int")


def keyword_flag(c: Column, word: str) -> Column:
    return F.lower(as_text(c)).contains(word).cast("int")


def any_word_flag(c: Column, words: list[str]) -> Column:
    return F.lower(as_text(c)).rlike("|".join(words)).cast("int")


def display_text(c: Column, width: int = 30, default: str = "NaN") -> Column:
    return F.substring(F.coalesce(c, F.lit(default)), 1, width)
