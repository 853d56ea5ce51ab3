"""Word forms that several operators share, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: ASCII characters that are no letter or digit, for texts without A-Z.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty.

    `lower` has a fast path for texts of one byte a character, where it is the same thing.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def spaced(text: Column) -> Column:
    """The words of `text`, lower-cased in A-Z, joined by one space: runs outside BREAKS."""
    return F.trim(F.regexp_replace(ascii_lower(text), BREAKS, " "))


def words(spaced_text: Column) -> Column:
    """The array of words in what `spaced` returns; empty for an empty text."""
    return F.when(spaced_text == "", F.array().cast("array<string>")).otherwise(F.split(spaced_text, " "))
