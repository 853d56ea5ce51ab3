"""Text functions of the retrieval engine, as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a query is searched without, unless it has no others.
STOP_WORDS = (
    "a", "an", "and", "are", "at", "be", "can", "could", "did", "do", "does", "for",
    "from", "how", "i", "in", "is", "it", "me", "my", "of", "on", "or", "please",
    "tell", "that", "the", "this", "to", "was", "we", "were", "what", "when", "where",
    "which", "who", "why", "with", "would", "you", "your",
)
#: Cues that a query asks for the newest, or else for earlier, events.
CURRENT_CUES = r"\b(current|currently|latest|recent|newest|now|today)\b|现在|目前|当前|最新|最近|如今"
FORMER_CUES = r"\b(previous|earlier|before|former|original|initially|used to)\b|之前|以前|曾经|过去|原来|最初"

#: What counts as one query term, and as one index token.
TERM = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}]+"


def _marked() -> tuple[str, str]:
    """Small Latin letters with a diacritic, and the plain letters they stand for."""
    found = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        parts = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(parts) > 1 and parts[0].isascii() and all(unicodedata.combining(x) for x in parts[1:]):
            found[c] = parts[0]
    return "".join(found), "".join(found.values())


MARKED, PLAIN = _marked()


def stripped(text: Column) -> Column:
    """Without white space at both ends, of any kind that Unicode has."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def casefold(text: Column) -> Column:
    """Case-folded: small letters, with sharp s written out."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def unmarked(text: Column) -> Column:
    """Small letters without diacritics, as the index compares them."""
    return F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), r"\p{Mn}", "")


def index_tokens(text: Column) -> Column:
    """The index's tokens of a text: runs of letters and digits."""
    return F.regexp_extract_all(unmarked(text), F.lit(TOKEN), F.lit(0))


def query_terms(text: Column) -> Column:
    """A query's terms, in order and as they are written."""
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def direction(text: Column) -> Column:
    """1 if the query asks for the newest, -1 if for earlier events, else 0."""
    return F.when(text.rlike("(?iU)" + CURRENT_CUES), 1).when(text.rlike("(?iU)" + FORMER_CUES), -1).otherwise(0)


#: Most rows that a channel contributes.
MOST_POOL = 200


def pool_size(top_k: Column) -> Column:
    """How many rows a channel contributes: four times the results, within 50 and MOST_POOL."""
    return F.least(F.greatest(top_k * 4, F.lit(50)), F.lit(MOST_POOL))
