"""Porter's stemmer (1980, with his later changes) as expressions of regular-expression functions.

Nothing runs in Python: each step is a test and a replacement of a column w, so stems can be had
inside any plan. A step's text is SQL that Spark and engines with RE2 expressions both run, but for
the name of the match test, which stands as MATCH.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: The stem's measure is above 0, is 1, is above 1; it has a vowel; it ends like "hop".
ABOVE_0, IS_1, ABOVE_1 = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}"
VOWEL, SHORT = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"
#: The published suffixes of steps 2, 3 and 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: Words of fewer or more characters stay as they are.
SHORTEST, LONGEST = 3, 64


def _cut(n: int, text: str = "w") -> str:
    return f"substr({text}, 1, length({text}) - {n})"


def _is(text: str, pattern: str) -> str:
    return f"MATCH({text}, '{pattern}')"


def _part(pattern: str, group: int) -> str:
    return f"regexp_extract(w, '{pattern}', {group})"


def _replaced(table: dict[str, str]) -> str:
    pattern = f"^(.+?)({'|'.join(table)})$"
    to = f"CASE {_part(pattern, 2)} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"
    return f"CASE WHEN {_is('w', pattern)} AND {_is(_part(pattern, 1), ABOVE_0)} THEN concat({_part(pattern, 1)}, {to}) ELSE w END"


def steps() -> list[str]:
    """The steps in order; each takes w and gives the next w."""
    went = _part("^(.+)(ed|ing)$", 1)
    v = _cut(1)  # without the mark
    last = f"substr({v}, length({v}), 1)"
    dropped, ion = f"^(.+?)({'|'.join(STEP4)})$", "^(.+)(s|t)(ion)$"
    root = f"concat({_part(ion, 1)}, {_part(ion, 2)})"
    return [
        f"CASE WHEN {_is('w', '^.+(ss|i)es$')} THEN {_cut(2)} WHEN {_is('w', '[^s]s$')} THEN {_cut(1)} ELSE w END",
        # a mark tells the next step that ed or ing went
        f"CASE WHEN {_is('w', '^.+eed$')} THEN CASE WHEN {_is(_cut(3), ABOVE_0)} THEN {_cut(1)} ELSE w END WHEN {_is(went, VOWEL)} THEN concat({went}, '+') ELSE w END",
        f"CASE WHEN NOT {_is('w', '[+]$')} THEN w WHEN {_is(v, '(at|bl|iz)$')} THEN concat({v}, 'e') WHEN {_is(v, '[^aeiouylsz]$')} AND {last} = substr({v}, length({v}) - 1, 1) AND length({v}) > 1 THEN {_cut(2)} WHEN {_is(v, SHORT)} THEN concat({v}, 'e') ELSE {v} END",
        f"CASE WHEN {_is('w', 'y$')} AND {_is(_cut(1), VOWEL)} THEN concat({_cut(1)}, 'i') ELSE w END",
        _replaced(STEP2),
        _replaced(STEP3),
        f"CASE WHEN {_is('w', dropped)} THEN CASE WHEN {_is(_part(dropped, 1), ABOVE_1)} THEN {_part(dropped, 1)} ELSE w END WHEN {_is('w', ion)} AND {_is(root, ABOVE_1)} THEN {root} ELSE w END",
        f"CASE WHEN {_is('w', 'e$')} AND ({_is(_cut(1), ABOVE_1)} OR {_is(_cut(1), IS_1)} AND NOT {_is(_cut(1), SHORT)}) THEN {_cut(1)} ELSE w END",
        f"CASE WHEN {_is('w', 'll$')} AND {_is('w', ABOVE_1)} THEN {_cut(1)} ELSE w END",
    ]


def with_stem(words: DataFrame, word: str, to: str = "stem") -> DataFrame:
    """`words` with the stem of the column `word`; meant for distinct words."""
    fits = F.length(word).between(SHORTEST, LONGEST)
    out = words.withColumn("w", F.when(fits, F.col(word)))
    for s in steps():
        out = out.withColumn("w", F.expr(s.replace("MATCH(", "regexp_like(")))
    return out.withColumn(to, F.when(fits, F.col("w")).otherwise(F.col(word))).drop("w")


def stem_sql(source: str, word: str) -> str:
    """SELECT of `word` and its stem from the distinct words of a relation, for RE2 engines."""
    inner = f"(SELECT DISTINCT {word} AS word, {word} AS w FROM {source})"
    for s in steps():
        inner = f"(SELECT word, {s.replace('MATCH(', 'regexp_matches(')} AS w FROM {inner})"
    return f"SELECT word, CASE WHEN length(word) BETWEEN {SHORTEST} AND {LONGEST} THEN w ELSE word END AS stem FROM {inner}"
