"""Secret scanning: fixed patterns, and a likelihood-ratio test between two character Markov models.

Base kinds are `assign`, `access` and `hex`; the method adds the kind `markov`: a token of at least
20 characters from [A-Za-z0-9+/_=.-] whose mean log-likelihood ratio for a character step, random
string against ordinary identifier, is at least the threshold. Both first-order models are trained
on labelled samples (generated by the seeded rules below) with additive smoothing; ratios are kept
as whole thousandths of a bit, so every engine gets the same sums. A `markov` span that overlaps a
base span is dropped; base spans stay.

Spark has no function for the places of matches. Splitting a text by a pattern gives the pieces
between its matches, and the running length of pieces and matches gives their places.

Defined results: a null text counts as empty and has no spans; places are in code points, the end
exclusive; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.sources.tables import table

_VALUE = "[A-Za-z0-9+/_.=-]+"


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
ASSIGN = f"""({_NAMES})["']?\\x20*[:=]\\x20*["']?({_VALUE})"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
#: What a text must hold, in small letters, for ASSIGN to match.
CUES = ("passw", "secret", "token", "apikey", "api_key")
LONG = "[A-Za-z0-9+/_=.-]"
LEAST = 20
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-"
WIDTH = len(ALPHABET) + 1


def samples(seed: int = 11, n: int = 4000) -> tuple[list[str], list[str]]:
    """Labelled samples: random strings, and ordinary identifiers, paths and long words."""
    rng = random.Random(seed)
    kinds = ["0123456789abcdef", ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "_-", ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62]]
    noise = ["".join(rng.choice(k) for _ in range(rng.randint(20, 64))) for k in (rng.choice(kinds) for _ in range(n))]
    words = (
        "account action address after agent amount array base batch before block body buffer build cache call change channel check child class clean client close code column command common config connection content context control convert copy count create current data date default delete detail device directory document double driver element email engine entry error event example exception export factory field file filter final find first format frame from function general get group handle header height helper history host image import index info init inner input insert instance integer interface internal item iterator key label language last layout length level library line link list load local location lock log login loop main manager map match max memory merge message method min model module name native network next node null number object offset only open option order output package page panel parameter parent parse path pattern payment performance player point pool position prefix previous print process product profile project property protocol provider public query queue random range rate read record reference region register release remove render report request resource response result return root route row rule sample save scale scan schedule schema scope screen script search section select sequence server service session set setting shared simple size sort source span stack start state static status step storage store stream string style sub submit summary support switch symbol system table target task template test text thread time timeout title tool total trace transaction transfer tree trigger type under unit update upper url user utility valid value vector version view visible wait widget width window word worker write wrapper zone".split()
    )
    syllables = "an ar as ch ció de di do ed en er es ge ha he ie in ing ion it la le li lo ly ment mi nd ne no on or ou ra re ri ro ru se sh st ta te ten th ti tion to tra un ung ver vi wh za".split()

    def identifier() -> str:
        if rng.random() < 0.15:  # a ruler, a leader or a placeholder: a character or two marks over and over
            unit = rng.choice([rng.choice(ALPHABET), rng.choice("+/_=.-") + rng.choice("+/_=.-")])
            return unit * (rng.randint(20, 60) // len(unit)) + rng.choice(["", "", str(rng.randint(1, 400))])
        some = [rng.choice(words) for _ in range(rng.randint(3, 7))]
        style = rng.randrange(8)
        if style == 0:
            return "".join(w.title() for w in some)
        if style == 1:
            return some[0] + "".join(w.title() for w in some[1:])
        if style == 2:
            return "_".join(some).upper()
        if style == 3:
            return "".join(rng.choice(syllables) for _ in range(rng.randint(8, 16))).replace("ó", "o")
        if style == 4:
            return "".join(some)
        return rng.choice("_-./").join(some) + rng.choice(["", "", str(rng.randint(0, 99)), ".html", "/" + str(rng.randint(1900, 2030))])

    return noise, [identifier() for _ in range(n)]


def train(noise: list[str], plain: list[str], smoothing: float = 0.5) -> tuple[list[int], int]:
    """(step ratios by 69 * code + code in thousandths of a bit, threshold of the mean a step).

    The threshold is the one in steps of 50 with the fewest errors on the samples, the larger of
    equals. A code is the character's place in ALPHABET from 1, or 0.
    """

    def steps(texts: list[str]) -> list[list[float]]:
        n = [[smoothing] * WIDTH for _ in range(WIDTH)]
        for t in texts:
            c = [ALPHABET.find(x) + 1 for x in t]
            for a, b in zip(c, c[1:]):
                n[a][b] += 1
        return [[x / sum(row) for x in row] for row in n]

    p, q = steps(noise), steps(plain)
    ratios = [round(1000 * math.log2(p[a][b] / q[a][b])) for a in range(WIDTH) for b in range(WIDTH)]

    def mean(t: str) -> float:
        c = [ALPHABET.find(x) + 1 for x in t]
        return sum(ratios[a * WIDTH + b] for a, b in zip(c, c[1:])) / (len(c) - 1)

    good, bad = [mean(t) for t in noise], [mean(t) for t in plain if len(t) > 1]
    return ratios, min(range(1500, -1, -50), key=lambda t: sum(x < t for x in good) + 4 * sum(x >= t for x in bad))


RATIOS, THRESHOLD = train(*samples())


def places(text: Column, pattern: str, found: Column, least: Column | None = None) -> Column:
    """array<struct<s, e>> of the matches `found`; with `least`, only of those it says true of."""
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    each = F.arrays_zip(pieces.alias("p"), found.alias("m"), (least if least is not None else F.transform(found, lambda x: F.lit(True))).alias("ok"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.when(x["ok"], F.array_append(a["out"], F.struct(s.alias("s"), e.alias("e")))).otherwise(a["out"]).alias("out"))

    none = F.array().cast("array<struct<s:int,e:int>>")
    return F.when(F.size(found) > 0, F.aggregate(each, zero, step, lambda a: a["out"])).otherwise(none)


def mean_ratio(token: Column, ratios: list[int]) -> Column:
    """Sum of the step ratios of `token`, in thousandths of a bit, over its number of steps."""
    codes = F.transform(F.split(token, "", -1), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(ALPHABET), c)))
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.length(token) - 1), F.slice(codes, F.lit(2), F.length(token) - 1), lambda a, b: F.get(F.lit(ratios), a * WIDTH + b))
    return F.aggregate(pairs, F.lit(0), lambda a, x: a + x) / (F.length(token) - 1)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratios: list[int] | None = None, threshold: int | None = None) -> DataFrame:
    """Per row: doc_id and the arrays assign, access, hex and markov of struct<s, e>."""
    ratios, threshold = ratios or RATIOS, THRESHOLD if threshold is None else threshold
    none = F.array().cast("array<string>")
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    small = F.lower("t")
    cue = small.contains(CUES[0])
    for c in CUES[1:]:
        cue = cue | small.contains(c)
    all_of = lambda pattern, group=0: F.regexp_extract_all("t", F.lit(pattern), F.lit(group))
    alone = f"(?<!{LONG}){LONG}{{{LEAST},}}"
    t = t.withColumn("cue", cue)
    t = t.withColumns({"m_assign": F.when(F.col("cue"), all_of(ASSIGN)).otherwise(none), "v_assign": F.when(F.col("cue"), all_of(ASSIGN, 2)).otherwise(none), "m_access": F.when(F.col("t").contains("AKIA"), all_of(ACCESS)).otherwise(none), "m_hex": all_of(HEX), "m_long": all_of(alone)})
    t = t.select(
        "doc_id",
        places(F.col("t"), ASSIGN, F.col("m_assign"), F.transform("v_assign", lambda v: F.length(v) >= 12)).alias("assign"),
        places(F.col("t"), ACCESS, F.col("m_access")).alias("access"),
        places(F.col("t"), HEX, F.col("m_hex")).alias("hex"),
        places(F.col("t"), alone, F.col("m_long"), F.transform("m_long", lambda m: mean_ratio(m, ratios) >= threshold)).alias("markov"),
    )
    base = F.concat("assign", "access", "hex")
    return t.withColumn("markov", F.filter("markov", lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))))


KINDS = ("assign", "access", "hex", "markov")


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans of `kinds`, by start and then kind in that order, comma-joined."""
    def rows(i: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("i"), F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")).alias("x")))

    return F.array_join(F.transform(F.array_sort(F.concat(*map(rows, range(len(kinds)), kinds))), lambda r: r["x"]), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(listed(KINDS[:3]), 256).alias("base_sha256"), listed(KINDS).alias("spans"))


def _sql() -> str:
    def spans(kind: str, i: int, pattern: str, keep: str) -> str:
        p = pattern.replace("'", "''")
        group = 2 if kind == "assign" else 0
        return f"""SELECT doc_id, {i} AS i, '{kind}' AS kind, p0 AS s, p0 + length(m) AS e FROM (
  SELECT doc_id, m[k] AS m, v[k] AS v, coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS p0
  FROM (SELECT *, unnest(generate_series(1, len(m))) AS k FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS p FROM d))) WHERE {keep}"""

    llr = f"list_sum(list_transform(generate_series(1, length(m) - 1), lambda j: (SELECT r FROM ratios)[instr('{ALPHABET}', m[j]) * {WIDTH} + instr('{ALPHABET}', m[j + 1]) + 1])) / (length(m) - 1) >= {THRESHOLD}"
    llr = llr.replace("(SELECT r FROM ratios)", f"({RATIOS}::INTEGER[])")
    base = " UNION ALL ".join(spans(k, i, p, "length(v) >= 12" if k == "assign" else "true") for i, (k, p) in enumerate((("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({base}),
markov AS (SELECT * FROM ({spans("markov", 3, f"{LONG}{{{LEAST},}}", llr)}) m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = m.doc_id AND b.s < m.e AND m.s < b.e)),
a AS (SELECT *, kind || ':' || s || ':' || e AS x FROM (SELECT * FROM base UNION ALL SELECT * FROM markov)),
g AS (SELECT doc_id, count(*) FILTER (i = 0) AS n0, count(*) FILTER (i = 1) AS n1, count(*) FILTER (i = 2) AS n2, string_agg(x, ',' ORDER BY s, i) FILTER (i < 3) AS b, string_agg(x, ',' ORDER BY s, i) AS x FROM a GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(x, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


ORACLE = _sql()
