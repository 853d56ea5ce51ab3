"""License scanning by ordered signature rules.

Texts are lower-cased in A-Z and cut into words (runs outside BREAKS), joined by one space, so a
rule is a regular expression over spaced words. A text is looked at further only if it holds a cue,
and a rule is tried only on a text that holds the rule's keyword, the plain text its pattern starts
with. Each rule has a label and a priority; a detection that lies inside one of a higher priority,
or inside a longer one of the same priority, is suppressed. The base phrases have the highest
priority and are never suppressed.

Everything is DataFrame operations; no shuffle at all.

Defined results: a null or wordless text has no words and no detections; repeated rows give a row
each; places are word numbers from 0, the end exclusive; the score is the confidence of the best
detection left (0 without one); other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.words import BREAKS, LOWER, UPPER, spaced
from mnemora.sources.tables import table

#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label: patterns, in falling priority by section. Priority 4: license tags; 3: a name with its
#: version or a sentence of the text itself; 2: a name or a short form; 1: a general mention.
TEXTS = """
mit: permission is hereby granted free of charge to any person obtaining a copy of this software
mit: the above copyright notice and this permission notice( including the next paragraph)? shall be included in all
mit-0: mit no attribution
apache-1.0: apache (software )?licen[sc]e version 1 0
apache-1.1: apache (software )?licen[sc]e version 1 1
apache-2.0: apache licen[sc]e( v| version)? ?2( 0)?
apache-2.0: apache software licen[sc]e( v| version)? ?2( 0)?
apache-2.0: apache org licenses license 2 0
apache-2.0: unless required by applicable law or agreed to in writing software distributed under the license
bsd-2-clause: simplified bsd licen[sc]e
bsd-2-clause: bsd 2 clause( licen[sc]e)?
bsd-2-clause: 2 clause bsd licen[sc]e
bsd-3-clause: bsd 3 clause( licen[sc]e)?
bsd-3-clause: 3 clause bsd licen[sc]e
bsd-3-clause: new bsd licen[sc]e
bsd-3-clause: modified bsd licen[sc]e
bsd-3-clause: revised bsd licen[sc]e
bsd-3-clause: neither the name of .{1,120}? nor the names of its contributors may be used
bsd-4-clause: bsd 4 clause( licen[sc]e)?
bsd-4-clause: original bsd licen[sc]e
bsd-4-clause: all advertising materials mentioning features or use of this software must display
bsd: redistributions of source code must retain the above copyright notice
bsd: redistributions in binary form must reproduce the above copyright notice
bsd: redistribution and use in source and binary forms with or without modification are permitted
0bsd: zero clause bsd licen[sc]e
0bsd: bsd zero clause licen[sc]e
isc: permission to use copy modify and or distribute this software for any purpose with or without fee
isc: isc licen[sc]e
gpl-1.0: gnu general public licen[sc]e( as published by the free software foundation)?( either)? version 1
gpl-2.0: gnu general public licen[sc]e( as published by the free software foundation)?( either)? version 2( 0)?
gpl-3.0: gnu general public licen[sc]e( as published by the free software foundation)?( either)? version 3( 0)?
gpl-2.0: gnu general public licen[sc]e v2
gpl-3.0: gnu general public licen[sc]e v3
gpl-1.0: gnu gpl (version |v)1
gpl-2.0: gnu gpl (version |v)2
gpl-3.0: gnu gpl (version |v)3
gpl-2.0: gpl (version |v)2( 0)?
gpl-3.0: gpl (version |v)3( 0)?
gpl-2.0: gplv2
gpl-3.0: gplv3
gpl-2.0: gpl2
gpl-3.0: gpl3
gpl: this program is free software you can redistribute it and or modify it
gpl: you should have received a copy of the gnu general public licen[sc]e
lgpl-2.0: gnu library general public licen[sc]e( as published by the free software foundation)?( either)? version 2( 0)?
lgpl-2.1: gnu lesser general public licen[sc]e( as published by the free software foundation)?( either)? version 2 1
lgpl-3.0: gnu lesser general public licen[sc]e( as published by the free software foundation)?( either)? version 3( 0)?
lgpl-2.1: lgpl (version |v)2 1
lgpl-3.0: lgpl (version |v)3( 0)?
lgpl-2.1: lgplv2 1
lgpl-3.0: lgplv3
lgpl: this library is free software you can redistribute it and or modify it
lgpl: you should have received a copy of the gnu lesser general public licen[sc]e
agpl-1.0: affero general public licen[sc]e version 1
agpl-3.0: gnu affero general public licen[sc]e( as published by the free software foundation)?( either)? version 3( 0)?
agpl-3.0: affero general public licen[sc]e version 3
agpl-3.0: agpl (version |v)3
agpl-3.0: agplv3
agpl: you should have received a copy of the gnu affero general public licen[sc]e
gfdl-1.1: gnu free documentation licen[sc]e version 1 1
gfdl-1.2: gnu free documentation licen[sc]e version 1 2
gfdl-1.3: gnu free documentation licen[sc]e version 1 3
mpl-1.0: mozilla public licen[sc]e( v| version)? ?1 0
mpl-1.1: mozilla public licen[sc]e( v| version)? ?1 1
mpl-2.0: mozilla public licen[sc]e( v| version)? ?2( 0)?
mpl-2.0: this source code form is subject to the terms of the mozilla public licen[sc]e
mpl-1.1: mpl (version |v)?1 1
mpl-2.0: mpl (version |v)?2 0
epl-1.0: eclipse public licen[sc]e( v| version)? ?1( 0)?
epl-2.0: eclipse public licen[sc]e( v| version)? ?2( 0)?
epl-1.0: epl (version |v)?1 0
epl-2.0: epl (version |v)?2 0
edl-1.0: eclipse distribution licen[sc]e( v| version)? ?1 0
cddl-1.0: common development and distribution licen[sc]e( v| version)? ?1 0
cddl-1.1: common development and distribution licen[sc]e( v| version)? ?1 1
cpl-1.0: common public licen[sc]e( v| version)? ?1 0
ipl-1.0: ibm public licen[sc]e( v| version)? ?1 0
eupl-1.1: european union public licen[sc]e( v| version)? ?1 1
eupl-1.2: european union public licen[sc]e( v| version)? ?1 2
eupl-1.1: eupl (version |v)?1 1
eupl-1.2: eupl (version |v)?1 2
artistic-1.0: artistic licen[sc]e( version)? 1 0
artistic-2.0: artistic licen[sc]e( version)? 2 0
afl-2.1: academic free licen[sc]e( v| version)? ?2 1
afl-3.0: academic free licen[sc]e( v| version)? ?3 0
osl-2.1: open software licen[sc]e( v| version)? ?2 1
osl-3.0: open software licen[sc]e( v| version)? ?3 0
apsl-1.0: apple public source licen[sc]e( v| version)? ?1 0
apsl-2.0: apple public source licen[sc]e( v| version)? ?2 0
bsl-1.0: boost software licen[sc]e( version)? 1 0
bsl-1.0: permission is hereby granted free of charge to any person or organization obtaining a copy of the software
busl-1.1: business source licen[sc]e( version)? 1 1
sspl-1.0: server side public licen[sc]e( v| version)? ?1
elastic-2.0: elastic licen[sc]e( v| version)? ?2( 0)?
python-2.0: python software foundation licen[sc]e( v| version)? ?2
php-3.0: php licen[sc]e( v| version)? ?3 0
php-3.01: php licen[sc]e( v| version)? ?3 01
zpl-2.0: zope public licen[sc]e( v| version)? ?2 0
zpl-2.1: zope public licen[sc]e( v| version)? ?2 1
ofl-1.0: sil open font licen[sc]e( v| version)? ?1 0
ofl-1.1: sil open font licen[sc]e( v| version)? ?1 1
lppl-1.3c: latex project public licen[sc]e( v| version)? ?1 3c?
cecill-2.0: cecill (version |v)?2 0
cecill-2.1: cecill (version |v)?2 1
mulan-2.0: mulan permissive software licen[sc]e( v| version)? ?2
ms-pl: microsoft public licen[sc]e
ms-rl: microsoft reciprocal licen[sc]e
ncsa: university of illinois ncsa open source licen[sc]e
unlicense: this is free and unencumbered software released into the public domain
wtfpl: do what the fuck you want to public licen[sc]e
zlib: this software is provided as is without any express or implied warranty in no event will the authors
zlib: altered source versions must be plainly marked as such
beerware: beer ware licen[sc]e
cc0-1.0: cc0 1 0( universal)?
cc0-1.0: creative commons zero( v1 0| 1 0)?
cc-by-1.0: creative commons attribution 1 0
cc-by-2.0: creative commons attribution 2 0
cc-by-2.5: creative commons attribution 2 5
cc-by-3.0: creative commons attribution 3 0
cc-by-4.0: creative commons attribution 4 0
cc-by-sa-2.0: creative commons attribution share ?alike 2 0
cc-by-sa-2.5: creative commons attribution share ?alike 2 5
cc-by-sa-3.0: creative commons attribution share ?alike 3 0
cc-by-sa-4.0: creative commons attribution share ?alike 4 0
cc-by-nd-3.0: creative commons attribution no ?deriv(ative)?s 3 0
cc-by-nd-4.0: creative commons attribution no ?deriv(ative)?s 4 0
cc-by-nc-2.0: creative commons attribution non ?commercial 2 0
cc-by-nc-3.0: creative commons attribution non ?commercial 3 0
cc-by-nc-4.0: creative commons attribution non ?commercial 4 0
cc-by-nc-sa-3.0: creative commons attribution non ?commercial share ?alike 3 0
cc-by-nc-sa-4.0: creative commons attribution non ?commercial share ?alike 4 0
cc-by-nc-nd-3.0: creative commons attribution non ?commercial no ?deriv(ative)?s 3 0
cc-by-nc-nd-4.0: creative commons attribution non ?commercial no ?deriv(ative)?s 4 0
cc-by-4.0: cc by 4 0
cc-by-3.0: cc by 3 0
cc-by-sa-4.0: cc by sa 4 0
cc-by-sa-3.0: cc by sa 3 0
cc-by-nd-4.0: cc by nd 4 0
cc-by-nc-4.0: cc by nc 4 0
cc-by-nc-3.0: cc by nc 3 0
cc-by-nc-sa-4.0: cc by nc sa 4 0
cc-by-nc-sa-3.0: cc by nc sa 3 0
cc-by-nc-nd-4.0: cc by nc nd 4 0
cc-by-4.0: creativecommons org licenses by 4 0
cc-by-3.0: creativecommons org licenses by 3 0
cc-by-sa-4.0: creativecommons org licenses by sa 4 0
cc-by-sa-3.0: creativecommons org licenses by sa 3 0
cc-by-nc-4.0: creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0: creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0: creativecommons org licenses by nc nd 4 0
cc-by-nd-4.0: creativecommons org licenses by nd 4 0
cc0-1.0: creativecommons org publicdomain zero 1 0
odbl-1.0: open database licen[sc]e( v| version)? ?1 0
odc-by-1.0: open data commons attribution licen[sc]e( v| version)? ?1 0
pddl-1.0: public domain dedication and licen[sc]e
"""
NAMES = """
mit: mit licen[sc]e
mit: licensed under( the)? mit
mit: opensource org licenses mit
apache: apache licen[sc]e
apache: apache software licen[sc]e
apache: licensed under( the)? apache
bsd: bsd licen[sc]e
bsd: bsd style licen[sc]e
bsd: licensed under( the)? bsd
gpl: gnu general public licen[sc]e
gpl: gnu gpl
gpl: gpl licen[sc]e
gpl: licensed under( the)? gpl
gpl: gnu org licenses gpl
gpl: general public licen[sc]e
lgpl: gnu lesser general public licen[sc]e
lgpl: gnu library general public licen[sc]e
lgpl: gnu lgpl
lgpl: licensed under( the)? lgpl
lgpl: gnu org licenses lgpl
agpl: gnu affero general public licen[sc]e
agpl: affero general public licen[sc]e
agpl: gnu agpl
agpl: licensed under( the)? agpl
gfdl: gnu free documentation licen[sc]e
gfdl: gnu fdl
mpl: mozilla public licen[sc]e
mpl: mozilla org mpl
epl: eclipse public licen[sc]e
epl: eclipse org legal epl
cddl: common development and distribution licen[sc]e
cpl: common public licen[sc]e
eupl: european union public licen[sc]e
artistic: artistic licen[sc]e
afl: academic free licen[sc]e
osl: open software licen[sc]e
apsl: apple public source licen[sc]e
bsl: boost software licen[sc]e
bsl: boost org license
busl: business source licen[sc]e
sspl: server side public licen[sc]e
elastic: elastic licen[sc]e
psf: python software foundation licen[sc]e
php: php licen[sc]e
ruby: ruby licen[sc]e
zpl: zope public licen[sc]e
w3c: w3c software (notice and )?licen[sc]e
ofl: open font licen[sc]e
lppl: latex project public licen[sc]e
openssl: openssl licen[sc]e
curl: curl licen[sc]e
postgresql: postgresql licen[sc]e
unicode: unicode licen[sc]e
vim: vim licen[sc]e
x11: x11 licen[sc]e
zlib: zlib licen[sc]e
libpng: libpng licen[sc]e
wtfpl: wtfpl
unlicense: unlicense
json: json licen[sc]e
ncsa: ncsa licen[sc]e
nasa: nasa open source agreement
sleepycat: sleepycat licen[sc]e
mulan: mulan permissive software licen[sc]e
odbl: open database licen[sc]e
odc: open data commons
cc0: creativecommons org publicdomain
cc0: cc0
cc-by: creative commons attribution
cc-by-sa: creative commons attribution share ?alike
cc-by-nd: creative commons attribution no ?deriv(ative)?s
cc-by-nc: creative commons attribution non ?commercial
cc-by-nc-sa: creative commons attribution non ?commercial share ?alike
cc-by-nc-nd: creative commons attribution non ?commercial no ?deriv(ative)?s
cc-by-sa: cc by sa
cc-by-nd: cc by nd
cc-by-nc: cc by nc
cc-by-nc-sa: cc by nc sa
cc-by-nc-nd: cc by nc nd
"""
MENTIONS = """
creative-commons: creative commons licen[sc]e
creative-commons: creativecommons org
public-domain: released into the public domain
public-domain: public domain
all-rights-reserved: copyright .{0,80}?all rights reserved
proprietary: proprietary and confidential
permissive: permission is hereby granted
copyright: copyright [0-9]{4}
license-mention: licensed under
license-mention: released under
license-mention: distributed under
license-mention: license agreement
no-warranty: without warranty of any kind
no-warranty: without any warranty
"""
#: Words that a text must hold one of for any rule to match.
CUES = ("licen", "copyright", "cc by", "cc0", "gnu", "gpl", "bsd", "mpl ", "epl ", "eupl ", "cecill", "commons", "public domain", "publicdomain", "warranty", "redistribut", "permission", "mit no attribution", "mozilla org", "eclipse org", "boost org", "open source agreement", "altered source", "wtfpl", "all advertising", "neither the name of", "proprietary and", "released under", "distributed under", "unencumbered")


def rules() -> list[dict]:
    """All rules in order: label, priority, confidence, kw (plain text that any match holds) and pattern."""
    found = [{"label": label, "priority": 5, "confidence": 1.0, "pattern": phrase} for phrase, label in BASE]
    tags = sorted({line.split(": ")[0] for line in TEXTS.split("\n") if line})
    for label in tags:  # each license's tag, with its version's points as blanks
        found.append({"label": label, "priority": 4, "confidence": 0.99, "pattern": "spdx license identifier " + re.sub(r"[-.]", " ", label) + "( only| or later)?"})
    for priority, confidence, section in ((3, 0.95, TEXTS), (2, 0.8, NAMES), (1, 0.4, MENTIONS)):
        for line in section.split("\n"):
            if line:
                label, pattern = line.split(": ", 1)
                found.append({"label": label, "priority": priority, "confidence": confidence, "pattern": pattern})
    for i, r in enumerate(found):
        plain = re.match(r"[a-z0-9 ]*", r["pattern"])[0]
        rest = r["pattern"][len(plain) :]
        r |= {"kw": plain[:-1] if rest[:1] in ("?", "*") else plain, "base": r["priority"] == 5, "nr": i}
    return found


RULES = rules()


def _blanks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def detections(text: Column) -> Column:
    """array<struct<s, e, priority, nr, label, confidence, base>> in the spaced `text`, by start, then longest first."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    table_ = F.array(*[F.struct(F.lit(r["kw"]).alias("kw"), F.lit(f"(?<= ){r['pattern']}(?= )").alias("pattern"), F.lit(r["label"]).alias("label"), F.lit(r["priority"]).alias("priority"), F.lit(r["confidence"]).alias("confidence"), F.lit(r["base"]).alias("base"), F.lit(r["nr"]).alias("nr")) for r in RULES])
    kind = "array<struct<s:int,to:int,priority:int,nr:int,e:int,label:string,confidence:double,base:boolean>>"

    def places(r: Column) -> Column:
        found = F.regexp_extract_all(padded, r["pattern"], F.lit(0))
        pieces = F.slice(F.split(padded, r["pattern"], -1), F.lit(1), F.size(found))
        zero = F.struct(F.lit(-1).alias("at"), F.array().cast(kind).alias("out"))

        def step(a: Column, x: Column) -> Column:
            s = a["at"] + _blanks(x["p"])
            n = _blanks(x["m"])
            new = F.struct(s.alias("s"), (-(s + n + 1)).alias("to"), (-r["priority"]).alias("priority"), r["nr"].alias("nr"), (s + n + 1).alias("e"), r["label"].alias("label"), r["confidence"].alias("confidence"), r["base"].alias("base"))
            return F.struct((s + n).alias("at"), F.array_append(a["out"], new).alias("out"))

        return F.when(F.size(found) > 0, F.aggregate(F.arrays_zip(pieces.alias("p"), found.alias("m")), zero, step, lambda a: a["out"])).otherwise(F.array().cast(kind))

    gated = F.filter(table_, lambda r: padded.contains(r["kw"]))
    cue = text.contains(CUES[0])
    for c in CUES[1:]:
        cue = cue | padded.contains(c)
    return F.when(cue, F.array_sort(F.flatten(F.transform(gated, places)))).otherwise(F.array().cast(kind))


def kept(found: str) -> Column:
    """The detections that aren't suppressed.

    In the order of `detections` what holds a detection comes before it, so one pass suffices: it
    keeps, for each priority, how far the detections seen so far reach.
    """
    reach = F.array(*[F.lit(-1)] * 6)
    zero = F.struct(reach.alias("to"), F.slice(F.col(found), F.lit(1), F.lit(0)).alias("out"))

    def step(a: Column, x: Column) -> Column:
        own = -x["priority"]
        above = F.array_max(F.slice(a["to"], own + 1, F.lit(6)))
        to = F.transform(a["to"], lambda v, i: F.when(i == own, F.greatest(v, x["e"])).otherwise(v))
        return F.struct(to.alias("to"), F.when(~x["base"] & (above >= x["e"]), a["out"]).otherwise(F.array_append(a["out"], x)).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(found, zero, step, lambda a: a["out"])).otherwise(F.col(found))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words and the detections kept."""
    sp = docs.select(F.col(id_col).alias("doc_id"), spaced(F.col(text_col)).alias("sp"))
    n = F.when(F.col("sp") == "", F.lit(0)).otherwise(_blanks(F.col("sp")) + 1)
    return sp.select("doc_id", n.cast("long").alias("n_words"), detections(F.col("sp")).alias("found")).withColumn("found", kept("found"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents")).withColumn("b", F.filter("found", lambda x: x["base"]))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    starts = F.transform("b", lambda x: x["s"].cast("long"))
    return found.select("doc_id", "n_words", F.size("b").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels("b").alias("base_labels"), labels("found").alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda x: x["confidence"])), F.lit(0.0)).alias("score"))


def _sql() -> str:
    """Words stand between two blanks each, so that matches next to each other don't share one."""
    rows = ", ".join(f"('{r['kw']}', '{' ' + r['pattern'].replace(' ', '  ') + ' '}', '{r['label']}', {r['priority']}, {r['confidence']}::DOUBLE, {str(r['base']).lower()}, {r['nr']})" for r in RULES)
    blanks = "(length({0}) - length(replace({0}, ' ', ''))) // 2"
    return f"""
WITH rules(kw, pattern, label, priority, confidence, base, nr) AS (VALUES {rows}),
d AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAKS}', ' ', 'g')) AS sp FROM documents),
x AS (SELECT doc_id, ' ' || replace(' ' || sp || ' ', ' ', '  ') AS t, rules.* FROM d JOIN rules ON contains(' ' || sp || ' ', kw)),
m AS (SELECT *, regexp_extract_all(t, pattern) AS m, string_split_regex(t, pattern) AS p FROM x),
k AS (SELECT *, unnest(generate_series(1, len(m))) AS k FROM m WHERE len(m) > 0),
f AS (SELECT doc_id, label, priority, confidence, base, nr, {blanks.format("b")} AS s, {blanks.format("trim(m[k])")} AS n
      FROM (SELECT *, array_to_string(list_transform(generate_series(1, k), lambda j: p[j] || CASE WHEN j < k THEN m[j] ELSE ' ' END), '') AS b FROM k)),
g AS (SELECT doc_id, label, priority, confidence, base, nr, s - 1 AS s, s + n AS e FROM f),
o AS (SELECT * FROM g a WHERE base OR NOT EXISTS (SELECT 1 FROM g b WHERE b.doc_id = a.doc_id AND b.s <= a.s AND b.e >= a.e AND (b.priority > a.priority OR b.priority = a.priority AND (b.e - b.s > a.e - a.s OR b.e - b.s = a.e - a.s AND b.nr < a.nr)))),
r AS (SELECT doc_id, count(*) FILTER (base) AS n, min(s) FILTER (base) AS a, max(s) FILTER (base) AS z, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) AS l, max(confidence) AS c FROM o GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN sp = '' THEN 0 ELSE length(sp) - length(replace(sp, ' ', '')) + 1 END AS n_words, coalesce(n, 0) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word, coalesce(bl, '') AS base_labels, coalesce(l, '') AS labels, coalesce(c, 0) AS score
FROM d LEFT JOIN r USING (doc_id)
"""


ORACLE = _sql()
