"""License scans by sentence rules; DataFrame functions only, one pass over the rows and no shuffle.

A text is normalised: ASCII lower case; runs of anything but letters a-z and digits become one space, so comment marks
go. Blank lines and . ! ? before white space are hard borders; single line ends and ; : before white space are soft
ones. A known sentence begins and ends at borders of either kind and may run over soft ones, as in wrapped text; the
longest sentence from a border counts. Known are sentences of the licences' own texts, references to a licence by one
of its names, and SPDX identifiers. What is between them is unknown; copyright lines and single words, such as the
numbers of a list, are passed over. The sequence of identifiers is then matched against the ordered rules: a rule
names a licence by a run of neighbouring identifiers, with nothing unknown between them, and what it matches is used
up, so a later, shorter rule sees only the rest. Sentences that tell no licence are recognised and passed over.

The SQL cuts at every border and so finds no sentence that runs over one; without such sentences both agree.

Null and empty texts have no sentence and no licence. Every row gives one result; repeated rows repeat it. Columns of
the result replace input columns of the same names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.llm.common import table, tune

# Sentences of licences' own texts, normalised, by identifier.
SENTENCES: dict[str, list[str]] = {
    "MITgrant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MITnotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"],
    "MITwarranty": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "MITliable": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "Apache2ref": ["licensed under the apache license version 2 0 the license"],
    "Apache2comply": ["you may not use this file except in compliance with the license"],
    "Apache2copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "Apache2url": ["http www apache org licenses license 2 0", "https www apache org licenses license 2 0"],
    "Apache2warranty": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "Apache2see": ["see the license for the specific language governing permissions and limitations under the license"],
    "Apache2title": ["apache license version 2 0 january 2004 http www apache org licenses"],
    "Apache2grant": ["subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"],
    "BSDcond": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BSDsource": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BSDbinary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BSDads": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "BSDendorse": [f"neither the name of the {who} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission" for who in ("copyright holder", "copyright holders", "author", "organization", "university")],
    "BSDdisclaim": [f"this software is provided by the {who} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed" for who in ("copyright holders and contributors", "copyright holder and contributors", "authors", "author", "regents and contributors")],
    "BSDliable": [f"in no event shall the {who} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage" for who in ("copyright holder or contributors", "copyright owner or contributors", "copyright holders or contributors", "authors", "author", "regents or contributors")],
    "ISCgrant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "0BSDgrant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "ISCwarranty": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "ZLIBwarranty": ["this software is provided as is without any express or implied warranty"],
    "ZLIBgrant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "BOOSTgrant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "UNLICENSEfree": ["this is free and unencumbered software released into the public domain"],
    "UNLICENSEany": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "WTFPLverbatim": ["everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"],
    "MPL2subject": ["this source code form is subject to the terms of the mozilla public license v", "this source code form is subject to the terms of the mozilla public license version 2 0"],
    "MPL2version": ["2 0"],
    "MPL2copy": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"],
    "EPL2made": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which accompanies this distribution"],
    "EPL1made": ["this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10"],
    "CDDLsubject": ["the contents of this file are subject to the terms of the common development and distribution license the license"],
    "CC0waive": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work"],
    "CC0ref": ["dedicated to the public domain under a cc0 1 0 license"],
    "GNUverbatim": ["everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"],
    "GNUifnot": ["if not see http www gnu org licenses", "if not see https www gnu org licenses", "if not write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa", "if not write to the free software foundation inc 59 temple place suite 330 boston ma 02111 1307 usa"],
    "Reserved": ["all rights reserved", "all rights reserved under copyright", "copyright all rights reserved"],
    "Confidential": ["this document is confidential and proprietary", "proprietary and confidential", "unauthorized copying of this file via any medium is strictly prohibited", "unauthorized copying of this file is strictly prohibited"],
}

# The GNU licences' names, versions and marks.
GNU = {"": "gnu general public license", "Lesser": "gnu lesser general public license", "Library": "gnu library general public license", "Affero": "gnu affero general public license"}
GNU_VERSIONS = [("GPL", "", "2"), ("GPL", "", "3"), ("LGPL", "Library", "2"), ("LGPL", "Lesser", "2 1"), ("LGPL", "Lesser", "3"), ("AGPL", "Affero", "3")]
# sentences of notices by what they call the work: the rule of them is one for all GNU licences
for _work in ("program", "library", "software", "file", "project"):
    for _mark, _kind, _version in GNU_VERSIONS:
        _id, _free = f"{_mark}{_version.replace(' ', '.')}", f"this {_work} is free software you can redistribute it and or modify it under the terms of the {GNU[_kind]} as published by the free software foundation"
        SENTENCES.setdefault(f"{_id}later", []).extend([f"{_free} either version {_version} of the license or at your option any later version", f"{_free} either version {_version} of the license or any later version"])
        SENTENCES.setdefault(f"{_id}only", []).extend([f"{_free} version {_version} of the license", f"{_free} version {_version}"])
        for _key, _text in (("see", f"see the {GNU[_kind]} for more details"), ("copy", f"you should have received a copy of the {GNU[_kind]} along with this {_work}")):
            if _text not in SENTENCES.setdefault(f"GNU{_key}", []):
                SENTENCES[f"GNU{_key}"].append(_text)
    _hope = f"this {_work} is distributed in the hope that it will be useful but without any warranty"
    SENTENCES.setdefault("GNUwarranty", []).extend([_hope, f"{_hope} without even the implied warranty of merchantability or fitness for a particular purpose"])

#: Recognised sentences that tell no licence: rules pass over them.
NEUTRAL = ["MITliable", "Apache2url", "BSDdisclaim", "BSDliable", "ISCwarranty", "MPL2version", "GNUverbatim", "GNUifnot", "GNUsee", "GNUcopy", "GNUwarranty"]

# Names by which texts refer to licences, normalised, by SPDX identifier.
NAMES: dict[str, list[str]] = {
    "MIT": ["mit license", "mit licence", "expat license", "mit"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache license v2 0", "apache 2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause simplified license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause new or revised license"],
    "MPL-2.0": ["mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v2 0", "mpl 2 0"],
    "MPL-1.1": ["mozilla public license 1 1", "mozilla public license version 1 1"],
    "EPL-1.0": ["eclipse public license 1 0", "eclipse public license v1 0", "eclipse public license version 1 0"],
    "EPL-2.0": ["eclipse public license 2 0", "eclipse public license v2 0", "eclipse public license version 2 0"],
    "CDDL-1.0": ["common development and distribution license 1 0", "common development and distribution license version 1 0"],
    "ISC": ["isc license"],
    "Zlib": ["zlib license", "zlib libpng license"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0"],
    "Unlicense": ["unlicense", "unlicence"],
    "WTFPL": ["wtfpl", "do what the fuck you want to public license"],
    "Artistic-2.0": ["artistic license 2 0"],
    "OFL-1.1": ["sil open font license version 1 1", "sil open font license 1 1"],
    "MS-PL": ["microsoft public license"],
    "PostgreSQL": ["postgresql license"],
    "CC0-1.0": ["cc0 1 0 license", "cc0 1 0 universal", "cc0 1 0", "creative commons zero v1 0 universal license", "creative commons cc0 1 0 universal public domain dedication"],
}
for _mark, _kind, _version in GNU_VERSIONS:
    _spdx = f"{_mark}-{_version.replace(' ', '.')}{'' if ' ' in _version else '.0'}"
    for _tail, _only in (("", "-only"), (" or later", "-or-later"), (" or any later version", "-or-later"), (" only", "-only")):
        _short = _mark.lower()
        NAMES.setdefault(_spdx + _only, []).extend(
            f"{name}{_tail}" for name in (f"{GNU[_kind]} version {_version}", f"{GNU[_kind]} v{_version}", f"{GNU[_kind]} {_version}", f"gnu {_short} version {_version}", f"gnu {_short} v{_version}", f"{_short} v{_version}", f"{_short}v{_version}", f"{_short} {_version} 0")
        )
# Creative Commons: words and letters of the parts, for each version
for _letters, _words in {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}.items():
    for _version in ("2 0", "2 5", "3 0", "4 0"):
        _cc = "cc " + _letters.lower().replace("-", " ") + " " + _version
        NAMES[f"CC-{_letters}-{_version.replace(' ', '.')}"] = [_cc, f"{_cc} license", f"creative commons {_words} {_version} international license", f"creative commons {_words} {_version} license", f"creative commons {_words} {_version} unported license", f"creative commons {_words} license version {_version}"]

# Ordered rules, (licence, run of identifiers); longer runs come before their parts.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["title-MIT", "MITgrant", "MITnotice", "MITwarranty"]),
    ("MIT", ["MITgrant", "MITnotice", "MITwarranty"]),
    ("MIT", ["title-MIT", "MITgrant", "MITnotice"]),
    ("MIT", ["MITgrant", "MITnotice"]),
    ("MIT-0", ["MITgrant", "MITwarranty"]),
    ("Apache-2.0", ["Apache2ref", "Apache2comply", "Apache2copy", "Apache2warranty", "Apache2see"]),
    ("Apache-2.0", ["ref-Apache-2.0", "Apache2comply", "Apache2copy", "Apache2warranty", "Apache2see"]),
    ("Apache-2.0", ["Apache2ref", "Apache2comply"]),
    ("Apache-2.0", ["Apache2title"]),
    ("Apache-2.0", ["Apache2grant"]),
    ("BSD-4-Clause", ["BSDcond", "BSDsource", "BSDbinary", "BSDads"]),
    ("BSD-3-Clause", ["Reserved", "BSDcond", "BSDsource", "BSDbinary", "BSDendorse"]),
    ("BSD-3-Clause", ["BSDcond", "BSDsource", "BSDbinary", "BSDendorse"]),
    ("BSD-2-Clause", ["Reserved", "BSDcond", "BSDsource", "BSDbinary"]),
    ("BSD-2-Clause", ["BSDcond", "BSDsource", "BSDbinary"]),
    ("ISC", ["ISCgrant"]),
    ("0BSD", ["0BSDgrant"]),
    ("Zlib", ["ZLIBwarranty", "ZLIBgrant"]),
    ("Zlib", ["ZLIBgrant"]),
    ("BSL-1.0", ["BOOSTgrant"]),
    ("Unlicense", ["UNLICENSEfree", "UNLICENSEany"]),
    ("Unlicense", ["UNLICENSEfree"]),
    ("WTFPL", ["WTFPLverbatim"]),
    ("MPL-2.0", ["MPL2subject", "MPL2copy"]),
    ("MPL-2.0", ["MPL2subject"]),
    ("EPL-2.0", ["EPL2made"]),
    ("EPL-1.0", ["EPL1made"]),
    ("CDDL-1.0", ["CDDLsubject"]),
    ("CC0-1.0", ["CC0waive"]),
    ("CC0-1.0", ["CC0ref"]),
    ("Apache-2.0", ["Apache2ref"]),
]
# a notice, a reference and an SPDX identifier name a licence alone
for _mark, _kind, _version in GNU_VERSIONS:
    _spdx = f"{_mark}-{_version.replace(' ', '.')}{'' if ' ' in _version else '.0'}"
    RULES += [(f"{_spdx}-or-later", [f"{_mark}{_version.replace(' ', '.')}later"]), (f"{_spdx}-only", [f"{_mark}{_version.replace(' ', '.')}only"])]
RULES += [(k, [f"{kind}-{k}"]) for k in NAMES for kind in ("ref", "spdx")] + [("Proprietary", ["Reserved"]), ("Proprietary", ["Confidential"])]

KNOWN = {s: k for k, all_of in SENTENCES.items() for s in all_of}
NAMED = {n: k for k, all_of in NAMES.items() for n in all_of}
# How a sentence refers to a licence by its name, and an SPDX line to its identifier.
SUBJECT = "(?:(?:this|the) (?:work|project|software|file|program|document|content|code|library|package|text|source code) is )?"
SAID = f"({SUBJECT}(?:dual )?(?:licensed|licenced|released|distributed|available|provided|made available|published) under (?:the terms of )?)?(?:the |a |an )?"
SPDX = "spdx license identifier "
IDENTIFIERS = {k.lower().replace("-", " ").replace(".", " "): k for k in NAMES}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Each telling sentence holds one of these; a text without them needs no cutting.
MARKS = [r"(?:d|available)\s+under\s", "licen", "permi", "warrant", "copyright", "redistribut", "reserved", "proprietary", "public domain", "waived"]
#: In order: what is replaced and by what. Capitals stand for borders, H for hard and S for soft ones.
BORDERS = [(r"\r\n?", "\n"), (r"[.!?](?=\s|$)", "H"), (r"[;:](?:[ \t\f]*\n|(?=\s|$))|\n", "S"), (r"[^a-z0-9HS]+", " "), (r" ?([HS]) ?", "$1"), (r"SS+", "H"), (r"^ | $", "")]
#: Pieces that are passed over: single words, and copyright lines.
OVER = r"^(?:copyright .*|c [0-9]{4}.*|[^ ]*)$"


def _any(texts) -> str:
    return "|".join(sorted(texts, key=len, reverse=True))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


REFERENCE, IDENTIFIER = f"{SAID}({_any(NAMED)})", f"{SPDX}({_any(IDENTIFIERS)})"


def identifier(sentence: Column) -> Column:
    """The identifier of a normalised known sentence; null for a name of one word alone, which is a word like any."""
    part = lambda pattern, n: F.regexp_extract(sentence, f"^{pattern}$", n)
    named = F.try_element_at(_map(NAMED), part(REFERENCE, 2))
    listed = F.try_element_at(_map(IDENTIFIERS), part(IDENTIFIER, 1))
    return F.coalesce(F.try_element_at(_map(KNOWN), sentence), F.concat(F.when(part(REFERENCE, 1) != "", "ref-").when(F.contains(sentence, F.lit(" ")), "title-"), named), F.concat(F.lit("spdx-"), listed))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order; ? stands for what is unknown between them."""
    low = F.translate(text, UPPER, LOWER)
    bordered = low
    for what, by in BORDERS:
        bordered = F.regexp_replace(bordered, what, by)
    over = f"{_any(KNOWN)}|{REFERENCE}|{IDENTIFIER}".replace(" ", "[ S]")
    marked = F.regexp_replace(bordered, f"(?<=^|[HS])(?:{over})(?=$|[HS])", "<$0>")
    pieces = F.filter(F.regexp_extract_all(marked, F.lit("<[^>]*>|[^<>HS]+"), F.lit(0)), lambda p: p.startswith("<") | ~p.rlike(OVER))
    found = F.transform(pieces, lambda p: F.when(p.startswith("<"), identifier(F.translate(F.replace(p, F.lit("S"), F.lit(" ")), "<>", ""))).otherwise("?"))
    return F.when(low.rlike("|".join(MARKS)) & F.contains(marked, F.lit("<")), F.array_compact(found)).otherwise(F.array().cast("array<string>"))


def matched(ids: Column, rules: list[tuple[str, list[str]]] | None = None) -> Column:
    """(licenses, rest): the licences in the order of the rules that name them, and identifiers no rule used."""
    listed = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{k}>" for k in run)).alias("run")) for name, run in rules or RULES])
    told = F.filter(ids, lambda k: ~k.isin(NEUTRAL))
    start = F.struct(F.concat(F.lit("<"), F.array_join(told, "><"), F.lit(">")).alias("rest"), F.array().cast("array<string>").alias("licenses"))

    def step(state: Column, rule: Column) -> Column:
        return F.when(
            F.contains(state["rest"], rule["run"]),
            F.struct(F.replace(state["rest"], rule["run"], F.lit("<>")).alias("rest"), F.array_union(state["licenses"], F.array(rule["name"])).alias("licenses")),
        ).otherwise(state)

    return F.when(F.size(ids) > 0, F.aggregate(listed, start, step)).otherwise(F.struct(F.lit("").alias("rest"), F.array().cast("array<string>").alias("licenses")))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with sentence_ids, licenses and rest_ids (telling sentences that no rule uses)."""
    tune(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("sentence_ids", "licenses", "rest_ids")]
    kept = F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")
    out = docs.select(kept, sentence_ids(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("__ids"))
    out = out.withColumn("__m", matched(F.col("__ids")))
    listed = lambda x: F.filter(x, lambda k: ~k.isin("", "?"))
    made = [listed(F.col("__ids")).alias("sentence_ids"), F.col("__m.licenses").alias("licenses"), listed(F.split(F.col("__m.rest"), "[<>]+")).alias("rest_ids")]
    return out.select(*[F.col("__row")[c].alias(c) for c in names], *made)


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    """Licences of every whole text of documents."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_known"),
        F.array_join("sentence_ids", ",").alias("sentences"),
        F.array_join("licenses", ",").alias("licenses"),
        F.array_join("rest_ids", ",").alias("unused"),
    )


def oracle() -> str:
    """The same scan as DuckDB SQL: a join with the known sentences, then one step a rule."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = lambda pairs: ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in pairs.items())
    low = "translate(replace(coalesce(text, ''), chr(13), chr(10)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps, last = [], "m"
    for n, (name, run) in enumerate(RULES):
        text = quoted("".join(f"<{k}>" for k in run))
        steps.append(f"WHEN {n} THEN CASE WHEN contains(a.rest, {text}) THEN {{'rest': replace(a.rest, {text}, '<>'), 'lic': CASE WHEN list_contains(a.lic, {quoted(name)}) THEN a.lic ELSE list_append(a.lic, {quoted(name)}) END}} ELSE a END")
    neutral = ", ".join(map(quoted, NEUTRAL))
    return f"""
WITH known(sentence, id) AS (VALUES {values(KNOWN)}), named(name, spdx) AS (VALUES {values(NAMED)}), listed(name, spdx) AS (VALUES {values(IDENTIFIERS)}),
d AS (SELECT doc_id, row_number() OVER () AS row, regexp_matches({low}, '{"|".join(MARKS)}') AS marked, string_split(regexp_replace(regexp_replace({low}, '([.!?;:])[ \\t\\r\\f]+', E'\\\\1\\n', 'g'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)) AS lines FROM documents),
e AS (SELECT row, trim(unnest(lines)) AS line, generate_subscripts(lines, 1) AS n FROM d WHERE marked),
f AS (SELECT row, n, line, coalesce(known.id, CASE WHEN regexp_extract(line, '^{REFERENCE}$', 1) <> '' THEN 'ref-' WHEN contains(line, ' ') THEN 'title-' END || named.spdx, 'spdx-' || listed.spdx) AS id
  FROM e LEFT JOIN known ON line = known.sentence LEFT JOIN named ON named.name = regexp_extract(line, '^{REFERENCE}$', 2) LEFT JOIN listed ON listed.name = regexp_extract(line, '^{IDENTIFIER}$', 1)),
g AS (SELECT row, n, coalesce(id, '?') AS id FROM f WHERE id IS NOT NULL OR NOT regexp_matches(line, '{OVER}')),
j AS (SELECT row, list(id ORDER BY n) AS ids FROM g GROUP BY row HAVING bool_or(id <> '?')),
m AS (SELECT d.doc_id, coalesce(j.ids, []) AS ids, coalesce('<' || array_to_string(list_filter(j.ids, lambda k: k NOT IN ({neutral})), '><') || '>', '') AS told FROM d LEFT JOIN j USING (row)),
r AS (SELECT doc_id, ids, CASE WHEN ids = [] THEN {{'rest': '', 'lic': []::VARCHAR[]}} ELSE list_reduce(generate_series(0, {len(RULES) - 1}), lambda a, n: CASE n {" ".join(steps)} END, {{'rest': told, 'lic': []::VARCHAR[]}}) END AS got FROM m)
SELECT doc_id, len(list_filter(ids, lambda k: k <> '?'))::BIGINT AS n_known, array_to_string(list_filter(ids, lambda k: k <> '?'), ',') AS sentences, array_to_string(got.lic, ',') AS licenses,
  array_to_string(list_filter(regexp_split_to_array(got.rest, '[<>]+'), lambda k: k NOT IN ('', '?')), ',') AS unused FROM r
"""
