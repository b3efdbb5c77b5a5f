"""Operator 4, licence scans by sentence rules, in DataFrame functions alone.

Texts are split into sentences after stops and at line ends, sentences are
normalised (ASCII lower case, letters and digits only, single blanks), and
those that are known map to licence-sentence identifiers. The sequence of a
document's identifiers is then matched against ordered licence rules, each a
sequence of identifiers; the first rule that fits takes its identifiers away,
so a rule for a whole licence comes before rules for its parts.

A tag line `SPDX-License-Identifier: X` is a sentence where X is a single known
identifier that ends its line or comment; expressions of several are none.

Null and empty texts have no sentence and no licence, an empty table gives an
empty result, very long texts are looked at whole; other columns, whatever
their names, are not read. Repeated rows give repeated rows. One projection of
each row: no shuffle, no join, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licences and licence notices, by identifier.
SENTENCES: dict[str, list[str]] = {
    "ApacheRef": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "This work is licensed under the Apache License, Version 2.0."],
    "ApacheMayNot": ["you may not use this file except in compliance with the License."],
    "ApacheObtain": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "ApacheAsIs": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "MITRef": ["Released under the MIT License.", "Licensed under the MIT License.", "This work is licensed under the MIT License."],
    "MITGrant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "MITNotice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "BSDGrant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSDSource": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "BSDBinary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSDEndorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "GPL3Ref": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3."],
    "GPL2Ref": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "GPLLater": ["either version 3 of the License, or (at your option) any later version."],
    "GPLWarranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "LGPLRef": ["Licensed under the GNU Lesser General Public License, version 3."],
    "MPL2Ref": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "CCBYNC4Ref": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CCBYSA4Ref": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CCBY4Ref": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0Ref": ["Released under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0."],
    "Reserved": ["All rights reserved."],
}
#: Rules, first to last: licence and its sentences in order.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["ApacheRef", "ApacheMayNot", "ApacheObtain", "ApacheAsIs"]),
    ("MIT", ["MITGrant", "MITNotice"]),
    ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse"]),
    ("BSD-2-Clause", ["BSDGrant", "BSDSource", "BSDBinary"]),
    ("GPL-3.0-or-later", ["GPL3Ref", "GPLLater", "GPLWarranty"]),
    ("GPL-3.0-or-later", ["GPL3Ref", "GPLLater"]),
    ("Apache-2.0", ["ApacheRef"]),
    ("MIT", ["MITRef"]),
    ("GPL-3.0-only", ["GPL3Ref"]),
    ("GPL-2.0-only", ["GPL2Ref"]),
    ("LGPL-3.0-only", ["LGPLRef"]),
    ("MPL-2.0", ["MPL2Ref"]),
    ("CC-BY-NC-4.0", ["CCBYNC4Ref"]),
    ("CC-BY-SA-4.0", ["CCBYSA4Ref"]),
    ("CC-BY-4.0", ["CCBY4Ref"]),
    ("CC0-1.0", ["CC0Ref"]),
    ("all-rights-reserved", ["Reserved"]),
]
_BY = ("Licensed under", "Released under", "Distributed under", *(f"This {x} is {how} under" for x in ("work", "project", "code", "software", "library", "package", "program", "repository", "file", "document", "dataset") for how in ("licensed", "released", "distributed")))
_FREE = "you can redistribute it and/or modify it under the terms of the"
_OF_FSF = "as published by the Free Software Foundation"


def _by(*names: str) -> list[str]:
    return [f"{by} {name}." for by in _BY for name in names]


def _free(rest: str) -> list[str]:
    """The grant of the GNU headers; after a colon it is a sentence by itself."""
    return [f"{_FREE} {rest}", *(f"This {x} is free software; {_FREE} {rest}" for x in ("program", "library", "file", "software", "package"))]


def _later(name: str, version: str) -> list[str]:
    return _free(f"{name} {_OF_FSF}, either version {version} of the License, or (at your option) any later version.")


_GPL, _LGPL, _AGPL = (f"GNU {x}General Public License" for x in ("", "Lesser ", "Affero "))
#: The standard headers and texts as they are published, and further forms of the notices above. The SQL
#: (oracle) has only the sentences and rules above.
STANDARD: dict[str, list[str]] = {
    "ApacheHeader": [f'{by} the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.' for by in ("Licensed under", "The ASF licenses this file to You under", "The ASF licenses this file to you under")],
    "ApacheRef": [*_by("the Apache License, Version 2.0"), 'Licensed under the Apache License, Version 2.0 (the "License");'],
    "ApacheObtain": ["You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "MITRef": _by("the MIT License"),
    "MITNotice": ["The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."],
    "BSDEndorse": ["The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."],
    "GPL3Ref": _by(f"the {_GPL}, version 3", f"the {_GPL} version 3", f"the {_GPL} v3.0"),
    "GPL2Ref": _by(f"the {_GPL}, version 2", f"the {_GPL} version 2", f"the {_GPL} v2.0"),
    "LGPLRef": _by(f"the {_LGPL}, version 3", f"the {_LGPL} version 3", f"the {_LGPL} v3.0"),
    "MPL2Ref": _by("the Mozilla Public License, version 2.0", "the Mozilla Public License, v. 2.0", "the Mozilla Public License 2.0"),
    "CCBYNC4Ref": _by("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CCBYSA4Ref": _by("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CCBY4Ref": _by("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC0Ref": _by("CC0 1.0"),
    "GPL3LaterGrant": _later(_GPL, "3"),
    "GPL2LaterGrant": _later(_GPL, "2"),
    "LGPL3LaterGrant": _later(_LGPL, "3"),
    "LGPL21LaterGrant": _later(_LGPL, "2.1"),
    "AGPL3LaterGrant": _later(_AGPL, "3"),
    "GPL3OnlyGrant": _free(f"{_GPL} version 3 {_OF_FSF}."),
    "GPL2OnlyGrant": _free(f"{_GPL} version 2 {_OF_FSF}."),
    "GPLWarranty": [f"This {x} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE." for x in ("library", "file", "software", "package")],
}
#: Rules of the standard headers; they go before the rules above.
STANDARD_RULES: list[tuple[str, list[str]]] = [
    *(("Apache-2.0", [*head, *rest]) for head in (["ApacheHeader"], ["ApacheRef", "ApacheMayNot"]) for rest in (["ApacheObtain", "ApacheAsIs"], ["ApacheObtain"], [])),
    *((name, [grant, *rest]) for name, grant in (
        ("GPL-3.0-or-later", "GPL3LaterGrant"), ("GPL-2.0-or-later", "GPL2LaterGrant"), ("LGPL-3.0-or-later", "LGPL3LaterGrant"), ("LGPL-2.1-or-later", "LGPL21LaterGrant"),
        ("AGPL-3.0-or-later", "AGPL3LaterGrant"), ("GPL-3.0-only", "GPL3OnlyGrant"), ("GPL-2.0-only", "GPL2OnlyGrant"),
    ) for rest in (["GPLWarranty"], [])),
]
#: Further licences' own sentences, and the whole texts' warranty paragraphs and titles.
FURTHER: dict[str, list[str]] = {
    "MITAsIs": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "MITLiable": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "BSDAsIs": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "BSDLiable": [f"IN NO EVENT SHALL THE COPYRIGHT {x} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE." for x in ("HOLDER", "OWNER", "HOLDERS")],
    "BSDStyle": [f"Use of this source code is governed by a BSD{x}style license that can be found in the LICENSE file." for x in "- "],
    "ISCGrant": [f"Permission to use, copy, modify, {x} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." for x in ("and/or", "and")],
    "0BSDGrant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "ISCAsIs": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "UnlicenseFree": ["This is free and unencumbered software released into the public domain."],
    "UnlicenseAnyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "BoostRef": [*_by("the Boost Software License, Version 1.0"), "Boost Software License - Version 1.0 - August 17th, 2003"],
    "BoostGrant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "ZlibGrant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "ZlibOrigin": ["The origin of this software must not be misrepresented; you must not claim that you wrote the original software."],
    "EPL2Notice": [f"This program and the accompanying materials are made available under the terms of the Eclipse Public License {v}2.0 which {x} available at {u}" for v in ("", "v. ", "v") for x in ("is", "accompanies this distribution, and is") for u in ("https://www.eclipse.org/legal/epl-2.0/", "http://www.eclipse.org/legal/epl-2.0", "https://www.eclipse.org/legal/epl-2.0")],
    "EPL1Notice": [f"All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at {u}" for u in ("http://www.eclipse.org/legal/epl-v10.html", "https://www.eclipse.org/legal/epl-v10.html")],
    "ApacheTitle": ["Apache License Version 2.0, January 2004"],
    "GPL3Title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "GPL2Title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL3Title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL21Title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "AGPL3Title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "MPL2Title": ["Mozilla Public License Version 2.0"],
}
#: Identifiers of the public licence list that a tag line may name.
SPDX = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-1.0 EPL-2.0 "
    "GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib"
).split()
FURTHER |= {f"SPDX-{x}": [f"SPDX-License-Identifier {x}"] for x in SPDX}
#: Rules of these, before all others; longer ones first.
FURTHER_RULES: list[tuple[str, list[str]]] = [
    *((x, [f"SPDX-{x}"]) for x in SPDX),
    *(("MIT", ["MITGrant", "MITNotice", *rest]) for rest in (["MITAsIs", "MITLiable"], ["MITAsIs"])),
    *((name, ["BSDGrant", "BSDSource", "BSDBinary", *end, *rest]) for rest in (["BSDAsIs", "BSDLiable"], ["BSDAsIs"]) for name, end in (("BSD-3-Clause", ["BSDEndorse"]), ("BSD-2-Clause", []))),
    *((name, [grant, *rest]) for rest in (["ISCAsIs"], []) for name, grant in (("ISC", "ISCGrant"), ("0BSD", "0BSDGrant"))),
    *(("Unlicense", x) for x in (["UnlicenseFree", "UnlicenseAnyone"], ["UnlicenseFree"])),
    *(("BSL-1.0", x) for x in (["BoostRef", "BoostGrant"], ["BoostGrant"], ["BoostRef"])),
    *(("Zlib", x) for x in (["ZlibGrant", "ZlibOrigin"], ["ZlibGrant"])),
    ("EPL-2.0", ["EPL2Notice"]), ("EPL-1.0", ["EPL1Notice"]), ("BSD-style", ["BSDStyle"]),
    ("Apache-2.0", ["ApacheTitle"]), ("GPL-3.0-only", ["GPL3Title"]), ("GPL-2.0-only", ["GPL2Title"]), ("LGPL-3.0-only", ["LGPL3Title"]), ("LGPL-2.1-only", ["LGPL21Title"]), ("AGPL-3.0-only", ["AGPL3Title"]), ("MPL-2.0", ["MPL2Title"]),
]
STANDARD |= FURTHER
STANDARD_RULES = FURTHER_RULES + STANDARD_RULES
ALL_SENTENCES = {k: SENTENCES.get(k, []) + STANDARD.get(k, []) for k in {**SENTENCES, **STANDARD}}
ALL_RULES = STANDARD_RULES + RULES
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(sentence: str) -> str:
    """What normalisation makes of a known sentence."""
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence)
    return " ".join(kept.translate(str.maketrans(UPPER, LOWER)).split())


def known(sentences: dict[str, list[str]]) -> dict[str, str]:
    """Identifier by normalised text, of every sentence."""
    return {normal(form): name for name, forms in sentences.items() for form in forms}


#: Where sentences break, in order.
BREAKS = [
    (r"spdx-license-identifier:[ \t]*([a-z0-9][a-z0-9.-]*)(?=[ \t]*(?:\*/|-->|\r?\n|\r?$))", "\n\nspdx-license-identifier $1\n\n"),
    (r"(?m)^[ \t]*+(?:(?:/[*/]|[*#;%>|•·–-])++[ \t]*+)++", ""),
    (r"(?m)^([ \t]*(?:copyright[ \t]+(?:\(c\)|©|[0-9]{4})|(?:\(c\)|©)[ \t]*[0-9]{4})[^\r\n]*)$", "$1\n\n"),
    (r"(?m)^([ \t]*<?https?://[^ \t\r\n]+[ \t\r]*)$", "\n\n$1\n\n"),
    (r"(/licenses/license-2\.0(?:\.txt|\.html)?)[ \t]+", "$1\n\n"),
    (r"(^|[.!?:;][ \t\r]*\n|\b(?:and|or)[ \t\r]*\n|\n[ \t\r]*\n)[ \t]*(?:\(?[0-9]{1,2}[.)]|\(?[a-z][.)])[ \t]+", "$1\n\n"),
    (r"([.!?:])[ \t\r\n]+([a-z\"(])", "$1\n\n$2"),
    (r"(?<![^a-z]v)([.!?:][ \t\r]*\n)([ \t\r\n]*[0-9])", "$1\n$2"),
]
ENDORSE = "^neither the names? of .{1,120}? nor the names of (?:its|any|their|other) contributors may"


def _parts(text: Column) -> Column:
    """A text's parts, sentences or several lines. Marks of comments and lists
    that begin a line are taken away; what follows a list's number, a copyright line or a line of an
    address alone is looked at by itself. A stop or colon ends a sentence
    before blanks or a line end and then a letter, a double quote or a bracket
    (so not in `v. 2.0`), or at a line end before a digit, and so does an empty
    line. Sentences may go over several lines; where one isn't known, its lines
    are looked at by themselves."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for pattern, put in BREAKS:
        lower = F.regexp_replace(lower, pattern, put)
    return F.split(lower, r"\n[ \t\r]*\n[ \t\r\n]*")


def _normal_sql(x: str) -> str:
    """A part's normalised text; x: an expression of Spark's SQL."""
    return f"regexp_replace(trim(regexp_replace({x}, '[^a-z0-9]+', ' ')), '{ENDORSE}', 'neither the name of the copyright holder nor the names of its contributors may')"


def scan(docs: DataFrame, sentences: dict[str, list[str]] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids (in order, by commas),
    licenses (in rule order, by commas), unmatched (identifiers that no rule
    has taken)."""
    by_text = known(sentences or ALL_SENTENCES)
    # as SQL text: normalised sentences hold letters, digits and blanks alone; IN looks them up by hash
    names, table = ", ".join(f"'{t}'" for t in by_text), F.expr("map(" + ", ".join(f"'{t}', '{i}'" for t, i in by_text.items()) + ")")
    rules = rules or (RULES if sentences else ALL_RULES)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _parts(F.col("text").cast("string")).alias("p"))
    whole = f"transform(p, x -> struct(x, {_normal_sql('x')} AS n))"
    lines = f"transform(split(y.x, '[\\\\r\\\\n]+'), z -> {_normal_sql('z')})"
    found = found.select("doc_id", F.expr(f"flatten(transform({whole}, y -> IF(y.n IN ({names}), array(y.n), {lines})))").alias("s"))
    found = found.select("doc_id", F.transform(F.expr(f"filter(s, x -> x IN ({names}))"), lambda s: F.element_at(table, s)).alias("ids"))
    found = found.withColumn("left", F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""))
    # no sign is shared by two marks, so adjacent ones all match; documents without sentences have nothing to match
    marks = F.expr("array(" + ", ".join(f"named_struct('mark', '{''.join(f'<{x}>' for x in sequence)}', 'name', '{name}')" for name, sequence in rules) + ")")
    none = F.array().cast("array<string>")
    start = F.struct(F.col("left").alias("left"), none.alias("hits"))

    def take(state: Column, rule: Column) -> Column:
        hits = F.when(state["left"].contains(rule["mark"]), F.array_append(state["hits"], rule["name"])).otherwise(state["hits"])
        return F.struct(F.replace(state["left"], rule["mark"], F.lit("|")).alias("left"), hits.alias("hits"))

    found = found.withColumn("m", F.when(F.size("ids") == 0, start).otherwise(F.aggregate(marks, start, take)))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(F.array_distinct("m.hits"), ",").alias("licenses"), F.trim(F.regexp_replace("m.left", "[<>|]+", " ")).alias("unmatched"))


def oracle(sentences: dict[str, list[str]] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> str:
    """The same in DuckDB's SQL over documents."""
    by_text = known(sentences or SENTENCES)
    table = "MAP {" + ", ".join(f"'{t}': '{i}'" for t, i in by_text.items()) + "}"
    steps, last = [], "l"
    for k, (_, sequence) in enumerate(rules or RULES):
        mark = " " + " ".join(sequence) + " "
        steps.append(f"x{k} AS (SELECT *, contains(left{k}, '{mark}') AS r{k}, replace(left{k}, '{mark}', ' | ') AS left{k + 1} FROM {last})")
        last = f"x{k}"
    names = ", ".join(f"CASE WHEN r{k} THEN '{rule[0]}' END" for k, rule in enumerate(rules or RULES))
    n = len(rules or RULES)
    return rf"""
WITH g AS (
  SELECT doc_id, string_split_regex(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '([.!?:])[ \t\r\n]+([a-z\"(])', '\1' || chr(10) || chr(10) || '\2', 'g'), '\n[ \t\r]*\n[ \t\r\n]*') AS g FROM documents),
s AS (SELECT doc_id, flatten(list_transform(g, lambda x: CASE WHEN ({table})[trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))] IS NOT NULL THEN [trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))]
  ELSE list_transform(string_split_regex(x, '[\r\n]+'), lambda y: trim(regexp_replace(y, '[^a-z0-9]+', ' ', 'g'))) END)) AS s FROM g),
i AS (SELECT doc_id, list_filter(list_transform(s, lambda x: ({table})[x]), lambda x: x IS NOT NULL) AS ids FROM s),
l AS (SELECT doc_id, ids, ' ' || coalesce(list_aggregate(list_transform(ids, lambda x: x || ' '), 'string_agg', ''), '') AS left0 FROM i),
{", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce((SELECT string_agg(v, ',' ORDER BY k) FROM (SELECT v, min(k) AS k FROM (SELECT unnest([{names}]) AS v, unnest(range({n})) AS k) WHERE v IS NOT NULL GROUP BY v)), '') AS licenses,
  trim(regexp_replace(replace(left{n}, '|', ''), ' +', ' ', 'g')) AS unmatched
FROM {last}"""
