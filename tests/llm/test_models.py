"""Classifier, language model and licence rules: accuracy and edge cases."""

import math
import random
import zlib

import numpy as np
import pytest

from quarry.llm import language, licenses, quality

WORDS = {"en": "the of and to in that is was for on with as it at by from they have this had not are but".split(), "de": "der die und das nicht mit ein eine ist auf für von dem zu sich auch werden über größe schön".split()}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng, rows = random.Random(5), []
    for i in range(600):
        lang = ("en", "de")[i % 2]
        body = text(rng, lang, rng.randint(5, 60))
        if i % 3 == 0:
            body = " ".join(w.upper() + "!!" for w in body.split()) if i % 2 else " ".join([rng.choice(WORDS[lang])] * 30)
        rows.append((i, body, lang, 1.0))
    rows += [(1000, None, "en", 1.0), (1001, "", None, 1.0), (1002, "123 !!", "de", 1.0), (1003, "unseenword " * 20000, None, 1.0), (0, rows[0][1], "en", 1.0), (None, "the of and", "en", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(600)] + [(1000, None, 0), (1001, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int").cache()


def test_quality(docs, labels):
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 600]
    assert len(held) > 100 and all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in rows if r["doc_id"] is not None)
    assert sum(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    kept = {(r["doc_id"]) for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r["doc_id"] for r in rows if r["predicted"] == 1}
    assert quality.keep_good(docs, labels).columns == docs.columns
    again = quality.classify(docs.repartition(7), labels).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_quality_without_labels(spark, docs, labels):
    assert {r["score"] for r in quality.classify(docs, labels.where("quality = 1")).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_word_features_do_not_depend_on_the_batch():
    at, owner = quality.word_features(["one", "zwei", "x", "größer!!"])
    for k, w in enumerate(["one", "zwei", "x", "größer!!"]):
        alone, _ = quality.word_features([w])
        assert sorted(at[owner == k].tolist()) == sorted(alone.tolist())
        assert len(alone) == 1 + sum(max(0, len(w) + 2 - n + 1) for n in quality.NGRAMS)


def test_language(docs):
    rows = language.identify(docs).collect()
    by = {r["doc_id"]: r for r in rows}
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 600]
    assert len(held) > 80 and sum(r["lang_pred"] == ("en", "de")[r["doc_id"] % 2] for r in held) / len(held) > 0.97
    for i in (1000, 1001, 1002):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[1003]["lang_pred"] in ("en", "de") and all(0 <= r["score"] <= 1 for r in rows)
    kept = [r["doc_id"] for r in language.keep_known(docs).collect()]
    assert not {1000, 1001, 1002} & set(kept) and {i for i in range(600) if i % 3} <= set(kept)
    assert {r["lang_pred"] for r in language.identify(docs.limit(0)).collect()} == set()


def test_language_backs_off():
    model = language.Model([("a", "xyzzy xyzzy xyzzy foo foo foo"), ("b", "plugh plugh plugh bar bar bar")])
    assert model.word("xyzzy")[0] > model.word("xyzzy")[1]
    assert model.word("xyzzyq")[0] > model.word("xyzzyq")[1]  # by its n-grams
    assert model.word("42") is None and model.word("ωω").tolist() == [0.0, 0.0]


def test_language_learns_nothing_from_null(spark):
    rows = spark.createDataFrame([(1, "the of", None), (2, "a b", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(rows).collect()} == {"und"}


def test_language_equals_plain_scoring(docs):
    model = language.Model(language.sample_rows(docs))
    plain = {}
    for r in docs.collect():
        known = [x for x in map(model.word, (r["text"] or "").split()) if x is not None]
        if not known:
            plain[r["doc_id"], r["text"]] = ("und", 0.0)
            continue
        total = np.sum(np.array(known, dtype=np.float64), axis=0) / math.sqrt(len(known))
        p = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        plain[r["doc_id"], r["text"]] = (model.languages[int(total.argmax())], float(p.max()))
    found = [(r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in language.identify(docs).collect()]
    assert set(found) == {(i, lang, round(x, 6)) for (i, _), (lang, x) in plain.items()} and len(found) == docs.count()


def test_language_learns_each_row_with_its_own_text(spark):
    rows = [(k, text, lang) for k in range(200) for lang, text in (("de", "der die und das nicht"), ("en", "the of and to in"), (None, "a b c"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(r["lang"], r["text"]) for r in spark.createDataFrame(language.sample_rows(docs), "lang string, text string").distinct().collect()} == {("de", "der die und das nicht"), ("en", "the of and to in")}
    assert len(language.sample_rows(docs, sample=20)) == 40


def test_language_learns_every_language(spark):
    rows = [(10 * i + j, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * 4, f"l{i:02}") for i in range(70) for j in range(8)]
    found = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in found} == {i: lang for i, _, lang in rows}


def test_language_learns_from_every_row(spark):
    """A held-out row's only word is one that a single other row teaches."""
    rng, rows, want = random.Random(8), [], {}
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    held, taught = [i for i in range(12000) if fold(i) == 2], [i for i in range(12000) if fold(i) != 2]
    for k, (i, j) in enumerate(zip(held, taught)):
        lang, word = ("en", "de")[k % 2], "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
        rows += [(i, word, None), (j, f"{word} " * 4, lang)]
        want[i] = lang
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(want) // 2 > language.SAMPLE
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).where("held_out").collect()} == want
    assert language.keep_known(docs, 0.75).where("lang IS NULL").count() == len(want)


def test_language_counts_as_one_task_would(spark):
    """Over portions of few bytes and several tasks."""
    words = "Der\x1cdie\u2003DAS über ÜBER! İstanbul ŒUVRE l'été x 12 a1b 中文字 ^a$ straße \U00020000\U00020001 ŉ".split() + ["der", "die"]
    rng = random.Random(3)
    rows = [(i, rng.choice(["", " ", "\t"]).join([" ", *(f"{w} " for w in rng.choices(words, k=rng.randint(0, 30)))]), ("x", "y", "z")[i % 3]) for i in range(300)]
    docs = spark.createDataFrame([*rows, (300, None, "x"), (301, "abc", None), (302, "", "w")], "doc_id long, text string, lang string").repartition(5)
    want = language.Model([(lang, text) for i, text, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2])
    found = language.learn(docs, text_bytes=64, word_bytes=32)
    assert found.languages == want.languages == ["x", "y", "z"]
    for (a, x), (b, y) in zip(found.tables, want.tables, strict=True):
        assert {p: x[k].tolist() for p, k in a.items()} == {p: y[k].tolist() for p, k in b.items()} and len(a) > 0


def test_quality_equals_a_plain_forward_pass(docs, labels):
    vectors, layer = quality.train(quality.sample_rows(docs, labels))
    found = {(r["doc_id"], round(r["score"], 5)) for r in quality.classify(docs, labels).collect()}
    for r in docs.where("doc_id < 60 OR doc_id >= 1000").collect():
        words = (r["text"] or "").split()
        at = [b for w in words for b in quality.word_features([w])[0].tolist()] + [quality.END] + [quality.REPEAT] * sum(a == b for a, b in zip(words, words[1:]))
        logit = layer.astype(np.float64) @ vectors[at].astype(np.float64).mean(axis=0)
        score = 1 / (1 + math.exp(-max(-30, min(30, logit[1] - logit[0]))))
        assert any(i == r["doc_id"] and abs(x - score) < 2e-4 for i, x in found)


def test_repeated_labels_fill_no_sample(spark, docs):
    labels = spark.createDataFrame([(2, 1)] * 50 + [(3, 0)] * 50 + [(i, i % 2) for i in range(4, 80)], "doc_id long, quality int")
    assert len(quality.sample_rows(docs, labels, sample=20)) == 40


def test_licenses(spark):
    mit = " ".join(s for k in ("MITGrant", "MITNotice") for s in licenses.SENTENCES[k][:1])
    rows = [
        (1, f"Title\n\n{mit}\nRest of it.".replace(" the Software", "\n the  Software")), (2, "Text. licensed under the  APACHE License, version 2.0. More."), (3, None), (4, ""), (5, "Nothing here. Licensed to kill."),
        (6, licenses.SENTENCES["MITNotice"][0]), (6, licenses.SENTENCES["MITNotice"][0]), (None, "Released under the MIT License."),
        (7, "Released under the MIT License.\nwords words\nAll rights reserved.\nLicensed under CC BY-NC 4.0."),
    ]
    out = licenses.scan(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, left int"))
    got = sorted(((r["doc_id"], r["sentence_ids"], r["licenses"], r["unmatched"]) for r in out.collect()), key=repr)
    want = [(1, "MITGrant,MITNotice", "MIT", ""), (2, "ApacheRef", "Apache-2.0", ""), (3, "", "", ""), (4, "", "", ""), (5, "", "", ""), (6, "MITNotice", "", "MITNotice"), (6, "MITNotice", "", "MITNotice"), (7, "MITRef,Reserved,CCBYNC4Ref", "MIT,CC-BY-NC-4.0,all-rights-reserved", ""), (None, "MITRef", "MIT", "")]
    assert got == sorted(want, key=repr)
    assert not {"MapInArrow", "ArrowEvalPython", "BatchEvalPython"} & set(out._jdf.queryExecution().executedPlan().toString().split())


def test_license_table(spark):
    """Every known sentence is one sentence to the splitter."""
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(f for forms in licenses.SENTENCES.values() for f in forms)], "doc_id long, text string")
    assert licenses.scan(rows).where("n_sentences <> 1").collect() == []


APACHE = """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Copyright (c) 2020, Some Body
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
{0} Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
{1} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{2} Neither the name of the {3} nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"."""


def test_standard_license_texts(spark):
    comment = lambda text, mark: "\n".join(f"{mark} {x}".rstrip() for x in text.split("\n"))
    cases = [
        ("Apache-2.0", APACHE), ("Apache-2.0", comment(APACHE, "#")), ("Apache-2.0", comment(APACHE, " *")), ("Apache-2.0", comment(APACHE, "//")), ("Apache-2.0", " ".join(APACHE.split()[4:])), ("Apache-2.0", APACHE.replace("\n", "\r\n")),
        ("GPL-3.0-or-later", GPL.format(":", ",", 3)), ("GPL-2.0-or-later", GPL.format(";", ";", 2)), ("GPL-2.0-or-later", comment(GPL.format(";", ";", 2), ";;")),
        ("LGPL-2.1-or-later", GPL.format(";", ";", "2.1").replace("General", "Lesser General").replace("program", "library")), ("AGPL-3.0-or-later", GPL.format(":", ",", 3).replace("General", "Affero General")),
        ("BSD-3-Clause", BSD.format("1.", "2.", "3.", "copyright holder")), ("BSD-3-Clause", BSD.format("*", "*", "*", "University of Somewhere")), ("BSD-3-Clause", comment(BSD.format("(a)", "(b)", "(c)", "author"), "#")),
        ("BSD-2-Clause", BSD.format("-", "-", "-", "x").replace("Neither", "Not")),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/."),
        ("GPL-2.0-only", "Released under the GNU General Public License, version 2."), ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
        ("MPL-2.0", "Released under the Mozilla Public License, version 2.0."), ("CC-BY-4.0", "Released under CC BY 4.0."), ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v.\n2.0."), ("", "Words of it. 2. Other words.\n3 more (a) words"),
    ]
    out = licenses.scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(cases)], "doc_id long, text string")).collect()
    assert [(r["licenses"], r["unmatched"]) for r in sorted(out, key=lambda r: r["doc_id"])] == [(name, "") for name, _ in cases]


def test_repeated_licenses(spark):
    of = lambda *names: "\n\n".join(licenses.SENTENCES[n][0] for n in names)
    bsd = ("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse")
    cases = [
        (of(*bsd, *bsd), "BSD-3-Clause", ""), (of(*bsd, *bsd[:3], *bsd), "BSD-3-Clause,BSD-2-Clause", ""), (of(*["GPL3Ref", "GPLLater"] * 2), "GPL-3.0-or-later", ""), (of(*["MITRef"] * 5), "MIT", ""),
        (of("GPLLater", "MITRef", "MITRef", "GPLLater", "BSDGrant"), "MIT", "GPLLater GPLLater BSDGrant"),
    ]
    out = licenses.scan(spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(cases)], "doc_id long, text string")).collect()
    assert [(r["licenses"], r["unmatched"]) for r in sorted(out, key=lambda r: r["doc_id"])] == [(name, left) for _, name, left in cases]


def test_languages_whose_rows_share_an_id_are_learned(spark):
    """Neither equal ids nor equal rows keep a language out of the sample."""
    docs = [(8, "de", f"das ist der satz {i % 7}") for i in range(3000)] + [(9, "fr", "le meme texte")] * 3000 + [(i, "en", f"this is the sentence {i}") for i in range(50)]
    df = spark.createDataFrame([(i, t, lang) for i, lang, t in docs], "doc_id long, text string, lang string")
    rows = language.sample_rows(df, sample=1000)
    assert {lang: sum(x == lang for x, _ in rows) for lang in ("de", "fr")} == {"de": 1000, "fr": 1000}
    assert 30 <= sum(x == "en" for x, _ in rows) <= 50
    assert rows == language.sample_rows(df.repartition(7), sample=1000)


ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT"""


@pytest.mark.parametrize(
    "text, want",
    [
        ("// SPDX-License-Identifier: Apache-2.0\nint x;", "Apache-2.0"),
        ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0-or-later"),
        ("# SPDX-License-Identifier: MIT", "MIT"),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ""),
        ("SPDX-License-Identifier: Unknown-9", ""),
        ("Copyright (c) 2001 A\n\n" + ISC, "ISC"),
        ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.", "Unlicense"),
        ("// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file)", "BSL-1.0"),
        ("Permission is granted to anyone to use this software for any purpose,\n  including commercial applications, and to alter it and redistribute it\n  freely, subject to the following restrictions:\n\n  1. The origin of this software must not be misrepresented; you must not\n     claim that you wrote the original software. If you use", "Zlib"),
        ("Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.", "BSD-style"),
        ("This project is licensed under the MIT License.", "MIT"),
        ("This code is licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", "GPL-3.0-only"),
        ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n", "Apache-2.0"),
        ("x " * 100_000 + "\n\nThis library is distributed under the MIT License.\n", "MIT"),
    ],
)
def test_further_licences(spark, text, want):
    df = spark.createDataFrame([(1, text, "clash")], "doc_id long, text string, licenses string")
    assert licenses.scan(df).first()["licenses"] == want
    assert licenses.scan(df.limit(0)).collect() == []
