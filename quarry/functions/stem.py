"""The Porter stemmer (Porter 1980, with the extensions that NLTK adds), as
regular expressions that Java and RE2 read alike, and so as Spark columns or
as SQL text.

A word is lower-cased and each y that is a consonant (at the start, or after a
vowel) becomes Y; then each step replaces the word by the first of its rules
whose guard fits. Letters other than a, e, i, o, u and the vowel y are
consonants. Words of one or two letters stay as they are.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_C, _V = "[^aeiouy#]", "[aeiouy]"
_M0 = f"{_C}*{_V}+{_C}[^#]*"  # stems of measure over 0
_M1 = f"{_C}*{_V}+{_C}+{_V}+{_C}[^#]*"  # of measure over 1
_ONE = f"{_C}*{_V}+{_C}+{_V}*"  # of measure 1
_HAS_V = f"[^#]*{_V}[^#]*"
_AFTER_ST = f"{_C}*{_V}+{_C}+{_V}+(?:{_C}[^#]*)?[st]"  # of measure over 1, at s or t
_CVC = f"(?:.*{_C}{_V}[^aeiouywxY#]|{_V}{_C})"

#: Words whose stems are listed.
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
#: Suffixes and what replaces them, in order of precedence.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

#: Steps of (guard, pattern, replacement with \1 for the first group).
STEPS: list[list[tuple[str, str, str]]] = [
    [("^y", "^y", "Y")],
    [("[aeiou]y", "([aeiou])y", r"\1Y")],
    [("yy", "yy", "yY")],
    [("^.ies$", "ies$", "ie"), ("sses$", "sses$", "ss"), ("ies$", "ies$", "i"), ("ss$", "ss$", "ss"), ("s$", "s$", "")],
    [("^.ied$", "ied$", "ie"), ("ied$", "ied$", "i"), ("eed$", f"^({_M0})eed$", r"\1ee"), (f"^{_HAS_V}ed$", "ed$", "#"), (f"^{_HAS_V}ing$", "ing$", "#")],
    [("at#$", "#$", "e"), ("bl#$", "#$", "e"), ("iz#$", "#$", "e"), ("(?:" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwxY") + ")#$", ".#$", ""), ("(?:ll|ss|zz)#$", "#$", ""), (f"^{_ONE}#$", f"^({_CVC})#$", r"\1e")],
    [("#$", "#$", "")],
    [(f"^.+{_C}y$", "y$", "i")],
    [(f"^{_M0}alli$", "alli$", "al")],
    [(f"{s}$", f"^({_M0}){s}$", rf"\1{r}") for s, r in STEP_2] + [("logi$", f"^({_M0})ogi$", r"\1og")],
    [(f"{s}$", f"^({_M0}){s}$", rf"\1{r}") for s, r in STEP_3],
    [(f"{s}$", f"^({_M1}){s}$" if s != "ion" else f"^({_AFTER_ST})ion$", r"\1") for s in STEP_4],
    [(f"^{_M1}e$", "e$", ""), (f"^{_CVC}e$", "e$", "e"), (f"^{_ONE}e$", "e$", "")],
    [(f"^{_M1}l$", "ll$", "l")],
]


def _apply(step: list[tuple[str, str, str]]) -> Callable[[Column], Column]:
    """The first rule whose guard fits, for a word."""

    def run(w: Column) -> Column:
        c = None
        for guard, pattern, new in step:
            made = F.regexp_replace(w, pattern, new.replace("\\1", "$1"))
            c = F.when(w.rlike(guard), made) if c is None else c.when(w.rlike(guard), made)
        return c.otherwise(w)

    return run


def stem_column(word: Column) -> Column:
    """The stem of a word. Each step names the word so far by a lambda
    variable, so the expression's size is linear in the number of steps,
    wherever the optimizer moves it."""
    lower = F.lower(word)
    out = lower
    for step in STEPS:
        out = F.element_at(F.transform(F.array(out), _apply(step)), 1)
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    return F.coalesce(F.element_at(irregular, lower), F.when(F.length(lower) <= 2, lower).otherwise(F.translate(out, "Y", "y")))


def stems(words: DataFrame, word: str = "term", to: str = "stem") -> DataFrame:
    """words with the column `to`: the stem of the column `word`."""
    return words.withColumn(to, stem_column(F.col(word)))


def _ending(guard: str) -> str:
    """The letters that a word has to end in for a guard to fit; may be none."""
    return re.search("[a-zY#]*$", guard[:-1])[0] if re.fullmatch(r"[^|$]*[)a-z][a-z#]*\$|[a-z#]+\$", guard) else ""


_COMPILED = [[(_ending(g), re.compile(g).search, re.compile(p).sub, n) for g, p, n in step] for step in STEPS]
#: Words whose stems a worker keeps, and lists whose words it holds at once.
KEPT, PART = 500_000, 500
_known: dict[str, str] = {}


def stem_word(word: str) -> str:
    """The stem of one word, by the same rules."""
    w = word.lower()
    if w in IRREGULAR or len(w) <= 2:
        return IRREGULAR.get(w, w)
    for step in _COMPILED:
        for ending, guard, replace, new in step:
            if w.endswith(ending) and guard(w):
                w = replace(new, w)
                break
    return w.replace("Y", "y")


def _stem_lists(lists: pa.Array) -> pa.Array:
    """Stems of lists of words; each distinct word of a part is looked up once."""
    known, parts = _known, []
    at = 0
    while at < len(lists) or not parts:
        part = lists.slice(at, PART)
        at += PART
        coded = part.flatten().dictionary_encode()
        found = []
        for w in coded.dictionary.to_pylist():
            stem = known.get(w)
            if stem is None:
                stem = stem_word(w)
                if len(known) < KEPT:  # words that come early are the frequent ones: they stay
                    known[w] = stem
            found.append(stem)
        stems = pa.array(found, pa.string()).take(coded.indices)
        offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        parts.append(pa.ListArray.from_arrays(pa.array(offsets), stems))
    return pa.concat_arrays(parts)


def stem_array(tokens: Column) -> Column:
    """Each token's stem. Tokens repeat so often that a worker's table of
    stems answers nearly all of them: one Arrow batch in and out, no shuffle,
    where a join with the stemmed vocabulary would move every token."""
    spark = SparkSession.getActiveSession()
    if spark is not None:  # workers on this machine find the package where the driver has
        root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        env["PYTHONPATH"] = os.pathsep.join(paths if root in paths else [root, *paths])
    return F.arrow_udf(_stem_lists, "array<string>")(tokens)


def stem_sql(source: str, word: str = "term", to: str = "stem", keep: str = "*") -> str:
    """The same as a SQL query text for DuckDB; source: a table or subquery."""
    sql = f"SELECT {keep}, lower({word}) AS _l, lower({word}) AS _w FROM {source}"
    for step in STEPS:
        cases = " ".join(f"WHEN regexp_matches(_w, '{g}') THEN regexp_replace(_w, '{p}', '{n}', 'g')" for g, p, n in step)
        sql = f"SELECT * REPLACE (CASE {cases} ELSE _w END AS _w) FROM ({sql})"
    listed = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    return f"SELECT * EXCLUDE (_l, _w), CASE _l {listed} ELSE CASE WHEN length(_l) <= 2 THEN _l ELSE replace(_w, 'Y', 'y') END END AS {to} FROM ({sql})"
