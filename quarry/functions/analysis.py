"""Text analysis as Spark columns: one analyzer object serves documents and queries.

Regular expressions are such that Java and RE2 read them alike; sql() gives an
analyzer's tokens as DuckDB SQL for checking.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.sentences import KEPT, keep_periods
from quarry.functions.stem import stem_array, stem_sql
from quarry.functions.stopwords import ENGLISH

#: Fixed value: ASCII punctuation in its usual order.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"
_PUNCT = "[!-/:-@\\[-`{-~]"
#: Rewrites that set tokens apart by blanks: punctuation, final periods, contractions, closing apostrophes, joined words.
TREEBANK = [
    (BLANKS, " "),
    ("([:,])([^0-9])", " \\1 \\2"),
    ("([:,])$", " \\1"),
    ("(\\.\\.+)", " \\1 "),
    ("([;@#$%&?!*\\[\\](){}<>\"]|--)", " \\1 "),
    ("([^.])\\.(['\") \\]]*)( |$)", "\\1 . \\2\\3"),
    ("([^' ])('[sSmMdD]|'ll|'LL|'re|'RE|'ve|'VE|n't|N'T|')( |$)", "\\1 \\2\\3"),
    ("\\b([dD])('[yY][eE])\\b", "\\1 \\2"),
    ("\\b([mM][oO][rR][eE])('[nN])\\b", "\\1 \\2"),
    ("( |^)('[tT])([iI][sS]|[wW][aA][sS])\\b", "\\1\\2 \\3"),
    ("\\b([cC][aA][nN])([nN][oO][tT])\\b", "\\1 \\2"),
    ("\\b([gG][iI][mM])([mM][eE])\\b", "\\1 \\2"),
    ("\\b([gG][oO][nN])([nN][aA])\\b", "\\1 \\2"),
    ("\\b([gG][oO][tT])([tT][aA])\\b", "\\1 \\2"),
    ("\\b([lL][eE][mM])([mM][eE])\\b", "\\1 \\2"),
    ("\\b([wW][aA][nN])([nN][aA])\\b", "\\1 \\2"),
]


def words(text: Column) -> Column:
    """Runs between blanks; null texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda t: t != "")


def treebank_words(text: Column, abbreviations: tuple[str, ...] | None = None) -> Column:
    """Words with punctuation and contractions as tokens of their own. A period
    before a blank is one, except after known abbreviations and initials where
    these are given (an empty tuple: initials alone)."""
    out = F.coalesce(text, F.lit(""))
    if abbreviations is not None:
        out = keep_periods(F.trim(F.regexp_replace(out, BLANKS, " ")), abbreviations)
    for pattern, new in TREEBANK:
        out = F.regexp_replace(out, pattern, new.replace("\\1", "$1").replace("\\2", "$2").replace("\\3", "$3"))
    return words(out if abbreviations is None else F.replace(out, F.lit(KEPT), F.lit(".")))


def letters_only(tokens: Column) -> Column:
    """Only the letters of each token; tokens without any go."""
    return F.filter(F.transform(tokens, lambda t: F.regexp_replace(t, "\\P{L}", "")), lambda t: t != "")


def without_punctuation(tokens: Column) -> Column:
    """Tokens that hold no ASCII punctuation."""
    return F.filter(tokens, lambda t: ~t.rlike(_PUNCT))


def not_in_punctuation(tokens: Column) -> Column:
    """Tokens that aren't a run of the punctuation string."""
    return F.filter(tokens, lambda t: F.instr(F.lit(PUNCTUATION), t) == 0)


def without_stopwords(tokens: Column, stop: list[str] | None = None) -> Column:
    return F.filter(tokens, lambda t: ~F.lower(t).isin(stop or ENGLISH))


def bigrams(tokens: Column) -> Column:
    """Neighbours joined by a blank; empty for fewer than two tokens."""
    n = F.size(tokens)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(tokens, 1, n - 1), F.slice(tokens, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b)))


def is_int(token: Column) -> Column:
    """Digits with or without a sign, as far as an int holds them (a cast alone would also take `1.`)."""
    return token.rlike("^[+-]?[0-9]+$") & token.try_cast("int").isNotNull()


def is_quoted(text: Column) -> Column:
    """Whether an opening double quote or two back-ticks stand in the text."""
    return text.rlike("(^|[\\s(\\[{<])\"|``")


@dataclass(frozen=True)
class Analyzer:
    """split: ws or treebank; keep: letters, punct_drop (tokens with
    punctuation go) or punct_substring (tokens that are punctuation go).
    abbreviations: words whose period ends no sentence (sentences.py learns
    them from a corpus); None: every period before a blank ends one."""

    split: str = "treebank"
    keep: str = "letters"
    stop: tuple[str, ...] = tuple(ENGLISH)
    stem: bool = True
    abbreviations: tuple[str, ...] | None = None

    def surface(self, text: Column) -> Column:
        """Tokens before stop words, lower case and stems."""
        tokens = treebank_words(text, self.abbreviations) if self.split == "treebank" else words(text)
        return {"letters": letters_only, "punct_drop": without_punctuation, "punct_substring": not_in_punctuation}[self.keep](tokens)

    def tokens(self, text: Column) -> Column:
        """The indexed tokens: without stop words, lower-cased and stemmed."""
        found = self.surface(text)
        found = without_stopwords(found, list(self.stop)) if self.stop else found
        return stem_array(found) if self.stem else F.transform(found, F.lower)

    def sql(self, expression: str) -> str:
        """tokens() of an SQL expression before stemming, as a DuckDB list."""
        if self.abbreviations is not None:
            raise ValueError("learned abbreviations have no SQL form")
        x = f"coalesce({expression}, '')"
        if self.split == "treebank":
            for pattern, new in TREEBANK:
                quoted = pattern.replace("'", "''")
                x = f"regexp_replace({x}, '{quoted}', '{new}', 'g')"
        x = f"list_filter(string_split_regex({x}, '{BLANKS}'), lambda t: t <> '')"
        if self.keep == "letters":
            x = f"list_filter(list_transform({x}, lambda t: regexp_replace(t, '\\P{{L}}', '', 'g')), lambda t: t <> '')"
        elif self.keep == "punct_drop":
            x = f"list_filter({x}, lambda t: NOT regexp_matches(t, '{_PUNCT}'))"
        else:
            x = f"list_filter({x}, lambda t: instr('{PUNCTUATION.replace(chr(39), chr(39) * 2)}', t) = 0)"
        if self.stop:
            x = f"list_filter({x}, lambda t: NOT list_contains([{', '.join(repr(w) for w in self.stop)}], lower(t)))"
        return f"list_transform({x}, lambda t: lower(t))"

    def sql_stemmed(self, query: str, column: str = "term") -> str:
        """An SQL query with its term replaced by the stem."""
        if not self.stem:
            return query
        table = stem_sql(f"(SELECT DISTINCT {column} FROM ({query}))", column, "_stem")
        return f"SELECT * EXCLUDE (_stem) REPLACE (_stem AS {column}) FROM ({query}) JOIN ({table}) USING ({column})"


CANONICAL = Analyzer()
WS = Analyzer("ws", "letters", (), False)
WS_STOP = Analyzer("ws", "letters", tuple(ENGLISH), False)
PUNCT_DROP = Analyzer("treebank", "punct_drop", tuple(ENGLISH), True)
PLAIN_TOPIC = Analyzer("treebank", "punct_substring", (), True)
