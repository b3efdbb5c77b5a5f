"""Where sentences end: abbreviations learned from the corpus itself.

A word that nearly always carries a period, is short and may hold periods
inside is an abbreviation (Kiss and Strunk, 2006). The evidence is a
log-likelihood ratio of two hypotheses, that a period follows the word as often
as any other word or nearly always, scaled by length, inner periods and
occurrences without one. It is one aggregate over the corpus's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "[ \\t\\n\\x0B\\f\\r]+"
#: Fixed values of the published method: the rate of periods after an abbreviation, and the score from which a word is one.
RATE, LEAST = 0.99, 0.3
#: Abbreviations that an analyzer takes, at most.
MOST = 100_000
#: Opening marks before a word, and what may follow its period.
_OPEN, _CLOSE = "^[(\\[{<\"'`]+", "[)\\]}>\"',;:]*$"
_WORD = "^[\\p{L}.\\-]*\\p{L}$"


def word_counts(text: Column, rows: DataFrame) -> DataFrame:
    """word, with_period, without: lower-cased words of letters, inner periods
    and hyphens, by whether a period follows."""
    plain = F.regexp_replace(F.regexp_replace(F.col("w"), _OPEN, ""), _CLOSE, "")
    words = rows.select(F.explode(F.split(F.coalesce(text, F.lit("")), BLANKS)).alias("w")).select(F.lower(plain).alias("w"))
    words = words.select(F.regexp_replace("w", "\\.$", "").alias("word"), F.col("w").endswith(".").alias("dot"))
    words = words.where(F.col("word").rlike(_WORD))
    return words.groupBy("word").agg(F.count_if("dot").alias("with_period"), F.count_if(~F.col("dot")).alias("without"))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """word, with_period, without, score of the words that a period follows."""
    totals = counts.agg(F.sum("with_period").cast("double").alias("dots"), F.sum(F.col("with_period") + F.col("without")).cast("double").alias("all"))
    rows = counts.where("with_period > 0").crossJoin(F.broadcast(totals))  # one row
    a, n = F.col("with_period").cast("double"), (F.col("with_period") + F.col("without")).cast("double")
    p = F.least(F.col("dots") / F.col("all"), F.lit(RATE))
    alike = lambda q: a * F.log(q) + (n - a) * F.log(1 - q)
    ratio = -2 * (alike(p) - alike(F.lit(RATE)))
    letters = F.length(F.regexp_replace("word", "\\.", "")).cast("double")
    inner = F.length("word") - letters + 1
    score = ratio * F.exp(-letters) * inner * F.pow(letters, -F.col("without").cast("double"))
    return rows.select("word", "with_period", "without", score.alias("score"))


def abbreviations(scores: DataFrame, least: float = LEAST) -> tuple[str, ...]:
    """The words whose score reaches least, for an analyzer. More than MOST of
    them is an error: their set is part of every task's expressions."""
    found = [r["word"] for r in scores.where(F.col("score") >= least).select("word").orderBy("word").take(MOST + 1)]
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} abbreviations; raise the least score")
    return tuple(found)


#: Stands for a period that is no sentence's end, while a text is split.
KEPT = "\ue000"


def keep_periods(text: Column, known: tuple[str, ...]) -> Column:
    """text with the periods of abbreviations, initials (`J.`) and letters with
    inner periods (`U.S.`) replaced by KEPT, but not at the text's end."""
    tokens = F.split(text, " ")

    def one(t: Column, i: Column) -> Column:
        word = F.lower(F.regexp_replace(F.regexp_replace(t, _OPEN, ""), "\\.[)\\]}>\"',;:]*$", ""))
        short = word.rlike("^\\p{L}(\\.\\p{L})*$")
        stays = t.rlike("\\.[)\\]}>\"',;:]*$") & ((word.isin(list(known)) | short) if known else short)
        return F.when(stays & (i < F.size(tokens) - 1), F.regexp_replace(t, "\\.([)\\]}>\"',;:]*)$", KEPT + "$1")).otherwise(t)

    return F.array_join(F.transform(tokens, one), " ")


def scores_sql(text: str = "text", table: str = "documents") -> str:
    """abbreviation_scores of a table's texts in DuckDB's SQL."""
    opens, closes = _OPEN.replace("'", "''"), _CLOSE.replace("'", "''")
    return f"""WITH w AS (SELECT lower(regexp_replace(regexp_replace(unnest(string_split_regex(coalesce({text}, ''), '{BLANKS}')), '{opens}', ''), '{closes}', '')) AS w FROM {table}),
c AS (SELECT regexp_replace(w, '\\.$', '') AS word, count(*) FILTER (ends_with(w, '.')) AS a, count(*) FILTER (NOT ends_with(w, '.')) AS b FROM w GROUP BY 1),
k AS (SELECT * FROM c WHERE regexp_matches(word, '{_WORD}')),
t AS (SELECT *, least((SELECT sum(a) FROM k)::DOUBLE / (SELECT sum(a + b) FROM k)::DOUBLE, {RATE}) AS p, length(replace(word, '.', ''))::DOUBLE AS l FROM k WHERE a > 0)
SELECT word, a AS with_period, b AS without, -2 * (a * ln(p) + b * ln(1 - p) - a * ln({RATE}) - b * ln(1 - {RATE}::DOUBLE)) * exp(-l) * (length(word) - l + 1) * pow(l, -b::DOUBLE) AS score FROM t"""
