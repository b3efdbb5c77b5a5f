"""Thesaurus builders: (term, synonyms) tables from lines of text.

A line is `headword, part of speech, synonym, ...`. Section lines and lines of
one character are left out, and so is all from the ending line on. Entries are
phrases of one or two words, without stop words in whatever case, each stemmed
as one string; the headword that others are synonyms of stays as it is,
whatever it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.stem import stems
from quarry.functions.stopwords import ENGLISH

#: What section lines hold, and the line that ends a thesaurus.
SECTIONS, LAST = ("ASSOCIATED CONCEPTS", "FOREIGN PHRASES", "Generally", "Specifically"), "LASTLINE"


def entries(lines: DataFrame, stop: list[str] | None = None, stem: bool = True, keep_head: bool = False) -> DataFrame:
    """line_no, k, term: the phrases of every entry, in order. Lines with fewer
    than two fields have none. keep_head: headwords aren't filtered."""
    end = lines.where(F.col("line").contains(LAST)).agg(F.min("line_no").alias("_end"))
    rows = lines.crossJoin(F.broadcast(end)).where(F.col("_end").isNull() | (F.col("line_no") < F.col("_end")))  # one row
    rows = rows.where((F.length("line") > 1) & ~F.col("line").rlike("|".join(SECTIONS)))
    fields = F.split(F.trim("line"), ", ")
    rows = rows.where(F.size(fields) >= 2).select("line_no", fields.alias("f"))
    head, rest = F.slice("f", 1, 1), F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0)))
    fits = lambda w: (F.size(F.split(w, " ")) < 3) & ~F.lower(w).isin(stop or ENGLISH)
    kept = F.concat(head if keep_head else F.filter(head, fits), F.filter(rest, fits))
    rows = rows.select("line_no", F.posexplode(kept).alias("k", "term"))
    return stems(rows, "term", "stem").select("line_no", "k", F.col("stem").alias("term")) if stem else rows.select("line_no", "k", F.lower("term").alias("term"))


def build(lines: DataFrame, mode: str = "headword", stop: list[str] | None = None, stem: bool = True) -> DataFrame:
    """term, synonyms. headword: the headword of an entry maps to the others, a later entry replacing an earlier one; symmetric: each phrase maps
    to all others of its entry, the first entry staying."""
    rows = entries(lines, stop, stem, keep_head=mode == "headword")
    pairs = rows.alias("a").join(rows.alias("b"), "line_no").select("line_no", F.col("a.k").alias("k"), F.col("a.term").alias("term"), F.col("b.k").alias("j"), F.col("b.term").alias("other"))
    if mode == "headword":
        first = rows.groupBy("line_no").agg(F.min("k").alias("k"))
        pairs = pairs.join(first, ["line_no", "k"])
    elif mode != "symmetric":
        raise ValueError("mode is headword or symmetric")
    lists = pairs.groupBy("line_no", "k", "term").agg(F.array_sort(F.collect_list(F.when(F.col("k") != F.col("j"), F.struct("j", "other")))).alias("s"))
    lists = lists.select("term", F.struct("line_no", "k").alias("at"), F.transform("s", lambda x: x["other"]).alias("synonyms"))
    pick = F.max_by if mode == "headword" else F.min_by
    return lists.groupBy("term").agg(pick("synonyms", "at").alias("synonyms"))


def save(table: DataFrame, path: str) -> None:
    """Writes a thesaurus once, for searches to read; sorted by term, so that lookups skip row groups."""
    table.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """term, synonyms of a stored thesaurus."""
    return spark.read.parquet(path)
