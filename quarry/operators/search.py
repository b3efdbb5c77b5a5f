"""Ranked and Boolean retrieval over the index tables, for tables of queries.

Queries are rows (query_id, text, relevant). Their analysis, their terms and
their clauses are columns and joins like all else, so a batch may be of any
size; terms are broadcast to the postings up to a checked size and shuffled
beyond it. A query that can't be answered gives a row with its error and leaves
the others alone.

Headers of postings blocks are met first. A conjunction opens blocks in which
all its clauses overlap. For the best k of a query, a block range is bounded by
the sum of its terms' largest weights: the k ranges with the highest bounds are
scored, their kth score is a threshold, and of the other ranges those are
opened that can reach it. Nothing is cut that could matter, ties included.

For a batch of many terms nearly all blocks are wanted by some query. They are
dealt by range of ids once, as they are stored; a task has all postings of its
documents, so it scores them for all queries, and only its best leave it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.analysis import CANONICAL, Analyzer, is_quoted
from quarry.functions.stem import stems
from quarry.plans.checkpoints import checkpointed
from quarry.plans.index import HEAD, KEYS, Index, unpack
from quarry.plans.ranges import ranks

QUERIES = "query_id long, text string, relevant array<long>"
BATCH = 1_000  #: rows of query terms beyond which blocks are read once for all queries, not chosen for each
RANGES = 4_096  #: documents whose postings a task scores, or so, for such batches
SMALL = 100_000  #: rows of query terms up to which they are broadcast (some MB)
ERROR = "Boolean query contains invalid item"

#: The word AND, with letters of any script around it being letters.
WORD_AND = "(^|[^\\p{L}\\p{N}_])AND($|[^\\p{L}\\p{N}_])"

Queries = DataFrame | Sequence[tuple[int, str]]


class InvalidQuery(ValueError):
    pass


def query_table(spark: SparkSession, queries: Queries) -> DataFrame:
    """query_id, text, relevant; a DataFrame may lack relevant."""
    if not isinstance(queries, DataFrame):
        return spark.createDataFrame([(q, t, []) for q, t in queries], QUERIES)
    relevant = F.col("relevant") if "relevant" in queries.columns else F.array()
    return queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("text").cast("string").alias("text"), F.coalesce(relevant.cast("array<long>"), F.array().cast("array<long>")).alias("relevant"))


def is_boolean(text: str, as_coded: bool = False) -> bool:
    """A query is Boolean if it holds the word AND (as_coded: the letters)."""
    return "AND" in text if as_coded else re.search(r"\bAND\b", text) is not None


def boolean_column(text: Column, as_coded: bool = False) -> Column:
    """is_boolean of a column; null texts aren't."""
    return F.coalesce(text.contains("AND") if as_coded else text.rlike(WORD_AND), F.lit(False))


def analysed(queries: DataFrame, analyzer: Analyzer, drop_stopwords: bool = False) -> DataFrame:
    """query_id, quoted, pos, raw, term: tokens as written and as indexed. Stop
    words stay unless asked, as the index alone leaves them out."""
    rows = queries.select("query_id", is_quoted(F.coalesce("text", F.lit(""))).alias("quoted"), F.posexplode(analyzer.surface(F.col("text"))).alias("pos", "raw"))
    if drop_stopwords and analyzer.stop:
        rows = rows.where(~F.lower("raw").isin(list(analyzer.stop)))
    return stems(rows, "raw", "term") if analyzer.stem else rows.withColumn("term", F.lower("raw"))


def free_text_terms(spark: SparkSession, queries: Queries, analyzer: Analyzer, thesaurus: DataFrame | None = None, zones: bool = True, zone_boost: float = 3.0) -> DataFrame:
    """The weighted terms of free-text queries. Tokens count once each as they
    are written, so forms that fold together count severally; quoted queries
    have none; synonyms are looked up in the body."""
    tokens = analysed(query_table(spark, queries), analyzer)
    base = tokens.where(~F.col("quoted")).select("query_id", "raw", "term").distinct().select("query_id", "term")
    parts = base.select("query_id", F.lit("body").alias("zone"), "term", F.lit(1.0).alias("boost"))
    if thesaurus is not None:
        more = base.join(thesaurus, "term").select("query_id", F.explode("synonyms").alias("term"))
        parts = parts.union(more.select("query_id", F.lit("body"), "term", F.lit(1.0)))
    if zones:
        for z in ("court", "title"):
            parts = parts.union(base.select("query_id", F.lit(z), "term", F.lit(float(zone_boost))))
    return parts.groupBy("query_id", "zone", F.lit("uni").alias("kind"), "term").agg(F.sum("boost").alias("boost"))


def few(rows: DataFrame) -> bool:
    """Whether rows made of query texts are so few that they are broadcast."""
    return len(rows.select(F.lit(1)).take(SMALL + 1)) <= SMALL


def _hinted(rows: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(rows) if small else rows


def _best(scores: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    """The k best of each query, ranked; tasks keep k rows a query before the shuffle."""
    order = [F.col("score").asc() if ascending else F.col("score").desc(), F.col("doc_id")]
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _ranked(scores: DataFrame, ascending: bool = False, limit: int | None = None) -> DataFrame:
    """query_id, rank, doc_id, score; ties by doc_id."""
    if limit is not None:
        return _best(scores, limit, ascending)
    order = F.col("score").asc() if ascending else F.col("score").desc()
    return ranks(scores, "query_id", order, "doc_id").select("query_id", "rank", "doc_id", "score")


def heads(index: Index, terms: DataFrame, small: bool = False) -> DataFrame:
    """Headers of the blocks of weighted terms: the columns of terms, HEAD.
    small: broadcast the terms."""
    return index.blocks.select(*KEYS, *HEAD).join(_hinted(terms, small), list(KEYS))


def opened(index: Index, terms: DataFrame, small: bool = False, chosen: DataFrame | None = None) -> DataFrame:
    """The terms' postings, with the columns of terms; chosen: (query_id,
    block) of the blocks to open."""
    also = [c for c in terms.columns if c not in KEYS]
    if chosen is not None:
        return unpack(index.blocks.join(terms.join(chosen, "query_id"), [*KEYS, "block"]), *also)
    if index.stored is not None:
        return unpack(index.stored.join(_hinted(terms, small), list(KEYS)), *also)
    return index.postings.join(_hinted(terms, small), list(KEYS))


def batched(index: Index, terms: DataFrame, small: bool) -> bool:
    """Whether a stored index is read once for all queries of these terms."""
    return index.stored is not None and small and len(terms.select(F.lit(1)).take(BATCH + 1)) > BATCH


def dealt(index: Index, terms: DataFrame) -> DataFrame:
    """The postings of a batch's terms, with the columns of terms, by block:
    all of a document's lie in one task. Terms are broadcast."""
    parts = max(index.stats.sparkSession.sparkContext.defaultParallelism, -(-index.stats.first()["n_docs"] // RANGES))
    blocks = index.stored.repartition(parts, "block").join(F.broadcast(terms), list(KEYS))
    return unpack(blocks, "block", *[c for c in terms.columns if c not in KEYS])


def _document(hits: DataFrame) -> list[str]:
    """What a query's score of a document is grouped by; block is known by doc_id."""
    return [c for c in ("block", "query_id", "doc_id") if c in hits.columns]


def _sums(hits: DataFrame) -> DataFrame:
    return hits.groupBy(*_document(hits)).agg(F.round(F.sum(F.col("wtf").cast("double") * F.col("w")), 6).alias("score")).select("query_id", "doc_id", "score")


def bounds(index: Index, terms: DataFrame, small: bool = False) -> DataFrame:
    """query_id, block, bound: the most that a document of a block range can
    score. terms: with the weight w >= 0 of each."""
    return heads(index, terms, small).groupBy("query_id", "block").agg(F.sum(F.col("top").cast("double") * F.col("w")).alias("bound"))


def top_blocks(index: Index, terms: DataFrame, k: int, small: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scores of the first k block ranges by bound, the ranges beyond them
    that can reach the kth of these scores)."""
    limits = checkpointed(bounds(index, terms, small))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    first = checkpointed(limits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("query_id", "block"))
    scores = checkpointed(_sums(opened(index, terms, chosen=first)))
    kth = _best(scores, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = limits.join(first, ["query_id", "block"], "left_anti").join(kth, "query_id", "left")
    return scores, rest.where(F.col("least").isNull() | (F.col("bound") + 1e-6 >= F.col("least"))).select("query_id", "block")  # scores are rounded


def weighted(index: Index, terms: DataFrame, small: bool = False) -> DataFrame:
    """Terms with the weight w = idf x boost; unknown ones go."""
    return index.dictionary.join(_hinted(terms, small), list(KEYS)).select("query_id", *KEYS, (F.col("idf") * F.col("boost")).alias("w"))


def free_text(spark: SparkSession, index: Index, queries: Queries, analyzer: Analyzer, thesaurus: DataFrame | None = None, zones: bool = True, zone_boost: float = 3.0, as_coded: bool = False, limit: int | None = None) -> DataFrame:
    """query_id, rank, doc_id, score: documents that hold a query term of some
    zone, by the sum of (1 + log10 tf) x idf x boost. as_coded: worst first.
    limit: the best so many, without scoring blocks that can't reach them."""
    terms = checkpointed(free_text_terms(spark, queries, analyzer, thesaurus, zones, zone_boost))
    index, small = index.narrowed(terms), few(terms)
    if limit is None or as_coded or index.stored is None or zone_boost < 0:
        return _ranked(_sums(opened(index, weighted(index, terms, small), small)), as_coded, limit)
    terms = checkpointed(weighted(index, terms, small))
    if batched(index, terms, small):
        return _best(_sums(dealt(index, terms)), limit)
    scores, rest = top_blocks(index, terms, limit, small)
    return _best(scores.union(_sums(opened(index, terms, chosen=rest))), limit)


def clauses(spark: SparkSession, queries: Queries, analyzer: Analyzer, drop_stopwords: bool = False) -> DataFrame:
    """query_id, phrases (the words of each conjunct in order), error: not
    null if a conjunct has no word or more than three."""
    table = query_table(spark, queries)
    tokens = analysed(table, analyzer, drop_stopwords)
    listed = tokens.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "raw", "term"))).alias("t"))
    listed = table.select("query_id").join(listed, "query_id", "left")
    empty = F.array(F.array().cast("array<string>"))
    add = lambda a, x: F.when(x["raw"] == "AND", F.concat(a, empty)).otherwise(F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.array_append(F.element_at(a, -1), x["term"]))))
    phrases = F.aggregate(F.coalesce("t", F.array().cast("array<struct<pos:int,raw:string,term:string>>")), empty, add)
    rows = listed.select("query_id", phrases.alias("phrases"))
    return rows.withColumn("error", F.when(F.exists("phrases", lambda p: ~F.size(p).between(1, 3)), F.lit(ERROR)))


def items(phrases: DataFrame) -> DataFrame:
    """query_id, clause_id, item_id, kind, term of valid queries: a conjunction
    of clauses, each a disjunction of its phrase's bigrams and words. Queries of
    fewer than three items and connectives have none."""
    item = lambda c, kind, t: F.struct(c.cast("long").alias("clause_id"), F.lit(kind).alias("kind"), t.alias("term"))
    pairs = lambda p: F.when(F.size(p) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    made = F.flatten(F.transform("phrases", lambda p, c: F.concat(F.transform(pairs(p), lambda t: item(c, "bi", t)), F.transform(p, lambda t: item(c, "uni", t)))))
    rows = phrases.where("error IS NULL").select("query_id", made.alias("i")).where(F.size("i") >= 2)
    rows = rows.select("query_id", F.posexplode("i").alias("item_id", "i"))
    return rows.select("query_id", "i.clause_id", F.col("item_id").cast("long").alias("item_id"), "i.kind", "i.term")


def boolean_plan(spark: SparkSession, queries: Queries, analyzer: Analyzer, drop_stopwords: bool = False) -> DataFrame:
    return items(clauses(spark, queries, analyzer, drop_stopwords))


def _zoned(index: Index, wanted: DataFrame, small: bool) -> DataFrame:
    """Items with the zone they are looked up in (the first of court, title,
    body that holds them) and its idf (w); unknown ones go."""
    order = F.when(F.col("zone") == "court", 1).when(F.col("zone") == "title", 2).otherwise(3)
    zones = index.dictionary.join(_hinted(wanted.select("kind", "term").distinct(), small), ["kind", "term"])
    zones = zones.groupBy("kind", "term").agg(F.min_by(F.struct("zone", "idf"), order).alias("z"))
    return wanted.join(zones, ["kind", "term"]).select("query_id", "z.zone", "kind", "term", "clause_id", F.col("z.idf").alias("w"))


def overlapping(index: Index, zoned: DataFrame, need: DataFrame, small: bool = False) -> DataFrame:
    """query_id, block: block ranges in which every clause has postings, and in
    a common range of ids."""
    one = heads(index, zoned, small).groupBy("query_id", "block", "clause_id").agg(F.min("first").alias("lo"), F.max("last").alias("hi"))
    every = one.groupBy("query_id", "block").agg(F.count("*").alias("n"), F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    return every.join(need, "query_id").where("n = need AND lo <= hi").select("query_id", "block")


def conjunction(index: Index, zoned: DataFrame, need: DataFrame, small: bool = False) -> DataFrame:
    """query_id, doc_id, score: documents that match every clause. zoned:
    query_id, zone, kind, term, clause_id, w; need: clauses of each query. A
    stored index opens overlapping blocks alone."""
    if batched(index, zoned, small):
        hits, need = dealt(index, zoned), F.broadcast(need)
    else:
        hits = opened(index, zoned, small, overlapping(index, zoned, need, small) if index.stored is not None else None)
    sums = hits.groupBy(*_document(hits)).agg(F.count_distinct("clause_id").alias("n"), F.round(F.sum(F.col("wtf").cast("double") * F.col("w")), 6).alias("score"))
    return sums.join(need, "query_id").where("n = need").select("query_id", "doc_id", "score")


def boolean(spark: SparkSession, index: Index, queries: Queries, analyzer: Analyzer, limit: int | None = None, drop_stopwords: bool = False, as_coded: bool = False, strict: bool = True) -> DataFrame:
    """query_id, rank, doc_id, score: documents that match every clause. A word
    is looked up in the first zone of court, title, body that holds it. One
    aggregate does all: matched clauses are counted, item weights summed.
    as_coded: no rows. strict: an invalid query raises InvalidQuery, else it
    has no rows (answer() tells its error)."""
    phrases = checkpointed(clauses(spark, queries, analyzer, drop_stopwords))
    if strict and (wrong := phrases.where("error IS NOT NULL").select("error").first()):
        raise InvalidQuery(wrong["error"])
    wanted = checkpointed(items(phrases))
    need = wanted.groupBy("query_id").agg(F.count_distinct("clause_id").alias("need"))
    index, small = index.narrowed(wanted), few(wanted)
    found = conjunction(index, checkpointed(_zoned(index, wanted, small)), need, small)
    return _ranked(found.where(F.lit(not as_coded)), limit=limit)


def intersect_sum(a: DataFrame, b: DataFrame) -> DataFrame:
    """AND of two (doc_id, score) lists: documents of both, scores added."""
    return a.alias("a").join(b.alias("b"), "doc_id").select("doc_id", (F.col("a.score") + F.col("b.score")).alias("score"))


def union_sum(a: DataFrame, b: DataFrame) -> DataFrame:
    """OR of two (doc_id, score) lists: documents of either, scores added."""
    return a.select("doc_id", "score").unionByName(b.select("doc_id", "score")).groupBy("doc_id").agg(F.sum("score").alias("score"))


def with_feedback(result: DataFrame, relevant: DataFrame) -> DataFrame:
    """The ranking with known relevant documents first, each part in its own
    order. relevant: query_id, doc_id; ids that aren't found are ignored."""
    known = relevant.select("query_id", "doc_id").distinct().withColumn("_r", F.lit(0))
    rows = result.withColumnRenamed("rank", "_rank").join(known, ["query_id", "doc_id"], "left").withColumn("_r", F.coalesce("_r", F.lit(1)))
    return ranks(rows, "query_id", "_r", "_rank").select("query_id", "rank", "doc_id", "score")


def top(result: DataFrame, k: int = 10) -> DataFrame:
    """The k best rows of all queries together: a heap a task, then one of heaps."""
    return result.orderBy(F.desc("score"), "query_id", "doc_id").limit(k)


def answer(spark: SparkSession, index: Index, queries: Queries, analyzer: Analyzer = CANONICAL, thesaurus: DataFrame | None = None, as_coded: bool = False, limit: int | None = None) -> DataFrame:
    """query_id, rank, doc_id, score, error of a table of queries: each free
    text or Boolean by is_boolean, its relevant documents first where found.
    limit is of the ranking after feedback. An invalid query has one row, of
    its error; one without hits has none."""
    table = query_table(spark, queries)
    mode = boolean_column(F.col("text"), as_coded)
    known = table.select("query_id", F.explode("relevant").alias("doc_id"))
    feedback = bool(known.take(1))
    first = None if feedback else limit  # feedback may lift documents from far down
    found = free_text(spark, index, table.where(~mode), analyzer, thesaurus, as_coded=as_coded, limit=first)
    found = found.union(boolean(spark, index, table.where(mode), analyzer, as_coded=as_coded, limit=first, strict=False))
    found = with_feedback(found, known) if feedback else found
    found = found.where(F.col("rank") <= limit) if limit is not None else found
    wrong = clauses(spark, table.where(mode), analyzer).where("error IS NOT NULL")
    none = lambda kind: F.lit(None).cast(kind)
    return found.withColumn("error", none("string")).union(wrong.select("query_id", none("long"), none("long"), none("double"), "error"))


def search(spark: SparkSession, index: Index, text: str, relevant: tuple[int, ...] = (), analyzer: Analyzer | None = None, thesaurus: DataFrame | None = None, as_coded: bool = False, limit: int | None = None) -> DataFrame:
    """One query: free text or Boolean by is_boolean, then feedback."""
    analyzer = analyzer or CANONICAL
    first = None if relevant else limit
    if is_boolean(text, as_coded):
        found = boolean(spark, index, [(0, text)], analyzer, as_coded=as_coded, limit=first)
    else:
        found = free_text(spark, index, [(0, text)], analyzer, thesaurus, as_coded=as_coded, limit=first)
    if relevant:
        found = with_feedback(found, spark.createDataFrame([(0, int(r)) for r in relevant], "query_id long, doc_id long"))
    return found.where(F.col("rank") <= limit) if limit is not None else found
