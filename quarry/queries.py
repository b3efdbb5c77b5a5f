"""The registered queries of the retrieval engine, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import analysis as an
from quarry.functions import sentences
from quarry.functions.stem import stem_sql, stems
from quarry.operators import plsa, search, thesaurus
from quarry.plans.checkpoints import checkpointed, session_folder
from quarry.plans.index import Index, build, counts, first_seen, from_documents, spread, token_rows
from quarry.sources import corpus as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def corpus_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(spread(docs_of(spark, sf_dir)))


def register(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


CORPUS = "corpus AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS content, lang AS court FROM documents)"


def index_sql(analyzer: an.Analyzer, zones: tuple[str, ...] = ("body", "title", "court")) -> str:
    """CTEs corpus, tok, keys, n, postings, dictionary."""
    column = {"body": "content", "title": "title", "court": "court"}
    lists = " UNION ALL ".join(f"SELECT doc_id, '{z}' AS zone, {analyzer.sql(column[z])} AS t FROM corpus" for z in zones)
    rows = analyzer.sql_stemmed("SELECT doc_id, zone, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM lists")
    return f"""{CORPUS}, lists AS ({lists}), tok AS ({rows}),
keys AS (SELECT doc_id, zone, 'uni' AS kind, term FROM tok UNION ALL
  SELECT doc_id, zone, 'bi', term || ' ' || nxt FROM (SELECT *, lead(term) OVER (PARTITION BY doc_id, zone ORDER BY pos) AS nxt FROM tok WHERE zone = 'body') WHERE nxt IS NOT NULL),
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
postings AS (SELECT zone, kind, term, doc_id, CAST(1 + log10(count(*)) AS FLOAT) AS wtf FROM keys GROUP BY ALL),
dictionary AS (SELECT zone, kind, term, count(*) AS df, ln((SELECT n FROM n)::DOUBLE) - ln(count(*)::DOUBLE) AS idf FROM postings GROUP BY ALL)"""


# tokens and terms

def _tokens(analyzer: an.Analyzer) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = token_rows(corpus_of(spark, sf_dir), analyzer, ("body",))
        return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "term")

    return run


def _tokens_sql(analyzer: an.Analyzer) -> str:
    rows = analyzer.sql_stemmed("SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM lists")
    return f"WITH {CORPUS}, lists AS (SELECT doc_id, {analyzer.sql('content')} AS t FROM corpus) SELECT doc_id, CAST(pos AS BIGINT) AS pos, term FROM ({rows})"


TREEBANK = an.Analyzer("treebank", "letters", (), False)
for _name, _a in {
    "tokens_ws": an.WS,
    "tokens_treebank": TREEBANK,
    "tokens_punct_drop": an.Analyzer("treebank", "punct_drop", (), False),
    "tokens_punct_substring": an.Analyzer("treebank", "punct_substring", (), False),
    "stopword_filter": an.WS_STOP,
    "tokens_canonical": an.CANONICAL,
}.items():
    register(_name, _tokens(_a), _tokens_sql(_a))


def stem_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = token_rows(corpus_of(spark, sf_dir), TREEBANK, ("body",)).select("term").distinct()
    return stems(words)


register("stem_vocab", stem_vocab, f"WITH {CORPUS}, lists AS (SELECT {TREEBANK.sql('content')} AS t FROM corpus), w AS (SELECT DISTINCT unnest(t) AS term FROM lists) {stem_sql('w')}")


def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(corpus_of(spark, sf_dir), an.WS_STOP, ("body",), ("bi",))[0].select("doc_id", "term", "tf")


register("bigrams", bigrams, f"WITH {index_sql(an.WS_STOP, ('body',))} SELECT doc_id, term, count(*) AS tf FROM keys WHERE kind = 'bi' GROUP BY ALL")


def is_int_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs_of(spark, sf_dir).select("doc_id", F.explode(an.treebank_words(F.col("text"))).alias("token"))
    return rows.where(an.is_int(F.col("token"))).groupBy("doc_id").agg(F.count("*").alias("n_ints"), F.sum(F.col("token").cast("int")).alias("total"))


register("is_int_tokens", is_int_tokens, f"WITH t AS (SELECT doc_id, unnest({an.Analyzer('treebank', 'punct_substring', (), False).sql('text')}) AS token FROM documents) SELECT doc_id, count(*) AS n_ints, CAST(sum(try_cast(ltrim(token, '+') AS INT)) AS BIGINT) AS total FROM t WHERE try_cast(ltrim(token, '+') AS INT) IS NOT NULL AND regexp_matches(token, '^[+-]?[0-9]+$') GROUP BY doc_id")


register(
    "abbreviation_scores",
    lambda spark, sf_dir: sentences.abbreviation_scores(sentences.word_counts(F.col("text"), spread(docs_of(spark, sf_dir)))).withColumn("score", F.round("score", 6)),
    f"SELECT * REPLACE (round(score, 6) + 0 AS score) FROM ({sentences.scores_sql()})",
)


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(corpus_of(spark, sf_dir), an.WS, ("body",), ("uni",))[0].select("doc_id", "term", "tf")


register("term_frequency", term_frequency, f"WITH {index_sql(an.WS, ('body',))} SELECT doc_id, term, count(*) AS tf FROM keys WHERE kind = 'uni' GROUP BY ALL")


def log_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counts(corpus_of(spark, sf_dir), an.WS, ("body",), ("uni",))[0]
    return rows.select("doc_id", "term", F.round(1 + F.log10("tf"), 6).alias("log_tf"), F.round(1 + F.log("tf"), 6).alias("ln_tf"))


register("log_tf", log_tf, f"WITH {index_sql(an.WS, ('body',))} SELECT doc_id, term, round(1 + log10(count(*)), 6) AS log_tf, round(1 + ln(count(*)), 6) AS ln_tf FROM keys WHERE kind = 'uni' GROUP BY ALL")


# the index

def _postings(zone: str, kind: str) -> Query:
    return lambda spark, sf_dir: build(corpus_of(spark, sf_dir), an.WS, (zone,), (kind,)).postings


for _zone, _kind, _name in (("body", "uni", "postings_body_uni"), ("body", "bi", "postings_body_bi"), ("title", "uni", "postings_title"), ("court", "uni", "postings_court")):
    register(_name, _postings(_zone, _kind), f"WITH {index_sql(an.WS, (_zone,))} SELECT * FROM postings WHERE kind = '{_kind}'")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(corpus_of(spark, sf_dir), an.WS).stats


register("corpus_stats", corpus_stats, "SELECT count(DISTINCT doc_id) AS n_docs FROM documents")


def dictionary_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(corpus_of(spark, sf_dir), an.WS).dictionary.withColumn("idf", F.round("idf", 6))


register("dictionary_df_idf", dictionary_df_idf, f"WITH {index_sql(an.WS)} SELECT zone, kind, term, df, round(idf, 6) AS idf FROM dictionary")


def dictionary_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(corpus_of(spark, sf_dir), an.CANONICAL).dictionary.withColumn("idf", F.round("idf", 6))


register("dictionary_canonical", dictionary_canonical, f"WITH {index_sql(an.CANONICAL)} SELECT zone, kind, term, df, round(idf, 6) AS idf FROM dictionary")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(corpus_of(spark, sf_dir), an.WS).vocabulary()


register("vocabulary", vocabulary, f"WITH {index_sql(an.WS)} SELECT kind, CASE WHEN zone = 'body' THEN '' ELSE zone || '#' END || term AS term FROM dictionary")


def _first_seen_sql(analyzer: an.Analyzer) -> str:
    return f"""WITH {index_sql(analyzer, ('body',))}, g AS (SELECT term, min(doc_id) AS doc_id, CAST(arg_min(pos, doc_id * 100000000 + pos) - 1 AS BIGINT) AS pos FROM tok GROUP BY term)
SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS term_id FROM g"""


STEMMED = an.Analyzer("ws", "letters", (), True)
for _name, _a in {"vocabulary_first_seen": an.WS, "vocabulary_first_seen_stems": STEMMED}.items():
    register(_name, lambda spark, sf_dir, a=_a: first_seen(corpus_of(spark, sf_dir), a), _first_seen_sql(_a))

LOOKUP = ["thst", "ndly", "shea", "zzzz"]
register("postings_lookup", lambda spark, sf_dir: build(corpus_of(spark, sf_dir), an.WS, only=LOOKUP).lookup(LOOKUP), f"WITH {index_sql(an.WS)} SELECT * FROM postings WHERE term IN ('thst', 'ndly', 'shea', 'zzzz')")


def stored_index(spark: SparkSession, sf_dir: str, analyzer: an.Analyzer) -> Index:
    """The index of all documents, written and read again."""
    path = f"{session_folder(spark)}/index-{uuid.uuid4().hex}"
    build(from_documents(docs_of(spark, sf_dir)), analyzer).save(path)
    return Index.load(spark, path)


register("postings_lookup_stored", lambda spark, sf_dir: stored_index(spark, sf_dir, an.WS).lookup(LOOKUP), ORACLE_SQL["postings_lookup"])


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = build(corpus_of(spark, sf_dir), an.WS, ("body",), ("uni",), only=["thst", "ndly"]).postings
    one = lambda t: p.where(F.col("term") == t).select("doc_id", F.col("wtf").cast("double").alias("score"))
    return one("thst"), one("ndly")


_TWO = f"WITH {index_sql(an.WS, ('body',))}, a AS (SELECT doc_id, wtf::DOUBLE AS score FROM postings WHERE kind = 'uni' AND term = 'thst'), b AS (SELECT doc_id, wtf::DOUBLE AS score FROM postings WHERE kind = 'uni' AND term = 'ndly')"
register("and_merge", lambda spark, sf_dir: search.intersect_sum(*_lists(spark, sf_dir)).withColumn("score", F.round("score", 6)), f"{_TWO} SELECT doc_id, round(a.score + b.score, 6) AS score FROM a JOIN b USING (doc_id)")
register("or_merge", lambda spark, sf_dir: search.union_sum(*_lists(spark, sf_dir)).withColumn("score", F.round("score", 6)), f"{_TWO} SELECT doc_id, round(sum(score), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id")


def _stored_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stored_index(spark, sf_dir, an.WS)
    rows = spark.createDataFrame([(0, "body", "uni", t, c, 1.0) for c, t in enumerate(("thst", "ndly"))], "query_id long, zone string, kind string, term string, clause_id long, w double")
    need = rows.groupBy("query_id").agg(F.count_distinct("clause_id").alias("need"))
    return search.conjunction(index.narrowed(rows), rows, need, small=True).select("doc_id", "score")


register("and_merge_stored", _stored_pair, ORACLE_SQL["and_merge"])


# free text

def free_text_sql(base: list[list[str]], analyzer: an.Analyzer = an.WS, zones: bool = True, ascending: bool = False, syn: list[tuple[int, str]] = ()) -> str:
    """base: for each query its terms, with repeats."""
    rows = [f"({q}, 'body', '{t}', 1.0)" for q, terms in enumerate(base) for t in terms] + [f"({q}, 'body', '{t}', 1.0)" for q, t in syn]
    rows += [f"({q}, '{z}', '{t}', 3.0)" for q, terms in enumerate(base) for t in terms for z in ("court", "title") if zones]
    return f"""WITH {index_sql(analyzer)},
q AS (SELECT query_id, zone, 'uni' AS kind, term, sum(boost)::DOUBLE AS boost FROM (VALUES {', '.join(rows)}) v(query_id, zone, term, boost) GROUP BY ALL),
scored AS (SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(sum(wtf::DOUBLE * idf * boost), 6) AS score FROM q JOIN postings USING (zone, kind, term) JOIN dictionary USING (zone, kind, term) GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score {'ASC' if ascending else 'DESC'}, doc_id) AS rank, doc_id, score FROM scored"""


def ranked(texts: list[str], analyzer: an.Analyzer = an.WS, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _free(spark, sf_dir, texts, analyzer, **options)

    return run


def _free(spark: SparkSession, sf_dir: str, texts: list[str], analyzer: an.Analyzer, synonyms: DataFrame | None = None, **options) -> DataFrame:
    specs = list(enumerate(texts))
    names = sorted({r["term"] for r in search.free_text_terms(spark, specs, analyzer, synonyms, options.get("zones", True)).collect()})  # of a few texts
    index = build(corpus_of(spark, sf_dir), analyzer, kinds=("uni",), only=names, checkpoint=True)
    return search.free_text(spark, index, specs, analyzer, synonyms, **options)


register("freetext_single", ranked(["thst"], zones=False), free_text_sql([["thst"]], zones=False))
register("freetext_multi", ranked(["thst ndly", "shea erth ntble"], zones=False), free_text_sql([["thst", "ndly"], ["shea", "erth", "ntble"]], zones=False))
register("freetext_zone_boost", ranked(["thst en", "ntble shea de"]), free_text_sql([["thst", "en"], ["ntble", "shea", "de"]]))
register("freetext_oov", ranked(["zzzz thst", "zzzz"]), free_text_sql([["zzzz", "thst"], ["zzzz"]]))
register("freetext_quoted_empty", ranked(['"thst ndly"', "shea"]), free_text_sql([[], ["shea"]]))
register("freetext_multiplicity", ranked(["Shea shea SHEA shea"]), free_text_sql([["shea", "shea", "shea"]]))
register("freetext_ascending_as_coded", ranked(["shea"], as_coded=True), free_text_sql([["shea"]], ascending=True))
register("freetext_canonical", ranked(["thst's reations, the Shea"], an.CANONICAL), free_text_sql([["thst", "reation", "the", "shea"]], an.CANONICAL))

THESAURUS = ["thst, n, ndly, shea erth", "FOREIGN PHRASES", "erth, v, ntble, thst", "Thst, n, the, en", "x", "alone", "state of mind, n, The, shea", "the, n, ndly", "LASTLINE", "after, n, end"]


register("freetext_stored", lambda spark, sf_dir: search.free_text(spark, stored_index(spark, sf_dir, an.WS), [(0, "erth shea")], an.WS), free_text_sql([["erth", "shea"]]))


def thesaurus_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(THESAURUS)), "line_no long, line string")


register("freetext_thesaurus", lambda spark, sf_dir: _free(spark, sf_dir, ["erth shea"], an.WS, thesaurus.build(thesaurus_lines(spark), stem=False)), free_text_sql([["erth", "shea"]], syn=[(0, "ntble"), (0, "thst")]))


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_no, line: each document's first six words as an entry with a phrase
    of two; every seventeenth is a section's; then the last line and one more."""
    w = docs_of(spark, sf_dir).select(F.col("doc_id").alias("line_no"), an.WS.tokens(F.substring_index("text", "\n", 1)).alias("w")).where(F.size("w") >= 6)
    at = lambda i: F.get("w", F.lit(i))
    line = F.concat_ws(", ", at(0), F.lit("n"), F.concat_ws(" ", at(1), at(2)), at(3), at(4), at(5))
    rows = w.select("line_no", F.concat(F.when(F.col("line_no") % 17 == 0, F.lit("Generally, ")).otherwise(F.lit("")), line).alias("line"))
    end = docs_of(spark, sf_dir).agg(F.max("doc_id").alias("m"))
    return rows.union(end.select(F.col("m") + 1, F.lit("LASTLINE"))).union(end.select(F.col("m") + 2, F.lit("after, n, end")))


def _stored_thesaurus(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    path = f"{session_folder(spark)}/thesaurus-{uuid.uuid4().hex}"
    thesaurus.save(thesaurus.build(_document_lines(spark, sf_dir), mode), path)
    return thesaurus.load(spark, path).select("term", F.array_join("synonyms", "|").alias("synonyms"))


def _thesaurus_sql(mode: str) -> str:
    stop = ", ".join(repr(w) for w in an.ENGLISH)
    head = "w[1:1]" if mode == "headword" else f"list_filter(w[1:1], lambda x: NOT list_contains([{stop}], x))"
    rows = f"""WITH l AS (SELECT doc_id AS line_no, {an.WS.sql("split_part(text, chr(10), 1)")} AS w FROM documents),
g AS (SELECT line_no, list_concat({head}, list_filter([w[2] || ' ' || w[3], w[4], w[5], w[6]], lambda x: NOT list_contains([{stop}], x))) AS g FROM l WHERE len(w) >= 6 AND line_no % 17 <> 0),
r AS (SELECT line_no, unnest(range(1, len(g) + 1)) AS k, unnest(g) AS word FROM g), st AS ({stem_sql('(SELECT DISTINCT word FROM r)', 'word', 'term')}), e AS (SELECT line_no, k, term FROM r JOIN st USING (word))"""
    if mode == "headword":
        return f"""{rows}, p AS (SELECT a.line_no, a.term, coalesce(string_agg(b.term, '|' ORDER BY b.k), '') AS s FROM e a LEFT JOIN e b ON a.line_no = b.line_no AND b.k > 1 WHERE a.k = 1 GROUP BY ALL)
SELECT term, arg_max(s, line_no) AS synonyms FROM p GROUP BY term"""
    return f"""{rows}, p AS (SELECT a.line_no, a.k, a.term, coalesce(string_agg(b.term, '|' ORDER BY b.k), '') AS s FROM e a LEFT JOIN e b ON a.line_no = b.line_no AND a.k <> b.k GROUP BY ALL)
SELECT term, arg_min(s, line_no * 100 + k) AS synonyms FROM p GROUP BY term"""


for _mode in ("headword", "symmetric"):
    register(f"thesaurus_{_mode}", lambda spark, sf_dir, m=_mode: _stored_thesaurus(spark, sf_dir, m), _thesaurus_sql(_mode))


# Boolean

def boolean_sql(items: list[tuple[int, str, str]], clauses: int) -> str:
    rows = ", ".join(f"({c}, {i}, '{k}', '{t}')" for i, (c, k, t) in enumerate(items))
    return f"""WITH {index_sql(an.WS)}, it AS (SELECT * FROM (VALUES {rows}) v(clause_id, item_id, kind, term)),
z AS (SELECT kind, term, min_by(zone, CASE zone WHEN 'court' THEN 1 WHEN 'title' THEN 2 ELSE 3 END) AS zone FROM dictionary WHERE term IN (SELECT term FROM it) GROUP BY ALL),
scored AS (SELECT doc_id, round(sum(wtf::DOUBLE * idf), 6) AS score FROM it JOIN z USING (kind, term) JOIN postings USING (zone, kind, term) JOIN dictionary USING (zone, kind, term) GROUP BY doc_id HAVING count(DISTINCT clause_id) = {clauses})
SELECT CAST(0 AS BIGINT) AS query_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored"""


def _boolean(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        items = [r["term"] for r in search.boolean_plan(spark, [(0, text)], an.WS).collect()]  # a query's items
        index = build(corpus_of(spark, sf_dir), an.WS, only=sorted(set(items)), checkpoint=True)
        return search.boolean(spark, index, [(0, text)], an.WS)

    return run


register("bool_two_terms", _boolean("thst AND erth"), boolean_sql([(0, "uni", "thst"), (1, "uni", "erth")], 2))
register("bool_bigram", _boolean('"thanedble the" AND anea'), boolean_sql([(0, "bi", "thanedble the"), (0, "uni", "thanedble"), (0, "uni", "the"), (1, "uni", "anea")], 2))
register("bool_trigram", _boolean("and attion to AND eriner"), boolean_sql([(0, "bi", "and attion"), (0, "bi", "attion to"), (0, "uni", "and"), (0, "uni", "attion"), (0, "uni", "to"), (1, "uni", "eriner")], 2))
register("bool_zone_preference", _boolean("en AND thst"), boolean_sql([(0, "uni", "en"), (1, "uni", "thst")], 2))
register("bool_unknown_term_empty", _boolean("zzzz AND thst"), boolean_sql([(0, "uni", "zzzz"), (1, "uni", "thst")], 2))
register("bool_single_word_empty", _boolean("thst"), f"{boolean_sql([(0, 'uni', 'thst')], 1)} WHERE 2 * (SELECT count(*) FROM it) - 1 >= 3")  # items and connectives

register("bool_stored", lambda spark, sf_dir: search.boolean(spark, stored_index(spark, sf_dir, an.WS), [(0, "thst AND erth")], an.WS), ORACLE_SQL["bool_two_terms"])


# tables of queries, drawn from the benchmark's texts

def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text: every three neighbouring words of an item as a query;
    by the place of the first: `a b c`, `a AND b c`, `a b AND c` or `a b c AND`,
    which is invalid."""
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", an.letters_only(an.words(F.lower("text"))).alias("w"))
    at = words.where(F.size("w") >= 3).select("item_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 3)).alias("i"))
    a, b, c = (F.get("w", F.col("i") + k) for k in range(3))
    text = F.when(F.col("i") % 4 == 0, F.concat_ws(" ", a, b, c)).when(F.col("i") % 4 == 1, F.concat_ws(" ", a, F.lit("AND"), b, c))
    text = text.when(F.col("i") % 4 == 2, F.concat_ws(" ", a, b, F.lit("AND"), c)).otherwise(F.concat_ws(" ", a, b, c, F.lit("AND")))
    return at.select((F.col("item_id") * 100_000 + F.col("i")).alias("query_id"), text.alias("text"))


DRAWN = f"""bw AS (SELECT item_id, {an.WS.sql('lower(text)')} AS w FROM benchmark),
bi AS (SELECT item_id, w, unnest(range(0, len(w) - 2)) AS i FROM bw),
bq AS (SELECT item_id * 100000 + i AS query_id, i % 4 AS form, w[i + 1] AS a, w[i + 2] AS b, w[i + 3] AS c FROM bi)"""
_TEXT = "CASE form WHEN 0 THEN a || ' ' || b || ' ' || c WHEN 1 THEN a || ' AND ' || b || ' ' || c WHEN 2 THEN a || ' ' || b || ' AND ' || c ELSE a || ' ' || b || ' ' || c || ' AND' END"
_ITEMS = """bx AS (SELECT query_id, form, unnest(CASE form WHEN 1 THEN [{'c': 0, 'k': 'uni', 't': a}, {'c': 1, 'k': 'bi', 't': b || ' ' || c}, {'c': 1, 'k': 'uni', 't': b}, {'c': 1, 'k': 'uni', 't': c}]
  ELSE [{'c': 0, 'k': 'bi', 't': a || ' ' || b}, {'c': 0, 'k': 'uni', 't': a}, {'c': 0, 'k': 'uni', 't': b}, {'c': 1, 'k': 'uni', 't': c}] END) AS x, unnest(range(4)) AS item_id FROM bq WHERE form IN (1, 2)),
it AS (SELECT query_id, CAST(x.c AS BIGINT) AS clause_id, CAST(item_id AS BIGINT) AS item_id, x.k AS kind, x.t AS term FROM bx)"""


def mode_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rules over drawn queries, and over the same with the word glued to its neighbour."""
    rows = drawn(spark, sf_dir)
    rows = rows.union(rows.select("query_id", F.regexp_replace("text", "AND ", "AND")))
    return rows.select("query_id", "text", search.boolean_column(F.col("text"), True).alias("as_coded"), search.boolean_column(F.col("text")).alias("is_boolean"))


register("mode_dispatch", mode_dispatch, f"WITH {DRAWN}, t AS (SELECT query_id, {_TEXT} AS text FROM bq), u AS (SELECT * FROM t UNION ALL SELECT query_id, replace(text, 'AND ', 'AND') FROM t) SELECT query_id, text, contains(text, 'AND') AS as_coded, regexp_matches(text, '{search.WORD_AND}') AS is_boolean FROM u")
register("bool_items", lambda spark, sf_dir: search.boolean_plan(spark, drawn(spark, sf_dir).where(search.boolean_column(F.col("text"))), an.WS), f"WITH {DRAWN}, {_ITEMS} SELECT * FROM it")


def batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every drawn query over a stored index, errors as rows."""
    return search.answer(spark, stored_index(spark, sf_dir, an.WS), drawn(spark, sf_dir), an.WS, limit=10)


register(
    "batch_answers",
    batch_answers,
    f"""WITH {index_sql(an.WS)}, {DRAWN}, {_ITEMS},
ft AS (SELECT DISTINCT query_id, unnest([a, b, c]) AS term FROM bq WHERE form = 0),
fq AS (SELECT query_id, zone, term, CASE zone WHEN 'body' THEN 1.0 ELSE 3.0 END AS boost FROM ft, (VALUES ('body'), ('title'), ('court')) v(zone)),
fs AS (SELECT query_id, doc_id, round(sum(wtf::DOUBLE * idf * boost::DOUBLE), 6) AS score FROM fq JOIN postings p USING (zone, term) JOIN dictionary d USING (zone, kind, term) WHERE kind = 'uni' GROUP BY ALL),
z AS (SELECT kind, term, min_by(zone, CASE zone WHEN 'court' THEN 1 WHEN 'title' THEN 2 ELSE 3 END) AS zone FROM dictionary WHERE term IN (SELECT term FROM it) GROUP BY ALL),
bs AS (SELECT query_id, doc_id, round(sum(wtf::DOUBLE * idf), 6) AS score FROM it JOIN z USING (kind, term) JOIN postings USING (zone, kind, term) JOIN dictionary USING (zone, kind, term) GROUP BY query_id, doc_id HAVING count(DISTINCT clause_id) = 2),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM (SELECT * FROM fs UNION ALL SELECT * FROM bs))
SELECT query_id, rank, doc_id, score, CAST(NULL AS VARCHAR) AS error FROM r WHERE rank <= 10 UNION ALL SELECT query_id, NULL, NULL, NULL, '{search.ERROR}' FROM bq WHERE form = 3""",
)


# results

def relevance_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _free(spark, sf_dir, ["shea ndly"], an.WS, zones=False)
    return search.with_feedback(found, docs_of(spark, sf_dir).where("doc_id % 7 = 0").select(F.lit(0).cast("long").alias("query_id"), "doc_id"))


register("relevance_feedback", relevance_feedback, f"SELECT query_id, row_number() OVER (ORDER BY (doc_id % 7 = 0) DESC, rank) AS rank, doc_id, score FROM ({free_text_sql([['shea', 'ndly']], zones=False)})")
register("topk_stored", lambda spark, sf_dir: search.free_text(spark, stored_index(spark, sf_dir, an.WS), list(enumerate(["thst erth", "shea", "ntble en"])), an.WS, limit=10), f"SELECT * FROM ({free_text_sql([['thst', 'erth'], ['shea'], ['ntble', 'en']])}) WHERE rank <= 10")
register("topk", lambda spark, sf_dir: search.top(_free(spark, sf_dir, ["thst erth"], an.WS), 10), f"SELECT * FROM ({free_text_sql([['thst', 'erth']])}) ORDER BY score DESC, query_id, doc_id LIMIT 10")
register("result_line", lambda spark, sf_dir: src.result_line(_free(spark, sf_dir, ["shea", "ndly erth"], an.WS)), f"SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY rank) AS line FROM ({free_text_sql([['shea'], ['ndly', 'erth']])}) GROUP BY query_id")
register("sample_rows", lambda spark, sf_dir: src.sample_rows(docs_of(spark, sf_dir), "doc_id"), "SELECT * FROM documents ORDER BY doc_id LIMIT 10")


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as quoted CSV and back."""
    path = f"{session_folder(spark)}/csv-{uuid.uuid4().hex}"
    rows = docs_of(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"), F.col("lang").alias("court"))
    src.write_csv(rows, path)
    return src.read_csv(spark, path, empty=True).select("document_id", F.md5(F.encode("content", "UTF-8")).alias("content_md5"), "court")


register("csv_corpus", _csv, "SELECT doc_id AS document_id, md5(text) AS content_md5, lang AS court FROM documents")


def _csv_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{session_folder(spark)}/sample-{uuid.uuid4().hex}"
    src.write_sample_csv(docs_of(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.col("text").alias("content")), "document_id", path)
    return src.read_csv(spark, path, empty=True)


register("sample_csv", _csv_sample, "SELECT doc_id AS document_id, text AS content FROM documents ORDER BY doc_id LIMIT 10")
register("row_slice", lambda spark, sf_dir: src.slice_rows(docs_of(spark, sf_dir).select("doc_id", "n_chars"), "doc_id", 60, 79), "SELECT * FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS line FROM documents) WHERE line BETWEEN 60 AND 79")
register("row_count", lambda spark, sf_dir: src.count_rows(docs_of(spark, sf_dir)), "SELECT count(*) AS n_rows FROM documents")


# topics

K = 4


def plsa_sql(rounds: int) -> str:
    """CTEs x, and l<i>, t<i> for each round."""
    digit = lambda i: f"(strpos('0123456789abcdef', substr(md5(term), {i}, 1)) - 1)"
    code = f"((({digit(1)} * 16 + {digit(2)}) * 16 + {digit(3)}) * 16 + {digit(4)})"
    ks = range(K)
    raw = lambda c: ", ".join(f"((({c} * 31 + {i * 17}) % 97) + 1)::DOUBLE AS r{i}" for i in ks)
    total = "(" + " + ".join(f"r{i}" for i in ks) + ")"
    norm = lambda source, p: f"SELECT term, {', '.join(f'CASE WHEN sum({p}{i}) OVER () = 0 THEN 1.0 / count(*) OVER () ELSE {p}{i} / sum({p}{i}) OVER () END AS t{i}' for i in ks)} FROM ({source})"
    out = [f"{index_sql(an.WS, ('body',))}", "x AS (SELECT doc_id, term, wtf::DOUBLE AS x FROM postings WHERE kind = 'uni')"]
    out.append(f"l0_ AS (SELECT doc_id, {', '.join(f'r{i} / {total} AS l{i}' for i in ks)} FROM (SELECT doc_id, {raw('doc_id')} FROM (SELECT DISTINCT doc_id FROM x)))")
    out.append(f"t0_ AS ({norm(f'SELECT term, {raw(code)} FROM (SELECT DISTINCT term FROM x)', 'r')})")
    den = " + ".join(f"l{i} * t{i}" for i in ks)
    for r in range(rounds + 1):
        out.append(f"p{r}_ AS (SELECT doc_id, term, x, den, {', '.join(f'CASE WHEN den = 0 THEN 0 ELSE l{i} * t{i} / den END AS p{i}' for i in ks)} FROM (SELECT *, {den} AS den FROM x JOIN l{r}_ USING (doc_id) JOIN t{r}_ USING (term)))")
        if r < rounds:
            out.append(f"t{r + 1}_ AS ({norm(f'SELECT term, {', '.join(f'sum(x * p{i}) AS s{i}' for i in ks)} FROM p{r}_ GROUP BY term', 's')})")
            out.append(f"l{r + 1}_ AS (SELECT doc_id, {', '.join(f'CASE WHEN sum(x) = 0 THEN 1.0 / {K} ELSE sum(x * p{i}) / sum(x) END AS l{i}' for i in ks)} FROM p{r}_ GROUP BY doc_id)")
    return "WITH " + ", ".join(out)


def _body(spark: SparkSession, sf_dir: str) -> Index:
    return build(corpus_of(spark, sf_dir), an.WS, ("body",), ("uni",))


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plsa.doc_term_matrix(_body(spark, sf_dir))


def _rounded(df: DataFrame, key: str, prefix: str, digits: int = 8) -> DataFrame:
    return df.select(key, *[F.round(f"{prefix}{i}", digits).alias(f"{prefix}{i}") for i in range(K)])


def _after(spark: SparkSession, sf_dir: str, n: int) -> tuple[DataFrame, DataFrame]:
    index = _body(spark, sf_dir)
    return plsa.rounds(plsa.doc_term_matrix(index), K, n, index.together)


def plsa_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _body(spark, sf_dir)
    seen = plsa.likelihoods(plsa.doc_term_matrix(index), K, 2, index.together)
    return spark.createDataFrame([(0, seen[0]), (2, seen[2])], "round long, loglik double").withColumn("loglik", F.round("loglik", 3))


_L, _T, _P = (", ".join(f"round({p}{i}, 8) AS {p}{i}" for i in range(K)) for p in "ltp")
register("doc_term_matrix", lambda spark, sf_dir: _matrix(spark, sf_dir).withColumn("x", F.round("x", 6)), f"{plsa_sql(0)} SELECT doc_id, term, round(x, 6) AS x FROM x")
register("plsa_init", lambda spark, sf_dir: _rounded(plsa.init(_matrix(spark, sf_dir), K)[0], "doc_id", "l"), f"{plsa_sql(0)} SELECT doc_id, {_L} FROM l0_")
register("plsa_init_terms", lambda spark, sf_dir: _rounded(plsa.init(_matrix(spark, sf_dir), K)[1], "term", "t"), f"{plsa_sql(0)} SELECT term, {_T} FROM t0_")


def plsa_e_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = checkpointed(_matrix(spark, sf_dir))  # read three times
    return plsa.e_step(x, *plsa.init(x, K), K).select("doc_id", "term", *[F.round(f"p{i}", 8).alias(f"p{i}") for i in range(K)])


register("plsa_e_step", plsa_e_step, f"{plsa_sql(0)} SELECT doc_id, term, {_P} FROM p0_")
register("plsa_m_step", lambda spark, sf_dir: _rounded(_after(spark, sf_dir, 1)[0], "doc_id", "l"), f"{plsa_sql(1)} SELECT doc_id, {_L} FROM l1_")
register("plsa_m_step_terms", lambda spark, sf_dir: _rounded(_after(spark, sf_dir, 1)[1], "term", "t"), f"{plsa_sql(1)} SELECT term, {_T} FROM t1_")
register("plsa_loglik", plsa_em, f"{plsa_sql(2)} SELECT 0::BIGINT AS round, round(sum(CASE WHEN den > 0 THEN x * ln(den) END), 3) AS loglik FROM p0_ UNION ALL SELECT 2, round(sum(CASE WHEN den > 0 THEN x * ln(den) END), 3) FROM p2_")


def plsa_stop_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rules with a tolerance that any gain is below: the start and two
    rounds are seen, as round 2 is the first to be compared."""
    index = _body(spark, sf_dir)
    rules = [plsa.PLSA(K, 9, 1e12, stop) for stop in ("gain", "change")]
    seen = plsa.seen_by(plsa.doc_term_matrix(index), rules, index.together)
    rows = [(rule.stop, i, v) for rule, found in zip(rules, seen) for i, v in enumerate(found)]
    return spark.createDataFrame(rows, "stop string, round long, loglik double").withColumn("loglik", F.round("loglik", 3))


_SEEN = " UNION ALL ".join(f"SELECT {i}::BIGINT AS round, round(sum(CASE WHEN den > 0 THEN x * ln(den) END), 3) AS loglik FROM p{i}_" for i in range(3))
register("plsa_stop_rules", plsa_stop_rules, f"{plsa_sql(2)}, seen AS ({_SEEN}) SELECT stop, round, loglik FROM seen, (VALUES ('gain'), ('change')) v(stop)")


def plsa_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = checkpointed(_matrix(spark, sf_dir))
    return plsa.diagnostics(plsa.e_step(x, *plsa.init(x, K), K), K)


register("plsa_diagnostics", plsa_diagnostics, f"{plsa_sql(0)} SELECT count(*) FILTER (den = 0) AS zero_denominators, CAST(sum({' + '.join(f'isnan(p{i})::INT' for i in range(K))}) AS BIGINT) AS nan_values FROM p0_")
register("plsa_topic_top_words", lambda spark, sf_dir: plsa.top_words(_after(spark, sf_dir, 2)[1], K), f"{plsa_sql(2)}, u AS ({' UNION ALL '.join(f'SELECT {i}::BIGINT AS topic, term, round(t{i}, 10) AS p FROM t2_' for i in range(K))}) SELECT topic, rank, term, p FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY p DESC, term) AS rank FROM u) WHERE rank <= 10")

_QUERY = ["thst", "erth", "thst", "zzzz"]
_FOLD = f"q AS (SELECT {', '.join(f'sum(t{i} * (1 + log10(n))) AS q{i}' for i in range(K))} FROM t2_ JOIN (VALUES ('thst', 2), ('erth', 1), ('zzzz', 1)) v(term, n) USING (term)), s AS (SELECT doc_id, ({' + '.join(f'l{i} * q{i}' for i in range(K))}) / (sqrt({' + '.join(f'l{i} * l{i}' for i in range(K))}) * sqrt({' + '.join(f'q{i} * q{i}' for i in range(K))})) AS s FROM l2_, q)"


def plsa_query_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lam, theta = _after(spark, sf_dir, 2)
    return plsa.nearest(lam, plsa.fold_in(theta, _QUERY, K), K)


register("plsa_query_topk", plsa_query_topk, f"{plsa_sql(2)}, {_FOLD} SELECT row_number() OVER (ORDER BY similarity DESC, doc_id) AS rank, * FROM (SELECT doc_id, round(s, 8) AS similarity FROM s ORDER BY round(s, 8) DESC, doc_id LIMIT 10)")


def cosine_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    lam, theta = _after(spark, sf_dir, 2)
    found = plsa.cosine(lam, plsa.fold_in(theta, _QUERY, K), K)
    return found.select("doc_id", F.round("similarity", 8).alias("similarity")).where("similarity > 0.5")


register("cosine_threshold", cosine_threshold, f"{plsa_sql(2)}, {_FOLD} SELECT doc_id, round(s, 8) AS similarity FROM s WHERE round(s, 8) > 0.5")
