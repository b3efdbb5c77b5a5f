"""The zoned inverted index as tables.

postings   zone, kind, term, doc_id, wtf     1 + log10 of the term's count
blocks     zone, kind, term, block, first, last, n, top, ids, weights
dictionary zone, kind, term, df, idf         idf = ln N - ln df
stats      n_docs

Zones are body, title and court; body has unigrams and bigrams, the others
unigrams. One pass over the corpus, in which terms are counted where their text
lies. Rows that repeat a document id are one document; only where some do, the
counts are added up by a shuffle.

A stored index holds blocks: the postings of a key whose document ids share a
range (block = id / WIDTH), with the first and last id, the number of postings
and the largest weight in front. Searches decide by these small columns which
blocks to open: a conjunction needs blocks of all its clauses that overlap, a
ranking of the best k those whose largest weights can reach the kth score. The
blocks of a frequent term are many rows, dealt to as many files as they need.
Bloom filters and sorted pages on term let lookups skip what lacks it.

To store an index, the texts are dealt by range of ids, SEGMENT bytes or so to
a task, which counts, packs and sorts its own documents' postings: texts are
shuffled once, postings never. A key's document frequency is the sum over its
blocks, so the dictionary of a stored index is read from them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.analysis import CANONICAL, Analyzer, bigrams
from quarry.plans.checkpoints import checkpointed
from quarry.plans.ranges import numbered

ZONES = ("body", "title", "court")
KEYS = ("zone", "kind", "term")
WIDTH = 256  #: document ids that a block spans
HEAD = ("block", "first", "last", "n", "top")
FEW = 1000  #: distinct terms up to which a lookup names them to the scan
MANY = 100_000  #: distinct terms up to which blocks of other terms are dropped at the scan
SEGMENT = 8 << 20  #: bytes of text whose postings a task stores, or so
RUN = 8 << 20  #: bytes of tokens that a task counts at once; a range of ids stays whole
PART = 50_000  #: blocks that leave a task's counting at once
BLOCK = "zone string, kind string, term string, block long, first long, last long, n int, top float, ids array<long>, weights array<float>"


def from_documents(documents: DataFrame) -> DataFrame:
    """documents as a corpus: the first line is the title, lang the court."""
    return documents.select(
        F.col("doc_id").cast("long").alias("document_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), F.col("lang").alias("court")
    )


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, if they come in fewer parts (a file of one row
    group is read by one task): analysing a text takes far longer than moving
    it. Large tables have more parts than cores and stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def token_rows(corpus: DataFrame, analyzer: Analyzer, zones: tuple[str, ...] = ZONES) -> DataFrame:
    """doc_id, zone, pos, term: every indexed token."""
    column = {"body": "content", "title": "title", "court": "court"}
    one = F.array(*[F.struct(F.lit(z).alias("zone"), analyzer.tokens(F.col(column[z])).alias("t")) for z in zones])
    rows = corpus.select(F.col("document_id").alias("doc_id"), F.explode(one).alias("z"))
    return rows.select("doc_id", "z.zone", F.posexplode("z.t").alias("pos", "term"))


def tallied(tokens: Column) -> Column:
    """The distinct tokens of a list, each with its count: where runs of the
    sorted list begin. Lambda variables name what is read for each token."""
    begins = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s, b: F.transform(b, lambda at, j: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(b, j + 1), F.size(s)) - at).cast("long").alias("tf")))
    of = lambda s: F.when(F.size(s) == 0, F.array().cast("array<struct<term:string,tf:bigint>>")).otherwise(F.element_at(F.transform(F.array(begins(s)), lambda b: runs(s, b)), 1))
    return F.element_at(F.transform(F.array(F.sort_array(tokens)), of), 1)


def repeats(corpus: DataFrame) -> bool:
    """Whether rows share a document id; reads nothing but the ids."""
    return bool(corpus.groupBy("document_id").count().where("count > 1").take(1))


def counts(corpus: DataFrame, analyzer: Analyzer, zones: tuple[str, ...] = ZONES, kinds: tuple[str, ...] = ("uni", "bi"), only: list[str] | None = None) -> tuple[DataFrame, bool]:
    """(doc_id, zone, kind, term, tf of every indexed term, whether a
    document's rows lie together). Terms are counted where their text lies; no
    row is shuffled unless ids repeat. only: these terms alone."""
    column = {"body": "content", "title": "title", "court": "court"}
    tokens = corpus.select(F.col("document_id").alias("doc_id"), *[analyzer.tokens(F.col(column[z])).alias(z) for z in zones])
    lists = [F.struct(F.lit(z).alias("zone"), F.lit("uni").alias("kind"), tallied(F.col(z)).alias("t")) for z in zones if "uni" in kinds]
    if "bi" in kinds and "body" in zones:
        lists.append(F.struct(F.lit("body").alias("zone"), F.lit("bi").alias("kind"), tallied(bigrams(F.col("body"))).alias("t")))
    rows = tokens.select("doc_id", F.explode(F.array(*lists)).alias("z"))
    rows = rows.select("doc_id", "z.zone", "z.kind", F.explode("z.t").alias("t")).select("doc_id", "zone", "kind", "t.term", "t.tf")
    rows = rows.where(F.col("term").isin(only)) if only is not None else rows
    if repeats(corpus):
        return rows.groupBy("zone", "kind", "term", "doc_id").agg(F.sum("tf").alias("tf")), False
    return rows, True


def pack(postings: DataFrame, width: int = WIDTH) -> DataFrame:
    """Postings as blocks, sorted by key and block. Dealt by key and block, so
    that a term of every document is no hot key."""
    keyed = postings.withColumn("block", F.floor(F.col("doc_id") / width))
    keyed = keyed.repartitionByRange(*KEYS, "block").sortWithinPartitions(*KEYS, "block")
    pairs = F.array_sort(F.collect_list(F.struct("doc_id", "wtf"))).alias("p")
    rows = keyed.groupBy(*KEYS, "block").agg(pairs, F.max("wtf").alias("top"))
    ids, weights = F.transform("p", lambda x: x["doc_id"]), F.transform("p", lambda x: x["wtf"])
    rows = rows.select(*KEYS, "block", F.col("p")[0]["doc_id"].alias("first"), F.element_at("p", -1)["doc_id"].alias("last"), F.size("p").alias("n"), "top", ids.alias("ids"), weights.alias("weights"))
    return rows.sortWithinPartitions(*KEYS, "block")


def _no_id(ids: np.ndarray) -> pa.Array:
    """ids, null where they stand for none."""
    return pa.array(ids, pa.int64(), mask=ids == np.iinfo(np.int64).min)


def _blocks(zone: str, kind: str, docs: np.ndarray, lines: pa.StringArray, width: int) -> pa.RecordBatch:
    """Blocks of one zone of documents, whose tokens come as lines."""
    some = pc.not_equal(lines, "").to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(lines.filter(pa.array(some)), " ")
    sizes = np.zeros(len(lines), dtype=np.int64)
    sizes[some] = pc.list_value_length(lists).to_numpy()
    coded = lists.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    words, place = coded.dictionary.take(order), np.empty(len(order), dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    ids, of = np.unique(docs, return_inverse=True)
    of, code = np.repeat(of, sizes), place[coded.indices.to_numpy()]
    if kind == "bi":
        row = np.repeat(np.arange(len(lines)), sizes)
        inner = row[1:] == row[:-1]
        of, code = of[1:][inner], (code[:-1] * len(words) + code[1:])[inner]
    known = None
    if len(words) ** 2 * len(ids) >= 1 << 63:  # numbers of pairs and documents together would run over
        known, code = np.unique(code, return_inverse=True)
    key = np.sort(code * len(ids) + of)  # by term, then document
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    weights = (1 + np.log10(np.diff(starts, append=len(key)))).astype(np.float32)
    code, of = np.divmod(key[starts], max(1, len(ids)))
    code = code if known is None else known[code]
    doc = ids[of]
    block = doc // width
    at = np.flatnonzero(np.diff(code, prepend=-1) | np.diff(block, prepend=block[:1]))
    size = np.diff(at, append=len(code))
    if kind == "bi":
        a, b = np.divmod(code[at], max(1, len(words)))
        terms = pc.binary_join_element_wise(words.take(pa.array(a)), words.take(pa.array(b)), " ")
    else:
        terms = words.take(pa.array(code[at]))
    top = np.maximum.reduceat(weights, at) if len(at) else weights
    alone, kept = size == 1, np.repeat(size > 1, size)  # a block of one posting is told by its first and top
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(alone, 0, size))]).astype(np.int32))
    listed = lambda values: pa.ListArray.from_arrays(offsets, values, mask=pa.array(alone))
    none = doc[at] == np.iinfo(np.int64).min
    columns = [pa.repeat(pa.scalar(zone), len(at)), pa.repeat(pa.scalar(kind), len(at)), terms, pa.array(block[at], pa.int64(), mask=none), _no_id(doc[at]), pa.array(doc[at + size - 1], pa.int64(), mask=none | alone), pa.array(size, pa.int32(), mask=alone), pa.array(top), listed(_no_id(doc[kept])), listed(pa.array(weights[kept]))]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BLOCK.split(", ")])


def _segment(zones: tuple[str, ...], kinds: tuple[str, ...], width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from documents' tokens (doc_id, a line for each zone), in the
    order of ranges of ids, to blocks, each whole."""

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        docs = pc.fill_null(table.column(0), np.iinfo(np.int64).min).to_numpy()
        for i, zone in enumerate(zones, 1):
            lines = table.column(i).chunk(0)
            for kind in ("uni", "bi"):
                if kind in kinds and (kind == "uni" or zone == "body"):
                    out = _blocks(zone, kind, docs, lines, width)
                    yield from (out.slice(k, PART) for k in range(0, out.num_rows, PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            ranges = pc.fill_null(batch.column(0), np.iinfo(np.int64).min).to_numpy() // width
            cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), batch.num_rows]
            sizes = np.cumsum([0, *sum(pc.binary_length(batch.column(i)).to_numpy() for i in range(1, batch.num_columns))])
            for a, b in zip(cuts, cuts[1:]):  # documents of one range
                if size > RUN and ranges[a] != last:
                    yield from made(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size, last = size + int(sizes[b] - sizes[a]), ranges[a]
        if held:
            yield from made(held)

    return run


def segments(corpus: DataFrame, analyzer: Analyzer, zones: tuple[str, ...] = ZONES, kinds: tuple[str, ...] = ("uni", "bi"), width: int = WIDTH) -> DataFrame:
    """The blocks of a corpus without repeated ids, sorted by key and block
    within each segment."""
    column = {"body": "content", "title": "title", "court": "court"}
    size = corpus.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    parts = max(corpus.sparkSession.sparkContext.defaultParallelism, -(-size // SEGMENT))
    dealt = corpus.withColumn("block", F.floor(F.col("document_id") / width)).repartition(parts, "block").sortWithinPartitions("block", "document_id")
    lines = [F.concat_ws(" ", analyzer.tokens(F.col(column[z]))).alias(z) for z in zones]  # no token holds a blank
    tokens = dealt.select(F.col("document_id").cast("long").alias("doc_id"), *lines)
    return tokens.mapInArrow(_segment(zones, kinds, width), BLOCK).sortWithinPartitions(*KEYS, "block")


def unpack(blocks: DataFrame, *also: str) -> DataFrame:
    """The postings of blocks, with further columns of theirs."""
    rows = blocks.select(*KEYS, *also, F.explode(F.arrays_zip("ids", "weights")).alias("p"))
    return rows.select(*KEYS, *also, F.col("p.ids").alias("doc_id"), F.col("p.weights").alias("wtf"))


def _dictionary(df: DataFrame, stats: DataFrame) -> DataFrame:
    n = stats.select(F.log(F.col("n_docs").cast("double")).alias("_n"))  # one row
    return df.crossJoin(F.broadcast(n)).select(*KEYS, "df", (F.col("_n") - F.log(F.col("df").cast("double"))).alias("idf"))


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    dictionary: DataFrame
    stats: DataFrame
    stored: DataFrame | None = None
    together: bool = False  #: whether a document's postings follow each other
    segments: Callable[[int], DataFrame] | None = None  #: from the width of blocks to all of them, where ids don't repeat

    @property
    def blocks(self) -> DataFrame:
        return pack(self.postings) if self.stored is None else self.stored

    def save(self, path: str, width: int = WIDTH) -> None:
        """Writes blocks and statistics once. Terms hardly repeat within a
        file, so they are written without a dictionary."""
        bloom = {"parquet.bloom.filter.enabled#term": "true", "parquet.bloom.filter.expected.ndv#term": "100000", "parquet.enable.dictionary#term": "false", "compression": "zstd"}
        blocks = pack(self.postings, width) if self.segments is None else self.segments(width)
        blocks.write.mode("overwrite").options(**bloom).parquet(f"{path}/blocks")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        blocks, stats = (spark.read.parquet(f"{path}/{t}") for t in ("blocks", "stats"))
        one = {"last": F.col("first"), "n": F.lit(1), "ids": F.array("first"), "weights": F.array("top")}  # of blocks of one posting
        return cls.of(blocks.select(*[F.coalesce(c, one[c]).alias(c) if c in one else c for c in blocks.columns]), stats)

    @classmethod
    def of(cls, blocks: DataFrame, stats: DataFrame) -> Index:
        """A stored index; its dictionary is summed up over the blocks."""
        return cls(unpack(blocks), _dictionary(blocks.groupBy(*KEYS).agg(F.sum("n").alias("df")), stats), stats, blocks)

    def lookup(self, terms: list[str]) -> DataFrame:
        """Postings of a few terms; the filter reaches the scan."""
        return self.postings.where(F.col("term").isin(terms))

    def narrowed(self, terms: DataFrame) -> Index:
        """The index for queries of these terms (column term): of a stored
        index, blocks of other terms are dropped at the scan, which is told the
        terms' names where they are few."""
        if self.stored is None:
            return self
        names = [r["term"] for r in terms.select("term").distinct().take(FEW + 1)]
        if len(names) <= FEW:
            return Index.of(self.stored.where(F.col("term").isin(names)), self.stats)
        wanted = terms.select("term").distinct()
        small = len(wanted.select(F.lit(1)).take(MANY + 1)) <= MANY
        return Index.of(self.stored.join(F.broadcast(wanted) if small else wanted, "term", "left_semi").select(self.stored.columns), self.stats)

    def vocabulary(self) -> DataFrame:
        """Keys with their zone's prefix, as in a dump of the dictionary."""
        prefix = F.when(F.col("zone") == "body", F.lit("")).otherwise(F.concat(F.col("zone"), F.lit("#")))
        return self.dictionary.select("kind", F.concat(prefix, F.col("term")).alias("term"))

    def dump_vocabulary(self, path: str) -> None:
        self.vocabulary().select("term").write.mode("overwrite").text(path)


def build(corpus: DataFrame, analyzer: Analyzer = CANONICAL, zones: tuple[str, ...] = ZONES, kinds: tuple[str, ...] = ("uni", "bi"), only: list[str] | None = None, checkpoint: bool = False) -> Index:
    """The index of a corpus. only: restrict it to these terms, before any
    shuffle; their df and idf are the same as in the whole index. checkpoint:
    make the postings once, for queries that read them and the dictionary."""
    terms, together = counts(corpus, analyzer, zones, kinds, only)
    postings = terms.select("zone", "kind", "term", "doc_id", (1 + F.log10("tf")).cast("float").alias("wtf"))
    postings = checkpointed(postings) if checkpoint else postings
    stats = corpus.agg(F.count_distinct("document_id").alias("n_docs"))
    whole = None if only is not None or not together else lambda width: segments(corpus, analyzer, zones, kinds, width)
    return Index(postings, _dictionary(postings.groupBy(*KEYS).agg(F.count("*").alias("df")), stats), stats, together=together, segments=whole)


def first_seen(corpus: DataFrame, analyzer: Analyzer) -> DataFrame:
    """term, doc_id, pos of each term's first occurrence, and its rank: range
    sorted, so no task orders the whole vocabulary."""
    rows = token_rows(corpus, analyzer, ("body",))
    first = rows.groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("f"))
    first = first.select("term", F.col("f.doc_id").alias("doc_id"), F.col("f.pos").cast("long").alias("pos"))
    placed = numbered(first, "doc_id", "pos", name="term_id")
    return placed.withColumn("term_id", F.col("term_id") + 1)
