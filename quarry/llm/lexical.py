"""Ranked lexical search of many items over all documents, with integer scores.

A term's impact in a document is its weight times a saturated count. The index
stores documents in shards of bounded text, each an inverted list of its own,
and for every term its document count and its k largest saturated counts. The
kth of them, weighted, is a score that k documents reach by this term alone, so
the largest of an item's terms is a lower bound of the item's kth score before
any document is looked at (the seed).

Items then meet shards. There an item's terms are ordered by the most each can
give; terms at the low end that together stay below the threshold can't lift a
document on their own and generate no candidates. Documents of the other terms
are candidates; each further term is added for those alone that, with all that
is still to come, can reach the threshold. What is left has its exact score.
Thresholds rise with what a task has found. Each shard gives k rows an item at
most, and the best k of them are ranked.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII,
A-Z lower-cased. Documents without terms and rows without an id take no part.
Null and empty texts have no terms; an item without terms gets no rows. Ties
go to the smaller id; rows that repeat an id are documents of their own, rows
that repeat an item each get a ranking. A very long text makes a shard alone.
Empty tables give an empty result, other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize

SHARD_BYTES, SHARD_DOCS = 4 << 20, 8192  #: of a shard, at most (one text may be longer)
BLOCK_ITEMS, BLOCK_TERMS = 256, 65_536  #: of the items that meet a shard at once, about
LISTS = 64  #: parts in which a term's largest counts are gathered first
SMALL_TERMS = 200_000  #: terms of all items, up to which they are broadcast (some MB)

_LETTERS = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123))
_TABLE = bytes(c if c >= 128 or c in _LETTERS else 32 for c in range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


def words(text: str | None) -> list[bytes]:
    """A text's terms in order, in UTF-8."""
    return text.encode().translate(_TABLE).split() if text else []


def _narrow(x: np.ndarray) -> bytes:
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _wide(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, dtype={1: np.uint8, 2: np.uint16, 4: np.uint32}[len(b) // n if n else 1]).astype(np.int64)


SHARD = "shard long, ids array<long>, n array<int>, n_docs long, n_terms long, terms array<binary>, lengths array<int>, docs binary, tf binary"
_SHARD = pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("docs", pa.binary()), ("tf", pa.binary())])


def _shard(name: int, ids: list[int], texts: list[list[bytes]]) -> pa.RecordBatch:
    """The inverted lists of a few documents, in one row."""
    codes: defaultdict[bytes, int] = defaultdict()
    codes.default_factory = codes.__len__
    n = np.array([len(t) for t in texts], dtype=np.int64)
    seen = np.concatenate([np.fromiter(map(codes.__getitem__, t), dtype=np.int64, count=len(t)) for t in texts])
    pairs, tf = np.unique(seen * len(texts) + np.repeat(np.arange(len(texts)), n), return_counts=True)
    row = {
        "shard": name, "ids": ids, "n": n, "n_docs": len(ids), "n_terms": int(n.sum()), "terms": list(codes), "lengths": np.bincount(pairs // len(texts), minlength=len(codes)),
        "docs": _narrow(pairs % len(texts)), "tf": _narrow(tf),
    }
    return pa.RecordBatch.from_pylist([row], schema=_SHARD)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    name, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
    for b in batches:
        for i, text in zip(b.column(0).to_pylist(), b.column(1)):
            t = words(text.as_py())
            if t:
                more = sum(map(len, t)) + len(t)
                if ids and (size + more > SHARD_BYTES or len(ids) >= SHARD_DOCS):
                    yield _shard(name, ids, texts)
                    name, ids, texts, size = name + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += more
    if ids:
        yield _shard(name, ids, texts)


@dataclass(frozen=True)
class Lists:
    """A shard's lists with the saturated counts g of all its postings."""

    ids: np.ndarray
    docs: np.ndarray
    g: np.ndarray
    starts: np.ndarray
    terms: list[bytes]

    @classmethod
    def of(cls, b: pa.RecordBatch, r: int, n_docs: int, n_terms: int) -> Lists:
        get = lambda c: b.column(b.schema.get_field_index(c))[r]
        array = lambda c: get(c).values.to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = array("lengths")
        starts = np.concatenate([[0], np.cumsum(lengths)])
        docs, tf = (_wide(get(c).as_py(), int(starts[-1])) for c in ("docs", "tf"))
        m = 10 + 90 * array("n") * n_docs // n_terms
        return cls(array("ids"), docs, 1_000_000_000 * tf // (1000 * tf + 8 * m[docs]), starts, get("terms").values.to_pylist())


@dataclass(frozen=True)
class Index:
    """shards: documents' inverted lists; terms: term, df, g (its k largest
    saturated counts); n_docs, n_terms: totals of documents with terms."""

    shards: DataFrame
    terms: DataFrame
    n_docs: int
    n_terms: int
    k: int


def build(docs: DataFrame, k: int = 10) -> Index:
    """The stored index of all documents, good for rankings of up to k."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    shards = materialize(rows.mapInArrow(_shards, SHARD), "shards")
    totals = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = totals[0] or 0, totals[1] or 1

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x = Lists.of(b, r, n_docs, n_terms)
                term = np.repeat(np.arange(len(x.terms)), np.diff(x.starts))
                order = np.lexsort((-x.g, term))
                first = order[np.arange(len(order)) - x.starts[term] < k]
                offsets = np.concatenate([[0], np.cumsum(np.minimum(np.diff(x.starts), k))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x.g[first]))
                part = pa.array(np.full(len(x.terms), b.column(0)[r].as_py() % LISTS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x.terms, pa.binary()), part, pa.array(np.diff(x.starts)), lists], names=["term", "part", "df", "g"])

    merged = F.slice(F.sort_array(F.flatten(F.collect_list("g")), asc=False), 1, k).alias("g")
    partial = shards.mapInArrow(largest, "term binary, part int, df long, g array<long>")
    for keys in (("term", "part"), ("term",)):  # a term of all shards is gathered in parts
        partial = partial.groupBy(*keys).agg(F.sum("df").alias("df"), merged)
    return Index(shards, materialize(partial, "terms"), n_docs, n_terms, k)


def weight(df: Column, n_docs: int) -> Column:
    return F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * df + 1))).cast("long")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(key, item, t) for key, item, text in zip(*(c.to_pylist() for c in b.columns)) for t in dict.fromkeys(words(text))]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.binary())], names=["key", "item_id", "term"])


def seeds(items: DataFrame, index: Index, k: int) -> DataFrame:
    """key, item_id, least, terms (term, w): one row an item that any document
    can match; least: no kth score is below it. Written as a table."""
    rows = items.select(F.monotonically_increasing_id().alias("key"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    terms = materialize(rows.mapInArrow(_item_terms, "key long, item_id long, term binary"), "items")
    w = weight(F.col("df"), index.n_docs)
    known = terms.join(index.terms, "term").select("key", "item_id", "term", w.alias("w"), F.coalesce(w * F.try_element_at("g", F.lit(k)), F.lit(0)).alias("kth"))
    return materialize(known.where("w > 0").groupBy("key", "item_id").agg(F.max("kth").alias("least"), F.collect_list(F.struct("term", "w")).alias("terms")), "seeds")


def candidates(lists: Lists, codes: dict[bytes, int], most: np.ndarray, terms: list[tuple[bytes, int]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, exact scores) of a shard that reach least, which is above 0.
    most: the largest saturated count of each list."""
    have = sorted(((w * int(most[c]), c, w) for t, w in terms if (c := codes.get(t)) is not None), reverse=True)
    suffix = [0]
    for bound, _, _ in reversed(have):
        suffix.append(suffix[-1] + bound)
    suffix.reverse()  # suffix[i]: the most that terms i and later can give
    score = np.zeros(len(lists.ids), dtype=np.int64)
    if suffix[0] < least:
        return np.zeros(0, dtype=np.int64), score[:0]
    alive = None
    for i, (_, c, w) in enumerate(have):
        span = slice(lists.starts[c], lists.starts[c + 1])
        docs, gain = lists.docs[span], w * lists.g[span]
        if suffix[i] >= least:  # the terms from here on could still make a document
            score[docs] += gain
            continue
        if alive is None:
            alive = score > 0
        alive &= score + suffix[i] >= least
        if not alive.any():
            break
        hit = alive[docs]
        score[docs[hit]] += gain[hit]
    found = np.flatnonzero(score >= least if alive is None else alive & (score >= least))
    return found, score[found]


def rank(index: Index, items: DataFrame, k: int | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents."""
    k = index.k if k is None else k
    if k > index.k:
        raise ValueError(f"the index holds bounds for rankings of up to {index.k}")
    asked = seeds(items, index, k)
    n_items, n_terms = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-n_items // BLOCK_ITEMS), -(-n_terms // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block")
    grouped = asked.groupBy(block).agg(F.collect_list(F.struct("key", "item_id", "least", "terms")).alias("items"))
    dealt = index.shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = dealt.join(F.broadcast(grouped) if n_terms <= SMALL_TERMS else grouped, "block")
    n_docs, n_all = index.n_docs, index.n_terms

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, list[int]] = {}  # of each item the best scores so far
        parsed: dict[int, list] = {}
        for b in batches:
            for r in range(b.num_rows):
                get = lambda c: b.column(b.schema.get_field_index(c))[r]  # noqa: B023, E731
                name = get("block").as_py()
                if name not in parsed:
                    parsed = {name: [(i["key"], i["item_id"], i["least"], [(t["term"], t["w"]) for t in i["terms"]]) for i in get("items").as_py()]}
                lists = Lists.of(b, r, n_docs, n_all)
                codes = {t: c for c, t in enumerate(lists.terms)}
                most = np.maximum.reduceat(lists.g, lists.starts[:-1])
                out = []
                for key, item, least, terms in parsed[name]:
                    top = tops.get(key, [])
                    if len(top) == k:
                        least = max(least, top[-1])
                    docs, score = candidates(lists, codes, most, terms, max(least, 1))
                    if len(docs):
                        best = np.lexsort((lists.ids[docs], -score))[:k]
                        out.append((np.full(len(best), key), [item] * len(best), lists.ids[docs[best]], score[best]))
                        tops[key] = sorted([*top, *score[best].tolist()], reverse=True)[:k]
                if out:
                    keys, ids, scores = (np.concatenate([o[j] for o in out]) for j in (0, 2, 3))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([i for o in out for i in o[1]], pa.int64()), pa.array(ids), pa.array(scores)], names=["key", "item_id", "doc_id", "score"])

    found = met.mapInArrow(search, "key long, item_id long, doc_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "doc_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Builds the index of docs and ranks them for each item."""
    return rank(build(docs, k), items, k)


def oracle(k: int = 10) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = lambda text: f"regexp_extract_all(translate({text}, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {terms('text')} AS t FROM documents WHERE doc_id IS NOT NULL),
a AS (SELECT count(*) AS n, sum(len(t)) AS l FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({terms('text')}) AS term FROM benchmark),
w AS (SELECT item_id, term, CAST(floor(1000 * ln((2.0::DOUBLE * n + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w FROM q JOIN f USING (term), a),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len * n) // l)))) AS BIGINT) AS score FROM w JOIN p USING (term), a GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {k}"""
