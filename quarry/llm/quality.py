"""Operator 2, a quality classifier on supervised subword embeddings.

A document is the mean of learned vectors: one for each of its words, one for
each character n-gram of each word, and one for each word that repeats the one
before it, all hashed into one table. A softmax layer over that mean gives the
class; table and layer are trained together by stochastic gradient descent in
numpy, on the driver, over at most SAMPLE labelled rows of each class (those
with the smallest hash of their id; the bound is a parameter). As the layer is
linear, a document's logit is the mean of its features' logits, so for scoring
the table is reduced to one logit a bucket (a fixed size, whatever the
corpus), and each worker keeps the sums of the words it has met. Scoring is
one pass without a shuffle.

Every document also has one feature that stands for its end, so null and empty
texts get the score that this alone gives. Null labels teach nothing; labels
that repeat an id count once (the smallest label), and so do documents that do
(the smallest text); repeated rows are scored as often as they come. Without
any labelled row of both classes every score is 0.5. Whole texts count, however
long; an empty table gives no rows. Columns other than doc_id and text,
whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import byte_bpe
from quarry.llm.bpe_codec import in_slices
from quarry.llm.common import crc_fold, texts

SAMPLE, BUCKETS, DIM, EPOCHS, RATE, SEED = 1200, 1 << 17, 16, 3, 0.5, 7
NGRAMS = (3, 4, 5)
#: Buckets that no hash gives: a document's end, and a repeated word.
END, REPEAT = BUCKETS, BUCKETS + 1
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, each bucket's word) of words and their character n-grams,
    words' ends marked by blanks, all words at once."""
    flat = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(size + 1)  # place of the blank after each word
    starts = ends - size
    of = np.repeat(np.arange(len(words)), size)
    within = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    power = np.cumprod(np.full(int(size.max(initial=1)) + 1, _STEP, dtype=np.uint64))
    letters = flat[np.repeat(starts, size) + within]
    with np.errstate(over="ignore"):
        whole = np.add.reduceat((letters + np.uint64(1)) * power[within], np.cumsum(size) - size) if len(words) else np.zeros(0, dtype=np.uint64)
        found, owner = [_bucket(whole)], [np.arange(len(words))]
        for n in NGRAMS:
            # windows over " word ", which begin at the blank before the word
            first = np.arange(max(0, len(flat) - n + 1))
            h = np.zeros(len(first), dtype=np.uint64)
            for j in range(n):
                h = h * _STEP + flat[first + j]
            word = np.searchsorted(ends, first, side="right")
            fits = (word < len(words)) & (first + n - 1 <= ends[np.minimum(word, len(words) - 1)]) if len(words) else np.zeros(0, dtype=bool)
            found.append(_bucket(h[fits] + np.uint64(n) * _MIX))
            owner.append(word[fits])
    return np.concatenate(found), np.concatenate(owner)


def repeats(words: list[str]) -> int:
    return sum(map(eq, words, words[1:]))


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, how often each) of a document, its end included."""
    words = (text or "").split()
    known = Counter(words)
    at, owner = word_features(list(known))
    times = np.array(list(known.values()), dtype=np.int64)[owner] if known else np.zeros(0, dtype=np.int64)
    at = np.r_[at, END, REPEAT]
    total = np.bincount(at, weights=np.r_[times, 1, repeats(words)])
    at = np.flatnonzero(total)
    return at, total[at]


def train(rows: list[tuple[str | None, int]], dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(bucket vectors, 2 x dim output layer) from (text, 0 or 1) rows."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS + 2, dim)).astype(np.float32)
    layer = np.zeros((2, dim), dtype=np.float32)
    if len({y for _, y in rows}) < 2:
        return vectors, layer
    bags = [(*document_features(t), y) for t, y in rows]
    steps, total = 0, epochs * len(bags)
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            at, n, y = bags[k]
            weight = (n / n.sum()).astype(np.float32)
            mean = weight @ vectors[at]
            logit = layer @ mean
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            step = rate * (1 - steps / total)
            back = p @ layer
            layer -= step * np.outer(p, mean)
            vectors[at] -= step * len(at) ** 0.5 * weight[:, None] * back
            steps += 1
    return vectors, layer


def bucket_logits(vectors: np.ndarray, layer: np.ndarray) -> np.ndarray:
    """Logit of class 1 against class 0 that each bucket's vector gives."""
    return (vectors @ (layer[1] - layer[0])).astype(np.float64)


class Scorer(byte_bpe.FragmentTable):
    """Words' (sum of logits, number of features), as complex numbers."""

    def __init__(self, logits: np.ndarray, cache: int = byte_bpe.SCORES):
        self.logits = logits
        self.end, self.repeat = complex(float(logits[END]), 1), complex(float(logits[REPEAT]), 1)
        super().__init__({}, cache)

    def split(self, text: str) -> list[str]:
        return text.split()

    def learn(self, fragments: list[str]) -> list[complex]:
        at, owner = word_features(fragments)
        total = np.bincount(owner, weights=self.logits[at], minlength=len(fragments))
        return (total + 1j * np.bincount(owner, minlength=len(fragments))).tolist()

    def scores(self, batch: list[str | None]) -> list[float]:
        out = []
        for text, found in zip(batch, self.resolve(batch)):
            total = sum(found, self.end)
            # the same value beside itself: mostly a repeated word, so look
            if text and any(map(eq, found, found[1:])):
                total += repeats(text.split()) * self.repeat
            out.append(float(1 / (1 + np.exp(-np.clip(total.real / total.imag, -30, 30)))))
        return out


def sample_rows(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3, sample: int = SAMPLE) -> list[tuple[str | None, int]]:
    """(text, quality) of at most sample labelled rows of each class outside
    the held-out fold, those with the smallest hashes of their ids."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & (crc_fold("doc_id", folds) != fold))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("h", F.xxhash64("doc_id"))
    known = reduce(DataFrame.unionByName, [known.where(F.col("quality") == y).orderBy("h", "doc_id").limit(sample) for y in (0, 1)])
    found = texts(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality")  # at most 2 x sample rows
    found = found.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    return [(r["text"], r["quality"]) for r in sorted(found.collect(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))]


def _scorer(logits: np.ndarray) -> Scorer:
    """One scorer for each model and worker."""
    return byte_bpe.table_of((Scorer, zlib.crc32(logits.tobytes())), lambda: Scorer(logits))


def _model(docs: DataFrame, labels: DataFrame, fold: int, folds: int, sample: int) -> Broadcast:
    """The bucket logits: BUCKETS + 2 doubles."""
    return docs.sparkSession.sparkContext.broadcast(bucket_logits(*train(sample_rows(docs, labels, fold, folds, sample))))


def classify(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = _model(docs, labels, fold, folds, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for batch in batches:
            for first, rows in in_slices(batch.column(1)):
                s = scorer.scores(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(crc_fold("doc_id", folds) == fold, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, fold: int = 1, folds: int = 3, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, whose score is at least least."""
    shared = _model(docs, labels, fold, folds, sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for batch in batches:
            for first, rows in in_slices(batch.column(at)):
                yield batch.slice(first, len(rows)).filter(pa.array([x >= least for x in scorer.scores(rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
