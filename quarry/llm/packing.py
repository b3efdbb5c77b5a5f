"""Operator 10, packing by lexical retrieval.

Documents are encoded once, to files. Document counts, document frequencies
and the mean length are those of the whole table. Each document gets a key of
its content: its terms of smallest weighted hash (a consistent sample that
favours late entries of the vocabulary, which are the longer and rarer ones,
so likely the same for documents that share many), then a hash of its id.
Documents lie in shards of up to SHARD_DOCS in the order of their keys: near
copies and documents that share rare terms lie together whatever the size of
the table, and large groups of equal documents go on over as many shards as
they need.

Each shard has a BM25 inverted index. Windows are filled greedily: the first
unused document seeds a window, and its nearest unused documents of the shard,
by all its terms, fill it, nearest first (ties: first in key order), as many
as fit; if none is near, the next in order. What doesn't fit is cut: the rest
of a document opens the next window and is its seed. A window that a shard
leaves open goes on in the next shard of the same range of keys; the last
window of each range stays short.

A task packs a range of keys, of RANGE_SHARDS shards or so. Spark's range
partitioning says where ranges begin, from a sample that differs between runs;
nothing else hangs on it. What is collected: one count for each vocabulary
entry.

Null and empty texts are documents of the end id alone; very long texts are
cut over as many windows as they fill. Repeated rows are packed as often as
they come, rows without doc_id too. An empty table has no pieces. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, word_bpe
from quarry.llm.bpe_codec import in_slices
from quarry.llm.common import materialize, shuffle_parts, texts

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SHARD_DOCS, WINDOW, K1, B = 1024, 2048, 1.2, 0.75
RANGE_SHARDS = 8
#: Documents whose terms are counted together.
SLICE = 64


def weights_of(df: np.ndarray, n: int) -> np.ndarray:
    """Each term's weight in n documents, of which df hold it."""
    return np.log1p((n - df + 0.5) / (df + 0.5))


class Statistics:
    """What a shard needs to know of the whole table."""

    def __init__(self, df: np.ndarray, n: int, tokens: int):
        self.idf, self.mean = weights_of(df, n).astype(np.float32), tokens / max(n, 1)


class Keys:
    """Keys of content for a vocabulary of some size."""

    def __init__(self, size: int):
        u = np.random.default_rng(17).random(size)
        self.hashes = (-np.log1p(-u) / np.log(np.arange(size) + 2.0) ** 8).astype(np.float32)  # the smaller the likelier for late entries

    def of(self, terms: np.ndarray, tie: int) -> int:
        """The place in order of a document of these distinct terms: the two of
        smallest hash, and 23 bits of tie."""
        hashes = self.hashes[terms]
        first = hashes.argmin()
        hashes[first] = np.inf
        return (int(terms[first]) & 0xFFFFF) << 43 | (int(terms[hashes.argmin()]) & 0xFFFFF) << 23 | tie & 0x7FFFFF


def counted(docs: list[np.ndarray], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, how often) of documents numbered from first, in order,
    by one sort of them all."""
    term = np.concatenate(docs).astype(np.int64)
    span = term.max() + 1
    key = np.repeat(np.arange(first, first + len(docs)), [len(x) for x in docs]) * span + term
    key.sort()
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return *np.divmod(key[at], span), np.diff(at, append=len(key))


class Index:
    """BM25 of a shard, by the terms that two of its documents hold: those of
    many documents as rows of a matrix, whose sums for all seeds are one
    product of matrices, the others as postings."""

    def __init__(self, docs: list[np.ndarray], stats: Statistics):
        n, size = len(docs), np.array([len(x) for x in docs])
        doc, term, tf = (np.concatenate(c) for c in zip(*(counted(docs[k : k + SLICE], k) for k in range(0, n, SLICE))))
        df = np.bincount(term)
        weight = stats.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / stats.mean))
        many = np.flatnonzero(df > max(8, n // 16))
        row = np.full(len(df), -1, dtype=np.int64)
        row[many] = np.arange(len(many))
        common, few = row[term] >= 0, (row[term] < 0) & (df[term] > 1)
        asked, held_by = np.zeros((n, len(many)), dtype=np.float32), np.zeros((len(many), n), dtype=np.float32)
        asked[doc[common], row[term[common]]] = 1
        held_by[row[term[common]], doc[common]] = weight[common]
        self.common = asked @ held_by
        doc, self.terms, weight = doc[few], term[few], weight[few]
        self.of = np.searchsorted(doc, np.arange(n + 1))
        order = np.argsort(self.terms, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.df = np.where((row < 0) & (df > 1), df, 0)
        self.start = np.cumsum(self.df) - self.df

    def scores(self, seed: int) -> np.ndarray:
        """Of all the seed's terms against each document."""
        terms = self.terms[self.of[seed] : self.of[seed + 1]]
        n = self.df[terms]
        at = np.repeat(self.start[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return (self.common[seed] + np.bincount(self.doc[at], weights=self.weight[at], minlength=len(self.common))).round(2)


class Packer:
    """Windows of pieces (document, start, length) of one range's shards;
    documents are numbered over all of them."""

    def __init__(self, stats: Statistics, window: int):
        self.stats, self.window = stats, window
        self.pieces: list[tuple[int, int, int]] = []
        self.room, self.numbered = window, 0

    def _put(self, doc: int, start: int, size: int) -> int:
        """Adds as much as there is room for; where the rest begins."""
        n = min(self.room, size - start)
        self.pieces.append((self.numbered + doc, start, n))
        self.room -= n
        return start + n

    def _close(self) -> list[tuple[int, int, int]]:
        out, self.pieces, self.room = self.pieces, [], self.window
        return out

    def shard(self, docs: list[np.ndarray]) -> Iterator[list[tuple[int, int, int]]]:
        index, size = Index(docs, self.stats), [len(x) for x in docs]
        unused, pointer, seed, score = np.ones(len(docs), dtype=bool), 0, None, None
        while True:
            doc = None
            if seed is not None:
                if score is None:
                    score = np.where(unused, index.scores(seed), 0.0)
                doc = int(score.argmax())
                doc = doc if score[doc] > 0 else None
            if doc is None:  # nothing near: the next in order seeds what is left
                while pointer < len(docs) and not unused[pointer]:
                    pointer += 1
                if pointer == len(docs):
                    break
                doc, seed, score = pointer, pointer, None
            unused[doc] = False
            if score is not None:
                score[doc] = 0.0
            start = 0
            while True:
                start = self._put(doc, start, size[doc])
                if self.room:
                    break
                yield self._close()
                # the rest opens the next window and seeds it
                seed, score = (doc, None) if start < size[doc] else (None, None)
                if start == size[doc]:
                    break
        self.numbered += len(docs)

    def rest(self) -> list[list[tuple[int, int, int]]]:
        return [self._close()] if self.pieces else []


def _encoded(docs: DataFrame, vocab: str, end_id: int) -> DataFrame:
    """doc_id, key, n, ids: documents' ids with the end id; and a row for each task
    with its document frequencies alone (counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_bpe.codec(vocab)
        end, df = np.array([end_id], dtype=codec.dtype), np.zeros(max(codec.library.get_vocab_size(), end_id + 1), dtype=np.int64)
        keys = Keys(len(df))

        def rows(names: pa.Array, key: list, n: list, ids: list, counts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([names, pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "key", "n", "ids", "counts"])

        for batch in batches:
            for first, part in in_slices(batch.column(1)):
                ids = [np.concatenate([x, end]) for x in codec.encode(part)]
                key, ties = [], batch.column(2).slice(first, len(ids)).to_pylist()
                for k in range(0, len(ids), SLICE):
                    some = ids[k : k + SLICE]
                    doc, term, _ = counted(some, 0)
                    present = np.bincount(term)
                    df[: len(present)] += present
                    cuts = np.searchsorted(doc, np.arange(len(some) + 1)).tolist()
                    key += [keys.of(term[i:j], tie) for i, j, tie in zip(cuts, cuts[1:], ties[k:])]
                yield rows(batch.column(0).slice(first, len(ids)), key, [len(x) for x in ids], [x.astype(f"<u{x.dtype.itemsize}").tobytes() for x in ids], [None] * len(ids))
        yield rows(pa.array([None], pa.int64()), [None], [None], [None], [df.astype("<i8").tobytes()])

    return texts(docs).withColumn("tie", F.xxhash64("doc_id")).mapInArrow(run, "doc_id long, key long, n long, ids binary, counts binary")


def _ids(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"<u{len(blob) // n}")


def _statistics(encoded: DataFrame) -> tuple[Statistics, int]:
    """Of all documents, and their number; only one row a term reaches the
    driver."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                df = np.frombuffer(blob, dtype="<i8")
                total = df + (total if len(total) else 0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64()), pa.array(np.full(len(at), len(total)), pa.int64())], names=["term", "df", "size"])

    found = encoded.where(F.col("counts").isNotNull()).select("counts").mapInArrow(terms, "term long, df long, size long").groupBy("term", "size").agg(F.sum("df").alias("df")).toArrow()
    n, tokens = encoded.where(F.col("n").isNotNull()).agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(found["size"][0].as_py() if found.num_rows else 1, dtype=np.int64)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    return Statistics(df, n, tokens or 0), n


def pack(docs: DataFrame, vocab: str = "word_bpe_49k.json", end_id: int = 1, window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    spark = docs.sparkSession
    encoded = materialize(_encoded(docs, vocab, end_id), "ids")
    stats, n = _statistics(encoded)
    shared = spark.sparkContext.broadcast(stats)  # three numbers a vocabulary entry
    shards = max(1, -(-n // shard_docs))
    ranges = min(shards, max(shuffle_parts(spark), shards // RANGE_SHARDS))
    rows = encoded.where(F.col("n").isNotNull()).select("key", "doc_id", "n", "ids").repartitionByRange(ranges, "key")
    dealt = rows.sortWithinPartitions("key", "doc_id", "ids").select("doc_id", "n", "ids", F.spark_partition_id().cast("long").alias("range"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_bpe.release()  # the words met while encoding
        known, at, packer = shared.value, None, None
        held: dict[int, tuple[int | None, np.ndarray]] = {}  # documents of open windows, by number
        waiting: list[tuple[int | None, np.ndarray]] = []
        made, k = [], 0

        def piece_rows(window_: list[tuple[int, int, int]]) -> None:
            nonlocal k
            place = 0
            for doc, start, n in window_:
                name, ids = held[doc]
                made.append((name, start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), len(ids), at << 32 | k, place))
                place += n
            k += 1

        def flush(last: bool) -> None:
            if waiting:
                held.update(enumerate(waiting, packer.numbered))
                for w in packer.shard([x for _, x in waiting]):
                    piece_rows(w)
                waiting.clear()
                still = {d for d, _, _ in packer.pieces}
                for d in [d for d in held if d not in still]:
                    del held[d]
            if last and packer:
                for w in packer.rest():
                    piece_rows(w)
                held.clear()

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*made)]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for name, size, blob, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                if of != at:
                    flush(True)
                    at, packer, k = of, Packer(known, window), 0
                elif len(waiting) == shard_docs:
                    flush(False)
                waiting.append((name, _ids(blob.as_py(), size)))
                if len(made) > 50_000:
                    yield batch_of()
        flush(True)
        if made:
            yield batch_of()

    return dealt.mapInArrow(run, SCHEMA)
