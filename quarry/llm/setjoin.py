"""Operator 6, an n-gram Jaccard join by universe-partition pigeonhole.

Sets of word shingles fall into size bands; a set also shows up in the bands
above in which a linked set could lie. Sets of a band that link differ by at
most T shingles. A hash partitions the shingle universe into segments, and one
of two allocations serves a band, whichever costs fewer keys:

exact    T + 1 + e + h segments: at least 1 + e + h of them hold the same
         subset in both sets. Empty subsets get no key; e is chosen so that
         nearly all sets have at most e of them. If either set does, 1 + h
         shared keys remain. Sets that have more (for pairs of two such sets)
         also get the keys of the other allocation.
deletion (T + 1) / 2 segments: at least one differs by at most one shingle, so
         one set's subset is the other's, or its one-deletion neighbour. The
         keys are all subsets and all their one-deletion neighbours.

A key of more than HOT documents is hot. A document with at most h hot keys in
a band shares some other key with each set it links with there, so hot keys
are followed only among documents that have more, and for deletion keys; a
passage that a third of all documents hold costs those documents nothing.

Keys travel packed, by bucket, each batch having met its own repeated keys
first. Sets that share a key are candidates of the key's smallest document
(a star, never all pairs of a key). First each document is compared with the
candidate it shares most keys with. Documents of keys that then still lie in
different components are compared around their key's centre, in blocks of TILE,
by signatures: a byte for each segment, of which linked sets differ in no more
than in shingles. Where few pairs pass, these leave the task and are verified
exactly on whole sets; where many pass, as in a large group of near copies, the
block's whole sets are sent there, all its pairs are verified exactly in the task, and
only links that join components leave it. Blocks of one component alone aren't
compared, as pairs inside a component can't change the result. So no link
between components is lost, whatever the sizes of groups.

Shingles are compared by 64-bit hashes. Words are as the contract has them:
A-Z lower-cased, runs of anything but ASCII white space. Null and empty texts
have an empty set, n_shingles 0, and are linked with nothing, and so is every
document of an empty table; very long texts have large sets like any other;
ties between candidates go to the smaller doc_id; other columns, whatever their
names, are not read. Rows of one doc_id count as one document; rows without
doc_id are returned as they are, their component null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import byte_bpe
from quarry.llm.bpe_codec import in_slices
from quarry.llm.common import discard, materialize, shuffle_parts, texts
from quarry.llm.components import UnionFind, components

#: Ratio of a band's sizes, segments kept for hot keys (a share), a key's documents before it is hot.
RATIO, SPARE, HOT = 1.4, 0.1, 64
#: Documents of a block that is compared at once, bits of the map of needed documents, characters a bucket.
TILE, MAP_BITS, BUCKET_CHARS = 512, 1 << 24, 1 << 23
#: Routes of at most so many rows (some 10 MB) are broadcast; steps to the root of a hot key's centre.
FEW, HOPS = 200_000, 4
#: Low bits of a key: its band, and whether it is one of the deletion allocation.
TAG = np.uint64(127)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _salt(n: int) -> np.uint64:
    return np.uint64(n * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    digest = xxhash.xxh3_64_intdigest
    words = np.array([digest(w) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()], dtype=np.uint64)
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    h = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        h = mix(h * _STEP + words[j : n - width + 1 + j])
    return np.unique(h)


class Bands:
    """Size bands and allocations for Jaccard >= num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lower: list[int] = [1]
        self.known: dict[int, tuple[int, int, int, int]] = {}

    def band(self, b: int) -> tuple[int, int]:
        """Smallest and largest size of band b."""
        while len(self.lower) < b + 2:
            self.lower.append(max(self.lower[-1] + 1, int(self.lower[-1] * RATIO)))
        return self.lower[b], self.lower[b + 1] - 1

    def of(self, size: int) -> list[int]:
        """The bands of a size: its own, and those above in which a linked set
        can lie."""
        b = 0
        while self.band(b)[1] < size:
            b += 1
        out = [b]
        while self.den * size >= self.num * self.band(out[-1] + 1)[0]:
            out.append(out[-1] + 1)
        return out

    def most_apart(self, b: int) -> int:
        """T: the largest symmetric difference of linked sets of band b."""
        return (self.den - self.num) * 2 * self.band(b)[1] // (self.den + self.num)

    def allocation(self, b: int) -> tuple[int, int, int, int]:
        """(segments of the exact allocation or 0, its e, its h, segments of
        the deletion allocation or 0)."""
        if b not in self.known:
            self.known[b] = self._allocate(b)
        return self.known[b]

    def _allocate(self, b: int) -> tuple[int, int, int, int]:
        least, t = self.band(b)[0], self.most_apart(b)
        if t == 0:
            return 1, 0, 0, 0
        # e: the mean number of empty segments and 2.6 deviations; it and h grow with the number of segments
        m = t + 2
        while m <= 0.75 * least:
            p = math.exp(-least / m)
            e, h = math.ceil(m * p + 2.6 * math.sqrt(m * p * (1 - p))), max(1, math.ceil(SPARE * m))
            if t + 1 + e + h <= m:
                return m, m - t - 1 - h, h, (t + 2) // 2
            m = t + 1 + e + h
        return 0, 0, 0, (t + 2) // 2

    def width(self, b: int) -> int:
        """Bytes of a signature of band b."""
        return self.allocation(b)[0] or 2 * self.most_apart(b) + 16

    def split(self, size: int, sig: bytes) -> dict[int, bytes]:
        """A document's signatures by band."""
        out, at = {}, 0
        for b in self.of(size):
            out[b] = sig[at : at + self.width(b)]
            at += self.width(b)
        return out


def _tagged(keys: np.ndarray, b: int, deletion: bool) -> np.ndarray:
    return (keys & ~TAG) | np.uint64((b & 63) * 2 + deletion)


def set_keys(s: np.ndarray, bands: Bands) -> tuple[np.ndarray, bytes]:
    """All keys of one set, for each of its bands, and its signatures."""
    out, sigs = [], []
    v = mix(s + _STEP)
    for b in bands.of(len(s)):
        exact, e, _, halves = bands.allocation(b)
        empty = e + 1
        if exact:
            _, counts, sums = _segments(s, v, exact)
            held = np.flatnonzero(counts)
            empty = exact - len(held) if exact > 1 else 0
            out.append(_tagged(mix(mix(sums[held] + _salt(b * 2)) + held.astype(np.uint64)), b, False))
            sigs.append(sums)
        else:
            sigs.append(_segments(s, v, bands.width(b))[2])
        if halves and empty > e:
            seg, _, sums = _segments(s, v, halves)
            base = _salt(b * 2 + 1)
            out.append(_tagged(mix(mix(sums + base) + np.arange(halves, dtype=np.uint64)), b, True))
            out.append(_tagged(mix(mix(sums[seg] - v + base) + seg.astype(np.uint64)), b, True))
    return np.unique(np.concatenate(out)), b"".join((mix(x) >> np.uint64(56)).astype(np.uint8).tobytes() for x in sigs)


def _segments(s: np.ndarray, v: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(each shingle's segment, segments' sizes, and sums of their values)."""
    seg = (s >> np.uint64(9)).astype(np.int64) % m
    counts = np.bincount(seg, minlength=m)
    sums = np.zeros(m, dtype=np.uint64)
    held = np.flatnonzero(counts)
    sums[held] = np.add.reduceat(v[np.argsort(seg, kind="stable")], (np.cumsum(counts) - counts)[held])
    return seg, counts, sums


DOCS, KEYS, LINKS, STARS, GROUPS, HOT_KEYS = 0, 1, 2, 3, 4, 5


def _mark(ids: np.ndarray) -> np.ndarray:
    """Hashes of ids, none of them 0; their sum tells a key's members."""
    return mix(ids.view(np.uint64) + _STEP) | np.uint64(1)


def _blob(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).view(np.int64).tobytes() for c in columns)


def _columns(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.int64).reshape(n, -1)


def _pack(key: np.ndarray, doc: np.ndarray) -> bytes:
    """Keys, and documents as offsets, in four bytes where that suffices."""
    low = int(doc.min())
    width = 4 if int(doc.max()) - low < 1 << 32 else 8
    return np.array([low, width], dtype=np.int64).tobytes() + key.tobytes() + (doc - low).astype(f"<u{width}").tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    low, width = np.frombuffer(blob, dtype=np.int64, count=2)
    n = (len(blob) - 16) // (8 + int(width))
    return np.frombuffer(blob, dtype=np.int64, count=n, offset=16), np.frombuffer(blob, dtype=f"<u{width}", offset=16 + 8 * n).astype(np.int64) + low


def _heads(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, dtype=np.int64)


def _emit(docs: DataFrame, k: int, num: int, den: int, buckets: int) -> DataFrame:
    """Packed rows by bucket: documents, links of equal sets, stars inside a
    slice, and keys: those of one document of the slice (KEYS), and those of
    several, with the smallest one, their mark and number (GROUPS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, turn = Bands(num, den), 0
        byte_bpe.release()
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, rows in in_slices(batch.column(1), rows=2048, chars=1 << 22):
                sets = [shingles(t, k) for t in rows]
                size = np.array([len(s) for s in sets], dtype=np.int64)
                known: dict[bytes, int] = {}
                sigs = [b""] * len(rows)
                links, keys, owners = [], [], []
                for at in sorted((i for i, s in enumerate(sets) if len(s) and names[first + i] is not None), key=lambda i: names[first + i]):
                    doc, s = names[first + at], sets[at]
                    if (same := known.setdefault(s.tobytes(), doc)) != doc:
                        links.append((same, doc))
                        continue
                    found, sigs[at] = set_keys(s, bands)
                    keys.append(found)
                    owners.append(np.full(len(found), doc, dtype=np.int64))
                rows_out: list[tuple[int, int, bytes, bytes | None]] = []
                turn += 1
                valid = np.array([names[first + i] is not None for i in range(len(rows))])
                ids = np.array([names[first + i] or 0 for i in range(len(rows))], dtype=np.int64)
                signed = np.array([len(x) for x in sigs], dtype=np.int64)
                rows_out.append((turn % buckets, DOCS, _blob(ids, size, valid.astype(np.int64), signed), b"".join(sigs)))
                if links:
                    rows_out.append((turn % buckets, LINKS, _blob(*np.array(links, dtype=np.int64).T), None))
                if keys:
                    key, doc = np.concatenate(keys).view(np.int64), np.concatenate(owners)
                    order = np.lexsort((doc, key))
                    key, doc = key[order], doc[order]
                    new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
                    key, doc = key[new], doc[new]
                    head = _heads(key)
                    n = np.diff(np.r_[head, len(key)])
                    again = np.ones(len(key), dtype=bool)
                    again[head] = False
                    if again.any():
                        rows_out.append((turn % buckets, STARS, _blob(key[again], np.repeat(doc[head], n)[again], doc[again]), None))
                    mark = np.add.reduceat(_mark(doc), head).view(np.int64)
                    key, doc = key[head], doc[head]
                    bucket = (mix(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    key, doc, bucket, mark, n = key[order], doc[order], bucket[order], mark[order], n[order]
                    start = _heads(bucket)
                    for i, j in zip(start, [*start[1:], len(bucket)]):
                        one, more = i + np.flatnonzero(n[i:j] == 1), i + np.flatnonzero(n[i:j] > 1)
                        if len(one):
                            rows_out.append((int(bucket[i]), KEYS, _pack(key[one], doc[one]), None))
                        if len(more):
                            rows_out.append((int(bucket[i]), GROUPS, _blob(key[more], doc[more], mark[more], n[more]), None))
                a, b, c, e = zip(*rows_out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.binary()), pa.array(e, pa.binary())], names=["bucket", "kind", "blob", "sigs"])

    return texts(docs).mapInArrow(run, "bucket int, kind int, blob binary, sigs binary")


def _meet(packed: DataFrame, parts: int) -> DataFrame:
    """kind, key, a, b, sig: documents (key: valid id, a: id, b: set size),
    links (a, b), stars (key, its smallest document, another), hot keys."""

    def rows(kind: int, *columns: np.ndarray, sig: list[bytes | None] | None = None) -> pa.RecordBatch:
        n = len(columns[0])
        columns = [pa.array(np.full(n, kind, dtype=np.int32)), *(pa.array(c) for c in columns), pa.array(sig or [None] * n, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "key", "a", "b", "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            """The bucket's keys: (key, document, mark, documents) of all slices."""
            if not held:
                return
            key, doc, mark, n = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.argsort(key, kind="stable")
            key, doc, mark, n = key[order], doc[order], mark[order], n[order]
            head = _heads(key)
            size = np.diff(np.r_[head, len(key)])
            total, marks, least = np.add.reduceat(n, head), np.add.reduceat(mark.view(np.uint64), head), np.minimum.reduceat(doc, head)
            hot = total > HOT
            if hot.any():
                yield rows(HOT_KEYS, key[head][hot], least[hot], least[hot])
            # of keys with the same members, those inside slices included, one says it all; hot ones are counted, so they stay
            first = hot.copy()
            several = np.flatnonzero((size > 1) & ~hot)
            first[several[np.unique(marks[several], return_index=True)[1]]] = True
            again = np.repeat(first, size) & (doc != np.repeat(least, size))
            yield rows(STARS, key[again], np.repeat(least, size)[again], doc[again])

        for batch in batches:
            for at, kind, blob, sigs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                blob = blob.as_py()
                if at != bucket:
                    yield from close()
                    bucket = at
                if kind == KEYS:
                    key, doc = _unpack(blob)
                    held.append((key, doc, _mark(doc).view(np.int64), np.ones(len(key), dtype=np.int64)))
                elif kind == GROUPS:
                    held.append(tuple(_columns(blob, 4)))
                elif kind == LINKS:
                    a, b = _columns(blob, 2)
                    yield rows(LINKS, np.zeros(len(a), dtype=np.int64), a, b)
                elif kind == STARS:
                    yield rows(STARS, *_columns(blob, 3))
                else:
                    ids, size, valid, signed = _columns(blob, 4)
                    ends, sigs = np.cumsum(signed).tolist(), sigs.as_py()
                    yield rows(DOCS, valid, ids, size, sig=[sigs[j - i : j] or None for i, j in zip(signed.tolist(), ends)])
        yield from close()

    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "kind int, key long, a long, b long, sig binary")


def _passing(pairs: DataFrame, signed: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose signatures let them link. The join that may be
    skewed, on a, comes first, while its rows are short."""
    left, right = (signed.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}")) for c in "ab")
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "sa", "nb", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            keep = []
            for na, sa, nb, sb in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                low, high = sorted(((na, sa), (nb, sb)))
                b = bands.of(high[0])[0]
                x, y = bands.split(*low).get(b), bands.split(*high)[b]
                apart = (den - num) * (na + nb) // (den + num)
                keep.append(x is not None and den * low[0] >= num * high[0] and int((np.frombuffer(x, dtype=np.uint8) != np.frombuffer(y, dtype=np.uint8)).sum()) <= apart)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long").distinct()


def _needed(docs: DataFrame, need: DataFrame, k: int) -> DataFrame:
    """id, blob (the whole shingle set) of the documents in need, and of a few
    others: a bit map of fixed size tells which texts are looked at, so that
    texts aren't shuffled."""
    spark = docs.sparkSession
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    words = need.select(place(F.col("id")).alias("h")).groupBy((F.col("h") / 32).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h % 32 AS INT))")).alias("m")).toArrow()
    bits = np.zeros(MAP_BITS // 32, dtype=np.uint32)
    bits[words["w"].to_numpy()] = words["m"].to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(bits.tobytes())  # MAP_BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(shared.value, dtype=np.uint32)
        for batch in batches:
            h = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((held[h // 32] >> (h % 32).astype(np.uint32)) & 1 == 1))
            for first, rows in in_slices(batch.column(1), rows=512, chars=1 << 22):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), pa.array([shingles(t, k).tobytes() for t in rows], pa.binary())], names=["id", "blob"])

    rows = texts(docs).where(F.col("doc_id").isNotNull()).withColumn("h", place(F.col("doc_id")))
    return rows.mapInArrow(run, "id long, blob binary")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int, per_task: int = 4000) -> DataFrame:
    """The pairs (a, b) that link, compared on whole sets. A document with
    many candidates is sent to several tasks."""
    parts = shuffle_parts(pairs.sparkSession)
    count = pairs.groupBy("a").agg(F.ceil(F.count("*") / per_task).cast("int").alias("n"))
    left = count.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), F.lit(False).alias("second"))
    right = pairs.join(count, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("part"), F.lit(True).alias("second"))
    routes = materialize(left.union(right), "routes")
    # few routes go to the sets, many meet them by a shuffle
    few = routes.count() <= FEW
    met = (F.broadcast(routes) if few else routes).join(sets.select("id", "blob"), "id").select("id", "a", "part", "second", "blob")
    met = met.repartition(parts, "a", "part").sortWithinPartitions("a", "part", "second")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, firsts = None, []
        for batch in batches:
            out = []
            for b, a, part, second, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                s = np.frombuffer(blob.as_py(), dtype=np.uint64)
                if (a, part) != at:
                    at, firsts = (a, part), []
                if not second:
                    firsts.append(s)
                    continue
                for other in firsts:
                    if not len(s) or not len(other) or den * min(len(s), len(other)) < num * max(len(s), len(other)):
                        continue
                    both = np.concatenate([s, other])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if den * shared >= num * (len(both) - shared):
                        out.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return met.mapInArrow(compare, "a long, b long")


def _near(ids: np.ndarray, label: np.ndarray, n: np.ndarray, sigs: list[dict[int, bytes]], side: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different components that their signatures let link; side: 0
    and 1 are compared with each other, 2 with all."""
    own = np.array([min(s) if s else -1 for s in sigs])
    for b in np.unique(own[own >= 0]):
        first = np.flatnonzero(own == b)
        second = np.array([i for i in range(len(ids)) if b in sigs[i]])  # its own band or one below
        width = len(sigs[first[0]][b])
        x = np.frombuffer(b"".join(sigs[i][b] for i in first), dtype=np.uint8).reshape(-1, width)
        y = np.frombuffer(b"".join(sigs[i][b] for i in second), dtype=np.uint8).reshape(-1, width)
        step = max(1, (1 << 23) // max(1, y.size))
        for k in range(0, len(first), step):
            p = first[k : k + step]
            fits = (label[p, None] != label[second]) & ((side[p, None] != side[second]) | (side[second] == 2))
            fits &= (own[second] < b) | (p[:, None] < second)
            fits &= den * np.minimum(n[p, None], n[second]) >= num * np.maximum(n[p, None], n[second])
            i, j = np.nonzero(fits)
            if len(i):
                most = (den - num) * (n[p[i]] + n[second[j]]) // (den + num)
                keep = np.concatenate([(x[k + i[z : z + 4096]] != y[j[z : z + 4096]]).sum(1) for z in range(0, len(i), 4096)]) <= most
                yield ids[p[i[keep]]], ids[second[j[keep]]]


def _joining(ids: np.ndarray, label: np.ndarray, sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join components, of all pairs of whole sets: shared shingles
    are counted by products of matrices over shingles of several documents."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    head = _heads(flat)
    held = np.diff(np.r_[head, len(flat)])
    column = np.repeat(np.cumsum(held > 1) - 1, held)[np.repeat(held > 1, held)]
    of = of[np.repeat(held > 1, held)]
    shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, int((held > 1).sum()), 4096):
        i, j = np.searchsorted(column, [low, low + 4096])
        x = np.zeros((len(sets), min(4096, int((held > 1).sum()) - low)), dtype=np.float32)
        x[of[i:j], column[i:j] - low] = 1
        shared += x @ x.T
    fits = (den * shared.astype(np.int64) >= num * (n[:, None] + n - shared.astype(np.int64))) & (n[:, None] > 0) & (n > 0)
    fits &= (label[:, None] != label) & ((side[:, None] != side) | (side == 2))
    groups, out = UnionFind(), []
    for i, j in zip(*np.nonzero(np.triu(fits, 1))):
        a, b = groups.find(int(label[i])), groups.find(int(label[j]))
        if a != b:
            groups.union(a, b)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _by_tile(rows: DataFrame, parts: int, n: int, close: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """close(tile, columns) for each tile's rows; a tile is rows' first three
    columns, the n others are given as tuples."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.bool_() if x.endswith("boolean") else pa.int64() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3 + n))):
                if row[:3] != at:
                    if held:
                        out += close(at, *zip(*held))
                    at, held = row[:3], []
                held.append(row[3:])
            if len(out) > 50_000:
                yield _table(out, names, kinds)
                out = []
        if held:
            out += close(at, *zip(*held))
        yield _table(out, names, kinds)

    return rows.repartition(parts, *rows.columns[:3]).sortWithinPartitions(*rows.columns[:3]).mapInArrow(run, schema)


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(names), kinds)], names=names)


def _placed(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, blk, x, c) of members (g, x, c) of groups with several components:
    large components have blocks of their own, the others share them; and the
    tiles (g, i, j): pairs of blocks that hold several components."""
    each = members.groupBy("g", "c").agg(F.count("*").alias("n"))
    group = each.groupBy("g").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"), F.sum(F.when(F.col("n") < TILE, F.col("n")).otherwise(0)).alias("rest")).where("kinds > 1")
    blocks = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    share = lambda of: F.pmod(F.xxhash64("x"), of)
    blk = F.when(F.col("all") <= TILE, F.lit(0)).when(F.col("n") < TILE, F.xxhash64(F.lit(0), share(blocks("rest")))).otherwise(F.xxhash64(F.lit(1), F.col("c"), share(blocks("n"))))
    placed = materialize(members.join(each.join(group, "g"), ["g", "c"]).select("g", blk.cast("long").alias("blk"), "x", "c"), "placed")
    held = placed.groupBy("g", "blk").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    other = held.select("g", F.col("blk").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    tiles = held.join(other, "g").where("blk <= j AND NOT (lo = hi AND lo2 = hi2 AND lo = lo2)")
    return placed, tiles.select("g", F.col("blk").alias("i"), "j")


def _ends(tiles: DataFrame, placed: DataFrame) -> DataFrame:
    """g, i, j, side, x, c: the members of each tile; side 2 in a tile of one
    block, else 0 or 1."""
    side = lambda blk, n: F.struct(F.col(blk).alias("blk"), F.lit(n).cast("long").alias("side"))
    sides = F.when(F.col("i") == F.col("j"), F.array(side("i", 2))).otherwise(F.array(side("i", 0), side("j", 1)))
    return tiles.select("g", "i", "j", F.explode(sides).alias("e")).select("g", "i", "j", "e.blk", "e.side").join(placed, ["g", "blk"]).select("g", "i", "j", "side", "x", "c")


def _cross(members: DataFrame, signed: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """Links (a, b) between components of the same group; members: g, x, c."""
    parts = shuffle_parts(members.sparkSession)
    placed, tiles = _placed(members)
    ends = materialize(_ends(tiles, placed), "ends")
    rows = ends.join(signed, F.col("x") == F.col("id")).select("g", "i", "j", "side", "x", "c", "n", "sig")

    def look(tile: tuple, side: tuple, ids: tuple, label: tuple, n: tuple, sigs: tuple) -> list[tuple]:
        bands, size = Bands(num, den), np.array(n)
        table = [bands.split(z, s) if s else {} for z, s in zip(n, sigs)]
        found = list(_near(np.array(ids), np.array(label), size, table, np.array(side), num, den))
        if sum(len(a) for a, _ in found) > 4 * len(ids):
            return [(*tile, None, None)]
        return [(None, None, None, min(p), max(p)) for a, b in found for p in zip(a.tolist(), b.tolist())]

    seen = materialize(_by_tile(rows, parts, 5, look, "g long, i long, j long, a long, b long"), "seen")
    pairs = seen.where(F.col("a").isNotNull()).select("a", "b").distinct()
    dense = ends.join(seen.where(F.col("a").isNull()).select("g", "i", "j").distinct(), ["g", "i", "j"], "left_semi")
    need = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(dense.select("x")).distinct()
    sets = materialize(sets_of(need), "sets")
    whole = dense.join(sets, F.col("x") == F.col("id")).select("g", "i", "j", "side", "x", "c", "blob")

    def verify(tile: tuple, side: tuple, ids: tuple, label: tuple, blobs: tuple) -> list[tuple]:
        return _joining(np.array(ids), np.array(label), [np.frombuffer(x, dtype=np.uint64) for x in blobs], np.array(side), num, den)

    links = _verify(pairs, sets, num, den).union(_by_tile(whole, parts, 4, verify, "a long, b long"))
    links = materialize(links, "links")
    discard(placed, ends, seen, sets)
    return links


def _open_members(stars: DataFrame, hot: DataFrame, best: DataFrame, label: DataFrame, num: int, den: int) -> DataFrame:
    """g, x, c: documents x, of component c, of keys whose members lie in
    different components, by the keys' centres. Of hot keys, those documents
    that no other key is sure to serve."""
    of = lambda c, into: label.select(F.col("id").alias(c), F.col("component_id").alias(into))
    ends = stars.select("a", "b").distinct().join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left")
    apart = materialize(ends.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "apart")
    keys = stars.join(apart, ["a", "b"], "left_semi").select("key").distinct()
    members = stars.join(keys, "key", "left_semi").select("key", F.explode(F.array("a", "b")).alias("x")).distinct()
    centre = members.groupBy("key").agg(F.min("x").alias("g")).join(hot.withColumn("hot", F.lit(True)), "key", "left")
    members = materialize(members.join(centre, "key").select("key", "g", "x", F.coalesce("hot", F.lit(False)).alias("hot")), "members")
    bands = Bands(num, den)
    spare = F.element_at(F.array(*[F.lit(bands.allocation(b)[2]) for b in range(64)]), F.shiftright(F.col("key").bitwiseAND(127), 1).cast("int") + 1)
    warm = members.where("hot").withColumn("sort", F.col("key").bitwiseAND(127)).withColumn("h", spare)
    busy = warm.where("sort % 2 = 0").groupBy("x", "sort", "h").agg(F.count("*").alias("n")).where("n > h").select("x", "sort")
    warm = warm.where("sort % 2 = 1").select("g", "x").union(warm.join(busy, ["x", "sort"], "left_semi").select("g", "x")).distinct()
    # centres of hot keys of one group of copies meet at their root
    up = best.select(F.col("b").alias("z"), F.col("a").alias("up"))  # a is always the smaller id
    centres = warm.select("g", F.col("g").alias("root")).distinct()
    for _ in range(HOPS):
        centres = centres.join(up, F.col("root") == F.col("z"), "left").select("g", F.coalesce("up", "root").alias("root"))
    warm = warm.join(centres, "g").select(F.col("root").alias("g"), "x")
    found = members.where("NOT hot").select("g", "x").union(warm).distinct()
    found = materialize(found.join(of("x", "c"), "x", "left").select("g", "x", F.coalesce("c", "x").alias("c")), "open")
    discard(apart, members)
    return found


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    parts = shuffle_parts(docs.sparkSession)
    chars = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(2 * parts, -(-chars // BUCKET_CHARS))
    met = materialize(_meet(_emit(docs, k, num, den, buckets), max(parts, buckets // 8)), "met")
    rows = met.where(F.col("kind") == DOCS).select(F.when(F.col("key") == 1, F.col("a")).alias("id"), F.col("b").alias("n_shingles"))
    signed = met.where((F.col("kind") == DOCS) & (F.col("key") == 1) & F.col("sig").isNotNull()).select(F.col("a").alias("id"), F.col("b").alias("n"), "sig")
    stars, hot = met.where(F.col("kind") == STARS).select("key", "a", "b"), met.where(F.col("kind") == HOT_KEYS).select("key")
    pairs = stars.groupBy("a", "b").agg(F.count("*").alias("keys"))
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct(F.col("keys"), -F.col("a"))).alias("a")).select("a", "b")
    best = materialize(best, "best")
    passing = materialize(_passing(best, signed, num, den), "passing")
    sets_of = lambda need: _needed(docs, need, k)
    sets = materialize(sets_of(passing.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "sets")
    links = materialize(met.where(F.col("kind") == LINKS).select("a", "b").union(_verify(passing, sets, num, den)), "links")
    discard(passing, sets)
    label = components(links)
    members = _open_members(stars, hot, best, label, num, den)
    more = _cross(members, signed, sets_of, num, den)
    if not more.isEmpty():
        label = components(label.select(F.col("id").alias("a"), F.col("component_id").alias("b")).union(more))
    return rows.join(label, "id", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """The rows of docs, all columns, but for those whose component has a
    smaller doc_id: one document of each group stays. Repeated rows of that
    document all stay, and so do rows without doc_id, copies or not."""
    found = jaccard_components(docs, k, num, den)
    gone = found.where(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")


def oracle(k: int = 4, num: int = 85, den: int = 100) -> str:
    """The same in DuckDB's SQL over documents, by counting shared shingles."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * c >= {num} * (x.n_shingles + y.n_shingles - c)),
m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT m.b, r.r FROM r JOIN m ON m.a = r.doc_id)
SELECT n.doc_id, n_shingles, min(r.r) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY ALL"""
