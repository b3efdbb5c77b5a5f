"""Operator 3, token ids in sorted-string-table shards.

A shard file holds the documents of one key range:

    data blocks   entries sorted by key, keys prefix-compressed against the
                  one before, in full at each restart point; the restart
                  points' offsets, their number and a crc32 end the block
    block index   for each block: its last key, offset and length
    Bloom filter  about 10 bits a key, 7 probes
    footer        fixed length: offsets of index and filter, counts, id width

An entry is varint(shared key bytes), varint(other key bytes), varint(value
bytes), those key bytes, and the ids as little-endian integers of the footer's
width. Keys are doc_ids as 8 big-endian bytes that sort like the numbers; a
null doc_id is the empty key and sorts first.

Writing: one range partitioning by doc_id, then each task streams its rows
into a file of its own in the shared folder, so a repeated task can't damage
what another has written; only files that the manifest names count. The
manifest (one row a shard) carries the exclusive sums of ids before a shard.
Reading: one task a shard, one block at a time. lookup() finds single
documents by filter, binary search in the index and binary search over the
restart points.

Null and empty texts are documents with the end id alone. Rows that repeat a
doc_id all stay, in order of their text's hash.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import word_bpe
from quarry.llm.bpe_codec import in_slices
from quarry.llm.common import fresh_dir, materialize, shuffle_parts, texts

MAGIC = b"QSSTABL1"
FOOTER = struct.Struct("<QQQQQQB7x8s")  # index at, length, filter at, length, documents, ids, width, magic
BLOCK_BYTES, RESTART, BITS, PROBES = 1 << 16, 16, 10, 7
MANIFEST = "shard int, path string, n_docs long, n_ids long, first_key binary, last_key binary, n_bytes long"


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Streams (key, ids) in ascending key order into an open file."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[np.ndarray] = []
        self.keys: list[bytes] = []
        self.docs = self.ids = 0
        self.first = self.last = b""
        self._begin()

    def _begin(self) -> None:
        self.block, self.size, self.restarts, self.entries, self.before = [], 0, [], 0, b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.docs and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.entries % RESTART:
            while shared < min(len(key), len(self.before)) and key[shared] == self.before[shared]:
                shared += 1
        else:
            self.restarts.append(self.size)
        value = ids.astype(f"<u{self.width}").tobytes()
        entry = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:]
        self.block += [entry, value]
        self.size += len(entry) + len(value)
        self.first = key if not self.docs else self.first
        self.entries, self.before, self.last = self.entries + 1, key, key
        self.docs, self.ids = self.docs + 1, self.ids + len(ids)
        self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            data = b"".join(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            data += struct.pack("<I", zlib.crc32(data))
            self.out.write(data)
            self.index.append((self.before, self.at, len(data)))
            self.at += len(data)
            self._begin()

    def close(self) -> int:
        """Writes what remains; returns the file's length."""
        self._flush()
        index = b"".join(varint(len(k)) + k + varint(at) + varint(n) for k, at, n in self.index)
        bits = max(64, BITS * len(self.keys))
        bloom = np.zeros(bits, dtype=bool)
        for key in self.keys:
            bloom[_probes(key, bits)] = True
        packed = struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
        self.out.write(index + packed)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.docs, self.ids, self.width, MAGIC))
        return self.at + len(index) + len(packed) + FOOTER.size


class Reader:
    """One shard file, opened by path or URI."""

    def __init__(self, uri: str):
        system, path = pafs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        (index_at, index_n, self.bloom_at, self.bloom_n, self.docs, self.ids, self.width, magic) = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri}: not a shard file")
        data, at = self.file.read_at(index_n, index_at), 0
        self.last_keys: list[bytes] = []
        self.blocks: list[tuple[int, int]] = []
        while at < len(data):
            n, at = read_varint(data, at)
            key = data[at : at + n]
            offset, at = read_varint(data, at + n)
            length, at = read_varint(data, at)
            self.last_keys.append(key)
            self.blocks.append((offset, length))

    def close(self) -> None:
        self.file.close()

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        offset, length = self.blocks[k]
        data = self.file.read_at(length, offset)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block's crc32 differs")
        (n,) = struct.unpack("<I", data[-8:-4])
        return data[: -8 - 4 * n], list(struct.unpack(f"<{n}I", data[-8 - 4 * n : -8]))

    def _entries(self, data: bytes, at: int) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < len(data):
            shared, at = read_varint(data, at)
            other, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + other]
            at += other
            yield key, np.frombuffer(data, dtype=f"<u{self.width}", count=size // self.width, offset=at)
            at += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.blocks)):
            for key, ids in self._entries(self._block(k)[0], 0):
                yield id_of(key), ids

    def may_hold(self, key: bytes) -> bool:
        (bits,) = struct.unpack("<Q", self.file.read_at(8, self.bloom_at))
        for p in _probes(key, bits):
            if not self.file.read_at(1, self.bloom_at + 8 + p // 8)[0] >> (7 - p % 8) & 1:
                return False
        return True

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all documents with this identifier."""
        from bisect import bisect_left

        key, out = key_of(doc_id), []
        if not self.may_hold(key):
            return out
        for k in range(bisect_left(self.last_keys, key), len(self.blocks)):
            data, restarts = self._block(k)
            first = [next(self._entries(data, r))[0] for r in restarts] if len(restarts) <= 2 else None
            lo, hi = 0, len(restarts)
            while lo < hi:  # the first restart point at or above the key
                mid = (lo + hi) // 2
                at = first[mid] if first else next(self._entries(data, restarts[mid]))[0]
                lo, hi = (mid + 1, hi) if at < key else (lo, mid)
            for found, ids in self._entries(data, restarts[max(0, lo - 1)]):
                if found > key:
                    return out
                if found == key:
                    out.append(ids)
        return out


def write_shards(docs: DataFrame, folder: str, vocab: str = "word_bpe_49k.json", end_id: int = 1, shards: int | None = None) -> DataFrame:
    """Encodes and writes all documents; returns the manifest, in files."""
    spark = docs.sparkSession
    keyed = texts(docs).repartitionByRange(shards or shuffle_parts(spark), "doc_id")
    keyed = keyed.sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = out = None
        codec = word_bpe.codec(vocab)
        system, base = pafs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.sst"
        end = np.array([end_id], dtype=codec.dtype)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, rows in in_slices(batch.column(1)):
                for k, ids in enumerate(codec.encode(rows), first):
                    if writer is None:
                        system.create_dir(base, recursive=True)
                        out = system.open_output_stream(f"{base}/{name}")
                        writer = Writer(out, codec.dtype.itemsize)
                    writer.add(key_of(keys[k]), np.concatenate([ids, end]))
        if writer is not None:
            size = writer.close()
            out.close()
            row = {"shard": shard, "path": f"{folder}/{name}", "n_docs": writer.docs, "n_ids": writer.ids, "first_key": writer.first, "last_key": writer.last, "n_bytes": size}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("n_bytes", pa.int64())]))

    return materialize(keyed.mapInArrow(run, MANIFEST), "manifest")


def read_shards(manifest: DataFrame, shards: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard file
    rows = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("base"))
    rows = rows.repartitionByRange(shards or shuffle_parts(manifest.sparkSession), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader, start, found = Reader(row["path"]), row["base"], []
                for doc_id, ids in reader.scan():
                    found.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(found) == 4096:
                        yield _rows(found)
                        found = []
                reader.close()
                yield _rows(found)

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, ids of the documents that keys (doc_id) name, read from the
    shards whose key range holds them. Ids that no shard holds give no row."""

    def encode(c):
        return F.when(c.isNull(), F.lit(b"")).otherwise(F.unhex(F.lpad(F.hex(c.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")))

    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("key", encode(F.col("doc_id")))
    shards = manifest.select("path", "first_key", "last_key")
    found = asked.join(shards, (F.col("key") >= F.col("first_key")) & (F.col("key") <= F.col("last_key"))).select("path", "doc_id")
    found = found.repartition("path").sortWithinPartitions("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = path = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["path"] != path:
                    if reader:
                        reader.close()
                    path = row["path"]
                    reader = Reader(path)
                out += [(row["doc_id"], ids.astype(np.int32)) for ids in reader.get(row["doc_id"])]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int64()), pa.array([i for _, i in out], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return found.mapInArrow(run, "doc_id long, ids array<int>")


def write_and_read(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Writes the shards below the shared folder and reads them back whole."""
    return read_shards(write_shards(docs, fresh_dir(spark, "sst"), **options))
