"""Operator 1, BPE encoding and decoding by forced-boundary splitting.

Texts are cut where a byte pair that stands in no token of the vocabulary
makes a token boundary certain; the fragments are encoded independently and
concatenated (byte_bpe.py has the argument). Fragments repeat, so each Python
worker keeps those it has met in a table of bounded size; those it has not met
are cut further inside their pre-tokens and merged together, as arrays. Rows
stay in their partitions: no shuffle, no driver work.

Null texts count as empty: no ids, and the digest of the empty text. Repeated
rows give repeated rows; a null doc_id stays null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import byte_bpe
from quarry.llm.common import texts

#: Texts whose new fragments are merged together, unless they are very long.
TEXTS, CHARS = 256, 1 << 21


class Codec(byte_bpe.FragmentTable):
    """encode(texts) -> arrays of ids, decode(ids) -> text, exactly as the
    tokenizers library's encode(..., add_special_tokens=False) and
    decode(..., skip_special_tokens=False)."""

    def __init__(self, name: str, cache: int = byte_bpe.CACHE):
        self.bpe, self.merger = byte_bpe.load(name), byte_bpe.merger(name)
        self.dtype = np.dtype("<u2" if self.bpe.size <= 1 << 16 else "<u4")
        super().__init__({s: np.array([i], dtype=self.dtype).tobytes() for s, i in self.bpe.special.items()}, cache)

    def split(self, text: str) -> list[str]:
        return self.bpe.split(text)

    def learn(self, fragments: list[str]) -> list[bytes]:
        """Ids of new fragments, as bytes, each piece between cuts by itself."""
        flat, of, fragment_of, _ = self.bpe.ragged(fragments, cuts=True)
        ids, of = self.merger.merge(self.bpe.byte_id[flat], of)
        return runs_of_bytes(ids.astype(self.dtype), fragment_of[of], len(fragments))

    def encode(self, batch: list[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(found), dtype=self.dtype) for found in self.resolve(batch)]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bpe.bytes_of.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


def runs_of_bytes(ids: np.ndarray, of: np.ndarray, n: int) -> list[bytes]:
    """The bytes of each of n runs of ids; of: each id's run, ascending."""
    ends = (np.cumsum(np.bincount(of, minlength=n)) * ids.dtype.itemsize).tolist()
    whole, start, out = ids.tobytes(), 0, []
    for end in ends:
        out.append(whole[start:end])
        start = end
    return out


def codec(name: str) -> Codec:
    """One codec for each vocabulary and worker."""
    return byte_bpe.table_of((Codec, name), lambda: Codec(name))


def in_slices(column: pa.Array, rows: int = TEXTS, chars: int = CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of slices with so many rows, or so many characters
    and one text, at most."""
    slice_, size, first = [], 0, 0
    for i, x in enumerate(column):
        text = x.as_py()
        if slice_ and (len(slice_) >= rows or size + len(text or "") > chars):
            yield first, slice_
            slice_, size, first = [], 0, i
        slice_.append(text)
        size += len(text or "")
    if slice_:
        yield first, slice_


def encode_documents(docs: DataFrame, vocab: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, ids array<int>: every whole text's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab)
        for batch in batches:
            for first, rows in in_slices(batch.column(1)):
                ids = [x.astype(np.int32) for x in c.encode(rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocab: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, text of (doc_id, ids); null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab)
        for batch in batches:
            out = [c.decode(np.array(x.as_py() or [], dtype=np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocab: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and
    decoded from those ids, in one pass; only digests leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab)
        decimal = c.bpe.decimal
        for batch in batches:
            n, a, b = [], [], []
            for _, rows in in_slices(batch.column(1)):
                for ids in c.encode(rows):
                    n.append(len(ids))
                    a.append(hashlib.sha256(b",".join(map(decimal.__getitem__, ids.tolist()))).hexdigest())
                    b.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
