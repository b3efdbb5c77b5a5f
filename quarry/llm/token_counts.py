"""Operator 9, token counts by rank-synchronous array merging.

New pre-tokens of many texts lie in one ragged numpy array of symbols. In each
round every sequence finds its lowest-rank pair, and all sequences merge
theirs at once (byte_bpe.RankMerger); the symbols that survive are the count.
Counts of fragments are kept in a table of bounded size in each worker. A
single sequence of more than byte_bpe.LONG symbols, which would need a round
for nearly each of its merges, is merged by a heap instead; the ids are the same.

Null texts count as empty (0 bytes, 0 tokens); repeated rows give repeated
rows; other columns, whatever their names, are not read. Very long texts are
counted whole, in slices of rows of bounded size; an empty table gives an empty
result. No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import byte_bpe
from quarry.llm.bpe_codec import in_slices
from quarry.llm.common import texts


class Counter(byte_bpe.FragmentTable):
    def __init__(self, name: str, cache: int = byte_bpe.CACHE):
        self.bpe, self.merger = byte_bpe.load(name), byte_bpe.merger(name)
        super().__init__(dict.fromkeys(self.bpe.special, 1), cache)

    def split(self, text: str) -> list[str]:
        return self.bpe.split(text)

    def learn(self, fragments: list[str]) -> list[int]:
        flat, of, fragment_of, _ = self.bpe.ragged(fragments, cuts=False)
        _, of = self.merger.merge(self.bpe.byte_id[flat], of)
        return np.bincount(fragment_of[of], minlength=len(fragments)).tolist()

    def counts(self, batch: list[str | None]) -> list[int]:
        return list(map(sum, self.resolve(batch)))


def count_tokens(docs: DataFrame, vocab: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = byte_bpe.table_of((Counter, vocab), lambda: Counter(vocab))
        for batch in batches:
            for first, rows in in_slices(batch.column(1)):
                n = counter.counts(rows)
                size = [len(t.encode()) if t else 0 for t in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
