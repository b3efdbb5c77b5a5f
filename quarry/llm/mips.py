"""Operator 8, maximum inner product search with anisotropic quantisation.

Each pair of dimensions has a codebook of 16 centres. Codebooks and codes
minimise a score-aware loss: for high inner products the residual's part along
the vector matters more than what is across it, so that part weighs ETA times
as much (Guo et al., Accelerating Large-Scale Inference with Anisotropic
Vector Quantization, 2020). They are fitted on a bounded sample; every vector
is encoded. Two four-bit codes share a byte, and a query's table for such a
byte has 256 sums, so a scan is one gather for each four dimensions.

Candidates and queries are dealt by hash into tiles. A task scans one tile of
codes for one tile of queries, reranks each query's RERANK best by their exact
inner products, and returns the best k; a window over those of all tiles
leaves k a query. Tiles have a bounded size whatever the table.

Vectors that are null, zero, or hold null or non-finite components, and rows
without vec_id, take no part; vectors of another length than the query aren't
its candidates. Rows that repeat a vec_id are one vector, the smallest. Vectors
of a length that the sample doesn't hold are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.vectors import by_dimension, matrix, packed, plain, sample

SAMPLE, ROUNDS, THRESHOLD = 8192, 8, 0.25
CANDIDATES, QUERIES, RERANK, SLAB = 32768, 2048, 640, 64


class Quantiser:
    """Codebooks (pairs of dimensions, 16 centres, 2) of one dimension."""

    def __init__(self, x: np.ndarray, rounds: int = ROUNDS):
        self.d = x.shape[1]
        self.m = -(-self.d // 4) * 2  # an even number of pairs
        y = self._pairs(x)
        rng = np.random.default_rng(5)
        first = rng.integers(0, len(x), (self.m, 16))
        self.books = np.stack([y[first[j], j] for j in range(self.m)])
        self.eta = max(1.0, (self.d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        codes = np.stack([self._nearest(y[:, j], j) for j in range(self.m)], axis=1)
        for _ in range(rounds):
            codes = self._fit(y, codes)

    def _pairs(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 2 * self.m))
        out[:, : self.d] = x
        return out.reshape(len(x), self.m, 2)

    def _nearest(self, part: np.ndarray, j: int) -> np.ndarray:
        return ((part[:, None] - self.books[j]) ** 2).sum(2).argmin(1)

    def _state(self, y: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit directions, each pair's residual along them, their sums)."""
        unit = y / np.maximum(np.sqrt((y**2).sum((1, 2))), 1e-300)[:, None, None]
        along = np.stack([((y[:, j] - self.books[j][codes[:, j]]) * unit[:, j]).sum(1) for j in range(self.m)], axis=1)
        return unit, along, along.sum(1)

    def _choose(self, y: np.ndarray, codes: np.ndarray, update: bool) -> np.ndarray:
        """One pass of coordinate descent over codes, and with update over centres."""
        codes = codes.copy()
        unit, along, total = self._state(y, codes)
        for j in range(self.m):
            rest = total - along[:, j]
            if update:
                u = unit[:, j]
                outer = np.eye(2) + (self.eta - 1) * u[:, :, None] * u[:, None, :]
                target = y[:, j] + (self.eta - 1) * (rest + (y[:, j] * u).sum(1))[:, None] * u
                for c in range(16):
                    if (mine := codes[:, j] == c).any():
                        self.books[j, c] = np.linalg.solve(outer[mine].sum(0), target[mine].sum(0))
            diff = y[:, j, None] - self.books[j]
            p = (diff * unit[:, j, None]).sum(2)
            codes[:, j] = ((diff**2).sum(2) + (self.eta - 1) * (rest[:, None] + p) ** 2).argmin(1)
            along[:, j] = np.take_along_axis(p, codes[:, j, None], 1)[:, 0]
            total = rest + along[:, j]
        return codes

    def _fit(self, y: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self._choose(y, codes, True)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Packed codes, m / 2 bytes a row."""
        y = self._pairs(x)
        codes = np.stack([self._nearest(y[:, j], j) for j in range(self.m)], axis=1)
        for _ in range(2):
            codes = self._choose(y, codes, False)
        return (codes[:, 0::2] * 16 + codes[:, 1::2]).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, m / 2, 256) sums for each byte's two codes."""
        t = np.einsum("qmd,mcd->qmc", self._pairs(q), self.books)
        return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), self.m // 2, 256).astype(np.float32)

    def scan(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products, (queries, rows)."""
        t = self.tables(q)
        out = np.zeros((len(q), len(codes)), dtype=np.float32)
        for j in range(self.m // 2):
            out += t[:, j][:, codes[:, j]]
        return out


def best_of(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, codes: np.ndarray | None, quantiser: Quantiser | None, k: int, rerank: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query id, vec_id, score) of each query's best k among rows x."""
    for i in range(0, len(q), SLAB):
        part, names = q[i : i + SLAB], q_ids[i : i + SLAB]
        if quantiser is None or len(x) <= rerank:
            at = np.broadcast_to(np.arange(len(x)), (len(part), len(x)))
        else:
            at = np.argpartition(-quantiser.scan(part, codes), rerank - 1, axis=1)[:, :rerank]
        for row, name, cand in zip(part, names, at):
            cand = cand[ids[cand] != name]
            score = (x[cand] * row).sum(1)
            order = np.lexsort((ids[cand], -score))[:k]
            yield np.full(len(order), name), ids[cand][order], score[order]


def search(vectors: DataFrame, every: int = 20, k: int = 20, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible
    by every, its k largest inner products with other rows."""
    rows = plain(vectors)
    n = rows.count()
    books = {d: Quantiser(x) for d, x in sample(rows, SAMPLE).items()}
    tiles = max(1, -(-n // CANDIDATES))
    query_tiles = max(1, -(-n // every // QUERIES))
    shared = vectors.sparkSession.sparkContext.broadcast(books)  # 16 centres for each pair of dimensions

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for d, (at, x) in by_dimension(batch.column(1)).items():
                codes = [c.tobytes() for c in shared.value[d].encode(x)] if d in shared.value else [b""] * len(x)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(np.full(len(at), d, dtype=np.int32)), pa.array(codes, pa.binary()), pa.array(packed(x), pa.binary())], names=["vec_id", "d", "code", "v"])

    coded = rows.mapInArrow(pack, "vec_id long, d int, code binary, v binary")
    tile = F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int")
    candidates = coded.select("d", tile.alias("c"), F.explode(F.sequence(F.lit(0), F.lit(query_tiles - 1))).alias("q"), F.lit(0).alias("side"), "vec_id", "code", "v")
    asked = coded.where(F.col("vec_id") % every == 0)
    query_tile = F.pmod(F.xxhash64("vec_id"), F.lit(query_tiles)).cast("int")
    asked = asked.select("d", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("c"), query_tile.alias("q"), F.lit(1).alias("side"), "vec_id", F.lit(b"").alias("code"), "v")

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending"), ("v", "ascending")]).combine_chunks()
        side, ids = table["side"].to_numpy(), table["vec_id"].to_numpy()
        found = []
        own, other = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        if len(own) and len(other):
            own, other = own[np.unique(ids[own], return_index=True)[1]], other[np.unique(ids[other], return_index=True)[1]]
            v = table["v"].combine_chunks()
            d = table["d"][0].as_py()
            q, x = matrix(v.take(pa.array(own)), d), matrix(v.take(pa.array(other)), d)
            quantiser = shared.value.get(d)
            codes = np.frombuffer(b"".join(table["code"].combine_chunks().take(pa.array(other)).to_pylist()), dtype=np.uint8).reshape(len(other), -1) if quantiser else None
            found = list(best_of(q, ids[own], x, ids[other], codes, quantiser, k, rerank))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 2 + [np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    best = candidates.union(asked).groupBy("d", "c", "q").applyInArrow(scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
