"""Exact top-k by inner product with multi-resolution segment statistics.

For a segment of m components, with means a, b and deviations s, t of two
vectors, the squared distance is at least m (a - b)^2 + m (s - t)^2, so (as
norms are known) the inner product is at most m a b + m s t. Summed over 1, 2,
4, ... segments this bounds a pair from coarse to fine; pairs whose bound stays
below what the query has already found are dropped, the others get their exact
product.

Vectors are sorted by coarse statistics and held in blocks of bounded size,
each with the range of its statistics. A query's first k come from its own
block; blocks whose range can't reach its kth score are never read for it.
Blocks that can meet the query's tile in tasks of bounded size, and of each
such meeting only k rows a query leave. Work grows with queries times rows
where bounds don't cut: the queries are a stated part of all rows.

Components become floor(scale * x); products are exact integers, those beyond
64 bits are given (and ranked) as the nearest long. Null vectors and those with
null or non-finite components take no part, nor do rows without an id; zero
and empty vectors do. Vectors of different lengths are not compared. Ties go to
the smaller id; rows that repeat an id are rows of their own, each a query if
the id is one. An empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize
from quarry.llm.vectors import by_dimension, matrix, packed, sample

LEVELS = (1, 2, 4, 8, 16)
HEADER = 8  #: segments of a block's header
ROWS, BYTES = 2048, 1 << 20  #: of a block, at most
TILES, HEADERS = 64, 1024  #: query tiles and headers that meet in one task
PIVOTS = 256  #: sampled vectors that only decide the order of rows
LONG = 2**63 - 1


def stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of 2 * segments numbers: means and deviations of each segment, by
    the root of its length. The product of two such rows bounds the vectors'."""
    d = x.shape[1]
    if d == 0:
        return np.zeros((len(x), 2))
    cut = np.unique(np.linspace(0, d, min(segments, d) + 1).astype(np.int64))
    m = np.diff(cut)
    mean = np.add.reduceat(x, cut[:-1], axis=1) / m
    dev = np.sqrt(np.add.reduceat((x - np.repeat(mean, m, axis=1)) ** 2, cut[:-1], axis=1) / m)
    return np.hstack([mean, dev]) * np.sqrt(np.concatenate([m, m]))


def _slack(q: np.ndarray, most: float) -> np.ndarray:
    """More than rounding can take from a bound, for each query."""
    return 1e-9 * np.sqrt((q**2).sum(1)) * most + 1e-6


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products of rows of integers, exact up to 64 bits."""
    if q.size == 0 or x.size == 0:
        return np.zeros((len(q), len(x)), dtype=np.int64)
    most = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = lambda a: np.array([[int(v) for v in r] for r in a.tolist()], dtype=object)
    return np.clip(whole(q) @ whole(x).T, -LONG - 1, LONG).astype(np.int64)


def _survivors(q: np.ndarray, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, rows, mask over them): pairs whose bounds reach the least score."""
    own, other = np.arange(len(q)), np.arange(len(x))
    mask = np.ones((len(q), len(x)), dtype=bool)
    least = least - _slack(q, float(np.sqrt((x**2).sum(1)).max(initial=0)))
    for level in LEVELS:
        if level > LEVELS[0] and level >= x.shape[1] or not mask.any():
            break
        mask &= stats(q[own], level) @ stats(x[other], level).T >= least[own, None]
        keep, cols = mask.any(1), mask.any(0)
        own, other, mask = own[keep], other[cols], mask[keep][:, cols]
    return own, other, mask


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, least: np.ndarray, own_row: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows that reach its least
    score, ties to smaller ids. own_row: the row that is the query itself."""
    own, other, mask = _survivors(q, x, least)
    if own_row is not None:
        mask &= other[None, :] != own_row[own, None]
    if not mask.any():
        return (np.zeros(0, dtype=np.int64),) * 3
    score = products(q[own], x[other])
    if mask.shape[1] > k:  # the kth of all survivors: fewer pairs to sort
        held = np.where(mask, score, -LONG - 1)
        mask &= score >= np.partition(held, -k, axis=1)[:, -k, None]
    i, j = np.nonzero(mask)
    value = score[i, j]
    order = np.lexsort((ids[other[j]], -value.astype(np.float64) if abs(value).max() < 2**53 else -value.astype(object), i))
    i, j, value = i[order], j[order], value[order]
    first = np.searchsorted(i, np.arange(len(own)))
    top = np.arange(len(i)) - first[i] < k
    return own[i[top]], other[j[top]], value[top]


def _pack(x: np.ndarray) -> bytes:
    short = x.astype(np.float32)
    return short.tobytes() if (short == x).all() else x.tobytes()


def _unpack(b: bytes, n: int, d: int) -> np.ndarray:
    return np.frombuffer(b, dtype=np.float64 if n * d and len(b) == 8 * n * d else np.float32).reshape(n, d).astype(np.float64)


BLOCK = "b long, d int, n int, ids array<long>, x binary, lo array<double>, hi array<double>, norm double, at array<int>, q_ids array<long>, q binary, least array<long>"


def _block(name: int, ids: np.ndarray, x: np.ndarray, every: int, k: int) -> dict:
    at = np.flatnonzero(ids % every == 0)
    q, least = x[at], np.full(len(at), -LONG - 1)
    who, _, score = best(q, x, ids, least.astype(np.float64), at, k)
    last = np.flatnonzero(np.bincount(who, minlength=len(at)) >= k)
    least[last] = score[np.searchsorted(who, last, side="right") - 1]
    s = stats(x, HEADER)
    return {
        "b": name, "d": x.shape[1], "n": len(x), "ids": ids, "x": _pack(x), "lo": s.min(0), "hi": s.max(0), "norm": float(np.sqrt((x**2).sum(1)).max(initial=0)),
        "at": at, "q_ids": ids[at], "q": _pack(q), "least": least,
    }


def blocks(vectors: DataFrame, every: int, k: int, scale: float) -> DataFrame:
    """The table of blocks, with their headers and their queries, written."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    spark = vectors.sparkSession
    pivots = spark.sparkContext.broadcast({d: stats(np.floor(scale * x), HEADER) for d, x in sample(rows, PIVOTS).items()})  # a bounded sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, (at, x) in by_dimension(b.column(1)).items():
                x = np.floor(scale * x)
                s, cell, far = stats(x, HEADER), np.zeros(len(x), dtype=np.int32), np.zeros(len(x))
                if d in pivots.value:
                    p = pivots.value[d]
                    gap = (s**2).sum(1)[:, None] - 2 * s @ p.T + (p**2).sum(1)
                    cell = gap.argmin(1).astype(np.int32)
                    far = np.maximum(gap[np.arange(len(x)), cell], 0)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.full(len(x), d, dtype=np.int32)), pa.array(cell), pa.array(far), pa.array(packed(x), pa.binary())], names=["vec_id", "d", "cell", "far", "v"])

    placed = rows.mapInArrow(place, "vec_id long, d int, cell int, far double, v binary")
    ranged = placed.repartitionByRange("d", "cell", "far", "vec_id").sortWithinPartitions("d", "cell", "far", "vec_id")
    names = [x.split()[0] for x in BLOCK.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of rows of one length, in blocks; named by partition and number."""
        from pyspark import TaskContext

        schema = pa.schema(list(zip(names, [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())])))
        name, held, held_d = TaskContext.get().partitionId() << 32, [], -1

        def out(rows: list) -> pa.RecordBatch:
            nonlocal name
            ids, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            name += 1
            return pa.RecordBatch.from_pylist([_block(name, ids, x, every, k)], schema=schema)

        for b in batches:
            ids, ds, v = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(4)
            edges = [0, *(np.flatnonzero(np.diff(ds)) + 1).tolist(), len(ds)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                d = int(ds[lo])
                if d != held_d and held:
                    yield out(held)
                    held = []
                held_d = d
                most = max(1, min(ROWS, BYTES // (4 * max(d, 1))))
                while lo < hi:
                    take = min(hi - lo, most - sum(len(r[0]) for r in held))
                    held.append((ids[lo : lo + take], matrix(v.slice(lo, take), d) if d else np.zeros((take, 0))))
                    lo += take
                    if sum(len(r[0]) for r in held) >= most:
                        yield out(held)
                        held = []
        if held:
            yield out(held)

    return materialize(ranged.select("vec_id", "d", "cell", "far", "v").mapInArrow(cut, BLOCK), "blocks")


def _part(c: str, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def _reachable(tiles: pa.Table, headers: pa.Table) -> pa.Table:
    """tile, b: blocks whose range of statistics can reach a query of the tile."""
    found = []
    by_d: dict[int, list] = {}
    for h in headers.to_pylist():
        by_d.setdefault(h["d"], []).append(h)
    boxes = {d: (np.array([h["b"] for h in hs]), np.array([h["lo"] for h in hs]), np.array([h["hi"] for h in hs]), max(h["norm"] for h in hs)) for d, hs in by_d.items()}
    for t in tiles.to_pylist():
        if t["d"] in boxes:
            b, lo, hi, norm = boxes[t["d"]]
            q = _unpack(t["q"], len(t["least"]), t["d"])
            s = stats(q, HEADER)
            up, down = np.maximum(s, 0), np.minimum(s, 0)
            bound = up @ hi.T + down @ lo.T
            reach = (bound >= (np.array(t["least"], dtype=np.float64) - _slack(q, norm))[:, None]).any(0)
            found += [(t["tile"], x) for x in b[reach].tolist()]
    return pa.table({"tile": pa.array([t for t, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _meet(k: int):
    names = ("tile", "at", "query_id", "vec_id", "score")

    def run(tiles: pa.Table, block: pa.Table) -> pa.Table:
        out = []
        for held in block.to_pylist():  # one row
            x, ids = _unpack(held["x"], held["n"], held["d"]), np.array(held["ids"])
            for t in tiles.to_pylist():
                q, at = _unpack(t["q"], len(t["at"]), t["d"]), np.array(t["at"])
                i, j, score = best(q, x, ids, np.array(t["least"], dtype=np.float64), at if t["tile"] == held["b"] else None, k)
                out.append((np.full(len(i), t["tile"]), at[i], np.array(t["q_ids"])[i], ids[j], score))
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 5
        return pa.table(dict(zip(names, columns)))

    return run


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by
    every, its k largest integer inner products with all other rows."""
    table = blocks(vectors, every, k, scale)
    asked = table.where(F.size("at") > 0).withColumnRenamed("b", "tile")
    n_blocks, n_tiles = table.count(), asked.count()
    groups, chunks = max(1, -(-n_blocks // HEADERS)), max(1, -(-n_tiles // HEADERS))
    heads = table.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c"), _part("b", groups).alias("g"), "b", "d", "lo", "hi", "norm")
    asks = asked.select(_part("tile", chunks).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "tile", "d", "q", "least")
    pairs = materialize(asks.groupBy("c", "g").cogroup(heads.groupBy("c", "g")).applyInArrow(_reachable, "tile long, b long"), "pairs")
    chunks = max(1, -(-n_tiles // TILES))
    sent = pairs.withColumn("c", _part("tile", chunks)).join(asked.select("tile", "d", "at", "q_ids", "q", "least"), "tile")
    wanted = pairs.select("b", _part("tile", chunks).alias("c")).distinct().join(table.select("b", "d", "n", "ids", "x"), "b").toDF("b", "c", "d", "n", "ids", "x")
    found = sent.groupBy("b", "c").cogroup(wanted.groupBy("b", "c")).applyInArrow(_meet(k), "tile long, at long, query_id long, vec_id long, score long")
    order = Window.partitionBy("tile", "at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle(every: int = 50, k: int = 5, scale: int = 256) -> str:
    """The same by comparing all pairs of whole vectors (unique ids)."""
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, len(x) AS d, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, o.vec_id, CAST(sum(q.c * o.c) AS BIGINT) AS score FROM e q JOIN e o ON q.i = o.i AND q.d = o.d AND q.vec_id <> o.vec_id WHERE q.vec_id % {every} = 0 GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""
