"""Operator 5, embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 - 2c. They are
rotated at random and split into blocks of about BLOCK dimensions; the squared
distance is the sum of the blocks', so in some block it is at most that
block's share, proportional to its dimensions. Each block is range-joined
under its share: vectors go to the cell of their nearest centre, and copies of
them to the cells of smaller number in which a partner could live (those whose
bisecting plane is near enough; exact by the triangle inequality). The union
over the blocks is verified by the exact cosine, and a pair counts in the
first block that finds it, so none counts twice.

Equal vectors are joined once, with their number. Cells larger than CHUNK are
split into pairs of chunks, which other tasks can take; a task returns for
each vector how many it links with and one link that leads to the smallest of
its group, never the pairs themselves. What is collected: a bounded sample for
the centres, and the cells' sizes (at most CELLS a block).

Vectors that are null, zero, or hold null or non-finite components, and rows
without vec_id, link with nothing; vectors of different lengths don't either.
Rows that repeat a vec_id are separate vectors with the same name: each has
links and a component of its own. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize
from quarry.llm.components import components, union_counts
from quarry.llm.vectors import by_dimension, matrix, packed, plain, rotated, rotation, sample, usable

BLOCK, CHUNK, CELLS, PER_CELL, SAMPLE, SLAB, PAIRS = 8, 4096, 256, 2048, 4096, 128, 1 << 16


def blocks_of(d: int) -> list[slice]:
    ends = np.linspace(0, d, max(1, d // BLOCK) + 1).round().astype(int)
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]


def shares(d: int, least: float) -> list[float]:
    total = 2 - 2 * least
    return [total * (s.stop - s.start) / d + 1e-12 for s in blocks_of(d)]


class Cells:
    """Centres of every block, for each dimension of the sample."""

    def __init__(self, found: dict[int, np.ndarray], n: int, least: float):
        self.least = least
        k = int(np.clip(n // PER_CELL, 1, CELLS))
        self.centres = {}
        for d, x in found.items():
            y = rotated(x / np.linalg.norm(x, axis=1)[:, None], rotation(d))
            self.centres[d] = [_centres(y[:, s], min(k, len(y))) for s in blocks_of(d)]

    def place(self, d: int, y: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(block, row, cell, whether it is the row's own) of rotated rows."""
        n = len(y)
        for b, s in enumerate(blocks_of(d)):
            if d not in self.centres:
                yield b, np.arange(n), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
                continue
            c = self.centres[d][b]
            part = y[:, s]
            d2 = np.maximum((part**2).sum(1)[:, None] - 2 * part @ c.T + (c**2).sum(1), 0)
            own = d2.argmin(1)
            apart = np.sqrt(np.maximum((c**2).sum(1)[:, None] - 2 * c @ c.T + (c**2).sum(1), 0))
            to_plane = (d2 - d2[np.arange(n), own][:, None]) / np.maximum(2 * apart[own], 1e-300)
            near = (to_plane <= shares(d, self.least)[b] ** 0.5 + 1e-6) & (np.arange(len(c)) < own[:, None])
            row, cell = np.nonzero(near)
            yield b, np.r_[np.arange(n), row], np.r_[own, cell], np.r_[np.ones(n, dtype=bool), np.zeros(len(row), dtype=bool)]


def _centres(x: np.ndarray, k: int) -> np.ndarray:
    """k-means from the first k distinct rows, few rounds; fewer if rows repeat."""
    c = np.unique(x[: 4 * k], axis=0)
    c = c[np.random.default_rng(3).permutation(len(c))[:k]]
    for _ in range(4):
        at = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1)
        n = np.bincount(at, minlength=len(c))
        sums = np.stack([np.bincount(at, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return np.unique(c, axis=0)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances row by row, dimension by dimension: the same bits for
    a pair in every task."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += (a[:, k] - b[:, k]) ** 2
    return out


def links_of(block: int, x: np.ndarray, y: np.ndarray, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked (row of x, row of y) that this block is the first to find. A
    product of floats tells, with some slack, which pairs to look at."""
    d = x.shape[1]
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    q, parts, share = rotation(d), blocks_of(d), shares(d, least)
    rx, ry = rotated(x / nx[:, None], q), rotated(y / ny[:, None], q)
    bx, by = rx[:, parts[block]], ry[:, parts[block]]
    fx, fy = bx.astype(np.float32), by.astype(np.float32).T.copy()
    hx, hy = ((bx**2).sum(1) - share[block]).astype(np.float32) / 2 - np.float32(1e-5), (by**2).sum(1).astype(np.float32) / 2
    for i in range(0, len(x), SLAB):
        a, b = np.nonzero(fx[i : i + SLAB] @ fy - hy >= hx[i : i + SLAB, None])
        a += i
        if same:
            a, b = a[b > a], b[b > a]
        for k in range(0, len(a), PAIRS):
            p, r = a[k : k + PAIRS], b[k : k + PAIRS]
            keep = _apart(bx[p], by[r]) <= share[block]
            p, r = p[keep], r[keep]
            keep = (x[p] * y[r]).sum(1) / (nx[p] * ny[r]) >= least
            p, r = p[keep], r[keep]
            for earlier in range(block):
                keep = _apart(rx[p, parts[earlier]], ry[r, parts[earlier]]) > share[earlier]
                p, r = p[keep], r[keep]
            if len(p):
                yield p, r


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors."""
    rows = plain(vectors)
    # a class has a number of its own: different vectors may share an id
    classes = rows.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("w")).withColumn("class", F.monotonically_increasing_id())
    classes = materialize(classes, "classes")
    cells = Cells(sample(classes, SAMPLE), classes.count(), least)

    def placed(batch: pa.RecordBatch) -> Iterator[tuple]:
        for d, (at, x) in by_dimension(batch.column(2)).items():
            y = rotated(x / np.linalg.norm(x, axis=1)[:, None], rotation(d))
            for b, row, cell, own in cells.place(d, y):
                yield d, at, x, b, row, cell, own

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, _, _, b, _, cell, own in placed(batch):
                for c, o, n in zip(*np.unique(np.stack([cell, own]), axis=1), np.unique(np.stack([cell, own]), axis=1, return_counts=True)[1]):
                    out.append((d, b, int(c), bool(o), int(n)))
            yield pa.RecordBatch.from_pylist([dict(zip(("d", "b", "cell", "own", "n"), r)) for r in out], schema=pa.schema([("d", pa.int32()), ("b", pa.int32()), ("cell", pa.int32()), ("own", pa.bool_()), ("n", pa.int64())]))

    base = classes.select(F.col("class").alias("vec_id"), "w", "v")
    sizes = base.mapInArrow(count, "d int, b int, cell int, own boolean, n long").groupBy("d", "b", "cell", "own").agg(F.sum("n").alias("n")).collect()
    chunks = {(r["d"], r["b"], r["cell"], r["own"]): -(-r["n"] // CHUNK) for r in sizes}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                ids, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                salt = np.array([xxhash.xxh3_64_intdigest(int(i).to_bytes(8, "little", signed=True)) >> 8 for i in ids], dtype=np.int64)
                out: list[tuple] = []
                for d, at, x, b, row, cell, own in placed(batch):
                    rows = packed(x)
                    for r, c, o in zip(row.tolist(), cell.tolist(), own.tolist()):
                        h, n = chunks.get((d, b, c, True), 0), chunks.get((d, b, c, False), 0)
                        me = int(salt[at[r]]) % (h if o else n)
                        if o:
                            tasks = [(min(me, j), max(me, j), int(me > j)) for j in range(h)] + [(me, h + j, 0) for j in range(n)]
                        else:
                            tasks = [(i, h + me, 1) for i in range(h)]
                        out += [(d, b, c, i, j, side, int(ids[at[r]]), int(w[at[r]]), rows[r]) for i, j, side in tasks]
                columns = list(zip(*out)) or [[]] * 9
                kinds = [pa.int32()] * 6 + [pa.int64()] * 2 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["d", "b", "cell", "i", "j", "side", "vec_id", "w", "v"])

    def join(key: tuple, table: pa.Table) -> pa.Table:
        block, i, j = key[1].as_py(), key[3].as_py(), key[4].as_py()
        table = table.sort_by([("vec_id", "ascending")]).combine_chunks()
        side = table["side"].to_numpy()
        ids, w, v = table["vec_id"].to_numpy(), table["w"].to_numpy(), matrix(table["v"].combine_chunks(), key[0].as_py())
        first, second = (np.arange(len(ids)),) * 2 if i == j else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        n = np.zeros(len(ids), dtype=np.int64)
        stars: dict[int, int] = {}
        for a, b in links_of(block, v[first], v[second], i == j, least) if len(first) and len(second) else ():
            a, b = first[a], second[b]
            np.add.at(n, a, w[b])
            np.add.at(n, b, w[a])
            stars = dict(union_counts(np.r_[a, np.array(list(stars), dtype=np.int64)], np.r_[b, np.array(list(stars.values()), dtype=np.int64)]))
        at = np.flatnonzero(n)
        root = np.array([stars.get(k, k) for k in at.tolist()], dtype=np.int64)
        return pa.table({"a": ids[at], "b": ids[root] if len(at) else ids[:0], "n": n[at]})

    dealt = base.mapInArrow(deal, "d int, b int, cell int, i int, j int, side int, vec_id long, w long, v binary")
    found = materialize(dealt.groupBy("d", "b", "cell", "i", "j").applyInArrow(join, "a long, b long, n long"), "found")
    links = found.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    label = components(found.select("a", "b")).select(F.col("id").alias("class"), F.col("component_id").alias("root"))
    known = classes.join(links, "class", "left").join(label, "class", "left").withColumn("root", F.coalesce("root", "class"))
    known = materialize(known.select("root", "vec_id", "v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links")), "known")
    known = known.join(known.groupBy("root").agg(F.min("vec_id").alias("component_id")), "root").select("v", "n_links", "component_id")
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    every = every.withColumn("v", F.when(F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("v")), F.lit(False)), F.col("v")))
    out = every.join(known, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def oracle(least: float = 0.95) -> str:
    """The same in DuckDB's SQL over embeddings, by comparing all pairs."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= {least}),
r AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT l.b, r.r FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(r) AS component_id FROM r GROUP BY vec_id),
d AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN c USING (vec_id) LEFT JOIN d ON d.a = e.vec_id"""
