"""What the two vector operators share: valid vectors, rotations, samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    inf = float("inf")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def plain(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of usable vectors that have an id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("v")), F.lit(False)))


def sample(rows: DataFrame, bound: int) -> dict[int, np.ndarray]:
    """By dimension, the vectors of at most bound rows: those with the
    smallest hash of their id."""
    found = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(bound).collect()
    out: dict[int, list] = {}
    for r in found:
        out.setdefault(len(r["v"]), []).append(r["v"])
    return {d: np.array(x, dtype=np.float64) for d, x in out.items()}


def by_dimension(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of a list column, by the lists' length."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    out = {}
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        out[int(d)] = at, flat[start[at][:, None] + np.arange(d)].astype(np.float64)
    return out


def packed(x: np.ndarray) -> list[bytes]:
    """Each row's bytes: as floats where that loses nothing, else as doubles."""
    short = x.astype(np.float32)
    fits = (short == x).all(axis=1)
    return [(s if f else v).tobytes() for s, v, f in zip(short, x, fits.tolist())]


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of packed vectors of d components as a matrix of doubles."""
    rows = column.to_pylist()
    if all(len(r) == 4 * d for r in rows):
        return np.frombuffer(b"".join(rows), dtype=np.float32).reshape(len(rows), d).astype(np.float64)
    return np.stack([np.frombuffer(r, dtype=np.float32 if len(r) == 4 * d else np.float64).astype(np.float64) for r in rows])


def rotation(d: int, seed: int = 11) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def rotated(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x @ q, column by column: a row's result depends on that row alone, to
    the last bit, whatever others are in the batch."""
    out = np.zeros_like(x)
    for k in range(x.shape[1]):
        out += x[:, k, None] * q[k]
    return out
