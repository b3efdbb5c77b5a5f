"""Keyed upsert into sorted Parquet files by copy-on-write.

A table is a folder of Parquet files, each a range of keys, sorted; no two
files overlap. A change goes to the file whose first key is the last at or
below its key (the first file for keys below all). Files in which no row
differs after the changes stay as they are, byte for byte; the others are
written anew in files of bounded rows and then removed.

Routing is an as-of join without a search: first keys (fences) and changes are
sorted by range together and the last fence is carried forward, from one
partition to the next as one number. Changes meet rows by an equi-join on (file,
key). Rows of rewritten files are numbered by range sort and offsets, so no
file, however many inserts it draws, is one task before it is split; then they
are shuffled by the ordinal of the file to write, one file a task.

Neither rows nor files go to the driver as a whole: it sees counts and, one at
a time, paths to remove. New files are committed before old ones go; a job that
dies between the two leaves both, and the folder is to be discarded.

Empty tables have no files and take no changes (no fence to route by). Rows
with null keys aren't stored. Repeated changes of one key have to be settled
before (`latest`). A key that several rows of a file hold is changed in all of
them. Extra columns, whatever their names, are kept in their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import discard, fresh_dir, materialize
from quarry.llm.ranged import carried, numbered


def store(rows: DataFrame, key: str, path: str, per_file: int) -> None:
    """Writes rows with a key as sorted files of per_file rows, the last of the
    rest, one task a file."""
    packed = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("r"))
    placed = numbered(packed, "k")
    n = placed.count()
    files = max(1, -(-n // per_file))
    target = F.floor(F.col("pos") / per_file).cast("int")
    placed.repartitionById(files, target).sortWithinPartitions("pos").select("r.*").write.mode("append").parquet(path)
    discard(placed)


def latest(changes: DataFrame, key: str, *by: str) -> DataFrame:
    """Of each key's changes the one that is highest by `by`; equal ones are
    settled by the other columns. Null keys go. Combines before it shuffles, so
    a key with very many changes is no hot key."""
    rest = [c for c in changes.columns if c not in (key, *by)]
    top = F.max(F.struct(*[F.col(f"`{c}`") for c in (*by, *rest)])).alias("w")
    return changes.where(F.col(key).isNotNull()).groupBy(key).agg(top).select(key, "w.*")


def fences(spark: SparkSession, path: str, key: str, schema) -> DataFrame:
    """file (ordinal from 0), first (its first key), path: one row a file."""
    rows = spark.read.schema(schema).parquet(path).select(F.col(key).alias("first"), F.col("_metadata.file_path").alias("path"))
    return numbered(rows.groupBy("path").agg(F.min("first").alias("first")), "first", name="file")


def route(changes: DataFrame, key: str, marks: DataFrame) -> DataFrame:
    """changes with the ordinal (file) and first key (first) of their home."""
    shape = changes.schema.simpleString()
    known = marks.select(F.col("first").alias("k"), F.lit(0).alias("kind"), F.col("file"), F.lit(None).cast(shape).alias("c"))
    asked = changes.select(F.col(key).alias("k"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("file"), F.struct(*[F.col(f"`{c}`") for c in changes.columns]).alias("c"))
    placed = carried(known.union(asked), "file", "k", "kind")
    homes = placed.where("kind = 1").select("c", F.coalesce("file", F.lit(0)).alias("file"))
    out = homes.join(marks.select("file", "first"), "file").select("file", "first", "c.*")
    out.stored_at = placed.stored_at
    return out


def _pieces(c: Column, most: int) -> tuple[Column, Column, Column]:
    """(pieces, rows of the smaller, how many have one more) for c rows."""
    n = F.ceil(c / most).cast("long")
    small = F.floor(c / n).cast("long")
    return n, small, c - small * n


def _joined_runs(group: pd.DataFrame) -> pd.DataFrame:
    """head: the first piece of the file that each piece of a run goes to."""
    group = group.sort_values("p")
    heads, size, head = [], 0, -1
    for p, n, most in zip(group["p"].tolist(), group["size"].tolist(), group["most"].tolist()):
        if head >= 0 and size + n <= most:
            size += n
        else:
            size, head = n, p
        heads.append(head)
    return pd.DataFrame({"p": group["p"].to_numpy(), "head": heads})


def plan_files(counts: DataFrame, most: int) -> DataFrame:
    """file, i, target: the ordinal of the file to write for each piece of each
    rewritten file.

    counts: file, c (rows left) of every rewritten file, emptied ones included.
    A file becomes its fewest pieces of at most `most` rows, larger first; then,
    ascending, a piece joins its left neighbour, as grown, if that's rewritten
    too and both fit. Two neighbours that alone don't fit never join, nor do
    files with an untouched one between, so the list falls into short runs and
    only the sizes of a run meet in one task.
    """
    ranked = numbered(counts, "file", name="rank")  # untouched files before a file: its ordinal less its rank
    n, small, more = _pieces(F.col("c"), most)
    rows = ranked.where("c > 0").select("file", (F.col("file") - F.col("rank")).alias("gap"), small.alias("small"), more.alias("more"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    listed = numbered(rows.select("file", "i", "gap", (F.col("small") + (F.col("i") < F.col("more")).cast("long")).alias("size")), "file", "i", name="p")
    left = listed.select((F.col("p") + 1).alias("p"), F.col("gap").alias("gap0"), F.col("size").alias("size0"))
    begins = F.col("gap0").isNull() | (F.col("gap") != F.col("gap0")) | (F.col("size") + F.col("size0") > most)
    marked = listed.join(left, "p", "left").select("file", "i", "size", F.lit(most).alias("most"), "p", F.when(begins, F.col("p")).alias("run"))
    runs = carried(marked, "run", "p")
    heads = runs.select("run", "p", "size", "most").groupBy("run").applyInPandas(_joined_runs, "p long, head long")
    heads = materialize(heads, "heads")
    targets = numbered(heads.select("head").distinct(), "head", name="target")
    placed = runs.select("file", "i", "p").join(heads, "p").join(targets, "head").select("file", "i", F.col("target"))
    out = materialize(placed, "targets")
    discard(ranked, listed, runs, heads, targets)
    return out


def upsert(spark: SparkSession, path: str, key: str, changes: DataFrame, per_file: int, schema, marks: DataFrame) -> None:
    """Applies routed changes (file, key, gone boolean, new: struct of the
    columns to set) to the files in path. marks: its fences. One change a key."""
    columns = [f.name for f in schema]
    sets = [f.name for f in changes.schema["new"].dataType]
    touched = changes.select("file").distinct()
    base = spark.read.schema(schema).parquet(path).select(F.col("_metadata.file_path").alias("path"), F.col(f"`{key}`").alias("k"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("r"))
    base = base.join(marks.select("path", "file"), "path").join(touched, "file", "left_semi").select("file", "k", "r", F.lit(True).alias("here"))
    asked = changes.select("file", F.col(f"`{key}`").alias("k"), "gone", "new", F.lit(True).alias("asked"))
    both = base.join(asked, ["file", "k"], "full_outer")
    asked_, here, gone = (F.coalesce(c, F.lit(False)) for c in ("asked", "here", "gone"))
    sought = lambda c: F.col("k") if c == key else F.when(asked_, F.col(f"new.`{c}`")).otherwise(F.col(f"r.`{c}`")) if c in sets else F.col(f"r.`{c}`")
    after = F.struct(*[sought(c).alias(c) for c in columns])
    both = both.select("file", "k", after.alias("a"), (~gone).alias("stays"), F.when(here, gone | ~after.eqNullSafe(F.col("r"))).otherwise(~gone).alias("differs"))
    both = materialize(both, "merged")
    counts = materialize(both.groupBy("file").agg(F.bool_or("differs").alias("d"), F.count_if("stays").alias("c")).where("d").select("file", "c"), "dirty")
    rows = numbered(both.where("stays").join(counts.select("file"), "file", "left_semi").select("file", "k", "a"), "file", "k")
    targets = plan_files(counts, per_file)
    n = targets.agg(F.max("target")).first()[0]
    if n is not None:
        starts = rows.groupBy("file").agg(F.min("pos").alias("start"), F.count("*").alias("c"))
        _, small, more = _pieces(F.col("c"), per_file)
        rank, large = F.col("pos") - F.col("start"), more * (small + 1)
        piece = F.floor(F.when(rank < large, rank / (small + 1)).otherwise(more + (rank - large) / small)).cast("long")
        placed = rows.join(starts, "file").withColumn("i", piece).join(targets, ["file", "i"])
        placed.repartitionById(n + 1, F.col("target").cast("int")).sortWithinPartitions("pos").select("a.*").write.mode("append").parquet(path)
    _remove(spark, marks.join(counts, "file").select("path"))
    discard(both, counts, rows, targets)


def _remove(spark: SparkSession, paths: DataFrame) -> None:
    """Deletes files, one path at a time on the driver."""
    for r in paths.toLocalIterator():
        p = spark._jvm.org.apache.hadoop.fs.Path(r["path"])
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False)


DIGEST = "path string, first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a path from rows (path, id, cents, crc) sorted by path, holding
    a running hash only."""
    now, state = None, None
    names = pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("n_rows", pa.int64()), ("cents", pa.int64()), ("rows_crc", pa.int64()), ("ids_sha256", pa.string())])
    row = lambda: pa.RecordBatch.from_pylist([{"path": now, **state, "ids_sha256": state["ids_sha256"].hexdigest()}], schema=names)
    for b in batches:
        for path, i, cents, crc in zip(*(c.to_pylist() for c in b.columns)):
            if path != now:
                if now is not None:
                    yield row()
                now, state = path, {"first_id": i, "n_rows": 0, "cents": 0, "rows_crc": 0, "ids_sha256": hashlib.sha256()}
            state["ids_sha256"].update(f"{',' if state['n_rows'] else ''}{i}".encode())
            for k, v in (("n_rows", 1), ("cents", cents), ("rows_crc", crc)):
                state[k] += v
    if now is not None:
        yield row()


def digests(spark: SparkSession, path: str, key: str, schema, cents: Column, crc: Column) -> DataFrame:
    """One row a file, read back: path, first_id, n_rows, sums of cents and
    crc, hash of its keys in file order. A file's rows stream through one task."""
    rows = spark.read.schema(schema).parquet(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"), F.col(f"`{key}`").alias("id"), cents.alias("cents"), crc.alias("crc"))
    rows = rows.repartition("path").sortWithinPartitions("path", "row")
    return rows.select("path", "id", "cents", "crc").mapInArrow(_digest, DIGEST)


def upsert_clients(spark: SparkSession, clients: DataFrame, changes: DataFrame) -> DataFrame:
    """The shop's clients (crc32(client_id) % 7 > 3) as files of 1 + n / 1000
    rows, then client_changes applied by rules that depend on the home's first
    id. One row for each file that is there afterwards."""
    key, sets = "client_id", ["source", "segment", "city", "balance"]
    crc = lambda c: F.crc32(c.cast("string").cast("binary"))
    per_file, path = 1 + clients.count() // 1000, fresh_dir(spark, "upsert")
    store(clients.where(crc(F.col(key)) % 7 > 3), key, path, per_file)
    marks = fences(spark, path, key, clients.schema)
    old = materialize(marks.select("path"), "old")
    won = latest(changes.select(key, "seq", "change_id", "op", *sets), key, "seq", "change_id")
    routed = route(won, key, marks)
    h = crc(F.col("first")) % 16
    gone = F.coalesce((F.col("op") == "D") | (crc(F.col("change_id")) % 8 < h), F.lit(False))
    asked = routed.where(h <= 7).select("file", key, gone.alias("gone"), F.struct(*sets).alias("new"))
    upsert(spark, path, key, asked, per_file, clients.schema, marks)
    cents = F.coalesce(F.floor(100 * F.col("balance") + 0.5), F.lit(0))
    text = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("source", "segment", "city")])
    found = digests(spark, path, key, clients.schema, cents, F.crc32(text.cast("binary")))
    discard(marks, routed)
    same = old.withColumn("rewritten", F.lit(False))
    empty = spark.read.schema(clients.schema).parquet(path).isEmpty()
    columns = ",".join(clients.columns if empty else spark.read.parquet(path).columns)
    return found.join(same, "path", "left").select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", F.lit(columns).alias("columns"), "path", F.coalesce("rewritten", F.lit(True)).alias("rewritten"))
