"""Quoted CSV read in parts: one file, however large, is many tasks' work.

Spark deals a file's lines to tasks by byte ranges. Whether a line begins a
record depends on all quotes before it, and so on the parity of what comes
before. A first pass puts each range's lines into chunks of a megabyte or so,
counts a chunk's lines, quotes and the records that begin in it, for either
parity, and writes them; sums over chunks (one row each) then tell every chunk
its parity and the number of its first record. The second pass reads the chunks,
not the files: where Spark cuts files depends on the cores and settings of the
moment, so that a second reading may have other ranges. It puts records together
where they lie; only those that cross a bound are shuffled, by their number.
Doubled quotes are two quotes and leave the parity as it is.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.plans.checkpoints import checkpointed


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, path, start: lines as they are, ended by line feeds alone, each
    range's in order."""
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


PART = 1 << 20  #: characters of text, about, that a task holds as Python objects


def _parts(values: pa.Array) -> Iterator[tuple[int, int]]:
    """(from, to) of the values in parts of about PART bytes, one value at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(values):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + PART, side="right")))
        yield lo, hi
        lo = hi


def _ranges(b: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """((path, start), from, to) of a batch's rows."""
    path, start = b.column(1).to_pylist(), b.column(2).to_numpy()
    edges = [i for i in range(1, len(path)) if start[i] != start[i - 1] or path[i] != path[i - 1]]
    for lo, hi in zip([0, *edges], [*edges, len(path)]):
        if hi > lo:
            yield (path[lo], int(start[lo])), lo, hi


def _before(values: pa.Array) -> tuple[np.ndarray, int, np.ndarray]:
    """(quotes before each line, quotes, which lines are blank)."""
    quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False)
    blank = pc.match_substring_regex(values, "^\r?$").to_numpy(zero_copy_only=False)
    return np.cumsum(quotes) - quotes, int(quotes.sum()), blank


CHUNK = "path string, start long, seq long, lines long, quotes long, even long, odd long, text string"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CHUNK: lines of a range, in parts, with their number and quotes, and the
    records that begin there if it begins outside (even) or inside (odd) quotes."""
    now, seq = None, 0
    for b in batches:
        for key, lo, hi in _ranges(b):
            now, seq = key, seq if key == now else 0
            values = b.column(0).slice(lo, hi - lo)
            for a, z in _parts(values):
                part = values.slice(a, z - a)
                before, quotes, blank = _before(part)
                inside = before % 2 == 1
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, z - a], pa.int32()), part), "\n")
                row = [key[0], key[1], seq, z - a, quotes, int((~inside & ~blank).sum()), int((inside & ~blank).sum())]
                yield pa.RecordBatch.from_arrays([*[pa.array([v]) for v in row], text], names=[c.split()[0] for c in CHUNK.split(", ")])
                seq += 1


def chunks(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, text of the chunks of lines, written once; id, pos, line0, odd, no0,
    own0: each chunk's place in file order, the lines and records that begin
    before it, whether it begins inside quotes, and the records of its file
    before it. One row a chunk)."""
    made = checkpointed(lines.mapInArrow(_chunks, CHUNK).withColumn("id", F.monotonically_increasing_id()), compression="zstd")
    file = Window.partitionBy("path").orderBy("start", "seq").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    known = made.drop("text").withColumn("q", total("quotes", file) % 2)
    known = known.withColumn("records", F.when(F.col("q") == 0, F.col("even")).otherwise(F.col("odd")))
    every = Window.orderBy("path", "start", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return made.select("id", "text"), known.select("id", total(F.lit(1), every).alias("pos"), total("lines", every).alias("line0"), F.col("q").alias("odd"), total("records", every).alias("no0"), total("records", file).alias("own0"))


def _lines(text: pa.Array) -> pa.Array:
    """The lines of a chunk's text."""
    return pc.split_pattern(text, "\n").flatten()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0, in file order), value: raw lines, records or not."""
    made, known = chunks(text_lines(spark, path))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                values, at = _lines(b.column(0).slice(r, 1)), b.column(1)[r].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(values))), values], names=["line", "value"])

    return made.join(F.broadcast(known), "id").select("text", "line0").mapInArrow(number, "line long, value string")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """no, own, pos, seq, text, whole: records of a chunk, or what it has of
    those that cross its bounds; from text, pos, odd, no0, own0."""
    schema = pa.schema([("no", pa.int64()), ("own", pa.int64()), ("pos", pa.int64()), ("seq", pa.int64()), ("text", pa.string()), ("whole", pa.bool_())])

    def pieces(text: pa.Array, pos: int, odd: int, no: int, own: int) -> Iterator[tuple]:
        values = _lines(text)
        before, quotes, blank = _before(values)
        begins = (before + odd) % 2 == 0
        no, own, seq, held, begun = no - 1, own - 1, 0, [], False  # what comes before the first begin belongs to the record before
        for line, new, empty in zip(values.to_pylist(), begins.tolist(), blank.tolist()):
            if new:
                if held:
                    yield no, own, pos, seq, "\n".join(held), begun
                    held, seq = [], seq + 1
                begun = not empty
                if empty:
                    continue
                no, own = no + 1, own + 1
            held.append(line)
        if held:
            yield no, own, pos, seq, "\n".join(held), begun and (odd + quotes) % 2 == 0

    for b in batches:
        for r in range(b.num_rows):
            rows = list(pieces(b.column(0).slice(r, 1), *(b.column(c)[r].as_py() for c in range(1, 5))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _fields(batches: Iterator[pa.RecordBatch], empty: bool = False) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(sys.maxsize)
    quoting = csv.QUOTE_NOTNULL if empty else csv.QUOTE_MINIMAL
    for b in batches:
        for lo, hi in _parts(b.column(2)):
            part = b.slice(lo, hi - lo)
            parsed = [next(csv.reader(io.StringIO(t.removesuffix("\r"), newline=""), quoting=quoting)) for t in part.column(2).to_pylist()]
            fields = parsed if empty else [[f or None for f in row] for row in parsed]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fields, pa.list_(pa.string()))], names=["no", "own", "f"])


def records(spark: SparkSession, path: str, empty: bool = False) -> DataFrame:
    """no, own, f: the fields of each record (empty ones are null; empty: quoted
    ones aren't), numbered from 0 over all files and in its own file. Blank lines
    between records are none."""
    texts, known = chunks(text_lines(spark, path))
    rows = texts.join(F.broadcast(known), "id").select("text", "pos", "odd", "no0", "own0")
    made = rows.mapInArrow(_pieces, "no long, own long, pos long, seq long, text string, whole boolean")
    parts = made.where(~F.col("whole")).groupBy("no").agg(F.min("own").alias("own"), F.array_sort(F.collect_list(F.struct("pos", "seq", "text"))).alias("p"))
    parts = parts.select("no", "own", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return made.where("whole").select("no", "own", "text").union(parts).mapInArrow(lambda b: _fields(b, empty), "no long, own long, f array<string>")
