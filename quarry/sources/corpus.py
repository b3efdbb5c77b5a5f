"""Readers and writers: corpora, query files, thesaurus text, result lines."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.ranges import numbered
from quarry.sources.quoted import numbered_lines, records

CORPUS = "document_id BIGINT, title STRING, content STRING, date_posted TIMESTAMP, court STRING"


def read_csv(spark: SparkSession, path: str, limit: int | None = None, header: bool = True, first: int | None = None, empty: bool = False) -> DataFrame:
    """A quoted CSV corpus; fields may hold line ends and doubled quotes, and
    one file is read by many tasks. The first record of each file names the
    columns; header=False: it counts as a row, and columns go by position (the
    names of CORPUS). limit: the rows with the smallest ids; first: the first
    rows in file order. Fields that don't fit their column's type are null;
    missing and empty ones too (empty: quoted empty ones are empty strings)."""
    rows = records(spark, path, empty)
    kinds = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], CORPUS).schema}
    names = list(kinds)
    if header:
        head = rows.where("own = 0").orderBy("no").limit(1).select("f").first()
        names = [c or f"_c{i}" for i, c in enumerate(head["f"])] if head else names
        rows = rows.where("own > 0")
    if first is not None:
        rows = rows.orderBy("no").limit(first)
    field = lambda i: F.get("f", F.lit(i))
    rows = rows.select([F.try_to_timestamp(field(i)).alias(c) if kinds.get(c) == "timestamp" else field(i).try_cast(kinds.get(c, "string")).alias(c) for i, c in enumerate(names)])
    return rows.orderBy("document_id").limit(limit) if limit is not None else rows


def slice_lines(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """line, value: raw lines first to last of a file, counted from 0."""
    return numbered_lines(spark, path).where(F.col("line").between(first, last))


def sample_rows(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The first n rows by key."""
    return rows.orderBy(key).limit(n)


def write_csv(rows: DataFrame, path: str) -> None:
    """rows as CSV: whatever needs quotes has them, empty strings too; nulls are
    fields with nothing at all."""
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_sample_csv(rows: DataFrame, key: str, path: str, n: int = 10) -> None:
    write_csv(sample_rows(rows, key, n), path)


def slice_rows(rows: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Rows first to last by key, counted from 0; sorted by range, so that no
    task holds more than its share wherever the slice lies."""
    return numbered(rows, key, name="line").where(F.col("line").between(first, last))


def count_rows(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"))


@dataclass(frozen=True)
class QuerySpec:
    """A query's text and the documents known to be relevant to it."""

    text: str
    relevant: tuple[int, ...] = field(default=())


def read_query(spark: SparkSession, path: str) -> QuerySpec:
    """A query file: its text, then one relevant document id a line."""
    lines = [r["value"] for r in spark.read.text(path, wholetext=True).collect()]
    lines = [x for x in "\n".join(lines).splitlines()]
    if not lines:
        raise ValueError(f"{path}: no query")
    return QuerySpec(lines[0].strip(), tuple(int(x) for x in lines[1:] if x.strip()))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text, relevant: a table of queries from a folder of query
    files, numbered from 0 by file name. A first line without text is a query
    without text; Spark skips files of no bytes, so they are no query."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\r?\n").alias("f"))
    relevant = F.filter(F.transform(F.slice("f", 2, F.size("f")), lambda x: F.trim(x).try_cast("long")), lambda x: x.isNotNull())
    rows = numbered(files.select("path", F.trim(F.col("f")[0]).alias("text"), relevant.alias("relevant")), "path", name="query_id")
    return rows.select("query_id", "text", "relevant")


def read_thesaurus_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line of a thesaurus text, read in parts and numbered in file
    order; what ends it is for the builder to find."""
    return numbered_lines(spark, path).select(F.col("line").alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line"))


def write_result(result: DataFrame, path: str) -> None:
    """A line for each query: its ranked ids joined by blanks; an empty line
    for no result at all. result: query_id, rank, doc_id.

    Rows are sorted by range over all tasks and then stream through one, which
    writes them as they come: its memory doesn't grow with the number of hits.
    The file gets its name when it is complete. The folder has to be one that
    pyarrow reaches (file, hdfs, s3, gs)."""
    spark = result.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(folder, True)
    store.mkdirs(folder)
    to = re.sub("^file:/+", "file:///", store.makeQualified(folder).toString())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pa.fs.FileSystem.from_uri(to)
        part, now, n = f"{at}/_part-{uuid.uuid4().hex}", None, 0
        with fs.open_output_stream(part) as out:
            for b in batches:
                chunk = []
                for query, doc in zip(*(c.to_pylist() for c in b.columns)):
                    chunk.append(f"{'' if not n else ' ' if query == now else chr(10)}{doc}")
                    now, n = query, n + 1
                out.write("".join(chunk).encode())
            out.write(b"\n")
        fs.move(part, f"{at}/part-00000.txt")
        yield pa.RecordBatch.from_pydict({"n": [n]})

    rows = result.select("query_id", "rank", "doc_id").orderBy("query_id", "rank").select("query_id", "doc_id")
    if not rows.coalesce(1).mapInArrow(write, "n long").collect():  # one row, but none where the plan is known to be empty
        out = store.create(spark._jvm.org.apache.hadoop.fs.Path(folder, "part-00000.txt"))
        out.write(10)
        out.close()


def result_line(result: DataFrame) -> DataFrame:
    """query_id, line; result: query_id, rank, doc_id."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "doc_id")))
    return result.groupBy("query_id").agg(pairs.alias("p")).select("query_id", F.array_join(F.transform("p", lambda x: x["doc_id"].cast("string")), " ").alias("line"))
