"""Probabilistic latent semantic analysis by expectation-maximisation.

The document-term matrix comes as (doc_id, term, x) triples. For fitting, it is
laid out once as rows of whole documents: their non-zero entries as arrays, in
pieces of bounded size, with the row's own list of terms, kept in files. A round
is one pass over the rows. The topic shares of a row's documents (lambda) and of
the terms that it holds (theta), and of no others, are dealt to it as packed
arrays, which the pieces follow: what moves grows with the entries, not with
documents times terms. numpy computes the responsibilities of a slice of entries
at a time and never keeps them. The pass yields sums for lambda, sums for theta
and the likelihood together, as packed arrays too; one shuffle deals them by
range, where they are added up. The driver sees the likelihood and one sum a
topic.

e_step, m_step and log_likelihood are the same step on triples, as a projection
of joins, for looking at single responsibilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.checkpoints import checkpointed, discard, release
from quarry.plans.index import Index

DOCS = 16_384  #: documents of a row, at most
TERMS = 32_768  #: of a range of packed parameters, at most; not to change while a model is fitted
USES = 1 << 20  #: of a range's terms in rows; it ends with the term that reaches them
ENTRIES = 1 << 22  #: of a row, which ends with the document that reaches them
PIECE = 1 << 18  #: entries of a record of a row's
SLICE = 1 << 18  #: entries whose responsibilities are held at once
HELD = 1 << 21  #: numbers a task keeps before it adds them up and gives them out
BROADCAST = 32 << 20  #: bytes of lambda and theta, up to which they are broadcast to the rows
CELLS = "no int, piece long, docs array<long>, terms array<string>, first int, n array<int>, u array<int>, x array<double>"


def doc_term_matrix(index: Index) -> DataFrame:
    """doc_id, term, x: body unigrams' weights."""
    return index.postings.where("zone = 'body' AND kind = 'uni'").select("doc_id", "term", F.col("wtf").cast("double").alias("x"))


def _cols(prefix: str, k: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(k)]


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _code(term: Column) -> Column:
    """A number of 16 bits from a term's md5, the same in any engine."""
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(term.cast("binary")), i, 1)) - 1
    return ((digit(1) * 16 + digit(2)) * 16 + digit(3)) * 16 + digit(4)


def init(x: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(lambda, theta): deterministic starts from ids and terms, normalised."""
    raw = lambda c, i: (((c * 31 + i * 17) % 97) + 1).cast("double")
    docs = x.select("doc_id").distinct().select("doc_id", *[raw(F.col("doc_id"), i).alias(f"r{i}") for i in range(k)])
    lam = docs.select("doc_id", *[(F.col(f"r{i}") / _sum([F.col(c) for c in _cols("r", k)])).alias(f"l{i}") for i in range(k)])
    terms = x.select("term").distinct().select("term", *[raw(_code(F.col("term")), i).alias(f"t{i}") for i in range(k)])
    return lam, _normalised(terms, k)


def _normalised(theta: DataFrame, k: int) -> DataFrame:
    """Columns t0.. divided by their sums; 1 / number of terms if a sum is 0."""
    totals = theta.agg(*[F.sum(f"t{i}").alias(f"s{i}") for i in range(k)], F.count("*").alias("m"))
    share = lambda i: F.when(F.col(f"s{i}") == 0, 1.0 / F.col("m")).otherwise(F.col(f"t{i}") / F.col(f"s{i}"))
    return theta.crossJoin(F.broadcast(totals)).select("term", *[share(i).alias(f"t{i}") for i in range(k)])  # one row of totals


def e_step(x: DataFrame, lam: DataFrame, theta: DataFrame, k: int) -> DataFrame:
    """doc_id, term, x, den, p0..: p(topic | document, term); 0 if den is 0."""
    joined = x.join(lam, "doc_id").join(theta, "term")
    joined = joined.withColumn("den", _sum([F.col(f"l{i}") * F.col(f"t{i}") for i in range(k)]))
    return joined.select("doc_id", "term", "x", "den", *[F.when(F.col("den") == 0, 0.0).otherwise(F.col(f"l{i}") * F.col(f"t{i}") / F.col("den")).alias(f"p{i}") for i in range(k)])


def m_step(p: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(lambda, theta) from responsibilities."""
    theta = _normalised(p.groupBy("term").agg(*[F.sum(F.col("x") * F.col(f"p{i}")).alias(f"t{i}") for i in range(k)]), k)
    sums = p.groupBy("doc_id").agg(F.sum("x").alias("sx"), *[F.sum(F.col("x") * F.col(f"p{i}")).alias(f"s{i}") for i in range(k)])
    lam = sums.select("doc_id", *[F.when(F.col("sx") == 0, 1.0 / k).otherwise(F.col(f"s{i}") / F.col("sx")).alias(f"l{i}") for i in range(k)])
    return lam, theta


def log_likelihood(p: DataFrame) -> DataFrame:
    return p.agg(F.sum(F.when(F.col("den") > 0, F.col("x") * F.log("den"))).alias("loglik"))


def diagnostics(p: DataFrame, k: int) -> DataFrame:
    """How many denominators are 0, and responsibilities not a number."""
    return p.agg(F.count_if(F.col("den") == 0).alias("zero_denominators"), F.sum(_sum([F.isnan(f"p{i}").cast("long") for i in range(k)])).alias("nan_values"))


class _Cut:
    """Where units of whole groups end in a stream: with the group that reaches
    so many entries, or after so many groups."""

    def __init__(self, entries: int, groups: int):
        self.entries, self.groups, self.size, self.count = entries, groups, 0, 0

    def __call__(self, begins: np.ndarray, n: int) -> Iterator[tuple[int, int, bool]]:
        """(from, to, whether a unit begins there) of the next n entries;
        begins: where groups do."""
        at, j, new = 0, 0, False
        while True:
            i = min(max(int(np.searchsorted(begins, at + self.entries - self.size)), j), j + self.groups - self.count)
            stop = int(begins[i]) if i < len(begins) else n
            if stop > at:
                yield at, stop, new
                self.size, self.count = self.size + stop - at, self.count + min(i, len(begins)) - j
            if i >= len(begins):
                return
            at, j, new, self.size, self.count = stop, i, True, 0, 0


def _lists(values: list, sizes: np.ndarray | list[int], kind: pa.DataType) -> pa.ListArray:
    """Arrays of these sizes, from their values one after the other."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values.cast(kind))


def _cutter(entries: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from entries (doc_id, term, x), each document's together, to
    rows of whole documents. A row ends with the document that reaches entries,
    or after most. Its first record has docs, its documents' ids, and terms, its
    distinct terms in ascending order; the others, pieces of it, have first, the
    place in docs of their first document, n, the entries of each, and u and x,
    each entry's place in terms and its weight."""
    schema = pa.schema([(c.split()[0], k) for c, k in zip(CELLS.split(", "), [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64())])])

    def record(**values) -> pa.RecordBatch:
        columns = [values.get(f.name, pa.nulls(1, f.type)) for f in schema]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array([c], f.type) for c, f in zip(columns, schema)], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, no, last = _Cut(entries, most), 0, None
        ids: list[np.ndarray] = []
        docs, size, held, pieces = 0, 0, [], []  # of the row so far; held: (places of documents, terms, weights) not yet coded

        def code() -> None:
            nonlocal size, held
            if held:
                d, x = (np.concatenate([h[c] for h in held]) for c in (0, 2))
                coded = pa.chunked_array([h[1] for h in held]).combine_chunks().dictionary_encode()
                pieces.append((int(d[0]), np.bincount(d - d[0]).astype(np.int32), coded.dictionary, coded.indices.to_numpy(), x))
                size, held = 0, []

        def row() -> Iterator[pa.RecordBatch]:
            nonlocal ids, docs, pieces, no
            code()
            every = pa.chunked_array([p[2] for p in pieces]).unique()
            every = every.take(pc.sort_indices(every))
            yield record(no=no, docs=_lists(np.concatenate(ids), [docs], pa.int64()), terms=_lists(every, [len(every)], pa.string()))
            for k, (first, n, known, u, x) in enumerate(pieces):
                u = pc.index_in(known, value_set=every).to_numpy(zero_copy_only=False)[u]
                yield record(no=no, piece=k, first=first, n=_lists(n, [len(n)], pa.int32()), u=_lists(u, [len(u)], pa.int32()), x=_lists(x, [len(x)], pa.float64()))
            ids, docs, pieces, no = [], 0, [], no + 1

        for b in batches:
            doc, x = b.column(0).to_numpy(), b.column(2).to_numpy()
            begins = np.flatnonzero(np.diff(doc, prepend=doc[:1]) != 0)
            if len(doc) and doc[0] != last:
                begins = np.concatenate([[0], begins])
            for lo, hi, new in where(begins, len(doc)):
                if new:
                    yield from row()
                own = begins[np.searchsorted(begins, lo) : np.searchsorted(begins, hi)]
                place = np.zeros(hi - lo, dtype=np.int64)
                place[own - lo] = 1
                held.append((docs + np.cumsum(place) - 1, b.column(1).slice(lo, hi - lo), x[lo:hi]))
                ids.append(doc[own])
                docs, size = docs + len(own), size + max(hi - lo, held[-1][1].nbytes >> 8)  # long terms count as many
                if size >= PIECE:
                    code()
            last = doc[-1] if len(doc) else last
        if docs:
            yield from row()

    return cut


def _ranges(most: int, uses: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from (row, term), sorted by term and row, to ranges of terms:
    no, terms; rows, the rows that hold some of them, n, how many each, and at,
    their places in terms, row by row. A range ends after most terms, or with
    the one that reaches uses."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, no, last = _Cut(uses, most), 0, None
        terms, rows, at, count = [], [], [], 0

        def out() -> pa.RecordBatch:
            row, place = np.concatenate(rows), np.concatenate(at)
            order = np.argsort(row, kind="stable")
            known, n = np.unique(row, return_counts=True)
            columns = [pa.array([no], pa.int32()), _lists(pa.chunked_array(terms).combine_chunks(), [count], pa.string()), _lists(known, [len(known)], pa.int64()), _lists(n, [len(n)], pa.int32()), _lists(place[order], [len(place)], pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["no", "terms", "rows", "n", "at"])

        for b in batches:
            row, term = b.column(0).to_numpy(), b.column(1)
            if not len(term):
                continue
            changed = pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.concatenate([[term[0] != last], changed]))
            for lo, hi, new in where(begins, len(term)):
                if new:
                    yield out()
                    terms, rows, at, count, no = [], [], [], 0, no + 1
                own = begins[np.searchsorted(begins, lo) : np.searchsorted(begins, hi)]
                place = np.zeros(hi - lo, dtype=np.int32)
                place[own - lo] = 1
                at.append(count + np.cumsum(place, dtype=np.int32) - 1)
                rows.append(row[lo:hi])
                terms.append(term.take(pa.array(own)))
                count += len(own)
            last = term[len(term) - 1]
        if rows:
            yield out()

    return cut


def _packed(rows: DataFrame, values: list[str]) -> DataFrame:
    """kind, chunk, v: the sums of a chunk's places as one array of doubles,
    place by place; rows: kind, chunk, at and s, arrays of places (ascending)
    and of their values one after the other."""
    w = len(values)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, v = None, np.zeros((0, w))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), _lists(v.ravel(), [v.size], pa.float64())], names=["kind", "chunk", "v"])

        for b in batches:
            for r in range(b.num_rows):
                key = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                at, s = (b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in (2, 3))
                if key != now:
                    if now is not None:
                        yield out()
                    now, v = key, np.zeros((0, w))
                if at[-1] >= len(v):
                    v = np.concatenate([v, np.zeros((int(at[-1]) + 1 - len(v), w))])
                v[at] += s.reshape(-1, w)
        if now is not None:
            yield out()

    return rows.select("kind", "chunk", "at", "s").sortWithinPartitions("kind", "chunk").mapInArrow(pack, "kind int, chunk long, v array<double>")


@dataclass
class State:
    """Parameters before a round: table (kind, chunk, v) holds, for kind 0,
    documents' sums for k topics and their weight, for kind 1 terms' sums;
    totals: the terms' sums of each topic."""

    table: DataFrame
    totals: list[float]


@dataclass
class Blocks:
    """The matrix in rows of whole documents, each of several records (cells, see
    _cutter), and the terms in ranges (ranges, see _ranges), which tell the rows
    that hold them. A range, or a row for its documents, is a chunk of packed
    parameters. In small models u has the terms' numbers in all of them."""

    cells: DataFrame
    ranges: DataFrame
    n_docs: int
    n_terms: int
    k: int

    @classmethod
    def of(cls, x: DataFrame, k: int, together: bool = False) -> Blocks:
        """together: the entries of each document follow each other in x, so
        they needn't be brought together."""
        x = x.select(F.col("doc_id").cast("long").alias("doc_id"), "term", F.col("x").cast("double").alias("x")).where("doc_id IS NOT NULL AND term IS NOT NULL")
        x = x if together else x.repartition("doc_id").sortWithinPartitions("doc_id", "term")
        own = lambda name: (F.shiftleft(F.spark_partition_id().cast("long"), 20) + F.col("no")).alias(name)  # noqa: E731  ascending with the partitions
        cells = checkpointed(x.mapInArrow(_cutter(ENTRIES, DOCS), CELLS).select(own("row"), *[c.split()[0] for c in CELLS.split(", ")[1:]]))
        held = cells.where("terms IS NOT NULL").select("row", F.explode("terms").alias("term"))
        placed = held.repartitionByRange("term").sortWithinPartitions("term", "row")
        ranges = checkpointed(placed.mapInArrow(_ranges(TERMS, USES), "no int, terms array<string>, rows array<long>, n array<int>, at array<int>").select(own("chunk"), "terms", "rows", "n", "at"))
        total = lambda rows, c: rows.agg(F.sum(F.size(c))).first()[0] or 0
        blocks = cls(cells, ranges, total(cells.where("docs IS NOT NULL"), "docs"), total(ranges, "terms"), k)
        if blocks.small:
            blocks._number()
        release(x.sparkSession)
        return blocks

    def _number(self) -> None:
        """Puts the terms' numbers over all ranges in u."""
        first, at = {}, 0
        for r in self.ranges.select("chunk", F.size("terms").alias("n")).orderBy("chunk").collect():  # of a small model
            first[r["chunk"]], at = at, at + r["n"]

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, chunk, at in _told(batches, 1):
                yield pa.RecordBatch.from_arrays([row, pa.array(np.full(len(row), chunk)), _lists(first[chunk] + at.values.to_numpy(), at.value_lengths(), pa.int32())], names=["row", "chunk", "g"])

        told = self.ranges.select("chunk", "rows", "n", "at").mapInArrow(tell, "row long, chunk long, g array<int>")
        told = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("chunk", "g"))).alias("g"))
        names = self.cells.columns

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    one = b.slice(r, 1)
                    if one.column("u")[0].is_valid:
                        u = np.concatenate([g.values.to_numpy() for g in one.column("g")[0].values])[one.column("u")[0].values.to_numpy()]
                        one = one.set_column(names.index("u"), "u", _lists(u, [len(u)], pa.int32()))
                    yield one.select(names)

        joined = self.cells.join(told.select("row", F.transform("g", lambda x: x["g"]).alias("g")), "row").select(*names, "g")
        before, self.cells = self.cells, checkpointed(joined.mapInArrow(number, self.cells.schema))
        discard(before)

    def discard(self, state: State) -> None:
        """Removes the tables; nothing may read them later."""
        discard(self.cells, self.ranges, state.table)

    @property
    def docs(self) -> DataFrame:
        """chunk, at, doc_id: each document's place."""
        return self.cells.where("docs IS NOT NULL").select(F.col("row").alias("chunk"), F.posexplode("docs").alias("at", "doc_id"))

    @property
    def small(self) -> bool:
        return 8 * (self.n_docs + self.n_terms) * (self.k + 1) <= BROADCAST

    def start(self) -> State:
        """The deterministic start of init(), packed."""
        raw = lambda c, i: (((c * 31 + i * 17) % 97) + 1).cast("double")
        ks = range(self.k)
        codes = F.transform("terms", lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 4), 16, 10).cast("int"))  # _code(), with one digest a term
        docs = F.transform("docs", lambda d: F.array(*[raw(d, i) for i in ks], _sum([raw(d, i) for i in ks])))
        coded = self.ranges.select("chunk", codes.alias("c"))
        terms = F.transform("c", lambda c: F.array(*[raw(c, i) for i in ks], F.lit(0.0)))
        totals = coded.select(F.explode("c").alias("c")).agg(*[F.coalesce(F.sum(raw(F.col("c"), i)), F.lit(0.0)) for i in ks]).first()
        rows = self.cells.where("docs IS NOT NULL").select(F.lit(0).alias("kind"), F.col("row").alias("chunk"), F.flatten(docs).alias("v"))
        return State(checkpointed(rows.union(coded.select(F.lit(1), "chunk", F.flatten(terms)))), list(totals))

    @property
    def _values(self) -> list[str]:
        return [*_cols("s", self.k), "n"]

    def _parameters(self, state: State) -> tuple[DataFrame, Callable | None]:
        """(the pieces with the parameters of their documents and terms, a
        function that gets a row's). Small parameters are broadcast as arrays;
        beyond BROADCAST each row's pieces (kind 2) follow its documents' (kind
        0, l) and its own terms' parameters and numbers (kind 1, t, range by
        range): all are dealt by row together, and no range goes where none of
        its terms is."""
        k, pieces = self.k, self.cells.where("u IS NOT NULL")
        no = lambda kind: F.lit(None).cast(kind)
        lists = ("array<double>",) * 2
        if self.small:
            held = {(r["kind"], r["chunk"]): np.array(r["v"]).reshape(-1, k + 1) for r in state.table.where("kind < 2").collect()}  # bounded above
            ranges = sorted(c for c in held if c[0] == 1)
            numbers = np.concatenate([np.zeros(0, dtype=np.int64), *[chunk * TERMS + np.arange(len(held[kind, chunk])) for kind, chunk in ranges]])
            theta = np.concatenate([np.zeros((0, k + 1)), *[held.pop(c) for c in ranges]])
            shared = self.cells.sparkSession.sparkContext.broadcast((held, theta[:, :k], numbers))
            known = lambda row: (shared.value[0][0, row], *shared.value[1:])
            return pieces.select("row", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("chunk"), "first", "n", "u", "x", *[no(c).alias(name) for c, name in zip(lists, "lt")]), known

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, chunk, at, v in _told(batches, 1, 4):
                at, n = at.values.to_numpy().astype(np.int64), at.value_lengths().to_numpy()
                t = np.column_stack([v.reshape(-1, k + 1)[at, :k], chunk * TERMS + at])  # the terms' numbers go along as doubles
                yield pa.RecordBatch.from_arrays([row, pa.array(np.full(len(row), chunk)), _lists(t.ravel(), n * (k + 1), pa.float64())], names=["row", "chunk", "t"])

        own = self.ranges.select("chunk", "rows", "n", "at").join(state.table.where("kind = 1").select("chunk", "v"), "chunk").mapInArrow(send, "row long, chunk long, t array<double>")
        none = [no("int").alias("first"), *[no(c).alias(name) for c, name in zip(("array<int>", "array<int>", "array<double>"), "nux")]]
        rows = state.table.where("kind = 0").select(F.col("chunk").alias("row"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("chunk"), *none, F.col("v").alias("l"), no("array<double>").alias("t"))
        rows = rows.union(own.select("row", F.lit(1), "chunk", *none, no("array<double>"), "t"))
        rows = rows.union(pieces.select("row", F.lit(2), F.col("piece"), "first", "n", "u", "x", *map(no, lists)))
        return rows.repartition("row").sortWithinPartitions("row", "kind", "chunk"), None

    def sums(self, state: State) -> DataFrame:
        """kind, chunk, at, s of the next parameters, dealt by chunk, by one pass;
        kind 2 has the terms' sums over all terms and the likelihood of this
        state (n)."""
        k, totals, n_terms = self.k, np.array(state.totals), self.n_terms
        cells, known = self._parameters(state)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []  # numbers and sums of the terms of the rows met
            size, loglik, all_terms = 0, 0.0, np.zeros(k)
            now, lam, theta, g, docs, own, met, parts = None, None, None, None, None, None, None, []

            def out(kind: int, chunk: np.ndarray, at: list | np.ndarray, s: np.ndarray) -> pa.RecordBatch:
                """chunk: that of each place, ascending."""
                edges = np.flatnonzero(np.diff(chunk, prepend=-1))
                n = np.diff(edges, append=len(chunk))
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, dtype=np.int32)), pa.array(chunk[edges].astype(np.int64)), _lists(at, n, pa.int32()), _lists(s.ravel(), n * (k + 1), pa.float64())], names=["kind", "chunk", "at", "s"])

            def terms() -> Iterator[pa.RecordBatch]:
                nonlocal held, size
                if held:
                    g, s = held[0] if len(held) == 1 else (np.concatenate([h[c] for h in held]) for c in (0, 1))
                    if len(held) > 1:
                        g, inverse = np.unique(g, return_inverse=True)
                        s = np.stack([np.bincount(inverse, s[:, c], len(g)) for c in range(k)], axis=1)
                    yield out(1, g // TERMS, g % TERMS, np.column_stack([s, np.zeros(len(g))]))
                held, size = [], 0

            def ended() -> Iterator[pa.RecordBatch]:
                """What a row gives: its documents' sums, and at times the terms'."""
                nonlocal size
                if docs is not None:
                    yield out(0, np.full(len(docs), now), np.arange(len(docs)), docs)
                    held.append((g[met], own[met]))
                    size += own.size
                    if size > HELD:
                        yield from terms()

            def shares(l: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
                weight = np.where(l[:, k:] == 0, 1.0, l[:, k:])
                return np.where(l[:, k:] == 0, 1.0 / k, l[:, :k] / weight), np.where(totals == 0, 1.0 / n_terms, t / np.where(totals == 0, 1.0, totals))

            for b in batches:
                for r in range(b.num_rows):
                    row, kind = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                    if row != now:
                        yield from ended()
                        now, docs, parts = row, None, []
                    if kind < 2:
                        parts.append(np.array(b.column(7 + kind)[r].values.to_numpy(zero_copy_only=False)).reshape(-1, k + 1))
                        continue
                    if docs is None:
                        if known is None:
                            l, t = parts[0], np.concatenate(parts[1:])  # noqa: E741
                            t, g, parts = t[:, :k], t[:, k].astype(np.int64), []
                        else:
                            l, t, g = known(row)  # noqa: E741
                        lam, theta = shares(l, t)
                        docs, own, met = np.zeros((len(lam), k + 1)), np.zeros((len(g), k)), np.zeros(len(g), dtype=bool)
                    n, u, x = (b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in (4, 5, 6))
                    d = b.column(3)[r].as_py() + np.repeat(np.arange(len(n)), n)
                    met[u] = True
                    docs[:, k] += np.bincount(d, x, len(docs))
                    for lo in range(0, len(u), SLICE):
                        at, w, y = d[lo : lo + SLICE], u[lo : lo + SLICE], x[lo : lo + SLICE]
                        p = lam[at] * theta[w]
                        den = p.sum(1)
                        loglik += float((y[den > 0] * np.log(den[den > 0])).sum())
                        p *= (y / np.where(den > 0, den, 1.0))[:, None]
                        all_terms += p.sum(0)
                        first = at[0]  # a slice meets neighbouring documents
                        for c in range(k):
                            part = np.bincount(at - first, p[:, c])
                            docs[first : first + len(part), c] += part
                            own[:, c] += np.bincount(w, p[:, c], len(g))
            yield from ended()
            yield from terms()
            yield out(2, np.zeros(1), [0], np.array([[*all_terms, loglik]]))

        return cells.mapInArrow(step, "kind int, chunk long, at array<int>, s array<double>").repartition("kind", "chunk")

    def round(self, state: State) -> tuple[State, float]:
        """(the next state, the likelihood of this one)."""
        table = checkpointed(_packed(self.sums(state), self._values))
        *totals, loglik = table.where("kind = 2").select(*[F.element_at("v", c + 1) for c in range(self.k + 1)]).first()
        release(table.sparkSession)
        return State(table, totals), loglik

    def parameters(self, state: State) -> tuple[DataFrame, DataFrame]:
        """(lambda, theta) as wide tables by doc_id and term."""
        k, totals, n_terms = self.k, np.array(state.totals), max(1, self.n_terms)

        def wide(share: Callable[[np.ndarray], np.ndarray], names: list[str]):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for r in range(b.num_rows):
                        s = share(b.column(1)[r].values.to_numpy(zero_copy_only=False).reshape(-1, k + 1))
                        yield pa.RecordBatch.from_arrays([b.column(0)[r].values, *[pa.array(np.ascontiguousarray(s[:, c])) for c in range(k)]], names=names)

            return run

        def table(rows: DataFrame, kind: int, key: str, of: str, share: Callable[[np.ndarray], np.ndarray], prefix: str) -> DataFrame:
            names = _cols(prefix, k)
            return rows.join(state.table.where(F.col("kind") == kind), "chunk").select(key + "s", "v").mapInArrow(wide(share, [of, *names]), f"{of} {'long' if kind == 0 else 'string'}, " + ", ".join(f"{c} double" for c in names))

        lam = lambda s: np.where(s[:, k:] == 0, 1.0 / k, s[:, :k] / np.where(s[:, k:] == 0, 1.0, s[:, k:]))
        theta = lambda s: np.where(totals == 0, 1.0 / n_terms, s[:, :k] / np.where(totals == 0, 1.0, totals))
        docs = self.cells.where("docs IS NOT NULL").select(F.col("row").alias("chunk"), "docs")
        return table(docs, 0, "doc", "doc_id", lam, "l"), table(self.ranges.select("chunk", "terms"), 1, "term", "term", theta, "t")


def _told(batches: Iterator[pa.RecordBatch], first: int, *more: int) -> Iterator[tuple]:
    """(rows, chunk, places of each, further arrays) of each range, whose
    columns rows, n and at begin with column first."""
    for b in batches:
        for r in range(b.num_rows):
            rows, n, at = (b.column(first + c)[r].values for c in range(3))
            yield rows, b.column(0)[r].as_py(), _lists(at, n.to_numpy(), pa.int32()), *[b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in more]


@dataclass
class PLSA:
    """stop: `gain` ends when the likelihood rises by less than tol from one
    round to the next, `change` when it moves by less than tol either way. The
    first round is compared with the second, not with the start."""

    k: int = 10
    max_iter: int = 30
    tol: float = 10.0
    stop: str = "gain"

    def stopped(self, seen: list[float]) -> bool:
        gain = seen[-1] - seen[-2] if len(seen) > 2 else self.tol
        return (gain if self.stop == "gain" else abs(gain)) < self.tol

    def fit(self, x: DataFrame, together: bool = False) -> tuple[DataFrame, DataFrame, list[float]]:
        """(lambda, theta, the likelihood before each round)."""
        blocks = Blocks.of(x, self.k, together)
        state = blocks.start()
        seen: list[float] = []
        for _ in range(self.max_iter):
            after, loglik = blocks.round(state)
            seen.append(loglik)
            if self.stopped(seen):
                discard(after.table)
                break
            discard(state.table)
            state = after
        return *blocks.parameters(state), seen


def _run(blocks: Blocks, n: int, ended: Callable[[list[float]], bool] = lambda seen: False) -> tuple[State, list[float]]:
    """(the state after n rounds, or when ended, the likelihoods before each);
    a round's table is removed when the next has been made of it."""
    state, seen = blocks.start(), []
    while len(seen) < n and not ended(seen):
        after, loglik = blocks.round(state)
        discard(state.table)
        state = after
        seen.append(loglik)
    return state, seen


def rounds(x: DataFrame, k: int, n: int, together: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parameters after n rounds."""
    blocks = Blocks.of(x, k, together)
    return blocks.parameters(_run(blocks, n)[0])


def likelihoods(x: DataFrame, k: int, n: int, together: bool = False) -> list[float]:
    """The likelihood at the start and after each of n rounds."""
    blocks = Blocks.of(x, k, together)
    state, seen = _run(blocks, n + 1)
    blocks.discard(state)
    return seen


def seen_by(x: DataFrame, rules: list[PLSA], together: bool = False) -> list[list[float]]:
    """The likelihoods that each of some rules for the same k sees until it
    stops. Rules don't change a round, so each round is made once for all."""
    blocks, found = Blocks.of(x, rules[0].k, together), [None] * len(rules)

    def ended(seen: list[float]) -> bool:
        for i, rule in enumerate(rules):
            if found[i] is None and (rule.stopped(seen) or len(seen) == rule.max_iter):
                found[i] = list(seen)
        return None not in found

    state, seen = _run(blocks, max(rule.max_iter for rule in rules), ended)
    ended(seen)
    blocks.discard(state)
    return found


def top_words(theta: DataFrame, k: int, n: int = 10) -> DataFrame:
    """topic, rank, term, p: the n likeliest terms of each topic."""
    from pyspark.sql import Window

    long = theta.select("term", F.posexplode(F.array(*[F.round(f"t{i}", 10) for i in range(k)])).alias("topic", "p"))
    order = Window.partitionBy("topic").orderBy(F.desc("p"), "term")
    return long.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n).select(F.col("topic").cast("long").alias("topic"), "rank", "term", "p")


def fold_in(theta: DataFrame, query: list[str], k: int) -> DataFrame:
    """q0..: one row, the query's weight in each topic."""
    counts: dict[str, int] = {}
    for t in query:
        counts[t] = counts.get(t, 0) + 1
    rows = theta.sparkSession.createDataFrame(list(counts.items()), "term string, n long")
    joined = theta.where(F.col("term").isin(list(counts))).join(F.broadcast(rows), "term")  # a query's terms
    return joined.agg(*[F.coalesce(F.sum(F.col(f"t{i}") * (1 + F.log10("n"))), F.lit(0.0)).alias(f"q{i}") for i in range(k)])


def cosine(lam: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """doc_id, similarity of topic shares to a fold_in row; 0 if a norm is 0."""
    joined = lam.crossJoin(F.broadcast(query))  # one row
    dot = _sum([F.col(f"l{i}") * F.col(f"q{i}") for i in range(k)])
    norm = F.sqrt(_sum([F.col(f"l{i}") * F.col(f"l{i}") for i in range(k)])) * F.sqrt(_sum([F.col(f"q{i}") * F.col(f"q{i}") for i in range(k)]))
    return joined.select("doc_id", F.when(norm == 0, 0.0).otherwise(dot / norm).alias("similarity"))


def nearest(lam: DataFrame, query: DataFrame, k: int, n: int = 10) -> DataFrame:
    """rank, doc_id, similarity of the n nearest documents."""
    from pyspark.sql import Window

    found = cosine(lam, query, k).select("doc_id", F.round("similarity", 8).alias("similarity")).orderBy(F.desc("similarity"), "doc_id").limit(n)
    return found.select(F.row_number().over(Window.orderBy(F.desc("similarity"), "doc_id")).cast("long").alias("rank"), "doc_id", "similarity")
