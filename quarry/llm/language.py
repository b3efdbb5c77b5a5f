"""Operator 7, language identification by word-first backoff.

The model holds, for each language, log frequencies of words and of character
n-grams. A word that the model knows scores by its own log frequencies; one it
doesn't know falls back to its longest n-grams of which some are known, from
five characters down to one. A document's scores are sums over its words.

The model is learned from every row that has a language and isn't held out:
words are counted where the texts lie, summed by a shuffle, and n-grams are
counted over the distinct words. (sample, if given, learns from so many rows of
each language instead, those with the smallest hash of their id.) Words, and
n-grams of more than two characters, that occur fewer than LEAST times in all
aren't kept, as one or two occurrences say little of a frequency; nor are those
that in no language make up FLOOR of its words, or of its n-grams of that
length, so the model's size depends on the number of languages alone. All of
them count in the totals, and words that aren't kept in the n-grams they fall
back to. The model is broadcast. Prediction is one pass without a shuffle; each
worker keeps the scores of words it has met.

Words are runs between white space, reduced to their letters, lower-cased.
lang_pred is `und`, with score 0, if a text is null or has no letter, or if
there is nothing to learn from; ties go to the first language by name. score
is the softmax of the sums over the square root of the number of words. Whole
texts count, however long; repeated rows, also of one doc_id with different
texts or languages, are rows like any other, and teach with their own text;
rows without doc_id are predicted but teach nothing. An empty table gives no
rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quarry.llm import byte_bpe
from quarry.llm.bpe_codec import in_slices
from quarry.llm.common import crc_fold, discard, materialize, texts

SAMPLE, LEAST, FLOOR, LONGEST, SMOOTH = 1000, 3, 2e-6, 5, 0.5
#: Whole words, then the lengths of n-grams, as words fall back to them.
LENGTHS = (0, *range(LONGEST, 0, -1))
#: Bytes of texts, and of distinct words, that are counted at once.
TEXT_BYTES, WORD_BYTES = 8 << 20, 1 << 19


def letters(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def least_of(n: int, least: int) -> int:
    return 1 if n in (1, 2) else least


class Model:
    """languages, and for words and for n-grams of each length a dictionary of
    rows and their log frequencies by language."""

    def __init__(self, rows: list[tuple[str, str | None]], least: int = LEAST):
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, text in rows:
            counts[lang].update(filter(None, map(letters, (text or "").split())))
        self.languages = sorted(lang for lang, c in counts.items() if c)
        self.tables: list[tuple[dict[str, int], np.ndarray]] = []
        for n in LENGTHS:
            parts = [counts[lang] if n == 0 else Counter() for lang in self.languages]
            for lang, c in zip(self.languages, parts if n else ()):
                for word, k in counts[lang].items():
                    for g in grams(word, n):
                        c[g] += k
            size = np.array([sum(c.values()) for c in parts], dtype=np.int64)
            known = list({p: None for c in parts for p in c})
            times = np.array([[c[p] for c in parts] for p in known], dtype=np.int64).reshape(len(known), len(parts))
            kept = (times.sum(axis=1) >= least_of(n, least)) & ((times > 0) & (times >= FLOOR * size)).any(axis=1)
            self._add([p for p, k in zip(known, kept) if k], times[kept], size)

    @classmethod
    def of_counts(cls, languages: list[str], counts: list[tuple[list[str], np.ndarray, np.ndarray]]) -> Model:
        """From the kept words or n-grams of each of LENGTHS, how often each
        stands in each language, and what all of a language are."""
        model = cls([])
        model.languages, model.tables = languages, []
        for parts, times, size in counts:
            model._add(parts, times, size)
        return model

    def _add(self, parts: list[str], times: np.ndarray, size: np.ndarray) -> None:
        logs = np.log((times + SMOOTH) / (size + SMOOTH * (len(parts) + 1)))
        self.tables.append((dict(zip(parts, range(len(parts)))), logs.astype(np.float32)))

    def word(self, word: str) -> np.ndarray | None:
        """Scores of a word by language; None if it has no letter, or the model
        no language."""
        plain = letters(word)
        if not plain or not self.languages:
            return None
        rows, logs = self.tables[0]
        if (found := rows.get(plain)) is not None:
            return logs[found]
        for (rows, logs), n in zip(self.tables[1:], LENGTHS[1:]):
            if known := [x for g in grams(plain, n) if (x := rows.get(g)) is not None]:
                return np.mean(logs[known], axis=0)
        return np.zeros(len(self.languages), dtype=np.float32)


class Scorer(byte_bpe.FragmentTable):
    """Words' row in a growing array of scores; row 0: no letter."""

    def __init__(self, model: Model, cache: int = byte_bpe.SCORES):
        self.model = model
        self.rows = np.zeros((1 << 16, max(1, len(model.languages))), dtype=np.float32)
        super().__init__({}, cache)

    def empty(self) -> None:
        super().empty()
        self.used = 1

    def split(self, text: str) -> list[str]:
        return text.split()

    def learn(self, fragments: list[str]) -> list[int]:
        out = []
        for word in fragments:
            found = self.model.word(word)
            if found is None:
                out.append(0)
                continue
            if self.used == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.used] = found
            out.append(self.used)
            self.used += 1
        return out

    def predict(self, batch: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        if self.used > 2 * self.cache:  # words that aren't kept have filled it
            self.empty()
        for found in self.resolve(batch):
            at = np.array(found, dtype=np.int64)
            at = at[at > 0]
            if not len(at) or not self.model.languages:
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.rows[at].sum(axis=0, dtype=np.float64) / len(at) ** 0.5
            p = np.exp(total - total.max())
            best = int(np.argmax(total))
            langs.append(self.model.languages[best])
            scores.append(float(p[best] / p.sum()))
        return langs, scores


def _teaching(docs: DataFrame, fold: int | None, folds: int) -> DataFrame:
    """doc_id, lang, text of the rows that teach; fold None: nothing is held
    out, and rows without doc_id teach too."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull())
    return rows if fold is None else rows.where(crc_fold("doc_id", folds) != fold)


def _portions(batches: Iterator[pa.RecordBatch], at: int, size: int) -> Iterator[pa.Table]:
    """All rows, in tables of so many bytes in column at, or of one row."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).astype(np.int64))
        first, before = 0, 0
        while first < len(ends):
            last = max(int(np.searchsorted(ends, before + size - n, side="right")), first if held else first + 1)
            if last > first:
                held.append(batch.slice(first, last - first))
                first, n, before = last, n + int(ends[last - 1]) - before, int(ends[last - 1])
            if first < len(ends):
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _plain(words: pa.Array) -> pa.Array:
    """letters() of words; those of ASCII together."""
    plain = pc.string_is_ascii(words)
    other = pa.array([letters(w) for w in words.filter(pc.invert(plain)).to_pylist()], pa.string())
    return pc.replace_with_mask(pc.replace_with_mask(words, plain, pc.ascii_lower(pc.replace_substring_regex(words.filter(plain), "[^A-Za-z]+", ""))), pc.invert(plain), other)


def _word_counts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """lang, word, k of (lang, text), by portions of the texts."""
    byte_bpe.release()
    for some in _portions(batches, 1, size):
        # splits where str.split does, and has empty words at a text's ends
        words = pc.utf8_split_whitespace(some["text"].combine_chunks())
        of = np.repeat(np.arange(len(some)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        found = pa.table({"lang": some["lang"].take(pa.array(of)), "word": words.flatten()})
        found = found.group_by(["lang", "word"], use_threads=False).aggregate([([], "count_all")])
        found = pa.table({"lang": found["lang"], "word": _plain(found["word"].combine_chunks()), "k": found["count_all"]})
        found = found.group_by(["lang", "word"], use_threads=False).aggregate([("k", "sum")])
        found = pa.table({"lang": found["lang"], "word": found["word"], "k": found["k_sum"]})
        yield from found.filter(pc.not_equal(found["word"], "")).to_batches()
        del some, words, of, found
        pa.default_memory_pool().release_unused()


def _part_counts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """n, part, lang, k of (lang, word, k): the words (n is 0), and their
    n-grams as grams() has them, by portions of the words."""
    byte_bpe.release()

    def out(n: int, part: pa.Array, lang: pa.Array, k: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(part), n, dtype=np.int32)), part, lang, k], names=["n", "part", "lang", "k"])

    for some in _portions(batches, 1, size):
        lang, word, k = (some[c].combine_chunks() for c in ("lang", "word", "k"))
        yield out(0, word, lang, k)
        marked = [f"^{w}$" for w in word.to_pylist()]
        flat, times, langs = "".join(marked), k.to_numpy(), lang.dictionary_encode()
        code = np.frombuffer(flat.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        of = np.repeat(np.arange(len(marked)), [len(m) for m in marked])
        # windows that stay within a word, and which language and letters so far each has
        at, group = np.arange(len(code)), langs.indices.to_numpy().astype(np.int64)[of]
        for n in range(1, LONGEST + 1):
            fits = at + n <= len(code)
            at, group = at[fits], group[fits]
            fits = of[at] == of[at + n - 1]
            at, group = at[fits], group[fits]
            _, first, group = np.unique(group * 0x110000 + code[at + n - 1], return_index=True, return_inverse=True)
            count = np.bincount(group, weights=times[of[at]]).astype(np.int64)
            first = at[first]
            if n == 1:  # the marks count in longer ones alone
                inner = ~np.isin(code[first], (ord("^"), ord("$")))
                first, count = first[inner], count[inner]
            yield out(n, pa.array([flat[i : i + n] for i in first.tolist()], pa.string()), lang.take(pa.array(of[first])), pa.array(count))


def learn(docs: DataFrame, fold: int | None = 2, folds: int = 4, text_bytes: int = TEXT_BYTES, word_bytes: int = WORD_BYTES) -> Model:
    """The model of all rows outside the held-out fold that have a language."""
    counted = _teaching(docs, fold, folds).where(F.col("text").isNotNull()).select("lang", "text").mapInArrow(lambda b: _word_counts(b, text_bytes), "lang string, word string, k long")
    words = materialize(counted.groupBy("lang", "word").agg(F.sum("k").alias("k")), "words")
    # how many n-grams a word has follows from its length
    chars = F.length("word")
    many = {n: F.lit(1) if n == 0 else chars if n == 1 else F.greatest(chars + 3 - n, F.lit(0)) for n in LENGTHS}
    sizes = words.groupBy("lang").agg(*[F.sum(F.col("k") * x).alias(f"n{n}") for n, x in many.items()])
    found = {r["lang"]: r for r in sizes.collect()}  # one row a language
    languages = sorted(found)
    size = {n: np.array([found[lang][f"n{n}"] for lang in languages], dtype=np.int64) for n in LENGTHS}
    all_of = sizes.select("lang", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"n{n}").alias("size")) for n in LENGTHS])).alias("x")).select("x.n", "lang", "x.size")
    # each task has counted its own, so they are dealt by part once, without the language
    parts = words.mapInArrow(lambda b: _part_counts(b, word_bytes), "n int, part string, lang string, k long").repartition("n", "part").groupBy("n", "part", "lang").agg(F.sum("k").alias("k"))
    parts = parts.join(F.broadcast(all_of), ["n", "lang"]).groupBy("n", "part").agg(F.sum("k").alias("total"), F.max(F.col("k") >= FLOOR * F.col("size")).alias("common"), F.collect_list(F.struct("lang", "k")).alias("by"))
    parts = parts.where(F.col("common") & (F.col("total") >= F.when(F.col("n").isin(1, 2), least_of(1, LEAST)).otherwise(LEAST)))
    kept = parts.select("n", "part", "by").toArrow()  # bounded by FLOOR
    discard(words)
    counts = []
    for n in LENGTHS:
        some = kept.filter(pc.equal(kept["n"], n)).combine_chunks()
        by = some["by"].combine_chunks()
        of = np.repeat(np.arange(len(some)), pc.list_value_length(by).to_numpy(zero_copy_only=False))
        lang = pc.index_in(by.flatten().field("lang"), value_set=pa.array(languages, pa.string())).to_numpy(zero_copy_only=False)
        times = np.zeros((len(some), len(languages)), dtype=np.int64)
        times[of, lang] = by.flatten().field("k").to_numpy(zero_copy_only=False)
        counts.append((some["part"].to_pylist(), times, size[n]))
    return Model.of_counts(languages, counts)


def sample_rows(docs: DataFrame, fold: int | None = 2, folds: int = 4, sample: int = SAMPLE) -> list[tuple[str, str | None]]:
    """(lang, text) of at most sample rows of each language, outside the
    held-out fold."""
    rows = _teaching(docs, fold, folds)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return []
    rows = rows.withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)))

    def taken(some: DataFrame) -> dict[str, list[str | None]]:
        """Of each language the rows with the lowest hashes, at most sample."""
        order = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
        found = some.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("lang", "r", "text").orderBy("lang", "r")
        out: dict[str, list[str | None]] = {}
        for r in found.collect():  # at most sample rows a language
            out.setdefault(r["lang"], []).append(r["text"])
        return out

    # rows whose hash is low enough to be among the first, before any shuffle
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 2.0 * sample / n))])
    found = taken(rows.where(F.col("h") < F.element_at(share, F.col("lang")) * (1 << 30)))
    # where rows repeat so much that few hashes are low, all rows of the language are looked at
    short = [lang for lang, n in counts.items() if len(found.get(lang, [])) < min(sample, n)]
    found |= taken(rows.where(F.col("lang").isin(short))) if short else {}
    return [(lang, text) for lang in sorted(found) for text in found[lang]]


def _scorer(packed: bytes) -> Scorer:
    """One scorer for each model and worker."""
    return byte_bpe.table_of((Scorer, zlib.crc32(packed)), lambda: Scorer(pickle.loads(packed)))


def _model(docs: DataFrame, fold: int | None, folds: int, sample: int | None) -> Broadcast:
    """The model, of bounded size, packed."""
    model = learn(docs, fold, folds) if sample is None else Model(sample_rows(docs, fold, folds, sample))
    return docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))


def identify(docs: DataFrame, fold: int = 2, folds: int = 4, sample: int | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document. sample: how many
    rows of each language teach; None: all."""
    shared = _model(docs, fold, folds, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for batch in batches:
            for first, rows in in_slices(batch.column(1)):
                langs, scores = scorer.predict(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    scored = texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", F.coalesce(crc_fold("doc_id", folds) == fold, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.0, fold: int | None = 2, folds: int = 4, sample: int | None = None) -> DataFrame:
    """The rows of docs, all columns, that have a language: not `und`, and (if
    it is asked for) a score of at least least; with the language found and its
    score as lang_pred and lang_score, which replace columns of these names.
    fold None: nothing is held out. sample: as for identify."""
    docs = docs.drop("lang_pred", "lang_score")
    shared = _model(docs, fold, folds, sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for batch in batches:
            for first, rows in in_slices(batch.column(at)):
                langs, scores = scorer.predict(rows)
                kept = [lang != "und" and score >= least for lang, score in zip(langs, scores)]
                found = batch.slice(first, len(rows)).append_column("lang_pred", pa.array(langs, pa.string())).append_column("lang_score", pa.array(scores, pa.float64()))
                yield found.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())]))
