"""Codecs, counts, id shards and packing against the tokenizers library."""

import math
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe_codec, byte_bpe, packing, sstable, token_counts, word_bpe
from quarry.llm.common import fresh_dir, vocabulary

LETTERS = "ab 's  \n\t'!t?dllé 　\x1c\x85漢字 12x. aaaa     '' --- ́🙂ÀßÆΣς"
ROWS = [(0, "Plain words, and don't we'll 123."), (1, None), (2, ""), (3, "a" * 9000 + " " * 300 + "b c" * 4000), (4, "x<|endoftext|>y <|endoftext|> z"), (4, "x<|endoftext|>y <|endoftext|> z"), (-5, "\n\n  a\n b  "), (None, "no id"), (9, "qzjxvk" * 2000), (1 << 40, "漢字かな" * 3000)]


def fuzz(n=3000):
    rng = random.Random(3)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [t for _, t in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 7, b"x") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, shard int, ids binary")


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_byte_codec_and_counts_equal_the_library(byte):
    texts = fuzz()
    codec, counter = bpe_codec.Codec("byte_bpe_50k.json", cache=500), token_counts.Counter("byte_bpe_50k.json", cache=500)
    got = [x for i in range(0, len(texts), 100) for x in codec.encode(texts[i : i + 100])]
    counts = [n for i in range(0, len(texts), 100) for n in counter.counts(texts[i : i + 100])]
    for text, x, n in zip(texts, got, counts):
        want = ids(byte, text)
        assert x.tolist() == want and n == len(want), repr(text)[:200]
        assert codec.decode(x) == byte.decode(want, skip_special_tokens=False)


def test_cuts_are_certain():
    bpe = byte_bpe.load("byte_bpe_50k.json")
    assert bpe.cut[ord("e"), ord(" ")] and not bpe.cut[ord(" "), ord("t")]
    for token in bpe.bytes_of[:50256]:
        assert not any(bpe.cut[a, b] for a, b in zip(token, token[1:]))


def test_heap_equals_rounds():
    bpe, merger = byte_bpe.load("byte_bpe_50k.json"), byte_bpe.merger("byte_bpe_50k.json")
    rng = random.Random(1)
    for _ in range(200):
        symbols = bpe.byte_id[np.frombuffer("".join(rng.choice("abet ah") for _ in range(rng.randint(1, 80))).encode(), dtype=np.uint8)]
        assert merger._heap(symbols.tolist()) == merger._rounds(symbols, np.zeros(len(symbols), dtype=np.int64))[0].tolist()


def test_word_codec_equals_the_library(word):
    texts = fuzz()
    codec = word_bpe.WordCodec("word_bpe_49k.json", cache=500)
    for text, x in zip(texts, codec.encode(texts)):
        assert x.tolist() == ids(word, text), repr(text)[:200]


def test_round_trip(docs, byte):
    rows = bpe_codec.round_trip_digests(docs).collect()
    want = []
    for i, t in ROWS:
        x = ids(byte, t)
        want.append((i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(byte.decode(x, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    back = bpe_codec.decode_documents(bpe_codec.encode_documents(docs)).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((i, t or "")) for i, t in ROWS)


def test_counts(docs, byte):
    rows = token_counts.count_tokens(docs, limit=512).collect()
    want = [(i, len((t or "").encode()), len(ids(byte, t)), len(ids(byte, t)) > 512) for i, t in ROWS]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))


def test_shards(spark, docs, word):
    manifest = sstable.write_shards(docs, fresh_dir(spark, "test"), shards=3)
    rows = sstable.read_shards(manifest, shards=3).collect()
    start, want = 0, []
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        x = ids(word, t) + [1]
        want.append((i, start, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())))
        start += len(x)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    found = sstable.lookup(manifest, spark.createDataFrame([(4,), (-5,), (77,), (1 << 40,)], "doc_id long")).collect()
    assert sorted((r["doc_id"], list(r["ids"])) for r in found) == sorted((i, ids(word, t) + [1]) for i, t in ROWS if i in (4, -5, 1 << 40))


def test_shard_file(tmp_path):
    path, keys = str(tmp_path / "a.sst"), list(range(-3000, 9000, 3))
    with open(path, "wb") as f:
        writer = sstable.Writer(f, 2)
        for k in keys:
            writer.add(sstable.key_of(k), np.arange(k % 50, dtype=np.uint16))
        with pytest.raises(ValueError):
            writer.add(sstable.key_of(-9999), np.zeros(1, dtype=np.uint16))
        assert writer.close() == f.tell()
    reader = sstable.Reader(path)
    assert len(reader.blocks) > 3 and [k for k, _ in reader.scan()] == keys
    for k in range(-3010, 9010, 7):
        assert [x.tolist() for x in reader.get(k)] == ([list(range(k % 50))] if k in set(keys) else [])
    assert sum(reader.may_hold(sstable.key_of(k)) for k in range(10_000, 20_000)) < 300
    with open(path, "r+b") as f:
        f.write(b"\xff")
    with pytest.raises(ValueError):
        list(sstable.Reader(path).scan())
    assert os.path.getsize(path) > 0


def check_packing(pieces, rows, word, window):
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    copies = {}
    for i, t in rows:
        copies.setdefault(i, []).append(ids(word, t) + [1])
    assert by_doc.keys() == copies.keys()
    for i, mine in by_doc.items():
        whole = copies[i][0]
        assert sum(r["length"] for r in mine) == len(whole) * len(copies[i])
        for r in mine:
            assert r["doc_tokens"] == len(whole) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(whole[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
        covered = sorted(x for r in mine for x in range(r["start"], r["start"] + r["length"]))
        assert covered == sorted(list(range(len(whole))) * len(copies[i]))
    size = []
    for mine in by_sequence.values():
        at = 0
        for r in sorted(mine, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        size.append(at)
    assert max(size) <= window
    return size


def test_packing(docs, word):
    size = check_packing(packing.pack(docs, window=256, shard_docs=4).collect(), ROWS, word, 256)
    assert sum(n < 256 for n in size) <= 3  # one a shard at most
    size = check_packing(packing.pack(docs).collect(), ROWS, word, 2048)
    assert sum(n < 2048 for n in size) <= 1


def statistics(docs):
    df = np.zeros(256, dtype=np.int64)
    for x in docs:
        df[np.unique(x)] += 1
    return packing.Statistics(df, len(docs), sum(map(len, docs)))


def windows(docs, window):
    packer = packing.Packer(statistics(docs), window)
    return [*packer.shard(docs), *packer.rest()]


def test_packing_prefers_neighbours():
    a, b = np.array([5, 6, 7, 8] * 3, dtype=np.uint16), np.array([15, 16, 17, 18] * 3, dtype=np.uint16)
    docs = [np.append(x, k + 100).astype(np.uint16) for k, x in enumerate([a, b, b, a, b, a])]
    assert {d for d, _, _ in windows(docs, 39)[0]} == {0, 3, 5}


def test_packing_goes_on_until_the_window_is_full():
    docs = [np.array([5, 6, 7 + k % 2], dtype=np.uint16) for k in range(60)]
    assert [d for d, _, _ in windows(docs, 90)[0]] == list(range(0, 60, 2))  # all thirty of its kind


def test_packing_takes_the_nearest_by_brute_force():
    rng = np.random.default_rng(6)
    docs = [rng.integers(2, 60, rng.integers(1, 40)).astype(np.uint16) ** 2 % 200 for _ in range(40)]
    docs += docs[:5]
    stats = statistics(docs)
    mean, n = np.mean([len(x) for x in docs]), len(docs)
    df = {t: sum(t in x for x in docs) for t in range(256)}

    def score(seed, doc):
        total = 0.0
        for t in sorted(set(docs[seed].tolist())):
            tf = docs[doc].tolist().count(t)
            idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) if df[t] > 1 else 0.0
            total += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(docs[doc]) / mean))
        return total

    index = packing.Index(docs, stats)
    brute = np.array([[score(s, d) for d in range(n)] for s in range(n)])
    found = np.array([index.scores(s) for s in range(n)])
    other = ~np.eye(n, dtype=bool)  # a document's own terms that no other holds aren't indexed
    assert np.abs(brute - found)[other].max() < 2e-2
    # greedy: each piece after the seed is the nearest unused document
    unused, seed = set(range(n)), None
    for window in windows(docs, 64):
        for doc, start, size in window:
            if start == 0:
                if seed is not None and (near := [d for d in unused if found[seed, d] > 0]):
                    assert doc == min(near, key=lambda d: (-found[seed, d], d))
                else:
                    assert doc == min(unused)
                    seed = doc
                unused.discard(doc)
            else:
                seed = doc
        if start + size == len(docs[doc]):
            seed = None
    assert not unused


def test_packing_keeps_like_documents_together(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(3000)]
    rows = []
    for group in range(60):  # near copies, which hashes of ids would deal over all shards
        own = [rng.choice(words) for _ in range(60)]
        for _ in range(4):
            rows.append((group + 60 * rng.randint(1, 10**6), " ".join(w if rng.random() < 0.97 else rng.choice(words) for w in own)))
    rng.shuffle(rows)
    sequences = {}
    for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=600, shard_docs=16).collect():
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["doc_id"] % 60))
    beside = [a[1] == b[1] for s in sequences.values() for a, b in zip(sorted(s), sorted(s)[1:])]
    assert sum(beside) > 100  # of 180 neighbours that documents could have


def test_packing_splits_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_SHARDS", 1)
    rows = [(i, "one and the same text of a few words" if i % 3 else f"text {i} of its own words w{i} x{i}") for i in range(300)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=64, shard_docs=8).collect()
    ranges = {}
    for r in found:
        ranges.setdefault(r["sequence_id"] >> 32, set()).add(r["doc_id"])
    assert sorted(x for s in ranges.values() for x in s) and set().union(*ranges.values()) == set(range(300))
    assert max(map(len, ranges.values())) < 60


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_codec.round_trip_digests(none).count() == 0
    assert token_counts.count_tokens(none).count() == 0
    assert sstable.write_and_read(spark, none).count() == 0
    assert packing.pack(none).count() == 0


def test_small_tables_give_the_same_ids(word):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdef") * rng.randint(1, 5) + str(rng.randint(0, 300)) for _ in range(80)) for _ in range(60)]
    small, large = word_bpe.WordCodec("word_bpe_49k.json", cache=200), word_bpe.WordCodec("word_bpe_49k.json")
    found = [x.tolist() for k in range(0, 60, 7) for x in small.encode(texts[k : k + 7])]
    assert found == [x.tolist() for x in large.encode(texts)] == [word.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(small.known) < 1000 and small.known.old


def test_terms_of_many_documents_are_counted_together(docs, word, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 3)
    rows = packing._encoded(docs, "word_bpe_49k.json", 1).collect()
    df = sum(np.frombuffer(r["counts"], dtype="<i8") for r in rows if r["counts"] is not None)
    want, keys = np.zeros(len(df), dtype=np.int64), packing.Keys(len(df))
    for r in (r for r in rows if r["n"] is not None):
        terms = np.unique(packing._ids(r["ids"], r["n"])).astype(np.int64)
        want[terms] += 1
        assert r["key"] >> 23 == keys.of(terms, 0) >> 23
    assert (df == want).all()
