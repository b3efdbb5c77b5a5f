"""Exact searches against brute force: op 11 (lexical) and op 13 (segments)."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import lexical, segments

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERMS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    rows = [(i, terms_of(t)) for i, t in docs if i is not None]
    rows = [(i, t) for i, t in rows if t]
    n_docs, n_all = len(rows), sum(len(t) for _, t in rows)
    out = []
    for item, text in items:
        scores = []
        for i, t in rows:
            s = 0
            for q in set(terms_of(text)):
                if tf := t.count(q):
                    df = sum(q in set(x) for _, x in rows)
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1000000000 * tf // (1000 * tf + 8 * (10 + 90 * len(t) * n_docs // n_all)))
            if s > 0:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def ranked(spark, docs, items, k=10):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, item_id string, rank int")
    items = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    return sorted(tuple(r) for r in lexical.search(spark, docs, items, k).collect())


def test_terms_are_those_of_the_pattern():
    for text in ("Az9 ß_É-日本 x\x00y\x7fz", "", "  ", "a.b.C", "É è"):
        assert [w.decode() for w in lexical.words(text)] == terms_of(text)
    assert lexical.words(None) == []


@pytest.mark.parametrize("small_shards", [False, True])
def test_ranking_is_exact(spark, monkeypatch, small_shards):
    if small_shards:  # many shards, so thresholds and merged lists count
        monkeypatch.setattr(lexical, "SHARD_DOCS", 7)
        monkeypatch.setattr(lexical, "BLOCK_ITEMS", 3)
    rnd = random.Random(5)
    word = lambda: f"w{int(rnd.paretovariate(0.6)) % 60}"
    docs = [(i, " ".join(word() for _ in range(rnd.randrange(1, 40)))) for i in range(150)]
    docs += [(i + 1000, docs[3][1]) for i in range(60)]  # copies: ties
    docs += [(5, docs[5][1]), (7000, None), (7001, ""), (7002, "..."), (None, "w1 w2"), (7003, "w1 " * 3000)]
    items = [(i, docs[7 * i][1]) for i in range(12)] + [(50, None), (51, ""), (52, "unknown"), (53, "w1"), (0, docs[0][1])]
    assert ranked(spark, docs, items) == plain(docs, items)
    assert ranked(spark, docs, items[:3], k=3) == plain(docs, items[:3], 3)


def test_shared_word_of_all_documents_and_empty_tables(spark):
    docs = [(i, "the " + "abc"[i % 3]) for i in range(40)]
    assert ranked(spark, docs, [(1, "the a"), (2, "the")]) == plain(docs, [(1, "the a"), (2, "the")])
    assert ranked(spark, [], [(1, "a")]) == [] == ranked(spark, docs, [])


def test_seeds_are_lower_bounds_and_suffixes_prune(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    index = lexical.build(docs)
    last = {r["item_id"]: r["score"] for r in lexical.rank(index, items).where("rank = 10").collect()}
    least = {r["item_id"]: r["least"] for r in lexical.seeds(items, index, 10).collect()}
    assert len(last) > 30 and all(0 < least[i] <= s for i, s in last.items())
    lists = lexical.Lists(np.arange(4), np.array([0, 1, 2, 3, 1]), np.array([5, 5, 5, 5, 90]), np.array([0, 4, 5]), [b"the", b"rare"])
    found, score = lexical.candidates(lists, {b"the": 0, b"rare": 1}, np.array([5, 90]), [(b"the", 1), (b"rare", 10)], 100)
    assert found.tolist() == [1] and score.tolist() == [905]
    assert len(lexical.candidates(lists, {b"the": 0, b"rare": 1}, np.array([5, 90]), [(b"the", 1), (b"rare", 10)], 906)[0]) == 0


def nearest(rows, every, k, scale=256):
    kept = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, v) in enumerate(kept):
        if i % every == 0:
            scores = [(max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), j) for b, (j, w) in enumerate(kept) if a != b and len(w) == len(v)]
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(sorted(scores, key=lambda t: (-t[0], t[1]))[:k])]
    return sorted(out)


def searched(spark, rows, every, k):
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows], "vec_id long, embedding array<float>, score double")
    return sorted(tuple(r) for r in segments.search(df, every, k).collect())


@pytest.mark.parametrize("rows_of_block", [2048, 16])
def test_segment_search_is_exact(spark, monkeypatch, rows_of_block):
    monkeypatch.setattr(segments, "ROWS", rows_of_block)
    monkeypatch.setattr(segments, "TILES", 4)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 24))
    x = np.float32(centres[rng.integers(0, 6, 500)] + 0.3 * rng.normal(size=(500, 24)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[10][1]) for i in range(250)]  # a third are copies: ties
    rows += [(2000, None), (2010, [float("nan")] * 24), (2020, [None] * 24), (2030, [0.0] * 24), (2040, [1.0, 2.0]), (2050, [3.0, -2.0]), (2060, []), (10, rows[10][1]), (None, [1.0] * 24), (2070, [float("inf")] * 24)]
    assert searched(spark, rows, 10, 5) == nearest(rows, 10, 5)


def test_segment_search_edges(spark):
    assert searched(spark, [], 50, 5) == []
    few = [(0, [1.0, 2.0]), (50, [2.0, 1.0]), (51, [-1.0, -1.0])]
    assert searched(spark, few, 50, 5) == nearest(few, 50, 5)
    large = [(0, [1e9, 1.0, 3e7]), (50, [2e9, 1.0, -5e6]), (51, [1e30, 2.0, 1.0]), (52, [1e8, 3.5, 2.0])]
    large = [(i, np.float32(v).tolist()) for i, v in large]
    assert searched(spark, large, 50, 2) == nearest(large, 50, 2)


def test_bounds_hold_and_cut():
    rng = np.random.default_rng(1)
    x = np.floor(256 * (np.repeat(rng.normal(size=(300, 8)), 8, axis=1) + 0.05 * rng.normal(size=(300, 64))))
    q = x[::50]
    for level in segments.LEVELS:
        assert (segments.stats(q, level) @ segments.stats(x, level).T + segments._slack(q, float(np.sqrt((x**2).sum(1)).max()))[:, None] >= q @ x.T).all()
    kth = np.sort(q @ x.T, axis=1)[:, -5]
    _, _, mask = segments._survivors(q, x, kth)
    assert 5 * len(q) <= mask.sum() < 10 * len(q)


def test_blocks_out_of_reach_are_not_met(spark):
    """Tight far clusters: most pairs of a tile and a block are cut by the header."""
    rng = np.random.default_rng(2)
    x = np.repeat(10 * rng.normal(size=(10, 32)), 40, axis=0) + 0.01 * rng.normal(size=(400, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.float32(x))], "vec_id long, embedding array<float>")
    table = segments.blocks(df.repartition(1), 10, 5, 256.0)
    held = table.where(F.size("at") > 0)
    pairs = held.withColumnRenamed("b", "tile").groupBy("d").cogroup(table.groupBy("d")).applyInArrow(segments._reachable, "tile long, b long").count()
    assert 0 < pairs <= table.count() * held.count()
