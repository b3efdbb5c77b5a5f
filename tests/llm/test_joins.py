"""Joins and searches against brute force on small tables."""

import random
import re
import time

import numpy as np
import pytest

from quarry.llm import mips, neardup, setjoin
from quarry.llm.components import components


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(rng.randint(1000, 2000), rng.randint(1000, 2000)) for _ in range(700)] + [(5000, 5000 + i) for i in range(500)] + [(7, 7)]
    rng.shuffle(edges)
    found = components(spark.createDataFrame([*edges, (None, 3)], "a long, b long").repartition(5)).collect()
    want = roots({x for e in edges for x in e}, edges)
    assert {r["id"]: r["component_id"] for r in found} == {i: r for i, r in want.items() if i != r}


def shingle_sets(rows, k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(90):
        base = [rng.choice(vocabulary) for _ in range(int(np.exp(rng.uniform(0.5, 6.6))))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((i, " ".join(words)))
            i += 1
    hot = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(60):  # a large group, of which not all link with each other
        words = list(hot)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
        i += 1
    rows += [(i, "Same Text\there"), (i + 1, "same text  here"), (i + 2, "same text here"), (i + 3, None), (i + 4, ""), (i + 5, " \n"), (i + 6, rows[0][1]), (i + 7, "word " * 30000)]
    return rows


@pytest.mark.parametrize("k, num, den, tile, hot", [(4, 85, 100, 8, 64), (5, 80, 100, 512, 64), (4, 85, 100, 8, 3), (5, 80, 100, 16, 5)])
def test_jaccard_join(spark, monkeypatch, k, num, den, tile, hot):
    monkeypatch.setattr(setjoin, "TILE", tile)  # many pairs of blocks, and few
    monkeypatch.setattr(setjoin, "HOT", hot)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, b"") for r in rows] + [(None, rows[0][1], 1, b""), (0, rows[0][1], 1, b"")], "doc_id long, text string, kind int, blob binary").repartition(6)
    sets = shingle_sets(rows, k)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = roots(sets, links)
    got = setjoin.jaccard_components(docs, k, num, den).collect()
    assert len(got) == len(rows) + 2 and len(links) > 150
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    kept = setjoin.keep_one(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), k, num, den)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in sets if want[i] == i) and kept.columns == docs.columns


def linked_pairs(num, den, n=1500):
    rng = np.random.default_rng(0)
    share = 1 - num / den
    for _ in range(n):
        n = int(np.exp(rng.uniform(0, 7)))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        d = int(share * n * rng.uniform(0.5, 1.1))
        x = int(rng.integers(0, d + 1))
        a, b = np.unique(a), np.unique(np.concatenate([a[: n - x], rng.integers(0, 1 << 63, d - x, dtype=np.uint64)]))
        if len(b) and den * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b)):
            yield a, b


@pytest.mark.parametrize("num, den", [(85, 100), (80, 100), (60, 100)])
def test_keys_and_signatures_miss_no_link(num, den):
    bands, linked = setjoin.Bands(num, den), 0
    for a, b in linked_pairs(num, den):
        linked += 1
        (x, sx), (y, sy) = setjoin.set_keys(a, bands), setjoin.set_keys(b, bands)
        band = bands.of(max(len(a), len(b)))[0]
        shared = np.intersect1d(x, y)
        shared = shared[(shared & np.uint64(127)) >> np.uint64(1) == band]
        exact = (shared & np.uint64(1)) == 0
        # more keys are shared than may be hot, or a key of the deletion allocation is
        assert exact.sum() > bands.allocation(band)[2] or (~exact).any()
        u, v = (np.frombuffer(bands.split(len(s), sig)[band], dtype=np.uint8) for s, sig in ((a, sx), (b, sy)))
        assert (u != v).sum() <= (den - num) * (len(a) + len(b)) // (den + num)
    assert linked > 800


def test_allocation_of_very_large_sets_is_quick():
    begin = time.time()
    for num in (85, 80):
        bands = setjoin.Bands(num, 100)
        assert all(bands.allocation(b)[0] for b in bands.of(1_000_000))
    assert time.time() - begin < 1


def test_groups_of_near_copies_send_few_rows(spark, monkeypatch):
    rng, found = random.Random(3), {}
    base = [f"v{i}" for i in range(150)]
    rows = []
    for i in range(400):  # a few of the pairs link
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(setjoin, "TILE", 64)
    keep = setjoin.materialize
    monkeypatch.setattr(setjoin, "materialize", lambda df, tag: found.setdefault(tag, []).append(keep(df, tag)) or found[tag][-1])
    monkeypatch.setattr(setjoin, "discard", lambda *_: None)
    got = setjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    sets = shingle_sets(rows, 4)
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(links) > 3000
    tiles = found["ends"][0].select("g", "i", "j").distinct().count()
    assert found["links"][-1].count() <= 2 * 64 * tiles and found["seen"][0].count() <= 5 * found["ends"][0].count()


def test_keep_one_keeps_repeated_rows_and_rows_without_id(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    kept = setjoin.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [rows[0], rows[1], rows[3], rows[4]]))


def met(spark, *rows):
    """Stars and hot keys of one bucket's rows of (kind, columns)."""
    blob = lambda kind, columns: setjoin._pack(*columns) if kind == setjoin.KEYS else setjoin._blob(*columns)
    packed = [(0, kind, bytearray(blob(kind, np.array(columns, dtype=np.int64))), None) for kind, columns in rows]
    found = setjoin._meet(spark.createDataFrame(packed, "bucket int, kind int, blob binary, sigs binary"), 2).collect()
    return {(r["key"], r["a"], r["b"]) for r in found if r["kind"] == setjoin.STARS}, {r["key"] for r in found if r["kind"] == setjoin.HOT_KEYS}


def test_keys_merge_only_with_equal_members(spark, monkeypatch):
    # document 0 holds key 5 alone; keys 6 and 7 have the same members as 3
    rows = (setjoin.KEYS, [[5], [0]]), (setjoin.KEYS, [[3, 5, 6, 7], [7] * 4]), (setjoin.KEYS, [[3, 5, 6, 7], [1 << 40] * 4])
    assert met(spark, *rows) == ({(3, 7, 1 << 40), (5, 0, 7), (5, 0, 1 << 40)}, set())
    monkeypatch.setattr(setjoin, "HOT", 1)  # hot keys don't merge
    assert met(spark, *rows) == ({(k, 7, 1 << 40) for k in (3, 6, 7)} | {(5, 0, 7), (5, 0, 1 << 40)}, {3, 5, 6, 7})


def test_keys_of_slices_count_all_members(spark):
    words = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(words[:j] + [f"x{i}"] + words[j + 1 :])) for i, j in ((0, 3), (1, 70), (2, 40))]
    rows = setjoin._emit(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), 4, 60, 100, 1).collect()
    columns = lambda kind, n: np.concatenate([setjoin._columns(bytes(r["blob"]), n) for r in rows if r["kind"] == kind], axis=1)
    inside = {}
    for key, a, b in columns(setjoin.STARS, 3).T.tolist():
        inside.setdefault(key, {a}).add(b)
    key, _, mark, n = columns(setjoin.GROUPS, 4)
    assert set(key.tolist()) == set(inside) and len({tuple(sorted(x)) for x in inside.values()}) > 1
    for k, m, size in zip(key.tolist(), mark.tolist(), n.tolist()):
        assert int(setjoin._mark(np.array(sorted(inside[k]))).sum().astype(np.int64)) == m and size == len(inside[k])
    # of two keys with documents 7 and 9, one has 8 besides 7 in its slice
    own = setjoin._mark(np.array([7, 8])).sum().astype(np.int64)
    assert met(spark, (setjoin.GROUPS, [[5], [7], [own], [2]]), (setjoin.KEYS, [[3], [7]]), (setjoin.KEYS, [[3, 5], [9, 9]]))[0] == {(3, 7, 9), (5, 7, 9)}


def test_jaccard_join_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert setjoin.jaccard_components(none).count() == 0 and setjoin.keep_one(none).count() == 0


def vectors(spark, d=24, n=700):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[100:140] = x[100] + 0.12 * rng.standard_normal((40, d)).astype(np.float32)
    x[200:230] = x[200] * rng.uniform(0.5, 2, (30, 1)).astype(np.float32)
    x[300:310] = x[300]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(9000, None), (9001, [0.0] * d), (9002, [float("nan")] + [1.0] * (d - 1)), (9003, [float("inf")] * d), (9004, [None] + [1.0] * (d - 1)), (9005, []), (None, x[0].tolist()), (9020, [1.0, 2.0, 3.0]), (9040, [1.0, 2.0, 3.1])]
    frame = spark.createDataFrame(rows + [(*r, 1) for r in odd], "vec_id long, embedding array<float>, w int").repartition(5)
    return x.astype(np.float64), odd, frame


def test_near_duplicates(spark, monkeypatch):
    x, odd, frame = vectors(spark)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    want = roots(range(len(x)), [(a, b) for a, b in zip(*map(list, np.nonzero(hit)))])
    for per_cell, chunk in ((2048, 4096), (60, 16)):  # one cell, and many with chunks
        monkeypatch.setattr(neardup, "PER_CELL", per_cell)
        monkeypatch.setattr(neardup, "CHUNK", chunk)
        got = neardup.near_duplicates(frame).collect()
        assert len(got) == len(x) + len(odd)
        for r in got:
            i = r["vec_id"]
            if i is not None and i < len(x):
                assert (r["n_links"], r["component_id"], r["kept"]) == (hit[i].sum(), want[i], want[i] == i)
            elif i == 9040:
                assert (r["n_links"], r["component_id"]) == (1, 9020)
            else:
                assert r["n_links"] == (1 if i == 9020 else 0) and r["component_id"] == i


def test_inner_product_search(spark):
    x, odd, frame = vectors(spark)
    got = mips.search(frame, every=20, k=20, rerank=128).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    found = 0
    for q in range(0, len(x), 20):
        rows = sorted(by[q], key=lambda r: r["rank"])
        score = x @ x[q]
        assert [r["rank"] for r in rows] == list(range(1, 21)) and q not in {r["vec_id"] for r in rows}
        assert all(abs(r["score"] - score[r["vec_id"]]) < 1e-9 for r in rows)
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        score[q] = -np.inf
        found += len({r["vec_id"] for r in rows} & set(np.argsort(-score)[:20].tolist()))
    assert found / (20 * len(range(0, len(x), 20))) >= 0.9
    assert [r["vec_id"] for r in by[9020]] == [9040] and set(by) == set(range(0, len(x), 20)) | {9020, 9040}


def test_scan_is_near_the_products():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 30))
    quantiser = mips.Quantiser(x[:2000])
    assert quantiser.encode(x).shape == (3000, 8)
    error = quantiser.scan(x[:20], quantiser.encode(x)) - x[:20] @ x.T
    assert error.std() < 0.4 * (x[:20] @ x.T).std()


def test_vectors_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neardup.near_duplicates(none).count() == 0 and mips.search(none).count() == 0


def test_different_vectors_of_one_id(spark):
    """Counts and components belong to vectors, not to names."""
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [1.0, 0.02, 0.0]), (4, [1.0, 0.0, 0.01]), (5, [1.0, 0.0, 0.02]), (7, [0.0, 0.0, 1.0]), (7, [0.0, 0.01, 1.0]), (6, [0.0, 1.0, 0.01])]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found.collect())
    assert got == [(1, 1, 1), (1, 4, 1), (2, 4, 1), (3, 4, 1), (4, 4, 1), (5, 4, 1), (6, 1, 1), (7, 1, 7), (7, 1, 7)]
