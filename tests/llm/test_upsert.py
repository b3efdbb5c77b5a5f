"""Copy-on-write upsert against a plain version in Python."""

import bisect
import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import ranged, upsert

CLIENTS = "client_id long, file string, source string, name string, city string, segment string, pos int, balance double"
CHANGES = "change_id long, client_id long, seq long, op string, source string, segment string, city string, balance double, file string"


def crc(x):
    return zlib.crc32(str(x).encode())


def plain(clients, changes):
    """The contract, row by row."""
    per_file = 1 + len(clients) // 1000
    base = sorted((r for r in clients if r["client_id"] is not None and crc(r["client_id"]) % 7 > 3), key=lambda r: r["client_id"])
    files = [base[i : i + per_file] for i in range(0, len(base), per_file)]
    firsts, won, homes = [f[0]["client_id"] for f in files], {}, {}
    for c in changes:
        key = tuple(-1 if c[k] is None else c[k] for k in ("seq", "change_id"))
        if c["client_id"] is not None and (c["client_id"] not in won or key > won[c["client_id"]][0]):
            won[c["client_id"]] = key, c
    for i, (_, c) in won.items():
        homes.setdefault(max(0, bisect.bisect_right(firsts, i) - 1), []).append(c)
    out = []
    for i, f in enumerate(files):
        h, new = crc(firsts[i]) % 16, {r["client_id"]: r for r in f}
        for c in homes.get(i, []) if h <= 7 else []:
            if c["op"] == "D" or c["change_id"] is not None and crc(c["change_id"]) % 8 < h:
                new.pop(c["client_id"], None)
            else:
                row = dict(new.get(c["client_id"]) or dict.fromkeys(f[0]), client_id=c["client_id"])
                new[c["client_id"]] = row | {k: c[k] for k in ("source", "segment", "city", "balance")}
        new = [new[k] for k in sorted(new)]
        n = -(-len(new) // per_file)
        if new == f:
            out.append((False, f))
        elif new:
            small, more = divmod(len(new), n)
            at = 0
            for j in range(n):
                out.append((True, new[at : at + small + (j < more)]))
                at += small + (j < more)
    joined = []
    for w, f in out:
        if w and joined and joined[-1][0] and len(joined[-1][1]) + len(f) <= per_file:
            joined[-1] = True, joined[-1][1] + f
        else:
            joined.append((w, f))
    cents = lambda x: 0 if x is None else math.floor(100 * x + 0.5)
    return [
        (f[0]["client_id"], len(f), sum(cents(r["balance"]) for r in f), sum(crc("|".join(r[k] or "" for k in ("source", "segment", "city"))) for r in f), hashlib.sha256(",".join(str(r["client_id"]) for r in f).encode()).hexdigest(), w)
        for w, f in joined
    ]


def compare(spark, clients, changes):
    found = upsert.upsert_clients(spark, clients, changes).orderBy("first_id").collect()
    want = plain([r.asDict() for r in clients.collect()], [r.asDict() for r in changes.collect()])
    assert [(r["first_id"], r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"], r["rewritten"]) for r in found] == want
    return found


def test_given_tables(spark):
    found = compare(spark, *(spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("clients", "client_changes")))
    folder = found[0]["path"].rsplit("/", 1)[0]
    files = spark.read.parquet(folder)
    assert files.select("_metadata.file_path").distinct().count() == len(found)
    assert {r["columns"] for r in found} == {",".join(files.columns)} == {"client_id,master_id,source,updated_at,name,email,city,nation_id,segment,balance"}


@pytest.mark.parametrize("n, seed", [(2100, 1), (3500, 2)])
def test_nulls_repeats_inserts_and_clashing_names(spark, n, seed):
    import random

    rnd = random.Random(seed)
    word = lambda: rnd.choice([None, "", "a", "b|c"])
    money = lambda: rnd.choice([None, 0.0, -1.005, 2.675, 10.0])
    clients = [(3 * i, "f", word(), "n", word(), word(), i, money()) for i in range(n)] + [(None, "f", "s", "n", "c", "g", 0, 1.0)]
    changes = [(k, rnd.choice([None, 7, rnd.randrange(-50, 3 * n), rnd.randrange(3 * n, 4 * n)]), rnd.choice([None, 1, 2, 3]), rnd.choice("DUUUI"), word(), word(), word(), money(), "x") for k in range(n)]
    compare(spark, spark.createDataFrame(clients, CLIENTS), spark.createDataFrame(changes + changes[:50], CHANGES))


def test_all_of_a_home_goes_and_hot_home_splits(spark):
    """Deletes empty files, so others become neighbours; a third of all rows are inserts of one home."""
    clients = spark.createDataFrame([(i, "f", "s", "n", "c", "g", i, 1.0) for i in range(2000)], CLIENTS)
    last = [(i, i, 1, "I", "t", "u", "v", 2.0, "x") for i in range(5000, 7000)]
    gone = [(i, i, 1, "D" if i % 5 else "U", "s", "g", "c", 1.0, "x") for i in range(2000)]
    compare(spark, clients, spark.createDataFrame(last + gone, CHANGES))


def test_empty_tables(spark):
    clients = spark.createDataFrame([(i, "f", "s", "n", "c", "g", i, 1.0) for i in range(40)], CLIENTS)
    changes = spark.createDataFrame([(1, 1, 1, "U", "a", "b", "c", 1.0, "x")], CHANGES)
    assert upsert.upsert_clients(spark, clients.limit(0), changes).collect() == []
    assert not any(r["rewritten"] for r in compare(spark, clients, changes.limit(0)))


def test_untouched_files_keep_their_bytes(spark):
    """A change that changes nothing rewrites nothing."""
    clients = spark.createDataFrame([(i, "f", "s", "n", "c", "g", i, 1.0) for i in range(1500)], CLIENTS)
    changes = spark.createDataFrame([(8 * i + 7, i, 1, "U", "s", "g", "c", 1.0, "x") for i in range(0, 1500, 2) if crc(i) % 7 > 3], CHANGES)
    compare(spark, clients, changes)


def test_numbers_and_carries_cross_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.when(F.col("id") * 7 % 1000 % 97 == 50, F.col("id") * 7 % 1000).alias("v"))
    assert all(r["pos"] == r["k"] for r in ranged.numbered(rows, "k").collect())
    for r in ranged.carried(rows, "v", "k").collect():
        assert r["v"] == (None if r["k"] < 50 else r["k"] - (r["k"] - 50) % 97)
