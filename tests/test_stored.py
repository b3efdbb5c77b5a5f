"""Block postings, tables of queries, ranks, split CSV, sinks, sentences, block EM."""

import csv
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.functions import analysis as an
from quarry.functions import sentences
from quarry.operators import plsa, search
from quarry.plans import checkpoints
from quarry.plans.index import Index, build, first_seen, pack
from quarry.plans.ranges import numbered, ranks
from quarry.sources import corpus as src
from quarry.sources import quoted


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """900 documents in blocks of 16 ids: `all` everywhere, `far`, `near` and `late` in some."""
    rnd = random.Random(4)
    rows = []
    for i in range(900):
        words = ["all"] * rnd.randrange(1, 4) + ["far"] * (i < 200) + ["near"] * (150 <= i < 260) + ["late"] * (i >= 800) + ["rich"] * (40 if i in (5, 300, 301, 777) else i % 50 == 0)
        rows.append((i, "t", " ".join(words), "c"))
    path = str(tmp_path_factory.mktemp("index"))
    made = build(spark.createDataFrame(rows, "document_id long, title string, content string, court string"), an.WS, checkpoint=True)
    made.save(path, width=16)
    return made, Index.load(spark, path)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "doc_id", "score").collect())


def test_blocks_hold_all_postings(stored):
    made, index = stored
    assert sorted(map(tuple, index.postings.collect())) == sorted(map(tuple, made.postings.collect()))
    assert index.stored.where("n <> size(ids) OR first <> ids[0] OR last <> ids[n - 1] OR top <> array_max(weights) OR last - first >= 16").count() == 0
    assert sorted(map(tuple, index.dictionary.collect())) == sorted(map(tuple, made.dictionary.collect()))


def test_postings_are_in_order_within_files(stored):
    _, index = stored
    rows = index.stored.select("_metadata.file_path", "_metadata.row_index", "zone", "kind", "term", "first", "ids").orderBy("file_path", "row_index").collect()
    assert all((a["zone"], a["kind"], a["term"], a["first"]) < (b["zone"], b["kind"], b["term"], b["first"]) for a, b in zip(rows, rows[1:]) if a["file_path"] == b["file_path"])
    assert all(r["ids"] == sorted(set(r["ids"])) for r in rows)


def test_a_frequent_term_is_dealt_to_several_parts(spark):
    rows = spark.range(20_000).select(F.lit("body").alias("zone"), F.lit("uni").alias("kind"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("w"), F.col("id"))).alias("term"), F.col("id").alias("doc_id"), F.lit(1.0).cast("float").alias("wtf"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts stay apart
    try:
        assert pack(rows).select("term", F.spark_partition_id().alias("p")).where("term = 'hot'").select("p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def conjunct(spark, *terms):
    rows = spark.createDataFrame([(0, "body", "uni", t, c, 1.0) for c, t in enumerate(terms)], "query_id long, zone string, kind string, term string, clause_id long, w double")
    return rows, rows.groupBy("query_id").agg(F.count_distinct("clause_id").alias("need"))


def test_a_conjunction_opens_overlapping_blocks_alone(spark, stored):
    made, index = stored
    rows, need = conjunct(spark, "all", "far", "near")
    chosen = search.overlapping(index, rows, need)
    assert sorted(r["block"] for r in chosen.collect()) == [9, 10, 11, 12]  # ids 150 to 199, of 57 blocks
    assert index.stored.where("term = 'all' AND zone = 'body'").count() == 57
    found = search.conjunction(index, rows, need)
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(150, 200))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, search.conjunction(made, rows, need).collect()))
    assert search.overlapping(index, *conjunct(spark, "far", "late")).count() == 0


@pytest.mark.parametrize("k", [1, 10, 2000])
def test_top_k_is_the_head_of_the_full_ranking(spark, stored, k):
    made, index = stored
    texts = [(0, "rich all"), (1, "far near"), (2, "late"), (3, "none"), (4, "all")]
    full = [r for r in rows_of(search.free_text(spark, made, texts, an.WS)) if r[1] <= k]
    assert rows_of(search.free_text(spark, index, texts, an.WS, limit=k)) == full


def test_top_k_skips_blocks(spark, stored):
    _, index = stored
    terms = search.weighted(index, search.free_text_terms(spark, [(0, "rich all")], an.WS, zones=False))
    scores, rest = search.top_blocks(index, terms, 3)
    assert search.bounds(index, terms).count() == 57
    assert scores.count() <= 3 * 16 and rest.count() <= 10  # at most 13 of 57 blocks are opened


def scanned(df):
    """(rows, rows that leave the scan) of a query that runs."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves, n = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numOutputRows")
        n += metric.get().value() if metric.isDefined() else 0
    return len(rows), n


def test_a_lookup_of_an_unknown_term_reads_no_rows(spark, stored):
    _, index = stored
    assert scanned(index.stored.where(F.col("term").isin(["zzzz"])).select("ids")) == (0, 0)
    assert scanned(index.stored.where(F.col("term").isin(["farz"])).select("ids")) == (0, 0)  # between the least and the greatest term: the Bloom filter
    found, read = scanned(index.stored.where(F.col("term").isin(["late"])).select("ids"))
    assert 0 < found <= read


def test_tables_of_queries(spark, stored):
    made, index = stored
    queries = spark.createDataFrame(
        [(1, "far near", None), (2, "a b c d AND x", [1]), (3, "far AND near", [170, 9999]), (4, "AND", None), (5, None, None), (6, "", []), (7, "late", [850]), (8, "zzz AND far", None), (9, "far", None)], "query_id long, text string, relevant array<long>"
    )
    found = search.answer(spark, index, queries, an.WS).collect()
    assert {r["query_id"]: r["error"] for r in found if r["error"]} == {2: search.ERROR, 4: search.ERROR}
    assert {r["query_id"] for r in found if not r["error"]} == {1, 3, 7, 9}
    ranked = {q: [r["doc_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] for q in (1, 3, 7, 9)}
    assert ranked[3][0] == 170 and sorted(ranked[3]) == list(range(150, 200)) and ranked[7][0] == 850
    for q, text in ((1, "far near"), (9, "far")):
        assert ranked[q] == [r[2] for r in rows_of(search.free_text(spark, made, [(q, text)], an.WS))]
    first = search.answer(spark, index, queries, an.WS, limit=2).where("error IS NULL").collect()
    assert sorted((r["query_id"], r["doc_id"]) for r in first) == sorted((q, d) for q in ranked for d in ranked[q][:2])
    assert search.answer(spark, index, queries.limit(0), an.WS).collect() == []


def test_search_collects_no_queries():
    import inspect

    assert ".collect()" not in inspect.getsource(search)


def test_shuffled_terms_give_the_same(spark, stored, monkeypatch):
    _, index = stored
    texts = [(i, t) for i, t in enumerate(["rich all", "far near", "late"])]
    want = rows_of(search.free_text(spark, index, texts, an.WS))
    monkeypatch.setattr(search, "SMALL", 0)
    monkeypatch.setattr("quarry.plans.index.FEW", 0)
    assert rows_of(search.free_text(spark, index, texts, an.WS)) == want


def test_a_batch_reads_blocks_once_and_shuffles_no_hits(spark, stored, monkeypatch):
    _, index = stored
    queries = [(i, t) for i, t in enumerate(["rich all", "far near", "late", "none", "far AND near", "all AND late", "far AND late", "rich AND all late"])]
    want = [search.answer(spark, index, search.query_table(spark, queries), an.WS, limit=k).collect() for k in (1, 7, 2000)]
    monkeypatch.setattr(search, "BATCH", 0)
    monkeypatch.setattr(search, "RANGES", 100)
    assert [sorted(map(str, search.answer(spark, index, search.query_table(spark, queries), an.WS, limit=k).collect())) for k in (1, 7, 2000)] == [sorted(map(str, w)) for w in want]
    terms = search.weighted(index, search.free_text_terms(spark, queries[:4], an.WS), True).localCheckpoint()
    sums = search._sums(search.dealt(index, terms))
    sums.collect()
    assert sums._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1  # of blocks, as stored


def test_ranks_and_numbers(spark):
    rows = spark.range(5000).select((F.col("id") % 3 == 0).cast("long").alias("g"), (F.col("id") * 37 % 5000).alias("v"))
    assert all(r["pos"] == r["v"] for r in numbered(rows, "v").collect())
    want = {g: sorted(r["v"] for r in rows.where(F.col("g") == g).collect()) for g in (0, 1)}
    assert all(want[r["g"]][r["rank"] - 1] == r["v"] for r in ranks(rows, "g", "v").collect())
    assert numbered(rows.limit(0), "v").collect() == []


def test_first_seen_stems(spark):
    rows = spark.createDataFrame([(2, "", "running cats", ""), (1, "", "a cat ran", ""), (3, "", "runs a", "")], "document_id long, title string, content string, court string")
    found = sorted(first_seen(rows, an.Analyzer("ws", "letters", (), True)).collect(), key=lambda r: r["term_id"])
    assert [(r["term"], r["doc_id"], r["pos"], r["term_id"]) for r in found] == [("a", 1, 0, 1), ("cat", 1, 1, 2), ("ran", 1, 2, 3), ("run", 2, 0, 4)]


@pytest.mark.parametrize("size", [512, 257, 1 << 20])
def test_one_csv_file_in_parts(spark, tmp_path, size):
    """Line ends, doubled quotes and blank lines inside and across byte ranges."""
    rnd = random.Random(size)
    piece = lambda: "".join(rnd.choice(["a", "é", '"', "\n", "\n\n", "\r\n", ",", '""', " ", "x" * 30]) for _ in range(rnd.randrange(12)))
    rows = [(i, piece(), piece(), "2001-02-03 00:00:00", "HC") for i in range(60)]
    path = tmp_path / "c.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\r\n" if size == 257 else "\n")
        out.writerow(["document_id", "title", "content", "date_posted", "court"])
        out.writerows(rows[:30])
        f.write("\n\n")
        out.writerows(rows[30:])
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        assert size > 1000 or quoted.text_lines(spark, str(path)).rdd.getNumPartitions() > 5
        got = sorted(map(tuple, src.read_csv(spark, str(path)).select("document_id", "title", "content", "court").collect()))
        assert got == [(i, t or None, c or None, k) for i, t, c, _, k in rows]
        plain = duckdb.sql(f"SELECT document_id, title, content, court FROM read_csv('{path}', header = true, quote = '\"', escape = '\"', all_varchar = true, parallel = false, null_padding = false, strict_mode = false)").fetchall() if size != 257 else None
        assert plain is None or sorted((int(i), t or None, c or None, k) for i, t, c, k in plain) == got
        assert [r["document_id"] for r in src.read_csv(spark, str(path), first=3).collect()] == [0, 1, 2]
        assert src.read_csv(spark, str(path), header=False, first=2).count() == 2
        assert src.read_csv(spark, str(path), header=False).where("document_id IS NULL").first()["title"] == "title"
        raw = open(path, newline="", encoding="utf-8").read().split("\n")
        assert [(r["line"], r["value"]) for r in src.slice_lines(spark, str(path), 5, 30).orderBy("line").collect()] == [(i, raw[i]) for i in range(5, 31)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_several_csv_files_and_an_empty_one(spark, tmp_path):
    for name, ids in (("a", (3, 1)), ("b", (2,)), ("c", ())):
        (tmp_path / f"{name}.csv").write_text("document_id,content\n" + "".join(f"{i},x\n" for i in ids) if ids else "")
    assert [r["document_id"] for r in src.read_csv(spark, str(tmp_path), first=3).collect()] == [3, 1, 2]


def test_sample_csv_is_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(3, "x"), (1, 'say "a,b"\nc'), (2, None)], "document_id long, title string")
    src.write_sample_csv(rows, "document_id", str(tmp_path / "s"), 2)
    assert sorted(map(tuple, src.read_csv(spark, str(tmp_path / "s")).collect())) == [(1, 'say "a,b"\nc'), (2, None)]


def test_long_result_lines_stream(spark, tmp_path):
    n = 300_000
    hits = spark.range(n).select(F.lit(1).cast("long").alias("query_id"), (n - F.col("id")).alias("rank"), F.col("id").alias("doc_id"))
    more = spark.createDataFrame([(0, 1, 7), (0, 2, 5), (2, 1, 9)], "query_id long, rank long, doc_id long")
    src.write_result(hits.union(more), str(tmp_path / "out"))
    files = [p for p in (tmp_path / "out").iterdir() if p.suffix == ".txt"]
    lines = files[0].read_text().split("\n")
    assert len(files) == 1 and lines[0] == "7 5" and lines[2:] == ["9", ""]
    assert lines[1] == " ".join(str(i) for i in range(n - 1, -1, -1))


def test_abbreviations_are_learned(spark):
    rnd = random.Random(1)
    texts = []
    for _ in range(300):
        texts.append(f"Then Mr. {rnd.choice(['Smith', 'Jones', 'Doe'])} sued in Roe v. Wade. The court {rnd.choice(['held', 'sat'])}. It was a judgment. The law held and sat with Wade, by judgment today.")
    counts = sentences.word_counts(F.col("text"), spark.createDataFrame([(t,) for t in texts], "text string"))
    known = sentences.abbreviations(sentences.abbreviation_scores(counts))
    assert {"mr", "v"} <= set(known) and not {"wade", "judgment", "held", "court", "law"} & set(known)
    analyzer = an.Analyzer("treebank", "punct_drop", (), False, known)
    row = spark.createDataFrame([("Mr. Smith v. Jones, in the U.S. law. J. R. Doe ended (the v. case). No vs. here.",)], "t string")
    assert row.select(an.treebank_words(F.col("t"), known).alias("w")).first()["w"] == "Mr. Smith v. Jones , in the U.S. law . J. R. Doe ended ( the v. case ) . No vs . here .".split()
    assert row.select(analyzer.tokens(F.col("t")).alias("w")).first()["w"] == "smith jones in the law doe ended the case no vs here".split()
    assert row.select(an.treebank_words(F.col("t")).alias("w")).first()["w"][:2] == ["Mr", "."]


def test_block_passes_equal_the_relational_step(spark, monkeypatch):
    rnd = random.Random(2)
    x = spark.createDataFrame([(d, f"w{t}", 1.0 + rnd.random()) for d in range(60) for t in rnd.sample(range(80), 12)], "doc_id long, term string, x double").cache()
    lam, theta = plsa.init(x, 3)
    want = []
    for _ in range(2):
        p = plsa.e_step(x, lam, theta, 3)
        want.append(plsa.log_likelihood(p).first()["loglik"])
        lam, theta = (checkpoints.checkpointed(d) for d in plsa.m_step(p, 3))
    near = lambda a, b: all(r[0] == s[0] and all(math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-15) for u, v in zip(r[1:], s[1:])) for r, s in zip(sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect())), strict=True))
    for docs, terms, broadcast in ((4096, 32768, 1 << 25), (16, 32, 0)):  # one block; many, joined by range
        monkeypatch.setattr(plsa, "DOCS", docs)
        monkeypatch.setattr(plsa, "TERMS", terms)
        monkeypatch.setattr(plsa, "BROADCAST", broadcast)
        monkeypatch.setattr(plsa, "HELD", 200 if broadcast == 0 else 1 << 23)
        monkeypatch.setattr(plsa, "ENTRIES", 7 if broadcast == 0 else 1 << 18)
        got = plsa.rounds(x, 3, 2)
        assert near(got[0], lam) and near(got[1], theta)
        assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(plsa.likelihoods(x, 3, 1), want))


def test_a_round_is_one_shuffle(spark):
    x = spark.createDataFrame([(d, f"w{(d * 3 + i) % 7}", 1.0 + i) for d in range(5) for i in range(4)], "doc_id long, term string, x double")
    blocks = plsa.Blocks.of(x, 2)
    sums = plsa._packed(blocks.sums(blocks.start()), blocks._values)
    sums.collect()
    assert sums._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange ") == 1


def test_rows_are_joined_with_their_own_terms_alone(spark, monkeypatch):
    for name, value in (("ENTRIES", 8), ("DOCS", 4), ("BROADCAST", 0)):
        monkeypatch.setattr(plsa, name, value)
    x = spark.createDataFrame([(d, f"w{d}x{i}", 1.0) for d in range(40) for i in range(3)], "doc_id long, term string, x double")
    blocks = plsa.Blocks.of(x, 2)
    joined, _ = blocks._parameters(blocks.start())
    assert joined.count() > 8 and joined.agg(F.sum(F.size("t"))).first()[0] == 120 * 3  # an entry's share of each topic and number
    assert sorted(r["doc_id"] for r in blocks.docs.collect()) == list(range(40))


def test_terms_are_counted_where_their_text_lies(spark):
    docs = [(1, "b a", "b a b", "x"), (2, "", None, None), (3, "c", "a", "y")]
    corpus = spark.createDataFrame(docs, "document_id long, title string, content string, court string")
    made = build(corpus, an.WS)
    assert "Exchange" not in made.postings._jdf.queryExecution().executedPlan().toString() and made.together
    got = {(r["zone"], r["kind"], r["term"], r["doc_id"]): round(10 ** (r["wtf"] - 1)) for r in made.postings.collect()}
    assert len(got) == made.postings.count() == 10 and got["body", "uni", "b", 1] == 2 and got["body", "bi", "a b", 1] == 1
    twice = build(corpus.union(corpus), an.WS)  # rows of one id are one document
    got = {k: 2 * n for k, n in got.items()}
    assert not twice.together and got == {(r["zone"], r["kind"], r["term"], r["doc_id"]): round(10 ** (r["wtf"] - 1)) for r in twice.postings.collect()}


def test_storing_an_index_shuffles_texts_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quarry.plans.index.RUN", 60)
    monkeypatch.setattr("quarry.plans.index.SEGMENT", 100)
    rnd = random.Random(5)
    word = lambda: rnd.choice(["b", "a", "a\u00e9", "\u4e2d", "ab", "!", "x-y", "\x01", "B"])
    docs = [(i * 3 - 50, word(), " ".join(word() for _ in range(rnd.randrange(20))) if i % 9 else None, "c") for i in range(80)]
    corpus = spark.createDataFrame(docs, "document_id long, title string, content string, court string")
    for analyzer in (an.WS, an.CANONICAL, an.Analyzer("ws", "punct_substring", (), False)):
        made = build(corpus, analyzer)
        plan = made.segments(16)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and plan.index("Exchange ") > plan.index("MapInArrow")
        made.save(str(tmp_path / "s"), width=16)
        got = Index.load(spark, str(tmp_path / "s"))
        assert sorted(map(tuple, got.postings.collect())) == sorted(map(tuple, made.postings.collect()))
        assert sorted(map(tuple, got.dictionary.collect())) == sorted(map(tuple, made.dictionary.collect()))
        assert got.stored.groupBy("zone", "kind", "term", "block").count().where("count > 1").count() == 0
    assert spark.read.parquet(str(tmp_path / "s" / "blocks")).where("n = 1").count() == 0  # such blocks have no lists
    build(corpus.limit(0), an.WS).save(str(tmp_path / "e"))
    assert Index.load(spark, str(tmp_path / "e")).dictionary.count() == 0
    build(corpus.union(corpus), an.WS).save(str(tmp_path / "r"), width=16)  # repeated ids
    assert Index.load(spark, str(tmp_path / "r")).dictionary.agg(F.max("df")).first()[0] == 80


def test_a_folder_of_query_files(spark, stored, tmp_path):
    from quarry.cli import main

    made, _ = stored
    made.save(str(tmp_path / "i"))
    (tmp_path / "q").mkdir()
    for name, text in (("a", "late\n850\nx\n"), ("b", "a b c d AND e\n"), ("c", "\n"), ("c0", ""), ("d", "far AND near\r\n")):
        (tmp_path / "q" / name).write_text(text, newline="")
    rows = src.read_queries(spark, str(tmp_path / "q")).orderBy("query_id").collect()
    assert [(r["query_id"], r["text"], r["relevant"]) for r in rows] == [(0, "late", [850]), (1, "a b c d AND e", []), (2, "", []), (3, "far AND near", [])]
    main(["answer", "-d", str(tmp_path / "i"), "-q", str(tmp_path / "q"), "-o", str(tmp_path / "o"), "--limit", "3"], spark)
    lines = [p for p in (tmp_path / "o" / "lines").iterdir() if p.suffix == ".txt"][0].read_text().split("\n")
    assert len(lines) == 3 and lines[0].startswith("850 ") and len(lines[1].split()) == 3
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "o" / "errors")).collect()] == [(1, search.ERROR)]


def test_records_are_parsed_in_bounded_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(quoted, "PART", 100)
    texts = [f'{i},"{"x" * (i * 7 % 60)}"' for i in range(50)] + [f'50,"{"y" * 500}"']
    b = pa.RecordBatch.from_arrays([pa.array(range(51)), pa.array(range(51)), pa.array(texts)], names=["no", "own", "text"])
    made = list(quoted._fields(iter([b])))
    assert all(m.num_rows == 1 or sum(len(f or "") for row in m.column(2).to_pylist() for f in row) <= 100 for m in made)
    assert [r for m in made for r in m.column(0).to_pylist()] == list(range(51))
    assert [f for m in made for f in m.column(2).to_pylist()] == [[f or None for f in next(csv.reader([t]))] for t in texts]


def test_the_topic_steps_analyse_texts_once(spark):
    from quarry.queries import QUERIES

    for name in ("plsa_e_step", "plsa_diagnostics"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" not in plan.lower() and "split(" not in plan.lower()  # texts are behind a table that is written


def test_stop_rules_share_matrix_and_rounds(spark, monkeypatch):
    from quarry.queries import QUERIES

    made = []
    of, one = plsa.Blocks.of.__func__, plsa.Blocks.round
    monkeypatch.setattr(plsa.Blocks, "of", classmethod(lambda cls, *a: made.append("matrix") or of(cls, *a)))
    monkeypatch.setattr(plsa.Blocks, "round", lambda self, state: made.append("round") or one(self, state))
    rows = QUERIES["plsa_stop_rules"](spark, "/root/testdata/sf0.001").collect()
    assert made == ["matrix", "round", "round", "round"] and [r["loglik"] for r in rows[:3]] == [r["loglik"] for r in rows[3:]]
    x = spark.createDataFrame([(d, f"w{(d * d + i) % 23}", 1.0 + i % 3) for d in range(40) for i in range(9)], "doc_id long, term string, x double").cache()
    rules = [plsa.PLSA(2, 12, 0.5, "gain"), plsa.PLSA(2, 4, 1e-9, "change"), plsa.PLSA(2, 12, 1e9, "change")]
    want = [rule.fit(x)[2] for rule in rules]
    got = plsa.seen_by(x, rules)
    assert [len(s) for s in got] == [len(s) for s in want] and len(got[1]) == 4 and len(got[2]) == 3
    assert all(math.isclose(a, b, rel_tol=1e-12) for s, t in zip(got, want) for a, b in zip(s, t))


def test_records_of_the_matrix_and_its_terms_are_bounded(spark, monkeypatch):
    for name, value in (("PIECE", 16), ("ENTRIES", 100), ("USES", 8), ("BROADCAST", 0)):
        monkeypatch.setattr(plsa, name, value, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    try:
        x = spark.createDataFrame([(d, f"w{(d * 5 + i * i) % 31}", 1.0 + d % 3) for d in range(50) for i in range(6)], "doc_id long, term string, x double").distinct()
        blocks = plsa.Blocks.of(x, 2)
        sizes = blocks.cells.agg(F.max(F.size("u")), F.sum(F.size("u")), F.count_distinct("row")).first()
        assert sizes[0] < 16 + 8 and sizes[1] == x.count() and sizes[2] < 12
        assert blocks.ranges.count() > 5 and [r[0] for r in blocks.ranges.orderBy("chunk").select(F.explode("terms")).collect()] == [r[0] for r in x.select("term").distinct().orderBy("term").collect()]
        state, _ = blocks.round(blocks.start())
        lam, theta = blocks.parameters(state)
        want = plsa.m_step(plsa.e_step(x, *plsa.init(x, 2), 2), 2)
        for a, b in zip((lam, theta), want):
            got, known = (sorted(map(tuple, t.collect())) for t in (a, b))
            assert len(got) == len(known) and all(g[0] == w[0] and math.isclose(g[1], w[1], rel_tol=1e-9) and math.isclose(g[2], w[2], rel_tol=1e-9) for g, w in zip(got, known))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_csv_survives_other_splits_and_empty_strings(spark, tmp_path):
    """A second reading may cut files elsewhere, as cores come and go."""
    from quarry.queries import QUERIES

    texts = [None, "", " ", "\n", "\r", "a\r", "a\r\nb", '"', '""', '"\n', '\n"\n"', "\\", 'a\\"b', "\0", "﻿", " ", "a,b", ",", "#c", "\t", "\x0b", "\n\n", "NULL"]
    rows = [(i, t, lang) for i, t in enumerate(texts) for lang in (None, "", "en", "\r", '"')]
    rows += [(1000 + i, f'line "{i}"\n\n' * 40, "en") for i in range(600)] + [(None, "x", "en"), (0, "twice", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    for query, columns in (("csv_corpus", ("doc_id", F.md5(F.encode("text", "UTF-8")), "lang")), ("sample_csv", ("doc_id", "text"))):
        got = QUERIES[query](spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        try:
            if query == "csv_corpus":
                assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, docs.select(*columns).collect()), key=repr)
            else:
                made = sorted(map(tuple, got.collect()), key=repr)
                assert len(made) == 10 and set(made) <= set(map(tuple, docs.select(*columns).collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
