"""Goldens on small corpora, properties, file formats and parsers."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import analysis as an
from quarry.functions.stem import stems
from quarry.operators import plsa, search, thesaurus
from quarry.plans.index import Index, build
from quarry.sources import corpus as src

H1 = [(1, "phone call", "phone call phone", "high court"), (2, "bank fraud", "call bank", "high court"), (3, "phone", "bank call phone fraud", "crown court"), (4, "fraud", "fraud fraud call", "crown court")]


@pytest.fixture(scope="module")
def h1(spark):
    rows = spark.createDataFrame(H1, "document_id long, title string, content string, court string")
    index = build(rows, an.WS)
    return Index(index.postings.cache(), index.dictionary.cache(), index.stats)


def hits(df):
    return [(r["doc_id"], r["score"]) for r in sorted(df.collect(), key=lambda r: r["rank"])]


@pytest.mark.parametrize(
    "text, want",
    [
        ("phone", [(1, 2.981247), (3, 2.772589)]),
        ("phone bank", [(2, 4.852030), (3, 3.465736), (1, 2.981247)]),
        ("Phone phone", [(1, 5.962494), (3, 5.545177)]),
        ("zzz", []),
        ('"phone"', []),
    ],
)
def test_free_text(spark, h1, text, want):
    assert hits(search.free_text(spark, h1, [(0, text)], an.WS)) == want


@pytest.mark.parametrize("text, want", [("bank AND fraud", [(2, 2.079442)]), ("phone call AND fraud", []), ("bank call phone AND crown", [(3, 3.465736)]), ("zzz AND bank", []), ("phone", [])])
def test_boolean(spark, h1, text, want):
    assert hits(search.boolean(spark, h1, [(0, text)], an.WS)) == want


@pytest.mark.parametrize("text", ["a b c d AND x", "AND x", "x AND"])
def test_boolean_items_of_wrong_size(spark, h1, text):
    with pytest.raises(search.InvalidQuery, match="invalid item"):
        search.boolean(spark, h1, [(0, text)], an.WS)


def test_boolean_does_not_depend_on_order(spark, h1):
    a = search.boolean(spark, h1, [(0, "bank AND fraud")], an.WS)
    b = search.boolean(spark, h1, [(0, "fraud AND bank")], an.WS)
    assert hits(a) == hits(b)


def test_dispatch():
    assert search.is_boolean("ANDERSON", as_coded=True) and not search.is_boolean("ANDERSON")
    assert search.is_boolean("a AND b")


def test_as_coded(spark, h1):
    assert hits(search.free_text(spark, h1, [(0, "phone")], an.WS, as_coded=True)) == [(3, 2.772589), (1, 2.981247)]
    assert hits(search.boolean(spark, h1, [(0, "bank AND fraud")], an.WS, as_coded=True)) == []


def test_feedback_is_a_permutation(spark, h1):
    found = search.search(spark, h1, "phone", (3, 99), an.WS)
    assert [d for d, _ in hits(found)] == [3, 1]


def test_duplicate_ids_are_one_document(spark):
    rows = spark.createDataFrame([(1, "t", "a b", "c"), (1, "t", "a", "c"), (2, None, None, None)], "document_id long, title string, content string, court string")
    index = build(rows, an.WS)
    assert index.stats.first()["n_docs"] == 2
    assert [r["doc_id"] for r in index.postings.where("term = 'a' AND zone = 'body'").collect()] == [1]


def test_save_and_load_prune(spark, h1, tmp_path):
    h1.save(str(tmp_path))
    again = Index.load(spark, str(tmp_path))
    found = again.lookup(["phone"])
    assert found.count() == h1.lookup(["phone"]).count() > 0
    assert "In(term" in found._jdf.queryExecution().toString() or "EqualTo(term" in found._jdf.queryExecution().toString()
    again.dump_vocabulary(str(tmp_path / "words"))
    words = {r["value"] for r in spark.read.text(str(tmp_path / "words")).collect()}
    assert {"phone", "title#phone", "court#high", "phone call"} <= words


PAIRS = """caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ angulariti angular effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll dying die news news enjoy enjoy crying cri geology geolog by by""".split()


def test_published_stems(spark):
    rows = spark.createDataFrame(list(zip(PAIRS[::2], PAIRS[1::2])), "term string, want string")
    assert stems(rows).where("stem <> want").collect() == []


def test_treebank(spark):
    text = "I can't; they're gonna well-known (42) café42, end."
    row = spark.createDataFrame([(text,)], "t string").select(an.treebank_words(F.col("t")).alias("w"), an.letters_only(an.treebank_words(F.col("t"))).alias("l")).first()
    assert row["w"] == ["I", "ca", "n't", ";", "they", "'re", "gon", "na", "well-known", "(", "42", ")", "café42", ",", "end", "."]
    assert row["l"] == ["I", "ca", "nt", "they", "re", "gon", "na", "wellknown", "café", "end"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("'Tis more'n I'd say", ["'T", "is", "more", "'n", "I", "'d", "say"]),
        ("the dogs' bark", ["the", "dogs", "'", "bark"]),
        ("'twas here, d'ye see", ["'t", "was", "here", ",", "d", "'ye", "see"]),
        ("it's a judge's 'view'", ["it", "'s", "a", "judge", "'s", "'view", "'"]),
        ("more'now 'tissue", ["more'now", "'tissue"]),
    ],
)
def test_treebank_apostrophes(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(an.treebank_words(F.col("t")).alias("w")).first()["w"] == want


def test_analyzers_and_bigrams(spark):
    df = spark.createDataFrame([("The cat, of the hill 7 !",)], "t string")
    row = df.select(an.WS_STOP.tokens(F.col("t")).alias("a"), an.bigrams(an.WS_STOP.tokens(F.col("t"))).alias("b"), an.without_punctuation(an.words(F.col("t"))).alias("p"), an.not_in_punctuation(an.words(F.col("t"))).alias("s")).first()
    assert row["a"] == ["cat", "hill"] and row["b"] == ["cat hill"]
    assert row["p"] == ["The", "of", "the", "hill", "7"] and row["s"][-1] == "7"
    assert df.select(an.bigrams(F.array(F.lit("one"))).alias("b")).first()["b"] == []


def test_csv_corpus(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('"document_id","title","content","date_posted","court"\n"2","T ""q""","line one\nline two","2001-02-03 00:00:00","HC"\n"1","A","b","x","CC"\n', encoding="utf-8")
    rows = src.read_csv(spark, str(path)).orderBy("document_id").collect()
    assert [(r["document_id"], r["title"], r["content"]) for r in rows] == [(1, "A", "b"), (2, 'T "q"', "line one\nline two")]
    assert [r["document_id"] for r in src.read_csv(spark, str(path), 1).collect()] == [1]


def test_query_file_and_result_line(spark, h1, tmp_path):
    path = tmp_path / "q.txt"
    path.write_text("phone bank\n3\n1\n")
    query = src.read_query(spark, str(path))
    assert query == src.QuerySpec("phone bank", (3, 1))
    src.write_result(search.search(spark, h1, query.text, query.relevant, an.WS), str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["3 1 2"]
    src.write_result(search.search(spark, h1, "zzz", (), an.WS), str(tmp_path / "none"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "none")).collect()] == [""]
    (tmp_path / "empty.txt").write_text("")
    with pytest.raises(ValueError):
        src.read_query(spark, str(tmp_path / "empty.txt"))


def test_thesaurus_text(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("FOREIGN PHRASES\nrun, v, hurry up, racing\nalone\nrun, v, walk\nend, n, stop it now, halt\n")
    lines = src.read_thesaurus_lines(spark, str(path))
    head = {r["term"]: r["synonyms"] for r in thesaurus.build(lines).collect()}
    assert head == {"run": ["walk"], "end": ["halt"]}
    both = {r["term"]: r["synonyms"] for r in thesaurus.build(lines, "symmetric").collect()}
    assert both["run"] == ["hurry up", "race"] and both["walk"] == ["run"]
    path.write_text("state of mind, n, The, mood\nthe, n, article\n")
    lines = src.read_thesaurus_lines(spark, str(path))
    assert {r["term"]: r["synonyms"] for r in thesaurus.build(lines, stem=False).collect()} == {"state of mind": ["mood"], "the": ["article"]}
    assert {r["term"]: r["synonyms"] for r in thesaurus.build(lines, "symmetric", stem=False).collect()} == {"mood": [], "article": []}


def test_topics_stop_by_comparing_rounds(spark):
    x = spark.createDataFrame([(d, f"w{(d * 3 + i) % 7}", 1.0 + i) for d in range(5) for i in range(4)], "doc_id long, term string, x double")
    for stop in ("gain", "change"):
        # any difference is below this tolerance: the start and two rounds are seen, as round 2 is the first to be compared
        assert len(plsa.PLSA(2, 15, 1e9, stop).fit(x)[2]) == 3
    seen = plsa.PLSA(2, 15, 0.05, "gain").fit(x)[2]
    assert len(seen) == 15 or seen[-1] - seen[-2] < 0.05 and all(b - a >= 0.05 for a, b in zip(seen[1:-1], seen[2:-1]))


def test_topics(spark):
    x = spark.createDataFrame([(d, f"w{d}{i}", 1.0) for d in range(3) for i in range(4)], "doc_id long, term string, x double")
    lam, theta, seen = plsa.PLSA(2, 15, 1e-9, "change").fit(x)
    assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:]))
    assert all(abs(r["l0"] + r["l1"] - 1) < 1e-9 for r in lam.collect())
    total = theta.agg(F.sum("t0").alias("a"), F.sum("t1").alias("b")).first()
    assert abs(total["a"] - 1) < 1e-9 and abs(total["b"] - 1) < 1e-9
    p = plsa.e_step(x, *plsa.init(x, 2), 2).collect()
    assert all(abs(r["p0"] + r["p1"] - 1) < 1e-12 for r in p)
    assert plsa.nearest(lam, plsa.fold_in(theta, ["w00", "w01"], 2), 2, 1).first()["rank"] == 1


def test_entry_and_registration(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "rank", "doc_id", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"corpus_stats", "freetext_multi", "bool_trigram", "plsa_loglik"} <= set(e.queries())


def test_command_line(spark, tmp_path):
    from quarry.cli import main

    (tmp_path / "c.csv").write_text("document_id,title,content,date_posted,court\n" + "".join(f'{d},"{t}","{c}",,"{k}"\n' for d, t, c, k in H1))
    (tmp_path / "q.txt").write_text("phone\n3\n")
    main(["index", "-i", str(tmp_path / "c.csv"), "-o", str(tmp_path / "i")], spark)
    main(["search", "-d", str(tmp_path / "i"), "-q", str(tmp_path / "q.txt"), "-o", str(tmp_path / "o")], spark)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "o")).collect()] == ["3 1"]
    (tmp_path / "t.txt").write_text("phone, n, bank\nalone\n")
    main(["thesaurus", "-i", str(tmp_path / "t.txt"), "-o", str(tmp_path / "t")], spark)
    assert [tuple(r) for r in thesaurus.load(spark, str(tmp_path / "t")).collect()] == [("phone", ["bank"])]
    (tmp_path / "q2.txt").write_text("phone\n")
    for option, at in (("--thesaurus", "t.txt"), ("--stored-thesaurus", "t")):
        main(["search", "-d", str(tmp_path / "i"), "-q", str(tmp_path / "q2.txt"), "-o", str(tmp_path / "o2"), option, str(tmp_path / at)], spark)
        assert set(spark.read.text(str(tmp_path / "o2")).first()["value"].split()) == {"1", "2", "3"}
    main(["vocabulary", "-d", str(tmp_path / "i"), "-o", str(tmp_path / "v")], spark)
    main(["plsa", "-d", str(tmp_path / "i"), "-o", str(tmp_path / "p"), "-k", "2", "--max-iter", "2"], spark)
    assert spark.read.parquet(str(tmp_path / "p" / "top_words")).count() > 0


def test_stems_of_lists_keep_frequent_words_and_hold_parts(monkeypatch):
    import pyarrow as pa

    from quarry.functions import stem

    monkeypatch.setattr(stem, "KEPT", 2)
    monkeypatch.setattr(stem, "PART", 3)
    monkeypatch.setattr(stem, "_known", {})
    lists = [["running", "flies"], [], ["Running", "cats", "cats"], ["ponies"], ["flies"]]
    assert stem._stem_lists(pa.array(lists)).to_pylist() == [[stem.stem_word(w) for w in words] for words in lists]
    assert stem._known == {"running": "run", "flies": "fli"}  # never cleared, never more
    assert stem._stem_lists(pa.array([], pa.list_(pa.string()))).to_pylist() == []
