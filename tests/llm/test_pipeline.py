"""The pipeline's stages on a small corpus, each against its own operator."""

from pyspark.sql import functions as F

from quarry.llm import language, quality, setjoin


def test_stages(spark, tmp_path):
    import corpus_pipeline

    good = "the of and to in that is was for on with as it at by from they have this had not are but"
    rows = []
    for i in range(120):
        words = good.split()
        words = [words[(i * 7 + j * (1 + i % 5)) % len(words)] + "abcdefghij"[(i + j) % 10] for j in range(40)]
        rows.append((i, " ".join(words) if i % 3 else " ".join(w.upper() + "!!" for w in words), "en", "s", 0))
    rows += [(200, rows[1][1], "en", "s", 0), (201, None, "en", "s", 0), (202, "", None, "s", 0), (203, "12 34 56", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "language ID", "n-gram Jaccard join", "packing"]
    want = docs
    scored = quality.classify(want, labels).where("predicted = 1").select("doc_id")
    want = want.join(scored, "doc_id", "left_semi")
    first = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert first.columns == docs.columns and {r["doc_id"] for r in first.collect()} == {r["doc_id"] for r in want.collect()}
    found = language.identify(want).where("lang_pred <> 'und'").select("doc_id")
    want = want.join(found, "doc_id", "left_semi")
    one = setjoin.jaccard_components(want, 5, 80, 100).where("doc_id = component_id").select("doc_id")
    kept = {r["doc_id"] for r in one.collect()}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == kept and not {201, 202, 203, 200} & kept
    assert {i for i in range(120) if i % 3} - kept == set()


def test_entry_points(spark):
    import __spark_entry__ as e

    names = {n.split("_")[0] for n in e.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in e.queries()


def test_an_empty_table_stays_empty(spark, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_the_language_stage_learns_from_all_rows_and_gives_what_it_finds(spark, tmp_path):
    import zlib

    import corpus_pipeline

    words = {"en": "the of and to in that is was".split(), "xx": "zun quork vlim jopt draf".split()}
    rows = []
    for i in range(400):  # all rows in xx are in the fold that op 7 holds out
        lang = "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else "en"
        rows.append((i, " ".join(words[lang][(i + j * j) % len(words[lang])] for j in range(12)), lang if i % 5 else None, "s", 0))
    rows += [(1000, "12 34", "en", "s", 0), (1001, None, "en", "s", 0), (None, "zun vlim", "xx", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.STAGES[1][1](spark, docs.withColumn("lang_pred", F.lit("?")), str(tmp_path))
    assert found.columns == [*docs.columns, "lang_pred", "lang_score"]
    got = sorted(map(tuple, found.collect()), key=repr)
    assert [r[:5] for r in got] == sorted(rows[:400] + rows[402:], key=repr)
    assert all(r[5] == ("xx" if r[1].split()[0] in words["xx"] else "en") and 0.5 < r[6] <= 1 for r in got)
