"""Command line: build an index, search it, fit topics."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quarry.functions.analysis import CANONICAL
from quarry.operators import plsa, thesaurus
from quarry.operators.search import answer, search
from quarry.plans.checkpoints import checkpointed
from quarry.plans.index import Index, build
from quarry.sources.corpus import read_csv, read_queries, read_query, read_thesaurus_lines, write_result


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="build an index from a CSV corpus")
    index.add_argument("-i", "--input", required=True)
    index.add_argument("-o", "--output", required=True)
    index.add_argument("--limit", type=int)
    one = commands.add_parser("search", help="answer one query file")
    one.add_argument("-d", "--index", required=True)
    one.add_argument("-q", "--query", required=True)
    one.add_argument("-o", "--output", required=True)
    given = one.add_mutually_exclusive_group()
    given.add_argument("--thesaurus", help="thesaurus text")
    given.add_argument("--stored-thesaurus", help="thesaurus as the thesaurus command has written it")
    one.add_argument("--limit", type=int)
    one.add_argument("--as-coded", action="store_true")
    many = commands.add_parser("answer", help="answer a folder of query files, a line each, errors as a table")
    many.add_argument("-d", "--index", required=True)
    many.add_argument("-q", "--queries", required=True)
    many.add_argument("-o", "--output", required=True)
    many.add_argument("--stored-thesaurus")
    many.add_argument("--limit", type=int)
    many.add_argument("--as-coded", action="store_true")
    book = commands.add_parser("thesaurus", help="store a thesaurus text for searches")
    book.add_argument("-i", "--input", required=True)
    book.add_argument("-o", "--output", required=True)
    book.add_argument("--mode", choices=("headword", "symmetric"), default="headword")
    topics = commands.add_parser("plsa", help="fit a topic model over an index")
    topics.add_argument("-d", "--index", required=True)
    topics.add_argument("-o", "--output", required=True)
    topics.add_argument("-k", type=int, default=10)
    topics.add_argument("--max-iter", type=int, default=30)
    topics.add_argument("--tol", type=float, default=10.0)
    topics.add_argument("--stop", choices=("gain", "change"), default="gain")
    words = commands.add_parser("vocabulary", help="write an index's terms as text")
    words.add_argument("-d", "--index", required=True)
    words.add_argument("-o", "--output", required=True)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("quarry").getOrCreate()
    if args.command == "index":
        build(checkpointed(read_csv(spark, args.input, args.limit)), CANONICAL).save(args.output)  # parsed once, though read twice
    elif args.command == "search":
        query = read_query(spark, args.query)
        synonyms = thesaurus.build(read_thesaurus_lines(spark, args.thesaurus)) if args.thesaurus else thesaurus.load(spark, args.stored_thesaurus) if args.stored_thesaurus else None
        write_result(search(spark, Index.load(spark, args.index), query.text, query.relevant, CANONICAL, synonyms, args.as_coded, args.limit), args.output)
    elif args.command == "answer":
        synonyms = thesaurus.load(spark, args.stored_thesaurus) if args.stored_thesaurus else None
        found = checkpointed(answer(spark, Index.load(spark, args.index), read_queries(spark, args.queries), CANONICAL, synonyms, args.as_coded, args.limit))
        write_result(found.where("error IS NULL"), f"{args.output}/lines")
        found.where("error IS NOT NULL").select("query_id", "error").write.mode("overwrite").parquet(f"{args.output}/errors")
    elif args.command == "thesaurus":
        thesaurus.save(thesaurus.build(read_thesaurus_lines(spark, args.input), args.mode), args.output)
    elif args.command == "plsa":
        lam, theta, _ = plsa.PLSA(args.k, args.max_iter, args.tol, args.stop).fit(plsa.doc_term_matrix(Index.load(spark, args.index)))
        lam.write.mode("overwrite").parquet(f"{args.output}/documents")
        theta.write.mode("overwrite").parquet(f"{args.output}/terms")
        plsa.top_words(theta, args.k).write.mode("overwrite").parquet(f"{args.output}/top_words")
    else:
        Index.load(spark, args.index).dump_vocabulary(args.output)


if __name__ == "__main__":
    main()
