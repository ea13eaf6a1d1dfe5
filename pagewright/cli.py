"""Command line: extract, ingest, load, search, ask, show, sql, models, eval, check. Exit codes: 0 done, 1 failed, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import chunks, metrics, numerals, search, store, tables
from pagewright.plans import engine, guard
from pagewright.session import give_package, local_session
from pagewright.sources import files

#: Commands and their arguments.
COMMANDS = {
    "extract": "corpus out", "ingest": "corpus index", "load": "csv out", "search": "index question", "ask": "index question", "show": "index doc page", "sql": "table statement",
    "models": "index", "eval": "index questions report", "check": "",
}


def ingest(spark: SparkSession, corpus: str, index: str) -> None:
    """Chunks of a folder's documents and of its tables' rows in one index, in order, and the numerals of its documents."""
    found = files.corpus(spark, corpus)
    parsed = files.parse(found.filter(F.col("suffix").isin(*files.PARSERS)))
    prose, rows = chunks.chunk_documents(parsed), None
    for r in found.filter("suffix = '.csv'").select("path", "doc").toLocalIterator():
        typed, _ = tables.load(files.read_csv(spark, r["path"]), os.path.splitext(r["doc"])[0], r["doc"])
        texts = tables.row_texts(typed, tables.identifier(os.path.splitext(r["doc"])[0]), r["doc"])
        one = tables.structured_chunks(texts).withColumn("place", F.regexp_extract("id", r"row(\d+)$", 1).cast("int"))
        rows = one if rows is None else rows.unionByName(one)
    store.corpus(prose, prose.limit(0) if rows is None else rows).write.mode("overwrite").parquet(f"{index}/chunks")
    numerals.save(numerals.numerals(parsed), numerals.figure_definitions(parsed), f"{index}/numerals")


def opened(spark: SparkSession, index: str) -> engine.Corpus:
    entries, figures = numerals.load(spark, f"{index}/numerals")
    return engine.Corpus(spark.read.parquet(f"{index}/chunks"), entries, figures)


def evaluate(spark: SparkSession, index: str, questions: str, report: str) -> DataFrame:
    """Answer a file of questions (JSON lines: qid, type, question, doc, page of the gold) and write how often the cited page
    is right, by type, as JSON and Markdown."""
    q = spark.read.schema("qid int, type string, question string, doc string, page int").json(questions)
    got = engine.ask(q.select("qid", "question"), opened(spark, index))
    t = q.join(got, "qid")
    answerable = F.col("doc").isNotNull()
    cited = F.exists(F.coalesce("citations", F.array().cast("array<struct<doc:string,page:int>>")), lambda c: (c["doc"] == F.col("doc")) & (c["page"] == F.col("page")))
    rates = metrics.quick_rates(t.select("type", F.when(answerable, cited).alias("page_hit"), (F.col("not_found") == ~answerable).alias("nf_ok")), ("page_hit", "nf_ok"))
    told, text = metrics.report("Evaluation", {"rates": rates})
    for ending, body in ((".json", json.dumps(told, indent=1)), (".md", text)):
        with open(report + ending, "w") as f:
            f.write(body)
    return rates


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("pagewright")
    sub = p.add_subparsers(dest="command", required=True)
    for name, words in COMMANDS.items():
        s = sub.add_parser(name)
        for w in words.split():
            s.add_argument(w, type=int if w == "page" else str)
    a = p.parse_args(argv)
    spark = local_session()
    give_package(spark)
    try:
        if a.command == "extract":
            store.to_markdown(files.parse(files.corpus(spark, a.corpus, tuple(files.PARSERS)))).write.mode("overwrite").json(a.out)
        elif a.command == "ingest":
            ingest(spark, a.corpus, a.index)
        elif a.command == "load":
            typed, profile = tables.load(files.read_csv(spark, a.csv), a.csv.rsplit("/", 1)[-1], a.csv)
            typed.write.mode("overwrite").parquet(a.out)
            print(tables.describe(profile, {r["tbl"]: typed.count() for r in profile.select("tbl").distinct().collect()}))
        elif a.command in ("search", "ask", "show"):
            corpus = opened(spark, a.index)
            if a.command == "show":
                store.page_chunks(corpus.chunks, a.doc, a.page).select("id", "kind", "text").show(100, truncate=False)
                return 0
            q = spark.createDataFrame([(1, a.question)], "qid int, question string")
            if a.command == "search":
                q = q.withColumn("identifiers", T.extract_identifiers(F.col("question")))
                search.keyword_search(corpus.chunks, q).join(corpus.chunks.select("ord", "id", "text"), "ord").orderBy("rank").show(8, truncate=100)
            else:
                engine.ask(q, corpus).show(truncate=False)
        elif a.command == "sql":
            spark.read.parquet(a.table).createOrReplaceTempView("t")
            print(guard.shown(guard.query_sql(spark, a.statement)))
        elif a.command == "models":
            try:
                store.models(spark.read.parquet(f"{a.index}/vectors")).show(truncate=False)
            except AnalysisException:
                print("no vectors: search is by keywords alone")
        elif a.command == "eval":
            evaluate(spark, a.index, a.questions, a.report).show(truncate=False)
        else:
            print(f"spark {spark.version}; parsers: {', '.join(sorted(files.PARSERS))}")
    except (guard.SQLError, ValueError, AnalysisException) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
