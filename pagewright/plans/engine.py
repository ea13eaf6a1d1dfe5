"""Questions to answers, all at once: route, rank, collect evidence, draft, verify, cite.

Models are plug-ins: ``embed`` turns questions into vectors, ``write`` into SQL, ``draft`` evidence into answers. Without them
retrieval is by keywords alone, structured questions are answered from the chunks, and the draft is the best piece of
evidence.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators import answers, numerals, routing, search
from pagewright.plans import guard
from pagewright.session import written


@dataclass(frozen=True)
class Corpus:
    """What questions are asked of. chunks: ord, id, doc, page, prefix, text, identifiers, and, where they are known, kind,
    table_id and caption_page. entries: doc, numeral, name, variants, pages. figures: doc, fig_id, page, title. labels: of
    figures: doc, ord, fig_id, labels. vectors: ord, doc, vec. tables: names of the views that SQL may read; schema:
    their description."""

    chunks: DataFrame
    entries: DataFrame | None = None
    figures: DataFrame | None = None
    labels: DataFrame | None = None
    vectors: DataFrame | None = None
    tables: list[str] = field(default_factory=list)
    schema: str = ""


def extractive(evidence: DataFrame) -> DataFrame:
    """(qid, answer, cited, declined): the first item's text as the answer."""
    first = evidence.groupBy("qid").agg(F.min_by(F.struct("eid", "text"), F.struct(F.length("eid"), "eid")).alias("e"))
    return first.select("qid", F.col("e.text").alias("answer"), F.array("e.eid").alias("cited"), F.lit(False).alias("declined"))


ITEM = "source string, place bigint, doc string, page int, kind string, text string, extra_pages array<int>"


def _chunk_items(ranked: DataFrame, corpus: Corpus) -> DataFrame:
    """Evidence of the ranked pages. A figure also cites its caption's page, a table over several pages its others."""
    c = corpus.chunks
    for name, kind in (("kind", "string"), ("table_id", "string"), ("caption_page", "int")):
        c = c if name in c.columns else c.withColumn(name, F.lit(None).cast(kind))
    c = c.select("ord", "doc", F.col("page").cast("int").alias("page"), F.coalesce("kind", F.lit("text")).alias("kind"), "text", "table_id", "caption_page")
    spread = answers.split_tables(c).withColumnRenamed("pages", "pw_pages")
    chosen = written(search.evidence(ranked, corpus.chunks), "chosen")
    items = c.join(search.small(chosen), "ord").join(spread, "table_id", "left")
    none = F.array().cast("array<int>")
    figure = F.when((F.col("kind") == "figure") & (F.col("caption_page") != F.col("page")), F.array("caption_page"))
    table = F.when(F.col("kind").isin("table", "table_row"), F.filter("pw_pages", lambda p: p != F.col("page")))
    place = (F.col("page_rank") * 1000 + F.col("place")).cast("bigint").alias("place")
    return items.select("qid", F.lit("chunk").alias("source"), place, "doc", "page", "kind", "text", F.coalesce(figure, table, none).alias("extra_pages"))


def _numeral_items(parsed: DataFrame, corpus: Corpus) -> DataFrame:
    """Definitions of the numerals asked about: of one document, with the figure asked about; of several, each by name."""
    hit = routing.numeral_lookup(parsed, corpus.entries).join(parsed.select("qid", "fig_id"), "qid")
    own = corpus.entries.select(F.col("doc").alias("edoc"), "numeral", "variants", "pages")
    t = hit.withColumn("edoc", F.element_at("docs", 1)).join(own, ["edoc", "numeral"], "left")
    if corpus.figures is not None:
        f = corpus.figures.select(F.col("doc").alias("edoc"), "fig_id", F.col("page").alias("fpage"), F.col("title").alias("ftitle"))
        t = t.join(f, ["edoc", "fig_id"], "left")
    else:
        t = t.withColumns({"fpage": F.lit(None).cast("int"), "ftitle": F.lit(None).cast("string")})
    if corpus.labels is not None:
        asked = t.filter("fig_id is not null").select("qid", F.col("edoc").alias("doc"), "fig_id", "numeral")
        t = t.join(numerals.seen_in_figure(asked, corpus.labels), "qid", "left")
    else:
        t = t.withColumn("seen", F.lit(None).cast("boolean"))
    several = F.size("docs") > 1
    names = F.array_join(F.zip_with("docs", "names", lambda d, n: F.concat(d, F.lit(": "), n)), "; ")
    many = F.concat(F.lit("Reference numeral "), "numeral", F.lit(" is defined in several documents: "), names, F.lit(". The question must name the document."))
    variants = F.when(F.size("variants") > 0, F.concat(F.lit(" (also written: "), F.array_join("variants", ", "), F.lit(")"))).otherwise("")
    title = F.when(F.col("ftitle").isNotNull(), F.concat(F.lit(" "), "fig_id", F.lit(" is described as: "), "ftitle", F.lit(" (page "), F.col("fpage").cast("string"), F.lit(")."))).otherwise("")
    unseen = F.when(~F.col("seen"), F.concat(F.lit(" (label "), "numeral", F.lit(" was not read on the "), "fig_id", F.lit(" image; the definition comes from the specification text)"))).otherwise("")
    pages = F.array_join(F.transform("pages", lambda p: p.cast("string")), ", ")
    one = F.concat(
        F.lit("Reference numeral "), "numeral", F.lit(" in "), "edoc", F.lit(" is defined in the specification as: "), F.element_at("names", 1), variants,
        F.lit(". Defined on page(s) "), pages, F.lit("."), title, F.coalesce(unseen, F.lit("")),
    )
    page = F.coalesce("fpage", F.element_at("pages", 1).cast("int"), F.lit(1))
    none = F.array().cast("array<int>")
    return t.select("qid", F.lit("numeral").alias("source"), F.lit(0).cast("bigint").alias("place"), F.col("edoc").alias("doc"), page.alias("page"), F.lit("numeral_lookup").alias("kind"), F.when(several, many).otherwise(one).alias("text"), none.alias("extra_pages"))


def _sql_items(parsed: DataFrame, corpus: Corpus, write: Callable) -> DataFrame:
    """Results of the statements that ``write`` makes of structured questions. Each is a call to a model and a statement of
    its own, so they are run one after the other; one that fails leaves its question to the chunks."""
    spark, rows = parsed.sparkSession, []
    for r in parsed.filter("route = 'sql'").select("qid", "question").toLocalIterator():
        try:
            statement, result, docs = guard.answer_sql(spark, r["question"], corpus.schema, write, corpus.tables)
        except guard.SQLError:
            continue
        rows.append((r["qid"], "sql", 0, docs[0] if docs else "structured", 1, "sql_result", f"SQL: {statement}\n{guard.shown(result)}", []))
    kind = parsed.schema["qid"].dataType.simpleString()
    return spark.createDataFrame(rows, f"qid {kind}, {ITEM}")


def ask(
    questions: DataFrame,
    corpus: DataFrame | Corpus,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    write: Callable[[str, str, str | None], str] | None = None,
    draft: Callable[[DataFrame], DataFrame] = extractive,
    least_top: float = 0.0,
) -> DataFrame:
    """(qid, route, answer, not_found, citations, missing) of questions (qid, question) over a corpus, or chunks alone.

    Numerals are matched by joins, however many there are. With ``least_top``, a question whose best page scores less is
    declined before a draft is made, unless a numeral or SQL answers it.
    """
    corpus = corpus if isinstance(corpus, Corpus) else Corpus(corpus)
    chunks, none = corpus.chunks, F.array().cast("array<string>")
    known = routing.known_in(questions, corpus.entries) if corpus.entries is not None else questions.withColumn("known", none)
    parsed = routing.parse(known, F.col("known")).drop("known")
    scope = routing.resolve(parsed, routing.doc_aliases(chunks))
    parsed = written(parsed.join(scope, "qid", "left"), "parsed")
    lists = [search.keyword_search(chunks, parsed, doc="doc")]
    if corpus.vectors is not None and embed is not None:
        asked = embed(parsed).join(parsed.select("qid", "doc"), "qid")
        lists.append(search.dense_search(corpus.vectors, asked, doc="doc"))
    fused = written(search.rrf(lists), "fused")
    boosts = parsed.select("qid", F.explode("doc_boost").alias("doc"))
    ranked = written(search.top_pages(search.page_scores(fused, chunks, boosts)), "ranked")
    items = _chunk_items(ranked, corpus)
    if corpus.entries is not None:
        items = items.unionByName(_numeral_items(parsed.filter("route = 'numeral'"), corpus))
    if write is not None:
        items = items.unionByName(_sql_items(parsed, corpus, write))
    evidence = written(answers.build_evidence(items), "evidence")
    drafted = evidence
    if least_top > 0:
        has = evidence.groupBy("qid").agg(F.bool_or(F.col("source") == "numeral").alias("has_numeral"), F.bool_or(F.col("source") == "sql").alias("has_sql"))
        gate = has.join(ranked.groupBy("qid").agg(F.max("score").alias("top_page_score")), "qid", "left").fillna(0.0, ["top_page_score"])
        drafted = evidence.join(gate.filter(~search.declines(gate, least_top)).select("qid"), "qid", "left_semi")
    drafts = parsed.select("qid", "question", "doc").join(draft(drafted), "qid", "left")
    drafts = drafts.withColumns({"declined": F.coalesce("declined", F.lit(True)), "answer": F.coalesce("answer", F.lit("")), "cited": F.coalesce("cited", none)})
    drafts = written(drafts, "drafts")
    checked = written(answers.verify(drafts, evidence.select("qid", "eid", "doc", "kind", "text")), "checked")
    cited = checked.filter("not not_found").select("qid", F.posexplode("kept").alias("place", "eid")).join(evidence.select("qid", "eid", "doc", "page", "extra_pages"), ["qid", "eid"])
    cites = answers.citations(cited)
    out = parsed.select("qid", "route").join(checked, "qid").join(drafts.select("qid", "answer"), "qid").join(cites, "qid", "left")
    text = F.when(F.col("not_found"), F.lit("not found")).otherwise(F.col("answer"))
    return out.select("qid", "route", text.alias("answer"), "not_found", F.col("cites").alias("citations"), "missing")
