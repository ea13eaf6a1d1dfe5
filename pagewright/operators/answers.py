"""Evidence for answers, checks of answers, and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T

LEAST_OVERLAP = 0.4
#: Evidence that is in scope whatever document is named.
FREE_KINDS = ("numeral_lookup", "sql_result")


def split_tables(tables: DataFrame) -> DataFrame:
    """(table_id, pages) of tables on more than one page."""
    by = tables.filter("table_id is not null").groupBy("table_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    return by.filter(F.size("pages") > 1)


def build_evidence(items: DataFrame) -> DataFrame:
    """items (qid, source, place, ...) numbered e1, e2, ... a question: numerals, then SQL, then chunks in place."""
    rank = F.when(F.col("source") == "numeral", 0).when(F.col("source") == "sql", 1).otherwise(2)
    order = Window.partitionBy("qid").orderBy(rank, "place")
    return items.withColumn("eid", F.concat(F.lit("e"), F.row_number().over(order)))


def citations(cited: DataFrame) -> DataFrame:
    """(qid, cites): distinct (doc, page) in the order cited, with the extra pages of an item after its own."""
    pages = F.concat(F.array("page"), F.coalesce("extra_pages", F.array().cast("array<int>")))
    flat = cited.select("qid", "place", "doc", F.posexplode(pages).alias("at", "p"))
    first = flat.groupBy("qid", "doc", "p").agg(F.min(F.struct("place", "at")).alias("o"))
    one = F.struct("o", F.struct("doc", F.col("p").alias("page")).alias("c"))
    return first.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]).alias("cites"))


def verify(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, ok, not_found, kept, missing, overlap) of drafts (qid, question, answer, doc, cited, declined).

    evidence: qid, eid, doc, kind, text. Hard checks: some cited id exists; if a document is named, some cited item is
    of it; each number of the answer is in the cited text or the question. A failed one makes it not found. A declined
    draft passes as not found.
    """
    cited = drafts.select("qid", F.posexplode_outer("cited").alias("at", "eid"))
    hit = cited.join(evidence.withColumnRenamed("doc", "edoc"), ["qid", "eid"]).join(drafts.select("qid", "doc"), "qid")
    scope = F.col("doc").isNull() | (F.col("edoc") == F.col("doc")) | F.col("kind").isin(*FREE_KINDS)
    inside = hit.filter(scope).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("at", "eid", "text"))).alias("x"))
    t = drafts.join(inside, "qid", "left")
    kept = F.coalesce(F.transform("x", lambda e: e["eid"]), F.array().cast("array<string>"))
    text = F.array_join(F.coalesce(F.transform("x", lambda e: e["text"]), F.array().cast("array<string>")), "\n")
    t = t.withColumn("kept", kept).withColumn("text", text)
    t = t.withColumn("missing", T.ungrounded_numbers(F.col("answer"), F.col("text"), F.col("question")))
    t = t.withColumn("overlap", F.round(T.content_overlap(F.col("answer"), F.col("text")), 6))
    sound = (F.size("kept") > 0) & (F.size("missing") == 0)
    ok = F.col("declined") | sound
    return t.select("qid", ok.alias("ok"), (F.col("declined") | ~sound).alias("not_found"), "kept", "missing", "overlap", (F.col("overlap") < LEAST_OVERLAP).alias("low_overlap"))


def score(rows: DataFrame) -> DataFrame:
    """Scores of answered questions (qid, type, gold, retrieved, cited: arrays of pages; reference, answer, not_found,
    graded). What does not apply to unanswerable questions is null; these are correct if declined."""
    answerable = F.size("gold") > 0
    nums = ~F.col("not_found") & T.nums_match(F.col("reference"), F.col("answer"))
    both = F.size(F.array_intersect("gold", "cited"))
    return rows.select(
        "qid",
        "type",
        F.when(answerable, F.arrays_overlap("gold", "retrieved")).alias("retrieved"),
        F.when(answerable, F.arrays_overlap("gold", "cited")).alias("page_hit"),
        F.when(answerable, nums).alias("nums_ok"),
        (F.col("not_found") == ~answerable).alias("nf_ok"),
        F.when(answerable, F.when(F.size("cited") > 0, F.round(both / F.size(F.array_distinct("cited")), 6)).otherwise(0.0)).alias("citation_precision"),
        F.when(~answerable, F.col("not_found")).when(F.col("not_found"), False).otherwise(nums & F.col("graded")).alias("correct"),
        "not_found",
    )


def failure_stage(answerable: Column, correct: Column, page_hit: Column, retrieved: Column, extracted: Column, not_found: Column) -> Column:
    """Where an answer failed: null for an unanswerable question that was declined, else abstention; none if correct and
    cited, citation if only the page is wrong, retrieval if no gold page was found, extraction if its text is not there,
    abstention if it was declined all the same, and generation."""
    return (
        F.when(~answerable, F.when(~not_found, F.lit("abstention")))
        .when(correct & page_hit, F.lit("none"))
        .when(correct, F.lit("citation"))
        .when(~retrieved, F.lit("retrieval"))
        .when(~extracted, F.lit("extraction"))
        .when(not_found, F.lit("abstention"))
        .otherwise(F.lit("generation"))
    )


def adversarial(rows: DataFrame) -> DataFrame:
    """Unanswerable questions (id, category, answer, not_found, visual, accept_zero, accept_visual): handled if
    declined, or answered with zero or from a picture where that is accepted."""
    zero = F.col("accept_zero") & (F.array_contains(T.numbers_in(F.col("answer")), "0") | F.array_contains(T.words_of(F.col("answer")), "zero"))
    return rows.select("id", "category", F.coalesce(F.col("not_found") | zero | (F.col("accept_visual") & F.col("visual")), F.lit(False)).alias("handled"))


def summary(scored: DataFrame) -> DataFrame:
    """By type and for all: counts, rates over the questions they apply to, and the penalty score: 1 for a correct
    answer, 0 for a declined one, -2 for a wrong one."""
    penalty = F.when(F.col("correct"), 1).when(F.col("not_found"), 0).otherwise(-2)
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    out = scored.rollup("type").agg(F.count(F.lit(1)).alias("n"), rate("correct"), rate("page_hit"), rate("nums_ok"), rate("nf_ok"), F.round(F.avg("citation_precision"), 6).alias("citation_precision"), F.sum(penalty).alias("penalty"))
    return out.withColumn("type", F.coalesce("type", F.lit("all")))
