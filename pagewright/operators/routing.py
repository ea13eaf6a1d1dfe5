"""Questions: which documents they name, what they are about, and which way to answer them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T

#: The patterns of the routes.
NUMERAL_AFTER_CUE = r"(?i)\b(?:label(?:l?ed)?|numeral|reference|component|element|part|item|number)\s+(?:as\s+|number\s+)?(\d{1,4}[a-z]?)\b"
NUMERAL_BEFORE_FIGURE = r"(?i)\b(\d{1,4}[a-z]?)\s+(?:in|of|on)\s+FIG"
AGGREGATE = (
    r"(?i)\b(how many|count|number of|total|sum|average|mean|highest|lowest|maximum|minimum|most expensive|cheapest|largest|smallest"
    r"|distinct|unique|percentage|percent|rate of|ratio of|earliest|latest|first|last)\b"
)
STRUCTURED_WORDS = (
    r"(?i)\b(test log|test runs?|tests?|bill of materials|bom|part numbers?|line items?|unit cost|extended cost|quantity|serial"
    r"|units? (were|was) tested|operator|failed|passed|pass|fail|measured|nominal|tolerance|manufacturer|supplier|cost)\b"
)
VISUAL = (
    r"(?i)\b(how many|count|shown|visible|depicted|where is|located|position|colou?r|shape|appearance|look like|arranged|orientation)\b"
)
FIGURE_WORDS = r"(?i)\b(figure|fig\.?|drawing|diagram|rendering|photo|image)\b"
PATENT_ID = r"^(us\d{7,11}[ab]?\d?|\d{7,11})$"
PATENT_STEM = r"(?i)^(US)?(\d{7,11})([AB]\d)?"
PRODUCT = r"^[a-z]{2,}[a-z0-9]*(-?[a-z0-9]+)+$"
FILE_ENDING = r"(?i)\.(pdf|docx|csv|xlsx)$"
LEAST_ALIAS, LEAST_PRODUCT, FIRST_CHUNKS = 4, 5, 3


def doc_aliases(chunks: DataFrame) -> DataFrame:
    """(doc, aliases): parts of the file name, forms of a patent number, product names in the first chunks of page 1.

    chunks: doc, page, ord, identifiers.
    """
    stem = F.regexp_replace("doc", FILE_ENDING, "")
    head = F.element_at(F.split(stem, "_"), 1)
    digits, kind = F.regexp_extract(head, PATENT_STEM, 2), F.lower(F.regexp_extract(head, PATENT_STEM, 3))
    parts = F.filter(F.transform(F.split(stem, r"[_\s]+"), T.norm), lambda p: F.length(p) >= LEAST_ALIAS)
    us = F.concat(F.lit("us"), digits)
    patents = F.when(digits != "", F.array(us, digits, F.concat(us, kind))).otherwise(F.array().cast("array<string>"))
    place = F.row_number().over(_by_place())
    ids = chunks.filter("page = 1").withColumn("n", place).filter(F.col("n") <= FIRST_CHUNKS)
    ids = ids.select("doc", F.explode("identifiers").alias("i")).filter(F.col("i").rlike(PRODUCT) & (F.length("i") >= LEAST_PRODUCT))
    products = ids.groupBy("doc").agg(F.collect_set(T.norm(F.col("i"))).alias("products"))
    named = chunks.select("doc").distinct().join(products, "doc", "left")
    none = F.array().cast("array<string>")
    return named.select("doc", F.array_sort(F.array_distinct(F.concat(parts, patents, F.coalesce("products", none)))).alias("aliases"))


def _by_place():
    from pyspark.sql import Window

    return Window.partitionBy("doc").orderBy("ord")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def patent_match(asked: Column, aliases: Column) -> Column:
    """Whether a patent number is among the aliases, kind codes aside."""
    same = F.exists(aliases, lambda a: a.startswith("us") & (_digits(a) == _digits(asked)) & (_digits(asked) != ""))
    return F.array_contains(aliases, asked) | same


def resolve(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(qid, doc, doc_boost): the document that a patent number pins, if it pins exactly one, and the documents whose
    product names occur, tables aside. questions: qid, identifiers.

    Identifiers and aliases meet by equality: as they stand, and patent numbers by their digits.
    """
    asked = questions.select("qid", F.explode(F.array_distinct(F.transform("identifiers", T.norm))).alias("i"))
    named = aliases.select("doc", F.explode("aliases").alias("a"))
    soft = asked.join(named, asked.i == named.a).select("qid", "doc", F.col("i").rlike(PATENT_ID).alias("hard"))
    patents = asked.filter(F.col("i").rlike(PATENT_ID)).select("qid", _digits(F.col("i")).alias("d"))
    numbers = named.filter(F.col("a").startswith("us")).select("doc", _digits(F.col("a")).alias("d")).filter("d <> ''").distinct()
    hard = patents.join(numbers, "d").select("qid", "doc", F.lit(True).alias("hard"))
    met = soft.unionByName(hard).groupBy("qid", "doc").agg(F.bool_or("hard").alias("hard"))
    boosted = ~F.col("hard") & ~F.lower("doc").rlike(r"\.(csv|xlsx)$")
    by = met.groupBy("qid").agg(F.count_if("hard").alias("n"), F.min(F.when(F.col("hard"), F.col("doc"))).alias("d"), F.array_sort(F.collect_list(F.when(boosted, F.col("doc")))).alias("doc_boost"))
    found = by.select("qid", F.when(F.col("n") == 1, F.col("d")).alias("doc"), "doc_boost")
    none = F.array().cast("array<string>")
    return questions.select("qid").distinct().join(found, "qid", "left").select("qid", "doc", F.coalesce("doc_boost", none).alias("doc_boost"))


def asked_numerals(question: Column, known: Column) -> Column:
    """Numerals that a question asks about: known ones, or with a letter."""
    found = F.array_distinct(F.concat(T.all_matches(question, NUMERAL_AFTER_CUE, 1), T.all_matches(question, NUMERAL_BEFORE_FIGURE, 1)))
    return F.filter(found, lambda n: F.array_contains(known, n) | n.rlike("[a-z]$"))


def known_in(questions: DataFrame, numerals: DataFrame) -> DataFrame:
    """questions with known: those of the numerals (numeral) that stand in them, by a join on the numbers they hold; the
    table may be of any size."""
    held = questions.select("qid", F.explode(F.array_distinct(T.all_matches(F.coalesce("question", F.lit("")), T.NUMERAL, 1))).alias("numeral"))
    met = held.join(numerals.select("numeral").distinct(), "numeral").groupBy("qid").agg(F.array_sort(F.collect_set("numeral")).alias("known"))
    none = F.array().cast("array<string>")
    return questions.join(met, "qid", "left").withColumn("known", F.coalesce("known", none))


def parse(questions: DataFrame, known: Column) -> DataFrame:
    """questions (qid, question) with identifiers, fig_id, numerals, route (numeral, sql or hybrid) and visual."""
    q = F.col("question")
    number = F.upper(F.regexp_extract(q, T.FIGURE, 1))
    out = questions.withColumns(
        {
            "identifiers": T.extract_identifiers(q, known),
            "fig_id": F.when(number != "", F.concat(F.lit("FIG. "), number)),
            "numerals": asked_numerals(q, known),
        }
    )
    sql = q.rlike(AGGREGATE) & q.rlike(STRUCTURED_WORDS)
    return out.withColumn("route", F.when(F.size("numerals") > 0, "numeral").when(sql, "sql").otherwise("hybrid")).withColumn(
        "visual", q.rlike(VISUAL) & (F.col("fig_id").isNotNull() | q.rlike(FIGURE_WORDS))
    )


def numeral_lookup(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """(qid, numeral, docs, names): the first of a question's numerals that any candidate document defines; several
    documents make it ambiguous. questions: qid, numerals, doc (null: any); entries: doc, numeral, name."""
    asked = questions.select("qid", F.col("doc").alias("only"), F.posexplode("numerals").alias("at", "numeral"))
    hit = asked.join(entries.select("doc", "numeral", "name"), "numeral").filter("only is null or only = doc")
    by = hit.groupBy("qid", "at", "numeral").agg(F.array_sort(F.collect_list(F.struct("doc", "name"))).alias("e"))
    first = by.groupBy("qid").agg(F.min_by(F.struct("numeral", "e"), "at").alias("x"))
    return first.select("qid", "x.numeral", F.transform("x.e", lambda e: e["doc"]).alias("docs"), F.transform("x.e", lambda e: e["name"]).alias("names"))
