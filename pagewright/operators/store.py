"""Index tables: lookups, rebuilds, embedding upserts, caches, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T


def by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks by (place, id) in the given order; ids that are not there are skipped."""
    return chunks.join(ids, "id").orderBy("place")


def page_chunks(chunks: DataFrame, doc: str, page: int) -> DataFrame:
    return chunks.filter((F.col("doc") == doc) & (F.col("page") == page)).orderBy("ord")


def all_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.orderBy("ord")


def docs(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc").distinct()


def with_identifier(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted identifiers (identifier) that any chunk carries."""
    held = chunks.select(F.explode("identifiers").alias("identifier"))
    return wanted.join(held, "identifier", "left_semi")


def surviving(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Embeddings of chunks that a rebuild has kept, of every model."""
    return embeddings.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` and the rows of ``old`` whose key is not in it; of rows of ``new`` with one key, the greatest."""
    values = [c for c in new.columns if c not in keys]
    order = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in values))
    latest = new.withColumn("pw_n", F.row_number().over(order)).filter("pw_n = 1").drop("pw_n")
    return old.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


def cache_misses(texts: DataFrame, cache: DataFrame, length: int = 32) -> DataFrame:
    """Distinct texts (text) whose content hash is not in the cache (hash), with that hash."""
    hashed = texts.select("text").distinct().withColumn("hash", T.content_hash(F.col("text"), length))
    return hashed.join(cache.select("hash"), "hash", "left_anti")


def stats(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(what, name, n): chunks by kind and embeddings by model."""
    kinds = chunks.groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("kind").alias("what"), "name", "n")
    models = embeddings.groupBy(F.col("model").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("embeddings").alias("what"), "name", "n")
    return kinds.unionByName(models)


def to_markdown(blocks: DataFrame) -> DataFrame:
    """(doc, page, markdown): blocks of a page in order, headings marked, tables as pipes, figures by their captions."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(F.element_at("cells", 1), lambda _: F.lit("---")), "|"), F.lit("|"))
    table = F.array_join(
        F.concat(F.array(line(F.element_at("cells", 1)), rule), F.transform(F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0))), line)), "\n"
    )
    body = F.when(F.col("kind") == "table", F.concat_ws("\n\n", "title", table)).when(
        F.col("kind") == "figure", F.concat(F.lit("[figure] "), F.coalesce("caption", F.lit("")))
    ).when(F.col("role") == "heading", F.concat(F.lit("## "), "text")).otherwise(F.col("text"))
    pages = blocks.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("ord", body.alias("t")))).alias("b"))
    return pages.select("doc", "page", F.concat_ws("\n\n", F.transform("b", lambda x: x["t"])).alias("markdown"))


def document_summary(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, pages, tables, figures, ocr_pages): what ``extract`` prints a document."""
    counts = blocks.groupBy("doc").agg(F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(F.col("kind") == "figure").alias("figures"))
    per = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("pages"), F.count_if("is_scanned").alias("ocr_pages"))
    return per.join(counts, "doc", "left").fillna(0).select("doc", "pages", "tables", "figures", "ocr_pages")


def corpus(prose: DataFrame, rows: DataFrame) -> DataFrame:
    """One index of prose chunks and chunks of structured rows, in the order of doc, page and place, with ord counting from
    0 by document: ord is the document's first number plus the place within it. Columns one side lacks are null there."""
    both = prose.unionByName(rows, allowMissingColumns=True)
    sizes = both.groupBy("doc").agg(F.count(F.lit(1)).alias("pw_n"))
    first = F.coalesce(F.sum("pw_n").over(Window.orderBy("doc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("page", "place", "id")) - 1
    return both.withColumn("pw_k", place).join(sizes.select("doc", first.alias("pw_first")), "doc").withColumn("ord", (F.col("pw_first") + F.col("pw_k")).cast("bigint")).drop("pw_k", "pw_first")


def models(embeddings: DataFrame) -> DataFrame:
    """(model): of which there are vectors; without any, search is by keywords alone."""
    return embeddings.select("model").distinct()


#: What an embedding model wants: prefixes of queries and passages, longest input.
SPECS = {"ibm-granite/granite-embedding-english-r2": ("", "", 1024)}
DEFAULT_SPEC = ("", "", 512)


def model_input(text, model: str, is_query: bool = False):
    """A text as the model wants it, with its prefix."""
    return F.concat(F.lit(SPECS.get(model, DEFAULT_SPEC)[0 if is_query else 1]), text)
