"""Queries for the driver: each operator over the driver's tables, and the same in SQL.

Stand-ins: a line of a document is a chunk, of doc ``source`` and page ``doc_id``; a benchmark passage is a question, and
the documents that hold it are its gold pages; ``embeddings`` are chunk vectors by ``vec_id``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import stem as S
from pagewright.functions import text as T
from pagewright.operators import answers, chunks, layout, metrics, numerals, routing, search, store, tables
from pagewright.plans import guard
from pagewright.session import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes a core up to which a table is dealt out anew.
SMALL_FILE = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew if it has fewer files than there are cores, and these are small: a small file is one task,
    however much work its rows make. Large files are read in parts."""
    n = df.sparkSession.sparkContext.defaultParallelism
    held = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(n) if len(df.inputFiles()) < n and held < n * SMALL_FILE else df


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of fixed rows, as a local relation."""
    return spark.createDataFrame(rows, schema)


def literal(rows: list[tuple], names: list[str]) -> str:
    """The same rows as SQL: a golden result."""

    def one(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(one, v)) + "]"
        return f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({', '.join(names)})"


# --- retrieval

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
CHUNKS_SQL = r"""
lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
chunks AS MATERIALIZED (SELECT doc_id * 1048576 + line AS ord, source AS doc, doc_id AS page, source || ' › p.' || doc_id AS prefix, text FROM lines WHERE trim(text, ' ') <> ''),
toks AS MATERIALIZED (SELECT ord, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM chunks),
terms AS MATERIALIZED (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.''/-]*')) AS t FROM benchmark),
kept AS (SELECT qid, t, list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ps FROM terms WHERE length(t) > 1 AND NOT list_contains(STOPS, t)),
asked AS MATERIALIZED (SELECT qid, t, len(ps) AS n, unnest(ps) AS w, generate_subscripts(ps, 1) AS pos FROM kept),
said AS MATERIALIZED (SELECT ord, unnest(ws) AS w, generate_subscripts(ws, 1) AS place FROM toks),
words AS (SELECT w FROM said UNION SELECT w FROM asked),
STEMS,
pieces AS MATERIALIZED (SELECT qid, t, n, s AS piece, pos FROM asked JOIN stemmed USING (w)),
placed AS (SELECT ord, s AS piece, place FROM said JOIN stemmed USING (w)),
occ AS (SELECT qid, t, n, ord, place - pos AS st FROM placed JOIN pieces USING (piece) GROUP BY ALL HAVING count(DISTINCT pos) = n),
tf AS MATERIALIZED (SELECT qid, t, ord, count(*)::DOUBLE AS tf FROM occ GROUP BY ALL),
df AS (SELECT qid, t, count(*) AS df FROM tf GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(ws)) AS ml FROM toks),
bm AS (SELECT qid, ord, round(sum((CASE WHEN ln((st.n - df + 0.5) / (df + 0.5)) > 0 THEN ln((st.n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / ml))), 6) AS score
  FROM tf JOIN df USING (qid, t) JOIN toks USING (ord), st GROUP BY ALL),
keyword AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank FROM bm) WHERE rank <= 50)""".replace("STOPS", STOP_SQL).replace("STEMS", ",\n".join(S.sql("words")))
DENSE_SQL = r"""
vq AS (SELECT item_id AS qid, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON vec_id = item_id),
vs AS (SELECT vec_id * 1048576 AS ord, embedding::DOUBLE[] AS v FROM embeddings),
cosines AS (SELECT qid, ord, round(list_inner_product(q, v) / ((sqrt(list_inner_product(q, q)) + 1e-9) * (sqrt(list_inner_product(v, v)) + 1e-9)), 6) AS score FROM vq, vs),
dense AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank FROM cosines) WHERE rank <= 50)"""
FUSED_SQL = r"""
fused AS MATERIALIZED (SELECT qid, ord, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT qid, ord, rank FROM keyword UNION ALL SELECT qid, ord, rank FROM dense) GROUP BY ALL),
firsts AS (SELECT page, min(ord) AS o, any_value(doc) AS doc FROM chunks GROUP BY page)"""
PAGES_SQL = r"""
ranked AS (SELECT qid, doc, page, f.ord, score, row_number() OVER (PARTITION BY qid, doc, page ORDER BY score DESC, f.ord) AS n FROM fused f JOIN chunks c USING (ord)),
pages AS MATERIALIZED (SELECT qid, doc, page, round(max(score) + 0.1 * coalesce(sum(score) FILTER (n BETWEEN 2 AND 4), 0), 10) AS score, list(ord ORDER BY n) FILTER (n <= 10) AS hits FROM ranked GROUP BY ALL),
tops AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, hits[1]) AS page_rank FROM pages) WHERE page_rank <= 8)"""
ALL_SQL = f"WITH {CHUNKS_SQL}, {DENSE_SQL}, {FUSED_SQL}, {PAGES_SQL}"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _keyword(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = search.line_chunks(spread(read(spark, sf_dir, "documents")))
    return c, search.bm25(c, _questions(spark, sf_dir), T.content_terms(F.col("question")), {"text": 1.0}, 50)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    asked = _questions(spark, sf_dir).join(e, F.col("qid") == F.col("vec_id")).select("qid", F.col("embedding").alias("vec"))
    return search.dense_search(e.select((F.col("vec_id") * (1 << 20)).alias("ord"), F.col("embedding").alias("vec")), asked)


def _fused(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    c, k = _keyword(spark, sf_dir)
    d = written(_dense(spark, sf_dir), "dense")
    return c, k, d, written(search.rrf([k, d]), "fused")


@query(f"{ALL_SQL} SELECT qid, doc, page, page_rank, score FROM tops")
def hybrid_search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _, _, fused = _fused(spark, sf_dir)
    return search.top_pages(search.page_scores(fused, c)).select("qid", "doc", "page", F.col("page_rank").cast("bigint").alias("page_rank"), "score")


@query(f"WITH {CHUNKS_SQL} SELECT qid, ord, score, rank FROM keyword")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword(spark, sf_dir)[1].withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {DENSE_SQL} SELECT qid, ord, score, rank FROM dense")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {CHUNKS_SQL}, {DENSE_SQL}, {FUSED_SQL} SELECT * FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)[3]


@query(f"{ALL_SQL} SELECT qid, doc, page, score, len(hits) AS n_hits FROM pages")
def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _, _, fused = _fused(spark, sf_dir)
    return search.page_scores(fused, c).select("qid", "doc", "page", "score", F.size("hits").cast("bigint").alias("n_hits"))


@query(
    f"""{ALL_SQL}, sizes AS (SELECT doc, page, count(*) AS on_page FROM chunks GROUP BY ALL),
t AS (SELECT qid, doc, page, page_rank, len(hits) AS n, on_page FROM tops JOIN sizes USING (doc, page)),
k AS (SELECT *, n - least(greatest(greatest(sum(n) OVER (PARTITION BY qid) - 24, 0) - coalesce(sum(n - 1) OVER (PARTITION BY qid ORDER BY page_rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), n - 1) AS kept FROM t),
r AS (SELECT *, least(10 - kept, on_page - kept) AS room FROM k)
SELECT qid, doc, page, page_rank, kept::INTEGER AS kept, least(greatest(greatest(24 - sum(kept) OVER (PARTITION BY qid), 0) - coalesce(sum(room) OVER (PARTITION BY qid ORDER BY page_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), room)::INTEGER AS added FROM r"""
)
def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _, _, fused = _fused(spark, sf_dir)
    ranked = written(search.top_pages(search.page_scores(fused, c)), "ranked")
    return search.evidence_budget(ranked, c).withColumn("page_rank", F.col("page_rank").cast("bigint"))


@query(
    f"""{ALL_SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS r FROM fused),
s AS (SELECT qid, max(score) AS top1, round(max(score) - coalesce(max(score) FILTER (r = 5), 0), 9) AS gap_1_5, count(*) AS n_candidates FROM g GROUP BY qid),
b AS (SELECT qid, max(score) AS top_page_score FROM tops GROUP BY qid),
a AS (SELECT DISTINCT k.qid, true AS both_lists_agree FROM keyword k JOIN dense d USING (qid, ord) WHERE k.rank <= 5 AND d.rank <= 5)
SELECT qid, top1, gap_1_5, n_candidates, coalesce(top_page_score, 0) AS top_page_score, coalesce(both_lists_agree, false) AS both_lists_agree FROM s LEFT JOIN b USING (qid) LEFT JOIN a USING (qid)"""
)
def gate_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k, d, fused = _fused(spark, sf_dir)
    return search.gate_signals(fused, search.top_pages(search.page_scores(fused, c)), k, d)


GOLD_SQL = "gold AS (SELECT item_id AS qid, 'passage' || (item_id % 3) AS type, source AS doc, doc_id AS page FROM documents d, benchmark b WHERE contains(d.text, b.text))"


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that hold a passage: each document is looked through once for all the passages where it lies."""
    d, b = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    hit = search.holding(d.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text"), b)
    return hit.select("qid", F.concat(F.lit("passage"), F.col("qid") % 3).alias("type"), "doc", "page")


@query(
    f"""{ALL_SQL}, {GOLD_SQL}, po AS (SELECT qid, doc, page, max(score) AS s, arg_max(ord, struct_pack(s := score, o := -ord)) AS o FROM fused JOIN chunks USING (ord) GROUP BY ALL),
pr AS (SELECT qid, doc, page, row_number() OVER (PARTITION BY qid ORDER BY s DESC, o) AS r FROM po),
f AS (SELECT qid, type, min(r) AS first FROM gold LEFT JOIN pr USING (qid, doc, page) GROUP BY ALL)
SELECT coalesce(type, 'all') AS type, count(*) AS n, round(avg(CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0 END), 3) AS recall_at_1, round(avg(CASE WHEN first <= 3 THEN 1.0::DOUBLE ELSE 0 END), 3) AS recall_at_3,
round(avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0 END), 3) AS recall_at_5, round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE ELSE 0 END), 3) AS recall_at_10 FROM f GROUP BY GROUPING SETS ((type), ())"""
)
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _, _, fused = _fused(spark, sf_dir)
    return search.recall_at_k(search.page_order(fused, c), _gold(spark, sf_dir))


PART_SQL = r"""
pc AS MATERIALIZED (SELECT p_partkey AS ord, list_distinct([lower(replace(p_brand, '#', '-')), lower(replace(p_brand, '#', ''))]) AS ids FROM part),
pq AS (SELECT DISTINCT p_size AS qid, lower(replace(p_brand, '#', '')) AS t FROM part)"""


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = read(spark, sf_dir, "part")
    name = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    c = p.select(
        F.col("p_partkey").alias("ord"), F.lit("part").alias("doc"), F.lit(1).alias("page"), F.lit("part").alias("prefix"), F.col("p_name").alias("text"),
        F.array(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), name).alias("identifiers"),
    )
    q = p.groupBy(F.col("p_size").alias("qid")).agg(F.array_sort(F.collect_set(name)).alias("identifiers"))
    return c, q


@query(
    rf"""WITH {PART_SQL}, j AS (SELECT ord, list_aggregate(ids, 'string_agg', ' ') AS s FROM pc),
h AS (SELECT qid, t, ord, (length(s) - length(replace(s, t, '')))::DOUBLE / length(t) AS tf, length(s) - 2 AS l FROM j JOIN pq ON contains(s, t)),
df AS (SELECT qid, t, count(*) AS df FROM h GROUP BY ALL), st AS (SELECT count(*) AS n, sum(length(s) - 2) AS al FROM j),
b AS (SELECT qid, ord, round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l * n / al))), 6) AS score FROM h JOIN df USING (qid, t), st GROUP BY ALL)
SELECT * FROM (SELECT qid, ord, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank FROM b) WHERE rank <= 50"""
)
def trigram_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = _parts(spark, sf_dir)
    return search.trigram(c, q, F.col("identifiers"), 50).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    rf"""WITH {PART_SQL}, j AS (SELECT ord, list_aggregate(ids, 'string_agg', ' ') AS s FROM pc),
h AS (SELECT qid, t, ord, (length(s) - length(replace(s, t, '')))::DOUBLE / length(t) AS tf, length(s) - 2 AS l FROM j JOIN pq ON contains(s, t)),
df AS (SELECT qid, t, count(*) AS df FROM h GROUP BY ALL), st AS (SELECT count(*) AS n, sum(length(s) - 2) AS al FROM j),
b AS (SELECT qid, ord, round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l * n / al))), 6) AS score FROM h JOIN df USING (qid, t), st GROUP BY ALL),
x AS (SELECT qid, t, ord, len(ids) AS l FROM pc JOIN pq ON list_contains(ids, t)), xd AS (SELECT qid, t, count(*) AS df FROM x GROUP BY ALL), xs AS (SELECT count(*) AS n, avg(len(ids)) AS ml FROM pc),
e AS (SELECT qid, ord, round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * l / ml))), 6) AS score FROM x JOIN xd USING (qid, t), xs GROUP BY ALL),
p AS (SELECT qid, ord, 0.2::DOUBLE * score / max(score) OVER (PARTITION BY qid) AS s FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS r FROM b) WHERE r <= 50
 UNION ALL SELECT qid, ord, 0.6::DOUBLE * score / max(score) OVER (PARTITION BY qid) FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS r FROM e) WHERE r <= 50),
f AS (SELECT qid, ord, round(sum(s), 6) AS score FROM p GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank FROM f) WHERE rank <= 50"""
)
def keyword_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = _parts(spark, sf_dir)
    found = search.keyword_search(c, q.withColumn("question", F.array_join("identifiers", " ")), 50)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    f"""{ALL_SQL}, hits AS (SELECT DISTINCT qid, ord FROM keyword UNION SELECT DISTINCT qid, ord + 1 FROM keyword)
SELECT qid, ord, score FROM fused UNION ALL SELECT qid, ord, round(1.0::DOUBLE / 110, 9) FROM hits WHERE NOT EXISTS (SELECT 1 FROM fused f WHERE f.qid = hits.qid AND f.ord = hits.ord)"""
)
def identifier_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, k, _, fused = _fused(spark, sf_dir)
    hits = k.select("qid", "ord").unionByName(k.select("qid", (F.col("ord") + 1).alias("ord")))
    return search.identifier_floor(fused, hits)


# --- index tables


@query(
    """SELECT 'kind' AS what, CASE WHEN length(text) > 2000 THEN 'long' ELSE 'text' END AS name, count(*) AS n FROM documents GROUP BY ALL
UNION ALL SELECT 'embeddings', 'model' || label, count(*) FROM embeddings GROUP BY ALL"""
)
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "documents").select(F.when(F.length("text") > 2000, "long").otherwise("text").alias("kind"))
    e = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("model"), "label").alias("model"))
    return store.stats(c, e)


@query("SELECT DISTINCT source AS doc FROM documents")
def docs_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.docs(read(spark, sf_dir, "documents").select(F.col("source").alias("doc")))


@query(f"WITH {CHUNKS_SQL} SELECT ord, text FROM chunks WHERE doc = 'src3' AND page = 3")
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page_chunks(search.line_chunks(read(spark, sf_dir, "documents")), "src3", 3).select("ord", "text")


@query(
    """SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3) UNION ALL SELECT vec_id, max(label + 100) FROM embeddings WHERE label = 3 GROUP BY vec_id"""
)
def embedding_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    new = e.filter("label = 3").select("vec_id", (F.col("label") + 100).alias("label"))
    return store.upsert(e, new.unionByName(new.withColumn("label", F.col("label") - 1)), ["vec_id"])


@query("SELECT DISTINCT left(sha256(text), 32) AS hash FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en')")
def embedding_cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    cache = d.filter("lang = 'en'").select(T.content_hash(F.col("text"), 32).alias("hash"))
    return store.cache_misses(d, cache).select("hash")


@query("SELECT chunk_id, label FROM (SELECT 'c' || vec_id AS chunk_id, label, vec_id FROM embeddings) WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def embedding_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("c"), "vec_id").alias("chunk_id"), "label")
    kept = read(spark, sf_dir, "documents").filter("lang = 'en'").select(F.concat(F.lit("c"), "doc_id").alias("id"))
    return store.surviving(e, kept)


@query("SELECT DISTINCT identifier FROM (SELECT lower(replace(p_brand, '#', '')) AS identifier FROM part) WHERE identifier IN ('brand11', 'brand23', 'brand55')")
def identifier_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = values(spark, [("brand11",), ("brand23",), ("brand55",), ("brand99",)], "identifier string")
    return store.with_identifier(_parts(spark, sf_dir)[0], wanted)


# --- texts and chunks


@query(
    r"""WITH l AS (SELECT source AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS t FROM documents)
SELECT doc, key, count(*) AS n_pages FROM (SELECT DISTINCT doc, page, regexp_replace(trim(t, ' '), '\d+', '#', 'g') AS key FROM l WHERE length(t) < 80) GROUP BY ALL HAVING count(*) >= 3"""
)
def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    lines = d.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.lit("text").alias("kind"), F.explode(F.split("text", "\n")).alias("text"))
    return chunks.running_lines(lines)


@query()
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.packed_lines(search.line_chunks(read(spark, sf_dir, "documents")))


@query(
    r"""SELECT doc_id, (len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) * 1.33::DOUBLE)::DOUBLE AS raw, floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) * 1.33::DOUBLE)::INTEGER + 1 AS n_tokens FROM documents"""
)
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(T.words(F.col("text"))) * F.lit(T.TOKENS_PER_WORD)
    return read(spark, sf_dir, "documents").select("doc_id", n.cast("double").alias("raw"), T.n_tokens(F.col("text")).alias("n_tokens"))


@query(r"SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?'), lambda x: replace(x, ',', '')))) AS numbers FROM documents")
def numbers_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sort_array(T.numbers_in(F.col("text"))).alias("numbers"))


@query(
    r"""SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS norm, regexp_replace(replace(replace(lower(c_name), ' ', '-'), '/', '-'), '[^a-z0-9-]+', '', 'g') AS hyphen FROM customer"""
)
def norm_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_name")
    return read(spark, sf_dir, "customer").select("c_custkey", T.norm(c).alias("norm"), T.norm_hyphen(c).alias("hyphen"))


@query(
    rf"""SELECT conv_id, turn, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.''/-]*'), lambda x: length(x) > 1 AND NOT list_contains({STOP_SQL}, x)))) AS terms FROM conversations"""
)
def content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sort_array(T.content_terms(F.col("text"))).alias("terms"))


IDENTIFIER_TEXTS = [
    (1, "The EV-BMS-100 unit and FVT-ESC-40A", ["ev-bms-100", "evbms100", "fvt-esc-40a", "fvtesc40a"]),
    (2, "see US 8,485,576 B2 and Figure 3A", ["us8485576b2", "fig3a", "3a", "3 a"]),
    (3, "rated 320 A at 3.3 V", ["320a", "320 a", "33v", "3.3 v"]),
    (4, "component 160 of the gripper", ["ref160"]),
    (5, "nothing here", []),
]


@query(literal([(i, ids) for i, _, ids in IDENTIFIER_TEXTS if ids] , ["i", "identifiers"]))
def extract_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = values(spark, [(i, s) for i, s, _ in IDENTIFIER_TEXTS], "i int, s string")
    found = t.select("i", T.extract_identifiers(F.col("s"), F.array(F.lit("160"))).alias("identifiers"))
    return found.filter(F.size("identifiers") > 0)


PUNCT = '[\\.\\,;:!\\?\\(\\)\\[\\]\\{\\}"\'\'“”‘’«»…\\-–—/\\\\\\|\\*#&@\\^~`<>=\\+]'


@query(
    rf"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS r FROM documents),
s AS (SELECT doc_id, r, regexp_replace(regexp_replace(r, '^{PUNCT}+', ''), '{PUNCT}+$', '') AS t FROM w),
q AS (SELECT doc_id, NOT contains(r, '(cid:') AND NOT contains(t, '�') AND CASE WHEN regexp_full_match(t, '[\d.,:/%+\-−°×]+[A-Za-zµΩ°]{{0,4}}') THEN true
 WHEN regexp_full_match(t, '[A-Za-z][A-Za-z''\-]*') THEN CASE WHEN length(t) = 1 THEN t IN ('a', 'A', 'I') ELSE regexp_matches(t, '[aeiouyAEIOUY]') OR (NOT regexp_matches(t, '[a-z]') AND length(t) <= 6) END
 ELSE regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[0-9]') AND length(t) <= 12 END AS good FROM s WHERE t <> ''),
a AS (SELECT doc_id, round(avg(good::INTEGER::DOUBLE), 6) AS quality FROM q GROUP BY ALL)
SELECT d.doc_id, coalesce(quality, 0) AS quality, CASE WHEN length(trim(text, ' ')) < 30 THEN CASE WHEN doc_id % 2 = 0 OR length(trim(text, ' ')) = 0 THEN 'no_text_layer' END WHEN coalesce(quality, 0) < 0.6 THEN 'low_text_quality' END AS reason FROM documents d LEFT JOIN a USING (doc_id)"""
)
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(read(spark, sf_dir, "documents"))
    cover = F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.1)
    scored = d.select("doc_id", "text", T.text_quality(F.col("text")).alias("q"))
    return scored.select("doc_id", F.round("q", 6).alias("quality"), T.needs_ocr(F.col("text"), cover, F.col("q")).alias("reason"))


@query("SELECT p_partkey, 'Table: Parts | name: ' || p_name || ' | col2: ' || p_brand AS text FROM part")
def row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.array(F.lit("name"), F.lit(""), F.lit("size"))
    return read(spark, sf_dir, "part").select("p_partkey", T.table_row_text(F.lit("Parts"), header, F.array("p_name", "p_brand", F.lit(""))).alias("text"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.first_json(F.concat(F.lit("reply: "), "props", F.lit(" end")))
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"))


# --- typed tables


def _as_text(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return _as_text(o).withColumn("o_totalprice", F.when(F.col("o_orderkey").cast("bigint") % 50 == 0, "n/a").otherwise(F.col("o_totalprice")))


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(
    "SELECT 'o_orderkey' AS col, 'int' AS type, count(DISTINCT o_orderkey) AS n_distinct FROM orders UNION ALL SELECT 'o_custkey', 'int', count(DISTINCT o_custkey) FROM orders"
    " UNION ALL SELECT 'o_orderstatus', 'text', count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'o_totalprice', 'float', count(DISTINCT o_totalprice) FILTER (o_orderkey % 50 <> 0) FROM orders"
    " UNION ALL SELECT 'o_orderdate', 'date', count(DISTINCT o_orderdate::DATE) FROM orders UNION ALL SELECT 'o_orderpriority', 'text', count(DISTINCT o_orderpriority) FROM orders"
)
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.profile(_orders(spark, sf_dir)).select(F.col("column").alias("col"), "type", "n_distinct")


@query("SELECT 'o_orderstatus' AS col, list_sort(list(DISTINCT o_orderstatus)) AS samples FROM orders UNION ALL SELECT 'o_orderpriority', list_sort(list(DISTINCT o_orderpriority)) FROM orders UNION ALL SELECT 'o_orderdate', list_sort(list(DISTINCT strftime(o_orderdate, '%Y-%m-%d')))[1:3] FROM orders")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["o_orderstatus", "o_orderpriority", "o_orderdate"]
    return tables.profile(_orders(spark, sf_dir), wanted).select(F.col("column").alias("col"), "samples")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice END AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders")
def coerce_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "text", "o_totalprice": "float", "o_orderdate": "date"}
    return tables.coerce(_orders(spark, sf_dir).drop("o_orderpriority"), kinds)


@query("SELECT 'supplier.csv' AS doc, 'supplier' AS tbl, s_suppkey AS row, 'supplier row ' || s_suppkey || ': s_name=' || s_name || '; s_nationkey=' || s_nationkey AS text FROM supplier")
def structured_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("_row"), "s_name", "s_nationkey")
    return tables.row_texts(s, "supplier", "supplier.csv")


@query("SELECT 'supplier.csv#supplier#row' || s_suppkey AS id, 1 AS page, 'supplier.csv › supplier › row ' || s_suppkey AS prefix FROM supplier")
def structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.structured_chunks(structured_rows(spark, sf_dir)).select("id", "page", "prefix")


HEADER_ROWS = [
    ("bom", 0, ["Bill of materials", None, None, None]), ("bom", 1, ["Rev C", "2024", None, None]), ("bom", 2, [None, None, None, None]),
    ("bom", 3, ["Part Number", "Description", "Qty", None]), ("bom", 4, ["P-1", "bolt", "4", "1.5"]), ("num", 0, ["1", "2", "3", "4"]), ("num", 1, ["5", "6", "7", "8"]),
]


@query(literal([("bom", 3), ("num", 0)], ["tbl", "header"]))
def detect_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, HEADER_ROWS, "tbl string, n bigint, cells array<string>")
    return tables.header_row(rows).withColumn("header", F.col("header").cast("int"))


def _sql(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """A guarded statement over the tables, with all the rows it returns."""
    for t in ("lineitem", "part", "supplier", "orders"):
        read(spark, sf_dir, t).createOrReplaceTempView(t)
    return guard.whole(spark, statement)


SQL_STATEMENTS = {
    "sql_count": "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'",
    "sql_count_distinct": "SELECT count(DISTINCT l_partkey) AS n FROM lineitem",
    "sql_top1": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1",
    "sql_lookup": "SELECT p_name, p_brand FROM part WHERE p_partkey = 7",
    "sql_cte": "WITH t AS (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, q FROM t WHERE q > 1000",
    "sql_window": "SELECT s_suppkey, rank() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier",
    "sql_set": "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT p_size FROM part",
    "sql_join": "SELECT o_orderpriority, count(*) AS n, sum(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority",
    "sql_semi": "SELECT count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
}
for _name, _statement in SQL_STATEMENTS.items():
    QUERIES[_name] = lambda spark, sf_dir, s=_statement: _sql(spark, sf_dir, s)
    ORACLES[_name] = _statement


@query("SELECT true AS truncated, 25 AS n_rows")
def sql_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "part").createOrReplaceTempView("part")
    r = guard.query_sql(spark, "SELECT p_partkey FROM part", 25, 120.0)
    return values(spark, [(r.truncated, len(r.rows))], "truncated boolean, n_rows int")


GUARDED = [
    ("SELECT 1", True), ("select 1;", True), ("WITH x AS (SELECT 1 AS a) SELECT a FROM x", True), ("SELECT 'drop table x' AS s", True),
    ("DROP TABLE x", False), ("SELECT 1; SELECT 2", False), ("INSERT INTO x VALUES (1)", False), ("WITH x AS (SELECT 1) DELETE FROM t", False),
    ("SELECT replace('a', 'a', 'b')", False), ("SELECT ';'", False),
]


@query(literal(GUARDED, ["statement", "allowed"]))
def sql_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    def allowed(s: str) -> bool:
        try:
            guard.check_plan(spark, guard.check_text(s))
        except guard.SQLError:
            return False
        return True

    return values(spark, [(s, allowed(s)) for s, _ in GUARDED], "statement string, allowed boolean")


# --- numerals and figures

PATENT = [
    ("pat.pdf", 1, 1, "text", "body", "FIG. 1 is a perspective view of the gripper. FIG. 2 is a block diagram of the control system."),
    ("pat.pdf", 1, 2, "text", "body", "The wings 14, 16 and the valves 74 and 76 are driven by an electromagnet 120a."),
    ("pat.pdf", 2, 1, "text", "body", "A control unit 160 reads 10 Hz signals. The control unit 160 drives claim 12 and 16-bit data of 2019."),
    ("pat.pdf", 2, 2, "text", "footer", "Page 7 of gears 55"),
    ("memo.docx", 1, 1, "text", "body", "The motor 7 runs. The pump 9b stops."),
]
PATENT_SCHEMA = "doc string, page int, ord bigint, kind string, role string, text string"


@query(
    literal(
        [("memo.docx", "9b", "pump", [1], 1), ("pat.pdf", "120a", "electromagnet", [1], 1), ("pat.pdf", "14", "wings", [1], 1), ("pat.pdf", "16", "wings", [1], 1),
         ("pat.pdf", "160", "control unit", [2], 2), ("pat.pdf", "74", "valves", [1], 1), ("pat.pdf", "76", "valves", [1], 1)],
        ["doc", "numeral", "name", "pages", "count"],
    )
)
def reference_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numerals.numerals(values(spark, PATENT, PATENT_SCHEMA)).select("doc", "numeral", "name", "pages", "count")


@query(literal([("pat.pdf", "FIG. 1", 1, "perspective view of the gripper"), ("pat.pdf", "FIG. 2", 1, "block diagram of the control system")], ["doc", "fig_id", "page", "title"]))
def figure_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numerals.figure_definitions(values(spark, PATENT, PATENT_SCHEMA))


@query(literal([("pat.pdf", 1, ["14 = wings", "120a = electromagnet"])], ["doc", "page", "lines"]))
def figure_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = values(spark, [("pat.pdf", 1, n) for n in ("120a", "14", "999")], "doc string, page int, numeral string")
    return numerals.glossary(numerals.numerals(values(spark, PATENT, PATENT_SCHEMA)), wanted)


LABELS = [(1, ["60", "(14)", "17", "abc"], ["11", "14", "160"]), (2, ["20"], ["120", "220"]), (3, ["0"], ["8", "18"])]


@query(literal([(1, ["14"], ["11", "160"], []), (2, [], [], ["20"]), (3, [], ["8"], [])], ["i", "matched", "repaired", "unmatched"]).replace("[]", "[]::VARCHAR[]"))
def reconcile_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = values(spark, LABELS, "i int, tokens array<string>, defined array<string>")
    return t.select("i", numerals.reconciled(F.col("tokens"), F.col("defined")).alias("r")).select("i", "r.*")


CAPTIONS = [(1, "FIG. 2 — view"), (2, "Figure 3a. Text"), (3, "fig 12"), (4, "Table 1"), (5, "FIGURE 7: x")]


@query(literal([(1, "FIG. 2"), (2, "Figure 3A"), (3, "FIG. 12"), (4, None), (5, "Figure 7")], ["i", "fig"]))
def figure_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, CAPTIONS, "i int, c string").select("i", T.figure_id(F.col("c")).alias("fig"))


def _page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents: the first line a heading, other lines texts; doc ``source``, page ``doc_id``."""
    c = search.line_chunks(read(spark, sf_dir, "documents"))
    first = F.col("ord") % (1 << 20) == 0
    none = F.lit(None)
    return c.select(
        "doc", F.col("page").cast("int").alias("page"), "ord", F.lit("text").alias("kind"), F.when(first, "heading").otherwise("body").alias("role"), "text",
        none.cast("array<array<string>>").alias("cells"), none.cast("string").alias("title"), none.cast("string").alias("caption"), none.cast("string").alias("figure_id"),
    )


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_documents(_page_blocks(spark, sf_dir))


@query(
    f"""WITH {CHUNKS_SQL}, b AS (SELECT doc, page, ord, CASE WHEN ord % 1048576 = 0 THEN text END AS h FROM chunks)
SELECT doc, page, ord, last_value(h IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM b"""
)
def carried_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.sections(_page_blocks(spark, sf_dir)).select("doc", F.col("page").cast("bigint").alias("page"), "ord", "section")


@query(f"WITH {CHUNKS_SQL} SELECT doc, coalesce(arg_min(text, ord) FILTER (page = 1 AND ord % 1048576 = 0 AND length(text) > 3 AND length(text) < 120), doc) AS title FROM chunks GROUP BY doc")
def doc_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.titles(_page_blocks(spark, sf_dir))


@query(f"WITH {CHUNKS_SQL} SELECT doc, page, string_agg(CASE WHEN ord % 1048576 = 0 THEN '## ' || text ELSE text END, chr(10) || chr(10) ORDER BY ord) AS markdown FROM chunks GROUP BY ALL")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.to_markdown(_page_blocks(spark, sf_dir)).withColumn("page", F.col("page").cast("bigint"))


# --- routing

ROUTED = [
    (1, "What is labelled 160 in FIG. 2?", "numeral", "FIG. 2", ["160"], False), (2, "How many test runs failed?", "sql", None, [], False),
    (3, "What is the maximum discharge current?", "hybrid", None, [], False), (4, "What is component 204a?", "numeral", None, ["204a"], False),
    (5, "How many wings are shown in the figure?", "hybrid", None, [], True), (6, "What is the highest unit cost in the bill of materials?", "sql", None, [], False),
]


@query(literal([r[:1] + r[2:] for r in ROUTED], ["qid", "route", "fig_id", "numerals", "visual"]).replace("[]", "[]::VARCHAR[]"))
def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = values(spark, [r[:2] for r in ROUTED], "qid int, question string")
    known = F.array(*(F.lit(n) for n in ("160", "112", "18", "74")))
    return routing.parse(q, known).select("qid", "route", "fig_id", "numerals", "visual")


ALIAS_CHUNKS = [
    ("US8485576B2.pdf", 1, 1, ["fig1"]), ("EV-BMS-100_design_document.pdf", 1, 1, ["ev-bms-100", "evbms100"]), ("test_log.csv", 1, 1, ["ev-bms-100"]),
]
ALIAS_SCHEMA = "doc string, page int, ord bigint, identifiers array<string>"


@query(literal([("EV-BMS-100_design_document.pdf", ["design", "document", "evbms100"]), ("US8485576B2.pdf", ["8485576", "us8485576", "us8485576b2"]), ("test_log.csv", ["evbms100", "test"])], ["doc", "aliases"]))
def doc_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.doc_aliases(values(spark, ALIAS_CHUNKS, ALIAS_SCHEMA))


@query(literal([(1, "US8485576B2.pdf", []), (2, None, ["EV-BMS-100_design_document.pdf"]), (3, None, [])], ["qid", "doc", "doc_boost"]).replace("[]", "[]::VARCHAR[]"))
def doc_pin_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = values(spark, [(1, ["us8485576"]), (2, ["ev-bms-100", "evbms100"]), (3, ["fig2"])], "qid int, identifiers array<string>")
    return routing.resolve(q, routing.doc_aliases(values(spark, ALIAS_CHUNKS, ALIAS_SCHEMA)))


@query(literal([(1, "160", ["a.pdf", "b.pdf"]), (2, "160", ["b.pdf"]), (3, "12", ["a.pdf"])], ["qid", "numeral", "docs"]))
def numeral_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = values(spark, [(1, ["999", "160"], None), (2, ["160"], "b.pdf"), (3, ["12", "160"], None), (4, ["5"], None)], "qid int, numerals array<string>, doc string")
    e = values(spark, [("a.pdf", "160", "unit"), ("b.pdf", "160", "gear"), ("a.pdf", "12", "wing")], "doc string, numeral string, name string")
    return routing.numeral_lookup(q, e).select("qid", "numeral", "docs")


# --- evidence and answers


@query("SELECT l_orderkey % 500 AS table_id, list_sort(list(DISTINCT l_linenumber)) AS pages FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) > 1")
def split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("table_id"), F.col("l_linenumber").alias("page"))
    return answers.split_tables(t)


@query(
    "WITH i AS (SELECT c_nationkey AS qid, CASE c_custkey % 10 WHEN 0 THEN 'numeral' WHEN 1 THEN 'sql' ELSE 'chunk' END AS source, c_custkey AS place FROM customer)"
    " SELECT qid, place, 'e' || row_number() OVER (PARTITION BY qid ORDER BY CASE source WHEN 'numeral' THEN 0 WHEN 'sql' THEN 1 ELSE 2 END, place) AS eid FROM i"
)
def build_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("c_custkey") % 10 == 0, "numeral").when(F.col("c_custkey") % 10 == 1, "sql").otherwise("chunk")
    items = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("qid"), kind.alias("source"), F.col("c_custkey").alias("place"))
    return answers.build_evidence(items).select("qid", "place", "eid")


@query(literal([(1, ["a", "b"], [2, 1]), (2, ["a", "a"], [7, 8])], ["qid", "docs", "pages"]))
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, 1, "a", 2, None), (1, 2, "b", 1, None), (1, 3, "a", 2, None), (2, 1, "a", 7, [8])]
    c = answers.citations(values(spark, rows, "qid int, place int, doc string, page int, extra_pages array<int>"))
    return c.select("qid", F.transform("cites", lambda x: x["doc"]).alias("docs"), F.transform("cites", lambda x: x["page"]).alias("pages"))


EVIDENCE = [
    (1, "e1", "a.pdf", "text", "The current is 320 A at l2 V."), (2, "e1", "a.pdf", "text", "Four wings flap."), (3, "e1", "a.pdf", "text", "Nothing."),
    (4, "e1", "a.pdf", "text", "It weighs 5 kg."), (5, "e1", "a.pdf", "text", "x"), (6, "e1", "b.pdf", "sql_result", "7 rows"),
]
DRAFTS = [
    (1, "current?", "The current is 320 A at 12 V.", None, ["e1", "e9"], False), (2, "wings?", "There are four wings.", None, ["e1"], False),
    (3, "how much?", "It is 77.", None, ["e1"], False), (4, "weight?", "It weighs 5 kg.", "b.pdf", ["e1"], False), (5, "?", "", None, [], True), (6, "rows?", "7 rows", "a.pdf", ["e1"], False),
]


@query(literal([(1, True, False, []), (2, True, False, []), (3, False, True, ["77"]), (4, False, True, ["5"]), (5, True, True, []), (6, True, False, [])], ["qid", "ok", "not_found", "missing"]).replace("[]", "[]::VARCHAR[]"))
def verify_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = values(spark, DRAFTS, "qid int, question string, answer string, doc string, cited array<string>, declined boolean")
    e = values(spark, EVIDENCE, "qid int, eid string, doc string, kind string, text string")
    return answers.verify(d, e).select("qid", "ok", "not_found", "missing")


PAIRS_SQL = "p AS (SELECT a.conv_id, a.turn, a.text AS answer, q.text AS question FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    q = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return c.select("conv_id", "turn", F.col("text").alias("answer")).join(q, ["conv_id", "turn"])


OVERLAP_STOP = "[" + ", ".join(f"'{w}'" for w in T.OVERLAP_STOP_WORDS) + "]"


@query(
    rf"""WITH {PAIRS_SQL}, w AS (SELECT conv_id, turn, lower(question) AS q, list_filter(regexp_extract_all(lower(answer), '[a-z][a-z\-]{{3,}}'), lambda x: NOT list_contains({OVERLAP_STOP}, x)) AS ws FROM p)
SELECT conv_id, turn, CASE WHEN len(ws) > 0 THEN round(len(list_filter(ws, lambda x: contains(q, x) OR contains(q, regexp_replace(x, 's+$', ''))))::DOUBLE / len(ws), 6) END AS overlap FROM w"""
)
def content_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(T.content_overlap(F.col("answer"), F.col("question")), 6).alias("overlap"))


MATCHES = [(1, "320 A", "322 A", True), (2, "320 A", "330 A", False), (3, "15", "fifteen", True), (4, "two in the wings", "none", True), (5, "1,000", "1000 units", True), (6, "3 and 4", "3", False)]


@query(literal([(i, ok) for i, _, _, ok in MATCHES], ["i", "ok"]))
def nums_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = values(spark, [m[:3] for m in MATCHES], "i int, r string, a string")
    return t.select("i", T.nums_match(F.col("r"), F.col("a")).alias("ok"))


SCORED_SQL = r"""t AS (SELECT l.doc_id AS qid, d.lang AS type, d.source AS g, CASE WHEN l.doc_id % 4 = 0 THEN 'none' ELSE d.source END AS c, l.quality = 1 AS graded, l.toxic = 1 AS not_found, l.doc_id % 7 <> 0 AS answerable FROM labels l JOIN documents d USING (doc_id)),
s AS (SELECT qid, type, not_found, CASE WHEN answerable THEN true END AS retrieved, CASE WHEN answerable THEN g = c END AS page_hit, CASE WHEN answerable THEN NOT not_found END AS nums_ok, not_found = (NOT answerable) AS nf_ok,
CASE WHEN answerable THEN CASE WHEN g = c THEN 1.0::DOUBLE ELSE 0 END END AS citation_precision, CASE WHEN NOT answerable THEN not_found WHEN not_found THEN false ELSE graded END AS correct FROM t)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    cited = F.when(F.col("doc_id") % 4 == 0, "none").otherwise(F.col("source"))
    gold = F.when(F.col("doc_id") % 7 != 0, F.array("source")).otherwise(F.array().cast("array<string>"))
    rows = t.select(
        F.col("doc_id").alias("qid"), F.col("lang").alias("type"), gold.alias("gold"), F.array("source").alias("retrieved"), F.array(cited).alias("cited"),
        F.concat(F.lit("value "), "doc_id").alias("reference"), F.concat(F.lit("it is "), "doc_id").alias("answer"), (F.col("toxic") == 1).alias("not_found"), (F.col("quality") == 1).alias("graded"),
    )
    return answers.score(rows)


@query(f"WITH {SCORED_SQL} SELECT * FROM s")
def score_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


@query(
    f"""WITH {SCORED_SQL} SELECT coalesce(type, 'all') AS type, count(*) AS n, round(avg(correct::INTEGER::DOUBLE), 6) AS correct, round(avg(page_hit::INTEGER::DOUBLE), 6) AS page_hit, round(avg(nums_ok::INTEGER::DOUBLE), 6) AS nums_ok, round(avg(nf_ok::INTEGER::DOUBLE), 6) AS nf_ok,
round(avg(citation_precision), 6) AS citation_precision, sum(CASE WHEN correct THEN 1 WHEN not_found THEN 0 ELSE -2 END)::BIGINT AS penalty FROM s GROUP BY GROUPING SETS ((type), ())"""
)
def penalty_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.summary(_scored(spark, sf_dir))


@query(
    f"""WITH {SCORED_SQL} SELECT qid, CASE WHEN retrieved IS NULL THEN CASE WHEN NOT not_found THEN 'abstention' END WHEN correct AND page_hit THEN 'none' WHEN correct THEN 'citation' WHEN qid % 5 = 0 THEN 'extraction' WHEN not_found THEN 'abstention' ELSE 'generation' END AS stage FROM s"""
)
def attribute_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    stage = answers.failure_stage(F.col("retrieved").isNotNull(), F.col("correct"), F.col("page_hit"), F.col("retrieved"), F.col("qid") % 5 != 0, F.col("not_found"))
    return s.select("qid", stage.alias("stage"))


@query(literal([(1, True), (2, True), (3, False), (4, True)], ["id", "handled"]))
def adversarial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "count", "no such thing", True, False, False, False), (2, "count", "There are zero.", False, False, True, False), (3, "count", "Five.", False, False, True, False), (4, "visual", "It is red", False, True, False, True)]
    t = values(spark, rows, "id int, category string, answer string, not_found boolean, visual boolean, accept_zero boolean, accept_visual boolean")
    return answers.adversarial(t).select("id", "handled")


# --- layout

BOX_SQL = "b AS (SELECT l_orderkey AS page, l_linenumber AS n, (l_partkey % 500)::DOUBLE AS x0, (l_suppkey % 70 * 10)::DOUBLE AS y0, (l_partkey % 500 + 20 + l_quantity * 3)::DOUBLE AS x1, (l_suppkey % 70 * 10 + 12 + l_linenumber)::DOUBLE AS y1 FROM lineitem)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "lineitem")
    x0, y0 = F.col("l_partkey") % 500, F.col("l_suppkey") % 70 * 10
    t = t.select(F.lit("d").alias("doc"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), x0.alias("x0"), y0.alias("y0"), (x0 + 20 + F.col("l_quantity") * 3).alias("x1"), (y0 + 12 + F.col("l_linenumber")).alias("y1"))
    return t.select("doc", "page", "n", layout.box("x0", "y0", "x1", "y1").alias("bbox"))


@query(
    f"""WITH {BOX_SQL}, p AS (SELECT a.page, a.n AS n1, c.n AS n2, greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) AS s FROM b a JOIN b c ON a.page = c.page AND a.n < c.n)
SELECT page, n1, n2, round(i / (s - i), 6) AS iou FROM p WHERE i > 0"""
)
def bbox_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    a, c = b.select("page", F.col("n").alias("n1"), F.col("bbox").alias("a")), b.select("page", F.col("n").alias("n2"), F.col("bbox").alias("c"))
    t = a.join(c, "page").filter("n1 < n2").select("page", "n1", "n2", F.round(layout.iou(F.col("a"), F.col("c")), 6).alias("iou"))
    return t.filter("iou > 0")


@query(
    f"""WITH {BOX_SQL}, f AS (SELECT * FROM b WHERE n = 1), c AS (SELECT * FROM b WHERE n > 1),
k AS (SELECT f.page, c.n, least(f.x1, c.x1) - greatest(f.x0, c.x0) AS h, c.y0 - f.y1 AS below, f.y0 - c.y1 AS above FROM f JOIN c USING (page)),
s AS (SELECT page, n, CASE WHEN below >= -2 THEN below ELSE above END AS gap, CASE WHEN below >= -2 THEN 0 ELSE 30 END AS pen FROM k WHERE h > 0)
SELECT page, arg_min('c' || n, struct_pack(s := gap + pen, n := n)) AS caption FROM s WHERE gap >= -2 AND gap <= 90 GROUP BY page"""
)
def nearest_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    fig = b.filter("n = 1").select("doc", "page", F.col("n").alias("fig"), "bbox")
    text = b.filter("n > 1").select("doc", "page", F.col("n").alias("ord"), F.lit("caption").alias("role"), F.concat(F.lit("c"), "n").alias("text"), "bbox")
    return layout.captions(fig, text).select("page", "caption")


@query(
    f"""WITH {BOX_SQL} SELECT page, n FROM b x WHERE n > 2 AND NOT EXISTS (SELECT 1 FROM b t WHERE t.n = 1 AND t.page = x.page AND (x.x0 + x.x1) / 2 BETWEEN t.x0 - 2 AND t.x1 + 2 AND (x.y0 + x.y1) / 2 BETWEEN t.y0 - 2 AND t.y1 + 2)"""
)
def text_inside_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    return layout.outside_tables(b.filter("n > 2"), b.filter("n = 1")).select("page", "n")


@query(
    f"""WITH {BOX_SQL}, t AS (SELECT *, max(x1) OVER (PARTITION BY page) - min(x0) OVER (PARTITION BY page) AS w FROM b), m AS (SELECT *, max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t WHERE x1 - x0 < 0.62 * w),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR x0 > before + 12 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM m),
f AS (SELECT page, min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY page, g HAVING max(x1) - min(x0) > 0.15 * any_value(w)),
e AS (SELECT page, min(x0) AS x0, max(x1) AS x1 FROM b WHERE page NOT IN (SELECT page FROM f) GROUP BY page), u AS (SELECT * FROM f UNION ALL SELECT * FROM e)
SELECT page, (row_number() OVER (PARTITION BY page ORDER BY x0, x1) - 1)::INTEGER AS col, x0, x1 FROM u"""
)
def detect_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.columns(_boxes(spark, sf_dir)).select("page", "col", "x0", "x1")


TWO_COLUMNS = [("TITLE", 50.0, 40.0, 550.0, 60.0), ("L1", 50.0, 80.0, 290.0, 100.0), ("L2", 50.0, 110.0, 290.0, 130.0), ("L3", 50.0, 140.0, 290.0, 160.0), ("R1", 310.0, 80.0, 550.0, 100.0), ("R2", 310.0, 110.0, 550.0, 130.0), ("R3", 310.0, 140.0, 550.0, 160.0)]


@query(literal([("TITLE", 1), ("L1", 2), ("L2", 3), ("L3", 4), ("R1", 5), ("R2", 6), ("R3", 7)], ["id", "place"]))
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = values(spark, TWO_COLUMNS[::-1], "id string, x0 double, y0 double, x1 double, y1 double")
    t = t.select(F.lit("d").alias("doc"), F.lit(1).alias("page"), "id", layout.box("x0", "y0", "x1", "y1").alias("bbox"))
    return layout.reading_order(t).select("id", "place")


@query(literal([("t", 0, ["A", "B"]), ("t", 1, ["one", "two more words"]), ("t", 3, ["three", ""])], ["tbl", "n", "cells"]))
def merge_continuation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("t", 0, ["A", "B"]), ("t", 1, ["one", "two"]), ("t", 2, ["", "more words"]), ("t", 3, ["three", ""])]
    return layout.continuation_rows(values(spark, rows, "tbl string, n int, cells array<string>"))


ROLES = [("FIG. 2 — view", 10.0, False, 20.0, 30.0), ("running head", 10.0, False, 20.0, 30.0), ("3.2 Thermal", 10.0, True, 300.0, 310.0), ("A LARGE TITLE", 16.0, False, 300.0, 320.0), ("plain text", 10.0, False, 300.0, 310.0), ("page 3", 9.0, False, 780.0, 790.0)]


@query(literal([("FIG. 2 — view", "caption"), ("running head", "header"), ("3.2 Thermal", "heading"), ("A LARGE TITLE", "heading"), ("plain text", "body"), ("page 3", "footer")], ["text", "role"]))
def block_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = values(spark, ROLES, "text string, size double, bold boolean, y0 double, y1 double").withColumns({"x0": F.lit(0.0), "x1": F.lit(100.0)})
    return t.select("text", layout.role(F.col("text"), F.col("size"), F.col("bold"), layout.box("x0", "y0", "x1", "y1"), F.lit(10.0), F.lit(800.0)).alias("role"))


@query("SELECT l_orderkey AS page, quantile_cont(l_quantity, 0.5) AS body FROM lineitem, range(0, greatest(1, l_linenumber * 30 // 40)) GROUP BY 1")
def body_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc"), F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("size"), F.repeat(F.lit("x"), (F.col("l_linenumber") * 30).cast("int")).alias("text"))
    return layout.body_size(t).select("page", "body")


# --- metrics


@query(f"WITH {PAIRS_SQL} SELECT conv_id, turn, round(levenshtein(regexp_replace(question, '[^ -~]', '?', 'g'), regexp_replace(answer, '[^ -~]', '?', 'g'))::DOUBLE / greatest(length(question), 1), 6) AS cer FROM p")
def cer_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.cer(_plain("question"), _plain("answer")), 6).alias("cer"))


def _plain(column: str):
    """Other characters than ASCII as question marks: the SQL's edit distance counts bytes."""
    return F.regexp_replace(column, "[^ -~]", "?")


@query("SELECT a.p_partkey AS i, round(1 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)), 6) AS s FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(q, "p_partkey").select(F.col("p_partkey").alias("i"), F.round(T.similarity(F.col("p_name"), F.col("other")), 6).alias("s"))


@query(
    "WITH a AS (SELECT l_orderkey AS doc, l_linenumber AS n, l_suppkey AS pos, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS nx FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_suppkey))"
    " SELECT doc, count(*) FILTER (nx > pos) AS right_, count(*) AS pairs FROM a WHERE nx IS NOT NULL GROUP BY doc"
)
def pair_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n")).agg(F.min("l_suppkey").alias("pos"))
    return metrics.order_accuracy(t).withColumnRenamed("right", "right_")


@query(literal([("same", 1.0), ("one cell", 0.928571), ("words", 0.5)], ["name", "value"]))
def tree_and_word_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = "<table><tr><td>aaaa</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>"
    rows = [("same", a, a), ("one cell", a, a.replace("aaaa", "aabb").replace("<td>d</td>", "<td>d</td>").replace("aabb", "aa")), ("words", "one two three four", "one three five")]
    t = values(spark, rows, "name string, a string, b string")
    value = F.when(F.col("name") == "words", metrics.wer("a", "b")).otherwise(metrics.teds("a", "b"))
    return t.select("name", F.round(value, 6).alias("value"))


@query(literal([("d", 3, 4)], ["doc", "right_", "cells"]))
def table_cell_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = values(spark, [("d", 1, ["Current", "320 A"]), ("d", 2, ["Voltage", "12 V"])], "doc string, row int, cells array<string>")
    f = values(spark, [("d", 1, ["current", "320  a"]), ("d", 2, ["Voltages", "12 V"])], "doc string, frow int, cells array<string>")
    return metrics.cell_accuracy(g, f).select("doc", F.col("right").cast("int").alias("right_"), F.col("cells").cast("int").alias("cells"))


@query("SELECT 0.583333::DOUBLE AS label_recall, 2 AS n")
def figure_label_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = values(spark, [(["1", "2", "3"], ["1", "2"]), (["4", "5"], ["5"]), ([], ["9"])], "gold array<string>, found array<string>")
    return metrics.label_recall(t).withColumn("n", F.col("n").cast("int"))


@query(f"WITH {BOX_SQL}, g AS (SELECT * FROM b WHERE n = 1), f AS (SELECT page, x0 + 5 AS x0, y0 + 3 AS y0, x1, y1 FROM b WHERE n = 1) SELECT (SELECT count(*) FROM g) AS n, (SELECT count(*) FROM g WHERE EXISTS (SELECT 1 FROM f WHERE f.page = g.page AND greatest(least(g.x1, f.x1) - greatest(g.x0, f.x0), 0) * greatest(least(g.y1, f.y1) - greatest(g.y0, f.y0), 0) / ((g.x1 - g.x0) * (g.y1 - g.y0) + (f.x1 - f.x0) * (f.y1 - f.y0) - greatest(least(g.x1, f.x1) - greatest(g.x0, f.x0), 0) * greatest(least(g.y1, f.y1) - greatest(g.y0, f.y0), 0)) >= 0.5)) AS hit")
def figure_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir).filter("n = 1")
    moved = b.select("doc", "page", F.struct((F.col("bbox.x0") + 5).alias("x0"), (F.col("bbox.y0") + 3).alias("y0"), F.col("bbox.x1").alias("x1"), F.col("bbox.y1").alias("y1")).alias("bbox"))
    return metrics.figure_recall(b.withColumnRenamed("n", "fig"), moved)


# --- sources, engine, streams


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.sources import files

    return files.read_html(read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), "html"))


@query()
def ask_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.plans import engine

    c = search.line_chunks(read(spark, sf_dir, "documents")).withColumn("identifiers", T.extract_identifiers(F.col("text")))
    return engine.ask(_questions(spark, sf_dir), c)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.streaming import ingest

    e = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    t = ingest.windowed_counts(e)
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT left(sha256(text), 32) AS hash FROM documents GROUP BY text")
def stream_new_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.streaming import ingest

    return ingest.new_texts(read(spark, sf_dir, "documents"), None).select("hash")
