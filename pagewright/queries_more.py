"""More queries for the driver, with their SQL: placement in rendered pages, figures, numerals, corpora, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import chunks, layout, metrics, numerals, placement, search, store, tables
from pagewright.queries import BOX_SQL, CHUNKS_SQL, SCORED_SQL, _as_text, _boxes, _questions, _scored, literal, query, read, spread, values

# --- placement

TURNS_SQL = r"t AS (SELECT conv_id AS doc, turn AS n, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS x, regexp_replace(coalesce(text, ''), '\s+', ' ', 'g') AS body FROM conversations)"


@query(
    rf"""WITH RECURSIVE {TURNS_SQL}, w AS (SELECT doc, n, string_split(x, ' ') AS ws FROM t),
p AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY n) AS k, n, array_to_string(ws[1:8], ' ') AS a, array_to_string(ws[1:5], ' ') AS b, array_to_string(ws[1:3], ' ') AS c FROM w WHERE n % 2 = 0),
g AS (SELECT doc, n + 1 AS page, body FROM t),
m AS MATERIALIZED (SELECT p.doc, k, n, page, CASE WHEN contains(body, a) AND length(a) >= 4 THEN 0 WHEN contains(body, b) AND length(b) >= 4 THEN 1 WHEN contains(body, c) AND length(c) >= 4 THEN 2 END AS tier FROM p JOIN g USING (doc)),
r AS (SELECT doc, 0::BIGINT AS k, 0::BIGINT AS n, 0::BIGINT AS cur, NULL::BIGINT AS page FROM (SELECT DISTINCT doc FROM p)
 UNION ALL SELECT p.doc, p.k, p.n, coalesce((SELECT arg_min(m.page, m.tier * 1000000 + m.page) FROM m WHERE m.doc = p.doc AND m.k = p.k AND m.page >= r.cur AND m.tier IS NOT NULL), r.cur),
 (SELECT arg_min(m.page, m.tier * 1000000 + m.page) FROM m WHERE m.doc = p.doc AND m.k = p.k AND m.page >= r.cur AND m.tier IS NOT NULL) FROM r JOIN p ON p.doc = r.doc AND p.k = r.k + 1)
SELECT doc, n, page::INTEGER AS page FROM r WHERE k > 0"""
)
def page_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("n"), "text")
    return placement.locate(c.filter("n % 2 = 0"), c.select("doc", (F.col("n") + 1).alias("page"), "text"))


@query(
    """WITH r AS (SELECT l_orderkey AS doc, l_linenumber AS n, CASE WHEN l_suppkey % 3 > 0 THEN (l_suppkey % 2 + 1)::INTEGER END AS page FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_suppkey)),
f AS (SELECT doc, n, coalesce(last_value(page IGNORE NULLS) OVER (PARTITION BY doc ORDER BY n), 1) AS page FROM r), g AS (SELECT *, CASE WHEN lag(page) OVER (PARTITION BY doc ORDER BY n) = page THEN 0 ELSE 1 END AS new FROM f),
p AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY n) AS piece FROM g) SELECT doc, piece::BIGINT AS piece, any_value(page) AS page, min(n) AS first_row, max(n) AS last_row, piece > 1 AS continued FROM p GROUP BY doc, piece"""
)
def table_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n")).agg(F.min("l_suppkey").alias("s"))
    return placement.table_pieces(one.select("doc", "n", F.when(F.col("s") % 3 > 0, (F.col("s") % 2 + 1).cast("int")).alias("page")))


@query(
    """WITH h AS (SELECT source AS doc, doc_id AS n, CASE doc_id % 5 WHEN 0 THEN 200.0 WHEN 1 THEN 16.0 * (n_chars % 7) ELSE 14.0 * (length(coalesce(text, '')) // 95 + 1) END::DOUBLE AS height FROM documents)
SELECT doc, n, round(72.0::DOUBLE + coalesce(sum(height + 6) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS y0, height FROM h"""
)
def flow_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 5 == 0, "image").when(F.col("doc_id") % 5 == 1, "table").otherwise("text")
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("n"), placement.flow_height(kind, F.col("text"), F.col("n_chars") % 7).alias("height"))
    return placement.flow(d, 72.0, 50.0, 550.0).select("doc", "n", F.round("bbox.y0", 3).alias("y0"), "height")


@query(
    f"""WITH {BOX_SQL}, o AS (SELECT o_custkey AS doc, o_orderkey AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
i AS (SELECT page % 100 AS doc, page, n AS at, x0, row_number() OVER (PARTITION BY page % 100 ORDER BY page, n, x0) AS k FROM (SELECT page, n, min(x0) AS x0 FROM b GROUP BY page, n)) SELECT doc, o.n, page, x0 FROM o LEFT JOIN i USING (doc, k)"""
)
def next_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _boxes(spark, sf_dir).groupBy("page", F.col("n").alias("at")).agg(F.min("bbox.x0").cast("double").alias("x0"))
    images = images.select((F.col("page") % 100).alias("doc"), "page", "at", "x0")
    items = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("n"))
    return placement.next_images(items, images).select("doc", "n", "page", "x0")


SCAN_SQL = f"""{BOX_SQL}, s AS (SELECT page, n, (x0 / 250)::INTEGER AS col, CASE WHEN n = 1 THEN 'caption' ELSE 'body' END AS role, CASE WHEN n = 2 THEN 'Figure 7' ELSE repeat('word ', (x1 - x0)::INTEGER % 17) END AS text, x0, y0, x1, y1 FROM (SELECT DISTINCT ON (page, n) * FROM b ORDER BY page, n, x0, y0, x1))"""


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir).groupBy("doc", "page", F.col("n").alias("ord")).agg(F.min("bbox").alias("bbox"))
    words = F.repeat(F.lit("word "), (F.col("bbox.x1") - F.col("bbox.x0")).cast("int") % 17)
    text = F.when(F.col("ord") == 2, "Figure 7").otherwise(words)
    return b.withColumns({"col": F.rint(F.col("bbox.x0") / 250).cast("int"), "role": F.when(F.col("ord") == 1, "caption").otherwise("body"), "text": text})


@query(
    rf"""WITH {SCAN_SQL}, c AS (SELECT * FROM s WHERE role = 'caption'),
a AS (SELECT c.page, c.x0 AS cx0, c.y0 AS cy0, c.x1 AS cx1, coalesce(max(o.y1) FILTER (o.n <> c.n AND o.y1 <= c.y0 AND len(list_filter(string_split(o.text, ' '), lambda x: x <> '')) >= 8 AND c.y0 - o.y1 > 60), 0) + 4 AS top,
min(o.x0) FILTER (o.n <> c.n AND o.y1 <= c.y0) AS l, max(o.x1) FILTER (o.n <> c.n AND o.y1 <= c.y0) AS r FROM c LEFT JOIN s o ON o.page = c.page AND o.col = c.col GROUP BY ALL)
SELECT page, greatest(0, least(coalesce(l, cx0), cx0) - 4) AS x0, top AS y0, least(600, greatest(coalesce(r, cx1), cx1) + 4) AS x1, cy0 - 2 AS y1 FROM a WHERE cy0 - top >= 60"""
)
def scan_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.scan_figures(_scan(spark, sf_dir), F.lit(600.0)).select("page", "bbox.*")


@query(f"WITH {BOX_SQL} SELECT page, n, x0, 800 - y1 AS y0, x1, 800 - y0 AS y1, x1 - x0 AS w, y1 - y0 AS h, (x0 + x1) / 2 AS cx, 800 - (y0 + y1) / 2 AS cy FROM b")
def layout_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir).withColumn("t", placement.from_bottom_left(F.col("bbox"), F.lit(800.0)))
    t = F.col("t")
    return b.select("page", "n", "t.*", layout.width(t).alias("w"), layout.height(t).alias("h"), layout.cx(t).alias("cx"), layout.cy(t).alias("cy"))


@query("SELECT o_orderkey AS i, CASE WHEN o_custkey % 2 = 0 THEN [o_orderstatus, o_orderpriority] ELSE [o_orderstatus, o_orderstatus, o_orderpriority] END AS cells FROM orders")
def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    ids = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit(1), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(3), F.lit(2)))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), placement.unmerged(F.array(F.concat(F.lit(" "), s), s, p), ids).alias("cells"))


@query("SELECT conv_id AS doc, turn AS n, arg_min(w, struct_pack(l := -length(w), k := k)) AS needle FROM (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), '.')) AS w, generate_subscripts(string_split(coalesce(text, ''), '.'), 1) AS k FROM conversations) GROUP BY ALL HAVING max(length(w)) >= 12")
def row_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("n"), F.split(F.coalesce("text", F.lit("")), r"\.").alias("cells"))
    return c.select("doc", "n", placement.row_needle(F.col("cells")).alias("needle")).filter("needle is not null")


# --- figures and numerals


@query(
    """WITH f AS (SELECT page, min(n) AS any_, min(n) FILTER (fid = want OR starts_with(cap, lower(o_orderstatus))) AS own FROM (SELECT o_orderkey AS page, o_orderstatus, 'FIG. ' || (o_orderkey % 4 + 1) AS want FROM orders)
LEFT JOIN (SELECT l_orderkey AS page, l_linenumber AS n, 'FIG. ' || l_linenumber AS fid, lower(l_returnflag) AS cap FROM lineitem) USING (page) GROUP BY page) SELECT page, coalesce(own, any_) AS ord FROM f"""
)
def match_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = read(spark, sf_dir, "orders").select(F.lit("d").alias("doc"), F.col("o_orderkey").alias("page"), F.lit(1).alias("gid"), F.concat(F.lit("FIG. "), F.col("o_orderkey") % 4 + 1).alias("figure_id"), F.col("o_orderstatus").alias("caption"))
    found = read(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("FIG. "), "l_linenumber").alias("figure_id"), F.col("l_returnflag").alias("caption"))
    return metrics.match_figures(gold, found).select("page", "ord")


def _figure_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").filter("p_size % 2 = 0")
    return p.groupBy(F.col("p_brand").alias("doc"), F.concat(F.lit("FIG. "), F.col("p_size") % 7).alias("fig_id")).agg(F.min("p_name").alias("title"))


@query(
    """WITH f AS (SELECT p_brand AS doc, 'FIG. ' || (p_size % 7) AS fig_id, min(p_name) AS title FROM part WHERE p_size % 2 = 0 GROUP BY ALL)
SELECT p_partkey AS qid, title AS figure_title FROM part LEFT JOIN f ON doc = p_brand AND fig_id = 'FIG. ' || (p_partkey % 9)"""
)
def numeral_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), F.array("p_brand").alias("docs"), F.concat(F.lit("fig. "), F.col("p_partkey") % 9).alias("fig_id"))
    return numerals.with_figures(hits, _figure_defs(spark, sf_dir)).select("qid", "figure_title")


@query(
    """WITH l AS (SELECT p_brand AS doc, 'FIG. ' || (p_size % 7) AS fig_id, arg_min(list_sort([p_size, p_size + 1]), p_partkey) AS labels FROM part GROUP BY ALL)
SELECT p_partkey AS qid, list_contains(labels, p_size) AS seen FROM part LEFT JOIN l ON doc = p_brand AND fig_id = 'FIG. ' || (p_partkey % 9)"""
)
def numeral_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    figures = p.select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("ord"), F.concat(F.lit("FIG. "), F.col("p_size") % 7).alias("fig_id"), F.array("p_size", F.col("p_size") + 1).alias("labels"))
    hits = p.select(F.col("p_partkey").alias("qid"), F.col("p_brand").alias("doc"), F.concat(F.lit("FIG. "), F.col("p_partkey") % 9).alias("fig_id"), F.col("p_size").alias("numeral"))
    return numerals.seen_in_figure(hits, figures)


@query(
    """WITH e AS (SELECT p_brand AS doc, p_size::VARCHAR AS numeral, min(p_type) AS name FROM part GROUP BY ALL), f AS (SELECT p_brand AS doc, 'FIG. ' || (p_size % 7) AS fig_id, min(p_name) AS title FROM part WHERE p_size % 2 = 0 GROUP BY ALL)
SELECT p_partkey AS ord, array_to_string(list_filter(['FIG. ' || (p_partkey % 9) || ': ' || p_name, CASE WHEN NOT contains(lower(p_name), lower(title)) THEN 'Description: ' || title END, CASE WHEN e.name IS NOT NULL THEN 'Labels: ' || p_size END, p_size || ' = ' || e.name], lambda x: x IS NOT NULL), ' | ') AS text
FROM part LEFT JOIN f ON f.doc = p_brand AND fig_id = 'FIG. ' || (p_partkey % 9) LEFT JOIN e ON e.doc = p_brand AND e.numeral = p_size::VARCHAR"""
)
def figure_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    entries = p.groupBy(F.col("p_brand").alias("doc"), size.alias("numeral")).agg(F.min("p_type").alias("name")).withColumn("pages", F.array(F.lit(2)))
    blocks = p.select(F.col("p_brand").alias("doc"), F.lit(1).alias("page"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("caption"), F.concat(F.lit("FIG. "), F.col("p_partkey") % 9).alias("figure_id"), F.array(size).alias("labels"), F.lit(None).cast("string").alias("description"))
    return chunks.figure_chunks(blocks, _figure_defs(spark, sf_dir), entries).select("ord", "text")


@query(
    """SELECT p_partkey AS i, p_name || ' | Parts: ' || p_size || ' = ' || p_brand || ' | Counts: ' || p_size || ' bolts | Connections: ' || array_to_string(list_transform(range(least(12, p_size)), lambda x: 'c' || x), '; ') || ' | Visible text: ' || array_to_string(list_transform(range(least(40, p_size)), lambda x: 'w' || x), ' ') AS text FROM part WHERE p_size > 0
UNION ALL SELECT -p_partkey, NULL FROM part WHERE p_size > 0"""
)
def description_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(read(spark, sf_dir, "part")).filter("p_size > 0")
    many = lambda mark: F.transform(F.sequence(F.lit(0), F.col("p_size") - 1), lambda x: F.concat(F.lit(mark), x.cast("string")))
    reply = F.to_json(
        F.struct(
            F.col("p_name").alias("summary"), F.array(F.struct(F.col("p_size").alias("label"), F.col("p_brand").alias("name"))).alias("labelled_parts"),
            F.array(F.struct(F.col("p_size").alias("count"), F.lit("bolts").alias("item"))).alias("counts"), many("c").alias("connections"), many("w").alias("visible_text"),
        )
    )
    t = p.select(F.col("p_partkey").alias("i"), F.concat(F.lit("Here: "), reply).alias("r")).unionByName(p.select((-F.col("p_partkey")).alias("i"), F.lit("no object").alias("r")))
    return t.select("i", T.description_text(F.col("r")).alias("text"))


GRADES = [(1, '{"correct": true, "reason": "same"}', None, True), (2, 'Sure: {"correct": false}', "CORRECT", False), (3, "prose", " correct.", True), (4, "prose", "INCORRECT", False), (5, "prose", None, False)]


@query(literal([(g[0], g[3]) for g in GRADES], ["i", "correct"]))
def grader_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = values(spark, [g[:3] for g in GRADES], "i int, reply string, word string")
    return t.select("i", T.graded(F.col("reply"), F.col("word")).alias("correct"))


@query("SELECT p_brand AS doc, p_size::VARCHAR AS numeral, min(p_name) AS name, list_sort(list(DISTINCT p_partkey % 5 + 1)) AS pages, count(*) AS count FROM part GROUP BY ALL")
def numeral_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.session import scratch

    p = read(spark, sf_dir, "part")
    entries = p.groupBy(F.col("p_brand").alias("doc"), F.col("p_size").cast("string").alias("numeral")).agg(
        F.min("p_name").alias("name"), F.array_sort(F.collect_set(F.col("p_partkey") % 5 + 1)).alias("pages"), F.count(F.lit(1)).alias("count")
    )
    path = scratch(spark, "numerals")
    numerals.save(entries.withColumn("variants", F.array().cast("array<string>")), _figure_defs(spark, sf_dir), path)
    return numerals.load(spark, path)[0].select("doc", "numeral", "name", "pages", "count")


# --- corpora and vectors


@query(
    f"""WITH {CHUNKS_SQL}, u AS (SELECT doc, page, ord AS place, '' AS id, text FROM chunks UNION ALL SELECT 'supplier.csv', 1, s_suppkey, '', s_name FROM supplier)
SELECT row_number() OVER (ORDER BY doc, page, place) - 1 AS ord, doc, text FROM u"""
)
def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    prose = search.line_chunks(read(spark, sf_dir, "documents")).withColumn("place", F.col("ord")).drop("ord")
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("supplier.csv").alias("doc"), F.lit(1).cast("bigint").alias("page"), F.col("s_name").alias("text"), F.col("s_suppkey").alias("place"))
    return store.corpus(prose, s).select("ord", "doc", "text")


@query(
    r"""WITH q AS (SELECT item_id AS qid, embedding::DOUBLE[] AS q, CASE WHEN item_id % 2 = 0 THEN 'label' || label END AS lone FROM benchmark JOIN embeddings ON vec_id = item_id), v AS (SELECT vec_id AS ord, 'label' || label AS doc, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT qid, ord, round(list_inner_product(q, v) / ((sqrt(list_inner_product(q, q)) + 1e-9) * (sqrt(list_inner_product(v, v)) + 1e-9)), 6) AS score FROM q JOIN v ON lone IS NULL OR lone = doc)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank FROM s) WHERE rank <= 10"""
)
def dense_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.concat(F.lit("label"), "label").alias("doc"), F.col("embedding").alias("vec"))
    q = _questions(spark, sf_dir).join(e.withColumnRenamed("ord", "qid"), "qid").select("qid", "vec", F.when(F.col("qid") % 2 == 0, F.col("doc")).alias("only"))
    return search.dense_search(e, q, 10, doc="only").withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT DISTINCT 'model' || label AS model FROM embeddings")
def embedding_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.models(read(spark, sf_dir, "embeddings").select(F.concat(F.lit("model"), "label").alias("model")))


@query(f"WITH {CHUNKS_SQL} SELECT doc, page, ord, text FROM chunks ORDER BY ord")
def ordered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.all_chunks(search.line_chunks(read(spark, sf_dir, "documents"))).select("doc", "page", "ord", "text")


@query(f"WITH {CHUNKS_SQL} SELECT ord / 1048576 / 50 AS place, ord, text FROM chunks WHERE ord % 1048576 = 0 AND (ord // 1048576) % 50 = 0")
def lookup_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = search.line_chunks(read(spark, sf_dir, "documents"))
    first = (F.col("ord") % (1 << 20) == 0) & (F.col("page") % 50 == 0)
    ids = c.filter(first).select((F.col("page") / 50).alias("place"), "id").unionByName(values(spark, [(-1.0, "missing")], "place double, id string"))
    return store.by_ids(c.drop("place"), ids).select("place", "ord", "text")


@query(
    """WITH t AS (SELECT s_suppkey::VARCHAR AS a, s_name AS b, s_nationkey::VARCHAR AS c FROM supplier)
SELECT 0 AS n, 'TABLE "supplier"  -- source file: supplier.csv, ' || count(*) || ' rows; column _row = 1-based source row number' AS head, '  "s_suppkey" INTEGER  -- ' || count(DISTINCT a) || ' distinct' AS first, '  "s_name" TEXT  -- ' || count(DISTINCT b) || ' distinct' AS second, '  "s_nationkey" INTEGER  -- ' || count(DISTINCT c) || ' distinct' AS third FROM t"""
)
def schema_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _as_text(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"))
    p = tables.profile(s).withColumns({"tbl": F.lit("supplier"), "doc": F.lit("supplier.csv")})
    lines = tables.describe(p, {"supplier": s.count()}).splitlines()
    return values(spark, [(0, lines[0], *(x.split(";")[0] for x in lines[1:4]))], "n int, head string, first string, second string, third string")


# --- metrics


@query(
    f"""WITH {SCORED_SQL}, r AS (SELECT coalesce(type, 'all') AS type, count(*) AS n, count_if(retrieved) AS a, count(retrieved) AS b, count_if(page_hit) AS c, count(page_hit) AS d, count_if(nums_ok) AS e, count(nums_ok) AS f, count_if(nf_ok) AS g, count(nf_ok) AS h FROM s GROUP BY GROUPING SETS ((type), ()))
SELECT type, n, CASE WHEN b > 0 THEN a || '/' || b ELSE '-' END AS retrieved, CASE WHEN d > 0 THEN c || '/' || d ELSE '-' END AS page_hit, CASE WHEN f > 0 THEN e || '/' || f ELSE '-' END AS nums_ok, CASE WHEN h > 0 THEN g || '/' || h ELSE '-' END AS nf_ok FROM r"""
)
def quick_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quick_rates(_scored(spark, sf_dir))


@query(
    """WITH p AS (SELECT l_orderkey, avg(l_discount) AS text, count(*) FILTER (l_suppkey % 2 = 0) AS right_, count(*) AS pairs, sum(l_tax) AS t, count(*) AS nt, count(*) FILTER (l_returnflag = 'R') AS hit FROM lineitem GROUP BY 1)
SELECT round(avg(text), 6) AS text, round(sum(right_) / sum(pairs), 6) AS "order", round(sum(hit) / sum(pairs), 6) AS figure_recall, round(sum(t) / sum(nt), 6) AS teds, sum(nt)::BIGINT AS tables FROM p"""
)
def benchmark_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.avg("l_discount").alias("text"), F.count_if(F.col("l_suppkey") % 2 == 0).alias("right"), F.count(F.lit(1)).alias("pairs"), F.collect_list("l_tax").alias("teds"),
        F.count(F.lit(1)).alias("figures"), F.count_if(F.col("l_returnflag") == "R").alias("hit"),
    )
    return metrics.benchmark_means(pages)


@query(f"WITH {SCORED_SQL}, f AS (SELECT CASE WHEN retrieved IS NULL THEN CASE WHEN NOT not_found THEN 'abstention' END WHEN correct AND page_hit THEN 'none' WHEN correct THEN 'citation' WHEN qid % 5 = 0 THEN 'extraction' WHEN not_found THEN 'abstention' ELSE 'generation' END AS stage FROM s) SELECT stage, count(*) AS n FROM f WHERE stage IS NOT NULL GROUP BY stage")
def failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.queries import attribute_failure

    return metrics.stage_counts(attribute_failure(spark, sf_dir))


# --- streams


@query(
    """WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
SELECT * FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 HOUR <= (SELECT mark FROM m)"""
)
def windowed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a stream of files in order of time, and last one of events long past: these are too late, and windows that the
    watermark has not passed are not given out yet."""
    from pagewright.session import scratch
    from pagewright.streaming import ingest

    e = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    first, last = e.agg(F.min(F.col("ts").cast("double")), F.max(F.col("ts").cast("double"))).first()
    path, at = scratch(spark, "events"), F.col("ts").cast("double")
    step = (last - first) / 4
    for k in range(4):
        part = e.filter((at >= first + k * step) & ((at < first + (k + 1) * step) if k < 3 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(path)
    e.filter(at < first + 7200).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    started = ingest.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", scratch(spark, "ck"))
    started.trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
