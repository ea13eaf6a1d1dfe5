"""What operators hand from step to step grows no faster than their input, and their results are those of the definition."""

import math
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import chunks, metrics, search


def by_trigram(chunks, queries, limit):
    """The definition of trigram search, chunk by chunk."""
    joined = {o: " ".join(ids) for o, ids in chunks}
    mean, out = sum(max(len(j) - 2, 0) for j in joined.values()) / len(joined), {}
    for q, ids in queries:
        for t in (i for i in ids if len(i) >= 3):
            hits = {o: j.count(t) for o, j in joined.items() if t in j}
            raw = math.log((len(joined) - len(hits) + 0.5) / (len(hits) + 0.5))
            for o, tf in hits.items():
                part = (raw if raw > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * max(len(joined[o]) - 2, 0) / mean))
                out[q, o] = out.get((q, o), 0) + part
    best = {q: sorted((-round(s, 6), o) for (p, o), s in out.items() if p == q)[:limit] for q, _ in queries}
    return sorted((q, o, -s) for q, x in best.items() for s, o in x)


def test_trigram_makes_no_row_for_each_query_and_chunk(spark):
    rows_ = [(o, [f"brand{o % 7}{o % 3}", "x" * (o % 5)]) for o in range(40)] + [(90, []), (91, ["ab"]), (92, ["brand11 brand11"]), (93, ["äöü-5"])]
    queries = [(q, sorted({f"brand{q % 7}{q % 3}", f"rand{q % 7}", "and", "ab", "öü-", "xxx"})) for q in range(20)] + [(77, ["brand11", "brand11"]), (78, [])]
    c, q = spark.createDataFrame(rows_, "ord bigint, identifiers array<string>"), spark.createDataFrame(queries, "qid int, identifiers array<string>")
    got = search.trigram(c, q, F.col("identifiers"), 6)
    rows, want = sorted((r["qid"], r["ord"], r["score"]) for r in got.collect()), by_trigram(rows_, queries, 6)
    assert [r[:2] for r in rows] == [r[:2] for r in want]
    assert [r[2] for r in rows] == pytest.approx([r[2] for r in want], abs=2e-6)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def tables_made(spark, make):
    """Rows of the tables that ``make`` writes to the shared folder, by name."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    make()
    return {n.split("-")[1]: spark.read.parquet(f"{root}/{n}").count() for n in set(os.listdir(root)) - before if n.startswith("pagewright-")}


def test_keyword_search_makes_no_row_for_each_word_and_chunk(spark):
    words = ["alpha", "beta", "gamma", "delta", "don't"]
    rows = [(o, "d", "p", " ".join(words[(o + k) % 5] for k in range(4)), [f"id-{o % 3}"]) for o in range(300)]
    c = spark.createDataFrame(rows, "ord bigint, doc string, prefix string, text string, identifiers array<string>")
    q = spark.createDataFrame([(k, " ".join(words), [f"id-{k}"]) for k in range(3)], "qid int, question string, identifiers array<string>")
    made = tables_made(spark, lambda: search.keyword_search(c, q, 5).collect())
    assert max(made.values()) <= len(rows)


@pytest.mark.parametrize("restricted", [False, True])
def test_scan_and_index_give_the_same_scores(spark, restricted):
    """Phrases, repeated terms, restricted documents, empty and null texts: a look through all chunks and an index agree."""
    texts = ["the well-known state-of-the-art well", "state of the art", "art state", "", None, "well known known well known", "Known, WELL; état of art", "the known unknown"]
    c = spark.createDataFrame([(o * 3, f"d{o % 3}", texts[o % len(texts)]) for o in range(50)], "ord bigint, doc string, text string")
    asked = [(1, "well-known known", "d1"), (2, "state-of-the-art", None), (3, "etat art's known", "d2"), (4, "nothing", None), (5, "known well-known art state", None)]
    q = spark.createDataFrame(asked, "qid int, question string, doc string")
    doc = "doc" if restricted else None
    rows = lambda x: sorted(map(tuple, search.bm25(x, q, T.content_terms(F.col("question")), {"text": 1.0}, 4, doc).collect()))
    got = rows(c)
    assert got == rows(search.index(c, {"text": 1.0})) and len(got) >= 12


def test_passages_are_found_in_texts_as_contains_finds_them(spark):
    texts = ["the quick brown fox", "a quick brown fox jumps", None, "", "xthe quick brown foxthe quick", "ünï quick brown fox", "the quick brown", "quick brown fo"] * 3
    t = spark.createDataFrame([(f"d{i}", i, x) for i, x in enumerate(texts)], "doc string, page bigint, text string").repartition(2)
    asked = ["the quick brown fox", "quick brown fox", "", "fox", "quick brown fo", "ï quick brown", "nowhere to be found", None]
    p = spark.createDataFrame(list(enumerate(asked)), "qid bigint, passage string")
    got = sorted((r["qid"], r["page"]) for r in search.holding(t, p).collect())
    assert got == sorted((q, i) for q, a in enumerate(asked) for i, x in enumerate(texts) if a is not None and x is not None and a in x)
    assert "NestedLoop" not in search.holding(t, p)._jdf.queryExecution().executedPlan().toString()


def test_what_few_hits_need_of_the_chunks_is_not_shuffled(spark):
    """A few fused hits meet all chunks by a broadcast, however small the session's limit for broadcasts is."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c = spark.range(2000).select(F.col("id").alias("ord"), F.lit("d").alias("doc"), (F.col("id") % 70).alias("page"))
        fused = spark.createDataFrame([(1, 5, 0.2), (1, 75, 0.1)], "qid int, ord bigint, score double")
        for f in (search.page_scores, search.page_order):
            got = f(fused, c)
            assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
            assert [r["page"] for r in got.collect()] == [5]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pages_are_packed_without_a_call_of_pandas_for_each(spark):
    rows = [(f"d{k % 3}", k // 3, o, "text", "heading" if o == 0 else "body", f"{'q' * k} words of line {'r' * o}", None, None, None, None) for k in range(60) for o in range(4)]
    rows += [("d0", 0, 9, "table", "body", None, [["a", None], ["1", "2"]], "T", None, None), ("d1", 0, 9, "figure", "body", None, None, None, "cap", "FIG. 1")]
    b = spark.createDataFrame(rows, "doc string, page int, ord bigint, kind string, role string, text string, cells array<array<string>>, title string, caption string, figure_id string")
    got = chunks.chunk_documents(b)
    assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
    by_doc = {d: sorted(r["place"] for r in got.collect() if r["doc"] == d) for d in ("d0", "d1", "d2")}
    assert all(p == list(range(len(p))) for p in by_doc.values()) and [len(by_doc[d]) for d in by_doc] == [22, 21, 20]


def test_rows_become_python_some_at_a_time(spark):
    """However many rows a batch of Arrow's has, few are Python objects at once, and results go out as they come."""
    most = chunks.TAKEN
    t = spark.range(1000).coalesce(1)
    got = chunks.by_row(t, lambda i: [(i, k) for k in range(i % 3)], "i bigint, k int")
    assert sorted(map(tuple, got.collect())) == [(i, k) for i in range(1000) for k in range(i % 3)]
    sizes = got.mapInArrow(lambda bs: (pa.record_batch([[b.num_rows]], ["n"]) for b in bs), "n bigint").collect()
    assert 0 < max(r["n"] for r in sizes) <= 2 * most
    c = spark.createDataFrame([("d", 1, 0, "a"), ("d", 1, 1, "b")], "doc string, page bigint, ord bigint, text string")
    assert "MapInPandas" not in chunks.packed_lines(c)._jdf.queryExecution().optimizedPlan().toString()


def test_figures_are_matched_by_page(spark):
    """As the definition says, null pages, ids and captions included; tasks hold no sorted pairs of figures."""
    gold = [("d", k % 5 if k % 7 else None, k, f"FIG. {k % 4}" if k % 3 else None, ["", "a", "Pump", None][k % 4]) for k in range(40)]
    found = [("d", k % 6 if k % 9 else None, k, f"FIG. {k % 5}" if k % 4 else None, ["A", "pump x", None][k % 3]) for k in range(30) if k % 6 != 3]
    g = spark.createDataFrame(gold, "doc string, page int, gid int, figure_id string, caption string")
    f = spark.createDataFrame(found, "doc string, page int, ord int, figure_id string, caption string")
    want = {}
    for _, page, gid, fid, cap in gold:
        here = sorted((0 if (c or "").lower().startswith((cap or "").lower()) or (i is not None and i == fid) else 1, o) for _, p, o, i, c in found if p == page and page is not None)
        want[gid] = here[0][1] if here else None
    got = metrics.match_figures(g, f)
    assert {r["gid"]: r["ord"] for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert metrics.parts(spark.range(50_000_000)) > metrics.parts(spark.range(100))


def test_a_reply_is_parsed_once(spark):
    replies = ['x {"summary": "s", "counts": [{"count": 2, "item": "b"}]} y', "none", None, "{", '{"visible_text": ["a", "b"], "connections": ["c"]}']
    t = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string").select("i", T.description_text(F.col("r")).alias("text"))
    assert [r["text"] for r in t.orderBy("i").collect()] == ["s | Counts: 2 b", None, None, None, "Connections: c | Visible text: a b"]
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1
