"""Operators whose results SQL does not give: chunking, sources, guard, engine, streams, retrieval pieces."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import chunks, layout, metrics, numerals, search, store, tables
from pagewright.plans import engine, guard
from pagewright.sources import files
from pagewright.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_rrf_and_page_scores(spark):
    lists = [[("a", 1), ("b", 2), ("c", 3)], [("c", 1), ("b", 2), ("x", 3)]]
    frames = [spark.createDataFrame([(1, n, r) for n, r in x], "qid int, ord string, rank int") for x in lists]
    got = [r["ord"] for r in search.rrf(frames).orderBy(F.col("score").desc(), "ord").collect()]
    assert got == ["c", "b", "a", "x"]
    ranking = ["b1", "a1", "a2", "a3", "a4", "a5", "c1", "b2"]
    fused = search.rrf([spark.createDataFrame([(1, n, i + 1) for i, n in enumerate(ranking)], "qid int, ord string, rank int")])
    place = {"a": ("A", 1), "b": ("B", 2), "c": ("C", 5)}
    c = spark.createDataFrame([(n, *place[n[0]]) for n in ranking], "ord string, doc string, page int")
    got = {r["doc"]: r["score"] for r in search.page_scores(fused, c).collect()}
    assert got["A"] == pytest.approx(1 / 62 + 0.1 * (1 / 63 + 1 / 64 + 1 / 65), abs=1e-8)
    assert got["B"] == pytest.approx(1 / 61 + 0.1 / 68, abs=1e-8)
    assert got["C"] == pytest.approx(1 / 67, abs=1e-8)


def test_evidence_fits_the_budget(spark):
    rows = [(p * 100 + i, "d", p) for p in range(1, 6) for i in range(12)]
    c = spark.createDataFrame(rows, "ord long, doc string, page int")
    fused = spark.createDataFrame([(1, o, 1.0 / (60 + i)) for i, (o, _, p) in enumerate(rows) if o % 100 < 8], "qid int, ord long, score double")
    ranked = search.top_pages(search.page_scores(fused, c))
    got = search.evidence_budget(ranked, c).orderBy("page_rank").collect()
    assert sum(r["kept"] + r["added"] for r in got) == 24
    assert all(r["kept"] >= 1 for r in got)
    assert search.evidence(ranked, c).count() == 24


def test_split_and_pack_keep_all_words():
    text = " ".join(f"w{i}" + ("." if i % 50 == 49 else "") for i in range(2000))
    pieces = chunks.split_long(text)
    assert " ".join(pieces).split() == text.split()
    assert all(chunks.tokens(p) <= chunks.MOST for p in pieces)
    long_sentence = " ".join(["word"] * 1500)
    assert " ".join(chunks.split_long(long_sentence)).split() == long_sentence.split()
    groups = chunks.pack([text[:300]] * 30)
    assert all(chunks.tokens("\n".join(g)) <= chunks.MOST for g in groups)
    assert sum(map(len, groups)) == 30


def test_chunks_of_a_document(spark):
    rows = [
        ("d.pdf", 1, 1, "text", "heading", "Widget manual", None, None, None, None),
        ("d.pdf", 1, 2, "text", "body", "The EV-BMS-100 unit. " * 30, None, None, None, None),
        ("d.pdf", 1, 3, "table", None, None, [["Parameter", "Value"], ["Max discharge current", "320 A"]], "3. Electrical", None, None),
        ("d.pdf", 2, 1, "text", "heading", "Claims", None, None, None, None),
        ("d.pdf", 2, 2, "text", "body", "1. A gripper of steel.", None, None, None, None),
        ("d.pdf", 2, 3, "figure", None, None, None, None, "FIG. 2 view", "FIG. 2"),
    ]
    got = chunks.chunk_documents(spark.createDataFrame(rows, files.BLOCKS)).orderBy("place").collect()
    assert [r["kind"] for r in got] == ["text", "table_row", "table", "claim", "figure"]
    assert got[1]["text"] == "Table: 3. Electrical | Parameter: Max discharge current | Value: 320 A"
    assert got[0]["id"] == "d.pdf#p1#text1" and got[0]["prefix"] == "Widget manual › Widget manual › p.1"
    assert "ev-bms-100" in got[0]["identifiers"] and got[3]["section"] == "Claims"


def test_guard_refuses_and_limits(spark):
    spark.range(300).createOrReplaceTempView("numbers")
    r = guard.query_sql(spark, 'SELECT "id" FROM numbers', seconds=60)
    assert r.truncated and len(r.rows) == 200
    assert guard.shown(r).endswith("(200 rows total)")
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "SELECT * FROM nowhere", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x"):
        with pytest.raises(guard.SQLError):
            guard.query_sql(spark, bad, seconds=60)
    fixed = guard.answer_sql(spark, "how many", "", lambda q, s, e: "SELECT count(*) AS n FROM numbers" if e else "SELECT nothing FROM numbers", ["numbers"])
    assert fixed[1].rows[0]["n"] == 300 and fixed[2] == ["numbers"]


def test_loader_reads_a_messy_csv(spark, tmp_path):
    body = "Bill of materials;;;\nRev;C;;\n;;;\nPart Number;Description;Qty;\n" + "".join(f"P-{i};bolt {i};{i};{'16H' if i == 20 else i * 1.5}\n" for i in range(1, 21))
    (tmp_path / "bom.csv").write_text("﻿" + body, encoding="utf-8")
    rows = files.read_csv(spark, str(tmp_path / "bom.csv"))
    typed, profile = tables.load(rows, "bom", "bom.csv")
    assert typed.columns == ["_row", "part_number", "description", "qty", "col_4"]
    assert dict(typed.dtypes)["qty"] == "bigint" and dict(typed.dtypes)["col_4"] == "double"
    sums = typed.agg(F.sum("col_4"), F.count("col_4"), F.max("_row")).first()
    assert (sums[0], sums[1], sums[2]) == (285.0, 19, 20)
    text = tables.describe(profile, {"bom": 20})
    assert '"qty" INTEGER' in text and "source file: bom.csv, 20 rows" in text


def test_names_and_types(spark):
    assert tables.column_names(["Unit Cost (€)", None, "qty", "qty", " "]) == ["unit_cost", "col_2", "qty", "qty_1", "col_5"]
    cells = ["1,000", "1_0", "12d", "inf", " 7 ", "1e3", "", "x", ".5", "-3."]
    got = [one(spark, tables.is_number(F.lit(c))) for c in cells]
    assert got == [True, True, False, True, True, True, False, False, True, True]


def _xlsx():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Parts List" sheetId="1" r:id="r1"/><sheet name="Suppliers" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si><si><t>bolt</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Qty</t></is></c></row><row/><row><c r="A3" t="s"><v>1</v></c><c r="C3"><v>4</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    return b.getvalue()


def _docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Title', 'Heading1')}{p('Body text')}{table}</w:body></w:document>")
    return b.getvalue()


def test_office_files(spark, tmp_path):
    (tmp_path / "bom.xlsx").write_bytes(_xlsx())
    (tmp_path / "note.docx").write_bytes(_docx())
    (tmp_path / ".hidden.docx").write_bytes(b"")
    found = files.corpus(spark, str(tmp_path))
    assert [r["doc"] for r in found.select("doc").collect()] == ["bom.xlsx", "note.docx"]
    rows = files.read_xlsx(found.filter("suffix = '.xlsx'")).orderBy("n").collect()
    assert [(r["tbl"], r["cells"]) for r in rows] == [("bom__parts_list", ["Name", None, "Qty"]), ("bom__parts_list", ["bolt", None, "4"])]
    blocks = files.parse(found.filter("suffix = '.docx'")).orderBy("ord").collect()
    assert [(b["kind"], b["role"]) for b in blocks] == [("text", "heading"), ("text", "body"), ("table", None)]
    assert blocks[2]["title"] == "Title" and blocks[2]["cells"] == [["a", "b"]]
    with pytest.raises(Exception, match="unsupported file"):
        files.parse(found.filter("suffix = '.xlsx'")).collect()


def test_html(spark):
    html = "<html><nav>Home</nav><h1>Top</h1><p>One <b>two</b></p><script>x()</script><table><tr><th>a</th><td>1</td></tr></table><footer>end</footer></html>"
    got = files.html_blocks(html)
    assert [(b["kind"], b.get("role"), b.get("text")) for b in got] == [("text", "header", "Home"), ("text", "heading", "Top"), ("text", "body", "One two"), ("table", None, None), ("text", "footer", "end")]


def test_engine_answers_and_declines(spark):
    c = spark.createDataFrame([(1, "c1", "a.pdf", 1, "a", "The gripper weighs 5 kg in total.", []), (2, "c2", "b.pdf", 3, "b", "Batteries are blue and large.", [])], "ord long, id string, doc string, page int, prefix string, text string, identifiers array<string>")
    q = spark.createDataFrame([(1, "How heavy is the gripper?"), (2, "zzz qqq?")], "qid int, question string")
    got = {r["qid"]: r for r in engine.ask(q, c).collect()}
    assert got[1]["answer"].startswith("The gripper") and got[1]["citations"][0]["doc"] == "a.pdf"
    assert got[2]["not_found"]


def test_stream_adds_each_text_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "text string").write.parquet(src)
    stream = spark.readStream.schema("text string").parquet(src)
    ingest.start(stream, out, ck).awaitTermination()
    spark.createDataFrame([("b",), ("c",)], "text string").write.mode("append").parquet(src)
    ingest.start(spark.readStream.schema("text string").parquet(src), out, ck).awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_text_functions(spark):
    assert one(spark, T.text_quality(F.lit("�� word"))) == 0.5
    assert one(spark, T.text_quality(F.lit("xkcd qwrt plmn zzzz brrr"))) == 0.0
    assert one(spark, F.sort_array(T.numbers_in(F.lit("1,000 units at 4.25 USD, total 12,345.67")))) == ["1000", "12345.67", "4.25"]
    assert one(spark, T.join_lines(F.array(F.lit("exam-"), F.lit("ple of EV-"), F.lit("BMS")))) == "example of EV- BMS"
    spans = F.array(*(F.struct(F.lit(a).alias("x0"), F.lit(b).alias("x1"), F.lit(10.0).alias("size"), F.lit(t).alias("text")) for a, b, t in ((0.0, 5.0, "0"), (5.0, 6.0, "."), (6.0, 9.0, "45"), (15.0, 20.0, "V"))))
    assert one(spark, T.join_spans(spans)) == "0.45 V"
    wide = T.typed_row_text("wide", F.lit(1), {f"c{i}": F.lit(i) for i in range(60)})
    assert one(spark, wide).endswith("c29=29; … (30 more columns)")


def test_metrics():
    assert metrics.edit_distance("one two three four".split(), "one three five".split()) == 2
    a = "<table><tr><td>x</td></tr></table>"
    assert metrics.teds_of(a, a) == 1 and metrics.teds_of(a, "<table></table>") == pytest.approx(1 / 3)


def test_layout_lines_and_definitions(spark):
    assert layout.by_line([(30, 0, 10, "b"), (0, 1, 11, "a"), (0, 20, 30, "c")]) == ["a", "b", "c"]
    texts = {
        "valves 74 and 76": [("74", "valves"), ("76", "valves")],
        "10 Hz and claim 12 in 2019": [],
        "a first gear 12, 14, and 16a drives the lower-arm unit 9": [("12", "gear"), ("14", "gear"), ("16a", "gear"), ("9", "lower-arm unit")],
        "the motor 2001 and the motor 31-bit and a shaft 7 mm": [],
        "": [],
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", numerals.definitions(F.col("t")).alias("d")).orderBy("i").collect()
    assert [[tuple(x) for x in r["d"]] for r in rows] == list(texts.values())


def test_upsert_keeps_one_row_a_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, store.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "d"), (3, "e")]


def test_rest_works_without_the_training_data_operators():
    import pathlib
    import re

    top = pathlib.Path(__file__).parent.parent / "pagewright"
    outside = [p for p in top.rglob("*.py") if "llm" not in p.parts]
    assert outside and not [p for p in outside if re.search(r"pagewright\.llm|from \.+llm", p.read_text())]


def test_entry_imports_without_the_training_data_operators(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    top = pathlib.Path(__file__).parent.parent
    shutil.copytree(top / "pagewright", tmp_path / "pagewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search_pages' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
    (tmp_path / "pagewright" / "llm").mkdir()  # a subpackage that cannot be imported does not take the others with it
    (tmp_path / "pagewright" / "llm" / "__init__.py").write_text("")
    (tmp_path / "pagewright" / "llm" / "queries.py").write_text("import a_library_that_is_not_here")
    shutil.copy(top / "corpus_pipeline.py", tmp_path) if (top / "corpus_pipeline.py").exists() else None
    run = """
import __spark_entry__ as e
from pagewright.session import local_session
spark = local_session(2, 2)
q = e.queries()
assert not [n for n in q if n.startswith("op") or n == "pipeline"]
for n in ("norm_forms", "sql_join", "page_scores"):
    assert q[n](spark, "/root/testdata/sf0.001").count() > 0, n
"""
    subprocess.run([sys.executable, "-c", run], cwd=tmp_path, check=True, env={**__import__("os").environ, "PYTHONPATH": str(tmp_path)}, timeout=300)


def test_ask_by_all_routes(spark):
    """A numeral with its figure, a statement over a table, a pinned document, a table over two pages; any number of numerals."""
    from pagewright.plans import engine

    chunks = spark.createDataFrame(
        [
            (1, "a1", "US8485576B2.pdf", 1, "p", "The control unit 160 drives the wings of the gripper.", ["ref160"], "text", None, None),
            (2, "a2", "US8485576B2.pdf", 2, "p", "Discharge current of the pack is 320 A at most.", ["320a"], "text", None, None),
            (3, "b1", "manual.pdf", 1, "p", "Discharge current of the charger is 12 A.", ["12a"], "text", None, None),
            (4, "t1", "bom.pdf", 1, "p", "Table: spares | name: flange gasket", [], "table_row", "t", None),
            (5, "t2", "bom.pdf", 2, "p", "Table: spares | name: washers", [], "table_row", "t", None),
        ],
        "ord long, id string, doc string, page int, prefix string, text string, identifiers array<string>, kind string, table_id string, caption_page int",
    )
    entries = spark.createDataFrame([("US8485576B2.pdf", "160", "control unit", ["unit"], [1, 2])], "doc string, numeral string, name string, variants array<string>, pages array<int>")
    many = spark.range(20_000).select(F.lit("other.pdf").alias("doc"), F.concat(F.lit("n"), "id").alias("numeral"), F.lit("x").alias("name"), F.array().cast("array<string>").alias("variants"), F.array(F.lit(1)).alias("pages"))
    figures = spark.createDataFrame([("US8485576B2.pdf", "FIG. 2", 2, "block diagram")], "doc string, fig_id string, page int, title string")
    labels = spark.createDataFrame([("US8485576B2.pdf", 9, "FIG. 2", ["14"])], "doc string, ord long, fig_id string, labels array<string>")
    spark.createDataFrame([(1, "pass"), (2, "fail"), (3, "fail")], "n int, outcome string").createOrReplaceTempView("test_log")
    corpus = engine.Corpus(chunks, entries.unionByName(many), figures, labels, tables=["test_log"])
    questions = spark.createDataFrame(
        [(1, "What is component 160 in FIG. 2?"), (2, "How many test runs failed?"), (3, "What is the discharge current of US 8,485,576 B2?"), (4, "Which flange gasket?"), (5, "zebra quagga okapi")], "qid int, question string",
    )
    write = lambda question, schema, error: "SELECT count(*) AS n FROM test_log WHERE outcome = 'fail'" if error else "SELECT nothing"
    got = {r["qid"]: r for r in engine.ask(questions, corpus, write=write).collect()}
    assert got[1]["route"] == "numeral" and "control unit (also written: unit)" in got[1]["answer"]
    assert "FIG. 2 is described as: block diagram (page 2)" in got[1]["answer"] and "was not read on the FIG. 2 image" in got[1]["answer"]
    assert got[2]["route"] == "sql" and got[2]["answer"].endswith("n\n2") and got[2]["citations"][0]["doc"] == "test_log"
    assert "320 A" in got[3]["answer"] and got[3]["citations"][0]["doc"] == "US8485576B2.pdf"
    assert [(c["doc"], c["page"]) for c in got[4]["citations"]] == [("bom.pdf", 1), ("bom.pdf", 2)]
    assert got[5]["not_found"] and got[5]["answer"] == "not found"


def test_dense_search_keeps_to_a_document(spark):
    from pagewright.operators import search

    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.9, 0.1]), (3, "b", [0.0, 1.0])], "ord long, doc string, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [1.0, 0.0], "b")], "qid int, vec array<double>, only string")
    got = [(r["qid"], r["ord"]) for r in search.dense_search(v, q, 2, doc="only").orderBy("qid", "rank").collect()]
    assert got == [(1, 1), (1, 2), (2, 2), (2, 3)]


def test_numeral_index_comes_back_as_saved(spark, tmp_path):
    entries = spark.createDataFrame([("a", "1", "gear", ["cog"], [1], 2)], "doc string, numeral string, name string, variants array<string>, pages array<int>, count long")
    figures = spark.createDataFrame([("a", "FIG. 1", 1, "view")], "doc string, fig_id string, page int, title string")
    numerals.save(entries, figures, str(tmp_path))
    back = numerals.load(spark, str(tmp_path))
    assert [back[0].collect(), back[1].collect()] == [entries.collect(), figures.collect()]
    assert [x.count() for x in numerals.load(spark, str(tmp_path / "none"))] == [0, 0]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    import zipfile

    from pagewright import cli

    monkeypatch.setattr(cli, "local_session", lambda: spark)
    src, index = tmp_path / "corpus", str(tmp_path / "index")
    src.mkdir()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:r><w:t>{t}</w:t></w:r></w:p>' for t in ("The gripper has a control unit 160 and a motor 9b.", "FIG. 1 is a view of the gripper."))
    with zipfile.ZipFile(src / "gripper.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    (src / "parts.csv").write_text("part,price\nflange gasket,12\nwasher,3\n")
    assert cli.main(["ingest", str(src), index]) == 0
    ords = [r["ord"] for r in spark.read.parquet(f"{index}/chunks").orderBy("ord").collect()]
    assert ords == list(range(len(ords))) and len(ords) >= 3
    assert cli.main(["search", index, "flange gaskets"]) == 0 and "gasket" in capsys.readouterr().out
    assert cli.main(["ask", index, "What is component 9b?"]) == 0 and "motor" in capsys.readouterr().out
    assert cli.main(["show", index, "gripper.docx", "1"]) == 0 and "control unit" in capsys.readouterr().out
    assert cli.main(["models", index]) == 0 and "keywords alone" in capsys.readouterr().out
    questions = tmp_path / "q.json"
    questions.write_text('{"qid": 1, "type": "fact", "question": "What is component 9b?", "doc": "gripper.docx", "page": 1}\n{"qid": 2, "type": "none", "question": "zebra quagga"}\n')
    assert cli.main(["eval", index, str(questions), str(tmp_path / "r")]) == 0
    assert "1/1" in (tmp_path / "r.md").read_text() and (tmp_path / "r.json").exists()
    assert cli.main(["sql", f"{index}/chunks", "DROP TABLE t"]) == 1
