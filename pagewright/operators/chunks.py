"""Chunks for retrieval from blocks in reading order."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagewright.functions import text as T
from pagewright.operators.numerals import reconciled
from pagewright.operators.search import small
from pagewright.session import written

#: Fixed values of chunking.
TARGET, MOST, LEAST, BIG_TABLE = 300, 450, 60, 400
TITLE = (3, 120)
RUNNING_PAGES, RUNNING_CHARS = 3, 80
#: Pages that are Python objects at once.
TAKEN = 100
CLAIM = r"^\s*(\d{1,3})\.\s+(?:The|A|An|In|Apparatus|Method|System)\b"


def tokens(text: str) -> int:
    return estimated(len(text.split()))


def estimated(words: int) -> int:
    return int(words * T.TOKENS_PER_WORD) + 1


def split_long(text: str, target: int = TARGET, most: int = MOST) -> list[str]:
    """A text over ``most`` tokens in pieces at sentence ends; a sentence over it is cut between words."""
    if tokens(text) <= most:
        return [text]
    out, held = [], ""
    for sentence in re.split(r"(?<=[.!?;])\s+", text):
        longer = f"{held} {sentence}".strip()
        if held and tokens(f"{held} {sentence}") > target:
            out.append(held)
            longer = sentence
        held = longer
        words = held.split()
        step = int(target / T.TOKENS_PER_WORD)
        while tokens(held) > most:
            out.append(" ".join(words[:step]))
            words = words[step:]
            held = " ".join(words)
    return [*out, held] if held else out


def pack(texts: list[str], target: int = TARGET, most: int = MOST) -> list[list[str]]:
    """Consecutive texts in groups: a group is closed once it has ``target`` tokens or would pass ``most``. Words of what is
    held are counted as it grows; a text set right behind it, as the limit counts it, may carry on its last word."""
    groups: list[list[str]] = []
    held: list[str] = []
    n, inside = 0, False
    for text in texts:
        own = len(text.split())
        if held and (estimated(n) >= target or estimated(n + own - (inside and not text[:1].isspace() and text != "")) > most):
            groups.append(held)
            held, n, inside = [], 0, False
        for piece in [text] if estimated(own) <= most else split_long(text, target, most):
            k = own if piece is text else len(piece.split())
            if held and estimated(n + k - (inside and not piece[:1].isspace() and piece != "")) > most:
                groups.append(held)
                held, n = [], 0
            held.append(piece)
            n, inside = n + k, piece != "" and not piece[-1].isspace()
    return [*groups, held] if held else groups


def running_lines(blocks: DataFrame) -> DataFrame:
    """(doc, key): short lines, digits masked, on RUNNING_PAGES pages or more of a document."""
    short = blocks.filter((F.col("kind") == "text") & (F.length("text") < RUNNING_CHARS))
    per = short.select("doc", "page", T.running_key(F.col("text")).alias("key")).distinct().groupBy("doc", "key").agg(F.count(F.lit(1)).alias("n_pages"))
    return per.filter(F.col("n_pages") >= RUNNING_PAGES)


def titles(blocks: DataFrame) -> DataFrame:
    """(doc, title): the first heading of page 1 of a title's length, else the file name without its ending."""
    stem = F.regexp_replace("doc", r"(?<=.)\.[^.]*$", "")
    fit = (F.col("page") == 1) & (F.col("kind") == "text") & (F.col("role") == "heading") & (F.length("text") > TITLE[0]) & (F.length("text") < TITLE[1])
    return blocks.groupBy("doc").agg(F.min_by(F.when(fit, F.col("text")), F.when(fit, F.col("ord"))).alias("h")).select("doc", F.coalesce("h", stem).alias("title"))


def _page(blocks: list[SimpleNamespace], section: str | None) -> Iterator[dict]:
    """Chunks of one page's blocks, which are in order, under the heading that the pages before leave open: headings open
    sections, claims stand alone, texts are packed, and a table or figure closes what is held."""
    counts: dict[tuple, int] = {}
    held, page = [], None

    def emit(kind: str, text: str, number: int) -> dict:
        key = (number, kind)
        counts[key] = counts.get(key, 0) + 1
        return {"page": number, "kind": kind, "n": counts[key], "text": text, "section": section}

    def flush() -> Iterator[dict]:
        for group in pack(held):
            yield emit("text", "\n".join(group), page)
        held.clear()

    for b in blocks:
        page = int(b.page)
        if b.kind == "text":
            if b.role in ("header", "footer") or b.running:
                continue
            if b.role == "heading":
                yield from flush()
                section = b.text
            elif (section or "").lower().startswith("claim") and re.match(CLAIM, b.text):
                yield from flush()
                yield emit("claim", b.text, page)
            else:
                held.append(b.text)
        else:
            yield from flush()
            if b.kind == "table":
                rows = [list(map(lambda c: c or "", r)) for r in b.cells]
                head = rows[0] if len(rows) > 1 else None
                for r in rows[1:] if head else rows:
                    if any(r):
                        named = [f"{head[i] if head and i < len(head) and head[i] else f'col{i + 1}'}: {v}" for i, v in enumerate(r) if v]
                        yield emit("table_row", " | ".join([f"Table: {b.title}" if b.title else "Table", *named]), page)
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                lines.insert(1, "|" + "---|" * len(rows[0]))
                whole = "\n".join([*([b.title] if b.title else []), *lines])
                if head and tokens(whole) > BIG_TABLE:
                    whole = "\n".join([*([b.title] if b.title else []), "Columns: " + " | ".join(head), f"({len(rows) - 1} rows)"])
                yield emit("table", whole, page)
            elif b.kind == "figure":
                yield emit("figure", b.caption or b.figure_id or "Figure", page)
    yield from flush()


def merged(chunks: list[dict]) -> list[dict]:
    """Text chunks under LEAST tokens join the text chunk before, if it is of the same page and section and has room."""
    out: list[dict] = []
    for c in chunks:
        last = out[-1] if out else None
        if (
            last and c["kind"] == last["kind"] == "text" and (c["page"], c["section"]) == (last["page"], last["section"])
            and tokens(c["text"]) < LEAST and tokens(last["text"] + c["text"]) <= MOST
        ):
            last["text"] += "\n" + c["text"]
        else:
            out.append(c)
    return out


def chunk_documents(blocks: DataFrame) -> DataFrame:
    """(id, doc, page, kind, text, section, prefix, identifiers, place) from blocks (doc, page, ord, kind, role, text,
    cells, title, caption, figure_id).

    What is held is closed at a page's end, so pages are packed apart: a group is one page's blocks, and the heading that
    is open when it begins is carried to it by a window over the document's pages, of a row each.
    """
    keyed = blocks.withColumn("key", F.when(F.col("kind") == "text", T.running_key(F.col("text"))))
    drop = written(running_lines(blocks).select("doc", "key").withColumn("running", F.lit(True)), "running")
    marked = keyed.join(small(drop), ["doc", "key"], "left").fillna({"running": False})
    cols = ["ord", "page", "kind", "role", "text", "cells", "title", "caption", "figure_id", "running"]
    pages = marked.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("blocks"))
    pages = pages.join(open_headings(marked), ["doc", "page"], "left")

    def of_page(doc: str, page: int, held: list[dict], section: str | None) -> Iterator[tuple]:
        for at, c in enumerate(merged(list(_page([SimpleNamespace(**b) for b in held], section)))):
            yield doc, c["page"], c["kind"], c["n"], c["text"], c["section"], at

    made = written(by_row(pages.select("doc", "page", "blocks", "open"), of_page, "doc string, page int, kind string, n int, text string, section string, at int"), "chunks")
    sizes = made.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("doc", "page", F.coalesce(before, F.lit(0)).alias("before"))
    made = made.join(sizes, ["doc", "page"]).withColumn("place", (F.col("before") + F.col("at")).cast("int"))
    made = made.join(small(written(titles(blocks), "titles")), "doc")
    page = F.concat(F.lit("p."), F.col("page"))
    return made.select(
        F.concat(F.col("doc"), F.lit("#p"), F.col("page"), F.lit("#"), F.col("kind"), F.col("n")).alias("id"),
        "doc", "page", "kind", "text", "section",
        F.concat_ws(" › ", "title", "section", page).alias("prefix"),
        T.extract_identifiers(F.col("text")).alias("identifiers"),
        "place",
    )


def packed_lines(chunks: DataFrame) -> DataFrame:
    """(doc, page, n, text, n_tokens): lines of a page packed into chunks, in order (chunks: doc, page, ord, text)."""
    lists = chunks.groupBy("doc", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("texts"))

    def of_page(doc: str, page: int, texts: list[str]) -> Iterator[tuple]:
        for i, g in enumerate(pack(texts), 1):
            yield doc, page, i, "\n".join(g)

    return by_row(lists, of_page, "doc string, page bigint, n int, text string").withColumn("n_tokens", T.n_tokens(F.col("text")))


def by_row(rows: DataFrame, each: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """What ``each`` makes of each row's values, as rows of ``schema``. Rows become Python's some at a time, and go out as they
    come: a worker holds a batch of Arrow's and little else."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, TAKEN):
                values = (c.to_pylist() for c in b.slice(a, TAKEN).columns)
                made = [r for row in zip(*values, strict=True) for r in each(*row)]
                columns = zip(*made, strict=True) if made else ((),) * len(kind)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], kind.names)
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


def open_headings(blocks: DataFrame) -> DataFrame:
    """(doc, page, open): the heading that is open when a page begins, from the last one of each page before. Running
    heads and feet, where they are marked (running, role), open none."""
    heading = (F.col("role") == "heading") & (F.col("kind") == "text" if "kind" in blocks.columns else F.lit(True))
    heading = heading & ~F.col("running") if "running" in blocks.columns else heading
    last = blocks.groupBy("doc", "page").agg(F.max_by(F.when(heading, F.col("text")), F.when(heading, F.col("ord"))).alias("last"))
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return last.select("doc", "page", F.last("last", ignorenulls=True).over(before).alias("open"))


def sections(blocks: DataFrame) -> DataFrame:
    """Blocks with the heading they stand under, carried over pages: within a page by a window over its blocks, from page to
    page by one over a row a page."""
    order = Window.partitionBy("doc", "page").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("role") == "heading", F.col("text")), ignorenulls=True).over(order)
    found = blocks.withColumn("pw_own", own).join(open_headings(blocks.select("doc", "page", "ord", "role", "text")), ["doc", "page"], "left")
    return found.withColumn("section", F.coalesce("pw_own", "open")).select(*blocks.columns, "section")


def figure_text(caption: Column, fig_id: Column, definition: Column, labels: Column, named: Column, same_page: Column, read: Column, description: Column) -> Column:
    """A figure's chunk, its parts with a bar between: caption, behind the figure's id unless it begins with that; the
    definition, unless the caption holds it; labels, with the names of those that are defined; other numerals defined on
    the page, as weaker evidence; words read in the figure; a description. labels, named, same_page and read are arrays."""
    cap = F.coalesce(caption, F.lit(""))
    begins = fig_id.isNull() | F.lower(cap).startswith(F.rtrim(F.lower(fig_id), F.lit(".")))
    head = F.when(begins, cap).otherwise(F.btrim(F.concat(fig_id, F.lit(": "), cap), F.lit(": ")))
    words = F.array_distinct(F.filter(read, lambda t: t.rlike("[A-Za-z]{3,}")))
    listed = lambda start, xs, by: F.when(F.size(xs) > 0, F.concat(F.lit(start), F.array_join(xs, by)))
    parts = [
        F.coalesce(F.nullif(head, F.lit("")), F.lit("Figure")),
        F.when(~F.contains(F.lower(cap), F.lower(definition)), F.concat(F.lit("Description: "), definition)),
        listed("Labels: ", labels, ", "),
        listed("", named, "; "),
        listed("Also defined on this page: ", same_page, "; "),
        listed("Text in figure: ", words, " "),
        F.concat(F.lit("VLM description: "), F.nullif(description, F.lit(""))),
    ]
    return F.concat_ws(" | ", *parts)


def figure_chunks(blocks: DataFrame, figures: DataFrame, entries: DataFrame) -> DataFrame:
    """Figure blocks (doc, page, ord, caption, figure_id, labels, description) with matched, repaired, unmatched and text.

    Labels are reconciled with the numerals that the document defines (entries: doc, numeral, name, pages); figures: doc,
    fig_id, title. Numerals meet figures by document, then by equality: no figure meets all numerals of the corpus.
    """
    defined = entries.groupBy("doc").agg(F.array_sort(F.collect_set("numeral")).alias("defined"))
    none = F.array().cast("array<string>")
    t = blocks.join(defined, "doc", "left").withColumn("r", reconciled(F.coalesce("labels", none), F.coalesce("defined", none)))
    t = t.select(*blocks.columns, "r.*").withColumn("present", F.array_distinct(F.concat("matched", "repaired")))
    line = F.struct(F.length(F.rtrim("numeral", F.lit("abc'"))).alias("l"), "numeral", F.concat_ws(" = ", "numeral", "name").alias("t"))
    lines = lambda df, name: df.groupBy("doc", "ord").agg(F.transform(F.array_sort(F.collect_set(line)), lambda x: x["t"]).alias(name))
    own = t.select("doc", "ord", F.explode("present").alias("numeral")).join(entries.select("doc", "numeral", "name"), ["doc", "numeral"])
    here = t.select("doc", "page", "ord", "present").join(entries.select("doc", "numeral", "name", F.explode("pages").alias("page")), ["doc", "page"])
    here = here.filter(~F.array_contains("present", F.col("numeral")))
    titled = figures.select("doc", F.col("fig_id").alias("figure_id"), F.col("title").alias("definition"))
    t = t.join(titled, ["doc", "figure_id"], "left").join(lines(own, "named"), ["doc", "ord"], "left").join(lines(here, "same_page"), ["doc", "ord"], "left")
    text = figure_text(F.col("caption"), F.col("figure_id"), F.col("definition"), F.col("present"), F.coalesce("named", none), F.coalesce("same_page", none), F.coalesce("labels", none), F.col("description"))
    return t.withColumn("text", text).drop("definition", "named", "same_page", "present")
