"""Page geometry: boxes, columns, reading order, captions, tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T

#: Fixed values of the layout rules, in points and shares.
FULL_WIDTH, GUTTER, SLIVER = 0.62, 12.0, 0.15
MARGIN, MARGIN_CHARS, MARGIN_SIZE = 0.12, 80, 0.5
CAPTION_CHARS, CAPTION_GAP, CAPTION_ABOVE, CAPTION_OVERLAP = 400, 90.0, 30.0, 2.0
TITLE_GAP, FIGURE_TITLE_GAP = 80.0, 30.0
IN_TABLE = 2.0
SAME_FIGURE = 0.3
CAPTION = r"(?i)^\s*(FIG(?:URE)?\.?|Figure|Table)\s*\d+[A-Za-z]?\s*([—–:\-]|\.(?=\s+[A-Z])|\.?\s*$)"
HEADING = r"^\s*(\d+(\.\d+)*\.?\s+\S|[A-Z][A-Z \-&/]{5,}$)"
FIGURE_TITLE = r"(?i)^\s*(FIG(?:URE)?\.?|Figure)\s*\d+[A-Za-z]?\.?\s*$"


def box(x0: str, y0: str, x1: str, y1: str) -> Column:
    return F.struct(F.col(x0).cast("double").alias("x0"), F.col(y0).cast("double").alias("y0"), F.col(x1).cast("double").alias("x1"), F.col(y1).cast("double").alias("y1"))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def cx(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2


def cy(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def union_box(b: str = "bbox") -> Column:
    """Aggregate: the box around all boxes."""
    return F.struct(F.min(f"{b}.x0").alias("x0"), F.min(f"{b}.y0").alias("y0"), F.max(f"{b}.x1").alias("x1"), F.max(f"{b}.y1").alias("y1"))


def overlaps(a: Column, b: Column, pad: float = 0.0) -> Column:
    return (a["x0"] < b["x1"] + pad) & (b["x0"] < a["x1"] + pad) & (a["y0"] < b["y1"] + pad) & (b["y0"] < a["y1"] + pad)


def contains_centre(a: Column, b: Column, pad: float = 0.0) -> Column:
    """Whether the centre of ``b`` lies in ``a``."""
    return cx(b).between(a["x0"] - pad, a["x1"] + pad) & cy(b).between(a["y0"] - pad, a["y1"] + pad)


def iou(a: Column, b: Column) -> Column:
    across = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    down = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    both = across * down
    either = width(a) * height(a) + width(b) * height(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def _narrow(blocks: DataFrame) -> DataFrame:
    page = Window.partitionBy("doc", "page")
    t = blocks.withColumn("tx0", F.min("bbox.x0").over(page)).withColumn("tx1", F.max("bbox.x1").over(page))
    return t.withColumn("narrow", width(F.col("bbox")) < FULL_WIDTH * (F.col("tx1") - F.col("tx0")))


def columns(blocks: DataFrame) -> DataFrame:
    """(doc, page, col, x0, x1): x-ranges of a page's columns from the left: narrow boxes that overlap or lie within a
    gutter are one; slivers are dropped; without any, the whole text area is the column."""
    t = _narrow(blocks)
    order = Window.partitionBy("doc", "page").orderBy("bbox.x0", "bbox.x1")
    before = F.max("bbox.x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = t.filter("narrow").withColumn("new", F.when(before.isNull() | (F.col("bbox.x0") > before + GUTTER), 1).otherwise(0))
    grouped = cut.withColumn("g", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = grouped.groupBy("doc", "page", "g").agg(F.min("bbox.x0").alias("x0"), F.max("bbox.x1").alias("x1"), F.first("tx0").alias("tx0"), F.first("tx1").alias("tx1"))
    found = found.filter(F.col("x1") - F.col("x0") > SLIVER * (F.col("tx1") - F.col("tx0"))).select("doc", "page", "x0", "x1")
    whole = t.groupBy("doc", "page").agg(F.first("tx0").alias("x0"), F.first("tx1").alias("x1")).join(found, ["doc", "page"], "left_anti")
    number = F.row_number().over(Window.partitionBy("doc", "page").orderBy("x0", "x1")) - 1
    return found.unionByName(whole).withColumn("col", number).select("doc", "page", "col", "x0", "x1")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks (doc, page, id, bbox) with col (null: across all columns) and place: wide boxes part a page into bands;
    in a band, column by column from the top."""
    cols = columns(blocks).groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("col", "x0", "x1"))).alias("cols"))
    t = _narrow(blocks).join(cols, ["doc", "page"])
    near = F.array_min(F.transform("cols", lambda c: F.struct(F.abs((c["x0"] + c["x1"]) / 2 - cx(F.col("bbox"))).alias("d"), c["col"].alias("col"))))
    single = F.size("cols") == 1
    t = t.withColumn("col", F.when(single, F.lit(0)).when(F.col("narrow"), near["col"]))
    spans = F.col("col").isNull()
    page = Window.partitionBy("doc", "page")
    by_y = page.orderBy("bbox.y0").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("band", F.sum(F.when(spans, 1).otherwise(0)).over(by_y))
    order = page.orderBy("band", F.when(spans, 0).otherwise(1), F.coalesce("col", F.lit(-1)), "bbox.y0", "id")
    return t.withColumn("place", F.row_number().over(order)).drop("cols", "tx0", "tx1", "narrow")


def body_size(blocks: DataFrame) -> DataFrame:
    """(doc, page, body): the median font size, a block counting once for each 40 characters."""
    votes = F.greatest(F.lit(1), F.floor(F.length("text") / 40)).cast("bigint")
    return blocks.withColumn("votes", votes).groupBy("doc", "page").agg(F.percentile("size", F.lit(0.5), F.col("votes")).alias("body"))


def role(text: Column, size: Column, bold: Column, b: Column, body: Column, page_height: Column) -> Column:
    """caption, header, footer, heading or body, tried in this order."""
    top, bottom = b["y0"] < MARGIN * page_height, b["y1"] > (1 - MARGIN) * page_height
    n = F.length(text)
    margin = (top | bottom) & (n < MARGIN_CHARS) & (size <= body + MARGIN_SIZE)
    heading = (bold & (size >= body * 1.1)) | (bold & (n < 60) & text.rlike(HEADING)) | ((size >= body * 1.3) & (n < 120))
    return (
        F.when(text.rlike(CAPTION) & (n < CAPTION_CHARS), "caption")
        .when(margin, F.when(top, "header").otherwise("footer"))
        .when(heading, "heading")
        .otherwise("body")
    )


def captions(figures: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, page, fig, caption): for each figure the nearest caption that overlaps it across; one above counts 30 points
    farther. figures: doc, page, fig, bbox; texts: doc, page, ord, role, text, bbox."""
    cand = figures.select("doc", "page", "fig", F.col("bbox").alias("f")).join(texts.filter("role = 'caption'").select("doc", "page", "ord", "text", F.col("bbox").alias("c")), ["doc", "page"])
    across = F.least("f.x1", "c.x1") - F.greatest("f.x0", "c.x0")
    below, above = F.col("c.y0") - F.col("f.y1"), F.col("f.y0") - F.col("c.y1")
    is_below = below >= -CAPTION_OVERLAP
    gap = F.when(is_below, below).otherwise(above)
    cand = cand.filter((across > 0) & (gap >= -CAPTION_OVERLAP) & (gap <= CAPTION_GAP))
    score = gap + F.when(is_below, 0.0).otherwise(CAPTION_ABOVE)
    return cand.groupBy("doc", "page", "fig").agg(F.min_by("text", F.struct(score.alias("s"), "ord")).alias("caption"))


def next_page_captions(figures: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, page, fig, caption, caption_page): figures without a caption at a page's end and captions without a figure
    on the next page, paired in order. figures: doc, page, fig (unlinked); texts: doc, page, ord, text (unlinked)."""
    nth = lambda by: F.row_number().over(Window.partitionBy("doc", "page").orderBy(by))
    a = figures.select("doc", "page", "fig", nth("fig").alias("n"))
    b = texts.select("doc", (F.col("page") - 1).alias("page"), nth("ord").alias("n"), F.col("text").alias("caption"), F.col("page").alias("caption_page"))
    return a.join(b, ["doc", "page", "n"]).drop("n")


def table_titles(tables: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, page, tbl, title): the nearest heading less than 80 points above each table."""
    cand = tables.select("doc", "page", "tbl", F.col("bbox").alias("t")).join(texts.filter("role = 'heading'").select("doc", "page", "ord", "text", F.col("bbox").alias("h")), ["doc", "page"])
    gap = F.col("t.y0") - F.col("h.y1")
    return cand.filter((gap >= 0) & (gap < TITLE_GAP)).groupBy("doc", "page", "tbl").agg(F.min_by("text", F.struct(gap.alias("g"), "ord")).alias("title"))


def outside_tables(texts: DataFrame, tables: DataFrame) -> DataFrame:
    """Text blocks whose centre lies in no table of their page, within 2 points."""
    t = tables.select(F.col("doc").alias("td"), F.col("page").alias("tp"), F.col("bbox").alias("tb"))
    inside = (F.col("doc") == F.col("td")) & (F.col("page") == F.col("tp")) & contains_centre(F.col("tb"), F.col("bbox"), IN_TABLE)
    return texts.join(t, inside, "left_anti")


def figure_boxes(boxes: DataFrame, tables: DataFrame, least: float = 60.0) -> DataFrame:
    """Boxes (doc, page, bbox) at least 60 points both ways that overlap no table."""
    big = boxes.filter((width(F.col("bbox")) >= least) & (height(F.col("bbox")) >= least))
    t = tables.select(F.col("doc").alias("td"), F.col("page").alias("tp"), F.col("bbox").alias("tb"))
    return big.join(t, (F.col("doc") == F.col("td")) & (F.col("page") == F.col("tp")) & overlaps(F.col("tb"), F.col("bbox")), "left_anti")


def merge_figures(native: DataFrame, model: DataFrame) -> DataFrame:
    """Figures of the layout model, and native ones that match none of these (IoU over 0.3)."""
    m = model.select(F.col("doc").alias("md"), F.col("page").alias("mp"), F.col("bbox").alias("mb"))
    own = native.join(m, (F.col("doc") == F.col("md")) & (F.col("page") == F.col("mp")) & (iou(F.col("mb"), F.col("bbox")) > SAME_FIGURE), "left_anti")
    return model.unionByName(own)


def cells_of_words(words: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc, page, tbl, row, col, text): words (doc, page, x0, y0, x1, y1, text) by the cell their centre is in (cells:
    doc, page, tbl, row, col, bbox), in order of visual lines. A page's cells and words meet by their page alone."""
    w = words.withColumn("b", box("x0", "y0", "x1", "y1"))
    hit = cells.join(w.select("doc", "page", "b", F.col("text").alias("w")), ["doc", "page"]).filter(contains_centre(F.col("bbox"), F.col("b")))
    line = F.struct(F.col("b.y0").alias("y0"), F.col("b.y1").alias("y1"), F.col("b.x0").alias("x0"), F.col("w").alias("w"))
    grouped = hit.groupBy("doc", "page", "tbl", "row", "col").agg(F.collect_list(line).alias("ws"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["text"] = [re.sub(r"\s+", " ", " ".join(by_line([(w["x0"], w["y0"], w["y1"], w["w"]) for w in ws]))).strip() for ws in f["ws"]]
            yield f.drop(columns="ws")

    return grouped.mapInPandas(run, "doc string, page int, tbl string, row int, col int, text string")


def by_line(words: list[tuple[float, float, float, str]]) -> list[str]:
    """Words (x0, y0, y1, text) line by line: a word within half its height of a line's mean centre belongs to it."""
    lines: list[list[tuple[float, float, str]]] = []
    for x0, y0, y1, text in sorted(words, key=lambda w: (w[1] + w[2]) / 2):
        middle = (y0 + y1) / 2
        if lines and abs(middle - sum(m for _, m, _ in lines[-1]) / len(lines[-1])) < 0.5 * (y1 - y0):
            lines[-1].append((x0, middle, text))
        else:
            lines.append([(x0, middle, text)])
    return [t for line in lines for _, _, t in sorted(line, key=lambda w: w[0])]


def continuation_rows(rows: DataFrame) -> DataFrame:
    """Rows (tbl, n, cells) with those whose first cell is empty folded into the row before, cell by cell."""
    order = Window.partitionBy("tbl").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy("tbl").orderBy("n")) == 1
    starts = first | (F.element_at("cells", 1) != "") | ~F.exists(F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0))), lambda c: c != "")
    t = rows.withColumn("starts", starts.cast("int")).withColumn("g", F.sum("starts").over(order))
    parts = t.groupBy("tbl", "g").agg(F.array_sort(F.collect_list(F.struct("n", "cells"))).alias("p"), F.min("n").alias("n"))
    place = F.sequence(F.lit(1), F.size(F.element_at("p", 1)["cells"]))
    fold = F.transform(place, lambda i: F.trim(F.array_join(F.filter(F.transform("p", lambda r: F.try_element_at(r["cells"], i)), lambda c: c.isNotNull() & (c != "")), " ")))
    return parts.select("tbl", "n", fold.alias("cells"))


def plausible_table(cells: Column, b: Column, page_area: Column) -> Column:
    """At least 2 by 2, 60 % filled, and at most 70 % of the page."""
    flat = F.flatten(cells)
    filled = F.size(F.filter(flat, lambda c: c != "")) / F.greatest(F.size(flat), F.lit(1))
    return (F.size(cells) >= 2) & (F.array_max(F.transform(cells, F.size)) >= 2) & (filled >= 0.6) & (width(b) * height(b) <= 0.7 * page_area)


def word_integrity(words: Column, edges: Column) -> Column:
    """Share of words (x0, x1) that no column edge cuts more than a point inside; 0 without words."""
    whole = F.filter(words, lambda w: ~F.exists(edges, lambda e: (w["x0"] + 1 < e) & (e < w["x1"] - 1)))
    return F.when(F.size(words) > 0, F.size(whole) / F.size(words)).otherwise(F.lit(0.0))


def paragraphs(words: DataFrame) -> DataFrame:
    """(doc, page, block, par, text, bbox, conf): OCR words by paragraph, lines joined; conf is the mean of those known."""
    known = F.when(F.col("conf") >= 0, F.col("conf"))
    lines = words.groupBy("doc", "page", "block", "par", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ").alias("t"), union_box().alias("bbox"), F.sum(known).alias("s"), F.count(known).alias("k"))
    joined = T.join_lines(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]))
    return lines.groupBy("doc", "page", "block", "par").agg(joined.alias("text"), union_box().alias("bbox"), F.try_divide(F.sum("s"), F.sum("k")).alias("conf"))


def merge_paragraphs(blocks: DataFrame) -> DataFrame:
    """Blocks (doc, page, x0, y0, x1, y1, text, size, bold) with those split within a paragraph joined.

    A block joins one of the last six that lies just above it, in its column and size, unless it is a caption. What a
    block joins depends on what has been joined before, so a page is worked on as a whole, in pandas.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for b in pdf.sort_values(["y0", "x0"]).to_dict("records"):
            for p in reversed(out[-6:]):
                inside = b["x0"] >= p["x0"] - 3 and b["x1"] <= p["x1"] + 3
                if (inside or abs(p["x0"] - b["x0"]) < 3) and -2 <= b["y0"] - p["y1"] < 3 and abs(p["size"] - b["size"]) < 0.6 and not re.match(CAPTION, b["text"]):
                    hyphen = p["text"].endswith("-") and b["text"][:1].islower()
                    p["text"] = p["text"][:-1] + b["text"] if hyphen else f"{p['text']} {b['text']}".strip()
                    p.update(x0=min(p["x0"], b["x0"]), x1=max(p["x1"], b["x1"]), y1=max(p["y1"], b["y1"]))
                    break
            else:
                out.append(b)
        return pd.DataFrame(out, columns=pdf.columns)

    return blocks.groupBy("doc", "page").applyInPandas(one, blocks.schema)
