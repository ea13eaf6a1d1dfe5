"""Where blocks without geometry of their own lie: found in rendered pages, in document order, or made up as a flow."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.layout import FIGURE_TITLE, contains_centre

#: Words of a text that are looked for, longest first; least characters of what is looked for.
PREFIXES = (8, 5, 3)
LEAST_NEEDLE, LEAST_ROW_NEEDLE = 4, 12
#: Fixed values, in points: of made-up boxes, and of the pieces of a table.
GAP, LINE, LINE_CHARS, ROW, IMAGE = 6.0, 14.0, 95, 16.0, 200.0
HEADER_ROOM, BOTTOM_ROOM = 16.0, 4.0
#: Figures on scanned pages.
PROSE_WORDS, SCAN_GAP, SCAN_PAD, CAPTION_ROOM, LEAST_FIGURE = 8, 60.0, 4.0, 2.0, 60.0


def locate(needles: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, n, page) of each needle (doc, n, text): the first page, from the last one found on, whose text (pages: doc,
    page, text) holds the needle's first words; fewer words are tried where more are not found. Null: not found.

    A document's needles are looked for in order and each search begins where the last ended, which no window can say;
    so a document's needles and pages meet in one group.
    """
    both = needles.select("doc", "n", F.lit(None).cast("int").alias("page"), "text").unionByName(pages.select("doc", F.lit(None).cast("bigint").alias("n"), F.col("page").cast("int").alias("page"), "text"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf[pdf["n"].isna()].sort_values("page")
        texts, numbers = [re.sub(r"\s+", " ", t or "") for t in held["text"]], held["page"].astype(int).tolist()
        wanted = pdf[pdf["n"].notna()].sort_values("n")
        at, found = 0, []
        for text in wanted["text"]:
            words = re.sub(r"\s+", " ", text or "").strip().split(" ")
            tried = [" ".join(words[:k]) for k in PREFIXES]
            hits = (next((i for i in range(at, len(texts)) if t in texts[i]), None) for t in tried if len(t) >= LEAST_NEEDLE)
            hit = next((i for i in hits if i is not None), None)
            at = at if hit is None else hit
            found.append(None if hit is None else numbers[hit])
        return pd.DataFrame({"doc": wanted["doc"], "n": wanted["n"].astype("int64"), "page": pd.array(found, dtype="Int32")})

    kind = needles.schema["doc"].dataType.simpleString()
    return both.groupBy("doc").applyInPandas(one, f"doc {kind}, n bigint, page int")


def row_needle(cells: Column) -> Column:
    """What a table's row is looked for by: its longest cell, the first of equals; null if that is short."""
    longest = F.array_max(F.transform(cells, lambda c, i: F.struct(F.length(F.coalesce(c, F.lit(""))).alias("l"), (-i).alias("o"), c.alias("c"))))
    return F.when(longest["l"] >= LEAST_ROW_NEEDLE, longest["c"])


def table_pieces(rows: DataFrame, first_page: int = 1) -> DataFrame:
    """(doc, piece, page, first_row, last_row, continued) of a table's rows (doc, n, page): a row not found is on the page of
    the row before; consecutive rows of one page are a piece."""
    order = Window.partitionBy("doc").orderBy("n")
    t = rows.withColumn("page", F.coalesce(F.last("page", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(first_page)))
    new = F.when(F.lag("page").over(order).eqNullSafe(F.col("page")), 0).otherwise(1)
    t = t.withColumn("new", new).withColumn("piece", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = t.groupBy("doc", "piece").agg(F.first("page").alias("page"), F.min("n").alias("first_row"), F.max("n").alias("last_row"))
    return out.withColumn("continued", F.col("piece") > 1)


def flow_height(kind: Column, text: Column, n_rows: Column) -> Column:
    """The height of a made-up box: by a text's length, a table's rows, or an image's standard."""
    lines = F.floor(F.length(F.coalesce(text, F.lit(""))) / LINE_CHARS) + 1
    return F.when(kind == "table", n_rows * ROW).when(kind == "image", F.lit(IMAGE)).otherwise(lines * LINE).cast("double")


def flow(blocks: DataFrame, top: float, x0: float, x1: float) -> DataFrame:
    """Blocks (doc, n, height) with page 1 and a box below those before: for what no rendered page places."""
    before = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    y0 = F.lit(top) + F.coalesce(F.sum(F.col("height") + GAP).over(before), F.lit(0.0))
    box = F.struct(F.lit(x0).alias("x0"), y0.alias("y0"), F.lit(x1).alias("x1"), (y0 + F.col("height")).alias("y1"))
    return blocks.withColumn("page", F.lit(1)).withColumn("bbox", box)


def next_images(items: DataFrame, images: DataFrame) -> DataFrame:
    """Items (doc, n) with the page and box of the rendered image (doc, page, at, bbox) of the same place in the document's
    order; null where images have run out."""
    k = F.row_number().over(Window.partitionBy("doc").orderBy("n"))
    j = F.row_number().over(Window.partitionBy("doc").orderBy("page", "at"))
    return items.withColumn("k", k).join(images.withColumn("k", j).drop("at"), ["doc", "k"], "left").drop("k")


def placed(blocks: DataFrame, located: DataFrame, made_up: DataFrame) -> DataFrame:
    """Blocks (doc, n) with page and bbox: as located (doc, n, page, bbox) where that has a page, else as made up."""
    a = located.select("doc", "n", F.col("page").alias("lpage"), F.col("bbox").alias("lbox"))
    b = made_up.select("doc", "n", F.col("page").alias("fpage"), F.col("bbox").alias("fbox"))
    t = blocks.join(a, ["doc", "n"], "left").join(b, ["doc", "n"], "left")
    return t.withColumn("page", F.coalesce("lpage", "fpage")).withColumn("bbox", F.coalesce("lbox", "fbox")).drop("lpage", "lbox", "fpage", "fbox")


def scan_figures(texts: DataFrame, page_width: Column) -> DataFrame:
    """(doc, page, ord, caption, bbox): on scanned pages, the figure above each caption (texts: doc, page, ord, role, text,
    col, bbox): from the last prose above it in its column, with a gap, down to the caption. Bands under LEAST_FIGURE are
    none."""
    cap = texts.filter((F.col("role") == "caption") & ~F.col("text").rlike(FIGURE_TITLE)).select("doc", "page", "ord", "col", F.col("text").alias("caption"), F.col("bbox").alias("c"), page_width.alias("w"))
    other = texts.select("doc", "page", "col", F.col("ord").alias("o"), F.col("text").alias("t"), F.col("bbox").alias("b"))
    above = cap.join(other, ["doc", "page", "col"], "left").withColumn("up", (F.col("o") != F.col("ord")) & (F.col("b.y1") <= F.col("c.y0")))
    words = F.size(F.filter(F.split("t", r"\s+"), lambda x: x != ""))
    prose = F.col("up") & (words >= PROSE_WORDS) & (F.col("c.y0") - F.col("b.y1") > SCAN_GAP) & ~F.col("t").rlike(FIGURE_TITLE)
    by = above.groupBy("doc", "page", "ord", "caption", "c", "w").agg(
        F.coalesce(F.max(F.when(prose, F.col("b.y1"))), F.lit(0.0)).alias("top"), F.min(F.when(F.col("up"), F.col("b.x0"))).alias("left"), F.max(F.when(F.col("up"), F.col("b.x1"))).alias("right")
    )
    top = F.col("top") + SCAN_PAD
    left, right = F.least("left", "c.x0") - SCAN_PAD, F.greatest("right", "c.x1") + SCAN_PAD
    box = F.struct(F.greatest(F.lit(0.0), left).alias("x0"), top.alias("y0"), F.least(F.col("w"), right).alias("x1"), (F.col("c.y0") - CAPTION_ROOM).alias("y1"))
    return by.filter(F.col("c.y0") - top >= LEAST_FIGURE).select("doc", "page", "ord", "caption", box.alias("bbox"))


def labels_inside(figures: DataFrame, texts: DataFrame) -> DataFrame:
    """figures (doc, page, ord, bbox) with labels: the distinct words of the texts whose centres lie in them."""
    t = texts.select("doc", "page", F.col("bbox").alias("b"), F.explode(F.split("text", r"\s+")).alias("w")).filter("w <> ''")
    met = figures.join(t, ["doc", "page"]).filter(contains_centre(F.col("bbox"), F.col("b")))
    by = met.groupBy("doc", "page", "ord").agg(F.array_sort(F.collect_set("w")).alias("labels"))
    return figures.join(by, ["doc", "page", "ord"], "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def from_bottom_left(b: Column, page_height: Column) -> Column:
    """A box whose y grows upwards, from the page's foot, as one whose y grows downwards from its head."""
    return F.struct(b["x0"].alias("x0"), (page_height - b["y1"]).alias("y0"), b["x1"].alias("x1"), (page_height - b["y0"]).alias("y1"))


def grid_rows(grid: Column) -> Column:
    """A layout model's grid: white space in cells made plain, rows without any text left out."""
    clean = F.transform(grid, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    return F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))


def unmerged(cells: Column, ids: Column) -> Column:
    """A row's cells, those of one merged cell (adjacent ones with the same id) once."""
    kept = F.filter(F.arrays_zip(cells.alias("c"), ids.alias("i"), F.transform(ids, lambda x, k: k).alias("k")), lambda x: (x["k"] == 0) | ~x["i"].eqNullSafe(F.try_element_at(ids, x["k"])))
    return F.transform(kept, lambda x: F.trim(F.regexp_replace(F.coalesce(x["c"], F.lit("")), r"\s+", " ")))
