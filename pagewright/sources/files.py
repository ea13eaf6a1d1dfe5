"""Sources: folders of files, CSV, spreadsheets, word-processor documents, HTML, question files, and plug-ins."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.tables import identifier

SUFFIXES = (".pdf", ".docx", ".csv", ".xlsx")
SNIFFED = 4096
BLOCKS = (
    "doc string, page int, ord bigint, kind string, role string, text string, cells array<array<string>>, title string, "
    "caption string, figure_id string"
)
NAMES = [c.split()[0] for c in BLOCKS.split(", ")]

#: Parsers by suffix: bytes and file name to blocks (dicts with the columns of BLOCKS). Formats that need libraries or
#: models that are not here (PDF, OCR, layout models) are added by ``register``.
PARSERS: dict[str, Callable[[bytes, str], list[dict]]] = {}


def register(suffix: str) -> Callable:
    def add(f: Callable[[bytes, str], list[dict]]) -> Callable[[bytes, str], list[dict]]:
        PARSERS[suffix] = f
        return f

    return add


def _frame(rows: list[dict]) -> pd.DataFrame:
    """Blocks as a frame, what is missing as None."""
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in NAMES})


def corpus(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, doc, suffix, length, content) of the files below a folder, dot files aside, in order of path. Content is
    read only where a query uses it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    doc = F.regexp_extract("path", "[^/]+$", 0)
    suffix = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    return files.select("path", doc.alias("doc"), suffix.alias("suffix"), "length", "content").filter(
        suffix.isin(*suffixes) & ~doc.startswith(".")
    ).orderBy("path")


def checksum(files: DataFrame, length: int = 16) -> DataFrame:
    return files.withColumn("hash", F.left(F.sha2("content", 256), F.lit(length)))


def parse(files: DataFrame) -> DataFrame:
    """Blocks of all files whose suffix has a parser. ValueError, when it runs, for a suffix without one."""
    parsers = dict(PARSERS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for doc, suffix, content in zip(f["doc"], f["suffix"], f["content"], strict=True):
                if suffix not in parsers:
                    raise ValueError(f"unsupported file: {doc}")
                yield _frame([{"doc": doc, **b} for b in parsers[suffix](content, doc)])

    return files.select("doc", "suffix", "content").mapInPandas(run, BLOCKS)


def numbered(df: DataFrame, column: str = "n") -> DataFrame:
    """``df`` with row numbers from 0 in reading order: places within partitions, plus the sizes of those before."""
    part, place = F.spark_partition_id(), F.monotonically_increasing_id() % F.lit(1 << 33)
    sizes = df.select(part.alias("p")).groupBy("p").count().orderBy("p").collect()
    starts, before = {}, 0
    for r in sizes:
        starts[r["p"]] = before
        before += r["count"]
    table = F.create_map(*(F.lit(x) for kv in starts.items() for x in kv)) if starts else F.create_map(F.lit(0), F.lit(0))
    return df.withColumn(column, (table[part] + place).cast("bigint"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows (n, cells) of a CSV file, its separator guessed from the first lines: one of ``, ; tab |``."""
    head = "\n".join(r[0] for r in spark.read.text(path).limit(50).collect())[:SNIFFED]
    try:
        sep = csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter
    except csv.Error:
        sep = ","
    raw = spark.read.csv(path, sep=sep, header=False, inferSchema=False, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    cells = F.transform(F.array(*(F.col(c) for c in raw.columns)), lambda c: F.regexp_replace(c, "^﻿", ""))
    return numbered(raw.select(cells.alias("cells")))


_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(reference: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def xlsx_rows(content: bytes, doc: str) -> list[tuple[str, int, list[str | None]]]:
    """(table, n, cells) of each sheet with a filled row: values, not formulas; blank rows dropped. The table is the
    file's name, with the sheet's if there are several."""
    z = zipfile.ZipFile(io.BytesIO(content))
    xml = lambda name: ElementTree.fromstring(z.read(name))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_X}t")) for s in xml("xl/sharedStrings.xml").iter(f"{_X}si")]
    targets = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
    sheets = [(s.get("name"), targets[s.get(f"{_R}id")]) for s in xml("xl/workbook.xml").iter(f"{_X}sheet")]
    stem, out = re.sub(r"\.[^.]*$", "", doc), []
    for name, target in sheets:
        rows = []
        for row in xml("xl/" + target.lstrip("/").removeprefix("xl/")).iter(f"{_X}row"):
            cells: dict[int, str | None] = {}
            for c in row.iter(f"{_X}c"):
                v, kind = c.find(f"{_X}v"), c.get("t")
                text = "".join(t.text or "" for t in c.iter(f"{_X}t")) if kind == "inlineStr" else (v.text if v is not None else None)
                cells[_column(c.get("r"))] = shared[int(text)] if kind == "s" and text else text
            if any(v and v.strip() for v in cells.values()):
                rows.append([cells.get(i) for i in range(max(cells) + 1)])
        table = identifier(stem) if len(sheets) == 1 else f"{identifier(stem)}__{identifier(name)}"
        out += [(table, n, r) for n, r in enumerate(rows)]
    return out


def read_xlsx(files: DataFrame) -> DataFrame:
    """(doc, tbl, n, cells) of all sheets of spreadsheet files (doc, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for doc, content in zip(f["doc"], f["content"], strict=True):
                yield pd.DataFrame([(doc, *r) for r in xlsx_rows(content, doc)], columns=["doc", "tbl", "n", "cells"])

    return files.select("doc", "content").mapInPandas(run, "doc string, tbl string, n bigint, cells array<string>")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


@register(".docx")
def docx_blocks(content: bytes, doc: str) -> list[dict]:
    """Blocks of a word-processor document in the order of its body; all on page 1, as pages are known only when it is
    laid out. Merged cells count once."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    out, heading = [], None
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    for e in body:
        b = {"page": 1, "ord": len(out)}
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") if style is not None else "").lower()
            if not (text := words(e)):
                continue
            role = "heading" if name.startswith(("heading", "title")) else "caption" if name.startswith("caption") else "body"
            heading = text if role == "heading" else heading
            out.append(b | {"kind": "text", "role": role, "text": text})
        elif e.tag == f"{_W}tbl":
            rows = []
            for tr in e.iter(f"{_W}tr"):
                cells = []
                for tc in tr.findall(f"{_W}tc"):
                    merge = tc.find(f"{_W}tcPr/{_W}vMerge")
                    cells.append("" if merge is not None and merge.get(f"{_W}val") != "restart" else words(tc))
                rows.append(cells)
            out.append(b | {"kind": "table", "cells": rows, "title": heading})
    return out


class _Html(HTMLParser):
    HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
    TEXTS = (*HEADINGS, "p", "li", "title", "figcaption", "blockquote", "pre")
    MARGINS = {"nav": "header", "header": "header", "footer": "footer"}

    def __init__(self) -> None:
        super().__init__()
        self.out: list[dict] = []
        self.text, self.tag, self.margin, self.skip, self.rows = "", None, [], 0, None

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", self.text).strip()
        if text and self.rows is None:
            role = self.margin[-1] if self.margin else "heading" if self.tag in self.HEADINGS else "caption" if self.tag == "figcaption" else "body"
            self.out.append({"page": 1, "ord": len(self.out), "kind": "text", "role": role, "text": text})
            self.text = ""
        elif self.rows is None:
            self.text = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.flush()
            self.rows = []
        elif self.rows is not None and tag == "tr":
            self.rows.append([])
        elif self.rows is not None and tag in ("td", "th"):
            self.text = ""
        elif tag in self.TEXTS or tag in self.MARGINS or tag in ("div", "body", "br"):
            self.flush()
            self.tag = tag if tag in self.TEXTS else None
            if tag in self.MARGINS:
                self.margin.append(self.MARGINS[tag])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif self.rows is not None and tag in ("td", "th") and self.rows:
            self.rows[-1].append(re.sub(r"\s+", " ", self.text).strip())
            self.text = ""
        elif tag == "table" and self.rows is not None:
            if any(self.rows):
                self.out.append({"page": 1, "ord": len(self.out), "kind": "table", "cells": [r for r in self.rows if r]})
            self.rows, self.text = None, ""
        elif tag in self.TEXTS or tag in self.MARGINS or tag in ("div", "body"):
            self.flush()
            self.tag = None
            if tag in self.MARGINS and self.margin:
                self.margin.pop()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text += data


def html_blocks(html: str) -> list[dict]:
    parser = _Html()
    parser.feed(html or "")
    parser.flush()
    return parser.out


@register(".html")
def html_file(content: bytes, doc: str) -> list[dict]:
    return html_blocks(content.decode(errors="replace"))


def read_html(pages: DataFrame) -> DataFrame:
    """Blocks of HTML texts (doc, html): headings, paragraphs, tables; navigation and footers by their role."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"doc": d, **b} for d, h in zip(f["doc"], f["html"], strict=True) for b in html_blocks(h)]
            yield _frame(rows)

    return pages.select(F.col("doc").cast("string").alias("doc"), "html").mapInPandas(run, BLOCKS)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their reference answers and evidence, from a JSON file or folder."""
    schema = "id string, type string, question string, reference_answer string, evidence array<struct<doc: string, page: int>>"
    return spark.read.schema(schema).json(path, multiLine=True)
