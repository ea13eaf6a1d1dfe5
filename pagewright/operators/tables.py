"""Typed tables from messy ones: header search, type inference, coercion, row texts, schema description."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T

#: Fixed values of the loader.
HEADER_ROWS = 15
NUMERIC_SHARE = 0.9
ENUM_VALUES = 20
SAMPLES = 3
WIDE, WIDE_HEAD, WIDE_TAIL = 30, 20, 8
SQL_TYPES = {"int": "INTEGER", "float": "REAL", "date": "TEXT", "text": "TEXT"}
#: What Python's float() accepts, separators dropped: Spark's cast takes other forms, such as 12d.
FLOAT = r"(?i)^\s*[+-]?((\d+(_\d+)*)?\.?\d+(_\d+)*|\d+(_\d+)*\.?)(e[+-]?\d+)?\s*$|^\s*[+-]?(inf|infinity|nan)\s*$"


def identifier(name: str) -> str:
    """A name that SQL takes: lower case, other characters to underscores; ``col`` if nothing is left."""
    return re.sub("[^0-9a-zA-Z_]+", "_", str(name).strip()).strip("_").lower() or "col"


def column_names(header: list[str | None]) -> list[str]:
    """Names for a header row: blanks are col_<i>, repeats get _1, _2, ..."""
    out, seen = [], {}
    for i, cell in enumerate(header, 1):
        name = identifier(cell) if cell is not None and str(cell).strip() else f"col_{i}"
        seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}_{seen[name]}" if seen[name] else name)
    return out


def blank(v: Column) -> Column:
    return v.isNull() | (F.trim(v) == "")


def plain_number(v: Column) -> Column:
    return F.translate(v, ",", "")


def is_number(v: Column) -> Column:
    return plain_number(v).rlike(FLOAT)


def as_number(v: Column) -> Column:
    """The number in a cell, null where Python's float() would fail."""
    return F.when(is_number(v), F.translate(F.trim(plain_number(v)), "_", "").try_cast("double"))


def header_cells(cells: Column) -> Column:
    """How many cells of a row look like names: not blank, and not only digits and money marks."""
    return F.size(F.filter(cells, lambda c: ~blank(c) & ~F.trim(c).rlike(r"^[\d.,%€$£-]+$")))


def header_row(rows: DataFrame) -> DataFrame:
    """The row number (n, from 0) of each table's header in rows (tbl, n, cells): of the first HEADER_ROWS the one
    with the most name-like cells, the earliest of equals; row 0 if none has two."""
    scored = rows.filter(F.col("n") < HEADER_ROWS).withColumn("names", header_cells(F.col("cells")))
    best = F.max_by("n", F.when(F.col("names") >= 2, F.struct("names", (-F.col("n")).alias("o"))))
    return scored.groupBy("tbl").agg(F.coalesce(best, F.lit(0).cast("bigint")).alias("header"))


def type_of(nonblank: Column, dates: Column, numbers: Column, whole: Column) -> Column:
    """int, float, date or text from counts: of cells that are not blank, and among them of dates, numbers, and
    numbers that are whole and written without a point."""
    return (
        F.when(nonblank == 0, "text")
        .when(dates == nonblank, "date")
        .when((numbers < NUMERIC_SHARE * nonblank) | (numbers == 0), "text")
        .when(whole == numbers, "int")
        .otherwise("float")
    )


def profile(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, place, type, n_distinct, samples) for each string column, in one pass over the table.

    samples: all distinct values of a text column with at most ENUM_VALUES of them, else the first SAMPLES, as
    strings, sorted. Distinct values are counted by a second, per-column aggregation of (column, value) pairs, which
    is summed on the map side; only the least ones are kept.
    """
    columns = columns or table.columns
    cells = table.select(F.posexplode(F.array(*(F.col(f"`{c}`").cast("string") for c in columns))).alias("place", "v"))
    v = F.col("v")
    number = as_number(v)
    stats = cells.groupBy("place").agg(
        F.count_if(~blank(v)).alias("nonblank"),
        F.count_if(~blank(v) & F.trim(v).rlike(r"^\d{4}-\d{2}-\d{2}$")).alias("dates"),
        F.count_if(~blank(v) & is_number(v)).alias("numbers"),
        F.count_if(~blank(v) & is_number(v) & (number == F.floor(number)) & ~F.contains(v, F.lit("."))).alias("whole"),
    )
    typed = stats.select("place", type_of(F.col("nonblank"), F.col("dates"), F.col("numbers"), F.col("whole")).alias("type"))
    values = cells.join(F.broadcast(typed), "place").withColumn("value", coerced(v, F.col("type"))).filter("value is not null")
    values = values.groupBy("place", "value").agg(F.first("type").alias("type"))
    order = Window.partitionBy("place").orderBy("value")
    least = values.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= ENUM_VALUES).groupBy("place").agg(F.array_sort(F.collect_list("value")).alias("least"))
    counts = values.groupBy("place").agg(F.count(F.lit(1)).alias("n_distinct"))
    names = F.array(*(F.lit(c) for c in columns))
    out = typed.join(counts, "place", "left").join(least, "place", "left")
    n = F.coalesce("n_distinct", F.lit(0))
    shown = F.when((F.col("type") == "text") & (n <= ENUM_VALUES), F.col("least")).otherwise(F.slice("least", 1, SAMPLES))
    return out.select(
        F.element_at(names, F.col("place") + 1).alias("column"), "place", "type", n.alias("n_distinct"), F.coalesce(shown, F.array().cast("array<string>")).alias("samples")
    )


def coerced(v: Column, kind: Column) -> Column:
    """A cell as its column's type, written as text: whole numbers, floats as Spark writes them; null if it is none."""
    number = as_number(v)
    return (
        F.when(blank(v), F.lit(None))
        .when(kind == "int", number.cast("bigint").cast("string"))
        .when(kind == "float", number.cast("string"))
        .when(kind == "date", v)
        .otherwise(F.trim(v))
    )


def coerce(table: DataFrame, types: dict[str, str]) -> DataFrame:
    """The table with its string columns as bigint, double or string; what is no number becomes null."""
    def one(c: str, kind: str) -> Column:
        v = F.col(f"`{c}`")
        if kind == "int":
            return F.when(~blank(v), as_number(v)).cast("bigint").alias(c)
        if kind == "float":
            return F.when(~blank(v), as_number(v)).alias(c)
        return F.when(~blank(v), v if kind == "date" else F.trim(v)).alias(c)

    return table.select(*(one(c, types[c]) if c in types else F.col(f"`{c}`") for c in table.columns))


def load(rows: DataFrame, name: str, doc: str) -> tuple[DataFrame, DataFrame]:
    """(typed table with _row first; its profile) from rows (n, cells) of one sheet.

    The header is looked for among the first rows, which the driver reads; names and types follow from it and from one
    aggregation. _row counts from 1 after the header. Rows shorter than the header are filled with nulls.
    """
    first = [r["cells"] for r in rows.filter(F.col("n") < HEADER_ROWS).orderBy("n").select("cells").collect()]
    looks = [sum(1 for c in r if c and c.strip() and not re.fullmatch(r"[\d.,%€$£-]+", c.strip())) for r in first]
    best = max(looks, default=0)
    at = looks.index(best) if best >= 2 else 0
    names = column_names(first[at]) if first else []
    body = rows.filter(F.col("n") > at).select((F.col("n") - at).alias("_row"), *(F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(names)))
    found = profile(body, names)
    types = {r["column"]: r["type"] for r in found.select("column", "type").collect()}
    typed = coerce(body, types)
    return typed, found.withColumns({"tbl": F.lit(identifier(name)), "doc": F.lit(doc)})


def replace_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (doc, tbl, row, text) with those of the tables in ``new`` replaced by the new ones."""
    return old.join(F.broadcast(new.select("doc", "tbl").distinct()), ["doc", "tbl"], "left_anti").unionByName(new)


def row_texts(typed: DataFrame, name: str, doc: str) -> DataFrame:
    """(doc, tbl, row, text) for each row of a typed table."""
    values = {c: F.col(f"`{c}`") for c in typed.columns if c != "_row"}
    return typed.select(F.lit(doc).alias("doc"), F.lit(name).alias("tbl"), F.col("_row").alias("row"), T.typed_row_text(name, F.col("_row"), values).alias("text"))


def structured_chunks(rows: DataFrame) -> DataFrame:
    """One chunk a row of a table: id, doc, page 1, kind, text, prefix, identifiers."""
    row = F.col("row").cast("string")
    return rows.select(
        F.concat_ws("#", "doc", "tbl", F.concat(F.lit("row"), row)).alias("id"),
        "doc",
        F.lit(1).alias("page"),
        F.lit("structured_row").alias("kind"),
        "text",
        F.concat_ws(" › ", "doc", "tbl", F.concat(F.lit("row "), row)).alias("prefix"),
        T.extract_identifiers(F.col("text")).alias("identifiers"),
    )


def describe(profiles: DataFrame, n_rows: dict[str, int]) -> str:
    """The schema as text for a model that writes SQL: tables by name, columns with types and examples; of wide tables
    the first and last columns. Reads the profiles, a few rows a table."""
    by_table: dict[tuple[str, str], list] = {}
    for r in profiles.orderBy("tbl", "place").collect():
        by_table.setdefault((r["tbl"], r["doc"]), []).append(r)
    lines = []
    for (tbl, doc), cols in by_table.items():
        lines.append(f'TABLE "{tbl}"  -- source file: {doc}, {n_rows.get(tbl, 0)} rows; column _row = 1-based source row number')
        hidden = cols[WIDE_HEAD:-WIDE_TAIL] if len(cols) > WIDE else []
        for i, c in enumerate(cols):
            if hidden and i == WIDE_HEAD:
                kind = SQL_TYPES[hidden[0]["type"]]
                lines.append(f"  ... {len(hidden)} more columns named like the ones above ({hidden[0]['column']} .. {hidden[-1]['column']}), all {kind}")
            if hidden and WIDE_HEAD <= i < len(cols) - WIDE_TAIL:
                continue
            every = c["type"] == "text" and c["n_distinct"] <= ENUM_VALUES
            lines.append(f'  "{c["column"]}" {SQL_TYPES[c["type"]]}  -- {c["n_distinct"]} distinct; {"values:" if every else "e.g."} {", ".join(c["samples"])}')
    return "\n".join(lines)


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())
