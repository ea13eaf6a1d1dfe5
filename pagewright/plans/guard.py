"""Read-only SQL: a guard on text and parsed plan, a row limit, a time limit, and words of another dialect."""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

#: Words that no read-only statement holds outside its strings.
WRITE_WORDS = "insert update delete drop alter create attach pragma replace".split()
QUERY_WORDS = ("select", "with")
LIMIT = 200
SECONDS = 5.0


class SQLError(Exception):
    """A statement that is refused or fails."""


@dataclass
class Result:
    columns: list[str]
    rows: list[Row]
    truncated: bool


#: A statement's tokens: strings, words, and any other sign.
TOKEN = re.compile(r"'(?:[^']|'')*'|\w+|[^\w\s]")


def check_text(sql: str) -> str:
    """The statement without its end mark. SQLError unless its tokens begin like a query's, none of them, strings
    included, has an end mark, and none outside strings is a word that writes."""
    statement = sql.strip().rstrip(";").strip()
    tokens = TOKEN.findall(statement)
    if not tokens or tokens[0].lower() not in QUERY_WORDS or any(";" in t for t in tokens):
        raise SQLError("only a single SELECT statement is allowed")
    if written := sorted({t.lower() for t in tokens} & set(WRITE_WORDS)):
        raise SQLError(f"statement contains a write/DDL keyword: {', '.join(written)}")
    return statement


def check_plan(spark: SparkSession, statement: str) -> None:
    """SQLError if any node of the parsed plan is a command: a WITH may hide one below its root."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception as e:
        raise SQLError(str(e).splitlines()[0]) from e
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if re.search("Command|Insert|Delete|Update|Merge|Drop|Create|Alter|Truncate|Replace(Table|Columns)|SetCatalog|SetNamespace", name):
            raise SQLError(f"statement contains {name}")
        for kids in (node.children(), node.innerChildren()):
            todo += [kids.apply(i) for i in range(kids.size()) if hasattr(kids.apply(i), "nodeName") and hasattr(kids.apply(i), "innerChildren")]


def query_sql(spark: SparkSession, sql: str, limit: int = LIMIT, seconds: float = SECONDS) -> Result:
    """Run one read-only statement: at most ``limit`` rows, cancelled after ``seconds``. SQLError on any failure.

    Double quotes name columns while it is parsed, as in the statements that models write.
    """
    statement = check_text(sql)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.ansi.enabled", "spark.sql.ansi.doubleQuotedIdentifiers")}
    tag = f"pagewright-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, lambda: spark.interruptTag(tag))
    try:
        for k in old:
            spark.conf.set(k, "true")
        check_plan(spark, statement)
        spark.addTag(tag)
        timer.start()
        found = spark.sql(statement).limit(limit + 1)
        rows = found.collect()
    except SQLError:
        raise
    except Exception as e:
        raise SQLError(str(e).splitlines()[0]) from e
    finally:
        timer.cancel()
        spark.removeTag(tag)
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return Result(found.columns, rows[:limit], len(rows) > limit)


def whole(spark: SparkSession, sql: str) -> DataFrame:
    """One read-only statement with all its rows, run when they are asked for. SQLError if it is refused."""
    statement = check_text(sql)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.ansi.enabled", "spark.sql.ansi.doubleQuotedIdentifiers")}
    try:
        for k in old:
            spark.conf.set(k, "true")
        check_plan(spark, statement)
        return spark.sql(statement)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def source_tables(sql: str, tables: list[str]) -> list[str]:
    """Tables whose name occurs in the statement."""
    return [t for t in tables if t.lower() in sql.lower()]


def answer_sql(spark: SparkSession, question: str, schema: str, write, tables: list[str]) -> tuple[str, Result, list[str]]:
    """(statement, result, source tables) of a question: ``write(question, schema, error)`` gives the statement, and
    once more with the error if the first fails."""
    statement = write(question, schema, None)
    try:
        result = query_sql(spark, statement)
    except SQLError as e:
        statement = write(question, schema, str(e))
        result = query_sql(spark, statement)
    return statement, result, source_tables(statement, tables)


def shown(result: Result, columns: int = 15, rows: int = 25) -> str:
    """A result as evidence: its first columns and rows, and how many rows there are."""
    lines = [" | ".join(result.columns[:columns])]
    lines += [" | ".join("" if v is None else str(v) for v in r[:columns]) for r in result.rows[:rows]]
    if len(result.rows) > rows:
        lines.append(f"... ({len(result.rows)} rows total)")
    return "\n".join(lines)
