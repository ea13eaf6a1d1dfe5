"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior replaces all-must-pass.

Only DataFrame functions touch the documents; EM runs on the counts of vote patterns, of which there are at most
3 to the power of the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Rules by name: condition for a vote against a document, then for a vote for it, over the base columns (SQL that
#: Spark and DuckDB read alike). Neither: the rule abstains. Each defect is looked at by two rules that differ in what
#: they measure or how strict they are: where both speak, their agreement shows how far each can be trusted.
RULES = {
    "length": ("n_words < 50", "n_words >= 100 AND n_words <= 100000"),
    "word_length": ("word_chars < 3 * n_words OR word_chars > 15 * n_words", "word_chars >= 4 * n_words AND word_chars <= 10 * n_words"),
    "symbols": ("10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    "symbol_chars": ("100 * n_symbols > word_chars", "500 * n_symbols <= word_chars"),
    "repeats": ("100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 20 * n_words"),
    "windows": ("100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    "lines": ("5 * n_dup_lines > n_lines", "10 * n_dup_lines <= n_lines"),
}
ROUNDS = 20
THRESHOLD = 0.5
#: Where EM starts: the chance that a document is good if two rules or more vote against it, and if fewer do.
START = (0.05, 0.95)
#: Mild prior on how rules vote (against, abstain, for) on bad and on good documents, the same for all rules. It counts
#: as much as WEIGHT of the documents; within it EM is free, and no chance is held within bounds.
PRIOR = ((0.4, 0.2, 0.4), (0.1, 0.2, 0.7))
WEIGHT = 0.05


@dataclass(frozen=True)
class Model:
    """prior: share of good documents; given[c][j][v + 1]: chance that rule j votes v given class c (0 bad, 1 good)."""

    prior: float
    given: tuple[tuple[tuple[float, float, float], ...], ...]


def _covered(words: Column) -> Column:
    """Positions in 3-word windows that occur twice or more: hash the windows, sort, and compare neighbours."""
    n = F.size(words)
    none = F.array().cast("array<int>")

    def hashed(i: Column) -> Column:
        return F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i"))

    def again(s: Column) -> Column:
        m = F.size(s) - 1
        both = F.zip_with(
            F.slice(s, F.lit(1), m), F.slice(s, F.lit(2), m), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
        )
        return F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))

    def width(at: Column) -> Column:
        m = F.size(at) - 1
        gaps = F.zip_with(F.slice(at, F.lit(1), m), F.slice(at, F.lit(2), m), lambda a, b: F.least(b - a, F.lit(3)))
        return F.when(m < 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda x, y: x + y))

    repeated = F.when(
        n >= 4, let(F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), hashed)), again)
    ).otherwise(none)
    return let(repeated, width)


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id and the base counts of each row's whole text (null: empty), all bigint.

    n_words, word_chars (code points in words), n_symbols (of ``#*$%&|<>``), n_lines (lines with a word), n_dup_lines
    (of these, equal to an earlier one), n_repeat_words (words in 3-word windows found twice or more).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    found = docs.select(
        F.col("doc_id"),
        let(words, lambda w: F.struct(F.size(w).alias("n"), _covered(w).alias("again"))).alias("words"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("own"))).alias("lines"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
    )
    return found.select(
        "doc_id",
        F.col("words.n").cast("bigint").alias("n_words"),
        F.col("word_chars").cast("bigint").alias("word_chars"),
        F.col("n_symbols").cast("bigint").alias("n_symbols"),
        F.col("lines.n").cast("bigint").alias("n_lines"),
        (F.col("lines.n") - F.col("lines.own")).cast("bigint").alias("n_dup_lines"),
        F.col("words.again").cast("bigint").alias("n_repeat_words"),
    )


def votes(base: DataFrame) -> DataFrame:
    """``base`` with vote_<rule>: -1 against, 1 for, 0 abstains."""
    cast = {f"vote_{k}": F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END") for k, (bad, good) in RULES.items()}
    return base.withColumns(cast)


def fit(voted: DataFrame, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over the counts of vote patterns of all rows.

    The estimates are those of the largest posterior under PRIOR, with WEIGHT. An empty table gives the prior itself.
    """
    names = [f"vote_{k}" for k in RULES]
    patterns = [(r[:-1], r[-1]) for r in voted.groupBy(*names).count().orderBy(*names).collect()]
    good = [START[0] if p.count(-1) > 1 else START[1] for p, _ in patterns]
    total = sum(n for _, n in patterns)
    weight = WEIGHT * total or 1.0
    for _ in range(rounds):
        mass = [sum(n * (1 - g) for (_, n), g in zip(patterns, good, strict=True)), sum(n * g for (_, n), g in zip(patterns, good, strict=True))]
        prior = (mass[1] + 1) / (total + 2)
        given = []
        for c in (0, 1):
            rows = []
            for j in range(len(names)):
                by = [weight * x for x in PRIOR[c]]
                for (p, n), g in zip(patterns, good, strict=True):
                    by[p[j] + 1] += n * (g if c else 1 - g)
                rows.append(tuple(x / (mass[c] + weight) for x in by))
            given.append(tuple(rows))
        model = Model(prior, tuple(given))
        good = [_posterior(model, p) for p, _ in patterns]
    return model


def _posterior(model: Model, pattern: tuple[int, ...]) -> float:
    bad, good = 1 - model.prior, model.prior
    for j, v in enumerate(pattern):
        bad *= model.given[0][j][v + 1]
        good *= model.given[1][j][v + 1]
    return good / (bad + good)


def posterior(model: Model) -> Column:
    """The chance that a row of ``votes`` is good."""

    def side(c: int, prior: float) -> Column:
        out = F.lit(prior)
        for j, k in enumerate(RULES):
            table = F.array(*(F.lit(x) for x in model.given[c][j]))
            out = out * F.element_at(table, F.col(f"vote_{k}") + 2)
        return out

    good = side(1, model.prior)
    return good / (side(0, 1 - model.prior) + good)


def judge(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Base columns, votes, ``base_failed``, ``posterior`` and ``kept`` for each row of ``docs``.

    base_failed: under 50 words, or over half the words in repeated windows. kept: not base_failed and a posterior
    of at least ``threshold``. Null or empty text: no words, so base_failed. Null ids and repeated rows each give a
    row; other columns are not looked at; an empty table gives no rows.
    """
    voted = cut(votes(base_columns(docs)), "votes")  # some 60 bytes a row, so that texts are read once
    model = fit(voted)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.withColumn("base_failed", failed).withColumn("posterior", posterior(model)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)
    )


def sift(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns as they are.

    Rows are written once with their votes, so that texts are looked at once; the verdict stands beside its row, so no
    join is needed and repeated or null ids do not matter.
    """
    whole = docs.select(F.struct(*docs.columns).alias("doc_id"), F.col("text"))
    voted = cut(votes(base_columns(whole)), "voted")
    model = fit(voted)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.filter(~failed & (posterior(model) >= threshold)).select("doc_id.*")


def oracle() -> str:
    """DuckDB SQL for ``judge``'s contract columns: counts by unnesting, EM as one pair of CTEs a round."""
    names = [f"vote_{k}" for k in RULES]
    cases = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS vote_{k}" for k, (bad, good) in RULES.items())
    ctes = [
        "d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents)",
        "s AS MATERIALIZED (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,"
        " list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d)",
        "w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM s)",
        "t3 AS (SELECT rid, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY rid ORDER BY i))",
        "g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM t3 WHERE c IS NOT NULL)",
        "r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY rid)",
        "b AS MATERIALIZED (SELECT rid, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,"
        " length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,"
        " (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM s LEFT JOIN r USING (rid))",
        f"v AS MATERIALIZED (SELECT *, {cases} FROM b)",
        f"p AS MATERIALIZED (SELECT {', '.join(names)}, count(*)::DOUBLE AS n FROM v GROUP BY ALL)",
        f"good0 AS MATERIALIZED (SELECT *, CASE WHEN {' + '.join(f'({n} = -1)::INT' for n in names)} > 1 THEN {START[0]}::DOUBLE ELSE {START[1]}::DOUBLE END AS g FROM p)",
    ]
    for k in range(ROUNDS):
        terms = ["(sum(n * g) + 1) / (sum(n) + 2) AS prior"]
        for j, name in enumerate(names):
            for c, share, prior in (("bad", "(1 - g)", PRIOR[0]), ("good", "g", PRIOR[1])):
                for v in range(3):
                    by = f"{WEIGHT}::DOUBLE * sum(n) * {prior[v]}::DOUBLE + coalesce(sum(n * {share}) FILTER ({name} = {v - 1}), 0)"
                    terms.append(f"({by}) / (sum(n * {share}) + {WEIGHT}::DOUBLE * sum(n)) AS {c}_{j}_{v}")
        ctes.append(f"m{k} AS MATERIALIZED (SELECT {', '.join(terms)} FROM good{k})")

        def side(c: str, prior: str) -> str:
            return " * ".join([prior, *(f"CASE {n} WHEN -1 THEN {c}_{j}_0 WHEN 0 THEN {c}_{j}_1 ELSE {c}_{j}_2 END" for j, n in enumerate(names))])

        ctes.append(
            f"good{k + 1} AS MATERIALIZED (SELECT p.*, {side('good', 'prior')} / ({side('bad', '(1 - prior)')} + {side('good', 'prior')}) AS g FROM p, m{k})"
        )
    on = " AND ".join(f"v.{n} = q.{n}" for n in names)
    failed = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
    return (
        f"WITH {', '.join(ctes)} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed,"
        f" (NOT {failed} AND q.g >= {THRESHOLD}) AS kept FROM v JOIN good{ROUNDS} q ON {on}"
    )
