"""Mixing sources to target weights by Poisson replication and a global shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup

SEED = "mix-1"
#: Share of a source: its document count to this power, over all sources.
POWER = 0.5
#: Documents wanted in all, as a multiple of those there are.
EPOCHS = 1.0
#: Mean repetitions up to which a source has a table of its distribution; beyond, rows add up their own.
MOST = 8.0
#: Terms of the distribution looked at; beyond, the chance is under 1e-30 for a mean of at most MOST.
TERMS = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts, joined by a colon; null reads ``null``."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, epochs: float = EPOCHS, most: float | None = None) -> DataFrame:
    """(source, rate, steps) a source: its mean repetitions (at most ``most``, if given, which misses the target
    weights), and the cumulative Poisson probabilities of 0, 1, ..., null for means beyond MOST.

    weights: target weights by source, those not named weigh 0; without them a source weighs its count to ``power``.
    Counts are over all rows, summed on the map side first, so a source with a third of the rows is no hot group; they
    are written once, a row a source, so that the documents are not counted again by whatever uses the rates.
    """
    counts = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts, "sources")
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(power)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0)
    counts = counts.withColumn("w", weight)
    total = counts.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    rate = F.coalesce(F.lit(float(epochs)) * F.col("all_n") * F.try_divide(F.col("w"), F.col("all_w")) / F.col("n"), F.lit(0.0))
    rate = rate if most is None else F.least(F.lit(float(most)), rate)
    first = F.exp(-F.col("rate"))
    start = F.struct(first.alias("p"), F.array(first).alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("rate") / k
        return F.struct(p.alias("p"), F.concat(acc["steps"], F.array(F.element_at(acc["steps"], -1) + p)).alias("steps"))

    steps = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["steps"])
    return counts.crossJoin(F.broadcast(total)).select("source", rate.alias("rate")).select("source", "rate", F.when(F.col("rate") <= MOST, steps).alias("steps"))


def drawn(rate: Column, u: Column) -> Column:
    """The Poisson count of mean ``rate`` at ``u``, by adding up probabilities from their logarithms: work in proportion
    to the rows that come out. The sum ends where rounding hides what is left."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 64).cast("int")
    first = F.exp(-rate)
    start = F.struct((-rate).alias("log"), first.alias("sum"), F.when(first <= u, 1).otherwise(0).alias("n"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(rate) - F.log(k)
        done = acc["sum"] + F.exp(log)
        more = (done <= u) & ((k <= rate) | (log > -40))
        return F.struct(log.alias("log"), done.alias("sum"), (acc["n"] + F.when(more, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["n"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, epochs: float = EPOCHS, most: float | None = None, seed: str = SEED) -> DataFrame:
    """All columns of ``docs``, then pw_replica (0, 1, ...) and pw_key, each row as often as its Poisson count.

    The count inverts the Poisson distribution with the mean its source needs to meet its target share, at a uniform
    number hashed from seed and doc_id: the same on every run, and independent of partitioning. Null source counts
    as the source ''; a null doc_id hashes as ``null``; repeated rows get equal counts; an empty table gives no rows.
    Rows are dealt out by a hash of (seed, doc_id, replica) and ordered by it within each partition: a global
    shuffle without a sampling pass. pw_key is that hash.
    """
    table = rates(docs, weights, power, epochs, most).select(F.col("source").alias("pw_source"), F.col("rate").alias("pw_rate"), F.col("steps").alias("pw_steps"))
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    joined = lookup(docs.withColumn("pw_source", source), table, ["pw_source"])
    u = uniform(F.lit(seed), F.col("doc_id"))
    counted = joined.withColumn("pw_u", u).withColumn("pw_n", F.when(F.col("pw_steps").isNotNull(), F.expr("size(filter(pw_steps, s -> s <= pw_u))")).otherwise(drawn(F.col("pw_rate"), F.col("pw_u"))))
    copies = counted.filter("pw_n > 0").select(*docs.columns, F.explode(F.expr("sequence(0, pw_n - 1)")).alias("pw_replica"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("pw_replica").cast("string")))
    return copies.withColumn("pw_key", key).repartition("pw_key").sortWithinPartitions("pw_key")


def oracle(table: str = "documents", extra: str = "", seed: str = SEED) -> str:
    """DuckDB SQL for ``mix`` with its defaults where no source needs a mean beyond MOST, which the SQL caps and
    ``mix`` doesn't; ``extra`` names more columns."""
    h = f"md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null'))"
    return f"""
WITH c AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM {table} GROUP BY 1),
r AS (SELECT s, least({MOST}::DOUBLE, {EPOCHS}::DOUBLE * (SELECT sum(n) FROM c) * (pow(n, {POWER}) / (SELECT sum(pow(n, {POWER})) FROM c)) / n) AS rate FROM c),
q AS (SELECT s, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS cdf FROM r, range(0, {TERMS + 1}) t(k)),
st AS (SELECT s, list(cdf ORDER BY k) AS steps FROM q GROUP BY s),
d AS (SELECT *, CAST('0x' || substr({h}, 1, 13) AS BIGINT) / {float(1 << 52)}::DOUBLE AS u FROM {table}),
n AS (SELECT d.*, len(list_filter(steps, lambda x: x <= u)) AS times FROM d JOIN st ON st.s = coalesce(source, ''))
SELECT doc_id, source{extra}, k::INTEGER AS replica, md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || k) AS shuffle_key
FROM n, range(0, 200) t(k) WHERE k < times"""
