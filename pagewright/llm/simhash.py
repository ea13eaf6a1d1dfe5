"""SimHash near-duplicate groups by multi-index hashing over small Hamming balls."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe
from .components import components
from .shingles import connected, majority, sketches

SEED = 42
BITS = 64
#: Segments of a fingerprint. Two fingerprints at most 3 bits apart differ in at most one bit of one of the two.
SEGMENTS = 2
WIDTH = BITS // SEGMENTS
#: Members up to which an entry of the table is fetched whole; larger ones are split by the other segment.
HOT = 128
#: Fingerprints a task enumerates the balls of.
PART = 16_000


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash over ``words``-word shingles, repeats included, of the text with A-Z lower-cased.

    Fewer words than a shingle: the whole sequence is the one shingle. No word or null: 0.
    """
    tokens = (text or "").encode().lower().split()  # bytes.split(): 0x20 and 0x09-0x0D only
    if not tokens:
        return 0
    shingles = (
        map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
        if len(tokens) >= words
        else iter([b" ".join(tokens)])
    )
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, seed) for s, _ in zip(shingles, range(n), strict=False)), np.uint64, n))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp bigint: the fingerprint's bits) for each row of ``docs``, repeated rows and null ids included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id bigint, fp bigint")


def _segment(fp: Column, s: int) -> Column:
    return F.shiftrightunsigned(fp, s * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _key(s: int, value: Column) -> Column:
    """An entry's key: the segment's number above its value."""
    return value.bitwiseOR(F.lit(s << WIDTH))


def _ball(value: Column, clear_only: bool = False) -> Column:
    """The values one bit away from ``value``; ``clear_only``: those with one bit less, so that of two values one bit
    apart only one finds the other."""
    bits = F.array(*(F.lit(1 << i).cast("bigint") for i in range(WIDTH)))
    if clear_only:
        bits = F.filter(bits, lambda x: value.bitwiseAND(x) != 0)
    return F.transform(bits, lambda x: value.bitwiseXOR(x))


def links(fps: DataFrame, distance: int = 2, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs at most ``distance`` bits (1 or 2) apart.

    Multi-index hashing: a table has an entry for each segment and value there, of the fingerprints with that value.
    Two fingerprints at most 2 bits apart differ in at most one bit of one segment, so each looks its own values up, and
    the values that lie one bit away (of such two only the one with the bit set asks). What an entry holds is fetched
    and the complete distance verified. A filter of fixed size spares most questions that no entry answers.

    Entries of over ``hot`` members are not fetched whole but split by the other segment: for members, who may differ
    there in 2 bits, each is filed under the ball round its value there, so that such two meet under a value between
    them; for those who ask from one bit away, and so may differ there in one, each value of that ball is asked for.
    So a fingerprint meets at most ``hot`` others a question, or 33, however many share a segment.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    fp = F.col("fp")
    fps = fps.select("fp").distinct()
    table = fps.select("fp", F.explode(F.array(*(_key(s, _segment(fp, s)) for s in range(SEGMENTS)))).alias("key"))
    crowded = cut(table.groupBy("key").count().filter(F.col("count") > hot).select("key"), "crowded")
    near = F.concat(*(F.transform(_ball(_segment(fp, s), True), partial(_key, s)) for s in range(SEGMENTS)))
    asked = maybe(fps.select("fp", F.explode(near).alias("key")), table, key="key")
    same, other = table.withColumnRenamed("fp", "b"), table.withColumnRenamed("fp", "a")
    some = crowded.limit(1).count() > 0
    plain = lambda x: x.join(crowded, "key", "left_anti") if some else x
    found = plain(same).join(plain(other), "key").filter("a < b").select("a", "b")
    found = found.unionByName(plain(asked).join(same, "key").select(F.col("fp").alias("a"), "b"))
    if some:
        rest = lambda c: F.when(F.shiftrightunsigned(F.col("key"), WIDTH) == 0, _segment(c, 1)).otherwise(_segment(c, 0))
        whole = lambda c: F.concat(F.array(rest(c)), _ball(rest(c)))
        held = table.join(crowded, "key").select("key", "fp", F.explode(whole(fp)).alias("at"))
        least = held.groupBy("key", "at").agg(F.min("fp").alias("a"))
        met = held.join(least, ["key", "at"]).select("a", F.col("fp").alias("b"))
        asks = asked.join(crowded, "key").select("key", "fp", F.explode(whole(fp)).alias("at"))
        exact = table.join(crowded, "key").select("key", F.col("fp").alias("b"), rest(fp).alias("at"))
        found = found.unionByName(met).unionByName(asks.join(exact, ["key", "at"]).select(F.col("fp").alias("a"), "b"))
    found = found.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, distance))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _spread(fps: DataFrame) -> DataFrame:
    """``fps``, a small table of many rows, in enough partitions for the balls round them."""
    return fps.repartition(max(1, -(-fps.count() // PART)), "fp")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint: 16 hex digits, component_id) for each row of ``docs``.

    component_id: the least doc_id of the documents reachable over links. Texts without words have fingerprint
    zero and link like any other; null text: no words. A null doc_id takes part, but never names a component
    unless no member has an id (then null). Repeated rows each give a row. Empty table: no rows. Other columns of
    ``docs`` are not looked at. Copies share a fingerprint and are never paired with each other: links are made
    between distinct fingerprints.
    """
    fps = cut(fingerprints(docs, words), "fingerprints")
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(links(_spread(classes), distance))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = cut(rooted.join(named, "root").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row of each group of near-duplicate rows of ``docs``, that with the least doc_id; columns kept as they are.

    Near-duplicates: texts whose sets of ``words``-word shingles overlap by 0.8 or more, and what chains of these connect.
    Fingerprints at most 2 bits apart name pairs. Pairs at 0.8 lie some 10 bits apart, beyond small balls: these are named
    by the bands of ``shingles.connected``. Every pair that is named is compared as sets.

    Rows are told apart by doc_id and text, so an id that different texts have loses only those that are copies; a null
    id comes after all others. Texts without words, null ones among them, are one group. Rows that repeat both are one.
    Only rows of groups are shuffled with their texts. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumn("tid", F.unhex(F.md5("text")))
    rows = sketches(texts, words)
    kinds = rows.groupBy("sid").agg(*(F.min(c).alias(c) for c in ("n", "tid", "fp")), *(F.first(c).alias(c) for c in ("bits", "keys")))
    kinds = cut(kinds, "kinds")
    some = cut(kinds.groupBy("fp").agg(F.min("sid").alias("least"), F.count(F.lit(1)).alias("m")), "fingerprints")
    alike = kinds.join(some.filter("m > 1"), "fp").filter("sid <> least").select(F.col("least").alias("a"), F.col("sid").alias("b"))
    close = links(_spread(some), 2)
    for c in "ab":
        close = close.join(some.select(F.col("fp").alias(c), F.col("least").alias(f"sid_{c}")), c)
    pairs = alike.unionByName(close.select(F.least("sid_a", "sid_b").alias("a"), F.greatest("sid_a", "sid_b").alias("b")))
    roots = connected(pairs, kinds, texts, words).withColumnRenamed("node", "sid")
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tid")
    rooted = rows.select("sid", "doc_id", "tid").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    rooted = cut(rooted.select("root", "doc_id", "tid"), "rooted")
    groups = rooted.groupBy("root").agg(F.min(name).alias("first"), F.count(F.lit(1)).alias("m"))
    grouped = cut(rooted.join(groups.filter("m > 1"), "root").select("doc_id", F.col("tid").alias("pw_tid"), F.col("first.doc_id").alias("pw_first"), F.col("first.tid").alias("pw_first_tid")), "grouped")
    keyed = docs.withColumn("pw_tid", F.unhex(F.md5(text)))
    alone, met = (maybe(keyed, grouped, inside, "pw_tid") for inside in (False, True))
    own = F.col("doc_id").cast("bigint")
    mine = grouped.distinct().withColumnsRenamed({"doc_id": "pw_id", "pw_tid": "pw_key"})
    found = met.join(mine, (F.col("pw_tid") == F.col("pw_key")) & own.eqNullSafe(F.col("pw_id")), "left")
    kept = found.filter(F.col("pw_key").isNull() | (own.eqNullSafe(F.col("pw_first")) & (F.col("pw_tid") == F.col("pw_first_tid"))))
    single, repeated = kept.filter("pw_key is null"), kept.filter("pw_key is not null").dropDuplicates(["pw_id", "pw_key"])
    out = alone.select(*docs.columns).unionByName(single.select(*docs.columns))
    return out.unionByName(repeated.select(*docs.columns))
