"""Links between texts whose sets of word shingles overlap by 0.8 or more: bands of min-hashes name pairs, whose sets are
compared.

Two sets of similarity J agree on a min-hash with chance J, so on all ROWS of one of BANDS bands with chance
1 - (1 - J**ROWS)**BANDS: 0.999997 at J = 0.8 and more beyond, but 0.01 at J = 0.15, as of texts that share a passage. An exact
filter, by the rarest fifth of each set, was tried instead: it files some 100 keys a text, and pairs off all texts that
share a passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, maybe, trimmed
from .components import components
from .subwords import slices

WORDS = 5
#: Similarity from which on texts are near-duplicates, as a fraction.
OVER, UNDER = 4, 5
BANDS, ROWS = 24, 4
#: Odd multipliers and summands of the min-hashes.
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
#: Further pivots of a band whose members its first one leaves unconnected.
PIVOTS = 4
#: Shingles that all min-hashes are worked out of at once.
STRIP = 2048
#: Bits of a set's bitmap, in words of 64.
BITMAP = 1 << 10
CHUNK = 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes ``h``."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        part = h[at : at + CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        while len(bits) > 255:  # sums of up to 255 rows fit in a byte
            cutoff = len(bits) // 255 * 255
            folded = bits[:cutoff].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8)
            ones += folded.sum(axis=0, dtype=np.int64)
            bits = bits[cutoff:]
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the ``words``-word shingles of the text with A-Z lower-cased, repeats included.

    Fewer words than a shingle: the whole sequence is the one shingle; no word or null: as one empty shingle.
    """
    tokens = (text or "").encode().lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    k = min(words, len(h))
    n = max(1, len(h) - k + 1)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * BASE + h[i : i + n]
    return _mixed(out)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct ``hashes``."""
    return np.unique(hashes(text, words))


def bitmap(s: np.ndarray) -> bytes:
    """One bit for each member, by its leading bits."""
    bits = np.zeros(BITMAP, np.uint8)
    bits[(s >> np.uint64(64 - BITMAP.bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def bands(s: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingles: two sets have one in common if they agree on all min-hashes of a band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), STRIP):
        x = s[None, at : at + STRIP] * _FACTORS[0][:, None] + _FACTORS[1][:, None]
        x ^= x >> np.uint64(32)
        np.minimum(least, x.min(1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = _mixed(key * BASE + row)
    return key


def sketches(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """A row each of texts (doc_id, text, tid): doc_id, tid, sid: a digest of the set of shingles, n: its size, fp: its
    SimHash, bits: its bitmap, keys: its bands."""
    longs = BITMAP // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in slices(b.column(2), 1 << 18):
                sid, n, fp, bits, keys = [], [], [], [], []
                for t in part:
                    h = hashes(t, words)
                    s = np.unique(h)
                    sid.append(xxhash.xxh64_intdigest(s.tobytes()))
                    n.append(len(s))
                    fp.append(majority(h))
                    bits.append(bitmap(s))
                    keys.append(bands(s))
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                lists = lambda flat, k: pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * k), pa.array(flat.view(np.int64)))
                yield pa.record_batch(
                    [
                        b.column(0).slice(first, len(part)), b.column(1).slice(first, len(part)), signed(sid), pa.array(n, pa.int64()), signed(fp),
                        lists(np.frombuffer(b"".join(bits), np.uint64), longs), lists(np.concatenate(keys), BANDS),
                    ],
                    ["doc_id", "tid", "sid", "n", "fp", "bits", "keys"],
                )

    kinds = "doc_id bigint, tid binary, sid bigint, n bigint, fp bigint, bits array<bigint>, keys array<bigint>"
    return cut(texts.select("doc_id", "tid", "text").mapInArrow(trimmed(run), kinds), "sketches")


def near(x: Column, y: Column) -> Column:
    """Whether the sizes of two sets allow the similarity."""
    return F.least(x, y) * UNDER >= F.greatest(x, y) * OVER


def possible(n_a: Column, n_b: Column, bits_a: Column, bits_b: Column) -> Column:
    """Whether two sets may be as similar: each cell of the bitmap that one has and the other lacks is a member fewer in
    common. No pair that is as similar is lost."""
    lack = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, v: s + v)
    common = F.least(n_a - lack(bits_a, bits_b), n_b - lack(bits_b, bits_a))
    return (UNDER + OVER) * common >= OVER * (n_a + n_b)


def compared(pairs: DataFrame, kinds: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets overlap by 0.8 or more. kinds: sid, n, bits, and tid of a text that has the set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in slices(b.column(1), 1 << 18):
                yield pa.record_batch([b.column(0).slice(first, len(part)), pa.array([shingles(t, words).tobytes() for t in part], pa.binary())], ["sid", "s"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yes = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(x) + len(y) - len(np.union1d(x, y))
                yes.append(UNDER * common >= OVER * (len(x) + len(y) - common))
            yield b.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    pairs = pairs.distinct()
    for c in "ab":
        pairs = pairs.join(kinds.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")), c)
    may = near(F.col("n_a"), F.col("n_b")) & possible(F.col("n_a"), F.col("n_b"), F.col("bits_a"), F.col("bits_b"))
    pairs = cut(pairs.filter(may).select("a", "b"), "pairs")
    named = pairs.select("a").distinct().union(pairs.select("b").distinct()).toDF("sid").distinct()
    wanted = cut(kinds.select("sid", "tid").join(named, "sid"), "sets-wanted")
    found = maybe(texts, wanted).select("tid", "text").join(wanted, "tid").dropDuplicates(["sid"])
    held = cut(found.select("sid", "text").mapInArrow(trimmed(sets), "sid bigint, s binary"), "sets")
    both = pairs.join(held.toDF("b", "y"), "b").join(held.toDF("a", "x"), "a")
    return both.select("a", "b", "x", "y").mapInArrow(trimmed(alike), "a bigint, b bigint")


def connected(named: DataFrame, kinds: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, root) of sets (kinds: sid, n, bits, keys, tid) that chains of overlaps of 0.8 or more connect. named: pairs (a,
    b) to compare besides those of the bands.

    A band's members are first compared with one of them, its pivot, which a hash of band and set draws: a group that has
    many bands in common has as many pivots, and who lies apart from one meets others. (The least one was the same in most
    bands; where it lay apart from half of a group, that half was paired off.) Where members stay unconnected, they are
    compared with PIVOTS more, and then with each other as pairs that their sizes and bitmaps allow: so a large group of
    near copies, which the pivots connect, isn't paired off with itself, and texts that only have a part in common are not
    passed on as pairs. No pair of a band is left out but those that are connected already.
    """

    def mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
        """Members, with their roots, of the bands that have more than one."""
        rooted = members.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        bands = rooted.groupBy("entry").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
        return rooted.join(bands.select("entry"), "entry", "left_semi")

    def apart(members: DataFrame, others: DataFrame, once: Column) -> DataFrame:
        """Pairs of a band that are unconnected and may be alike."""
        others = others.select("entry", *(F.col(c).alias(f"{c}_b") for c in own))
        may = possible(F.col("n"), F.col("n_b"), F.col("bits"), F.col("bits_b"))
        pairs = members.join(others, "entry").filter(once & (F.col("root") != F.col("root_b")) & near(F.col("n"), F.col("n_b")) & may)
        return pairs.select(F.least("sid", "sid_b").alias("a"), F.greatest("sid", "sid_b").alias("b"))

    def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
        return components(roots.toDF("a", "b").unionByName(links)) if links.limit(1).count() else roots

    own = "sid", "root", "n", "bits"
    window = Window.partitionBy("entry")
    met = kinds.select(F.explode("keys").alias("entry"), "sid", F.col("n").cast("int").alias("n"))
    met = met.withColumn("m", F.count(F.lit(1)).over(window)).filter("m > 1")
    met = met.withColumn("pivot", F.min(F.struct(F.xxhash64("entry", "sid").alias("drawn"), "sid", "n")).over(window))
    met = cut(met.select("entry", "sid", "n", "pivot"), "bands")
    star = met.filter("sid <> pivot.sid").filter(near(F.col("n"), F.col("pivot.n")))
    star = named.unionByName(star.select(F.least("pivot.sid", "sid").alias("a"), F.greatest("pivot.sid", "sid").alias("b")))
    roots = components(cut(compared(star, kinds, texts, words), "star-links"))
    held = mixed(met, roots).filter("sid <> pivot.sid").select("entry", "sid", "root", "n")
    held = cut(held.join(kinds.select("sid", "bits"), "sid"), "unconnected")
    if not held.limit(1).count():
        return roots
    drawn = (F.min(F.struct(F.xxhash64("entry", "sid", F.lit(i)).alias("drawn"), *own)) for i in range(PIVOTS))
    pivots = held.groupBy("entry").agg(F.array(*drawn).alias("p")).select("entry", F.explode("p").alias("p"))
    pivots = cut(pivots.select("entry", *(F.col(f"p.{c}") for c in own)).distinct(), "pivots")
    links = cut(compared(apart(held, pivots, F.lit(True)), kinds, texts, words), "pivot-links")
    roots = merged(roots, links)
    held = held.join(pivots.select("entry", "sid"), ["entry", "sid"], "left_anti").drop("root")
    held = cut(mixed(held, roots), "apart")
    links = cut(compared(apart(held, held, F.col("sid") < F.col("sid_b")), kinds, texts, words), "more-links")
    return merged(roots, links)
