"""Token-id files with Elias-Fano document boundaries.

A block is a self-contained file image: header, ids of many documents one after the other, then two monotone
sequences in Elias-Fano form: where documents begin, and their doc_ids. Each sequence of n values up to u takes about
n * (2 + log2(u / n)) bits; every 256th one bit of the upper part is indexed, so ``select`` reads one short stretch.
Blocks lie as rows of a Parquet table, so that any store Spark writes to can hold them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lookup, trimmed
from .subwords import encode_ended, slices

MAGIC = b"PWEF0001"
END = 1
#: Ids after which a block is closed; a document is never split, so one long document makes a longer block.
BLOCK_IDS = 1 << 20
#: Characters a partition is meant to have.
PARTITION_CHARS = 24_000_000
SAMPLE = 256
#: Bytes of the upper part looked at in one step: a sampled stretch has about two bits a value.
STRETCH = SAMPLE // 4
#: Parts whose ids are summed together first: starts are two sums, of groups of parts and within a group.
GROUP = 4096


def _pack_low(values: np.ndarray, bits: int) -> bytes:
    if not bits:
        return b""
    rows = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(rows.astype(np.uint8).ravel(), bitorder="little").tobytes()


def encode_monotone(values: np.ndarray) -> bytes:
    """Elias-Fano form of non-decreasing unsigned values: n, low bits, sizes; lower part, upper part, samples."""
    v = values.astype(np.uint64)
    n = len(v)
    top = int(v[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    lower = _pack_low(v & np.uint64((1 << low) - 1), low)
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    bits[ones] = 1
    upper = np.packbits(bits, bitorder="little").tobytes()
    samples = ones[::SAMPLE].astype("<u4").tobytes()
    return struct.pack("<QIIII", n, low, len(lower), len(upper), len(samples)) + lower + upper + samples


class Monotone:
    """A sequence in Elias-Fano form, read in place from ``data`` at ``at``."""

    def __init__(self, data: memoryview, at: int = 0) -> None:
        self.n, self.low, *sizes = struct.unpack_from("<QIIII", data, at)
        at += 24
        parts = []
        for s in sizes:
            parts.append(np.frombuffer(data, np.uint8, s, at))
            at += s
        self.lower, self.upper, self.samples, self.end = parts[0], parts[1], parts[2].view("<u4"), at

    def select(self, i: int) -> int:
        """The i-th value."""
        return int(self.some(i, i + 1)[0])

    def some(self, i: int, j: int) -> np.ndarray:
        """Values i up to j: from the sampled one bit at or before the i-th on, bits of the upper part are counted in
        steps of about a sample's stretch until the j-th is found. Nothing else of the sequence is read."""
        j = min(j, self.n)
        if i >= j:
            return np.zeros(0, np.uint64)
        at, skip = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, first, ones = at // 8, at % 8, []
        wanted = skip + j - i
        while wanted > 0:
            bits = np.flatnonzero(np.unpackbits(self.upper[byte : byte + STRETCH], bitorder="little")[first:]) + (byte * 8 + first)
            ones.append(bits[:wanted])
            wanted -= len(ones[-1])
            byte, first = byte + STRETCH, 0
        high = (np.concatenate(ones)[skip:] - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low)
        if not self.low:
            return high
        start = i * self.low
        bits = np.unpackbits(self.lower[start // 8 : (j * self.low + 7) // 8], bitorder="little")[start % 8 :]
        bits = bits[: (j - i) * self.low].reshape(j - i, self.low)
        return high | (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def write_block(doc_ids: list[int | None], ids: np.ndarray, bounds: np.ndarray) -> bytes:
    """A file image. Null doc_ids come first (ascending order puts them there) and are counted, not stored.

    Ids are stored in 2 bytes if all fit, else in 4; doc_ids as differences from the least.
    """
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    base = int(known[0]) if len(known) else 0
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    head = struct.pack("<8sQQQqI", MAGIC, len(doc_ids), len(ids), nulls, base, width)
    body = ids.astype(f"<u{width}").tobytes()
    return head + body + encode_monotone(bounds[:-1]) + encode_monotone((known - base).astype(np.uint64))


class Block:
    """A file image opened for reading: whole, or one document at a time by ``select``."""

    def __init__(self, data: bytes) -> None:
        view = memoryview(data)
        magic, self.n_docs, self.n_ids, self.nulls, self.base, width = struct.unpack_from("<8sQQQqI", view)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize("<8sQQQqI")
        self.ids = np.frombuffer(view, f"<u{width}", self.n_ids, at)
        self.starts = Monotone(view, at + width * self.n_ids)
        self.keys = Monotone(view, self.starts.end)

    def stretches(self) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
        """(doc_ids, starts, ends) of SAMPLE documents at a time, each stretch selected where it lies."""
        for i in range(0, self.n_docs, SAMPLE):
            j = min(i + SAMPLE, self.n_docs)
            bounds = self.starts.some(i, j + 1).astype(np.int64)
            if j == self.n_docs:
                bounds = np.append(bounds, self.n_ids)
            nulls = max(0, min(j, self.nulls) - i)
            keys = self.keys.some(max(0, i - self.nulls), max(0, j - self.nulls)).astype(np.int64) + self.base
            yield [None] * nulls + keys.tolist(), bounds[:-1], bounds[1:]

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document."""
        start, *end = self.starts.some(i, i + 2)
        return self.ids[int(start) : int(end[0]) if end else self.n_ids]


def blocks(docs: DataFrame, path: str, kind: str = "word", end: int = END) -> DataFrame:
    """(part, block, first: ids of the part before the block, n_ids, image) in ascending doc_id order.

    Texts are dealt by doc_id range; bounds take in a hash of the text too, so rows that repeat one doc_id can spread.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(8, -(-chars // PARTITION_CHARS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        found: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            ids = np.concatenate(found)
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            cols = [[part], [block], [before], [len(ids)], [write_block(keys, ids, bounds)]]
            kinds = [pa.int64()] * 4 + [pa.binary()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "block", "first", "n_ids", "image"])

        for b in batches:
            for first, texts in slices(b.column(1)):
                ids, bounds = encode_ended(path, kind, texts, end)
                keys += b.column(0).slice(first, len(texts)).to_pylist()
                found.append(ids)
                sizes.append(np.diff(bounds))
                if sum(map(len, found)) >= BLOCK_IDS:
                    out = close()
                    yield out
                    before, block = before + out.column(3)[0].as_py(), block + 1
                    keys, found, sizes = [], [], []
        if keys:
            yield close()

    key = F.xxhash64("text")
    ranged = docs.repartitionByRange(int(parts), F.col("doc_id"), key).sortWithinPartitions(F.col("doc_id"), key)
    return ranged.mapInArrow(trimmed(run), "part bigint, block bigint, first bigint, n_ids bigint, image binary")


def read_back(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in a table of ``blocks``.

    Documents are read by select, a sampled stretch at a time: no table of 64-bit offsets is made. start is global: the
    ids of all parts before, those of the part's blocks before (stored with the block), and the document's place in
    its block. The parts' sums are added up in groups, then over groups.
    """
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("g", F.floor(F.col("part") / GROUP))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sums.groupBy("g").agg(F.sum("n").alias("n")).select("g", before(Window.orderBy("g")).alias("earlier"))
    within = sums.select("part", "g", before(Window.partitionBy("g").orderBy("part")).alias("here"))
    bases = cut(within.join(groups, "g").select("part", (F.col("earlier") + F.col("here")).alias("base")), "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, first, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                block = Block(image.as_py())
                for keys, starts, ends in block.stretches():
                    crc = [zlib.crc32(block.ids[x:y].astype("<u4").tobytes()) for x, y in zip(starts, ends, strict=True)]
                    yield pa.record_batch(
                        [pa.array(keys, pa.int64()), pa.array(starts + base + first), pa.array(ends - starts), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    based = lookup(files, bases, ["part"], "inner")
    return based.select("base", "first", "image").mapInArrow(trimmed(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def store(docs: DataFrame, path: str, kind: str = "word", end: int = END) -> DataFrame:
    """Write ``docs`` (doc_id, text) as token files in the shared folder and return the table of files.

    Null text: the end id alone. Null doc_ids come first; repeated rows are stored as often as they occur, next to
    each other; other columns are not looked at; an empty table gives no files.
    """
    return cut(blocks(docs, path, kind, end), "tokenfile")
