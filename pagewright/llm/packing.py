"""Packing along a space-filling curve: neighbours on the Hilbert curve share sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, trimmed
from .subwords import encode_ended, slices

LENGTH = 2048
END = 1
DIMS = 4  # of the curve
HASHED = 64  # of the hashed document vectors
ORDER = 12  # bits a dimension
SEED = 7
#: Tokens a partition is meant to have.
PARTITION_TOKENS = 4_000_000
#: Rows of the curve's partition number above the sequence number within it.
SHIFT = 40


def hilbert(points: np.ndarray, order: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n x dims, each under 2**order), by Skilling's transform."""
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    q = one << np.uint64(order - 1)
    while q > one:
        p = q - one
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = one << np.uint64(order - 1)
    while q > one:
        t ^= np.where((x[dims - 1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= t
    key = np.zeros_like(t)
    for bit in range(order - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(bit)) & one)
    return key.astype(np.int64)


class Curve:
    """Hilbert keys of token-id documents: hash ids into signed cells, project to few dimensions, quantise."""

    def __init__(self, dims: int = DIMS, hashed: int = HASHED, order: int = ORDER, seed: int = SEED) -> None:
        self.hashed, self.order = hashed, order
        self.projection = np.random.default_rng(seed).standard_normal((hashed, dims))
        self.cells = np.zeros(0, np.int64)  # by id: its cell, then whether it counts for or against

    def _cells(self, top: int) -> np.ndarray:
        if top >= len(self.cells):
            mixed = np.arange(1, max(1 << 16, top + 1) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            cell = (mixed >> np.uint64(40)) % np.uint64(self.hashed) * np.uint64(2)
            self.cells = (cell + ((mixed >> np.uint64(39)) & np.uint64(1))).astype(np.int64)
        return self.cells

    def keys(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        doc = np.repeat(np.arange(n) * (2 * self.hashed), np.diff(bounds))
        doc += self._cells(int(ids.max(initial=0)))[ids]
        counts = np.bincount(doc, minlength=n * 2 * self.hashed).reshape(n, self.hashed, 2)
        vectors = (counts[:, :, 1] - counts[:, :, 0]).astype(float)
        norm = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
        points = vectors / np.maximum(norm, 1e-12) @ self.projection  # about standard normal in each dimension
        level = (1 / (1 + np.exp(-1.702 * points)) * (1 << self.order)).astype(np.int64)
        return hilbert(np.clip(level, 0, (1 << self.order) - 1), self.order)


def id_width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def tokenized(docs: DataFrame, path: str, kind: str = "byte", end: int = END) -> DataFrame:
    """(doc_id, key, n, ids) a row: the text's ids, then ``end``, as little-endian integers of 2 bytes if all ids of
    the vocabulary fit, else of 4."""
    width = id_width(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curve = Curve()
        for b in batches:
            for first, texts in slices(b.column(1)):
                ids, bounds = encode_ended(path, kind, texts, end)
                raw = ids.astype(f"<u{width}").tobytes()
                yield pa.record_batch(
                    [
                        b.column(0).slice(first, len(texts)),
                        pa.array(curve.keys(ids, bounds)),
                        pa.array(np.diff(bounds)),
                        pa.array([raw[width * x : width * y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                    ],
                    ["doc_id", "key", "n", "ids"],
                )

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(trimmed(run), "doc_id bigint, key bigint, n bigint, ids binary")


def pieces(tokens: DataFrame, width: int, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """Sequences filled along the curve, one row a piece: doc_id, start, length, doc_tokens, sequence_id, offset, and
    ids (little-endian, 4 bytes) or, with ``digest``, ids_crc32 of these.

    A partition holds a stretch of the curve and fills sequences of ``length`` from one document's end to the next's
    start. What is left at its end is under ``length``; it is cut into sequences of falling powers of two, which are
    not padded: so no sequence holds padding. Bounds of the stretches take in (key, doc_id), so copies, which share a
    key, spread over partitions.
    """
    total = tokens.agg(F.sum("n")).first()[0] or 0
    parts = max(8, -(-total // PARTITION_TOKENS))
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32" if digest else "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, room, offset = TaskContext.get().partitionId() << SHIFT, length, 0
        held: list[tuple] = []  # pieces of the sequence being filled; their ids as arrays

        def close(rows: list[tuple]) -> pa.RecordBatch:
            *cols, ids = zip(*rows, strict=True)
            last = pa.array([crc(x) for x in ids], pa.int64()) if digest else pa.array([x.tobytes() for x in ids], pa.binary())
            return pa.record_batch([*(pa.array(c, pa.int64()) for c in cols), last], names)

        for b in batches:
            done = []
            for doc, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids, start = np.frombuffer(raw.as_buffer(), f"<u{width}").astype("<u4"), 0
                while start < n:
                    take = min(room, n - start)
                    held.append((doc, start, take, n, sequence, offset, ids[start : start + take]))
                    start, offset, room = start + take, offset + take, room - take
                    if not room:
                        done += held
                        held, sequence, room, offset = [], sequence + 1, length, 0
            if done:
                yield close(done)
        if held:  # the tail, cut at powers of two
            size = offset
            out, room, offset = [], 1 << (size.bit_length() - 1), 0
            for doc, start, n, whole, _, _, ids in held:
                at = 0
                while at < n:
                    take = min(room, n - at)
                    out.append((doc, start + at, take, whole, sequence, offset, ids[at : at + take]))
                    at, offset, room, size = at + take, offset + take, room - take, size - take
                    if not room and size:
                        sequence, room, offset = sequence + 1, 1 << (size.bit_length() - 1), 0
            yield close(out)

    ranged = tokens.repartitionByRange(int(parts), "key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    kinds = ", ".join(f"{c} bigint" for c in names[:-1]) + (", ids_crc32 bigint" if digest else ", ids binary")
    return ranged.select("doc_id", "n", "ids").mapInArrow(trimmed(run), kinds)


def pack(docs: DataFrame, path: str, kind: str = "byte", length: int = LENGTH, digest: bool = False) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of ``length`` ids: the pieces, as of ``pieces``.

    Null or empty text: the end id alone. Null ids and repeated rows are packed like any other (repeated rows give
    repeated pieces, in different places); other columns are not looked at; an empty table gives no rows.
    """
    return pieces(cut(tokenized(docs, path, kind), "tokens"), id_width(path), length, digest)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
