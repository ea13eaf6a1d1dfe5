"""Quality scores by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the classifier is fitted on at most: those with the least hash of doc_id.
TRAIN_ROWS = 20_000
FOLDS = 5
TREES = 60
DEPTH = 4
BINS = 64
RATE = 0.15
RIDGE = 1.0
LEAST_ROWS = 10
THRESHOLD = 0.3

_KINDS = {
    "upper": range(65, 91), "digit": range(48, 58), "space": (32, *range(9, 14)), "symbol": b"#*$%&|<>", "bang": b"!",
    "stop": b".,;:?", "other": range(128, 256),
}
_MASKS = np.array([[b in set(k) for b in range(256)] for k in _KINDS.values()], float).T

FEATURES = (
    "log_bytes", "log_words", "word_bytes", *_KINDS, "distinct_words", "top_word", "repeated_words", "log_lines",
    "distinct_lines", "line_words", "packed",
)


def statistics(text: str | None) -> list[float]:
    """FEATURES of a whole text (null: empty); shares are of bytes, words or lines, and 0 where there are none."""
    raw = (text or "").encode()
    n = len(raw)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _MASKS / max(1, n)
    words = raw.split()
    w = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    return [
        float(np.log1p(n)),
        float(np.log1p(w)),
        sum(map(len, words)) / max(1, w),
        *shares.tolist(),
        len(counts) / max(1, w),
        max(counts.values(), default=0) / max(1, w),
        sum(map(eq, words, words[1:])) / max(1, w),
        float(np.log1p(len(lines))),
        len(set(lines)) / max(1, len(lines)),
        w / max(1, len(lines)),
        len(zlib.compress(raw, 1)) / max(1, n),
    ]


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: node k of a tree has children 2k + 1 and 2k + 2; leaves lie at one depth.

    feature, bound: trees x (2**depth - 1); value: trees x 2**depth. A row goes right where feature > bound.
    """

    base: float
    feature: np.ndarray
    bound: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 a row: all trees walk down level by level, in numpy."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = self.value.shape[1].bit_length() - 1 if self.value.size else 0
        for f, b, v in zip(self.feature, self.bound, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > b[node])
            out += v[node - (len(v) - 1)]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boost on logistic loss with histograms of quantile bins. No rows, or one label only: a constant score."""
    n, m = x.shape if x.size else (0, len(FEATURES))
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    inner, leaves = 2**depth - 1, 2**depth
    if n == 0 or y.min() == y.max():
        return Forest(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1)  # bin b: edges[b - 1] < x <= edges[b]
    cell = binned + np.arange(m) * BINS
    f_all, b_all, v_all = [], [], []
    score = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, bound = np.zeros(inner, int), np.full(inner, np.inf)  # not split: all rows go left
        node = np.zeros(n, int)
        for level in range(depth):
            first = 2**level - 1
            at = ((node - first)[:, None] * (m * BINS) + cell).ravel()
            size = 2**level * m * BINS
            sums = [np.bincount(at, np.repeat(z, m), size).reshape(-1, m, BINS).cumsum(2) for z in (g, h, np.ones(n))]
            (gl, hl, nl), (gt, ht, nt) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(nl < LEAST_ROWS) | (nt - nl < LEAST_ROWS)] = 0
            flat = gain.reshape(len(gain), -1)
            best = flat.argmax(1)
            for k in np.flatnonzero(flat[np.arange(len(best)), best] > 1e-9):
                j, b = divmod(int(best[k]), BINS)
                if b < len(edges[j]):
                    feature[first + k], bound[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > bound[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        value = -RATE * gs / (hs + RIDGE)
        score += value[leaf]
        f_all.append(feature)
        b_all.append(bound)
        v_all.append(value)
    return Forest(base, np.array(f_all), np.array(b_all), np.array(v_all))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


def _measured(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and x, the statistics, a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in b.column(len(keep)).to_pylist()]
            yield pa.record_batch([*b.columns[: len(keep)], pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{kinds}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest:
    """Fit on labelled rows outside the held-out fold, at most ``rows`` of them, chosen by a hash of doc_id.

    Rows with a null label or id are left out; a doc_id with both labels counts for each, and of several texts with one
    doc_id the least is taken.
    """
    known = labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id"), F.col("quality").cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "y").limit(rows)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    found = found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # of texts that share an id one, so rows stay bounded
    got = sorted(_measured(found, "y").collect(), key=lambda r: (r["x"], r["y"]))  # so that a fit can be repeated
    return fit(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["y"] for r in got]))


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    Null or empty text is scored by its statistics, which are all 0. A null id reads as the empty text for held_out.
    Repeated rows each give a row; other columns are not looked at; an empty table gives none.
    The forest, some ten thousand numbers, goes to the workers with the function.
    """
    forest = train(docs, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(1).to_pylist()]).reshape(b.num_rows, len(FEATURES))
            yield pa.record_batch([b.column(0), pa.array(forest.score(x))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
