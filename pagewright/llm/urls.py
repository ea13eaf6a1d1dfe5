"""URL filters: rules by host and path, and logistic regression on hashed character n-grams for what no rule fits."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import url_labels


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)

BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
EPOCHS = 60
RATE = 0.5
DECAY = 1e-4
THRESHOLD = 0.5


def split(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path from
    there up to ``?``, ``#`` or the end. Null, or no ``://``: both empty."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, null if none does: its host or a subdomain, and a path that
    starts with the rule's. Equally long rules: the longer host, then the earlier rule."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))
    name = verdict = F.lit(None).cast("string")
    for r in reversed(ordered):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name).otherwise(name)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def cells(host: str, path: str) -> np.ndarray:
    """Sorted distinct buckets of the character n-grams of host and path, marked by part."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        raw = text.encode()
        for n in GRAMS:
            found.update(xxhash.xxh32_intdigest(raw[i : i + n], ord(mark)) % BUCKETS for i in range(max(1, len(raw) - n + 1)))
    return np.fromiter(sorted(found), np.int64, len(found))


def trained(table: list[tuple[str, str, str, int]]) -> np.ndarray:
    """Weights, the bias last, of a table of (word, host, path, label): full-batch gradient descent, the same on every
    process. Both labels weigh the same."""
    rows = [cells(h, p) for _, h, p, _ in table]
    y = np.array([x[3] for x in table], float)
    at, n = np.concatenate(rows), np.array([len(r) for r in rows])
    of = np.repeat(np.arange(len(rows)), n)
    scale = 1 / np.sqrt(n)
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w = np.zeros(BUCKETS + 1)
    for _ in range(EPOCHS * 10):
        z = np.bincount(of, w[at], len(rows)) * scale + w[-1]
        g = (1 / (1 + np.exp(-z)) - y) * balance
        step = np.zeros_like(w)
        step[:-1] = np.bincount(at, (g * scale)[of], BUCKETS) + DECAY * w[:-1]
        step[-1] = g.sum()
        w -= RATE * 10 * step
    return w


@lru_cache(maxsize=1)
def weights() -> np.ndarray:
    """The weights of the labelled table, trained once a process."""
    return trained(url_labels.table())


def held_out_figures(folds: int = 5, threshold: float = THRESHOLD) -> dict[str, float]:
    """Precision and recall on rows whose words the training has not seen, over ``folds`` splits by word; and the share of
    made-up names blocked."""
    table = url_labels.table()
    words = list(dict.fromkeys(w for w, *_ in table))
    fold = {w: zlib.crc32(w.encode()) % folds for w in words}
    said, truth, made = [], [], []
    for k in range(folds):
        w = trained([r for r in table if fold[r[0]] != k])
        for r in (r for r in table if fold[r[0]] == k):
            said.append(chance(r[1], r[2], w) >= threshold)
            truth.append(r[3] == 1)
            made.append(r[0].startswith("made-up"))
    said, truth, made = np.array(said), np.array(truth), np.array(made)
    return {"precision": float((said & truth).sum() / max(1, said.sum())), "recall": float((said & truth).sum() / truth.sum()), "made_up_blocked": float(said[made].mean())}


def chances(hosts: list[str], paths: list[str], w: np.ndarray) -> np.ndarray:
    """How likely each URL is unwanted; each distinct URL is looked at once."""
    known: dict[tuple[str, str], float] = {}
    for pair in zip(hosts, paths, strict=True):
        if pair not in known:
            known[pair] = chance(*pair, w)
    return np.array([known[pair] for pair in zip(hosts, paths, strict=True)], float)


def chance(host: str, path: str, w: np.ndarray) -> float:
    """How likely the URL is unwanted."""
    c = cells(host, path)
    return float(1 / (1 + np.exp(-(w[c].sum() / np.sqrt(len(c)) + w[-1]))))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, score, verdict) for each row of ``pages`` (page_id, url).

    verdict is the rule's; where none fits, the classifier's: block from ``threshold`` on. A null URL or one without
    ``://`` has empty host and path, which the classifier allows or blocks like any other. Null ids, repeated rows
    and very long URLs each give a row; other columns are not looked at; an empty table gives no rows. Weights are
    2**14 numbers, trained in each worker process from the table in this module: nothing is broadcast.
    """
    host, path = split(F.col("url").cast("string"))
    parts = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights()
        for b in batches:
            score = pa.array(chances(b.column(1).to_pylist(), b.column(2).to_pylist(), w), pa.float64())
            found = pc.if_else(pc.greater_equal(score, threshold), "block", "allow")
            yield pa.record_batch(
                [*b.columns[:4], score, pc.coalesce(b.column(4), found)], ["page_id", "host", "path", "rule", "score", "verdict"]
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return ruled.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, score double, verdict string")
