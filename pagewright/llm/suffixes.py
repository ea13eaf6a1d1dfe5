"""Removal of repeated byte strings by a sparse suffix array.

Only suffixes at anchors are sorted: an anchor is where the least hash of a short string lies in a window, so two
equal long strings have an anchor at the same place within. Sampled splitters deal the suffixes out by their leading
bytes; each bucket is sorted by multikey quicksort and its neighbours' common prefixes tell which strings recur; what
may recur across a bucket's bounds is compared with the other buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe, trimmed

MIN_BYTES = 400
#: Bytes worked on at once; a longer text is worked on alone.
SLICE = 1 << 18
#: Suffixes a bucket is meant to have.
BUCKET = 16_000
#: Strings to compare with other buckets that a bucket holds before it passes them on.
SENT = 100_000
M64 = (1 << 64) - 1


@lru_cache(maxsize=4)
def _bytes_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, M64, 256, np.uint64, endpoint=True)


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    got = _POWERS.get((base, inverse))
    if got is None or len(got) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        got = np.full(max(n, 4096), step, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        _POWERS[base, inverse] = got
    return got[:n]


BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Rolling:
    """Hashes of all strings of any one length of ``data``: polynomials over Z/2**64 in hashed bytes."""

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        self.n, self.base = len(data), BASES[which]
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_bytes_table(which + 1)[data] * _powers(self.base, self.n), out=self.sums[1:])

    def of(self, k: int) -> np.ndarray:
        if self.n < k:
            return np.zeros(0, np.uint64)
        h = (self.sums[k:] - self.sums[:-k]) * _powers(self.base, self.n - k + 1, True)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while 2 * have <= w:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return v if have == w else np.minimum(v[: len(v) - (w - have)], v[w - have :])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of all texts in ``data`` (text i at bounds[i]:bounds[i + 1]), and what repeats within a text.

    Returns arrays text, hash, at, first, last (an anchor at ``at`` stands for the strings of ``length`` bytes that
    start in first..last), then text and start of strings that occur twice in their text. Of equal strings within a
    text one is kept, so a periodic text has no more anchors than its period gives.
    """
    k = length // 2
    w = length - k + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64, np.int64, np.int64))
    sizes = np.diff(bounds)
    if not len(sizes) or sizes.max() < length:
        return none
    rolling = Rolling(data)
    h = rolling.of(k)
    places = np.arange(len(h), dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    m = _window_min((h & ~low) | (low - places), w)  # m[p]: of the window from p, its least hash and rightmost place
    starts = np.zeros(len(data) + 1, np.int64)
    long = sizes >= length
    np.add.at(starts, bounds[:-1][long], 1)
    np.add.at(starts, bounds[1:][long] - length + 1, -1)
    p = np.flatnonzero(np.cumsum(starts)[:-1])  # where a string of length bytes fits in its text
    at = (low - (m[p] & low)).astype(np.int64)

    def runs(p: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        new = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 1) | (np.diff(at) != 0)]))
        return at[new], p[new], p[np.append(new[1:], len(p)) - 1]

    a, first, last = runs(p, at)
    text = np.searchsorted(bounds, a, "right") - 1
    order = np.lexsort((h[a], text))
    same = (text[order][1:] == text[order][:-1]) & (h[a][order][1:] == h[a][order][:-1])
    own_text, own_start = [], []
    if same.any():
        redo = np.unique(text[order][1:][same])
        whole, other = rolling.of(length), Rolling(data, 1).of(length)
        keep = ~np.isin(text, redo)
        parts = [(a[keep], first[keep], last[keep])]
        for t in redo:
            q = np.arange(bounds[t], bounds[t + 1] - length + 1)
            by = q[np.lexsort((other[q], whole[q]))]  # strings named by 128 bits; equal ones in order of place
            new = np.concatenate([[True], (whole[by[1:]] != whole[by[:-1]]) | (other[by[1:]] != other[by[:-1]])])
            lone = new & np.append(new[1:], True)
            again = np.sort(by[~lone])
            own_text.append(np.full(len(again), t))
            own_start.append(again)
            kept = np.sort(by[new])
            parts.append(runs(kept, (low - (m[kept] & low)).astype(np.int64)))
        a, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
        text = np.searchsorted(bounds, a, "right") - 1
        order = np.argsort(text, kind="stable")
        a, first, last, text = a[order], first[order], last[order], text[order]
    own = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (own_text, own_start)]
    return text, h[a], a, first, last, *own


def _covers(owner: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, from, to) of the bytes covered by strings at ``start``: runs of overlapping ones merged."""
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(start) > length)])) if len(start) else np.zeros(0, int)
    ends = np.append(new[1:], len(start)) - 1 if len(start) else new
    return owner[new], start[new], start[ends] + length


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, bytes) of an Arrow string or binary column without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bounds, data


def _slices(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE, "right")) - 1)
        yield i, j
        i = j


def _lists(rows: int, owner: np.ndarray, values: dict[str, pa.Array]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(values.values()), list(values)))


def scan(texts: DataFrame, length: int) -> DataFrame:
    """(tid, marks: anchors by text, own: bytes that repeat within the text) of texts (tid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds, data = _raw(b.column(1))
            for i, j in _slices(bounds):
                at = bounds[i : j + 1] - bounds[i]
                text, h, a, first, last, own, start = anchors(data[bounds[i] : bounds[j]], at, length)
                base = at[text]
                marks = _lists(j - i, text, {"h": pa.array(h.view(np.int64)), "a": pa.array((a - base).astype(np.int32)), "near": pa.array((a - last).astype(np.int32)), "far": pa.array((a - first).astype(np.int32))})
                owner, s, e = _covers(own, start, length)
                spans = _lists(j - i, owner, {"s": pa.array(s - at[owner]), "e": pa.array(e - at[owner])})
                yield pa.record_batch([b.column(0).slice(i, j - i), marks, spans], ["tid", "marks", "own"])

    return texts.select("tid", "text").mapInArrow(
        trimmed(run), "tid binary, marks array<struct<h: bigint, a: int, near: int, far: int>>, own array<struct<s: bigint, e: bigint>>"
    )


def contexts(texts: DataFrame, length: int) -> DataFrame:
    """(tid, a, near, far, ahead, behind) of texts (tid, text, marks): an anchor's bytes from it on, and those before
    it in reverse, as far as the strings it stands for reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tid, text, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = text.encode()
                back = raw[::-1]
                n = len(raw)
                cols = [(tid, m["a"], m["near"], m["far"], raw[m["a"] : m["a"] + length - m["near"]], back[n - m["a"] : n - m["a"] + m["far"]]) for m in marks]
                kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                names = ["tid", "a", "near", "far", "ahead", "behind"]
                if cols:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*cols, strict=True), kinds, strict=True)], names)

    return texts.select("tid", "text", "marks").mapInArrow(trimmed(run), "tid binary, a int, near int, far int, ahead binary, behind binary")


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of rows of bytes: lcp[i] is the common prefix of the i-th row in order and the one before.

    Multikey quicksort, a token of 8 bytes at a time and all groups of a depth at once: rows still tied are split by
    their next token; those that stand alone are done.
    """
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    tokens = padded.view(">u8")
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # by place in order: where its group of tied rows begins
    tied = np.arange(n)  # places in groups of two or more
    for depth in range(tokens.shape[1]):
        if len(tied) < 2:
            break
        keys = tokens[order[tied], depth].astype(np.uint64)
        by = np.lexsort((keys, group[tied]))
        order[tied] = order[tied][by]
        keys, g = keys[by], group[tied]
        new = np.concatenate([[True], (np.diff(g) != 0) | (keys[1:] != keys[:-1])])
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
    lcp = np.zeros(n, np.int64)
    for at in range(0, n - 1, 8192):  # in pieces, to bound memory
        x, y = rows[order[at : at + 8192]], rows[order[at + 1 : at + 8193]]
        differ = x[: len(y)] != y
        lcp[at + 1 : at + 1 + len(y)] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, lcp


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    bounds, data = _raw(column)
    n = np.diff(bounds)
    out = np.zeros((len(n), width), np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(bounds[-1] - bounds[0]) - np.repeat(bounds[:-1] - bounds[0], n)] = data[bounds[0] : bounds[-1]]
    return out


FOUND = "tid binary, a int, s bigint, e bigint, o int, h1 bigint, h2 bigint, n int"


def _bucket(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Of a bucket of suffixes: covered bytes (tid, s, e), and strings to compare with other buckets (o, h1, h2, n,
    and tid, a if it occurs once here).

    A string that starts o bytes before its anchor recurs if another suffix shares length - o bytes ahead and o bytes
    behind. In sorted order, rows that share t bytes are a run between common prefixes under t, ahead as behind; so for
    each o a pair of run numbers names the string. Only rows of a run that the bucket's first or last row is in can have
    equals in other buckets.
    """
    k = length // 2
    table = table.combine_chunks()
    col = lambda name: table.column(name).combine_chunks() if table.column(name).num_chunks != 1 else table.column(name).chunk(0)
    ahead, behind = _matrix(col("ahead"), length), _matrix(col("behind"), length - k)
    tids = col("tid")
    a, near, far = (col(x).to_numpy().astype(np.int64) for x in ("a", "near", "far"))
    order, lcp = multikey_sort(ahead)
    ahead, behind, a, near, far = ahead[order], behind[order], a[order], near[order], far[order]
    del table
    back_order, back_lcp = multikey_sort(behind)
    n = len(a)
    tie = np.cumsum(lcp < k)
    open_ = (tie == tie[0]) | (tie == tie[-1])
    alone = np.bincount(tie)[tie] < 2
    live = ~alone | open_
    opened = np.flatnonzero(open_)
    sums, bytes_ = [], [_bytes_table(s + 1) for s in (1, 2)]
    for table_, base in zip(bytes_, BASES, strict=True):
        up, down = _powers(base, length + 1), _powers(base, length + 2, True)
        s = np.zeros(len(opened), np.uint64)
        for j in range(k - 1):
            s += table_[ahead[opened, j]] * up[j]
        for j in range(length - k):
            s += table_[behind[opened, j]] * down[j + 1]
        sums.append(s)
    rank = np.full(n, -1)
    rank[opened] = np.arange(len(opened))
    hit_row, hit_start, sent = [], [], []
    back = np.empty(n, np.int64)
    for o in range(length - k, -1, -1):
        t = length - o
        if len(opened):  # the sums now take in bytes ahead up to t and behind up to o
            for s, table_, base in zip(sums, bytes_, BASES, strict=True):
                s += table_[ahead[opened, t - 1]] * _powers(base, length + 1)[t - 1]
                if o < length - k:
                    s -= table_[behind[opened, o]] * _powers(base, length + 2, True)[o + 1]
        rows = np.flatnonzero(live & (near <= o) & (o <= far))
        if not len(rows):
            continue
        back[back_order] = np.cumsum(back_lcp < o)
        run = np.cumsum(lcp < t)
        name = run[rows] * (n + 1) + back[rows]
        by = np.argsort(name, kind="stable")
        name = name[by]
        new = np.concatenate([[True], name[1:] != name[:-1]])
        of = np.cumsum(new) - 1
        count = np.bincount(of)
        again = count[of] > 1
        hit_row.append(rows[by][again])
        hit_start.append(a[rows[by][again]] - o)
        one = rows[by][new]
        edge = (rank[one] >= 0) & ((run[one] == run[0]) | (run[one] == run[-1]))
        one, count = one[edge], count[edge]
        if len(one):
            sent.append((one, np.full(len(one), o), count, *(s[rank[one]].view(np.int64) for s in sums)))
            if sum(len(x[0]) for x in sent) > SENT:
                yield _to_compare(sent, tids, order, a)
                sent = []
    if hit_row:
        row, s, e = _covers(np.concatenate(hit_row), np.concatenate(hit_start), length)
        m = len(row)
        empty = lambda kind: pa.nulls(m, kind)
        yield pa.record_batch(
            [tids.take(pa.array(order[row])), empty(pa.int32()), pa.array(s), pa.array(e), empty(pa.int32()), empty(pa.int64()), empty(pa.int64()), empty(pa.int32())],
            ["tid", "a", "s", "e", "o", "h1", "h2", "n"],
        )
    if sent:
        yield _to_compare(sent, tids, order, a)


def _to_compare(sent: list[tuple[np.ndarray, ...]], tids: pa.Array, order: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
    one, o, count, h1, h2 = (np.concatenate(x) for x in zip(*sent, strict=True))
    once = count == 1
    m = len(one)
    return pa.record_batch(
        [
            tids.take(pa.array(np.where(once, order[one], 0), mask=~once)),
            pa.array(np.where(once, a[one], 0).astype(np.int32), mask=~once),
            pa.nulls(m, pa.int64()),
            pa.nulls(m, pa.int64()),
            pa.array(o.astype(np.int32)),
            pa.array(h1),
            pa.array(h2),
            pa.array(np.minimum(count, 2).astype(np.int32)),
        ],
        ["tid", "a", "s", "e", "o", "h1", "h2", "n"],
    )


def recurring(suffixes: DataFrame, length: int, rows: int) -> DataFrame:
    """(tid, s, e): bytes of a text covered by strings of ``length`` that recur, from its anchors' contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := [b for b in batches if b.num_rows]:
            yield from _bucket(pa.Table.from_batches(found), length)

    parts = max(8, -(-rows // BUCKET))
    dealt = suffixes.repartitionByRange(int(parts), "ahead", "behind", "tid", "a")
    found = cut(dealt.mapInArrow(trimmed(run), FOUND), "recurring")
    here = found.filter("s is not null").select("tid", "s", "e")
    across = found.filter("s is null").groupBy("o", "h1", "h2").agg(
        F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") == 1, F.struct("tid", "a"))).alias("who")
    )
    across = across.filter("n > 1").select("o", F.explode("who").alias("w"))
    start = (F.col("w.a") - F.col("o")).cast("bigint")
    return here.unionByName(across.select(F.col("w.tid").alias("tid"), start.alias("s"), (start + length).alias("e")))


def spans(docs: DataFrame, length: int = MIN_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(copied: tid and n of texts that several rows have; one row a distinct text: tid, text; tid, s, e covered).

    docs: doc_id, text without nulls, tid (128-bit digest of the text). Of equal texts one takes part for all.
    """
    keys = docs.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
    copied = cut(keys.filter("n > 1"), "copied")
    single = maybe(docs, copied, inside=False).select("tid", "text")
    several = maybe(docs, copied).join(copied, "tid", "left").filter("n is null or doc_id <=> first_id")
    texts = single.unionByName(several.select("tid", "text").dropDuplicates(["tid"]))
    marked = cut(scan(texts, length), "anchors")
    marks = marked.select("tid", F.explode("marks").alias("m")).select("tid", "m.*")
    twice = marks.groupBy("h").count().filter("count > 1").select("h")
    near = marks.join(twice, "h").groupBy("tid").agg(F.collect_list(F.struct("h", "a", "near", "far")).alias("marks"))
    near = cut(near, "candidates")
    rows = near.agg(F.sum(F.size("marks"))).first()[0] or 0
    found = recurring(contexts(maybe(texts, near).join(near, "tid"), length), length, rows)
    own = marked.select("tid", F.explode("own").alias("o")).select("tid", "o.*")
    return copied, texts, cut(found.unionByName(own), "covered")


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_windows(data: np.ndarray, words: int, length: int) -> tuple[np.ndarray, ...]:
    """start, end, anchor's hash and anchor's place of all strings of ``words`` words under ``length`` bytes of a text.

    Equal strings have anchors of equal hash: the least hash of strings of half the words within.
    """
    edges = np.diff(np.concatenate([[0], (~_SPACE[data]).astype(np.int8), [0]]))
    first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if len(first) < words:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64))
    s, e = first[: len(first) - words + 1], end[words - 1 :]
    short = e - s < length
    k = max(1, words // 2)
    i, j = first[: len(first) - k + 1], end[k - 1 :]
    sums = Rolling(data).sums
    h = (sums[j] - sums[i]) * _powers(BASES[0], len(data) + 1, True)[i]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = np.uint64(0xFFFFFFFF)
    m = _window_min((h & ~low) | (low - np.arange(len(h), dtype=np.uint64)), words - k + 1)
    at = (low - (m & low)).astype(np.int64)
    return s[short], e[short], h[at][short], at[short]


def _within(s: np.ndarray, e: np.ndarray, spans: list[dict] | None) -> np.ndarray:
    """Which of s..e lie in one run of the spans, overlapping and touching ones merged."""
    if not spans:
        return np.zeros(len(s), bool)
    at = np.array(sorted((x["s"], x["e"]) for x in spans), np.int64)
    ends = np.maximum.accumulate(at[:, 1])
    new = np.flatnonzero(np.concatenate([[True], at[1:, 0] > ends[:-1]]))
    first, last = at[new, 0], ends[np.append(new[1:], len(at)) - 1]
    k = np.searchsorted(first, s, "right") - 1
    return (k >= 0) & (e <= last[np.maximum(k, 0)])


def short_passages(texts: DataFrame, words: int, length: int, covered: DataFrame) -> DataFrame:
    """(tid, s, e): bytes covered by strings of ``words`` words that recur and have fewer than ``length`` bytes, besides those
    that are ``covered`` (tid, s, e) already.

    texts: tid, text, one row a distinct text. Strings run from a word's first byte to a word's last and are compared as
    bytes (by 128-bit hash); only those whose anchor recurs are. Of strings within covered bytes only the hash is passed
    on, for others to meet.
    """

    def scan_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, marks, times = [], [], []
            for row, text in enumerate(b.column(1).to_pylist()):
                _, _, h, at = word_windows(np.frombuffer(text.encode(), np.uint8), words, length)
                one, n = np.unique(h[np.unique(at, return_index=True)[1]], return_counts=True)
                marks.append(one)
                times.append(n)
                owner += [row] * len(one)
            h = np.concatenate(marks) if marks else np.zeros(0, np.uint64)
            n = np.concatenate(times) if times else np.zeros(0, np.int64)
            yield pa.record_batch([b.column(0).take(pa.array(owner, pa.int64())), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["tid", "h", "n"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tid, text, marks, spans in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                s, e, h, _ = word_windows(np.frombuffer(raw, np.uint8), words, length)
                hit = np.isin(h.view(np.int64), np.array(marks, np.int64))
                s, e = s[hit], e[hit]
                digest = xxhash.xxh3_128_digest
                k = np.frombuffer(b"".join([digest(raw[i:j]) for i, j in zip(s.tolist(), e.tolist(), strict=True)]), np.int64).reshape(-1, 2)
                inside = _within(s, e, spans)
                owner = pa.array([tid] * len(s), pa.binary(), mask=inside) if len(s) else pa.nulls(0, pa.binary())
                place = [pa.array(x, mask=inside) for x in (s, e)]
                yield pa.record_batch([owner, *place, pa.array(k[:, 0]), pa.array(k[:, 1])], ["tid", "s", "e", "k1", "k2"])

    marked = cut(texts.select("tid", "text").mapInArrow(trimmed(scan_words), "tid binary, h bigint, n bigint"), "word-anchors")
    twice = marked.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    near = cut(marked.select("tid", "h").join(twice, "h").groupBy("tid").agg(F.collect_list("h").alias("marks")), "word-candidates")
    held = covered.groupBy("tid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    found = maybe(texts, near).join(near, "tid").join(held, "tid", "left").select("tid", "text", "marks", "spans")
    found = cut(found.mapInArrow(trimmed(windows), "tid binary, s bigint, e bigint, k1 bigint, k2 bigint"), "word-windows")
    again = found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.count("tid").alias("open")).filter("n > 1 and open > 0")
    return found.filter("tid is not null").join(again.select("k1", "k2"), ["k1", "k2"]).select("tid", "s", "e")


def _strip(raw: bytes, covered: list[tuple[int, int]]) -> tuple[bytes, int]:
    """(what is left, maximal removed runs)."""
    kept, at, runs, end = [], 0, 0, -1
    for s, e in sorted(covered):
        if s > end:
            runs += 1
            kept.append(raw[at:s])
        at = end = max(end, e)
    return b"".join([*kept, raw[at:]]), runs


def _with_digest(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("tid", F.unhex(F.md5("text")))


def _left(texts: DataFrame, covered: DataFrame) -> DataFrame:
    """(tid, kept: bytes, n_spans) of texts with covered bytes."""
    by_text = covered.groupBy("tid").agg(F.collect_set(F.struct("s", "e")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, runs = [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                left, n = _strip(text.encode(), [(x["s"], x["e"]) for x in found])
                kept.append(left)
                runs.append(n)
            yield pa.record_batch([b.column(0), pa.array(kept, pa.binary()), pa.array(runs, pa.int64())], ["tid", "kept", "n_spans"])

    joined = maybe(texts, covered.select("tid").distinct()).join(by_text, "tid")
    return joined.select("tid", "text", "spans").mapInArrow(trimmed(run), "tid binary, kept binary, n_spans bigint")


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _decoded(left: DataFrame) -> DataFrame:
    """(pw_tid, pw_left: text of the bytes kept, without those of a character that is only in part there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([x.decode(errors="ignore") for x in b.column(1).to_pylist()], pa.string())
            yield pa.record_batch([b.column(0), texts], ["pw_tid", "pw_left"])

    return left.select("tid", "kept").mapInArrow(trimmed(run), "pw_tid binary, pw_left string")


def _word_count() -> Column:
    return F.size(F.regexp_extract_all("text", F.lit(r"[^ \t-\r]+"), F.lit(0)))


def report(docs: DataFrame, length: int = MIN_BYTES, words: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and text if ``words`` is given) for each row of ``docs``.

    A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or
    another; strings are judged on the input. So a text of at least ``length`` bytes that several rows have is
    removed whole from each. Null text: empty. Texts under ``length`` bytes lose nothing. Null ids and repeated rows
    each give a row (repeats are copies); other columns are not looked at; an empty table gives no rows.

    text is what ``stripped`` would leave: besides those bytes, passages of ``words`` words that recur are taken out of it,
    however few bytes they have. The other columns do not count these.
    """
    plain = _with_digest(docs)
    copied, texts, covered = spans(plain, length)
    single = lambda found: found.join(copied.select("tid"), "tid", "left_anti")
    left = _left(texts, single(covered)).select(
        "tid", F.octet_length("kept").cast("bigint").alias("left"), "n_spans", F.sha2("kept", 256).alias("sha")
    )
    gone = copied.select("tid", F.lit(0).cast("bigint").alias("left"), F.lit(1).cast("bigint").alias("n_spans"), F.lit(EMPTY_SHA).alias("sha"))
    known = left.unionByName(gone)
    hit = F.col("sha").isNotNull() & (F.col("n_bytes") >= length)
    digest = [
        "doc_id",
        "n_bytes",
        F.when(hit, F.col("n_bytes") - F.col("left")).otherwise(0).cast("bigint").alias("n_removed"),
        F.when(hit, F.col("n_spans")).otherwise(0).cast("bigint").alias("n_spans"),
        F.when(hit, F.col("sha")).otherwise(F.col("whole")).alias("kept_sha256"),
    ]
    columns = ["doc_id", "tid", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("whole")]
    if words is None:
        return plain.select(*columns).join(known, "tid", "left").select(*digest)
    wide = cut(covered.select("tid", "s", "e").unionByName(short_passages(texts, words, length, covered)), "covered-words")
    new = _decoded(_left(texts, single(wide))).withColumnRenamed("pw_tid", "tid")
    known = cut(known.join(new, "tid", "full"), "left")
    changed, same = (maybe(plain, known, inside) for inside in (True, False))
    copy = F.col("sha").isNotNull() & (F.col("left") == 0) & F.col("pw_left").isNull() & (hit | (_word_count() >= words))
    text = F.when(copy, F.lit("")).otherwise(F.coalesce("pw_left", "text")).alias("text")
    nothing = [F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.col("whole").alias("kept_sha256"), "text"]
    changed = changed.select(*columns, "text").join(known, "tid", "left").select(*digest, text)
    return same.select(*columns, "text").select("doc_id", "n_bytes", *nothing).unionByName(changed)


def stripped(docs: DataFrame, length: int = MIN_BYTES, words: int | None = None) -> DataFrame:
    """``docs`` with what recurs taken out of text, and n_chars, if there, counted anew; all rows and columns stay.

    Bytes of a character that is only in part covered are dropped with it. Texts that several rows have become empty
    (if of ``length`` bytes or more), as in ``report``; drop copies first to keep one. With ``words``, passages of so
    many words recur too, however few bytes they have.
    """
    tid = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    copied, texts, covered = spans(_with_digest(docs), length)
    if words is not None:
        covered = cut(covered.select("tid", "s", "e").unionByName(short_passages(texts, words, length, covered)), "covered-words")
    left = _left(texts, covered.join(copied.select("tid"), "tid", "left_anti"))

    new = _decoded(left).withColumn("pw_part", F.lit(True))
    new = new.unionByName(copied.select(F.col("tid").alias("pw_tid"), F.lit("").alias("pw_left"), F.lit(False).alias("pw_part")))
    long = F.col("pw_part") | (F.octet_length("text") >= length)
    if words is not None:
        long = long | (_word_count() >= words)
    hit = F.col("pw_left").isNotNull() & long
    out = docs.withColumn("pw_tid", tid)
    changed, same = (maybe(out, new, inside, "pw_tid") for inside in (True, False))
    new_text = {"text": F.when(hit, F.col("pw_left")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new_text["n_chars"] = F.when(hit, F.length("pw_left").cast(kind)).otherwise(F.col("n_chars"))
    changed = changed.join(new, "pw_tid", "left").withColumns(new_text)
    return same.select(*docs.columns).unionByName(changed.select(*docs.columns))
