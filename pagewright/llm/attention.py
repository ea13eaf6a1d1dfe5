"""Language-model scores: a small causal self-attention model over subword ids, and a word-count base score.

The network is a block-local one: tokens are laid out in blocks, a token attends to its own block up to itself and to
the whole block before, so windows of two blocks overlap by one and each token is scored once. A token's probability
is that of its class, by the network, times its share of the class, by counts over all training documents.

Each word's chance is that which the network gives, after all ids before, to the class of the word's first id, times the
word's share of that class. The share is either that by counts of the class's words in the training texts, or the network
spells the rest of the word, id by id: the chance of the latter is what Good and Turing give a word of the class not met
before, the share of its words met once. Both parts sum to one over a class's words, and the classes to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keep_freed, recorded, release, trimmed
from .subwords import encode_ended, encoder, slices

FOLDS, HELD = 7, 2
BLOCK = 16
WIDTH = 16
CELLS = 4096  # rows of the table of input vectors, by id modulo CELLS
OWN, SHARED = 48, 16  # classes of one frequent id each, and of many ids
#: Words whose counts every worker holds; the rest are joined.
HEAD = 100_000
#: Bytes of texts whose words are counted at once.
COUNTED = 32 << 20
#: Ids of texts that are worked on at once.
IDS = 96_000
#: The network's weights are learned from one of so many training documents, by a hash of the text; 1: from all.
EVERY = 1
ROUNDS = 2
RATE = 4e-3
STEP = 128  # blocks a gradient step
CHUNK = 128  # blocks worked on at once: what they need stays in a core's cache
TOP = 40.0  # scores are held within this, so that exp() needs no maximum taken first


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD


# --- the network


@dataclass(frozen=True)
class Classes:
    """of: class by id; share: log10 of an id's share of its class; log_mass: log of the classes' shares of all."""

    of: np.ndarray
    share: np.ndarray
    log_mass: np.ndarray


def classes(counts: np.ndarray) -> Classes:
    """The most frequent ids have a class each; the others, by falling count, fill classes of about equal mass."""
    mass = counts + 1.0
    order = np.argsort(-mass, kind="stable")
    of = np.zeros(len(mass), np.int64)
    of[order[:OWN]] = np.arange(min(OWN, len(mass)))
    rest = order[OWN:]
    done = np.cumsum(mass[rest])
    if len(rest):
        of[rest] = OWN + np.minimum(SHARED - 1, ((done - mass[rest]) / done[-1] * SHARED).astype(np.int64))
    total = np.bincount(of, mass, OWN + SHARED)
    return Classes(of, np.log10(mass / total[of]), np.log(np.maximum(total, 1e-9) / total.sum()))


Weights = dict[str, np.ndarray]
_SEEN = np.arange(2 * BLOCK)[None, :] <= np.arange(BLOCK)[:, None] + BLOCK  # what a token of a block sees of two


def initial(log_mass: np.ndarray, seed: int = 11) -> Weights:
    """Small random weights; the output starts at the classes' frequencies."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    square = {k: draw(WIDTH, WIDTH, by=WIDTH**-0.5) for k in ("q", "k", "v", "h")}
    return {"e": draw(CELLS, WIDTH, by=0.5), **square, "bias": np.zeros((BLOCK, 2 * BLOCK), np.float32), "u": draw(WIDTH, len(log_mass), by=0.05), "b": log_mass.astype(np.float32)}


def layout(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cells of inputs, targets, which blocks begin a document, document of each block); targets are -1 past an end.

    A token's input is the token before; a document's first token follows ``end``.
    """
    n = np.diff(bounds)
    blocks = -(-n // BLOCK)
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    target = np.full(total * BLOCK, -1, np.int64)
    at = np.arange(len(ids)) + np.repeat(first * BLOCK - bounds[:-1], n)
    target[at] = ids
    source = np.full(total * BLOCK + 1, end, np.int64)
    source[1:][target >= 0] = target[target >= 0]
    source = source[:-1]
    source[first[blocks > 0] * BLOCK] = end
    begins = np.zeros(total, bool)
    begins[first[blocks > 0]] = True
    return (source % CELLS).reshape(-1, BLOCK), target.reshape(-1, BLOCK), begins, np.repeat(np.arange(len(n)), blocks)


def _pairs(x: np.ndarray) -> np.ndarray:
    """Each block with the one before it, as a view: (blocks + 1) x BLOCK x WIDTH to blocks x 2 BLOCK x WIDTH."""
    x = np.ascontiguousarray(x)
    return np.ndarray((len(x) - 1, 2 * BLOCK, WIDTH), x.dtype, x, 0, x.strides)


def _dealt(x: np.ndarray) -> np.ndarray:
    """The rows of ``x``, a multiple of BLOCK, in BLOCK parts: BLAS has a quicker way for products of small matrices."""
    return x.reshape(BLOCK, -1, x.shape[-1])


def projected(w: Weights) -> np.ndarray:
    """For each cell its query, key, value and skip vectors, side by side."""
    return w["e"] @ np.concatenate([w["q"] * np.float32(WIDTH**-0.5), w["k"], w["v"], w["h"]], 1)


def _bound(x: np.ndarray) -> bool:
    """Hold ``x`` within TOP; whether any of it was beyond."""
    beyond = x.size > 0 and bool(x.max() > TOP or x.min() < -TOP)
    if beyond:
        np.clip(x, -TOP, TOP, out=x)
    return beyond


def _attend(w: Weights, q: np.ndarray, k: np.ndarray, v: np.ndarray, h: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
    """q, k, v, h: ``projected`` vectors, those of keys and values with the block before the blocks themselves."""
    keys, values = _pairs(k), _pairs(v)
    a = q @ keys.transpose(0, 2, 1)
    _bound(a)
    np.exp(a, out=a)
    a *= np.exp(np.minimum(w["bias"], TOP)) * _SEEN
    a[begins, :, :BLOCK] = 0
    a *= 1 / (a.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, a.dtype)).reshape(*a.shape[:2], 1)
    seen = a @ values
    return {"keys": keys, "values": values, "a": a, "seen": seen, "z": seen + h}


def _hidden(z: np.ndarray) -> np.ndarray:
    """What is above zero, and a one beside it, by which the output's summands are weighed."""
    out = np.empty((z.size // WIDTH, WIDTH + 1), z.dtype)
    np.maximum(z.reshape(-1, WIDTH), 0, out=out[:, :WIDTH])
    out[:, WIDTH] = 1
    return out


def _before(cells: np.ndarray, i: int, j: int) -> np.ndarray:
    return cells[i - 1 : j] if i else np.concatenate([cells[:1], cells[:j]])  # what is before the first is masked


def log_chances(w: Weights, c: Classes, ids: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
    """log10 probability of each id of the documents, ``end`` included, given those before it."""
    cells, target, begins, _ = layout(ids, bounds, end)
    out = np.empty(target.shape)
    table = np.split(projected(w), 4, 1)
    q, k, v, h = (np.ascontiguousarray(x) for x in table)
    ones, output = np.ones(len(w["b"]), np.float32), np.concatenate([w["u"], w["b"][None]])
    for i in range(0, len(cells), CHUNK):
        j = min(len(cells), i + CHUNK)
        here, own = _before(cells, i, j), cells[i:j]
        z = _attend(w, q.take(own, axis=0), k.take(here, axis=0), v.take(here, axis=0), h.take(own, axis=0), begins[i:j])["z"]
        logits = (_dealt(_hidden(z)) @ output).reshape(-1, output.shape[1])
        _bound(logits)
        t = np.maximum(target[i:j].ravel(), 0)
        chosen = logits[np.arange(len(t)), c.of[t]]
        norm = np.log(np.exp(logits, out=logits) @ ones)
        out[i:j] = ((chosen - norm) * np.float64(1 / np.log(10)) + c.share[t]).reshape(-1, BLOCK)
    return out[target >= 0]


def gradients(w: Weights, cells: np.ndarray, wanted: np.ndarray, begins: np.ndarray) -> tuple[Weights, float]:
    """Of the mean cross-entropy of the classes wanted (-1: none); cells have one block more, that before. For input
    vectors, those of the cells ``rows`` alone."""
    table = np.concatenate([w["q"] * np.float32(WIDTH**-0.5), w["k"], w["v"], w["h"]], 1)
    x = w["e"].take(cells.ravel(), axis=0)
    parts = [(x @ table[:, i : i + WIDTH]).reshape(*cells.shape, WIDTH) for i in range(0, 4 * WIDTH, WIDTH)]
    q = parts[0][1:]
    f = _attend(w, q, parts[1], parts[2], parts[3][1:], begins)
    a, z = f["a"], f["z"]
    hidden = _hidden(z)
    output = np.concatenate([w["u"], w["b"][None]])
    p = (_dealt(hidden) @ output).reshape(-1, output.shape[1])
    held = _bound(p) and np.abs(p) >= TOP  # no gradient beyond the bounds that scores are held within
    t = wanted.ravel()
    real = t >= 0
    rows = np.flatnonzero(real)
    n = max(1, len(rows))
    at = rows * p.shape[1] + t[rows]
    flat = p.ravel()
    chosen = flat[at]
    np.exp(p, out=p)
    total = p @ np.ones(p.shape[1], p.dtype)
    loss = float((np.log(total[rows]) - chosen).sum()) / n
    p *= (real / (n * total)).astype(p.dtype)[:, None]
    flat[at] -= p.dtype.type(1 / n)
    if held is not False:
        p[held] = 0
    both = (_dealt(hidden).transpose(0, 2, 1) @ _dealt(p)).sum(0)
    g: Weights = {"u": both[:WIDTH], "b": both[WIDTH]}
    dz = (_dealt(p) @ w["u"].T).reshape(z.shape)
    dz *= z > 0
    da = dz @ f["values"].transpose(0, 2, 1)
    da -= ((dz * f["seen"]) @ np.ones(WIDTH, dz.dtype))[:, :, None]
    ds = np.multiply(a, da, out=da)
    g["bias"] = ds.sum(0)
    d = np.zeros((4, *cells.shape, WIDTH), x.dtype)
    np.matmul(ds, f["keys"], out=d[0, 1:])
    d[3, 1:] = dz
    for own, weights, of in ((d[1], ds, q), (d[2], a, dz)):
        np.matmul(weights[:, :, BLOCK:].transpose(0, 2, 1), of, out=own[1:])
        own[:-1] += weights[:, :, :BLOCK].transpose(0, 2, 1) @ of
    d = d.reshape(4, -1, WIDTH)
    g |= dict(zip("qkvh", d.transpose(0, 2, 1) @ x, strict=True))
    g = {k: v.T if k in "qkvh" else v for k, v in g.items()}
    g["q"] = g["q"] * np.float32(WIDTH**-0.5)
    dx = (d @ table.reshape(WIDTH, 4, WIDTH).transpose(1, 2, 0)).sum(0)
    order = np.argsort(cells.ravel().astype(np.uint16), kind="stable")
    own = cells.ravel()[order]
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    g["rows"], g["e"] = own[new], np.add.reduceat(dx.take(order, axis=0), new, axis=0)
    return g, loss


class Adam:
    """w: the weights; all but the input vectors are views of one vector, and so are their moments."""

    def __init__(self, w: Weights) -> None:
        self.names = [k for k in w if k != "e"]
        self.flat = np.concatenate([w[k].ravel() for k in self.names])
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.e = np.zeros((3, *w["e"].shape), w["e"].dtype)
        self.e[2] = w["e"]
        cuts = np.cumsum([w[k].size for k in self.names])[:-1]
        self.w = {k: x.reshape(w[k].shape) for k, x in zip(self.names, np.split(self.flat, cuts), strict=True)} | {"e": self.e[2]}
        self.t = 0

    def step(self, g: Weights) -> None:
        """Input vectors that a step has not met stay, and so do their moments."""
        self.t += 1
        rate = np.float32(RATE * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t))
        rows = g["rows"]
        met = self.e.take(rows, axis=1)
        for m, v, w, x in ((self.m, self.v, self.flat, np.concatenate([g[k].ravel() for k in self.names])), (*met, g["e"])):
            m += 0.1 * (x - m)
            v += 0.001 * (x * x - v)
            w -= rate * m / (np.sqrt(v) + 1e-8)
        self.e[:, rows] = met


# --- over the corpus


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all ``texts``: A-Z lower-cased, split at white space, and the empty word once a text, its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.cumulative_sum(pc.binary_length(b.column(0)).cast(pa.int64())).to_numpy()
            cuts = np.flatnonzero(np.diff(size // COUNTED, prepend=0, append=-1))
            for i, j in zip([0, *cuts[:-1]], cuts, strict=True):
                if i == j:
                    continue
                # white space at a text's ends leaves empty words there; only its end is to count as one
                words = pc.ascii_split_whitespace(pc.ascii_lower(b.column(0).slice(i, j - i))).flatten().value_counts()
                word, c = words.field(0).cast(pa.binary()), words.field(1)
                some = pc.greater(pc.binary_length(word), 0)
                word, c = (pa.concat_arrays([x.filter(some), pa.array([own], x.type)]) for x, own in ((word, b""), (c, j - i)))
                yield pa.record_batch([word, c], ["word", "c"])

    return texts.select("text").mapInArrow(trimmed(run), "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def subword_counts(counts: DataFrame, path: str, end: int) -> np.ndarray:
    """Three rows of counts by id over the counted words: of the id itself, of words that begin with it, and of words met
    once that do. A word's ids do not depend on its neighbours; the empty word's is ``end``; some words have none.

    Each task sends three vectors of the vocabulary's size; they are added up in a few tasks before the driver has them.
    """
    shape = 3, end + 1

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for b in batches:
            words = b.column(0).to_pylist()
            for i in range(0, len(words), 20_000):
                part, own = words[i : i + 20_000], b.column(1).to_numpy()[i : i + 20_000]
                ids, bounds = encode_ended(path, "word", part, end)
                c = np.repeat(own, np.diff(bounds))
                text_end = np.fromiter((not w for w in part), bool, len(part))
                c[bounds[1:] - 1] = np.where(text_end, own, 0)  # that after another word is none
                first, real = ids[bounds[:-1]], (np.diff(bounds) > 1) | text_end
                for row, (at, n) in enumerate(((ids, c), (first, own * real), (first, real & (own == 1)))):
                    total[row] += np.bincount(at, n, end + 1).astype(np.int64)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for b in batches:
            for v in b.column(0).to_pylist():
                total += np.frombuffer(v, np.int64).reshape(shape)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["v"])

    some = counts.mapInArrow(trimmed(one), "v binary").repartition(8).mapInArrow(add, "v binary").collect()
    return sum((np.frombuffer(r["v"], np.int64).reshape(shape) for r in some), np.zeros(shape, np.int64))


@dataclass(frozen=True)
class Shares:
    """By class: log10 of a met word's share of its class for each time that it was met, and of the chance of a word of the
    class not met before. The last entry is for words without ids, of all words."""

    met: np.ndarray
    new: np.ndarray


def shares(of: np.ndarray, words: np.ndarray, once: np.ndarray, unmet: tuple[int, int, float]) -> Shares:
    """words, once: by first id, how many words, and how many met once; unmet: as ``unmet`` gives it for all words."""
    n, once = (np.bincount(of, x, OWN + SHARED) for x in (words, once))
    q = np.where(n > 1, np.maximum(once, 1) / np.maximum(n, 1), 1.0)
    n, q = np.append(n, unmet[0]), np.append(q, unmet[2])
    return Shares(np.log10(np.maximum((1 - q) / np.maximum(n, 1), 1e-300)), np.log10(q))


def _words(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """(words of all ``texts``, each text's followed by the empty one, its end; how many by text)."""
    words: list[bytes] = []
    n = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.encode().lower().split()
        words += own
        words.append(b"")
        n[i] = len(own) + 1
    return words, n


def _packed(flat: np.ndarray, n: np.ndarray) -> pa.Array:
    """A binary value a text: ``n`` by text of the numbers in ``flat``."""
    ends = np.concatenate([[0], np.cumsum(n)]) * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


def encoded(texts: DataFrame, path: str, end: int) -> DataFrame:
    """``texts`` with their ids and, by word, how many ids, both as bytes: every text is encoded once, here, for all that
    learn from it and score it. A word's ids do not depend on its neighbours; ``end`` is that of the empty word, a text's end."""
    kind = _id_type(end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in slices(b.column(1), 1 << 18):
                words, n = _words(part)
                ids, bounds = encoder(path, "word").encode(words)
                sizes, ends = np.diff(bounds), np.cumsum(n)
                sizes[ends - 1] = 1
                own = np.diff(np.cumsum(sizes)[ends - 1], prepend=0)
                flat = np.full(len(ids) + len(part), end, kind)
                flat[np.arange(len(ids)) + np.repeat(np.arange(len(part)), own - 1)] = ids
                given = [b.column(i).slice(first, len(part)) for i in (0, 1)]
                yield pa.record_batch([*given, _packed(flat, own), _packed(sizes.astype("<u4"), n)], ["doc_id", "text", "ids", "sizes"])

    of = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {of}, text string, ids binary, sizes binary")


def _id_type(end: int) -> str:
    return "<u2" if end < 1 << 16 else "<u4"


def _ids(column: pa.Array, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, bounds by row) of a column of ids, by pieces of about IDS."""
    kind = np.dtype(_id_type(end))
    ends = np.cumsum(pc.binary_length(column).to_numpy() // kind.itemsize, dtype=np.int64)
    cuts = np.flatnonzero(np.diff(ends // IDS, prepend=0, append=-1))
    for i, j in zip([0, *cuts[:-1]], cuts, strict=True):
        if i < j:
            bounds = np.concatenate([[ends[i - 1] if i else 0], ends[i:j]])
            yield i, np.frombuffer(b"".join(column.slice(i, j - i).to_pylist()), kind), bounds - bounds[0]


def _flat(w: Weights) -> bytes:
    return np.concatenate([w[k].ravel() for k in sorted(w)]).astype("<f4").tobytes()


def _unflat(raw: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = raw[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def train(texts: DataFrame, path: str, c: Classes, end: int, every: int = EVERY, rounds: int = ROUNDS) -> Weights:
    """Learn the network's weights from all texts, or from one of ``every`` by a hash of the text. Texts that are not yet
    ``encoded`` are so first.

    In a round each partition starts from the common weights, takes a step of Adam for each STEP blocks of its texts,
    and the weights are averaged by the number of blocks, in a few tasks first. No texts: the initial weights.
    """
    weights = initial(c.log_mass)
    chosen = texts if every == 1 else texts.filter(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(every)) == 0)
    if "ids" not in texts.columns:
        chosen = cut(encoded(chosen, path, end), "encoded")

    for _ in range(rounds):
        start = weights

        def learn(batches: Iterator[pa.RecordBatch], start: Weights = start) -> Iterator[pa.RecordBatch]:
            keep_freed()
            adam, seen = Adam(start), 0
            rng = np.random.default_rng(TaskContext.get().partitionId())
            for b in batches:
                for _, ids, bounds in _ids(b.column(0), end):
                    cells, target, begins, _ = layout(ids, bounds, end)
                    wanted = np.where(target >= 0, c.of[np.maximum(target, 0)], -1)
                    steps = np.arange(0, len(cells), STEP)
                    for i in rng.permutation(steps):
                        j = min(len(cells), i + STEP)
                        adam.step(gradients(adam.w, _before(cells, i, j), wanted[i:j], begins[i:j])[0])
                    seen += len(cells)
            if seen:
                yield pa.record_batch([pa.array([_flat(adam.w)], pa.binary()), pa.array([seen])], ["w", "n"])

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = None, 0
            for b in batches:
                for raw, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    x = np.frombuffer(raw, "<f4").astype(np.float64) * k
                    total, n = x if total is None else total + x, n + k
            if n:
                yield pa.record_batch([pa.array([(total / n).astype("<f4").tobytes()], pa.binary()), pa.array([n])], ["w", "n"])

        learned = chosen.select("ids").mapInArrow(trimmed(learn), "w binary, n bigint").repartition(8).mapInArrow(mean, "w binary, n bigint").collect()
        if learned:
            n = sum(r["n"] for r in learned)
            weights = _unflat(sum(np.frombuffer(r["w"], "<f4").astype(np.float64) * (r["n"] / n) for r in learned), start)
    return weights


def _head(counts: DataFrame, most: int) -> list:
    """The most frequent words, at most ``most``: all those from a count on. A histogram of counts by their logarithm,
    of a few hundred rows, tells from which, so the driver gets no rows but these."""
    level = F.floor(F.log2("c") * 8)
    total, least = 0, None
    for r in counts.groupBy(level.alias("l")).count().orderBy(F.col("l").desc()).collect():
        total += r["count"]
        if total > most:
            break
        least = r["l"]
    return counts.filter(level >= least).collect() if least is not None else []


def unmet(counts: DataFrame) -> tuple[int, int, float]:
    """(words in all, distinct words, chance of a word not met before: the share of those met once)."""
    n, v, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") == 1)).first()
    return n, v, max(once, 1) / n if n > 1 else 1.0


def score(docs: DataFrame, path: str, end: int = 49407, head: int = HEAD, every: int = EVERY, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``.

    base_score adds log10((c + 1) / (N + V + 1)) over words and an end; c, N and V are of the rows not held out. score
    adds log10(p ((1 - q) c / n + q r)): p is the network's chance of the class of the word's first id, r that of the id in
    its class and of the word's other ids, n counts the class's words and q is the chance of one not met before. Words
    without ids (of white space beyond ASCII alone) are a class of all words, which the network does not see. Counts of the ``head`` most frequent words are broadcast (a bound, not a cut: a word beyond is
    joined with the table of counts; as such words are rare, none of them is a hot key). Null text: empty, so the end
    alone. A null id reads as the empty text for held_out. Repeated rows each give a row; other columns are not looked at.
    With no rows to learn from, N and V are 0, and score is the initial network's; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = _texts(docs)
    learned = ~held_out(F.col("doc_id"))
    counts = cut(word_counts(texts.filter(learned)), "words")
    n, v, new = unmet(counts)
    by_id = subword_counts(counts, path, end)
    top = _head(counts, head)
    known = spark.sparkContext.broadcast({bytes(r["word"]): int(r["c"]) for r in top})
    of = classes(by_id[0])
    with recorded() as made:
        texts = cut(encoded(texts, path, end), "encoded")
    weights = train(texts.filter(learned), path, of, end, every, rounds)
    model = spark.sparkContext.broadcast((weights, of, shares(of.of, by_id[1], by_id[2], (n, v, new))))
    space = float(n + v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        w, of, share = model.value
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            for first, ids, bounds in _ids(b.column(2), end):
                part = b.column(1).slice(first, len(bounds) - 1).to_pylist()
                words, n_tokens = _words(part)
                sizes = np.frombuffer(b"".join(b.column(3).slice(first, len(part)).to_pylist()), "<u4").astype(np.int64)
                until = np.cumsum(sizes)
                ids = ids.astype(np.int64)
                each = log_chances(w, of, ids, bounds, end)
                done = np.concatenate([[0.0], np.cumsum(each)])
                start, none = until - sizes, sizes == 0
                kind = np.where(none, len(share.met) - 1, of.of[ids[start]])
                met = np.where(none, 0.0, each[start] - of.share[ids[start]]) + share.met[kind]
                spelt = share.new[kind] + done[until] - done[start]
                text_of = np.repeat(np.arange(len(part)), n_tokens)
                c = np.fromiter(map(known.value.get, words, repeat(-1)), np.int64, len(words))
                here = c >= 0
                base = np.bincount(text_of, np.where(here, np.log10(np.maximum(c + 1, 1) / space), 0), len(part))
                whole = np.log10(np.maximum(c, 0) * 10.0**met + 10.0 ** np.maximum(spelt, -300), where=here, out=np.zeros(len(c)))
                lm = np.bincount(text_of, whole, len(part))
                sure = np.bincount(text_of, here, len(part)).astype(np.int64)
                away = np.flatnonzero(~here)  # words beyond the head
                told = [pa.array(x[away].astype(np.float32)) for x in (met, spelt)]
                rest = pa.StructArray.from_arrays([pa.array([words[i] for i in away], pa.binary()), *told], ["word", "met", "spelt"])
                held = np.concatenate([[0], np.cumsum(np.bincount(text_of[away], minlength=len(part)))]).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(held), rest)
                yield pa.record_batch(
                    [pa.array(np.arange(row, row + len(part))), b.column(0).slice(first, len(part)), pa.array(n_tokens), pa.array(sure), pa.array(base), rest, pa.array(lm)],
                    ["row", "doc_id", "n_tokens", "sure", "base", "rest", "lm"],
                )
                row += len(part)

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = cut(texts.mapInArrow(trimmed(run), f"row bigint, doc_id {kind}, n_tokens bigint, sure bigint, base double, rest array<struct<word: binary, met: float, spelt: float>>, lm double"), "scored")
    release(spark, made)  # nothing reads the ids again
    tail = scored.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.met", "r.spelt")
    c = F.coalesce("c", F.lit(0))
    lone = F.col("spelt").cast("double")
    whole = F.when(c > 0, F.log10(c * F.pow(F.lit(10.0), F.col("met").cast("double")) + F.pow(F.lit(10.0), F.greatest(lone, F.lit(-300.0))))).otherwise(lone)
    tail = tail.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.log10((c + 1) / F.lit(space))).alias("more"), F.count_if(c > 0).alias("also"), F.sum(whole).alias("also_lm")
    )
    return scored.join(tail, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("sure") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("lm") + F.coalesce("also_lm", F.lit(0.0))).alias("score"),
    )
