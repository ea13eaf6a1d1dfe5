"""Subword ids of many texts: whole texts are cut where no token can span, and repeated pieces are encoded once.

Plain texts (ASCII and the letters of Latin-1, without odd white space) are cut and looked up by numpy, all texts of a
call at once: a piece is read eight bytes at a time, which name its entry in a table of hashes. Other texts are cut by
patterns, and their pieces looked up one by one.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: How texts that are not plain are cut. byte: before white space that follows something else, so a piece is white space
#: and what comes after it; for vocabularies whose tokens may begin with a space. word: at white space, which the
#: vocabulary drops.
CUTS = {"byte": re.compile(r"[ \n]*[^ \n]+|[ \n]+"), "word": re.compile(r"[^ \t\n\r]+")}
#: White space other than this can split a token at a cut of kind byte: such texts are encoded whole.
OTHER_SPACE = re.compile(r"[^\S \n]")
#: Normalisers and patterns of the two kinds of vocabulary, as their files name them. Others are refused.
FORMS = {
    "byte": ([], ["ByteLevel: own pattern"]),
    "word": (
        ["NFC", "Replace", "Lowercase"],
        [r"Split: 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "ByteLevel: no pattern"],
    ),
}
#: Classes of bytes in plain texts.
OTHER, LETTER, DIGIT, MARK, SPACE, LINE = range(6)
#: Longest piece, in bytes, that is looked up by numpy; texts with longer ones are not plain.
LONGEST = 64
#: Pieces that are encoded in one call, with a special token between them, which ends a piece like a text's end.
JOINED = 256
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def _byte_names() -> list[str]:
    """The character by which byte-level vocabularies name each byte: itself if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


def _form(tokenizer) -> tuple[list[str], list[str]]:
    """The file's normalisers, and its patterns."""
    told = json.loads(tokenizer.to_str())
    each = lambda x, many: [] if x is None else x[many] if x["type"] == "Sequence" else [x]
    parts = []
    for x in each(told["pre_tokenizer"], "pretokenizers"):
        byte = x["type"] == "ByteLevel" and not x["add_prefix_space"]
        parts.append(f"{x['type']}: " + (("own pattern" if x["use_regex"] else "no pattern") if byte else str(x.get("pattern", {}).get("Regex"))))
    return [x["type"] for x in each(told["normalizer"], "normalizers")], parts


def _classes(kind: str) -> np.ndarray:
    """Class by byte. Letters beyond ASCII are two bytes, 0xC3 and one from 0x80 on."""
    of = np.zeros(256, np.uint8)
    of[33:127] = MARK
    of[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = LETTER
    of[48:58] = DIGIT
    of[32], of[10] = SPACE, LINE if kind == "byte" else SPACE
    if kind == "word":
        of[[9, 13]] = SPACE
    of[ord("'")] = OTHER  # it begins contractions
    return of


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    return x ^ (x >> np.uint64(29))


class Table:
    """64-bit keys to numbers, open addressing; the key 0 is taken as 1."""

    def __init__(self, size: int = 1 << 16) -> None:
        self.keys, self.values, self.n = np.zeros(size, np.uint64), np.zeros(size, np.int32), 0

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of ``keys``, -1 where there are none."""
        mask = np.uint64(len(self.keys) - 1)
        at = (keys & mask).astype(np.int64)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            at[left] = (at[left] + 1) & int(mask)
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (held != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct ``keys`` that are not there."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            full = self.keys != 0
            old = self.keys[full], self.values[full]
            self.__init__(1 << int(4 * (self.n + len(keys))).bit_length())
            self.put(*old)
        self.n += len(keys)
        mask = len(self.keys) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = keys[free]  # of several at one place the last stays
            done = self.keys[at[left]] == keys[left]
            self.values[at[left[done]]] = values[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & mask


class Encoder:
    """Ids of the ``tokenizers`` file at ``path``, equal to encoding each whole text without special tokens.

    The memory of pieces is bounded by ``entries`` and ``chars``: when it is full, pieces met only once are forgotten,
    and all of them if that frees less than half.
    """

    def __init__(self, path: str, kind: str, entries: int = 350_000, chars: int = 8_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind, self.entries, self.chars = kind, entries, chars
        self.model = self.tokenizer.model
        self.byte_names = _byte_names()
        self.classes = _classes(kind)
        if _form(self.tokenizer) != FORMS[kind]:
            raise ValueError(f"{path} parts texts otherwise than vocabularies of kind {kind}")
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark = special[0] if special else None
        self._forget(np.zeros(0, np.int64))

    def _forget(self, kept: np.ndarray) -> None:
        """Keep the entries ``kept`` alone, numbered anew."""
        if len(kept):
            n = self.counts[kept].astype(np.int64)
            done = np.cumsum(n)
            flat = self.flat[np.repeat(self.starts[kept] - done + n, n) + np.arange(done[-1])]
            keys, second, size = self.keys[kept], self.second[kept], self.sizes[kept]
            number = np.full(self.n, -1)
            number[kept] = np.arange(len(kept))
            index = {k: int(number[i]) for k, i in self.index.items() if number[i] >= 0}
        else:
            n, size, flat, index = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), {}
            keys = second = np.zeros(0, np.uint64)
        #: index: entry by piece, of texts that are not plain; table: by key, of plain ones.
        self.index: dict[str, int] = index
        self.n, self.held, self.used = len(n), int(size.sum(dtype=np.int64)), len(flat)
        self.flat = np.concatenate([flat, np.zeros(1 << 16, np.uint32)])
        more = lambda x: np.concatenate([x, np.zeros(1 << 12, x.dtype)])
        self.counts, self.starts, self.sizes = (more(x.astype(np.int32)) for x in (n, np.cumsum(n) - n, size))
        self.keys, self.second = more(keys), more(second)
        self.met = np.zeros(len(self.counts), np.int32)
        self.table = Table()
        if len(own := np.flatnonzero(keys)):
            self.table.put(keys[own], own.astype(np.int32))

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ids by piece): many pieces a call, parted by a special token that none of them holds."""
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        text, mark = self.mark
        found = encode([text.join(pieces[i : i + JOINED]) + text for i in range(0, len(pieces), JOINED)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        ends = np.flatnonzero(ids == mark)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ids by piece) of pieces that are one word to the vocabulary's pattern: merging alone is left."""
        merge, names = self.model.tokenize, self.byte_names
        found = [[t.id for t in merge(p.decode() if p.isascii() and p[0] > 32 else "".join([names[c] for c in p]))] for p in pieces]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def _parted(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ids by piece) of any pieces."""
        if self.mark and not any("<" in p and self.mark[0] in p for p in pieces):
            return self._ids(pieces)
        found = [e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def _learn(self, flat: np.ndarray, n: np.ndarray, sizes: np.ndarray, keys: np.ndarray | int = 0, second: np.ndarray | int = 0) -> np.ndarray:
        """The numbers of new entries with these ids."""
        first, last = self.n, self.n + len(n)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while last > len(self.starts):
            for name in ("starts", "counts", "sizes", "keys", "second", "met"):
                x = getattr(self, name)
                setattr(self, name, np.concatenate([x, np.zeros_like(x)]))
        self.flat[self.used : self.used + len(flat)] = flat
        self.counts[first:last], self.sizes[first:last] = n, sizes
        self.starts[first:last] = self.used + np.cumsum(n) - n
        self.keys[first:last], self.second[first:last] = keys, second
        self.n, self.used, self.held = last, self.used + len(flat), self.held + int(sizes.sum())
        return np.arange(first, last)

    def _plain(self, data: np.ndarray, of: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which of the texts in ``data``, whose bytes have the classes ``of``, are plain."""
        odd = of == OTHER
        pair = (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        pair |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # signs among the letters
        if self.kind == "byte":
            blank = of >= SPACE
            both = blank[:-1] & blank[1:]
            inner = bounds[1:-1]
            both[inner[(inner > 0) & (inner < len(data))] - 1] = False
            pair |= both
        odd[:-1] |= pair
        if not odd.any():
            return np.ones(len(bounds) - 1, bool)
        done = np.concatenate([[0], np.cumsum(odd)])
        return done[bounds[1:]] == done[bounds[:-1]]

    def _pieces(self, of: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the words of plain texts whose bytes have the classes ``of``."""
        new = np.empty(len(of), bool)
        new[0] = True
        np.not_equal(of[1:], of[:-1], out=new[1:])
        if self.kind == "byte":  # a space goes with what follows it
            space = of == SPACE
            new[1:] &= ~space[:-1]
            new |= space
        else:
            new |= of == DIGIT
        new[bounds[:-1][bounds[:-1] < len(of)]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(of))
        if self.kind == "byte":
            return start, end
        word = of[start] != SPACE
        return start[word], end[word]

    def _places(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The entries of pieces in ``data``, which 8 zero bytes follow; -1 for one that its keys do not tell for sure."""
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        size = end - start
        masks = np.array([*((1 << 8 * i) - 1 for i in range(8)), (1 << 64) - 1], np.uint64)
        key = eight[start] & masks[np.minimum(size, 8)]
        long = np.flatnonzero(size > 8)
        h, at, left = key[long], start[long] + 8, size[long] - 8
        key = _mixed(key)
        g, h = h * _MIX[1], _mixed(h)
        live = np.arange(len(long))
        while len(live):
            word = eight[at[live]] & masks[np.minimum(left[live], 8)]
            h[live] = _mixed(h[live] ^ (word * _MIX[1]) ^ left[live].astype(np.uint64))
            g[live] = (g[live] ^ word) * _MIX[2]
            g[live] ^= g[live] >> np.uint64(31)
            at[live] += 8
            left[live] -= 8
            live = live[left[live] > 0]
        key[long] = h
        key[key == 0] = 1
        found = self.table.get(key)
        if len(new := np.flatnonzero(found < 0)):
            keys, one, back = np.unique(key[new], return_index=True, return_inverse=True)
            one = new[one]
            raw = data.tobytes()
            pieces = [raw[i:j] for i, j in zip(start[one].tolist(), end[one].tolist(), strict=True)]
            other = np.zeros(len(start), np.uint64)
            other[long] = g | np.uint64(1)
            number = self._learn(*self._merged(pieces), size[one], keys, other[one])
            self.table.put(keys, number.astype(np.int32))
            found[new] = number[back]
        sure = self.second[found[long]] == (g | np.uint64(1))
        found[long[~sure]] = -1
        return found

    def encode(self, texts: list[str] | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids uint32 of all texts, one after the other; bounds int64, one more than texts). Texts may be UTF-8 already."""
        if self.n > self.entries or self.held > self.chars:
            kept = np.flatnonzero(self.met[: self.n] > 1)
            few = len(kept) < self.entries // 2 and self.held < 2 * self.chars
            self._forget(kept if few else np.zeros(0, np.int64))
        raw = texts if texts and isinstance(texts[0], bytes) else [t.encode() for t in texts]
        bounds = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)), out=bounds[1:])
        data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
        plain, at, n = np.ones(len(texts), bool), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        if bounds[-1]:
            data = self._folded(data) if self.kind == "word" else data
            of = self.classes[data[: bounds[-1]]]
            plain = self._plain(data[: bounds[-1]], of, bounds)
            start, end = self._pieces(of, bounds)
            first = np.searchsorted(start, bounds)
            fits = end - start <= LONGEST
            if not fits.all():
                plain[np.searchsorted(bounds, start[~fits], "right") - 1] = False
            n = np.diff(first)
            if not plain.all():
                own = np.repeat(plain, n)
                start, end, n = start[own], end[own], np.where(plain, n, 0)
            at = self._places(data, start, end).astype(np.int64)
            if len(unsure := np.flatnonzero(at < 0)):
                plain[np.searchsorted(np.cumsum(n), unsure, "right")] = False
                at, n = at[np.repeat(plain, n)], np.where(plain, n, 0)
        if len(hard := np.flatnonzero(~plain)):
            names: list[str] = []
            for i in hard.tolist():
                t = raw[i].decode()
                found = [t] if self.kind == "byte" and OTHER_SPACE.search(t) else CUTS[self.kind].findall(t)
                names += found
                n[i] = len(found)
            if new := [p for p in dict.fromkeys(names) if p not in self.index]:
                number = self._learn(*self._parted(new), np.array([len(p) for p in new], np.int64))
                self.index.update(zip(new, number.tolist(), strict=True))
            both, own = np.zeros(int(n.sum()), np.int64), np.repeat(plain, n)
            both[own] = at
            both[~own] = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))
            at = both
        self.met[: self.n] += np.bincount(at, minlength=self.n).astype(np.int32)
        counts = self.counts[at]
        done = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.repeat(self.starts[at] - done[:-1], counts) + np.arange(done[-1])]
        return ids, done[np.concatenate([[0], np.cumsum(n)])]

    def _folded(self, data: np.ndarray) -> np.ndarray:
        """Lower case of ASCII and of the letters of Latin-1; other texts are not plain, whatever becomes of them here."""
        out = data.copy()
        out[(data >= 65) & (data <= 90)] += 32
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        out[second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]] += 32
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The worker process's encoder for this file: its memory of pieces outlives batches and tasks."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def encode_ended(path: str, kind: str, texts: list[str] | list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``Encoder.encode``, with the id ``end`` after each text."""
    ids, bounds = encoder(path, kind).encode(texts)
    out = np.full(len(ids) + len(texts), end, np.uint32)
    n = np.diff(bounds)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), n)] = ids
    return out, bounds + np.arange(len(bounds))


def slices(column, limit: int = 1 << 19):
    """(first row, texts) of an Arrow string column by pieces of about ``limit`` characters; null reads empty."""
    texts, first, size = [], 0, 0
    for i, t in enumerate(column.to_pylist()):
        texts.append(t or "")
        size += len(texts[-1])
        if size >= limit:
            yield first, texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, texts
