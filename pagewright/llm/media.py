"""Media columns: AVI files of motion-JPEG frames, written from bytes without loss, indexed, decoded and cut at shots.

Bytes become quantised DCT coefficients, the unit that JPEG keeps exactly: with Huffman codes of one bit for
"run 0, size 8", the 8 bits after a code are the byte itself. A block holds 63 bytes (its DC stays 0), and a full one
takes 71 bytes of scan.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64  # payloads are padded to a multiple of this
SIDE = 8  # blocks across and down a frame
BLOCKS = SIDE * SIDE
AC = 63
FULL = 71  # bytes of a full block's code: (1 + 63 * 9) / 8
FPS = 25
BINS = 32
#: A frame begins a shot if its histogram differs from the last one's by over FLOOR, and by over the mean of the
#: differences around it and SPREAD times their deviation.
WINDOW, SPREAD, FLOOR = 8, 2.0, 0.08


def _zigzag() -> list[tuple[int, int]]:
    """(row, column) of the coefficients in order: along the diagonals, turning at each end."""
    return sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))


def _basis() -> np.ndarray:
    """64 coefficients in zigzag order to 64 samples by row."""
    x = np.arange(8)
    one = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, 1 / np.sqrt(2), 1)[None, :] / 2
    return np.stack([np.outer(one[:, r], one[:, c]).ravel() for r, c in _zigzag()])


BASIS = _basis()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, codes: dict[int, int]) -> bytes:
    """A Huffman table with one symbol for each length named."""
    return bytes([kind, *(int(n in codes) for n in range(1, 17)), *(codes[n] for n in sorted(codes))])


HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0]) + bytes([1]) * 64)
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * SIDE, 8 * SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, _table(0x00, {1: 0x00}) + _table(0x10, {1: 0x08, 2: 0x00}))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)


def _frames(payload: bytes) -> list[bytes]:
    data = np.frombuffer(payload, np.uint8)
    n = len(data) // AC
    bits = np.zeros((n, FULL * 8), np.uint8)
    bits[:, 1:].reshape(n, AC, 9)[:, :, 1:] = np.unpackbits(data[: n * AC]).reshape(n, AC, 8)
    full = np.packbits(bits, axis=1)
    rest = data[n * AC :]
    total = n + bool(len(rest))
    out = []
    for at in range(0, total, BLOCKS):
        scan = full[at : at + BLOCKS].tobytes()
        here = min(n - at, BLOCKS)
        if here < BLOCKS:
            tail = []
            if at + here < total:
                part = np.zeros(1 + len(rest) * 9 + 2, np.uint8)
                part[1:-2].reshape(-1, 9)[:, 1:] = np.unpackbits(rest).reshape(-1, 8)
                part[-2] = 1
                tail.append(part)
                here += 1
            tail.append(np.tile(np.array([0, 1, 0], np.uint8), BLOCKS - here))
            tail = np.concatenate(tail)
            scan += np.packbits(np.concatenate([tail, np.ones(-len(tail) % 8, np.uint8)])).tobytes()
        out.append(HEADER + scan.replace(b"\xff", b"\xff\x00") + b"\xff\xd9")
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode(payload: bytes, fps: int = FPS) -> bytes:
    """An AVI file whose frames hold ``payload``: RIFF headers, one motion-JPEG stream, and an index."""
    frames = _frames(payload)
    most, w = max(map(len, frames), default=0), 8 * SIDE
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, w, w, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, w, w)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, w, 1, 24, b"MJPG", w * w * 3, 0, 0, 0, 0)
    streams = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + len(f) % 2
    body = (
        b"AVI "
        + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + streams)
        + _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames))
        + _chunk(b"idx1", b"".join(index))
    )
    return b"RIFF" + struct.pack("<I", len(body)) + body


def index(media: bytes) -> tuple[float, list[tuple[int, int]]]:
    """(microseconds a frame, (offset, size) of each video frame) by the file's index; without one, by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    step, movi, entries = 0.0, 0, None
    todo = [(12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]))]
    chunks = []
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", media, at)
            inside = at + 8
            if name == b"LIST":
                kind = media[inside : inside + 4]
                movi = inside if kind == b"movi" else movi
                todo.append((inside + 4, min(inside + size, end)))
            elif name == b"avih":
                step = float(struct.unpack_from("<I", media, inside)[0])
            elif name == b"idx1":
                entries = [struct.unpack_from("<4sIII", media, inside + k) for k in range(0, size - 15, 16)]
            elif name[2:] in (b"dc", b"db"):
                chunks.append((inside, size))
            at = inside + size + size % 2
    if entries is None:
        return step, sorted(chunks)
    video = [(at, size) for name, _, at, size in entries if name[2:] in (b"dc", b"db")]
    base = movi if video and media[movi + video[0][0] + 2 : movi + video[0][0] + 4] in (b"dc", b"db") else 0
    return step, [(base + at + 8, size) for at, size in video]


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class Frame:
    """A baseline JPEG frame: ``coefficients`` of the first component (blocks x 64, zigzag, before dequantising), in
    raster order of its blocks, ``used``: the last AC coefficient a block sets, and its size. Frames must carry their Huffman tables."""

    def __init__(self, raw: bytes) -> None:
        at, quant, huff, restart = 2, {}, {}, 0
        while True:
            marker, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
            body = raw[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int64)
                    k += 65 + 64 * bool(wide)
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    counts = body[k + 1 : k + 17]
                    huff[body[k]] = _codes(counts, body[k + 17 : k + 17 + sum(counts)])
                    k += 17 + sum(counts)
            elif marker == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif marker in (0xC0, 0xC1):
                self.height, self.width = struct.unpack_from(">HH", body, 1)
                parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
            elif 0xC2 <= marker <= 0xCF:
                raise ValueError("not a baseline frame")
            elif marker == 0xDA:
                order = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
                break
        scan = raw[at : raw.rindex(b"\xff\xd9")]
        self.quant = quant[parts[order[0][0]][2]]
        own = raw[:at] == HEADER
        self.coefficients = self._plain(scan) if own else self._coded(scan, parts, order, huff, restart)

    def _plain(self, scan: bytes) -> np.ndarray:
        """Our own frames: full blocks at once, then the last one's bits."""
        data = np.frombuffer(scan.replace(b"\xff\x00", b"\xff"), np.uint8)
        rows = data[: len(data) // FULL * FULL].reshape(-1, FULL)[:BLOCKS]
        bits = np.unpackbits(rows, axis=1)
        broken = np.flatnonzero(bits[:, ::9][:, :1].any(1) | bits[:, 1:].reshape(len(rows), AC, 9)[:, :, 0].any(1))
        n = int(broken[0]) if len(broken) else len(rows)
        out = np.zeros((BLOCKS, 64), np.int64)
        values = np.packbits(bits[:n, 1:].reshape(n, AC, 9)[:, :, 1:], axis=2).reshape(n, AC).astype(np.int64)
        out[:n, 1:] = np.where(values < 128, values - 255, values)
        self.used = np.zeros(BLOCKS, np.int64)
        self.used[:n] = AC
        if n < BLOCKS:
            rest = np.unpackbits(data[n * FULL : (n + 1) * FULL])
            flags = np.flatnonzero(rest[1::9])
            k = int(flags[0])
            values = np.packbits(rest[1 : 1 + 9 * k].reshape(k, 9)[:, 1:], axis=1).ravel().astype(np.int64)
            out[n, 1 : k + 1] = np.where(values < 128, values - 255, values)
            self.used[n] = k
        return out

    def _coded(self, scan: bytes, parts: dict, order: list, huff: dict, restart: int) -> np.ndarray:
        """Any baseline frame, bit by bit."""
        top = max(h for h, _, _ in parts.values()), max(v for _, v, _ in parts.values())
        across, down = -(-self.width // (8 * top[0])), -(-self.height // (8 * top[1]))
        if len(order) == 1:  # a scan of one component has its blocks, not whole units
            h, v, q = parts[order[0][0]]
            across = -(-(-(-self.width * h // top[0])) // 8)
            down = -(-(-(-self.height * v // top[1])) // 8)
            parts = {order[0][0]: (1, 1, q)}
        h0, v0, _ = parts[order[0][0]]
        out = np.zeros((down * v0, across * h0, 64), np.int64)
        used = np.zeros(out.shape[:2], np.int64)
        pieces, at = [], 0
        for k in range(len(scan) - 1):
            if scan[k] == 0xFF and 0xD0 <= scan[k + 1] <= 0xD7:
                pieces.append(scan[at:k])
                at = k + 2
        pieces.append(scan[at:])
        bits = iter(())

        def take(n: int) -> int:
            value = 0
            for _ in range(n):
                value = value << 1 | next(bits)
            return value

        def symbol(table: dict) -> int:
            code = 0
            for n in range(1, 17):
                code = code << 1 | next(bits)
                if (n, code) in table:
                    return table[n, code]
            raise ValueError("broken Huffman code")

        def number(size: int) -> int:
            value = take(size)
            return value if not size or value >> (size - 1) else value - (1 << size) + 1

        before: dict[int, int] = {}
        for unit in range(across * down):
            if unit % restart == 0 if restart else unit == 0:
                piece = np.frombuffer(pieces[unit // restart if restart else 0].replace(b"\xff\x00", b"\xff"), np.uint8)
                bits = iter(np.unpackbits(piece).tolist())
                before = {}
            for k, (part, tables) in enumerate(order):
                h, v, _ = parts[part]
                for b in range(h * v):
                    block = np.zeros(64, np.int64)
                    before[part] = before.get(part, 0) + number(symbol(huff[tables >> 4]))
                    block[0], i, last = before[part], 1, 0
                    while i < 64:
                        s = symbol(huff[16 | (tables & 15)])
                        if s == 0:
                            break
                        i += s >> 4
                        if s & 15:
                            block[i], last = number(s & 15), i
                        i += 1
                    if k == 0:
                        place = unit // across * v + b // h, unit % across * h + b % h
                        out[place], used[place] = block, last
        self.used = used.ravel()
        return out.reshape(-1, 64)

    def samples(self) -> np.ndarray:
        """8-bit samples of each block: dequantised, transformed, rounded."""
        return np.clip(np.rint((self.coefficients * self.quant) @ BASIS + 128), 0, 255).astype(np.uint8)


def shots(histograms: np.ndarray) -> list[int]:
    """Frames that begin a shot, the first included: histogram differences against an adaptive threshold."""
    if not len(histograms):
        return []
    d = np.abs(np.diff(histograms, axis=0)).sum(1) / 2
    found = [0]
    for i in range(len(d)):
        near = np.delete(d[max(0, i - WINDOW) : i + WINDOW + 1], min(i, WINDOW))
        limit = near.mean() + SPREAD * near.std() if len(near) else 0.0
        if d[i] > max(FLOOR, limit):
            found.append(i + 1)
    return found


def decode(media: bytes) -> tuple[float, list[Frame]]:
    step, places = index(media)
    return step, [Frame(media[at : at + size]) for at, size in places]


def payload(frames: list[Frame]) -> bytes:
    """The bytes that our own frames hold."""
    out = []
    for f in frames:
        values = f.coefficients[:, 1:]
        flat = np.where(values < 0, values + 255, values).astype(np.uint8)
        out.append(flat[np.arange(AC) < f.used[:, None]].tobytes())
    return b"".join(out)


def histograms(frames: list[Frame]) -> np.ndarray:
    if not frames:
        return np.zeros((0, BINS))
    return np.stack([np.bincount(s.ravel() >> 3, minlength=BINS) / s.size for s in (f.samples() for f in frames)])


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for each row: the text's UTF-8 bytes and zeros up to a positive multiple of UNIT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            media = [encode(r + b"\0" * (-len(r) % UNIT if r else UNIT)) for r in raw]
            yield pa.record_batch([b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


CLIPS = "array<struct<clip: int, first_frame: int, frames: int, start_ms: double, end_ms: double>>"


def read(stored: DataFrame) -> DataFrame:
    """What is read back from (doc_id, n_bytes, media): payload and media digests, clips and a feature string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for media in b.column(2).to_pylist():
                step, frames = decode(media)
                data, h = payload(frames), histograms(frames)
                begins = shots(h)
                ends = [*begins[1:], len(frames)]
                clips = [{"clip": i, "first_frame": x, "frames": y - x, "start_ms": x * step / 1000, "end_ms": y * step / 1000} for i, (x, y) in enumerate(zip(begins, ends, strict=True))]
                mean = (h.mean(0) * (np.arange(BINS) * 8 + 4)).sum() if len(h) else 0.0
                dark, light = (h[:, 0].mean(), h[:, -1].mean()) if len(h) else (0.0, 0.0)
                feature = f"frames={len(frames)};shots={len(begins)};mean={mean:.3f};dark={dark:.4f};light={light:.4f};cuts={','.join(map(str, begins[1:]))}"
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, clips))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            clip = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_ms", pa.float64()), ("end_ms", pa.float64())]))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), clip]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, clips {CLIPS}"
    )


def clips(stored: DataFrame) -> DataFrame:
    """Timed clip rows: doc_id, clip, first_frame, frames, start_ms, end_ms."""
    return read(stored).select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")


def digest(docs: DataFrame) -> DataFrame:
    """Store each text as media, read it back, and report it: one row for each row of ``docs`` (doc_id, text), with its
    timed clips as a list; ``clips`` gives them as rows.

    Null text: empty, stored as 64 zero bytes. Null ids and repeated rows each give a row; equal texts give equal
    values; other columns are not looked at; an empty table gives no rows.
    """
    return read(store(docs))
