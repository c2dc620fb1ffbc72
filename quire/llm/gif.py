"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames.

`decode` reads any GIF87a/89a: global and local palettes, interlacing, graphic control
extensions, and composes each frame on the canvas under the disposal and transparency rules.
`encode_samples` stores bytes losslessly as 8-bit palette indices.

Edge cases: null text is the empty text (one frame of spaces); equal texts give equal files;
texts of any length are stored whole, in frames of at most 192 x 192 samples, so memory is
bounded by a frame and the file; a damaged file raises ValueError in `decode`, as does one whose
frames, or the part of the screen that they cover, have more than MOST_PIXELS pixels, and gives a
null frame plus the error text in `frames`; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import batch_of, per_batch
from quire.runtime import ship

WIDTH = 192
ROWS = 192
DELAY_CS = 10  # hundredths of a second each stored frame is shown
_MAX_CODES = 4096
#: Frames and canvases of more pixels are errors: a few bytes can declare gigabytes.
MOST_PIXELS = 1 << 25


def _widths(first_size: int, clear: int, count: int) -> np.ndarray:
    """Bit widths of the codes that follow a clear code: one table entry is added from the second on."""
    entries = clear + 2 + np.maximum(np.arange(count) - 1, 0)
    w = np.full(count, first_size, np.int64)
    for bits in range(first_size, 12):
        w[entries >= (1 << bits)] = bits + 1
    return w


def _schedule(first_size: int) -> np.ndarray:
    return _widths(first_size, 1 << (first_size - 1), _MAX_CODES + 1)


_SCHEDULES: dict[int, np.ndarray] = {s: _schedule(s) for s in range(3, 10)}


def lzw_encode(data: bytes, min_size: int = 8) -> bytes:
    """The LZW code stream of `data`, whose samples are below 2**min_size; a clear code restarts a full table."""
    clear = 1 << min_size
    plan = _SCHEDULES[min_size + 1]
    codes: list[int] = [clear]
    spans: list[int] = []  # codes of each run that starts with its clear code
    table: dict[int, int] = {}
    get, free = table.get, clear + 2
    out = codes.append
    it = iter(data)
    cur = next(it, None)
    begun = 0
    if cur is not None:
        for b in it:
            key = cur << 8 | b
            nxt = get(key)
            if nxt is not None:
                cur = nxt
                continue
            out(cur)
            if free < _MAX_CODES:
                table[key] = free
                free += 1
            else:
                out(clear)
                spans.append(len(codes) - 1 - begun)
                begun = len(codes) - 1
                table.clear()
                free = clear + 2
            cur = b
        out(cur)
    out(clear + 1)
    spans.append(len(codes) - begun)
    value = np.array(codes, np.int64)
    # A run is its clear code, written at the width in force before it, then codes by the schedule.
    width = np.empty(len(codes), np.int64)
    at, before = 0, min_size + 1
    for n in spans:
        width[at] = before
        width[at + 1 : at + n] = plan[: n - 1]
        before = int(plan[n - 1])
        at += n
    offset = np.cumsum(width) - width
    total = int(offset[-1] + width[-1])
    size = (total + 7) // 8
    shifted = value << (offset & 7)
    byte = offset >> 3
    packed = np.zeros(size + 3)
    for k in range(3):
        packed += np.bincount(byte + k, weights=(shifted >> (8 * k)) & 255, minlength=size + 3)
    return packed[:size].astype(np.uint8).tobytes()


#: The first codes of a run are read one by one: runs of a few codes cost no more than they hold.
_FIRST_CODES = 64


def _run(stream: bytes, bits: np.ndarray, at: int, plan: np.ndarray, clear: int) -> tuple[list[int], int, int]:
    """The codes from a bit on, the clear or end code after them (-1 if the data ends), and the bit behind it."""
    codes: list[int] = []
    total = 8 * len(stream)
    for w in plan[:_FIRST_CODES].tolist():
        if at + w > total:
            return codes, -1, at
        code = int.from_bytes(stream[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & (1 << w) - 1
        at += w
        if code == clear or code == clear + 1:
            return codes, code, at
        codes.append(code)
    width = plan[_FIRST_CODES:]
    rest = total - at - int(width.sum())
    if rest > 0:  # a full table that is never cleared stays at 12 bits
        width = np.concatenate([width, np.full(rest // 12, 12, np.int64)])
    ends = at + np.cumsum(width)
    n = int(np.searchsorted(ends, total, "right"))
    offset = ends[:n] - width[:n]
    byte = offset >> 3
    value = ((bits[byte] | bits[byte + 1] << 8 | bits[byte + 2] << 16) >> (offset & 7)) & ((1 << width[:n]) - 1)
    stops = np.flatnonzero((value == clear) | (value == clear + 1))
    if not len(stops):
        return codes + value.tolist(), -1, total
    return codes + value[: stops[0]].tolist(), int(value[stops[0]]), int(ends[stops[0]])


def lzw_decode(stream: bytes, min_size: int, expected: int) -> bytes:
    """The samples of a code stream; codes are unpacked in runs whose widths are known beforehand."""
    if not 2 <= min_size <= 8:
        raise ValueError(f"LZW minimum code size {min_size}")
    clear = 1 << min_size
    plan = _SCHEDULES[min_size + 1]
    bits = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    have = at = 0
    while True:
        codes, stop, at = _run(stream, bits, at, plan, clear)
        table = roots.copy() if codes else roots
        add, emit = table.append, out.append
        previous = None
        for code in codes:
            try:
                entry = table[code]
            except IndexError:
                if previous is None or code != len(table):
                    raise ValueError("LZW code outside the table") from None
                entry = previous + previous[:1]
            emit(entry)
            have += len(entry)
            if previous is not None and len(table) < _MAX_CODES:
                add(previous + entry[:1])
            previous = entry
            if have >= expected:
                break
        if have >= expected or stop != clear:
            break
    data = b"".join(out)
    if len(data) < expected:
        raise ValueError("LZW stream ends early")
    return data[:expected]


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    start_cs: int
    delay_cs: int
    disposal: int
    transparent: int | None
    indices: np.ndarray  # height x width palette indices
    canvas: np.ndarray  # RGBA after this frame is drawn, as far as the frames reach on the screen


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise ValueError("GIF ends inside a block")
        n = data[at]
        at += 1
        if not n:
            return b"".join(parts), at
        parts.append(data[at : at + n])
        at += n


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    raw = np.frombuffer(data[at : at + 3 * n], np.uint8)
    if len(raw) < 3 * n:
        raise ValueError("GIF palette ends early")
    return raw.reshape(n, 3), at + 3 * n


def _row_order(height: int) -> np.ndarray:
    """Stored row -> screen row of an interlaced image."""
    return np.concatenate([np.arange(s, height, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> Iterator[Frame]:
    """The timed frames of a GIF, one by one; ValueError where the file is damaged."""
    try:
        yield from _frames(data)
    except IndexError:
        raise ValueError("GIF ends early") from None


def _covered(data: bytes, at: int) -> tuple[int, int]:
    """The right and lower edge of all frames, from the block structure alone."""
    right = below = 0
    while at < len(data) and data[at] in (0x21, 0x2C):
        if data[at] == 0x21:
            at += 2
        else:
            left, top, fw, fh = (int.from_bytes(data[at + 1 + i : at + 3 + i], "little") for i in (0, 2, 4, 6))
            if fw * fh > MOST_PIXELS:
                raise ValueError(f"GIF frame of {fw} x {fh} pixels")
            right, below = max(right, left + fw), max(below, top + fh)
            flags = data[at + 9]
            at += 11 + (3 * (2 << (flags & 7)) if flags & 0x80 else 0)
        while at < len(data) and data[at]:
            at += data[at] + 1
        at += 1
    return right, below


def _frames(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("no GIF header")
    w, h, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    common, at = _palette(data, 13, flags)
    right, below = _covered(data, at)
    w, h = min(w, right), min(h, below)
    if w * h > MOST_PIXELS:
        raise ValueError(f"GIF canvas of {w} x {h} pixels")
    canvas = np.zeros((h, w, 4), np.uint8)
    clock, delay, disposal, transparent = 0, 0, 0, None
    while True:
        if at >= len(data):
            raise ValueError("GIF has no trailer")
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            body, at = _blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                transparent = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown GIF block {kind}")
        left, top, fw, fh = (int.from_bytes(data[at + i : at + i + 2], "little") for i in (0, 2, 4, 6))
        own, at = _palette(data, at + 9, local := data[at + 8])
        palette = own if own is not None else common
        if palette is None or not fw or not fh:
            raise ValueError("GIF frame without palette or area")
        stream, end = _blocks(data, at + 1)
        index = np.frombuffer(lzw_decode(stream, data[at], fw * fh), np.uint8).reshape(fh, fw)
        at = end
        if local & 0x40:
            placed = np.empty_like(index)
            placed[_row_order(fh)] = index
            index = placed
        before = canvas.copy() if disposal == 3 else None
        rows, cols = slice(top, min(top + fh, h)), slice(left, min(left + fw, w))
        seen = index[: max(0, min(fh, h - top)), : max(0, min(fw, w - left))]
        colour = np.zeros((256, 4), np.uint8)
        colour[: len(palette), :3] = palette
        colour[:, 3] = 255
        drawn = colour[seen]
        if transparent is None:
            canvas[rows, cols] = drawn
        else:
            keep = seen == transparent
            canvas[rows, cols] = np.where(keep[..., None], canvas[rows, cols], drawn)
        yield Frame(left, top, fw, fh, clock, delay, disposal, transparent, index, canvas.copy())
        clock += delay
        if disposal == 2:
            canvas[rows, cols] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, None


_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def encode_samples(payload: bytes) -> bytes:
    """A GIF whose frames hold `payload`, a multiple of WIDTH samples, row by row in a grey palette."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", WIDTH.to_bytes(2, "little"), min(rows, ROWS).to_bytes(2, "little"), b"\xf7\0\0", _GREY]
    for top in range(0, rows, ROWS):
        part = payload[top * WIDTH : (top + ROWS) * WIDTH]
        out += [b"\x21\xf9\x04\x04", DELAY_CS.to_bytes(2, "little"), b"\0\0"]
        out += [b"\x2c\0\0\0\0", WIDTH.to_bytes(2, "little"), (len(part) // WIDTH).to_bytes(2, "little"), b"\0\x08"]
        stream = lzw_encode(part)
        for i in range(0, len(stream), 255):
            block = stream[i : i + 255]
            out += [bytes([len(block)]), block]
        out.append(b"\0")
    out.append(b"\x3b")
    return b"".join(out)


def payload_of(text: bytes) -> bytes:
    """The bytes padded with spaces to a positive multiple of WIDTH."""
    return text + b" " * (max(1, -(-len(text) // WIDTH)) * WIDTH - len(text))


def histogram(canvas: np.ndarray) -> np.ndarray:
    """64 counts of visible pixels: two leading bits of red, green and blue."""
    seen = canvas[canvas[..., 3] > 0]
    return np.bincount((seen[:, 0] >> 6) * 16 + (seen[:, 1] >> 6) * 4 + (seen[:, 2] >> 6), minlength=64)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, gif binary): every whole text as samples of a GIF."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def make():
        return lambda b: batch_of([(id_col, b.schema.field(0).type), ("gif", pa.binary())], [b.column(0), [encode_samples(payload_of((t or "").encode())) for t in b.column(1).to_pylist()]])

    return src.mapInArrow(per_batch(make), f"`{id_col}` {src.schema['id'].dataType.simpleString()}, gif binary")


def frames(media: DataFrame, id_col: str = "doc_id", gif_col: str = "gif") -> DataFrame:
    """One row per frame: place, time, disposal, transparency, samples and a 64-colour histogram of the canvas.

    A null or damaged file is one row with a null frame and the error.
    """
    ship(media.sparkSession)
    src = media.select(media[id_col].alias("id"), media[gif_col].alias("gif"))
    fields = [("frame", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("disposal", pa.int32()), ("transparent", pa.int32()), ("samples", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())]

    def run(batches):
        for b in batches:
            for key, gif in zip(b.column(0), b.column(1).to_pylist()):
                rows = []
                try:
                    if gif is None:
                        raise ValueError("null file")
                    for i, f in enumerate(decode(gif)):
                        rows.append((i, f.left, f.top, f.width, f.height, f.start_cs, f.delay_cs, f.disposal, f.transparent, f.indices.tobytes(), histogram(f.canvas).tolist(), None))
                except ValueError as e:
                    rows.append((*[None] * 11, str(e)))
                if rows:
                    yield batch_of([(id_col, b.schema.field(0).type), *fields], [pa.array([key.as_py()] * len(rows), b.schema.field(0).type), *map(list, zip(*rows))])

    return src.mapInArrow(run, f"`{id_col}` {src.schema['id'].dataType.simpleString()}, frame int, x int, y int, width int, height int, start_cs bigint, delay_cs int, disposal int, transparent int, samples binary, histogram array<bigint>, error string")


def _digest(text: bytes) -> tuple:
    media = encode_samples(payload_of(text))
    sha, tail, size, hist, n, clock = hashlib.sha256(), b"", 0, np.zeros(64, np.int64), 0, 0
    for f in decode(media):
        part = f.canvas[: f.height, : f.width, 0].tobytes()  # the grey palette maps a sample to itself
        sha.update(part)
        size += len(part)
        tail = (tail + part)[-16:]
        hist += histogram(f.canvas[: f.height, : f.width])
        n, clock = n + 1, f.start_cs + f.delay_cs
    feature = f"frames={n};cs={clock};hist=" + ",".join(f"{i}:{c}" for i, c in enumerate(hist.tolist()) if c)
    return len(text), size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), files not kept."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def make():
        def each(b):
            rows = [_digest((t or "").encode()) for t in b.column(1).to_pylist()]
            return batch_of([(id_col, b.schema.field(0).type), *fields], [b.column(0), *(map(list, zip(*rows)) if rows else [[] for _ in fields])])

        return each

    return src.mapInArrow(per_batch(make), f"`{id_col}` {src.schema['id'].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
