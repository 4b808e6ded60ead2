"""GIF columns: LZW code streams, palettes, timed frames with disposal and transparency, colour histograms.

``encode_bytes`` stores any bytes losslessly as 8-bit samples: 64 to a row, as many rows to a
frame as ``ROWS``, and as many timed frames as that takes. ``decode_gif`` reads any GIF: global
and local palettes, interlacing, transparent colours and all disposals.

Defined results: a null or empty text is one row of zero bytes; a text of any length is stored whole, in as many frames as it
takes; a stream that breaks off gives
the samples it had and zeros after them; bytes that aren't a GIF have no frames, and one that is broken between frames (cut
short, a code size out of 2 to 8, an unknown block) has those before; a canvas or image of more than
``MAX_PIXELS`` is refused by ``TooLarge``, which ``frames`` reports as the gif's only row and ``digests`` in its own; repeated rows
get a row each and equal texts equal values, so there are no ties; an empty table gives an empty table; other columns
aren't read.
"""

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from tallyforge.llm.common import over_batches

ROW = 64
ROWS = 1024
#: Hundredths of a second that a frame is shown.
DELAY = 4
#: Bins of each colour's histogram.
BINS = 16
COLOURS = ("red", "green", "blue")
#: The largest canvas or image that is decoded, four bytes a pixel.
MAX_PIXELS = 1 << 26
#: Bytes of texts after which a batch of gifs is passed on.
BATCH_BYTES = 4 << 20
_FULL = 4096
#: For images without a palette.
_GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
_GREY[:, 3] = 255
#: Width of the j-th code after a clear code, and its first bit. A decoder has 257 + j entries before it reads it.
_N = 1 << 14
_WIDTH = np.minimum(12, np.maximum(9, [(257 + j).bit_length() for j in range(_N)])).astype(np.int64)


def _widths(bits: int, n: int) -> np.ndarray:
    """Widths of the first n codes after a clear code, for samples of ``bits`` bits."""
    if bits == 8 and n <= _N:
        return _WIDTH[:n]
    at = (1 << bits) + 1 + np.arange(n)
    return np.clip(np.floor(np.log2(np.maximum(at, 1))).astype(np.int64) + 1, bits + 1, 12)


def lzw_encode(samples: bytes) -> bytes:
    """The code stream of 8-bit samples: a new table whenever the old one is full."""
    codes, clears = [256], [0]
    table: dict[int, int] = {}
    get, add, entry = table.get, codes.append, 258
    rest = iter(samples)
    w = next(rest, -1)
    for c in rest:
        if (known := get(key := w << 8 | c)) is not None:
            w = known
            continue
        add(w)
        if entry < _FULL:
            table[key] = entry
            entry += 1
        else:
            clears.append(len(codes))
            add(256)
            table.clear()
            entry = 258
        w = c
    if w >= 0:
        add(w)
    add(257)
    values = np.array(codes, np.int64)
    # a clear code is read at the width that the table before it has reached
    since = np.arange(len(values)) - np.repeat(np.array(clears) + 1, np.diff([*clears, len(values)]))
    since[np.array(clears[1:], np.int64)] = np.diff(clears) - 1
    since[0] = 0
    width = _WIDTH[since]
    at = np.r_[0, np.cumsum(width)]
    shifted = values << (at[:-1] & 7)
    size = int(at[-1] + 7) >> 3
    out = np.zeros(size + 2)
    for k in range(3):
        out += np.bincount((at[:-1] >> 3) + k, weights=(shifted >> (8 * k)) & 255, minlength=size + 2)[: size + 2]
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, bits: int, limit: int) -> bytes:
    """The samples of a code stream, ``limit`` at most."""
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int32)
    clear, end = 1 << bits, (1 << bits) + 1
    single = [bytes([i]) for i in range(clear)]
    out, size, bit, total = [], 0, 0, 8 * len(stream)
    table, prev, read = [*single, b"", b""], b"", 0
    while bit < total and size < limit:
        n = min(4096, (total - bit) // (bits + 1) + 1)
        width = _widths(bits, read + n)[read:]
        at = bit + np.r_[0, np.cumsum(width)]
        n = int(np.searchsorted(at[1:], total, "right"))
        at, width = at[: n + 1], width[:n]
        if not n:
            break
        byte = at[:-1] >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (at[:-1] & 7)) & ((1 << width) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        upto = int(stop[0]) if len(stop) else n
        told, strings = codes[:upto].tolist(), []
        add, grow, at_first = strings.append, table.append, 0
        if told and not prev:  # the first code after a clear code adds no entry
            if told[0] >= clear:
                return b"".join(out)[:limit]  # a broken stream
            add(prev := table[told[0]])
            at_first = 1
        growing = min(len(told), at_first + max(0, _FULL - len(table)))
        for code in told[at_first:growing]:
            try:
                own = table[code]
            except IndexError:
                if code > len(table):
                    return b"".join([*out, *strings])[:limit]
                own = prev + prev[:1]
            add(own)
            grow(prev + own[:1])
            prev = own
        if growing < len(told):  # a full table
            strings += map(table.__getitem__, told[growing:])
            prev = strings[-1]
        out.append(b"".join(strings))
        size += len(out[-1])
        if not len(stop):
            bit, read = int(at[n]), read + n
        elif codes[upto] == end:
            break
        else:
            bit, read, table, prev = int(at[upto + 1]), 0, [*single, b"", b""], b""
    return b"".join(out)[:limit]


def _blocks(data: bytes) -> bytes:
    n = len(data)
    return b"".join(bytes([min(255, n - i)]) + data[i : i + 255] for i in range(0, n, 255)) + b"\0"


def encode_bytes(payload: bytes, delay: int = DELAY) -> bytes:
    """A GIF whose samples are the payload, a positive multiple of 64 bytes; the palette is grey."""
    rows = len(payload) // ROW
    grey = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))
    out = [b"GIF89a", struct.pack("<HHBBB", ROW, min(rows, ROWS), 0xF7, 0, 0), grey]
    for top in range(0, rows, ROWS):
        part = payload[top * ROW : (top + ROWS) * ROW]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, ROW, len(part) // ROW, 0) + b"\x08" + _blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


class TooLarge(ValueError):
    """A canvas or image of more than MAX_PIXELS."""


def _bounded(width: int, height: int) -> None:
    if width * height > MAX_PIXELS:
        raise TooLarge(f"{width} x {height} pixels")


def decode_gif(data: bytes):
    """Yields (samples, red-green-blue-alpha canvas as shown, delay in hundredths of a second, disposal) of each frame."""
    for samples, canvas, delay, disposal, _ in _decoded(data):
        yield samples, canvas.copy(), delay, disposal


def _decoded(data: bytes):
    """The frames of ``decode_gif`` with their histograms; the canvas is the next frame's too. Opaque frames of the whole canvas are counted by palette index."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, palette = 13, None

    def colours(flags: int, at: int):
        n = 2 << (flags & 7)
        own = np.full((256, 4), (0, 0, 0, 255), np.uint8)
        got = np.frombuffer(data[at : at + 3 * n], np.uint8)
        own[: len(got) // 3, :3] = got[: len(got) // 3 * 3].reshape(-1, 3)
        return own, at + 3 * n

    def blocks(at: int):
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    if flags & 0x80:
        palette, at = colours(flags, at)
    _bounded(width, height)
    canvas = np.zeros((height, width, 4), np.uint8)
    disposal = delay = 0
    clear = None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            body, after = blocks(at + 2)
            if data[at + 1 : at + 2] == b"\xf9" and len(body) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear = packed >> 2 & 7, index if packed & 1 else None
            at = after
            continue
        if data[at] != 0x2C or at + 11 > len(data):
            return
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        own, at = colours(flags, at) if flags & 0x80 else (palette, at)
        bits = data[at] if at < len(data) else 0
        if not 2 <= bits <= 8:
            return
        _bounded(w, h)
        stream, at = blocks(at + 1)
        samples = lzw_decode(stream, bits, w * h).ljust(w * h, b"\0")
        image = np.frombuffer(samples, np.uint8).reshape(h, w)
        if flags & 0x40:
            rows = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            image = image[np.argsort(rows)]
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        image = image[: area.shape[0], : area.shape[1]]
        colour = (own if own is not None else _GREY)[image]
        if clear is None:
            area[:] = colour
        else:
            area[image != clear] = colour[image != clear]
        if clear is None and image.shape == canvas.shape[:2] and not (left or top):
            bins = _by_palette(image, own if own is not None else _GREY)
        else:
            bins = histogram(canvas)
        yield samples, canvas, delay, disposal, bins
        if disposal == 2:
            canvas[top : top + h, left : left + w] = 0
        elif disposal == 3:
            canvas = before
        disposal = delay = 0
        clear = None


def histogram(canvas: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Counts of visible pixels by their red, green and blue, a row each."""
    flat = canvas.reshape(-1, 4)
    seen = flat if (flat[:, 3] > 0).all() else flat[flat[:, 3] > 0]
    if bins == 16:
        return np.stack([np.bincount(seen[:, i] >> 4, minlength=bins) for i in range(3)])
    return np.stack([np.bincount(seen[:, i].astype(np.int64) * bins >> 8, minlength=bins) for i in range(3)])


def _by_palette(image: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """``histogram`` of an opaque image of palette indices: indices are counted once, colours by index."""
    uses = np.bincount(image.reshape(-1), minlength=256)
    return np.stack([np.bincount(palette[:, i] >> 4, weights=uses, minlength=BINS) for i in range(3)]).astype(np.int64)


def _named(bins: np.ndarray) -> str:
    return ";".join(",".join(map(str, own)) for own in bins.tolist())


FRAMES = {"id": "bigint", "frame": "int", "delay_cs": "int", "disposal": "int", "width": "int", "height": "int", "rgba": "binary", **dict.fromkeys(COLOURS, "array<bigint>"), "error": "string"}


def frames(media: DataFrame) -> DataFrame:
    """Every frame as shown of ``media`` (id, gif), with its time, disposal and colour histograms; null gives no frame."""

    def fn(c):
        for i, gif in zip(c["id"], c["gif"], strict=True):
            try:
                for k, (_, canvas, delay, disposal, bins) in enumerate(_decoded(gif or b"")):
                    row = (i, k, delay, disposal, canvas.shape[1], canvas.shape[0], canvas.tobytes(), *bins.tolist(), None)
                    yield {n: [v] for n, v in zip(FRAMES, row, strict=True)}
            except TooLarge as e:
                yield {n: [None] for n in FRAMES} | {"id": [i], "error": [str(e)]}

    return over_batches(media.select("id", "gif"), FRAMES, fn)


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b"\0")


def texts_as_gifs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, n_bytes and gif, the text's bytes as samples."""

    def fn(c):
        out, held = {"doc_id": [], "n_bytes": [], "gif": []}, 0
        for doc, text in zip(c["doc_id"], c["text"], strict=True):
            n, payload = payload_of(text)
            for name, v in zip(out, (doc, n, encode_bytes(payload)), strict=True):
                out[name].append(v)
            held += n
            if held > BATCH_BYTES:
                yield out
                out, held = {k: [] for k in out}, 0
        yield out

    return over_batches(docs.select("doc_id", "text"), {"doc_id": "bigint", "n_bytes": "bigint", "gif": "binary"}, fn)


DIGEST = {
    "doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint",
    "media_bytes": "bigint", "media_sha256": "string", "feature": "string", "n_frames": "int", "duration_cs": "bigint",
    "frame_features": "string", "error": "string",
}


def digests(gifs: DataFrame) -> DataFrame:
    """What the stored gifs hold, read back: the samples' digests, how long their frames show, and the sums of the frames' colour histograms as feature.

    ``frame_features`` has each frame's time and histogram, ``delay:red;green;blue`` joined by ``|``, in order of the frames.
    """

    def fn(c):
        rows = []
        for doc, n, gif in zip(c["doc_id"], c["n_bytes"], c["gif"], strict=True):
            gif, error = gif or b"", None
            sha, tail, size, bins, shown, time = hashlib.sha256(), b"", 0, np.zeros((3, BINS), np.int64), [], 0
            try:
                for samples, _, delay, _, own in _decoded(gif):
                    sha.update(samples)
                    tail = (tail + samples)[-64:]
                    size += len(samples)
                    bins += own
                    shown.append(f"{delay}:{_named(own)}")
                    time += delay
            except TooLarge as e:
                error = str(e)
            rows.append((doc, n, size, sha.hexdigest(), zlib.crc32(tail), len(gif), hashlib.sha256(gif).hexdigest(), _named(bins), len(shown), time, "|".join(shown), error))
        return {name: [r[i] for r in rows] for i, name in enumerate(DIGEST)}

    return over_batches(gifs.select("doc_id", "n_bytes", "gif"), DIGEST, fn)
