"""Pictures as arrays, and their perceptual hashes, with numpy and zlib only.

PNG (8 bits and fewer, not interlaced), BMP (8, 24 and 32 bits, not compressed) and TIFF (8 bits, strips, not compressed or deflated) are decoded
here; other formats need a decoder that may be installed (`decoders.with_phash`).

The hash is that of a picture's low frequencies: grey levels, resized to 32 x 32 by a Lanczos filter in fixed-point arithmetic, an orthogonal cosine
transform (two matrix products over a whole batch of pictures), and of its first 8 x 8 coefficients which are larger than
their median, row by row, as 16 hexadecimal digits. Coefficients are rounded to 10^-6, so that those that are zero by the definition
don't depend on the order of sums: an even picture is `8000000000000000`.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

from photolith.sources.embedded import Broken, Ranges, Tiff

SIDE, LOW = 32, 8
#: Fixed value: the most pixels that are decoded.
MOST_PIXELS = 178_956_970
#: Weights of red, green and blue in a grey level, and the bits of the resizing filter's weights.
GREY = (19595, 38470, 7471)
BITS = 22


def _unfiltered(raw: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """PNG's rows (height, width, channels) without their filters.

    A byte depends on those to the left and above, so the picture is gone through by diagonals, each over all rows at once.
    """
    height, width, channels = raw.shape
    out = np.zeros((height + 1, width + 1, channels), dtype=np.int16)
    for step in range(width + height - 1):
        y = np.arange(max(0, step - width + 1), min(height - 1, step) + 1)
        x = step - y
        left, above, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = left + above - corner
        far = [np.abs(guess - v) for v in (left, above, corner)]
        paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, corner))
        kind = kinds[y][:, None]
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, above, (left + above) // 2, paeth], 0)
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def _inflated(parts: list[bytes], size: int) -> bytes:
    found = zlib.decompressobj()
    out = found.decompress(b"".join(parts), size)
    if len(out) != size:
        raise Broken
    return out


def of_png(data: bytes) -> np.ndarray:
    at, parts, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) != size:
            raise Broken
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise Broken
    width, height, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if not channels or interlaced or depth > 8 or depth < 8 and channels > 1 or not 0 < width * height <= MOST_PIXELS:
        raise Broken
    row = (width * channels * depth + 7) // 8
    lines = np.frombuffer(_inflated(parts, height * (row + 1)), dtype=np.uint8).reshape(height, row + 1)
    if depth == 8:
        pixels = _unfiltered(lines[:, 1:].reshape(height, width, channels), lines[:, 0])
    else:
        packed = _unfiltered(lines[:, 1:].reshape(height, row, 1), lines[:, 0])[:, :, 0]
        bits = np.unpackbits(packed, axis=1).reshape(height, -1, depth)
        pixels = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2)[:, :width, None]
        pixels = pixels.astype(np.uint8) if colour == 3 else (pixels * 255 // ((1 << depth) - 1)).astype(np.uint8)
    if colour == 3:
        if palette is None or pixels.max(initial=0) >= len(palette):
            raise Broken
        return palette[pixels[:, :, 0]]
    return pixels[:, :, : 1 if channels < 3 else 3]


def of_bmp(data: bytes) -> np.ndarray:
    start, size, width, height, _, depth, packed = struct.unpack_from("<I I i i H H I", data, 10)
    if size < 40 or packed or depth not in (8, 24, 32) or width <= 0 or not 0 < width * abs(height) <= MOST_PIXELS:
        raise Broken
    row = (width * depth // 8 + 3) // 4 * 4
    body = np.frombuffer(data, dtype=np.uint8, count=row * abs(height), offset=start).reshape(abs(height), row)
    pixels = body[:, : width * depth // 8].reshape(abs(height), width, depth // 8)
    pixels = pixels if height < 0 else pixels[::-1]
    if depth == 8:
        (used,) = struct.unpack_from("<I", data, 46)
        palette = np.frombuffer(data, dtype=np.uint8, count=4 * (used or 256), offset=14 + size).reshape(-1, 4)
        if pixels.max() >= len(palette):
            raise Broken
        pixels = palette[pixels[:, :, 0]]
    return pixels[:, :, 2::-1]


def of_tiff(data: bytes) -> np.ndarray:
    import io

    tiff = Tiff(Ranges(io.BytesIO(data), 0, len(data)))
    own, _ = tiff.directory(tiff.first)
    one = lambda tag, other=0: (tiff.whole(own, tag) or [other])[0]
    width, height, packed, photo, channels, strip = one(256), one(257), one(259, 1), one(262, 1), one(277, 1), one(278)
    if (
        set(tiff.whole(own, 258)) != {8} or packed not in (1, 8, 32946) or photo not in (0, 1, 2) or one(284, 1) != 1 or one(317, 1) != 1
        or channels not in (1, 2, 3, 4) or not 0 < width * height <= MOST_PIXELS
    ):
        raise Broken
    rows, lines = [], strip or height
    for at, n in zip(tiff.whole(own, 273), tiff.whole(own, 279), strict=True):
        size = width * channels * min(lines, height - lines * len(rows))
        raw = data[at : at + n]
        raw = raw if packed == 1 else _inflated([raw], size)
        if len(raw) < size or size <= 0:
            raise Broken
        rows.append(raw[:size])
    pixels = np.frombuffer(b"".join(rows), dtype=np.uint8)
    if len(pixels) != width * height * channels:
        raise Broken
    pixels = pixels.reshape(height, width, channels)[:, :, : 1 if channels < 3 else 3]
    return 255 - pixels if photo == 0 else pixels


def decoded(data: bytes) -> np.ndarray | None:
    """A picture's grey or red, green and blue levels (height, width, 1 or 3); None where it can't be decoded here."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return of_png(data)
        if data[:2] == b"BM":
            return of_bmp(data)
        if data[:4] in (b"II*\0", b"MM\0*"):
            return of_tiff(data)
    except (Broken, ValueError, struct.error, zlib.error):
        return None
    return None


def grey(pixels: np.ndarray) -> np.ndarray:
    """The grey level of each pixel, rounded."""
    if pixels.shape[2] == 1:
        return pixels[:, :, 0]
    return ((pixels.astype(np.int64) @ np.array(GREY) + 0x8000) >> 16).astype(np.uint8)


def weights(size: int, to: int) -> np.ndarray:
    """The Lanczos filter's fixed-point weights (to, size) of `size` levels in each of `to`."""
    scale = size / to
    wide = max(scale, 1.0)
    out = np.zeros((to, size), dtype=np.int64)
    for i in range(to):
        middle = (i + 0.5) * scale
        first, last = max(0, int(middle - 3 * wide + 0.5)), min(size, int(middle + 3 * wide + 0.5))
        x = (np.arange(first, last) - middle + 0.5) / wide
        w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        w = w / w.sum() * (1 << BITS)
        out[i, first:last] = np.trunc(w + np.where(w < 0, -0.5, 0.5)).astype(np.int64)
    return out


def resized(levels: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Grey levels (height, width) resized to a square, the width first, each pass rounded to whole levels."""
    out = levels.astype(np.int64)
    for _ in range(2):
        if out.shape[1] != side:
            out = np.clip((out @ weights(out.shape[1], side).T + (1 << BITS - 1)) >> BITS, 0, 255)
        out = out.T
    return out


def cosines(side: int = SIDE, low: int = LOW) -> np.ndarray:
    """The first `low` rows of the cosine transform's matrix."""
    x, u = np.arange(side), np.arange(low)
    return 2 * np.cos(math.pi * u[:, None] * (2 * x + 1) / (2 * side))


def hashes(squares: np.ndarray) -> list[str]:
    """The hashes of pictures (n, 32, 32)."""
    if not len(squares):
        return []
    turn = cosines()
    found = np.round(turn @ squares.astype(np.float64) @ turn.T, 6).reshape(len(squares), -1)
    bits = found > np.median(found, axis=1, keepdims=True)
    return [b.tobytes().hex() for b in np.packbits(bits, axis=1)]


def square(data: bytes) -> np.ndarray | None:
    """The 32 x 32 grey levels of an encoded picture, or None."""
    pixels = decoded(data)
    return None if pixels is None else resized(grey(pixels))
