"""Small encoded pictures and movies with known metadata, for queries and tests that have none: only headers, and no picture behind most of them."""

from __future__ import annotations

import struct
import zlib
from datetime import datetime

import numpy as np

EPOCH = datetime(1904, 1, 1)


def _directory(order: str, at: int, entries: list[tuple[int, int, int, bytes]]) -> bytes:
    """A TIFF directory that begins at `at`, with the values that don't fit its entries behind it."""
    behind = at + 2 + 12 * len(entries) + 4
    out, rest = struct.pack(f"{order}H", len(entries)), b""
    for tag, kind, count, value in entries:
        if len(value) > 4:
            place = struct.pack(f"{order}I", behind + len(rest))
            rest += value + b"\0" * (len(value) % 2)
        else:
            place = value.ljust(4, b"\0")
        out += struct.pack(f"{order}HHI", tag, kind, count) + place
    return out + struct.pack(f"{order}I", 0) + rest


def _angle(order: str, degrees: float) -> bytes:
    whole = int(abs(degrees))
    return struct.pack(f"{order}6I", whole, 1, round((abs(degrees) - whole) * 60_000), 1000, 0, 1)


def tiff(order: str = "<", date: str | None = None, size: tuple[int, int] | None = None, place: tuple[float, float] | None = None, cyclic: bool = False, more: list = ()) -> bytes:
    """A TIFF structure; cyclic: what should be its Exif directory is itself."""
    whole = lambda tag, value: (tag, 4, 1, struct.pack(f"{order}I", value))
    base = [whole(0x100, size[0]), whole(0x101, size[1])] if size else []
    base += list(more)
    pointers = [0x8769] * (date is not None) + [0x8825] * (place is not None)
    exif = [(0x9003, 2, 20, date.encode().ljust(20, b"\0")[:20])] if date is not None else []
    gps = []
    if place is not None:
        ref = lambda negative, letters: letters[negative].encode() + b"\0"
        gps = [(1, 2, 2, ref(place[0] < 0, "NS")), (2, 5, 3, _angle(order, place[0])), (3, 2, 2, ref(place[1] < 0, "EW")), (4, 5, 3, _angle(order, place[1]))]
    start = 8 + len(_directory(order, 8, base + [whole(p, 0) for p in pointers]))
    at, inner, targets = start, b"", []
    for pointer, entries in ((0x8769, exif), (0x8825, gps)):
        if pointer in pointers:
            targets.append(whole(pointer, 8 if cyclic and pointer == 0x8769 else at))
            part = _directory(order, at, entries)
            inner, at = inner + part, at + len(part)
    mark = b"II" if order == "<" else b"MM"
    return mark + struct.pack(f"{order}HI", 42, 8) + _directory(order, 8, base + targets) + inner


def jpeg(structure: bytes, size: tuple[int, int]) -> bytes:
    segment = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    frame = segment(0xC0, struct.pack(">BHHB", 8, size[1], size[0], 1) + b"\x01\x11\x00")
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + b"\xff" + segment(0xE1, b"Exif\0\0" + structure) + frame + segment(0xDA, b"\x01\x01\0\0\x3f\0") + b"\0\xff\xd9"


def png(structure: bytes | None, size: tuple[int, int], pixels: bytes = b"", colour: int = 0, depth: int = 8) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", *size, depth, colour, 0, 0, 0))
    if structure is not None:
        out += chunk(b"eXIf", structure)
    return out + chunk(b"IDAT", zlib.compress(pixels)) + chunk(b"IEND", b"")


def webp(structure: bytes, size: tuple[int, int]) -> bytes:
    chunk = lambda kind, body: kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    body = chunk(b"VP8X", b"\x08\0\0\0" + (size[0] - 1).to_bytes(3, "little") + (size[1] - 1).to_bytes(3, "little")) + chunk(b"EXIF", structure)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def movie(date: str | None, size: tuple[int, int], place: tuple[float, float] | None, broken: bool = False) -> bytes:
    """broken: the movie's first box is smaller than its own header."""
    seconds = int((datetime.strptime(date, "%Y:%m:%d %H:%M:%S") - EPOCH).total_seconds()) if date else 0
    head = lambda kind, rest: box(kind, struct.pack(">III", 0, seconds, seconds), rest)
    track = box(b"trak", head(b"tkhd", b"\0" * 64 + struct.pack(">II", size[0] << 16, size[1] << 16)), box(b"mdia", head(b"mdhd", b"\0" * 12)))
    sound = box(b"trak", head(b"tkhd", b"\0" * 72))
    text = f"{place[0]:+08.4f}{place[1]:+09.4f}/".encode() if place else b""
    user = box(b"udta", box(b"\xa9xyz", struct.pack(">HH", len(text), 0), text)) if place else b""
    first = struct.pack(">I4s", 3, b"mvhd") if broken else head(b"mvhd", b"\0" * 84)
    return box(b"ftyp", b"isom\0\0\0\0") + struct.pack(">I4sQ", 1, b"mdat", 24) + b"\0" * 8 + box(b"moov", first, sound, track, user)


def heif(structure: bytes, size: tuple[int, int]) -> bytes:
    payload = struct.pack(">I", 6) + b"Exif\0\0" + structure
    info = lambda n, kind: box(b"infe", struct.pack(">IHH4s", 2 << 24, n, 0, kind) + b"\0")
    items = box(b"iinf", struct.pack(">IH", 0, 2), info(1, b"hvc1"), info(2, b"Exif"))
    extents = [box(b"ispe", struct.pack(">III", 0, *s)) for s in ((16, 16), size)]

    def meta(at: int) -> bytes:
        place = struct.pack(">IBBH", 0, 0x44, 0x00, 1) + struct.pack(">HHHII", 2, 0, 1, at, len(payload))
        return box(b"meta", b"\0\0\0\0", items, box(b"iloc", place), box(b"iprp", box(b"ipco", *extents)))

    front = box(b"ftyp", b"heic\0\0\0\0mif1heic")
    return front + meta(len(front) + len(meta(0)) + 8) + box(b"mdat", payload)


FORMS = ("jpg", "tif", "png", "webp", "mov", "heic")


def made(form: str, order: str, date: str | None, size: tuple[int, int], place: tuple[float, float] | None, cyclic: bool = False) -> bytes:
    """A file of one of the FORMS with this metadata; cyclic: its date can't be reached (of a movie: nothing can)."""
    if form == "mov":
        return movie(date, size, place, cyclic)
    structure = tiff(order, date, size if form == "tif" else None, place, cyclic)
    return {"jpg": jpeg, "png": png, "webp": webp, "heic": heif}[form](structure, size) if form != "tif" else structure


def picture(levels: np.ndarray, form: str) -> bytes:
    """Grey levels (height, width) as a file that holds them: `png` (its rows filtered by turns), `bmp` or `tif`."""
    height, width = levels.shape
    if form == "png":
        rows, above = b"", np.zeros(width, dtype=np.int64)
        for y, row in enumerate(levels.astype(np.int64)):
            left = np.concatenate(([0], row[:-1]))
            guess = (0 * row, left, above, (left + above) // 2)[y % 4]
            rows += bytes([y % 4]) + ((row - guess) & 255).astype(np.uint8).tobytes()
            above = row
        return png(None, (width, height), rows)
    if form == "bmp":
        flat = np.zeros((height, (3 * width + 3) // 4 * 4), dtype=np.uint8)
        flat[:, : 3 * width] = np.repeat(levels[::-1], 3, axis=1)
        return struct.pack("<2sIHHI", b"BM", 54 + flat.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, flat.size, 0, 0, 0, 0) + flat.tobytes()
    short = lambda tag, value: (tag, 3, 1, struct.pack("<H", value))
    packed = zlib.compress(levels.astype(np.uint8).tobytes())
    entries = lambda at: [short(258, 8), short(259, 8), short(262, 1), (273, 4, 1, struct.pack("<I", at)), short(277, 1), short(278, height), (279, 4, 1, struct.pack("<I", len(packed)))]
    head = tiff("<", None, (width, height), None, more=entries(0))
    return tiff("<", None, (width, height), None, more=entries(len(head))) + packed
