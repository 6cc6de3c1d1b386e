"""Embedded metadata, read from the bytes of files where tasks run: no program, and only the ranges that hold it.

* JPEG: segments up to the picture; the frame header has the size, an Exif segment a TIFF structure.
* TIFF and the raw formats built on it: directories of entries in either byte order; the size is that of the directory of the whole picture.
* PNG, WebP, GIF, BMP: their chunks and headers, with the Exif chunk where there is one.
* HEIF: nested boxes; the size is the largest of the picture's extents, Exif is an item.
* MOV, MP4, M4V, 3GP, CR3: nested boxes; the movie's and the first track's creation times (UTC, as they are stored), the size of the largest
  track, the place from the user data.

Every offset and count is checked against the file before it's used, directories are read once each, and a file is read from `READS` times at
most, so truncated, cyclic and hostile files end the walk; what was read before that
counts, everything else is unknown. Formats not listed are unknown. Values are texts, as `files.read_embedded` takes them.
"""

from __future__ import annotations

import os
import struct
from datetime import datetime, timedelta

import pandas as pd

from photolith.sources.files import DATE_TAGS, PLACE_TAGS, SIZE_TAGS

#: Numbers of tags, and kinds of entries with the bytes of each (TIFF 6, Exif 2.3).
WIDTH, HEIGHT, KIND, SUB, EXIF, GPS = 0x0100, 0x0101, 0x00FE, 0x014A, 0x8769, 0x8825
ORIGINAL, DIGITIZED, PIXELS_X, PIXELS_Y = 0x9003, 0x9004, 0xA002, 0xA003
LAT_REF, LAT, LON_REF, LON = 1, 2, 3, 4
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
#: Boxes that hold boxes, and the epoch of their times.
HOLDERS = {b"moov", b"trak", b"mdia", b"udta", b"iprp", b"ipco"}
EPOCH = datetime(1904, 1, 1)
#: The largest value of an entry that is read, and the most bytes of a box that is read whole.
MOST = 1 << 16
MOST_BOX = 1 << 22
#: The most reads of one file; what it tells within them counts.
READS = 1 << 16


class Broken(Exception):
    """A structure that points outside its file, or goes round in circles."""


class Ranges:
    """A file, or a part of one, whose ranges are read only if they're inside it, and not endlessly."""

    def __init__(self, file, start: int, end: int, left: list[int] | None = None):
        self.file, self.start, self.end = file, start, end
        self.left = [READS] if left is None else left

    @property
    def size(self) -> int:
        return self.end - self.start

    def read(self, at: int, n: int) -> bytes:
        self.left[0] -= 1
        if at < 0 or n < 0 or at + n > self.size or self.left[0] < 0:
            raise Broken
        self.file.seek(self.start + at)
        found = self.file.read(n)
        if len(found) != n:
            raise Broken
        return found

    def numbers(self, layout: str, at: int) -> tuple:
        return struct.unpack(layout, self.read(at, struct.calcsize(layout)))

    def part(self, at: int, n: int) -> Ranges:
        if at < 0 or n < 0 or at + n > self.size:
            raise Broken
        return Ranges(self.file, self.start + at, self.start + at + n, self.left)


class Tiff:
    """The directories of a TIFF structure."""

    def __init__(self, data: Ranges):
        mark = data.read(0, 2)
        if mark not in (b"II", b"MM"):
            raise Broken
        self.data, self.order, self.seen = data, "<" if mark == b"II" else ">", set()
        self.magic, self.first = data.numbers(f"{self.order}HI", 2)

    def directory(self, at: int) -> tuple[dict[int, tuple[int, int, int]], int]:
        """(kind, number of values, offset of them) of each entry, and the next directory's offset, 0 for none."""
        if at in self.seen:
            raise Broken
        self.seen.add(at)
        (n,) = self.data.numbers(f"{self.order}H", at)
        entries = {}
        for i in range(n):
            tag, kind, count = self.data.numbers(f"{self.order}HHI", at + 2 + 12 * i)
            size = SIZES.get(kind, 0) * count
            if not size or size > MOST:
                continue
            place = at + 10 + 12 * i
            entries.setdefault(tag, (kind, count, place if size <= 4 else self.data.numbers(f"{self.order}I", place)[0]))
        try:
            following = self.data.numbers(f"{self.order}I", at + 2 + 12 * n)[0]
        except Broken:
            following = 0
        return entries, following

    def whole(self, entries: dict, tag: int) -> list[int]:
        """The whole numbers of an entry; none if it has none, or points outside."""
        kind, count, at = entries.get(tag, (0, 0, 0))
        letter = {1: "B", 3: "H", 4: "I", 13: "I"}.get(kind)
        try:
            return list(self.data.numbers(f"{self.order}{count}{letter}", at)) if letter else []
        except Broken:
            return []

    def text(self, entries: dict, tag: int) -> str | None:
        kind, count, at = entries.get(tag, (0, 0, 0))
        try:
            return self.data.read(at, count).split(b"\0")[0].decode("ascii", "replace") if kind == 2 else None
        except Broken:
            return None

    def angle(self, entries: dict, tag: int, reference: int) -> float | None:
        """Degrees from degrees, minutes and seconds, negative for S and W."""
        kind, count, at = entries.get(tag, (0, 0, 0))
        side = (self.text(entries, reference) or "").strip().upper()
        try:
            parts = self.data.numbers(f"{self.order}{2 * count}I", at) if kind == 5 and 1 <= count <= 3 else ()
        except Broken:
            return None
        if not parts or not side or side not in "NSEW" or any(d == 0 for d in parts[1::2]):
            return None
        degrees = sum(n / d / 60**i for i, (n, d) in enumerate(zip(parts[::2], parts[1::2], strict=True)))
        return -degrees if side in "SW" else degrees


def of_tiff(data: Ranges, found: dict, alone: bool) -> None:
    """Dates and the place of a TIFF structure; its size too if it stands alone, and isn't part of another format."""
    tiff = Tiff(data)
    entries, _ = tiff.directory(tiff.first)
    for pointer, read in ((EXIF, _of_exif), (GPS, _of_gps)):
        for at in tiff.whole(entries, pointer)[:1]:
            try:
                read(tiff, tiff.directory(at)[0], found, alone)
            except Broken:
                continue
    if not alone:
        return
    pictures = [entries]
    for at in tiff.whole(entries, SUB):
        try:
            pictures.append(tiff.directory(at)[0])
        except Broken:
            continue
    whole = [e for e in pictures if tiff.whole(e, KIND) in ([], [0])] or pictures
    sizes = [(w[0], h[0]) for e in whole if (w := tiff.whole(e, WIDTH)) and (h := tiff.whole(e, HEIGHT))]
    if sizes:
        found["ImageWidth"], found["ImageHeight"] = sizes[0]


def _of_exif(tiff: Tiff, entries: dict, found: dict, alone: bool) -> None:
    for tag, name in ((ORIGINAL, "DateTimeOriginal"), (DIGITIZED, "CreateDate")):
        if value := tiff.text(entries, tag):
            found[name] = value


def _of_gps(tiff: Tiff, entries: dict, found: dict, alone: bool) -> None:
    lat, lon = tiff.angle(entries, LAT, LAT_REF), tiff.angle(entries, LON, LON_REF)
    if lat is not None and lon is not None:
        found["GPSLatitude"], found["GPSLongitude"] = lat, lon


def of_jpeg(data: Ranges, found: dict) -> None:
    at = 2
    while True:
        if data.read(at, 1) != b"\xff":
            raise Broken
        while (mark := data.read(at + 1, 1)[0]) == 0xFF:  # filling before a marker
            at += 1
        if mark in (0xD9, 0xDA):  # the picture's data begin, or nothing does
            return
        if mark == 0x01 or 0xD0 <= mark <= 0xD7:
            at += 2
            continue
        (size,) = data.numbers(">H", at + 2)
        if size < 2:
            raise Broken
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            found["ImageHeight"], found["ImageWidth"] = data.numbers(">HH", at + 5)
        elif mark == 0xE1 and size >= 8 and data.read(at + 4, 6) == b"Exif\0\0":
            _inner(data, at + 10, size - 8, found)
        at += 2 + size


def _inner(data: Ranges, at: int, size: int, found: dict) -> None:
    """A TIFF structure inside another format, which goes on if it's broken."""
    try:
        part = data.part(at, size)
        if size >= 6 and part.read(0, 6) == b"Exif\0\0":
            part = data.part(at + 6, size - 6)
        of_tiff(part, found, False)
    except Broken:
        return


def of_png(data: Ranges, found: dict) -> None:
    at = 8
    while True:
        size, kind = data.numbers(">I4s", at)
        if kind == b"IHDR":
            found["ImageWidth"], found["ImageHeight"] = data.numbers(">II", at + 8)
        elif kind == b"eXIf":
            _inner(data, at + 8, size, found)
        elif kind == b"IEND":
            return
        at += 12 + size


def of_webp(data: Ranges, found: dict) -> None:
    at = 12
    while True:
        kind, size = data.numbers("<4sI", at)
        if kind == b"VP8X":
            raw = data.read(at + 12, 6)
            found["ImageWidth"], found["ImageHeight"] = (1 + int.from_bytes(raw[i : i + 3], "little") for i in (0, 3))
        elif kind == b"VP8 " and "ImageWidth" not in found:
            found["ImageWidth"], found["ImageHeight"] = (x & 0x3FFF for x in data.numbers("<HH", at + 14))
        elif kind == b"VP8L" and "ImageWidth" not in found:
            (bits,) = data.numbers("<I", at + 9)
            found["ImageWidth"], found["ImageHeight"] = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        elif kind == b"EXIF":
            _inner(data, at + 8, size, found)
        at += 8 + size + size % 2


def boxes(data: Ranges):
    """(kind, content) of the boxes that lie in a range one after the other."""
    at = 0
    while at + 8 <= data.size:
        size, kind = data.numbers(">I4s", at)
        head = 8
        if size == 1:
            (size,) = data.numbers(">Q", at + 8)
            head = 16
        elif size == 0:
            size = data.size - at
        if size < head:
            raise Broken
        yield kind, data.part(at + head, size - head)
        at += size


def _time(data: Ranges) -> str | None:
    """The creation time that a movie, track or media header begins with."""
    (version,) = data.numbers(">B", 0)
    (seconds,) = data.numbers(">Q" if version == 1 else ">I", 4)
    try:
        return (EPOCH + timedelta(seconds=seconds)).strftime("%Y:%m:%d %H:%M:%S") if seconds else None
    except OverflowError:
        return None


def _place(text: str) -> tuple[float, float] | None:
    """Latitude and longitude of an ISO 6709 text in degrees, `+48.20-016.37/`."""
    cuts = [i for i, c in enumerate(text) if c in "+-"]
    if len(cuts) < 2 or cuts[0]:
        return None
    end = next((i for i in range(cuts[1] + 1, len(text)) if text[i] not in "0123456789."), len(text))
    try:
        return float(text[: cuts[1]]), float(text[cuts[1] : end])
    except ValueError:
        return None


def of_movie(data: Ranges, found: dict, depth: int = 0) -> None:
    for kind, box in boxes(data):
        if kind == b"mvhd" and (at := _time(box)):
            found.setdefault("CreateDate", at)
        elif kind == b"mdhd" and (at := _time(box)):
            found.setdefault("MediaCreateDate", at)
        elif kind == b"tkhd":
            width, height = (x >> 16 for x in box.numbers(">II", box.size - 8))
            if width * height > found.get("ImageWidth", 0) * found.get("ImageHeight", 0):
                found["ImageWidth"], found["ImageHeight"] = width, height
        elif kind == b"\xa9xyz" and box.size <= MOST:
            (n,) = box.numbers(">H", 0)
            if place := _place(box.read(4, min(n, box.size - 4)).decode("ascii", "replace")):
                found["GPSLatitude"], found["GPSLongitude"] = place
        elif kind == b"uuid" and box.size >= 16 and box.read(0, 16) == bytes.fromhex("85c0b687820f11e08111f4ce462b6a48"):
            for inner, part in boxes(box.part(16, box.size - 16)):
                if inner in (b"CMT2", b"CMT4"):
                    _directory(part, _of_exif if inner == b"CMT2" else _of_gps, found)
        elif kind in HOLDERS and depth < 8:
            try:
                of_movie(box, found, depth + 1)
            except Broken:
                continue


def _directory(data: Ranges, read, found: dict) -> None:
    """A TIFF structure whose first directory is the wanted one."""
    try:
        tiff = Tiff(data)
        read(tiff, tiff.directory(tiff.first)[0], found, False)
    except Broken:
        return


def of_heif(data: Ranges, found: dict) -> None:
    for kind, box in boxes(data):
        if kind == b"meta" and box.size >= 4:
            _of_heif_meta(data, box.part(4, box.size - 4), found)


def _of_heif_meta(data: Ranges, meta: Ranges, found: dict) -> None:
    exif, places = set(), {}
    for kind, box in boxes(meta):
        if kind == b"iprp":
            for inner, part in boxes(box):
                for name, size in boxes(part) if inner == b"ipco" else ():
                    if name == b"ispe":
                        width, height = size.numbers(">II", 4)
                        if width * height > found.get("ImageWidth", 0) * found.get("ImageHeight", 0):
                            found["ImageWidth"], found["ImageHeight"] = width, height
        elif kind == b"iinf":
            version = box.numbers(">B", 0)[0]
            for inner, item in boxes(box.part(6 if version == 0 else 8, box.size - (6 if version == 0 else 8))):
                if inner == b"infe" and (form := item.numbers(">B", 0)[0]) >= 2:
                    number, _, what = item.numbers(">HH4s" if form == 2 else ">IH4s", 4)
                    if what == b"Exif":
                        exif.add(number)
        elif kind == b"iloc" and box.size <= MOST_BOX:
            places = _places(box)
    for number in exif & set(places):
        at, size = places[number]
        if size > 4:
            (skip,) = data.numbers(">I", at)
            _inner(data, at + 4 + skip, size - 4 - skip, found)


def _places(box: Ranges) -> dict[int, tuple[int, int]]:
    """(offset in the file, bytes) of each item that lies in one piece."""
    version, sizes, more = box.numbers(">B3xBB", 0)
    offset, length, base, index = sizes >> 4, sizes & 15, more >> 4, more & 15
    number = lambda at, n: int.from_bytes(box.read(at, n), "big")
    wide = 4 if version == 2 else 2
    at, found = 6 + wide, {}
    for _ in range(number(6, wide)):
        item, at = number(at, wide), at + wide
        inside, at = (number(at, 2) & 15, at + 2) if version else (0, at)
        start, at = number(at + 2, base), at + 2 + base
        pieces, at = number(at, 2), at + 2
        for _ in range(pieces):
            at += index if version else 0
            place, size, at = number(at, offset), number(at + offset, length), at + offset + length
            if pieces == 1 and inside == 0:
                found[item] = (start + place, size)
    return found


def of_file(path: str) -> dict:
    """The tags that a file's own bytes tell, by name; none where it can't be read."""
    found: dict = {}
    try:
        with open(path, "rb") as f:
            data = Ranges(f, 0, os.fstat(f.fileno()).st_size)
            head = data.read(0, min(data.size, 16))
            if head[:2] == b"\xff\xd8":
                of_jpeg(data, found)
            elif head[:2] in (b"II", b"MM"):
                of_tiff(data, found, True)
            elif head[:8] == b"\x89PNG\r\n\x1a\n":
                of_png(data, found)
            elif head[:4] == b"RIFF" and head[8:12] == b"WEBP":
                of_webp(data, found)
            elif head[:6] in (b"GIF87a", b"GIF89a"):
                found["ImageWidth"], found["ImageHeight"] = data.numbers("<HH", 6)
            elif head[:2] == b"BM":
                width, height = data.numbers("<ii", 18)
                found["ImageWidth"], found["ImageHeight"] = width, abs(height)
            elif head[4:8] == b"ftyp" and head[8:12] in (b"heic", b"heix", b"hevc", b"mif1", b"msf1", b"avif"):
                of_heif(data, found)
            elif head[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free", b"skip"):
                of_movie(data, found)
    except (Broken, OSError, struct.error):
        pass
    return found


def byte_reader(batch: list[str]) -> pd.DataFrame:
    """A reader for `files.read_embedded` that needs no program."""
    rows = [{"path": p} | of_file(p) for p in batch]
    return pd.DataFrame(rows, columns=["path", *DATE_TAGS, *SIZE_TAGS, *PLACE_TAGS], dtype=object)
