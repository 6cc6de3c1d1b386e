import math
import struct
import zlib

import numpy as np
import pytest

from photolith.plans import made_files as M
from photolith.sources import decoders, embedded, pixels
from photolith.sources import files as S

DATE, SIZE, PLACE = "2015:06:15 12:00:01", (4000, 3000), (-48.5, 16.25)
WHOLE = {"ImageWidth": 4000, "ImageHeight": 3000, "GPSLatitude": -48.5, "GPSLongitude": 16.25}


def read(tmp_path, data):
    path = tmp_path / "x.bin"
    path.write_bytes(data)
    return embedded.of_file(str(path))


@pytest.mark.parametrize("form", M.FORMS)
@pytest.mark.parametrize("order", "<>")
def test_every_format_tells_date_size_and_place(tmp_path, form, order):
    found = read(tmp_path, M.made(form, order, DATE, SIZE, PLACE))
    dates = {"CreateDate": DATE, "MediaCreateDate": DATE} if form == "mov" else {"DateTimeOriginal": DATE}
    assert found == WHOLE | dates
    found = read(tmp_path, M.made(form, order, None, SIZE, None))
    assert found == {"ImageWidth": 4000, "ImageHeight": 3000}


@pytest.mark.parametrize("form", M.FORMS)
def test_truncated_files_give_what_was_read_and_never_fail(tmp_path, form):
    data = M.made(form, ">", DATE, SIZE, PLACE)
    whole = read(tmp_path, data)
    for n in range(0, len(data), 1 if len(data) < 400 else 3):
        found = read(tmp_path, data[:n])
        assert all(whole.get(k) == v for k, v in found.items() if not k.startswith("Image")), (n, found)
    assert read(tmp_path, data[:10]) == {}


@pytest.mark.parametrize("form", M.FORMS)
def test_no_byte_makes_it_fail(tmp_path, form):
    data = M.made(form, "<", DATE, SIZE, PLACE)
    rng = np.random.default_rng(1)
    for _ in range(300):
        broken = bytearray(data)
        for at in rng.integers(0, len(data), 3):
            broken[at] = rng.choice([0, 1, 255, rng.integers(256)])
        assert set(read(tmp_path, bytes(broken))) <= {*WHOLE, *S.DATE_TAGS}


def test_circles_end(tmp_path):
    found = read(tmp_path, M.made("jpg", "<", DATE, SIZE, PLACE, cyclic=True))
    assert found == WHOLE
    assert read(tmp_path, M.made("mov", "<", DATE, SIZE, PLACE, cyclic=True)) == {}
    own = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<HHHIIHHIII", 2, 0x8769, 4, 1, 8, 0x14A, 4, 1, 8, 8)
    assert read(tmp_path, own) == {}
    many = M.box(b"ftyp", b"isom\0\0\0\0") + M.box(b"free") * 200_000 + M.box(b"moov", M.box(b"mvhd", struct.pack(">III", 0, 9, 9)))
    assert read(tmp_path, many) == {}  # beyond the most reads of a file
    deep = b""
    for _ in range(50):
        deep = M.box(b"udta", deep)
    assert read(tmp_path, M.box(b"ftyp", b"isom\0\0\0\0") + M.box(b"moov", deep)) == {}


def test_raw_formats_give_the_size_of_the_whole_picture(tmp_path):
    long = lambda tag, v: (tag, 4, 1, struct.pack("<I", v))
    small = [long(0xFE, 1), long(0x100, 160), long(0x101, 120)]
    sub = M._directory("<", 0, [long(0xFE, 0), long(0x100, 6000), long(0x101, 4000)])
    head = len(M._directory("<", 8, [*small, long(0x14A, 0)])) + 8
    data = struct.pack("<2sHI", b"II", 42, 8) + M._directory("<", 8, [*small, long(0x14A, head)]) + sub
    assert read(tmp_path, data) == {"ImageWidth": 6000, "ImageHeight": 4000}


@pytest.mark.parametrize("data, want", [
    (b"GIF89a" + struct.pack("<HH", 30, 20) + b"\0" * 4, (30, 20)), (struct.pack("<2sIHHIIii", b"BM", 0, 0, 0, 54, 40, 30, -20), (30, 20)),
    (b"RIFF\0\0\0\0WEBPVP8 " + struct.pack("<I", 10) + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 30 | 0x4000, 20), (30, 20)),
    (b"RIFF\0\0\0\0WEBPVP8L" + struct.pack("<IBI", 5, 0x2F, 29 | 19 << 14) + b"\0", (30, 20)), (b"", None), (b"plain text", None), (b"\xff\xd8", None), (b"\xff\xd8\xff\xd9", None),
])
def test_other_headers(tmp_path, data, want):
    assert read(tmp_path, data) == ({"ImageWidth": want[0], "ImageHeight": want[1]} if want else {})


@pytest.mark.parametrize("text, want", [("+48.2-016.3/", (48.2, -16.3)), ("-10+020.5+100.2CRSWGS_84/", (-10.0, 20.5)), ("48.2+16", None), ("+48", None), ("", None), ("+1+x", None)])
def test_places_of_movies(text, want):
    assert embedded._place(text) == want


def test_angles_without_a_side_or_with_zero_denominators_are_unknown(tmp_path):
    data = bytearray(M.tiff("<", None, SIZE, PLACE))
    at = bytes(data).index(b"S\0")
    data[at] = ord("?")
    assert "GPSLatitude" not in read(tmp_path, bytes(data))
    data = M.tiff("<", None, SIZE, PLACE).replace(struct.pack("<II", 48, 1), struct.pack("<II", 48, 0))
    assert read(tmp_path, data) == {"ImageWidth": 4000, "ImageHeight": 3000}


def test_metadata_of_files_without_a_program(spark, tmp_path):
    for k, form in enumerate(M.FORMS):
        (tmp_path / f"{k}.{form}").write_bytes(M.made(form, "<", DATE if k else None, SIZE, PLACE))
    (tmp_path / "empty.jpg").write_bytes(b"")
    media = S.scan(S.list_files(spark, str(tmp_path)))
    found = {r.path.rsplit("/", 1)[1]: r for r in S.metadata(S.read_embedded(media, embedded.byte_reader)).collect()}
    assert {k: str(r.taken_at) for k, r in found.items() if r.taken_at} == {f"{k}.{f}": "2015-06-15 12:00:01" for k, f in enumerate(M.FORMS) if k and f != "webp" or f == "webp"}
    assert all((r.width, r.height, r.gps_latitude) == (4000, 3000, -48.5) for k, r in found.items() if k != "empty.jpg")
    assert found["empty.jpg"].width is None and found["empty.jpg"].taken_at_source == "unknown" and found["1.tif"].taken_at_source == "exif"


def plain_hash(levels):
    """The definition, sum by sum."""
    cell = [[sum(levels[y][x] * math.cos(math.pi * u * (2 * x + 1) / 64) * math.cos(math.pi * v * (2 * y + 1) / 64) for y in range(32) for x in range(32)) * 4 for u in range(8)] for v in range(8)]
    flat = [round(c, 6) for row in cell for c in row]
    middle = sum(sorted(flat)[31:33]) / 2
    return f"{int(''.join('1' if c > middle else '0' for c in flat), 2):016x}"


def test_hashes_equal_the_definition():
    rng = np.random.default_rng(1)
    squares = rng.integers(0, 256, (12, 32, 32))
    squares[0], squares[1, :, :16] = 7, 0
    assert pixels.hashes(squares) == [plain_hash(s.tolist()) for s in squares]
    assert pixels.hashes(squares[:1]) == ["8000000000000000"] and pixels.hashes(squares[:0]) == []


@pytest.mark.parametrize("shape", [(32, 32), (1, 1), (5, 90), (100, 47), (33, 31)])
@pytest.mark.parametrize("form", ["png", "bmp", "tif"])
def test_pictures_are_decoded(shape, form):
    levels = np.random.default_rng(2).integers(0, 256, shape).astype(np.uint8)
    assert (pixels.grey(pixels.decoded(M.picture(levels, form))) == levels).all()


def test_all_filters_channels_and_depths_of_png():
    rng = np.random.default_rng(3)
    for colour, channels in ((0, 1), (2, 3), (4, 2), (6, 4)):
        want = rng.integers(0, 256, (9, 7, channels))
        rows, above = b"", np.zeros((7, channels), dtype=np.int64)
        for y, row in enumerate(want):
            left = np.vstack([np.zeros((1, channels), dtype=np.int64), row[:-1]])
            corner = np.vstack([np.zeros((1, channels), dtype=np.int64), above[:-1]])
            p = left + above - corner
            a, b, c = abs(p - left), abs(p - above), abs(p - corner)
            paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
            guess = (0 * row, left, above, (left + above) // 2, paeth)[y % 5]
            rows += bytes([y % 5]) + ((row - guess) & 255).astype(np.uint8).tobytes()
            above = row
        assert (pixels.decoded(M.png(None, (7, 9), rows, colour)) == want[:, :, : 1 if channels < 3 else 3]).all()
    for depth in (1, 2, 4):
        want = rng.integers(0, 1 << depth, (3, 5))
        lines = b"".join(b"\0" + bytes(int("".join(f"{v:0{depth}b}" for v in row).ljust(-(-5 * depth // 8) * 8, "0")[i : i + 8], 2) for i in range(0, -(-5 * depth // 8) * 8, 8)) for row in want)
        assert (pixels.decoded(M.png(None, (5, 3), lines, 0, depth))[:, :, 0] == want * 255 // ((1 << depth) - 1)).all()


def test_grey_levels_and_resizing():
    assert pixels.grey(np.array([[[255, 255, 255], [255, 0, 0], [0, 0, 0]]], dtype=np.uint8)).tolist() == [[255, 76, 0]]
    for size in (1, 5, 31, 32, 33, 64, 500):
        w = pixels.weights(size, 32)
        assert w.shape == (32, size) and (abs(w.sum(axis=1) - (1 << 22)) <= size).all()
        assert (pixels.resized(np.full((size, 2 * size), 77)) == 77).all()
    ramp = pixels.resized(np.tile(np.arange(256), (256, 1)))
    assert (np.diff(ramp, axis=1) > 0).all() and (ramp == ramp[0]).all()


def test_what_cannot_be_decoded_has_no_hash(spark, tmp_path):
    good = M.picture(np.arange(64 * 64).reshape(64, 64) % 251, "png")
    for name, data in {"a.png": good, "b.png": good[:60], "c.jpg": good, "d.png": b"", "e.png": M.png(None, (5, 5), b"short"), "f.mov": good, "g.jpg": b"\xff\xd8\xff\xd9"}.items():
        (tmp_path / name).write_bytes(data)
    found = {r.path.rsplit("/", 1)[1]: r.phash for r in decoders.with_phash(S.scan(S.list_files(spark, str(tmp_path)))).collect()}
    want = pixels.hashes(np.array([pixels.square(good)]))[0]
    assert found == {"a.png": want, "b.png": None, "c.jpg": want, "d.png": None, "e.png": None, "f.mov": None, "g.jpg": None}
    assert pixels.decoded(M.png(None, (1 << 20, 1 << 20), b"")) is None and pixels.decoded(b"BM" + b"\0" * 60) is None and zlib
