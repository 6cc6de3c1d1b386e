"""Paths and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from photolith.functions import text

#: File kinds by extension, and folders that hold no content.
PHOTO = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff", ".webp", ".heic", ".heif", ".dng", ".raw", ".cr2", ".cr3", ".nef", ".arw", ".orf", ".rw2")
VIDEO = (".mov", ".mp4", ".m4v", ".avi", ".mkv", ".mts", ".m2ts", ".3gp")
HASHABLE = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff", ".webp")
SIDECAR = (".xmp", ".json", ".aae")
SYSTEM = (
    ".trashes", ".trash", "$recycle.bin", "recycler", "system volume information", ".spotlight-v100",
    ".fseventsd", ".temporaryitems", ".documentrevisions-v100", ".apdisk", "__macosx", "lost+found",
)
SCREENSHOT = ("screenshot", "screen shot", "simulator screen shot")


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """The last extension with its dot; none for names that only start or end with a dot."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    own = name(path)
    return F.substring(own, F.lit(1), F.length(own) - F.length(suffix(path)))


def extension(path: Column) -> Column:
    return F.lower(suffix(path))


def is_media(path: Column) -> Column:
    return extension(path).isin(*PHOTO, *VIDEO)


def can_hash(path: Column) -> Column:
    return extension(path).isin(*HASHABLE)


def media_type(path: Column) -> Column:
    """`video` by extension, everything else `photo`."""
    return F.when(extension(path).isin(*VIDEO), "video").otherwise("photo")


def is_system(relative: Column) -> Column:
    """Whether a folder above the file is hidden or one of the system's."""
    parts = F.split(relative, "/")
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(above, lambda p: F.lower(p).isin(*SYSTEM) | p.startswith("."))


def is_content(relative: Column, skip=()) -> Column:
    """Whether a path below the root is a media file that a scan keeps."""
    own = name(relative)
    kept = is_media(relative) & ~own.startswith(".") & ~is_system(relative)
    return kept & ~own.isin(*skip) if skip else kept


def looks_like_screenshot(filename: Column) -> Column:
    own = text.fold_case(text.strip(filename))
    found = F.lit(False)
    for prefix in SCREENSHOT:
        found = found | own.startswith(prefix)
    return F.coalesce(found, F.lit(False))


def sidecars(media: Column) -> Column:
    """The sidecar paths a media file may have, first choice first."""
    bare = F.substring(media, F.lit(1), F.length(media) - F.length(suffix(media)))
    return F.array(*[F.concat(base, F.lit(e)) for e in (".json", ".xmp", ".aae") for base in (media, bare)])


def relative_to(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)
