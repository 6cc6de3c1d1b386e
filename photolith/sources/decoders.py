"""Perceptual hashes, and readers that need tools this library doesn't depend on: other picture decoders and an embedded-metadata program.

What needs a tool degrades to unknown values where it is missing or a file can't be read; nothing ever guesses.
"""

from __future__ import annotations

import json
import subprocess

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photolith.errors import SourceError
from photolith.functions import paths
from photolith.functions.keys import unused
from photolith.sources import pixels
from photolith.sources.files import DATE_TAGS, SIZE_TAGS, PLACE_TAGS
from photolith.sources.vault import dealt_out

#: The program and its options: JSON out, plain numbers, UTF-8 names, names from standard input.
PROGRAM = "exiftool"
OPTIONS = ("-json", "-n", "-charset", "filename=utf8", "-@", "-")
#: The most pictures whose levels and coefficients are held at a time.
HELD = 256


def _other_hash():
    """A function from a path to a hash for formats that `pixels` doesn't decode, or None where no decoder is installed."""
    try:
        import imagehash
        from PIL import Image
    except ImportError:
        return None

    def of(path: str) -> str | None:
        try:
            with Image.open(path) as image:
                return str(imagehash.phash(image))
        except Exception:  # whatever a decoder raises: the file is compared by its checksum alone
            return None

    return of


def _square(path: str):
    try:
        with open(path, "rb") as f:
            return pixels.square(f.read())
    except OSError:
        return None


def with_phash(files: DataFrame, column: str = "phash") -> DataFrame:
    """`files` with the 64-bit perceptual hash (hexadecimal) of each picture at `path`; null for video, for formats that can't be hashed, and
    for those that need a decoder that isn't installed. Pictures are decoded one by one and transformed by up to HELD."""
    (wanted,) = unused(files, "_wanted")
    marked = dealt_out(files.withColumn(wanted, F.when(paths.can_hash(F.col("path")), F.col("path"))))
    schema = T.StructType([*files.schema.fields, T.StructField(column, T.StringType())])

    def run(batches):
        other = _other_hash()
        for batch in (b.slice(a, HELD) for b in batches for a in range(0, b.num_rows, HELD)):
            asked = batch.column(batch.num_columns - 1).to_pylist()
            squares = {i: s for i, p in enumerate(asked) if p is not None and (s := _square(p)) is not None}
            found = dict(zip(squares, pixels.hashes(np.array(list(squares.values()))), strict=True))
            if other is not None:
                found |= {i: other(p) for i, p in enumerate(asked) if p is not None and i not in squares}
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([found.get(i) for i in range(len(asked))], type=pa.string())], names=[*batch.schema.names[:-1], column])

    return marked.mapInArrow(run, schema)


def _ask(*options: str, said: str = "", seconds: float | None = None) -> str:
    """What the program writes for these options; a SourceError where it can't be run."""
    try:
        done = subprocess.run([PROGRAM, *options], input=said.encode(), stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, timeout=seconds, check=False)
    except FileNotFoundError:
        raise SourceError(f"{PROGRAM} isn't installed; without it dates and dimensions stay unknown") from None
    except (OSError, subprocess.SubprocessError) as error:
        raise SourceError(f"{PROGRAM} failed: {error}") from error
    return done.stdout.decode("utf-8", "replace").strip()


def program_version() -> str:
    """The installed program's version; also the check to make before a long run."""
    return _ask("-ver", seconds=30)


def embedded_reader(batch: list[str]) -> pd.DataFrame:
    """A reader for `files.read_embedded`: one call of the program for all paths of a batch."""
    tags = [*DATE_TAGS, *SIZE_TAGS, *PLACE_TAGS]
    answer = _ask(*(f"-{t}" for t in tags), *OPTIONS, said="\n".join(batch))
    try:
        entries = json.loads(answer or "[]")
    except ValueError as error:
        raise SourceError(f"{PROGRAM} gave no JSON: {error}") from error
    table = pd.DataFrame.from_records(entries).reindex(columns=["SourceFile", *tags])
    return table.rename(columns={"SourceFile": "path"}).dropna(subset=["path"])
