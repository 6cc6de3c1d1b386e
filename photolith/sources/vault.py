"""The vault: files are copied in where tasks run, checked there, and never replaced."""

from __future__ import annotations

import errno
import hashlib
import os
import shutil
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK = 1 << 20
TAKEN = "other content is there"
#: What file systems without hard links say when they are asked for one.
NO_LINKS = {errno.EPERM, errno.ENOTSUP, errno.EOPNOTSUPP, errno.ENOSYS, errno.EMLINK, errno.EXDEV, errno.EACCES}


def sha256_of(path: str) -> str:
    """The SHA-256 of a file, read in chunks."""
    found = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(CHUNK):
            found.update(chunk)
    return found.hexdigest()


def _placed(aside: str, target: str) -> bool:
    """Give a checked copy its name; False if the name is taken. It appears whole where there are hard links, else it's claimed first and then filled."""
    try:
        os.link(aside, target)
        return True
    except FileExistsError:
        return False
    except OSError as error:
        if error.errno not in NO_LINKS:
            raise
    try:
        own = os.open(target, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        return False
    try:
        with open(aside, "rb") as source, os.fdopen(own, "wb") as out:
            shutil.copyfileobj(source, out, CHUNK)
        shutil.copystat(aside, target)
    except OSError:
        os.unlink(target)  # the claim is this task's own
        raise
    return True


def file_one(source: str, vault: str, places: list[str], want: str | None) -> tuple[str | None, str | None]:
    """(place, error) of a file that goes to the first of the places where nothing is, or where it is already."""
    if not want:
        return None, "no checksum"
    aside = None
    try:
        for place in places:
            target = os.path.join(vault, place)
            if not os.path.lexists(target):
                os.makedirs(os.path.dirname(target), exist_ok=True)
                if aside is None:
                    aside = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}.part")
                    shutil.copy2(source, aside)  # with its times, which are evidence
                    if sha256_of(aside) != want:
                        return None, "the copy differs from its checksum"
                if _placed(aside, target):
                    # A link is the file that was read and checked; what was filled is read again.
                    return (place, None) if os.path.samefile(aside, target) or sha256_of(target) == want else (None, "the copy differs from its checksum")
            if os.path.isfile(target) and sha256_of(target) == want:
                return place, None
        return None, TAKEN
    except OSError as error:
        return None, f"{type(error).__name__}: {error.strerror or error}"
    finally:
        if aside is not None and os.path.lexists(aside):
            os.unlink(aside)


def copy_into_vault(files: DataFrame, vault: str) -> DataFrame:
    """(path, vault_path, error) of files (path, vault_path, sha256 and, if there is one, spare_path) copied into a mounted vault.

    A file goes to its vault_path or, where other content is there, to its spare_path; vault_path says where it is now, and is null
    where there is an error. Bytes that are there already are fine if they are the same, and are never replaced, so a task that runs
    twice does no harm. Rows are dealt out before, as few bytes of rows are many bytes of files.
    """

    def run(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            done = [file_one(path, vault, [p for p in (place, *spare) if p], sha) for path, place, sha, *spare in zip(*columns, strict=True)]
            arrays = [batch.column(0), *(pa.array(x, type=pa.string()) for x in (zip(*done, strict=True) if done else ([], [])))]
            yield pa.RecordBatch.from_arrays(arrays, names=["path", "vault_path", "error"])

    spare = ["spare_path"] if "spare_path" in files.columns else []
    return dealt_out(files.select("path", "vault_path", "sha256", *spare)).mapInArrow(run, "path string, vault_path string, error string")


def dealt_out(files: DataFrame) -> DataFrame:
    """Rows that each stand for a file, dealt over all cores: their own bytes are few, and would be read by one task."""
    return files.repartition(2 * files.sparkSession.sparkContext.defaultParallelism)


def over_cores(rows: DataFrame) -> DataFrame:
    """The rows of a scan as they are where it has splits enough for all cores, else dealt out: a table of one row group is one task, however many files it makes."""
    return rows if rows.rdd.getNumPartitions() >= 2 * rows.sparkSession.sparkContext.defaultParallelism else dealt_out(rows)


def with_sha256(files: DataFrame, column: str = "sha256") -> DataFrame:
    """`files` with the SHA-256 of each `path`, read where the tasks run; a file that can't be read has none."""
    schema = T.StructType([*files.schema.fields, T.StructField(column, T.StringType())])

    def digest(path: str) -> str | None:
        try:
            return sha256_of(path)
        except OSError:
            return None

    def run(batches):
        for batch in batches:
            found = [digest(path) for path in batch.column(batch.schema.get_field_index("path")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, type=pa.string())], names=[*batch.schema.names, column])

    return dealt_out(files).mapInArrow(run, schema)
