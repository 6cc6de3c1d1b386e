"""Removing for good what was deleted from a drive in its review: the system's trash folders, and sidecars whose media are gone.

Nothing here is counted, named or returned: how many items there were is how many were held back. What is to go is marked first, in a written
table, and looked at again in the task that removes it, so what has come back meanwhile stays. Files go first, then folders, deepest level first.
Whatever can't be removed stays, without an error, and a run that is repeated, or a task that runs twice, finds nothing left to do.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolith.errors import SourceError
from photolith.functions import paths
from photolith.operators import verify
from photolith.sources.files import MANIFEST_NAME, levels, list_files, scan
from photolith.sources.scratch import discard, settle
from photolith.sources.vault import dealt_out


def _removed(rows: DataFrame, remove: Callable[[list[str]], None]) -> None:
    """Have tasks remove the paths; nothing comes back."""

    def run(batches):
        for batch in batches:
            remove(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([], type=pa.string())], names=["path"])

    dealt_out(rows.select("path")).mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def _unlink(found: list[str]) -> None:
    for path in found:
        try:
            os.unlink(path)
        except OSError:
            continue


def _rmdir(found: list[str]) -> None:
    for path in found:
        try:
            os.rmdir(path)
        except OSError:
            continue


def _base(root: str) -> str:
    base = os.path.abspath(os.path.expanduser(root))
    if not os.path.isdir(base):
        raise SourceError(f"not a folder: {root}")
    return base


def trash(spark: SparkSession, root: str) -> None:
    """Remove the system's folders at the top of a drive, with all that is in them."""
    base = _base(root)
    with os.scandir(base) as entries:
        tops = [e.path for e in entries if e.name.casefold() in paths.SYSTEM and e.is_dir(follow_symlinks=False)]
    if not tops:
        return
    marked = list(levels(spark, tops, every=True))
    for level in marked:
        _removed(level.filter("NOT is_folder"), _unlink)
    for level in reversed(marked):
        _removed(level.filter("is_folder"), _rmdir)
    _rmdir(tops)
    discard(*marked)


def _unlink_orphans(found: list[str]) -> None:
    """Remove sidecars, but not those whose media are there by now."""
    seen: dict[str, set[str]] = {}
    for path in found:
        folder, name = os.path.split(path)
        if folder not in seen:
            try:
                own = [n for n in os.listdir(folder) if not n.startswith(".") and os.path.splitext(n)[1].lower() in (*paths.PHOTO, *paths.VIDEO)]
            except OSError:
                continue
            seen[folder] = {*own, *(os.path.splitext(n)[0] for n in own)}
        if os.path.splitext(name)[0] not in seen[folder]:
            _unlink([path])


def orphaned_sidecars(spark: SparkSession, root: str) -> None:
    """Remove sidecars whose media file isn't on the drive."""
    listed = list_files(spark, _base(root))
    kept = scan(listed, (MANIFEST_NAME,)).select(F.col("path").alias("_kept"))
    rows = listed.join(kept, F.col("path") == F.col("_kept"), "left")
    rows = rows.select("path", F.col("_kept").isNotNull().alias("is_media"), paths.extension(F.col("path")).isin(*paths.SIDECAR).alias("is_sidecar"))
    marked = settle(verify.orphan_sidecars(rows), "orphans")
    _removed(marked, _unlink_orphans)
    discard(marked)


def clean(spark: SparkSession, root: str) -> None:
    """Both, the trash first."""
    trash(spark, root)
    orphaned_sidecars(spark, root)
