"""What is recorded against what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _compared(listed: DataFrame, files: DataFrame, differs, extra: str) -> DataFrame:
    left = listed.withColumn("_listed", F.lit(True))
    right = files.select(*[F.col(c).alias(f"_{c}") for c in files.columns], F.lit(True).alias("_there"))
    joined = left.join(right, F.col("path") == F.col("_path"), "full_outer")
    status = F.when(F.col("_listed").isNull(), extra).when(F.col("_there").isNull(), "missing").when(differs, "corrupted").otherwise("ok")
    return joined.select(F.coalesce("path", "_path").alias("path"), status.alias("status"))


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status) of a manifest's and a drive's (path, sha256): ok, corrupted, missing or unlisted."""
    differs = ~F.col("sha256").eqNullSafe(F.col("_sha256"))
    return _compared(manifest.select("path", "sha256"), files.select("path", "sha256"), differs, "unlisted")


def verify_vault(assets: DataFrame, files: DataFrame, deep: bool = True) -> DataFrame:
    """(path, status) of the index's assets and the vault's files (path, size_bytes, sha256): sizes first, checksums if `deep`; untracked: only there."""
    differs = ~F.col("filesize").eqNullSafe(F.col("_size_bytes"))
    if deep:
        differs = differs | ~F.col("sha256").eqNullSafe(F.col("_sha256"))
    kept = ["path", "size_bytes", *(["sha256"] if deep else [])]
    return _compared(assets.select(F.col("vault_path").alias("path"), "filesize", "sha256"), files.select(*kept), differs, "untracked")


def counts(statuses: DataFrame) -> DataFrame:
    """checked (listed paths), ok, corrupted, missing, extra, and whether all is well; one row."""
    of = lambda *names: F.count_if(F.col("status").isin(*names))
    extra = of("unlisted", "untracked")
    found = statuses.agg((F.count(F.lit(1)) - extra).alias("checked"), of("ok").alias("ok"), of("corrupted").alias("corrupted"), of("missing").alias("missing"), extra.alias("extra"))
    return found.withColumn("passed", (F.col("corrupted") + F.col("missing") + F.col("extra")) == 0)


def orphan_sidecars(paths: DataFrame) -> DataFrame:
    """Sidecar paths whose media file is gone; for deleting only, never for counting. paths: (path, is_media, is_sidecar)."""
    bare = lambda c: F.regexp_replace(c, r"(?<=[^/])\.[^./]+$", "")
    media = paths.filter("is_media").select(F.explode(F.array("path", bare(F.col("path")))).alias("_key")).distinct()
    return paths.filter("is_sidecar").join(media, bare(F.col("path")) == F.col("_key"), "left_anti").select("path")
