"""Ingest with its copies: files are filed in chunks that are recorded as they land, so a broken run goes on where it stopped.

A run is planned once. Its new files are numbered, best first, and cut into chunks; the plan is written beside the index. Of each chunk tasks
copy the files into the vault, read them again and say what landed; that is written, and what landed is recorded in one commit together with a note
that the chunk is done. A run that is started again under its name reads its plan and the notes: chunks that are recorded aren't looked at, one
whose copies were made but not recorded finds them in place.

A file fails if it can't be read, isn't what was identified any more, or finds both its names taken by other content. A failed
file isn't recorded and is no master, so those that were to be linked to it or queued because of it are planned again, against what
has landed, as the run's next round; there are as many rounds as copies of one picture fail in a row. Links and queued
files are recorded at the end. Every file ends as imported, linked, deferred or failed, and the counts say whether that is so;
a later run takes up what failed.

Defined cases: files of null checksum fail; a run without files is done at once; a run that is done changes nothing when it's started again;
runs of different names are independent; two files of one path count as one.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolith import schemas
from photolith.errors import SourceError
from photolith.functions.keys import merged
from photolith.operators import dedupe, upsert
from photolith.plans.ingest import link_rows, next_id, plan_ingest, review_rows, source_row
from photolith.sources.catalog import Catalog
from photolith.sources.vault import copy_into_vault

CHUNK = 100_000
IMPORTED, LINKED, DEFERRED, FAILED = "imported", "linked", "deferred", "failed"


class Run:
    """A run's tables beside the index, and what the index notes of it."""

    def __init__(self, catalog: Catalog, name: str):
        if not name or not set(name) <= set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_."):
            raise SourceError(f"a run's name is made of letters, digits, - _ and .: {name!r}")
        self.catalog, self.spark, self.name, self.root = catalog, catalog.spark, f"run/{name}", f"{catalog.root}/_runs/{name}"

    @property
    def state(self) -> dict:
        return self.catalog.note(self.name) or {"rounds": [], "done": False}

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.get(name, rows.schema)

    def get(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.root}/{name}")

    def outcomes(self, nth: int) -> DataFrame:
        """(path, vault_path, error) of a round's copies; names of chunks are columns of the path to them."""
        chunks = self.state["rounds"][nth]["chunks"]
        empty = self.spark.createDataFrame([], "path string, vault_path string, error string")
        return self.get_all([f"{nth}/copied-{c}" for c in chunks], empty.schema) if chunks else empty

    def get_all(self, names: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{n}" for n in names])


def _planned(run: Run, nth: int, identified: DataFrame, threshold: int, chunk: int) -> dict:
    """Write a round's plan, with ids and chunks of its new files, and note it."""
    catalog = run.catalog
    plan = plan_ingest(identified, catalog.read("assets"), threshold=threshold)
    start = next_id(catalog, "assets")
    assets = upsert.numbered(plan.assets, ["rank"], start)
    new = run.put(f"{nth}/new", assets.withColumn("chunk", F.floor((F.col("id") - start) / chunk).cast("int")))
    run.put(f"{nth}/verdicts", plan.verdicts)
    run.put(f"{nth}/links", plan.links)
    run.put(f"{nth}/late", plan.reviews.filter("kind <> 'unknown_date'"))
    run.put(f"{nth}/undated", plan.reviews.filter("kind = 'unknown_date'"))
    n = new.agg(F.max("chunk")).head()[0]
    state = run.state
    state["rounds"].append({"n_chunks": 0 if n is None else n + 1, "chunks": []})
    catalog.commit(notes={run.name: state})
    return state


def _file_chunk(run: Run, nth: int, number: int, vault: str, at: datetime, source: str | None) -> None:
    """Copy a chunk's files, and record those that landed together with the chunk's note."""
    catalog = run.catalog
    new = run.get(f"{nth}/new").filter(F.col("chunk") == number)
    copied = run.put(f"{nth}/copied-{number}", copy_into_vault(new, vault))
    landed = copied.filter("error IS NULL").select(F.col("path").alias("_path"), F.col("vault_path").alias("_place"))
    rows = new.join(merged(landed), F.col("path") == F.col("_path")).withColumn("vault_path", F.col("_place"))
    source_id, appended = source_row(catalog, source, at)
    rows = rows.withColumn("imported_at", F.lit(at).cast("timestamp")).withColumn("source_id", F.lit(source_id).cast("bigint"))
    named = rows.select(F.col("path").alias("asset_path"), "original_filename", F.col("vault_path").alias("_place"))
    undated = run.get(f"{nth}/undated").join(merged(named), "asset_path")
    undated = undated.withColumn("detail", F.to_json(F.struct(F.col("original_filename").alias("filename"), F.col("_place").alias("vault_path"))))
    state = run.state
    state["rounds"][nth]["chunks"] = [*state["rounds"][nth]["chunks"], number]
    catalog.commit(appended | {"assets": rows, "review_queue": review_rows(catalog, undated, rows, at)}, notes={run.name: state})


def _failed(run: Run, nth: int) -> DataFrame:
    """(path, error) of a round's new files that didn't land."""
    return run.outcomes(nth).filter("error IS NOT NULL").select("path", "error")


def _orphaned(run: Run, nth: int) -> DataFrame:
    """A round's files whose master failed."""
    gone = _failed(run, nth).select(F.col("path").alias("master_path"))
    return run.get(f"{nth}/verdicts").join(merged(gone), "master_path", "left_semi")


def _finished(run: Run, at: datetime) -> None:
    """Record links and queued files of all rounds."""
    catalog, rounds = run.catalog, range(len(run.state["rounds"]))
    ids, links, late = None, None, None
    for nth in rounds:
        landed = run.outcomes(nth).filter("error IS NULL").select("path", F.col("vault_path").alias("place"))
        own = run.get(f"{nth}/new").select("path", "id").join(merged(landed), "path")
        kept = run.get(f"{nth}/verdicts").select("path").join(merged(_orphaned(run, nth).select("path")), "path", "left_anti")
        named = kept.withColumnRenamed("path", "original_path")
        one, two = run.get(f"{nth}/links").join(merged(named), "original_path", "left_semi"), run.get(f"{nth}/late").join(merged(named), "original_path", "left_semi")
        ids, links, late = (own, one, two) if ids is None else (ids.unionByName(own), links.unionByName(one), late.unionByName(two))
    state = run.state | {"done": True}
    if ids is None:
        catalog.commit(notes={run.name: state})
        return
    # A path that has a link keeps the one it has, and only an open entry stands in the way of another.
    links = links.join(merged(catalog.read("linked_files").select("original_path")), "original_path", "left_anti")
    late = late.join(merged(catalog.read("review_queue").filter("status = 'open'").select("original_path")), "original_path", "left_anti")
    catalog.commit({"linked_files": link_rows(catalog, links, ids, at), "review_queue": review_rows(catalog, late, ids, at)}, notes={run.name: state})


def ingest(identified: DataFrame, catalog: Catalog, vault: str, run: str, at: datetime, source: str | None = None, threshold: int = 8, chunk: int = CHUNK, after_chunk: Callable[[int, int], None] | None = None) -> DataFrame:
    """Take identified files into a vault and its index; (path, outcome, verdict, vault_path, error, filesize, undated, renamed) of every file.

    Started again under its name, a run goes on with the files it was planned for, whatever `identified` holds by then. after_chunk is told the
    round and the number of each chunk that was recorded.
    """
    own = Run(catalog, run)
    nth = 0
    while not own.state["done"]:
        if nth == len(own.state["rounds"]):
            files = identified if nth == 0 else _orphaned(own, nth - 1).select(*schemas.IDENTIFIED.names)
            if files.isEmpty():
                _finished(own, at)
                break
            _planned(own, nth, files, threshold, chunk)
        here = own.state["rounds"][nth]
        for number in range(here["n_chunks"]):
            if number not in here["chunks"]:
                _file_chunk(own, nth, number, vault, at, source)
                if after_chunk is not None:
                    after_chunk(nth, number)
        nth += 1
    return outcomes(catalog, run)


def outcomes(catalog: Catalog, run: str) -> DataFrame:
    """What a run did with every file; those whose master failed are in the round that decided on them."""
    own, found = Run(catalog, run), None
    new, linked = F.col("verdict") == dedupe.NEW, F.col("verdict").isin(dedupe.EXACT, dedupe.TWIN)
    for nth in range(len(own.state["rounds"])):
        copied = own.outcomes(nth).select(F.col("path").alias("_path"), "vault_path", "error")
        wished = own.get(f"{nth}/new").select(F.col("path").alias("_new"), F.col("original_filename").alias("_name"))
        rows = own.get(f"{nth}/verdicts").join(merged(_orphaned(own, nth).select("path")), "path", "left_anti")
        rows = rows.join(merged(copied), F.col("path") == F.col("_path"), "left").join(merged(wished), F.col("path") == F.col("_new"), "left")
        landed = F.col("vault_path").isNotNull()
        outcome = F.when(new & landed, IMPORTED).when(new & F.col("error").isNotNull(), FAILED).when(linked, LINKED).when(~new, DEFERRED)
        renamed = F.coalesce(landed & (F.element_at(F.split("vault_path", "/"), -1) != F.col("_name")), F.lit(False))
        rows = rows.select("path", outcome.alias("outcome"), "verdict", "vault_path", "error", "filesize", (landed & F.col("taken_at").isNull()).alias("undated"), renamed.alias("renamed"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return own.spark.createDataFrame([], "path string, outcome string, verdict string, vault_path string, error string, filesize bigint, undated boolean, renamed boolean")
    return found


def counts(found: DataFrame) -> DataFrame:
    """scanned, imported, linked, deferred, failed, bytes, undated, renamed, and whether every file is accounted for."""
    is_ = lambda name: F.coalesce(F.col("outcome") == name, F.lit(False))
    size = lambda name: F.coalesce(F.sum(F.when(is_(name), F.coalesce("filesize", F.lit(0)))), F.lit(0))
    parts = [F.count_if(is_(name)).alias(name) for name in (IMPORTED, LINKED, DEFERRED, FAILED)]
    sizes = [size(IMPORTED).alias("imported_bytes"), size(LINKED).alias("linked_bytes"), F.count_if("undated").alias("undated"), F.count_if("renamed").alias("renamed")]
    one = found.agg(F.count(F.lit(1)).alias("scanned"), *parts, *sizes)
    return one.withColumn("balanced", F.col(IMPORTED) + F.col(LINKED) + F.col(DEFERRED) + F.col(FAILED) == F.col("scanned"))


def errors(found: DataFrame) -> DataFrame:
    """(path, error) of the files that failed."""
    return found.filter(F.col("outcome") == FAILED).select("path", "error")
