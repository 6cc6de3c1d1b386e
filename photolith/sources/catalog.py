"""Stored tables with checked appends and atomic replacement.

A table is a list of part folders of Parquet files; one small file, the state, lists those of all tables. A writer fills new parts, checks them, and then
renames a new state over the old one, so readers see all of a change, over however many tables, or nothing of it. An append copies nothing,
and reads of what is there only the keys that new rows could break. One writer at a time: a commit is refused where the state has changed
since the commit began. Statistics are kept with the parts (`summaries`). The state also holds notes, which appear together with the rows that they speak of.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from photolith import schemas
from photolith.errors import ConflictError, SourceError
from photolith.sources import summaries


class Catalog:
    def __init__(self, spark: SparkSession, root: str, create: bool = True):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm
        if not self._fs.exists(self._path(self.root)):
            if not create:
                raise SourceError(f"no index at {self.root}")
            self._fs.mkdirs(self._path(self.root))
            self._put("_version", {"version": schemas.VERSION})
        version = self.version
        if version > schemas.VERSION:
            raise SourceError(f"the index is of version {version}, newer than {schemas.VERSION}")

    @property
    def version(self) -> int:
        return (self._get("_version") or {"version": 1})["version"]

    def _get(self, name: str) -> dict | None:
        path = self._path(f"{self.root}/{name}.json")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, value: dict) -> None:
        """Write the file aside, then put it in its place."""
        target, aside = self._path(f"{self.root}/{name}.json"), self._path(f"{self.root}/.{name}-{uuid.uuid4().hex}.json")
        stream = self._fs.create(aside, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()) if target.toUri().getScheme() else self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark.sparkContext._jsc.hadoopConfiguration())
        option = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = option
        context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(target), options)

    def _parts(self, table: str) -> list[dict]:
        return (self._get("_state") or {}).get(table, [])

    def _rows(self, table: str, parts: list[dict]) -> DataFrame:
        spec, found = schemas.TABLES[table], None
        for schema in sorted({p["schema"] for p in parts}):
            rows = self.spark.read.schema(spec.versions[schema]).parquet(*[f"{self.root}/{table}/{p['path']}" for p in parts if p["schema"] == schema])
            rows = schemas.migrate(rows, table)
            found = rows if found is None else found.unionByName(rows)
        return found if found is not None else self.spark.createDataFrame([], spec.schema)

    def read(self, table: str) -> DataFrame:
        """A table's rows in the present schema, whatever version they were written in."""
        return self._rows(table, self._parts(table))

    def _write(self, table: str, rows: DataFrame) -> dict:
        part = {"path": uuid.uuid4().hex, "schema": max(schemas.TABLES[table].versions)}
        schemas.conform(rows, schemas.TABLES[table].schema).write.parquet(f"{self.root}/{table}/{part['path']}")
        written = self._rows(table, [part])
        ids = summaries.ids(table, written)
        if ids is not None:
            ids.write.parquet(f"{self.root}/{table}/{part['path']}.ids")
        return part | {"summary": summaries.summary(table, written)}

    def commit(self, appended: dict[str, DataFrame] | None = None, replaced: dict[str, DataFrame] | None = None, checked: bool = True, notes: dict | None = None) -> None:
        """Append to and replace tables and notes, all or none of them; raises ConstraintError where a table would break its rules.

        What replaces a table's rows may be made from them. Of what is appended only the new rows are checked, against the keys that are there.
        """
        before = self._get("_state") or {}
        new = {t: [*before.get(t, []), self._write(t, rows)] for t, rows in (appended or {}).items()}
        new |= {t: [self._write(t, rows)] for t, rows in (replaced or {}).items()}
        after = before | new
        if checked:
            for table, parts in new.items():
                others = {t: self._rows(t, after.get(t, [])) for t in schemas.TABLES[table].refers.values()}
                known = self._rows(table, before[table]) if table in (appended or {}) and before.get(table) else None
                schemas.check(table, self._rows(table, parts[-1:]), others, known)
        if (self._get("_state") or {}).get("_serial", 0) != before.get("_serial", 0):
            raise ConflictError(f"the index at {self.root} was changed meanwhile")
        self._put("_state", after | {"_serial": before.get("_serial", 0) + 1, "_notes": before.get("_notes", {}) | (notes or {})})

    def note(self, name: str):
        """What the last commit that had a note of this name said, or None."""
        return (self._get("_state") or {}).get("_notes", {}).get(name)

    def _kept(self, table: str) -> list[dict]:
        """The summaries of a table's parts; a part that was written without one is read."""
        return [p["summary"] if "summary" in p else summaries.summary(table, self._rows(table, [p])) for p in self._parts(table)]

    def stats(self) -> DataFrame:
        """The row of `operators.stats.index_stats`, from what is kept with the parts; no table is read."""
        table = "asset_persons"
        paths = [f"{self.root}/{table}/{p['path']}.ids" for p in self._parts(table) if "summary" in p]
        old = [p for p in self._parts(table) if "summary" not in p]
        bits = self.spark.read.schema("bucket bigint, bits binary").parquet(*paths) if paths else None
        if old:
            more = summaries.ids(table, self._rows(table, old))
            bits = more if bits is None else bits.unionByName(more)
        tagged = summaries.distinct(bits).head()[0] if bits is not None else 0
        return summaries.one_row(self.spark, {t: self._kept(t) for t in ("assets", "linked_files", "review_queue", "sources")}, tagged)

    def open_reviews_by_kind(self) -> dict[str, int]:
        """How many open reviews each kind has, from what is kept."""
        out: dict[str, int] = {}
        for (status, kind), n in summaries.grouped(self._kept("review_queue")).items():
            if status == "open":
                out[kind] = out.get(kind, 0) + n
        return out

    def links_by_reason(self) -> dict[str, int]:
        return {reason: n for (reason,), n in summaries.grouped(self._kept("linked_files")).items()}

    def append(self, table: str, rows: DataFrame, checked: bool = True) -> None:
        """Add rows; raises ConstraintError, and adds nothing, where the table would break its rules."""
        self.commit(appended={table: rows}, checked=checked)

    def replace(self, table: str, rows: DataFrame, checked: bool = True) -> None:
        """Put rows in the place of all that are there; they may be made from them."""
        self.commit(replaced={table: rows}, checked=checked)
