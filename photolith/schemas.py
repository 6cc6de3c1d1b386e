"""Schemas of the stored and the passing tables, with their versions and keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from photolith.errors import ConstraintError
from photolith.functions.keys import merged


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(text: str) -> T.StructType:
    """Fields as `name type [not null]`; Spark's own parser would need a session on import."""
    fields = [f.split() for f in text.split(", ")]
    return T.StructType([T.StructField(f[0], _TYPES[f[1]], f[2:] != ["not", "null"]) for f in fields])


LIBRARY_ITEMS = _struct(
    "uuid string not null, original_filename string not null, date timestamp_ntz, persons array<string>, albums array<string>, is_screenshot boolean, is_hidden boolean, "
    "in_trash boolean, is_shared boolean, is_photo boolean, is_movie boolean, is_live_photo boolean, is_missing boolean, filesize bigint, path string"
)
ASSETS_V1 = _struct(
    "id bigint not null, sha256 string not null, phash string, vault_path string not null, original_filename string not null, taken_at timestamp_ntz, taken_at_source string not null, "
    "media_type string not null, filesize bigint not null, width int, height int, imported_at timestamp not null, source_id bigint"
)
ASSETS = T.StructType([*ASSETS_V1.fields, *_struct("gps_latitude double, gps_longitude double, gps_source string").fields])
IDENTIFIED = _struct("path string, rel_path string, sha256 string, filesize bigint, phash string, taken_at timestamp_ntz, taken_at_source string, width int, height int, gps_latitude double, gps_longitude double")
MANIFEST = _struct("path string, date string, albums string, persons string, size_bytes bigint, sha256 string")
SOURCES = _struct("id bigint, label string, kind string, ingested_at timestamp")
LINKED_FILES = _struct("id bigint, sha256 string, original_path string, master_asset_id bigint, reason string, filesize bigint, seen_at timestamp")
REVIEW_QUEUE = _struct("id bigint, asset_id bigint, original_path string, kind string, detail string, status string, resolution string, created_at timestamp, resolved_at timestamp")
PERSONS = _struct("id bigint, name string")
ASSET_PERSONS = _struct("asset_id bigint, person_id bigint, source string")
DERIVATIVES = _struct("id bigint, master_asset_id bigint, kind string, location string, created_at timestamp")
ENRICHMENTS = _struct("id bigint, asset_id bigint, kind string, value string, source string, confidence double, created_at timestamp")


@dataclass(frozen=True)
class Table:
    """A stored table: schema by version, keys that are unique, and columns that refer to another table's id."""

    versions: dict[int, T.StructType]
    unique: tuple[tuple[str, ...], ...]
    refers: dict[str, str]

    @property
    def schema(self) -> T.StructType:
        return self.versions[max(self.versions)]


VERSION = 2
TABLES = {
    "sources": Table({1: SOURCES}, (("id",), ("label",)), {}),
    "assets": Table({1: ASSETS_V1, 2: ASSETS}, (("id",), ("sha256",), ("vault_path",)), {"source_id": "sources"}),
    "linked_files": Table({1: LINKED_FILES}, (("id",),), {"master_asset_id": "assets"}),
    "review_queue": Table({1: REVIEW_QUEUE}, (("id",),), {"asset_id": "assets"}),
    "persons": Table({1: PERSONS}, (("id",), ("name",)), {}),
    "asset_persons": Table({1: ASSET_PERSONS}, (("asset_id", "person_id"),), {"asset_id": "assets", "person_id": "persons"}),
    "derivatives": Table({1: DERIVATIVES}, (("id",),), {"master_asset_id": "assets"}),
    "enrichments": Table({2: ENRICHMENTS}, (("id",), ("asset_id", "kind", "value")), {"asset_id": "assets"}),
}


def missing_columns(df: DataFrame, required) -> list[str]:
    """Which of the columns `df` lacks; a source that lost one must fail loudly, not be read with defaults."""
    return [c for c in (required.names if isinstance(required, T.StructType) else required) if c not in df.columns]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """`df` with the schema's columns in order, those it lacks as typed nulls; a lacking column that must not be null raises."""
    absent = [f.name for f in schema if f.name not in df.columns and not f.nullable]
    if absent:
        raise ConstraintError(f"missing columns: {', '.join(absent)}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def migrate(df: DataFrame, table: str, to: int = VERSION) -> DataFrame:
    """Rows of an older version of a table in the version `to`."""
    versions = TABLES[table].versions
    return conform(df, versions[max(v for v in versions if v <= to)])


def duplicate_keys(df: DataFrame, key) -> DataFrame:
    """Keys that are there more than once, and how often."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(df: DataFrame, column: str, target: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose reference points nowhere; a null refers to nothing and is fine."""
    return df.filter(F.col(column).isNotNull()).join(merged(target.select(F.col(id_col).alias("_id"))), F.col(column) == F.col("_id"), "left_anti")


def check(table: str, df: DataFrame, others: dict[str, DataFrame] | None = None, known: DataFrame | None = None) -> None:
    """Raise a ConstraintError where rows break a key, a reference or a not-null rule.

    known: rows that were checked before; only their keys are read, and only the new rows are checked against them.
    """
    spec = TABLES[table]
    required = [f.name for f in spec.schema if not f.nullable]
    if required and not df.filter(" OR ".join(f"{c} IS NULL" for c in required)).isEmpty():
        raise ConstraintError(f"{table}: null in one of {', '.join(required)}")
    for key in spec.unique:
        again = known is not None and not known.select(*key).join(merged(df.select(*key)), list(key), "left_semi").isEmpty()
        if again or not duplicate_keys(df, key).isEmpty():
            raise ConstraintError(f"{table}: {', '.join(key)} is not unique")
    for column, target in spec.refers.items():
        if others and target in others and not orphans(df, column, others[target]).isEmpty():
            raise ConstraintError(f"{table}: {column} refers to rows that {target} doesn't have")
