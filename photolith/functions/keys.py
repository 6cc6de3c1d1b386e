"""Join keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores after them where `df` has them already, for helper columns beside a caller's own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def merged(df: DataFrame) -> DataFrame:
    """`df` for a join in which it must not be sent whole: it grows with the files of a run, and what is sent to all tasks goes through the driver first."""
    return df.hint("merge")


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """`df` with its partitioning by a text key forgotten.

    What was just aggregated by a key is partitioned by it, and a join would keep that partitioning, in which AQE can't split a
    key that the other side has very often. Dealt anew on both sides, it can.
    """
    return df.withColumn(key, F.concat(F.col(key), F.lit("")))
