"""The copy contract: which library items may be shared, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolith.config import Contract, Family
from photolith.functions import text

#: All dispositions, in reporting order.
DISPOSITIONS = ("INCLUDE_PRE_CUTOFF", "INCLUDE_TAGGED", "EXCLUDE_NOT_OWNED", "EXCLUDE_ALBUM", "EXCLUDE_SCREENSHOT", "EXCLUDE_UNTAGGED", "REVIEW_UNKNOWN_DATE")
INCLUDED = DISPOSITIONS[:2]
REVIEW = "REVIEW_UNKNOWN_DATE"


def window_end(contract: Contract):
    return F.add_months(F.lit(contract.cutoff), contract.window_months)


def decide(items: DataFrame, contract: Contract, family: Family) -> DataFrame:
    """`items` with matched_subjects, disposition and in_untagged_window.

    The first rule that applies wins: not owned; trash, hidden or an excluded album; no date; before the cutoff; a
    screenshot; a subject tagged; untagged. Null flags count as false, except that an unknown owner isn't the
    contributor. A projection: no shuffle, no Python.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    taken = F.to_date("date")
    found = items.withColumn("matched_subjects", text.subjects_in(F.col("persons"), family))
    rules = [
        (F.coalesce(F.col("is_shared"), F.lit(True)) if contract.exclude_not_owned else F.lit(False), "EXCLUDE_NOT_OWNED"),
        (flag("in_trash") | flag("is_hidden") | text.has_any(F.col("albums"), contract.exclude_albums), "EXCLUDE_ALBUM"),
        (F.col("date").isNull(), REVIEW),
        (taken < F.lit(contract.cutoff), "INCLUDE_PRE_CUTOFF"),
        (flag("is_screenshot") if contract.exclude_screenshots else F.lit(False), "EXCLUDE_SCREENSHOT"),
        (F.size("matched_subjects") > 0, "INCLUDE_TAGGED"),
    ]
    ruling = F.when(*rules[0][:1], rules[0][1])
    for condition, name in rules[1:]:
        ruling = ruling.when(condition, name)
    found = found.withColumn("disposition", ruling.otherwise("EXCLUDE_UNTAGGED"))
    return found.withColumn("in_untagged_window", F.coalesce((F.col("disposition") == "EXCLUDE_UNTAGGED") & (taken < window_end(contract)), F.lit(False)))


def selected(decisions: DataFrame) -> DataFrame:
    """The uuids of what may be copied."""
    return decisions.filter(F.col("disposition").isin(*INCLUDED)).select("uuid")
