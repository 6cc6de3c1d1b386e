"""Names, tags and lists of names."""

from __future__ import annotations

import sys
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from photolith.config import Family, fold_tag

#: Unicode white space and the four separators that count with it in tags.
BLANKS = r"(?U)[\s\x1c-\x1f]+"


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Unicode case folding: characters that become one other character, those in the same order, and those that become several."""
    whole = [chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    changed = {c: c.casefold() for c in whole if c.casefold() != c}
    single = {c: f for c, f in changed.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in changed.items() if len(f) > 1}


def _bound(value: Column, fn) -> Column:
    """`fn` of a value that is computed once, however often `fn` names it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def fold_case(value: Column) -> Column:
    """The text with its case folded: `ß` and `SS` alike, `ς` and `Σ`, ligatures as their letters.

    ASCII texts are only lower-cased. In others, characters are translated one for one, and those that fold to several
    letters are looked up, where a text has any.
    """
    source, target, several = _folds()
    longer = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    any_longer = "[" + "".join(several) + "]"

    def spelled(x: Column) -> Column:
        letters = F.transform(F.split(x, ""), lambda c: F.coalesce(F.try_element_at(longer, c), c))
        return F.when(x.rlike(any_longer), F.array_join(letters, "")).otherwise(x)

    def folded(x: Column) -> Column:
        lowered = F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + source, "abcdefghijklmnopqrstuvwxyz" + target)
        return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(_bound(lowered, spelled))

    return _bound(value, folded)


def strip(value: Column) -> Column:
    """The text without white space at either end, whatever kind it is; Spark's `trim` knows spaces only."""
    return F.regexp_replace(value, rf"^{BLANKS}|{BLANKS}$", "")


def normalize_tag(tag: Column) -> Column:
    """White space collapsed and trimmed, case folded; the column form of `config.fold_tag`."""
    spaced = F.trim(F.regexp_replace(tag, BLANKS, " "))
    return F.when(F.octet_length(tag) == F.length(tag), F.lower(spaced)).otherwise(fold_case(spaced))


def split_names(value: Column) -> Column:
    """The names of a `; `-joined list, trimmed, without empty ones; null: none."""
    trimmed = F.transform(F.split(F.coalesce(value, F.lit("")), ";"), strip)
    return F.filter(trimmed, lambda x: x != "")


def join_names(names: Column) -> Column:
    return F.array_join(names, "; ")


def _listed(names: Column) -> Column:
    return F.coalesce(names, F.array().cast("array<string>"))


def real_names(names: Column) -> Column:
    """A list of names without null and blank ones, in the spelling they have; null: none."""
    return F.filter(_listed(names), lambda x: x.isNotNull() & (F.regexp_replace(x, BLANKS, "") != ""))


def subject_of(tag: Column, family: Family) -> Column:
    """The subject that a person tag names, or null."""
    spelled = family.by_tag()
    if not spelled:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in spelled.items() for x in pair]), normalize_tag(tag))


def subjects_in(persons: Column, family: Family) -> Column:
    """The subjects among person tags, each once, in roster order."""
    named = F.filter(F.transform(_listed(persons), lambda p: subject_of(p, family)), lambda x: x.isNotNull())
    roster = F.array(*[F.lit(s.name) for s in family.subjects]).cast("array<string>")
    return F.array_intersect(roster, named)


def has_any(tags: Column, unwanted) -> Column:
    """Whether any of the tags, normalised, is among `unwanted`, normalised alike; null tags are none of them."""
    if not unwanted:
        return F.lit(False)
    listed = F.array(*[F.lit(fold_tag(str(x))) for x in unwanted])
    return F.arrays_overlap(F.transform(F.filter(_listed(tags), lambda t: t.isNotNull()), normalize_tag), listed)
