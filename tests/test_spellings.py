import difflib
import random

import pytest
from pyspark.sql import functions as F

from photolith.operators import spellings as S


def brute(names, options, n=3, cutoff=0.6):
    out = []
    for name in {x for x in names if x is not None}:
        found = difflib.get_close_matches(name, sorted({o for o in options if o is not None}), n=n, cutoff=cutoff)
        out += [(name, k, o) for k, o in enumerate(found, 1)]
    return sorted(out)


def got(spark, names, options, **more):
    x, y = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(o,) for o in options], "option string")
    return sorted((r.name, r.rank, r.option) for r in S.closest(x, y, **more).collect())


def mangled(rng, text):
    letters = list(text)
    for _ in range(rng.randrange(3)):
        at = rng.randrange(len(letters) + 1)
        letters[at:at + rng.randrange(2)] = rng.choice(["", "x", "-", "é"])
    return "".join(letters)


@pytest.mark.parametrize("cell", [S.CELL, 7])
def test_equals_all_comparisons(spark, monkeypatch, cell):
    monkeypatch.setattr(S, "CELL", cell)
    rng = random.Random(1)
    options = [f"--{a}-{b}" for a in ("export", "skip", "only", "use", "exif", "download") for b in ("photos", "movies", "missing", "edited", "live", "raw")]
    names = [mangled(rng, rng.choice(options)) for _ in range(40)] + ["", "--", "nothing like it", "ÄÖÜ", "--raw" * 60]
    assert got(spark, names, options) == brute(names, options)
    assert got(spark, names, options, best=1, cutoff=0.9) == brute(names, options, 1, 0.9)


def test_ties_nulls_repeats_and_nothing(spark):
    options = ["abcd", "abce", "abcf", "abcg", "abcd", None, ""]
    names = ["abcx", "abcx", None, "", "zzz"]
    assert got(spark, names, options) == brute(names, options) == [("", 1, ""), ("abcx", 1, "abcg"), ("abcx", 2, "abcf"), ("abcx", 3, "abce")]
    assert got(spark, [], options) == [] == got(spark, names, [])


def test_options_of_a_help_text(spark):
    said = "usage: --dry-run, --Export [--exif-tool PATH] -x --dry-run ---"
    assert spark.range(1).select(S.options_in(F.lit(said))).head()[0] == ["--Export", "--dry-run", "--exif-tool"]
