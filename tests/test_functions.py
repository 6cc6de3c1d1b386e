import math
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photolith import config, schemas
from photolith.errors import ConfigError, ConstraintError
from photolith.functions import dates, paths, text, values


def each(spark, kind, inputs, fn):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("x", schemas._TYPES[kind] if kind != "date" else T.DateType())]))
    return [r[0] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_tags(spark):
    raw = ["  Sub   ONE\t", "a  b", "x\x1cy", "", None, "Straße"]
    assert each(spark, "string", raw, text.normalize_tag) == ["sub one", "a b", "x y", "", None, "strasse"]
    assert each(spark, "string", ["a; b;;  ;c ", "", None], text.split_names) == [["a", "b", "c"], [], []]
    assert each(spark, "array<string>", [["a", None, " ", "b "], None], text.real_names) == [["a", "b "], []]
    family = config.Family((config.Subject("One", ("Uno",)), config.Subject("Two")))
    assert each(spark, "array<string>", [["two", "UNO ", "one", "x"], [], None, [None]], lambda c: text.subjects_in(c, family)) == [["One", "Two"], [], [], []]
    assert each(spark, "array<string>", [["Trips"], ["recently  deleted"], None], lambda c: text.has_any(c, ("Hidden", "Recently Deleted"))) == [False, True, False]


def test_case_is_folded_as_python_folds_it(spark):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    raw = ["".join(every[a : a + 4096]) for a in range(0, len(every), 4096)] + [f"a{c}B" for c in every if len(c.casefold()) > 1] + ["ΟΔΟΣ ΟΔΟΣ", "İstanbul ISTANBUL", "ﬃ ﬆ ŉ"]
    assert each(spark, "string", raw, text.fold_case) == [x.casefold() for x in raw]


def test_names_outside_ascii_are_found(spark):
    family = config.Family((config.Subject("Jo Strauß", ("ΟΔΥΣΣΕΥΣ", "İlker", "ﬁnn")),))
    tags = ["jo  STRAUSS", "Jo Strauß", "οδυσσευς", "i̇lker", "FINN", "Jo Straus"]
    assert each(spark, "string", tags, lambda c: text.subject_of(c, family)) == ["Jo Strauß"] * 5 + [None]
    assert each(spark, "array<string>", [["x", " STRASSE "], ["Straße"], ["Strase", None]], lambda c: text.has_any(c, ("Straße",))) == [True, True, False]
    assert config.fold_tag(" ẞ \x1c Σ") == "ss σ"


def test_dates(spark):
    at = datetime(2015, 6, 15, 12, 0, 1)
    raw = ["2015:06:15 12:00:01", " 2015-06-15T12:00:01.5+02:00", "0000:00:00 00:00:00", "2015:02:30 10:00:00", "2015:06:15 24:00:00", "2015:06:15 23:59:60", "x", "", None]
    assert each(spark, "string", raw, dates.parse_embedded) == [at, at] + [None] * 7
    iso = ["2015-06-15T12:00:01", "2015-06-15T12:00:01-07:00", "2015-06-15 12:00:01Z", "2015-06-15", "20150615T120001", "20150615", "2015-06-15T12", "2015-06-15T12:00:01.250000+05:30", "2015", "2015-13-01", "nope", None]
    day = datetime(2015, 6, 15)
    want = [at, at, at, day, at, day, day.replace(hour=12), at.replace(microsecond=250000), None, None, None, None]
    assert each(spark, "string", iso, dates.parse_iso) == want
    for x, w in zip(iso[:-1], want, strict=False):
        try:
            own = datetime.fromisoformat(x).replace(tzinfo=None)
        except ValueError:
            own = None
        assert own == w, x
    assert each(spark, "string", ["2015:06:15 12:00:01"], dates.parse_sidecar) == [at]
    assert each(spark, "timestamp_ntz", [datetime(1970, 5, 5), at, None], dates.known_date) == [None, at, None]
    assert each(spark, "timestamp_ntz", [at, None], dates.month_directory) == ["2015/06", "undated"]


def test_paths(spark):
    import pathlib

    raw = ["a/b.JPG", "b.tar.gz", ".hidden", "a.b/c", "..jpg", "x.", "", "d/IMG 1.Mov"]
    assert each(spark, "string", raw, paths.suffix) == [pathlib.PurePosixPath(x).suffix if x != "x." else "" for x in raw]
    assert each(spark, "string", raw, paths.stem) == ["b", "b.tar", ".hidden", "c", ".", "x.", "", "IMG 1"]
    kept = {"a.jpg": True, ".Trashes/501/a.jpg": False, "$RECYCLE.BIN/a.jpg": False, "x/.y/a.mov": False, "x/.a.jpg": False, "x/a.txt": False, "System Volume Information/a.png": False, "x/y/a.HEIC": True, "_z/_a.png": True}
    assert each(spark, "string", list(kept), paths.is_content) == list(kept.values())
    assert each(spark, "string", ["d/a.jpg"], paths.sidecars) == [["d/a.jpg.json", "d/a.json", "d/a.jpg.xmp", "d/a.xmp", "d/a.jpg.aae", "d/a.aae"]]
    assert each(spark, "string", [" Screenshot 1.png", "Simulator Screen Shot x", "IMG", None], paths.looks_like_screenshot) == [True, True, False, False]


def test_hamming(spark):
    rows = [("de8f2130da8607f9", "de8f2130da8607f8", 1), ("0" * 16, "f" * 16, 64), ("", "", 999), ("ab", "abc", 999), ("zz", "zz", 999), (None, "00", 999), ("0" * 32, "f" * 31 + "e", 127)]
    df = spark.createDataFrame(rows, "a string, b string, want int")
    assert all(r.got == r.want for r in df.select("want", values.hamming(F.col("a"), F.col("b")).alias("got")).collect())


def test_values(spark):
    smaller = [(10, 10, 5, 20, 20, 9, True), (10, 20, 5, 20, 20, 9, False), (10, 10, 9, 20, 20, 9, False), (None, 10, 5, 20, 20, 9, False), (0, 10, 5, 20, 20, 9, False), (10, 10, 5, 0, 20, 9, False)]
    df = spark.createDataFrame(smaller, "w int, h int, s int, mw int, mh int, ms int, want boolean")
    assert all(r.want == r.got for r in df.select("want", values.strictly_smaller(*[F.col(c) for c in ("w", "h", "s", "mw", "mh", "ms")]).alias("got")).collect())
    lat, lon = values.coordinates(F.col("x"), F.col("y"))
    df = spark.createDataFrame([("37.5", "-122"), ("0", "0.0"), ("91", "0"), ("1", None), ("x", "1"), ("0", "5")], "x string, y string")
    assert [tuple(r) for r in df.select(lat, lon).collect()] == [(37.5, -122.0), (None, None), (None, None), (None, None), (None, None), (0.0, 5.0)]
    assert each(spark, "string", ["5", "0", "-1", "x", None], values.positive_int) == [5, None, None, None, None]
    gaps = [0.0, 1200.0, 3600.0, 21589.0, 21590.0, 21600.0, 30000.0]
    want = [0.0 if g >= 21600 else round(1 - g / 21600, 3) for g in gaps]
    assert each(spark, "double", gaps, values.confidence) == want and want[3] > 0 == want[4]
    assert each(spark, "string", ['{"k": 1}', "[1]", "{bad", None], lambda c: F.to_json(values.detail_map(c))) == ['{"k":"1"}', "{}", "{}", "{}"]
    assert each(spark, "bigint", [0, 1023, 1024, 1536 * 1024, 1 << 50, -2048], values.format_size) == ["0 B", "1,023 B", "1.0 KB", "1.5 MB", "1,024.0 TB", "-2.0 KB"]
    assert each(spark, "date", [date(2015, 1, 31), date(2015, 1, 1)], lambda c: F.add_months(c, 1)) == [date(2015, 2, 28), date(2015, 2, 1)]
    assert each(spark, "double", [0.001, 0.5, 3.25, 48.0], values.format_duration) == ["under a minute", "30 minutes", "3.2 hours", "2.0 days"]
    assert each(spark, "bigint", [1, 3, 1200], lambda c: values.plural(c, "item")) == ["1 item", "3 items", "1,200 items"]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ends = spark.createDataFrame([(datetime(2024, 3, 10, 1, 30), datetime(2024, 3, 10, 3, 30, 0, 250000)), (datetime(2024, 3, 12), datetime(2024, 3, 9))], "a timestamp_ntz, b timestamp_ntz")
        assert [r[0] for r in ends.select(values.gap_seconds(F.col("a"), F.col("b"))).collect()] == [7200.25, 3 * 86400.0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert math.isclose(each(spark, "bigint", [25_000_000 * 450], values.download_hours)[0], 1.0) and timedelta(hours=1)


GOOD = """
[family]
subjects = [{name = "One", tags = ["Uno"], quota = 3}, {name = "Two"}]
adults = [{name = "Ann", requires_subject = false}]
[contribute]
cutoff_date = 2015-01-01
[ingest]
phash_threshold = 4
"""


def test_config(tmp_path):
    file = tmp_path / "config.toml"
    file.write_text(GOOD)
    found = config.load(config.find(tmp_path))
    assert found.contract.cutoff == date(2015, 1, 1) and found.contract.window_months == 18 and found.ingest.threshold == 4
    assert found.family.by_tag() == {"one": "One", "uno": "One", "two": "Two"} and not found.family.adults[0].requires_subject
    assert found.index_path == tmp_path / "index" and found.enrich.window_hours == 6.0


@pytest.mark.parametrize("old, new", [
    ("[family]", "[nothing]"), ('{name = "Two"}', '{name = " one "}'), ('{name = "Two"}', '{name = "Two", tags = ["UNO"]}'), ('{name = "Two"}', "{quota = 1}"), ("quota = 3", "quota = -1"),
    ("cutoff_date = 2015-01-01", ""), ("cutoff_date = 2015-01-01", 'cutoff_date = "soon"'), ("phash_threshold = 4", "phash_threshold = 65"), ("phash_threshold = 4", "guess_missing_dates = true"),
    ("[ingest]", '[vault]\nlayout = "flat"\n[ingest]'), ("[ingest]", "[enrich]\ninfer_locations = true\n[ingest]"), ("[ingest]", "[enrich]\nlocation_window_hours = 0\n[ingest]"), ("[family]", "[family"),
    ("[ingest]", '[vault]\npath = "/v"\nmirror_path = "/v"\n[ingest]'), ("[contribute]", "[contribute]\nuntagged_report_months = -1"),
])
def test_config_refusals(tmp_path, old, new):
    file = tmp_path / "config.toml"
    file.write_text(GOOD.replace(old, new))
    with pytest.raises(ConfigError):
        config.load(file)


def test_all_faults_are_named_at_once(tmp_path):
    file = tmp_path / "config.toml"
    file.write_text('[family]\nsubjects = [{name = "A"}, 7]\n[vault]\nlayout = "flat"\n[ingest]\nphash_threshold = true\n')
    with pytest.raises(ConfigError) as error:
        config.load(file)
    assert all(x in str(error.value) for x in ("without a name", "layout", "phash_threshold", "cutoff_date"))
    file.write_text(GOOD + '[vault]\npath = ""\n[index]\npath = "/there/index"\n')
    assert config.load(file).vault.path is None and str(config.load(file).index_path) == "/there/index"


def test_schemas(spark):
    v1 = spark.createDataFrame([], schemas.ASSETS_V1)
    assert schemas.migrate(v1, "assets").schema.names == schemas.ASSETS.names
    rows = spark.createDataFrame([(1, "a"), (2, "a")], "id bigint, name string")
    with pytest.raises(ConstraintError):
        schemas.check("persons", rows)
    with pytest.raises(ConstraintError):
        schemas.check("asset_persons", spark.createDataFrame([(1, 9, "manifest")], schemas.ASSET_PERSONS), {"persons": rows})
    with pytest.raises(ConstraintError):
        schemas.conform(rows, schemas.ASSETS)
    assert schemas.missing_columns(rows, ("id", "kind")) == ["kind"]


def test_white_space_of_every_kind_is_stripped(spark):
    from photolith.functions import dates, paths, text

    rows = [("\tScreenshot 1.png", True), (" SCREEN SHOT.png", True), (" \nscreenshot", True), ("my screenshot.png", False), ("​screenshot.png", False), (None, False)]
    df = spark.createDataFrame(rows, "name string, want boolean")
    assert all(r.got == r.want for r in df.select(paths.looks_like_screenshot(F.col("name")).alias("got"), "want").collect())
    stamps = spark.createDataFrame([("\t2015:06:15 12:00:00",), (" 2015-06-15T12:00:00\r\n",), ("\x1f2015:06:15 12:00:00\x85",)], "s string")
    assert {str(r[0]) for r in stamps.select(dates.parse_embedded(F.col("s"))).collect()} == {"2015-06-15 12:00:00"}
    assert {str(r[0]) for r in stamps.limit(2).select(dates.parse_sidecar(F.col("s"))).collect()} == {"2015-06-15 12:00:00"}
    assert spark.range(1).select(text.strip(F.lit(" \t a b 　"))).head()[0] == "a b"


def test_only_one_whole_json_object_is_read(spark):
    from photolith.functions import values

    said = ['{"a": 1, "b": {"c": 2}}', " {} \n", "{'a': 1}", '{"a": 1} x', '{"a": 1},{"a": 2}', '{"a":1}],[{}', '{"a":1},"mark":0} {', "[1]", '"a"', "null", "", None, "{a: 1}", '{"a": 1']
    df = spark.createDataFrame(list(enumerate(said)), "i int, s string")
    got = [r.m for r in df.select("i", values.detail_map(F.col("s")).alias("m")).orderBy("i").collect()]
    assert got[0] == {"a": "1", "b": '{"c":2}'} and all(m == {} for m in got[1:])


def test_sidecars_are_strict_and_of_any_size(tmp_path):
    import json

    from photolith.sources import files

    def read(content):
        (tmp_path / "s.json").write_text(content, encoding="utf-8")
        return files._sidecar(str(tmp_path / "s.json"))

    assert read(json.dumps({"date": "2020-01-01", "albums": ["a", None, 3], "persons": "Trey"})) == ("2020-01-01", "a; 3", "Trey")
    assert read("{'date':'2020-01-01'}") == read('{"date":"2020-01-01"} x') == read("[1]") == read("") == read("[" * 100_000) == ("", "", "")
    assert read(json.dumps({"date": None, "albums": [], "persons": None})) == ("", "", "")
    large = {"date": "2020-01-01", "persons": ["Trey"], "more": "x" * (20 << 20)}
    assert read(json.dumps(large)) == ("2020-01-01", "", "Trey")
    assert files._sidecar(str(tmp_path / "none.json")) == ("", "", "")
