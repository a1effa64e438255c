import os

import pytest
from pyspark.sql import functions as F

from trackspark.functions import formats, names, paths

NAMES = [
    ("Artist - Title", "Artist", "Title"),
    ("01 - Artist - Title (Live)", "01", "Artist - Title"),
    ("A-ha - Take On Me [1985]", "A", "ha - Take On Me"),
    ("Foo - Bar - 2020", "Foo", "Bar"),
    ("- Title", "Unknown Artist", "Title"),
    ("x -", "x", "x -"),
    ("No dash", "Unknown Artist", "No dash"),
    ("track-01 Foo", "track", "01 Foo"),
    ("a - b", "a", "b"),
]


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_parsed_names(spark):
    got = column(spark, [f"/m/{n}.mp3" for n, _, _ in NAMES], names.parsed_name("v"))
    assert [(r.artist, r.title) for r in got] == [(a, t) for _, a, t in NAMES]
    assert got[0].filename == "Artist - Title.mp3"
    assert (got[0].duration, got[0].similarity) == ("--:--", 0.0)


def test_track_numbers(spark):
    got = column(spark, ["/m/01 - Artist - Title.mp3", "/m/A - B.mp3"], names.parsed_name("v", True))
    assert (got[0].track_num, got[0].artist, got[0].title) == ("01", "Artist", "Title")
    assert (got[1].track_num, got[1].artist, got[1].title) == (None, "A", "B")


PATHS = ["/a/b.MP3", "b", "/a/.hid", "/a/..x", "/a/x.", "/a.b/c", "/a/t.tar.gz", "/a/", "", ".a.b"]


def test_stem_agrees_with_python(spark):
    want = [os.path.splitext(os.path.basename(p))[0] for p in PATHS]
    assert column(spark, PATHS, paths.stem("v")) == want
    assert column(spark, PATHS, paths.base_name("v")) == [os.path.basename(p) for p in PATHS]


def test_suffix_and_keys(spark):
    assert column(spark, ["/a/b.MP3", "b", "/a/.hid", "/x/t.tar.gz"], paths.suffix("v")) == [".mp3", "", "", ".gz"]
    assert column(spark, ["/a/b.M4A", "c.mp4", "d.mp3"], paths.needs_transcode("v")) == [True, True, False]
    assert column(spark, ["abc"], paths.path_key("v")) == ["900150983cd24fb0d6963f7d28e17f72"]
    assert column(spark, ["abc"], paths.short_path_key("v")) == ["900150983cd2"]
    assert column(spark, ["file:/a/b", "file:///a/b", "hdfs://h/a", "/a"], paths.local_path("v")) == [
        "/a/b", "/a/b", "hdfs://h/a", "/a",
    ]
    assert column(spark, ["  a b\t\n"], paths.strip("v")) == ["a b"]


def test_durations(spark):
    v = [None, float("nan"), 0.0, 65.9, 3661.0, 59.999]
    assert column(spark, v, formats.duration_text("v"), "double") == ["--:--", "--:--", "0:00", "1:05", "61:01", "0:59"]
    assert column(spark, [-1.0, 0.0, 65.9], formats.clock_text("v"), "double") == ["0:00", "0:00", "1:05"]
    assert column(spark, [None, float("nan"), 3661.0], formats.clock_text("v"), "double") == ["0:00", "0:00", "61:01"]


def test_percent_and_band(spark):
    v = [0.625, 0.635, 1.0, -0.003, 0.7, 0.71, 0.5, 0.51]
    want = [f"{x * 100:.0f}%" for x in v]
    want[3] = "0%"
    assert column(spark, v, formats.percent_text("v"), "double") == want
    assert column(spark, v[4:], formats.band("v"), "double") == ["yellow", "green", "red", "yellow"]


@pytest.mark.parametrize("n", [50, 51])
def test_ellipsis(spark, n):
    t = "x" * n
    assert column(spark, [t], formats.ellipsis("v", 50)) == [t if n == 50 else "x" * 47 + "..."]
    assert column(spark, ["y" * 36], formats.ellipsis("v", 35, 35)) == ["y" * 35 + "..."]


def test_tag_defaults(spark):
    catalog = spark.createDataFrame([("/a/1.mp3",), ("/a/2.mp3",), ("/a/3.mp3",)], "file_path string")
    tags = spark.createDataFrame(
        [("/a/1.mp3", "T", None, "L"), ("/a/2.mp3", None, "R", None)],
        "file_path string, title string, artist string, album string",
    )
    got = {r.file_path: (r.title, r.artist, r.album) for r in names.with_tags(catalog, tags).collect()}
    assert got == {
        "/a/1.mp3": ("T", "Unknown Artist", "L"),
        "/a/2.mp3": ("2.mp3", "R", "Unknown Album"),
        "/a/3.mp3": ("Unknown Title", "Unknown Artist", "Unknown Album"),
    }
    assert F  # imported for interactive use
