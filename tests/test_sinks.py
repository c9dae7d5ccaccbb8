import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.functions import formats, geometry
from pointmill.operators import measure
from pointmill.operators.quality import Frame
from pointmill.sinks import geotiff, parts, report
from pointmill.sinks import las as las_sink
from pointmill.sources import las, scan


def cloud(spark, n, colour=True):
    rng = random.Random(n)
    rows = [(k * 3 + 1, rng.randrange(-50_000, 50_000) / 1000, rng.randrange(0, 9_000) / 1000, rng.randrange(-40_000, 40_000) / 1000, k % 7, rng.randrange(1, 4), 3, k % 5, k % 256) for k in range(n)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double, classification int, return_number int, number_of_returns int, point_source_id int, r int").withColumns({"g": F.col("r"), "b": F.col("r")})
    return rows, df if colour else df.drop("r", "g", "b")


@pytest.mark.parametrize("name", ["las_points", "las_tiles"])
def test_scene_files_keep_their_frame(spark, monkeypatch, name):
    """A scene whose middle lies nearer to the next thousand is read where it was written."""
    from pointmill import queries

    df = cloud(spark, 200)[1].withColumns({"x": F.col("x") + 900, "z": F.col("z") + 1700, "intensity": F.lit(7.0)})
    monkeypatch.setattr(queries, "points", lambda *_: df)
    key = lambda d: sorted(tuple(r) for r in d.select(*(F.round(c, 6) for c in "xyz")).collect())
    assert key(queries.QUERIES[name](spark, "")) == key(df)


@pytest.mark.parametrize("chunk", [7, 1_000_000])
def test_one_las_file_of_many_writers(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(las_sink, "CHUNK", chunk)
    rows, df = cloud(spark, 500)
    path = str(tmp_path / "a.las")
    assert las_sink.write_las(df.repartition(5), f"file://{path}", (500.0, 10.0, -700.0)) == 500
    raw = (tmp_path / "a.las").read_bytes()
    h = las.parse_header(raw[:375])
    assert len(raw) == h.offset + 500 * h.stride and struct.unpack_from("<15Q", raw, 255)[:3] == tuple(sum(r[5] == k for r in rows) for k in (1, 2, 3))
    back = scan.read_scan(spark, path).orderBy("pid").collect()
    ox, oy, oz = las.scan_info(path)["origin"]
    for r, b in zip(rows, back, strict=True):  # in the order of pid, without a gap
        assert (b["x"] + ox, b["y"] + oy, b["z"] + oz) == pytest.approx((r[1] + 500, r[2] + 10, r[3] - 700), abs=2e-3) and (b["classification"], b["return_number"], b["r"]) == (r[4], r[5], r[8])
    assert not list(tmp_path.glob("*.tmp"))
    assert las_sink.write_las(df.limit(0), path) == 0 and las.parse_header((tmp_path / "a.las").read_bytes()).count == 0


def test_las_files_by_tiles(spark, tmp_path):
    rows, df = cloud(spark, 600, colour=False)
    made = las_sink.write_las_tiles(df, str(tmp_path / "t"), 30.0, (100.0, 0.0, 0.0), per_file=60).collect()
    assert sum(r["n"] for r in made) == 600 and len({r["path"] for r in made}) == len(made) and {r["slice"] for r in made} > {0}
    for r in made:
        with open(r["path"], "rb") as f:
            h = las.parse_header(f.read(375))
        assert h.count == r["n"] and h.low[0] == pytest.approx(r["min_x"] + 100) and h.format == 6
    back = scan.read_scan(spark, str(tmp_path / "t"))
    o = las.scan_info(str(tmp_path / "t"))["origin"]
    got = sorted((round(r["x"] + o[0] - 100, 3), round(r["y"] + o[1], 3), round(r["z"] + o[2], 3), r["classification"]) for r in back.collect())
    assert got == sorted((r[1], r[2], r[3], r[4]) for r in rows)


def test_las_on_other_filesystems_needs_joining(spark, tmp_path, monkeypatch):
    """Where the filesystem can't join parts, the error names the way that works."""
    from pyarrow import fs

    _, df = cloud(spark, 20)
    monkeypatch.setattr(parts, "placed", lambda path: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), path))
    (tmp_path / "a.las.parts").mkdir()
    at = spark.createDataFrame([(0, bytearray(b"abc"))], "at long, bytes binary")
    with pytest.raises(ValueError, match="folder of files"):
        parts.assemble(at, str(tmp_path / "a.las"), b"head", 7)


def tags_of(raw):
    if struct.unpack_from("<H", raw, 2)[0] == 43:
        n = struct.unpack_from("<Q", raw, 16)[0]
        return {t: (k, c, v) for t, k, c, v in (struct.unpack_from("<HHQQ", raw, 24 + 20 * i) for i in range(n))}
    n = struct.unpack_from("<H", raw, 8)[0]
    return {t: (k, c, v) for t, k, c, v in (struct.unpack_from("<HHII", raw, 10 + 12 * i) for i in range(n))}


def test_geotiff_in_strips(spark, tmp_path):
    f = Frame(0.0, 0.0, 2.0, 37, 50)
    want = {(r, c): 5 + r * 0.25 + c for r in range(50) for c in range(37) if not 20 <= r < 30}
    m = spark.createDataFrame([(r, c, v) for (r, c), v in want.items()], "row int, col int, elevation double")
    path = tmp_path / "t.tif"
    geotiff.write_geotiff(m, f, str(path), (100.0, 3.0, -50.0), 4326, strip_cells=160)
    raw = path.read_bytes()
    t = tags_of(raw)
    assert sorted(t) == list(t) and t[278][2] == 4 and t[273][1] == t[279][1] == 13
    places, sizes = (np.frombuffer(raw, "<u4", 13, t[k][2]) for k in (273, 279))
    image = np.concatenate([np.frombuffer(raw, "<f4", s // 4, p) for p, s in zip(places.tolist(), sizes.tolist(), strict=True)]).reshape(50, 37)
    for r in range(50):
        for c in range(37):
            assert image[r, c] == np.float32(want[r, c] + 3 if (r, c) in want else -9999)
    # A system of degrees has keys of its own.
    keys = np.frombuffer(raw, "<u2", t[34735][1], t[34735][2]).reshape(-1, 4)[1:].tolist()
    assert keys == [[1024, 0, 1, 2], [1025, 0, 1, 1], [2048, 0, 1, 4326]]
    assert len(raw) == places[0] + 50 * 37 * 4


@pytest.mark.parametrize("big", [False, True])
def test_head_of_a_large_image(big):
    """20,000 x 20,000 cells: the head alone says where each strip goes, also beyond 4 GB."""
    rows = cols = 40_000 if big else 20_000
    strip = geotiff.STRIP_CELLS // cols
    head = geotiff.geotiff_head(rows, cols, strip, 0.0, 0.0, 1.0)
    t = tags_of(head)
    n = -(-rows // strip)
    places = np.frombuffer(head, "<u8" if big else "<u4", n, t[273][2])
    assert head[2] == (43 if big else 42) and places[0] == len(head) and (np.diff(places.astype(np.int64)) == strip * cols * 4).all()
    assert len(head) < 40_000


def test_overview_equals_a_slow_average(spark):
    rng = random.Random(2)
    f = Frame(0.0, 0.0, 1.0, 23, 41)
    grid = {(r, c): rng.choice((0, 1, 5, 9, 14, 30, None)) for r in range(41) for c in range(23) if rng.random() < 0.8}
    df = spark.createDataFrame([(r, c, None if v is None else float(v)) for (r, c), v in grid.items()], "row int, col int, value double")
    image, step = report.overview(df, 10.0, f, pixels=9)
    assert step == 5

    def colour(v):
        if v == 0:
            return 214, 48, 49
        if v < 2:
            return 232, 110, 44
        if v < 8:
            return 232, 176, 52
        t = min(1, v / max(8, 20))
        return tuple(math.floor(a + b * t + 0.5) for a, b in ((40, 60), (120, 100), (70, 40)))

    want = {}
    for (r, c), v in grid.items():
        if v is not None:
            want.setdefault((r // 5, c // 5), []).append(colour(v))
    got = {(r["py"], r["px"]): (r["r"], r["g"], r["b"], r["a"]) for r in image.collect()}
    for (py, px), cells in want.items():
        inside = min(5, 41 - 5 * py) * min(5, 23 - 5 * px)
        assert got.pop((py, px)) == (*(math.floor(sum(x[k] for x in cells) / len(cells) + 0.5) for k in range(3)), math.floor(len(cells) * 255 / inside + 0.5))
    assert not got
    # A large grid gives a page of bounded size.
    large = spark.range(3_000).selectExpr("cast(id * 6 as int) AS row", "cast(id * 6 as int) AS col", "9e0 AS value")
    assert len(report.heatmap(large, 9.0, Frame(0.0, 0.0, 1.0, 20_000, 20_000))) < 200_000


def test_formats(spark):
    val = lambda c: spark.range(1).select(c).first()[0]
    for n, text in ((7, "7"), (1_500, "2K"), (2_000_000, "2M"), (2_340_000, "2.3M")):
        assert val(formats.format_count(F.lit(n).cast("long"))) == formats.count_text(n) == text
    for n, text in ((0, "0%"), (5, "<1%"), (25, "2.5%"), (125, "13%")):
        assert val(formats.format_share(F.lit(n), F.lit(1000))) == formats.share_text(n, 1000) == text
    assert val(formats.format_area(F.lit(12345.6))) == "12,346 m²" and val(formats.format_volume(F.lit(99.94))) == "99.9 m³" and val(formats.format_length(F.lit(1234.5))) == "1,234.50 m"
    assert val(formats.format_height(F.lit(9.94))) == "9.9 m" and val(formats.format_height(F.lit(12.5))) == "13 m"
    assert [val(formats.ordinal_suffix(F.lit(n))) for n in (1, 2, 3, 4, 11, 12, 21, 112, 113, 122)] == ["st", "nd", "rd", "th", "th", "th", "st", "th", "th", "nd"]
    assert val(geometry.class_colour(F.lit(6))) == "#c0553c" and val(geometry.class_colour(F.lit(70))) == geometry.OTHER_COLOUR and val(geometry.class_name(F.lit(13))) == "Wire, guard"
    assert val(geometry.density_rgb(F.lit(None).cast("double"), F.lit(4.0))) is None


def test_drawing_of_odd_polygons(spark):
    p = lambda *xz: [{"x": float(x), "y": 0.0, "z": float(z)} for x, z in xz]
    rows = [(1, p((0, 0), (4, 4), (4, 0), (0, 4)), "mean", None, 2.0), (2, p((0, 0), (1, 0)), "mean", None, 2.0), (3, p((0, 0), (3, 0), (0, 3)), "custom", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, vertices array<struct<x:double,y:double,z:double>>, base string, custom_base double, height double")
    got = {r["id"]: [len(r[c]) for c in ("outline", "base", "drops", "prism_edges", "prism_faces")] for r in measure.polygon_drawing(df).collect()}
    # Edges that cross and two corners have an outline; without a height there is no prism.
    assert got == {1: [8, 0, 0, 0, 0], 2: [2, 0, 0, 0, 0], 3: [6, 3, 6, 0, 0]}
    assert {r["id"]: len(r["outline"]) for r in measure.polygon_drawing(df, closed=False).collect()} == {1: 6, 2: 2, 3: 4}
