import json
import struct

import numpy as np
import pytest

from pointmill.operators.quality import Frame
from pointmill.sinks import geojson, geotiff, las as las_sink, report
from pointmill.sources import crs, las, ply, scan

WKT = 'PROJCS["WGS 84 / UTM zone 54N",GEOGCS["WGS 84",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","32654"]]'


def make_las(path, cut=0, deep=True):
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(WKT), b"wkt") + WKT.encode()
    head = struct.pack("<4sHH16sBB32s32sHHHIIBHI5I", b"LASF", 0, 0, b"", 1, 2, b"", b"", 1, 2000, 227, 227 + len(vlr), 1, 2, 26, 2, *[0] * 5)
    head += struct.pack("<3d3d6d", 0.001, 0.001, 0.001, 543000, 4179000, 0, 543210.5, 543010.5, 4179100.75, 4178900.25, 35.25, 20.5)
    k = 257 if deep else 1
    recs = b"".join(struct.pack("<3iHBBbBH3H", x, y, z, i, rn | n << 3, c | 0xE0, 0, 0, s, *(k * v for v in rgb)) for x, y, z, i, rn, n, c, s, rgb in ((10500, 100750, 20500, 7, 1, 1, 2, 5, (1, 2, 3)), (210500, -99750, 35250, 9, 2, 3, 6, 6, (255, 128, 0))))
    data = head + vlr + recs
    path.write_bytes(data[: len(data) - cut])


@pytest.mark.parametrize("deep", [True, False])
def test_las_round_trip(spark, tmp_path, deep):
    make_las(tmp_path / "a.las", deep=deep)
    df = scan.read_scan(spark, str(tmp_path / "a.las"))
    got = [tuple(r) for r in df.orderBy("pid").collect()]
    assert got[0] == (0, 10.5, 20.5, -100.75, 7.0, 1, 1, 2, 5, 1, 2, 3)
    assert got[1] == (1, 210.5, 35.25, 99.75, 9.0, 2, 3, 6, 6, 255, 128, 0)
    info = las.scan_info(str(tmp_path / "a.las"))
    assert info["origin"] == (543000.0, 0.0, -4179000.0) and info["epsg"] == 32654
    n = las_sink.write_las(df.selectExpr("*", "1.5e0 AS height_above_ground", "3L AS object_id"), str(tmp_path / "b.las"), info["origin"], info["records"])
    assert n == 2
    back = [tuple(r) for r in scan.read_scan(spark, str(tmp_path / "b.las")).orderBy("pid").collect()]
    assert back == got
    raw = (tmp_path / "b.las").read_bytes()
    h = las.parse_header(raw[:375])
    assert h.version == (1, 4) and h.format == 7 and h.count == 2
    assert struct.unpack_from("<fI", raw, h.offset + 36) == (1.5, 3)
    assert las.scan_info(str(tmp_path / "b.las"))["wkt"] == WKT


def test_truncated_and_thinned(spark, tmp_path):
    make_las(tmp_path / "a.las", cut=26)
    assert scan.read_scan(spark, str(tmp_path / "a.las")).count() == 1
    make_las(tmp_path / "b.las")
    assert scan.read_scan(spark, str(tmp_path / "b.las"), maxPoints=1).count() == 1
    df = scan.read_scan(spark, str(tmp_path / "b.las"), columns="x,classification", blockBytes=26)
    assert df.columns == ["x", "classification"] and df.rdd.getNumPartitions() == 2 and df.count() == 2


def test_bad_inputs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "a.las").write_text("hello")
    (tmp_path / "e.ply").write_text("")
    for name in ("a.txt", "a.las", "e.ply"):
        with pytest.raises(ValueError):
            scan.read_scan(spark, str(tmp_path / name))


@pytest.mark.parametrize("fmt", ["binary_little_endian", "binary_big_endian", "ascii"])
def test_ply(spark, tmp_path, fmt):
    rows = [(500_000.125 + i, 4_000_000.25, 10.0 + i, 7 * i, i) for i in range(50)]
    head = f"ply\nformat {fmt} 1.0\nelement vertex 50\nproperty double x\nproperty double y\nproperty double z\nproperty ushort red\nproperty uchar classification\nend_header\n"
    end = ">" if "big" in fmt else "<"
    body = "\n".join(" ".join(map(str, r)) for r in rows).encode() if fmt == "ascii" else b"".join(struct.pack(f"{end}3dHB", *r) for r in rows)
    (tmp_path / "p.ply").write_bytes(head.encode() + body)
    df = scan.read_scan(spark, str(tmp_path / "p.ply"), maxPoints=10)
    assert df.count() == 10
    r = scan.read_scan(spark, str(tmp_path / "p.ply")).filter("pid = 3").first()
    assert (r["x"], r["y"], r["z"], r["classification"]) == (3.125, 0.25, 13.0, 3)
    assert ply.parse_header(b"ply\nformat ascii 1.0\nelement face 1\nproperty list uchar int v\nend_header\n") is None


def test_reference_systems():
    assert crs.epsg_of_wkt(WKT) == 32654
    assert crs.epsg_of_wkt(f'COMPD_CS["a",{WKT},VERT_CS["v",AUTHORITY["EPSG","5703"]],AUTHORITY["EPSG","9999"]]') == 32654
    assert crs.epsg_of_wkt('PROJCRS["x",BASEGEOGCRS["y",ID["EPSG",4326]],ID["EPSG",25832]]') == 25832
    assert crs.epsg_of_wkt("nonsense") is None and crs.epsg_of_wkt(None) is None
    keys = lambda *k: struct.pack("<4H", 1, 1, 0, len(k)) + b"".join(struct.pack("<4H", *x) for x in k)
    assert crs.epsg_of_keys(keys((2048, 0, 1, 4326), (3072, 0, 1, 32654))) == 32654
    assert crs.epsg_of_keys(keys((2048, 0, 1, 4326), (3072, 0, 1, 32767))) == 4326


def test_geotiff(spark, tmp_path):
    f = Frame(0.0, 0.0, 1.0, 20, 10)
    m = spark.createDataFrame([(r, c, 100 + 0.1 * c + 0.001 * r) for r in range(10) for c in range(20) if c < 15], "row int, col int, elevation double")
    geotiff.write_geotiff(m, f, str(tmp_path / "t.tif"), (543000.0, 2.0, -4179000.0), 32654)
    raw = (tmp_path / "t.tif").read_bytes()
    n = struct.unpack_from("<H", raw, 8)[0]
    tags = {t: (k, c, v) for t, k, c, v in (struct.unpack_from("<HHII", raw, 10 + 12 * i) for i in range(n))}
    assert tags[256][2] == 20 and tags[257][2] == 10 and sorted(tags) == list(tags)
    data = np.frombuffer(raw, "<f4", 200, tags[273][2]).reshape(10, 20)
    assert data[3, 4] == pytest.approx(102.403, abs=1e-3) and data[0, 19] == -9999
    assert struct.unpack_from("<6d", raw, tags[33922][2])[3:5] == (543000.0, 4179000.0)


def test_geojson_and_csv(spark):
    obj = spark.createDataFrame(
        [(1, "building", 40, 6.0, 12.0, 3.0, None, (2.0, 1.5), [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]), (2, "tree", 20, 9.125, 5.0, 3.0, 1.26, (10.0, 20.0), None)],
        "id long, kind string, point_count long, height double, area double, ground_y double, crown_radius double, center struct<x:double,z:double>, outline array<struct<x:double,z:double>>",
    )
    doc = json.loads(geojson.collection(geojson.object_features(obj, (1000.0, 0.0, -2000.0)), epsg=32654))
    ring = doc["features"][0]["geometry"]["coordinates"][0]
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2
    assert ring[0] == ring[-1] and area == pytest.approx(12)
    assert doc["features"][1]["geometry"] == {"type": "Point", "coordinates": [1010.0, 1980.0]} and "32654" in doc["crs"]["properties"]["name"]
    assert "crs" not in json.loads(geojson.collection(geojson.object_features(obj, (0.0, 0.0, 0.0))))
    csv = geojson.inventory_csv(obj, (1000.0, 0.0, -2000.0)).split("\r\n")
    assert csv[1] == "1,building,1002.000,1998.500,3.00,6.00,12.0,,40" and csv[2] == "2,tree,1010.000,1980.000,3.00,9.13,5.0,1.26,20"


def test_measurement_features(spark):
    origin = (1000.0, 5.0, -2000.0)
    rulers = spark.sql("SELECT 1 AS id, named_struct('x', 0e0, 'y', 1e0, 'z', 0e0) AS a, named_struct('x', 3e0, 'y', 1e0, 'z', -4e0) AS b")
    f = json.loads(geojson.ruler_features(rulers, origin).first()["feature"])
    assert f["geometry"]["coordinates"] == [[1000.0, 2000.0, 6.0], [1003.0, 2004.0, 6.0]] and f["properties"] == {"kind": "distance", "id": 1, "distance": 5.0, "horizontal": 5.0, "vertical": 0.0, "slope_degrees": 0.0}
    surfaces = spark.sql("SELECT 7 AS seed, 12.5e0 AS plan_area, 13.126e0 AS surface_area, 9.456e0 AS slope, 2.5e0 AS mean, 1e0 AS center_x, 2e0 AS center_y, -3e0 AS center_z")
    f = json.loads(geojson.surface_features(surfaces, origin).first()["feature"])
    assert f["geometry"] == {"type": "Point", "coordinates": [1001.0, 2003.0, 7.0]} and f["properties"] == {"kind": "surface", "id": 7, "plan_area": 12.5, "surface_area": 13.13, "slope_degrees": 9.46, "mean_elevation": 7.5}
    ring = "array(named_struct('x', 0e0, 'y', 1e0, 'z', 0e0), named_struct('x', 4e0, 'y', 1e0, 'z', 0e0), named_struct('x', 4e0, 'y', 1e0, 'z', 2e0))"
    poly = spark.sql(f"SELECT 1 AS id, {ring} AS vertices, 'mean' AS base, CAST(NULL AS DOUBLE) AS custom_base, 3e0 AS height")
    figures = spark.sql("SELECT 1 AS id, 4e0 AS plan_area, 4.1e0 AS surface_area, 10.47e0 AS perimeter, 5e0 AS cut, 2e0 AS fill, 12e0 AS prism, 1e0 AS filled, 0e0 AS unmeasured, 1e0 AS base_mean")
    f = json.loads(geojson.polygon_features(poly, figures, origin, 0.5).first()["feature"])
    c = f["geometry"]["coordinates"][0]
    assert c[0] == c[-1] and sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(c, c[1:], strict=False)) > 0
    assert f["properties"]["net_volume"] == 3.0 and f["properties"]["base_elevation"] == 6.0 and f["properties"]["grid_cell"] == 0.5


def test_many_files_are_one_scan(spark, tmp_path):
    for k in range(3):
        make_las(tmp_path / f"t{k}.las")
    (tmp_path / "note.txt").write_text("x")
    whole = {(r["pid"], r["x"]) for r in scan.read_scan(spark, str(tmp_path)).collect()}
    assert whole == {(2 * k + i, x) for k in range(3) for i, x in ((0, 10.5), (1, 210.5))}
    assert scan.read_scan(spark, str(tmp_path / "t[01].las")).count() == 4 and scan.read_scan(spark, [str(tmp_path / "t0.las"), f"file://{tmp_path}/t2.las"], keepEvery=2).count() == 2
    assert las.scan_info(str(tmp_path))["loaded"] == 6
    with pytest.raises(ValueError):
        scan.read_scan(spark, str(tmp_path / "none*.las"))
    (tmp_path / "p.ply").write_bytes(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty double x\nproperty double y\nproperty double z\nend_header\n1 2 3\n")
    with pytest.raises(ValueError):
        scan.read_scan(spark, str(tmp_path))


def test_report(spark):
    b = spark.createDataFrame([(0, 0, 12.0), (1, 1, 0.0)], "row int, col int, value double")
    page = report.quality_html("<scan>", [{"check": "density", "verdict": "pass"}], {"mean": 8.0}, [], report.heatmap(b, 12.0, Frame(0.0, 0.0, 1.0, 2, 2)))
    assert "&lt;scan&gt;" in page and "data:image/png;base64," in page and "<b>pass</b>" in page
    assert report.noise_summary({"n": 1000, "low": 2, "high": 3}) == "5 points are noise (<1%): 3 stray above the surface, 2 stray at or below it."
    assert report.quality_summary("QL1", [{"verdict": "pass"}, {"verdict": "fail"}]) == "Meets QL1; 1 check failed." and report.quality_summary(None, []) == "Meets below QL3; every check passed."
    assert report.terrain_summary({"low": 2.25, "high": 41.6, "cell": 1.0, "measured": 80, "covered": 100}, 0.5, 2.5).startswith("Ground from 2.2 m to 42 m on a 1.0 m grid; 80% measured")
    inv = {"buildings": 2, "built_area": 1234.5, "tallest_building": 12.4, "trees": 1, "shortest_tree": 5.0, "tallest_tree": 5.0}
    assert report.inventory_summary(inv) == "Footprints cover 1,235 m², the tallest building rising 12 m. The tree stands 5.0 m tall."
    assert report.inventory_summary(inv | {"buildings": 0, "trees": 0}) == "No buildings found. No trees found."


def test_options(tmp_path):
    from pointmill.operators.ground import GroundOptions

    (tmp_path / "c.json").write_text('{"slope": 0.3, "other": 1}')
    assert scan.load_options(str(tmp_path / "c.json"), GroundOptions()).slope == 0.3
    assert scan.load_options(str(tmp_path / "none.json"), GroundOptions()) == GroundOptions()
    nested = {"ground": GroundOptions(), "view": {"dot": 2, "noise": {"shown": True, "size": 1}}}
    (tmp_path / "n.json").write_text('{"ground": {"slope": 0.3}, "view": {"noise": {"size": 3}}, "more": 1}')
    assert scan.load_options(str(tmp_path / "n.json"), nested) == {"ground": GroundOptions(slope=0.3), "view": {"dot": 2, "noise": {"shown": True, "size": 3}}}
    with pytest.raises(ValueError):
        GroundOptions(cell=0)
