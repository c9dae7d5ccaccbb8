import pytest

from pointmill.operators import noise, quality, tables
from pointmill.operators.quality import Frame


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_voxel_means_and_votes(spark):
    p = spark.createDataFrame([(0, 0.1, 0.1, 0.1, 0, 2.0, 2), (1, 0.3, 0.3, 0.3, 100, 4.0, 6), (2, 2.1, 0.0, 0.0, 255, 8.0, 9), (3, 0.2, 0.2, 0.2, 50, 3.0, 6)], "pid long, x double, y double, z double, r int, intensity double, classification int")
    out = tables.voxel_downsample(p, 1.0, origin=(0.0, 0.0, 0.0)).orderBy("vx").collect()
    assert [r["n"] for r in out] == [3, 1]
    assert out[0]["x"] == pytest.approx(0.2) and out[0]["r"] == 50 and out[0]["intensity"] == pytest.approx(3.0)
    assert [r["classification"] for r in out] == [6, 9]


def test_vote_tie_takes_the_lowest(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 7), (1, 0.0, 0.0, 0.0, 3)], "pid long, x double, y double, z double, classification int")
    assert tables.voxel_downsample(p, 1.0).first()["classification"] == 3


def test_histogram_order(spark):
    p = spark.createDataFrame([(c,) for c in (6, 2, 6, 6)], "classification int")
    assert [tuple(r) for r in tables.class_histogram(p).collect()] == [(6, 3), (2, 1)]


def test_clean_keeps_unclassified(spark):
    p = spark.createDataFrame([(0, 2), (1, 18), (2, 6), (3, 7), (4, None)], "pid long, classification int")
    assert rows(tables.without_noise(p), "pid") == [(0,), (2,), (4,)]


def test_thin_and_trim(spark):
    p = spark.range(70).withColumnRenamed("id", "pid")
    assert tables.thin_every(p, 7).count() == 10
    assert tables.trim_to(p, 33, 70).count() == 33
    with pytest.raises(ValueError):
        tables.thin_every(p, 0)


def test_tiles_are_lossless(spark):
    p = spark.range(1000).selectExpr("id AS pid", "(id % 37) * 1e0 AS x", "0e0 AS y", "(id % 41) * 1e0 AS z")
    t = tables.tiles(p, 5.0, 0.0, 0.0, 36.0, 40.0)
    assert t.count() == 1000
    assert t.agg({"grid_x": "max", "grid_z": "max"}).first().asDict() == {"max(grid_x)": 7, "max(grid_z)": 7}


def field(spark):
    grid = [(i * 161 + j, i * 0.25, 0.02 * ((i * j) % 7) / 7, j * 0.25) for i in range(161) for j in range(161)]
    return grid


def test_noise_bird_and_multipath(spark):
    p = field(spark) + [(90_000, 20.1, 25.0, 20.1), (90_001, 10.1, -3.0, 10.1)]
    df = spark.createDataFrame(p, "pid long, x double, y double, z double").selectExpr("*", "0 AS classification")
    out = noise.detect_noise(df)
    assert rows(out.filter("classification <> 0"), "pid", "classification") == [(90_000, 18), (90_001, 7)]
    s = noise.noise_stats(df, out).first()
    assert (s["kept"], s["low"], s["high"]) == (0, 1, 1)


def test_noise_leaves_a_wire(spark):
    p = field(spark) + [(90_000 + i, i * 0.5, 12.0, 20.0) for i in range(80)]
    df = spark.createDataFrame(p, "pid long, x double, y double, z double").selectExpr("*", "0 AS classification")
    assert noise.detect_noise(df).filter("classification <> 0").count() == 0


def test_isolated_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    p = [(i, rng.uniform(0, 20), rng.uniform(0, 6), rng.uniform(0, 20)) for i in range(300)]
    r = 1.5
    want = [i for i, x, y, z in p if sum(1 for j, a, b, c in p if j != i and (x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2 < r * r) < 2]
    got = rows(noise.isolated_points(spark.createDataFrame(p, "pid long, x double, y double, z double"), r), "pid")
    assert got == sorted((i,) for i in want)


def strips(spark, offset=0.05):
    n, out = 0, []
    for s, lo, hi in ((1, 0.0, 26.0), (2, 14.0, 40.0)):
        for i in range(160):
            for j in range(160):
                x, z = i * 0.25 + 0.1, j * 0.25 + 0.1
                if lo <= z < hi and not (18 <= x < 22 and 4 <= z < 8):
                    out.append((n, x, 100 + (offset if s == 2 else 0.0), z, 2, 1, 1, s))
                    n += 1
    return spark.createDataFrame(out, "pid long, x double, y double, z double, classification int, return_number int, number_of_returns int, point_source_id int")


def test_two_strips(spark):
    p = strips(spark)
    f = Frame.of(p)
    r = quality.quality_report(p, f)
    assert r.density.first()["median"] == 16.0 and r.level == "QL1"
    pair = r.pairs.first()
    assert (pair["a"], pair["b"]) == (1, 2) and pair["median"] == pytest.approx(0.05, abs=1e-6) and r.overlap.first()["overlap_share"] > 0.25
    c = r.coverage.first()
    assert c["gap_regions"] == 1 == c["voids"] and 9 <= c["largest_gap_area"] <= 16 and c["scattered_cells"] == 0 and c["void_threshold"] == pytest.approx(1, abs=0.4)
    verdicts = {x["check"]: x["verdict"] for x in r.checks.collect()}
    assert verdicts == {"density": "pass", "voids": "review", "precision": "pass", "strips": "pass", "accuracy": "skipped", "noise": "pass"}
    thin = quality.density(r.foot, f, (1000, 2000)).first()
    assert (thin["median"], thin["full_median"]) == (16.0, 32.0)
    bare = quality.quality_report(p.select("pid", "x", "y", "z"), f)
    assert {x["check"]: x["verdict"] for x in bare.checks.collect()}["strips"] == "skipped"
    assert {x["check"]: x["verdict"] for x in quality.quality_report(strips(spark, 0.12), f).checks.collect()}["strips"] == "fail"


def test_precision_of_a_noisy_plane(spark):
    """A tilted plane with 2 cm of uniform noise either side deviates by about 1.2 cm."""
    import random

    rng = random.Random(3)
    pts = [(i, x * 0.2 + 0.1, 5 + 0.01 * (x * 0.2) + (rng.random() - 0.5) * 0.04, z * 0.2 + 0.1) for i, (x, z) in enumerate((x, z) for x in range(200) for z in range(200))]
    p = spark.createDataFrame(pts, "pid long, x double, y double, z double")
    assert 0.009 < quality.quality_report(p, Frame.of(p)).precision.first()["hard"] < 0.013


def test_checkpoints(spark):
    p = strips(spark, 0.0)
    cp = spark.createDataFrame([("A", 10.0, -10.0, 99.98), ("B", 30.0, -30.0, 100.02), ("C", 900.0, 0.0, 1.0)], "name string, east double, north double, elevation double")
    r = quality.checkpoint_residuals(p, cp)
    assert rows(r.selectExpr("name", "round(residual, 4) AS e"), "name", "e") == [("A", 0.02), ("B", -0.02), ("C", None)]
    a = quality.accuracy(r).first()
    assert a["rmsez"] == pytest.approx(0.02) and a["nva"] == pytest.approx(0.0392) and a["measured"] == 2


def test_quality_level(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(9.0, None, False), (9.0, 0.04, True), (9.0, 0.08, True), (3.0, 0.08, True), (0.1, 0.0, True)], "d double, r double, c boolean")
    got = [r[0] for r in df.select(quality.quality_level(F.col("d"), F.col("r"), F.col("c"))).collect()]
    assert got == ["QL1", "QL0", "QL1", "QL2", None]


def test_parse_checkpoints(spark):
    lines = ["name,east,north,elevation", "GCP1,1,2,3", "4;5;6.5", "junk"]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
    got = [tuple(r) for r in quality.parse_checkpoints(df).collect()]
    assert sorted(got) == [("CP2", 4.0, 5.0, 6.5), ("GCP1", 1.0, 2.0, 3.0)]
