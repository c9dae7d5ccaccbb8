import pytest
from pyspark.sql import functions as F

from pointmill.functions import geometry, sql
from pointmill.operators import measure, quality, tables
from pointmill.operators.quality import Frame
from pointmill.plans.analyze import analyze
from pointmill.sources.synthetic import synthetic_survey
from pointmill.storage import settled
from pointmill.streaming import cells


def test_analysis_of_a_synthetic_survey(spark):
    p = settled(synthetic_survey(spark, 160_000))
    assert p.count() == 160_000
    a = analyze(p, ("noise", "ground", "terrain", "quality"))
    assert a.errors == {} and {"noise", "ground", "terrain", "contours", "quality", "density", "strips"} <= set(a.results)
    e = tables.ground_errors(a.points).first()
    assert e["total"] < 0.02 and e["noise_recall"] > 0.9
    strip = a.results["strips"].first()
    assert strip["mean"] == pytest.approx(0.04, abs=0.01)
    again = analyze(a.points, ("ground",))
    assert "object_id" not in again.points.columns


def test_a_failed_step_does_not_stop_the_rest(spark):
    p = spark.createDataFrame([(i, float(i % 5), 1.0, float(i // 5), 7, 1, 1, 1) for i in range(20)], "pid long, x double, y double, z double, classification int, return_number int, number_of_returns int, point_source_id int")
    a = analyze(p, ("ground", "terrain", "quality"))
    assert set(a.errors) == {"ground", "terrain"} and "quality" in a.results
    with pytest.raises(ValueError):
        analyze(p, ("lunch",))


def test_stream_equals_batch(spark):
    p = synthetic_survey(spark, 5_000)
    f = Frame(0.0, 0.0, 10.0, 20, 20)
    got = {tuple(r) for r in cells.cell_stats_stream(p, f).selectExpr("row", "col", "n", "lo", "hi").collect()}
    want = {tuple(r) for r in cells.cell_partials(p, f).selectExpr("row", "col", "n", "lo", "hi").collect()}
    assert got == want


def test_event_windows(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", k) for m, k in ((1, "a"), (20, "a"), (59, "b"))]
    spark.createDataFrame(rows, "t string, k string").selectExpr("CAST(t AS timestamp) AS t", "k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, k string").parquet(str(tmp_path / "in"))
    q = cells.event_windows(stream, "t", ["k"]).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["k"], r["n"]) for r in spark.table("windows").collect()) == [("a", 2), ("b", 1)]


def test_sql_kernels(spark):
    sql.register(spark)
    assert spark.sql("""SELECT epsg_of_wkt('PROJCS["a",AUTHORITY["EPSG","32654"]]') AS e""").first()["e"] == 32654
    assert spark.sql("SELECT * FROM around_cell(5, 7, 1)").count() == 9
    v = "array(named_struct('x', 0e0, 'y', 1e0, 'z', 0e0), named_struct('x', 1e0, 'y', 2e0, 'z', 0e0), named_struct('x', 0e0, 'y', 1e0, 'z', 1e0))"
    r = spark.sql(f"SELECT ear_clip({v}) AS t, plane_through({v}) AS p").first()
    assert len(r["t"]) == 1 and r["p"] == pytest.approx([1, 1, 0])


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    assert val(geometry.js_round(F.lit(-2.5))) == -2.0 and val(geometry.js_round(F.lit(0.125), 2)) == 0.13
    assert val(geometry.slug(F.lit("my scan?.las"))) == "my-scan" and val(geometry.slug(F.lit("???"))) == "scan"
    assert val(geometry.csv_field(F.lit('a,"b'))) == '"a,""b"' and val(geometry.class_name(F.lit(6))) == "Building" and val(geometry.class_name(F.lit(99))) == "Class 99"
    assert [round(x, 6) for x in one.select(*geometry.measure_between(F.lit(3.0), F.lit(4.0), F.lit(0.0))).first()] == [5.0, 3.0, 4.0, 53.130102]
    assert tuple(one.select(*geometry.constrained(F.lit(1.0), F.lit(2.0), F.lit(3.0), "level")).first()) == (1.0, 0.0, 3.0)
    assert val(geometry.snapped(F.lit(1.26), 0.1)) == pytest.approx(1.3)


def test_lod(spark):
    p = synthetic_survey(spark, 20_000).withColumn("x", F.col("x") / 10).withColumn("z", F.col("z") / 10)
    tiers = measure.build_lod(p, levels=2)
    n = [t.count() for _, t in tiers]
    assert n[0] == 20_000 and 0.08 * n[0] < n[1] <= 0.25 * n[0] and n[2] <= 0.25 * n[1]
    t = spark.createDataFrame([("a", 0, 100), ("a", 1, 25), ("a", 2, 6), ("b", 0, 300), ("b", 1, 75), ("b", 2, 20)], "tile string, tier int, n long")
    assert {r["tile"]: r["tier"] for r in measure.tier_for_budget(t, 100).collect()} == {"a": 1, "b": 1}
    assert {r["tile"]: r["tier"] for r in measure.tier_for_budget(t, 10).collect()} == {"a": 2, "b": 2}


def test_visible(spark):
    p = spark.createDataFrame([(1, 2, 1), (2, 7, 1), (3, 18, 2), (4, 6, 3)], "pid long, classification int, point_source_id int")
    ids = lambda df: sorted(r["pid"] for r in df.collect())
    assert ids(tables.visible(p, "only")) == [2, 3] and ids(tables.visible(p, "hidden", spark.createDataFrame([(3,)], "point_source_id int"))) == [1]


def test_without_the_corpus_operators(tmp_path):
    """A copy without that subpackage, its tests and its pipeline imports whole and still has its queries."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parent.parent
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py", ".pytest_cache")
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e, importlib, pkgutil, pointmill\nfor m in pkgutil.walk_packages(pointmill.__path__, 'pointmill.'): importlib.import_module(m.name)\nq = e.queries(); assert len(q) > 80 and 'quality_checks' in q and not any(k.startswith('op1') for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "copy")})


def test_scene_plans(spark):
    """The scene is read from its table: one scan, no join in it, columns pruned and filters pushed."""
    from pointmill.scene import points

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    p = plan(points(spark, "/root/testdata/sf0.001").filter("classification = 2").groupBy("classification").agg(F.sum("y")))
    assert "Join" not in p and p.count("FileScan") == 1 and "EqualTo(classification,2)" in p and "intensity" not in p
    cells = quality.survey_cells(points(spark, "/root/testdata/sf0.001"), Frame(0.0, 0.0, 1.0, 32, 32))
    assert "NestedLoop" not in plan(quality.footprint_cells(cells))
