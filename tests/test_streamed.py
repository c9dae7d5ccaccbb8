import pytest
from pyspark.sql import functions as F

from pointmill.operators import quality, tables
from pointmill.operators.quality import Frame
from pointmill.streaming.partials import FAMILIES, ScanState


def test_streamed_partials_equal_the_batch(spark, tmp_path):
    rows = [(k, (k * 37 % 4000) / 100.0, (k * 11 % 64) / 8.0, (k * 53 % 3600) / 100.0, float(k % 9), 2 + k % 3, 1 + k % 2, 1 + k % 2, 1 + k % 3, k % 256) for k in range(3_000)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double, intensity double, classification int, return_number int, number_of_returns int, point_source_id int, r int").withColumns({"g": F.col("r"), "b": F.col("r")})
    f = Frame(0.0, 0.0, 2.0, 20, 18)
    state = ScanState(spark, str(tmp_path / "s"), f, 1.5, (0.0, 0.0, 0.0))
    with pytest.raises(ValueError):
        state.table("classes")
    for part in range(3):  # later files come when the first ones are merged
        df.filter(F.col("pid") % 3 == part).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        state.follow(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).awaitTermination()
        if part < 2:
            state.compact()
    for name, want in state.partials(df).items():
        keys = [c for c in want.columns if c in ("classification", "row", "col", "point_source_id", "vx", "vy", "vz")]
        got = {tuple(r[k] for k in keys): r for r in state.table(name).collect()}
        rest = [c for c in want.columns if c not in keys]
        for r in want.collect():
            assert tuple(got[tuple(r[k] for k in keys)][c] for c in rest) == pytest.approx(tuple(r[c] for c in rest), nan_ok=True)
        assert len(got) == want.count()
    key = lambda d: sorted(tuple(r) for r in d.collect())
    offsets = lambda c: quality.strip_offsets(c, 100.0).select("row", "col", "a", "b", F.round("offset", 9))
    assert key(offsets(state.survey())) == key(offsets(quality.survey_cells(df, f)))
    whole = tables.voxel_downsample(df, 1.5, votes=["classification"], origin=(0.0, 0.0, 0.0))
    cols = ["vx", "vy", "vz", "n", "r", "classification"]
    assert key(state.thinned().select(cols)) == key(whole.select(cols))
    # A batch that runs again replaces its rows; unknown families are named.
    before = key(state.table("classes"))
    last = state._folders("classes")[2][-1]
    state.keep(df.filter("pid % 3 = 2").limit(0), last + 1)
    state.keep(df.filter("pid % 3 = 2").limit(0), last + 1)
    assert key(state.table("classes")) == before
    with pytest.raises(ValueError, match=FAMILIES[0]):
        state.table("lines")


def test_streamed_scene_is_no_two_files(spark, tmp_path, monkeypatch):
    """The scene's parts come as files of their own, and many partials are merged by many tasks."""
    from pointmill import queries
    from pointmill.streaming import partials

    rows = [(k, k % 40 + 0.5, 1.0, k % 36 + 0.5, 2, 1, 1, 1 + k % 2, 5.0, 0, 0.0, 0.0) for k in range(400)]
    p = spark.createDataFrame(rows, "pid long, x double, y double, z double, classification int, return_number int, number_of_returns int, point_source_id int, intensity double, kind int, terrain double, above double")
    monkeypatch.setattr(queries, "points", lambda *_: p.repartition(6))
    monkeypatch.setattr(queries, "_STATES", {})
    monkeypatch.setattr(partials, "MERGE_ROWS", 50)
    state = queries._state(spark, str(tmp_path))
    assert len(spark.read.parquet(f"{state.path}/in").inputFiles()) == 12
    cells = state.table("cells")
    assert cells.rdd.getNumPartitions() > 4 and cells.agg(F.sum("n")).first()[0] == 400
