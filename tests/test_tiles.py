import math
import random

import pytest
from pyspark.sql import functions as F

from pointmill.operators import components, measure, tables, tilestore


def cloud(spark, n=3_000, seed=1):
    rng = random.Random(seed)
    # A third of all points in one corner.
    rows = [(k, rng.uniform(0, 3) if k % 3 == 0 else rng.uniform(0, 40), rng.uniform(0, 5), rng.uniform(0, 3) if k % 3 == 0 else rng.uniform(0, 36), k % 5, k % 256, k % 200, k % 100) for k in range(n)]
    return rows, spark.createDataFrame(rows, "pid long, x double, y double, z double, classification int, r int, g int, b int")


def test_store_is_lossless_and_prunes(spark, tmp_path):
    rows, df = cloud(spark)
    store = tilestore.write_tiles(df, str(tmp_path / "s"), tile=8.0, levels=2)
    again = tilestore.TileStore(spark, str(tmp_path / "s"))
    got = sorted(tuple(r) for r in again.points().select(df.columns).collect())
    assert got == sorted(rows)
    m = {(r["grid_x"], r["grid_z"]): r for r in again.manifest.filter("tier = 0").collect()}
    assert len(m) == 25 and sum(r["n"] for r in m.values()) == len(rows) and m[0, 0]["tile"] == "tile-0-0"
    for (gx, gz), r in m.items():
        own = [p for p in rows if min(4, int((p[1] - min(q[1] for q in rows)) // 8)) == gx and min(4, int((p[3] - min(q[3] for q in rows)) // 8)) == gz]
        assert r["n"] == len(own) and r["min_y"] == min(p[2] for p in own) and r["max_x"] == max(p[1] for p in own)
    # A rectangle opens the folders of its tiles only.
    part = store.within(1.0, 1.0, 10.0, 5.0)
    assert {f.split("/grid_x=")[1].split("/part")[0] for f in part.inputFiles()} == {"0/grid_z=0", "1/grid_z=0"}
    assert sorted(r["pid"] for r in part.collect()) == sorted(p[0] for p in rows if 1 <= p[1] <= 10 and 1 <= p[3] <= 5)
    assert store.within(100.0, 100.0, 101.0, 101.0).collect() == []


def test_named_or_joined_tiles_are_alike(spark, tmp_path, monkeypatch):
    rows, df = cloud(spark)
    store = tilestore.write_tiles(df, str(tmp_path / "s"), tile=10.0)
    want = sorted(r["pid"] for r in store.within(0.0, 0.0, 25.0, 36.0).collect())
    monkeypatch.setattr(tilestore, "NAMED_TILES", 2)
    assert sorted(r["pid"] for r in store.within(0.0, 0.0, 25.0, 36.0).collect()) == want


def slow_tier(points, box_n, voxel, fraction=0.25):
    """Voxel and voxels' means of one tile, step by step."""
    xs, zs = [p[0] for p in points], [p[2] for p in points]
    low = [min(p[c] for p in points) for c in range(3)]
    space = max(math.sqrt(max((max(xs) - min(xs)) * (max(zs) - min(zs)), 1e-6) / len(points)), 0.005)
    v = max(voxel, space) * tilestore.GROWTH
    for k in range(tilestore.ATTEMPTS + 1):
        size = v * tilestore.GROWTH**k
        cells = {}
        for p in points:
            cells.setdefault(tuple(math.floor((p[c] - low[c]) / size) for c in range(3)), []).append(p)
        if len(cells) <= max(1, math.floor(len(points) * fraction)) or len(cells) <= 1:
            break
    return size, [tuple(sum(p[c] for p in g) / len(g) for c in range(3)) for g in cells.values()]


def test_tiers_equal_a_slow_ladder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tilestore, "AT_ONCE", 1)
    rows, df = cloud(spark, 900)
    store = tilestore.write_tiles(df.select("pid", "x", "y", "z"), str(tmp_path / "s"), tile=20.0, levels=3)
    n = {(r["grid_x"], r["grid_z"], r["tier"]): (r["n"], r["voxel"]) for r in store.manifest.collect()}
    tiles = {}
    for r in store.points().collect():
        tiles.setdefault((r["grid_x"], r["grid_z"]), []).append((r["x"], r["y"], r["z"]))
    for at, own in tiles.items():
        voxel = 0.0
        for tier in range(1, 4):
            voxel, own = slow_tier(own, len(own), voxel)
            assert n[*at, tier][0] == len(own) and n[*at, tier][1] == pytest.approx(voxel)
    # A choice of tiers brings the chosen points of each tile.
    chosen = measure.tier_for_budget(store.manifest, 200)
    picked = {r["tile"]: r["tier"] for r in chosen.collect()}
    want = sum(v for (x, z, t), (v, _) in n.items() if picked[f"tile-{x}-{z}"] == t)
    assert store.chosen(chosen).count() == want


def test_votes_within_tiles(spark, tmp_path):
    rows, df = cloud(spark, 400)
    store = tilestore.write_tiles(df, str(tmp_path / "s"), tile=20.0, levels=1)
    tier = store.points(tier=1)
    assert {"classification", "r", "g", "b", "voxel"} <= set(tier.columns) and "pid" not in tier.columns
    assert tier.filter("classification IS NULL OR r IS NULL").count() == 0


def test_no_points_and_one_tile(spark, tmp_path):
    _, df = cloud(spark, 10)
    assert tilestore.write_tiles(df.limit(0), str(tmp_path / "e"), levels=1).points().collect() == []
    one = tilestore.write_tiles(df, str(tmp_path / "o"))
    assert one.manifest.count() == 1 and one.points().count() == 10
    with pytest.raises(ValueError):
        tilestore.write_tiles(df, str(tmp_path / "x"), tile=-1.0)


def greedy(tiers, gaps, limit, budget, seen):
    """The finest steps one by one, widest gap first."""
    level = {t: max(k for u, k in tiers if u == t) for t in {u for u, _ in tiers}}
    spent = sum(tiers[t, k] for t, k in level.items())
    while True:
        open_ = [(-gaps[t, k], t) for t, k in level.items() if k > 0 and seen(t)]
        if not open_ or -min(open_)[0] <= limit:
            return level
        _, t = min(open_)
        cost = tiers[t, level[t] - 1] - tiers[t, level[t]]
        if spent + cost > budget:
            return level
        spent, level[t] = spent + cost, level[t] - 1


@pytest.mark.parametrize("budget", [0, 900, 2_000, 5_000, 10**9])
def test_refinement_within_a_budget(spark, budget):
    rng = random.Random(budget)
    tiers, rows = {}, []
    for k in range(40):
        n, x = rng.randrange(100, 400), rng.uniform(0, 300)
        for t in range(4):
            tiers[f"t{k}", t] = n
            rows.append((f"t{k}", t, n, 10 / math.sqrt(n), x, 0.0, 0.0, x + 10, 5.0, 10.0))
            n = max(1, n // 4)
    df = spark.createDataFrame(rows, "tile string, tier int, n long, spacing double, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    gaps = {(r[0], r[1]): r[3] * 600 / max(math.hypot(max(r[4] - 5, 0, 5 - r[7]), max(r[5] - 9, 0, 9 - r[8]), max(r[6] - 1, 0, 1 - r[9])), 1e-3) for r in rows}
    seen = {r[0]: r[4] < 250 for r in rows}
    got = {r["tile"]: r["tier"] for r in measure.tier_for_screen(df, 5.0, 9.0, 1.0, 600.0, 3.0, budget, F.col("min_x") < 250).collect()}
    assert got == greedy(tiers, gaps, 3.0, budget, seen.get)
    if budget == 10**9:
        assert got == {r["tile"]: r["tier"] for r in measure.tier_for_screen(df, 5.0, 9.0, 1.0, 600.0, 3.0, None, F.col("min_x") < 250).collect()}


def test_running_total(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS v").repartition(5)
    got = {r["id"]: r["s"] for r in components.running_total(df, [F.desc("id")], "v", "s").collect()}
    assert got == {k: sum(j % 7 for j in range(k, 1000)) for k in range(1000)}


def test_tier_for_distance(spark):
    tiers = spark.createDataFrame([(0, None), (1, 30.0), (2, 10.0)], "tier int, min_distance double")
    cameras = spark.createDataFrame([("a", 5.0), ("b", 12.0), ("c", 90.0)], "camera string, distance double")
    assert {r["camera"]: r["tier"] for r in measure.tier_for_distance(tiers, cameras).collect()} == {"a": 2, "b": 2, "c": 1}
    assert {r["tier"] for r in measure.tier_for_distance(tiers.filter("tier = 0"), cameras).collect()} == {0}


def test_tile_edge():
    assert tables.tile_size(50_000, 100.0) is None and tables.tile_size(400_000, 100.0) == 50.0


def test_voxels_of_many_points_are_dealt_over_many_tasks(spark, tmp_path, monkeypatch):
    points = spark.range(2_000).selectExpr("id AS pid", "CAST(id % 50 AS DOUBLE) AS x", "0e0 AS y", "CAST(id % 40 AS DOUBLE) AS z")
    key, seen, own = "spark.sql.shuffle.partitions", [], tilestore.thinned

    def thinned(*args):
        seen.append(int(spark.conf.get(key)))
        return own(*args)

    monkeypatch.setattr(tilestore, "thinned", thinned)
    monkeypatch.setattr(tilestore, "TASK_VOXELS", 800, raising=False)
    before = spark.conf.get(key)
    store = tilestore.write_tiles(points, str(tmp_path / "t"), 10.0, levels=1)
    assert seen == [10] and spark.conf.get(key) == before and store.points().count() == 2_000
