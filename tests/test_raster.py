import numpy as np
import pytest

from pointmill.operators import components, ground, measure, objects, raster, terrain
from pointmill.operators.quality import Frame


def grid_df(spark, a):
    return spark.createDataFrame([(int(r), int(c), float(a[r, c])) for r, c in zip(*np.nonzero(~np.isnan(a)), strict=True)], "row int, col int, value double")


def dense(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = r["value"]
    return out


@pytest.mark.parametrize("radius", [1, 2, 3, 5, 8, 12, 30])
def test_sliding_equals_brute_force(radius):
    a = np.random.default_rng(radius).uniform(-50, 50, (23, 17))
    got = raster._sliding(a, radius, np.minimum)
    want = np.array([[a[i, max(0, j - radius) : j + radius + 1].min() for j in range(17)] for i in range(23)])
    assert np.array_equal(got, want)


def test_window_erosion_equals_brute_force(spark):
    a = np.random.default_rng(1).uniform(-5, 5, (9, 11))
    got = dense(raster.erode(grid_df(spark, a), 2), a.shape)
    want = np.array([[a[max(0, i - 2) : i + 3, max(0, j - 2) : j + 3].min() for j in range(11)] for i in range(9)])
    assert np.array_equal(got, want)


@pytest.mark.parametrize("radius", [1, 4, 18, 60])
def test_opening_keeps_a_plane_and_never_raises(radius):
    r, c = np.mgrid[:30, :40]
    plane = 3 + 0.4 * r - 0.2 * c
    assert np.allclose(raster.open_extrapolated(plane, radius), plane)
    rough = plane + np.random.default_rng(0).uniform(0, 2, plane.shape)
    assert (raster.open_extrapolated(rough, radius) <= rough).all()


def test_opening_removes_a_bump():
    a = np.full((21, 21), 2.0)
    a[9:12, 9:12] = 14
    assert np.allclose(raster.open_extrapolated(a, 2), 2)


def test_push_pull(spark):
    n = np.nan
    a = np.array([[1, 1, 1], [n, n, 5], [5, n, 5]])
    got = dense(raster.push_pull(grid_df(spark, a), 3, 3), a.shape)
    assert not np.isnan(got).any()
    assert np.array_equal(got[~np.isnan(a)], a[~np.isnan(a)])
    assert 1 < got[1, 0] < 5


def test_pits(spark):
    a = np.full((7, 7), 10.0)
    a[2, 2] = a[5, 4] = a[5, 5] = 4
    out = raster.raise_pits(grid_df(spark, a), 7, 7, 1.0)
    assert out.filter("lifted").count() == 3 and out.filter("value < 10").count() == 0
    b = np.full((9, 9), 10.0)
    b[4, :] = 4
    assert raster.raise_pits(grid_df(spark, b), 9, 9, 1.0).filter("lifted").count() == 0


def test_labels_and_moments(spark):
    m = spark.createDataFrame([(0, 5), (1, 6), (4, 0), (4, 1), (5, 2)], "row int, col int")
    assert components.label_cells(m, 10).groupBy("label").count().orderBy("label").collect()[0]["count"] == 2
    assert sorted(r["label"] for r in components.label_cells(m, 10, 4).select("label").distinct().collect()) == [1, 2, 3, 4]


def test_long_chain_is_one_component(spark):
    e = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    out = components.connected_components(e)
    assert out.count() == 201 and out.select("root").distinct().collect()[0][0] == 0


def test_outline_shapes():
    square = {(r, c) for r in range(3) for c in range(5)}
    assert len(objects.boundary_ring(square)) == 4
    assert len(objects.boundary_ring(square | {(r, c) for r in range(3, 6) for c in range(2)})) == 6
    assert len(objects.boundary_ring({(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (2, 3), (3, 2), (3, 3)})) == 8


def test_intervals():
    assert [terrain.contour_interval(r) for r in (24, 60, 3)] == [(1.0, 5), (2.5, 4), (0.2, 5)]


def test_slope_contours(spark):
    a = np.array([[0.1 * c for c in range(41)] for _ in range(41)]) * 2
    f = Frame(0.0, 0.0, 1.0, 41, 41)
    out = terrain.contours(grid_df(spark, a), f, 1.0, origin_y=30.25, passes=0).collect()
    assert sorted(r["k"] for r in out) == list(range(31, 39))
    assert [r["k"] for r in out if r["major"]] == [35] and not any(r["closed"] for r in out)


def test_cone_contours_are_rings(spark):
    r, c = np.mgrid[:61, :61]
    a = np.maximum(0, 12 - 0.5 * np.hypot(r - 30, c - 30)) + 1e-3 * (r + 2 * c) / 61
    f = Frame(0.0, 0.0, 1.0, 61, 61)
    out = terrain.contours(grid_df(spark, a), f, 2.0).collect()
    rings = {round(x["level"]) for x in out if x["closed"]}
    assert {2, 4, 6, 8, 10} <= rings


def suburb(spark):
    rng = np.random.default_rng(7)
    n = 60 * 60 * 4
    x, z = rng.uniform(0, 60, n), rng.uniform(0, 60, n)
    y = 10 + 0.05 * x + rng.normal(0, 0.02, n)
    roof = (x > 10) & (x < 26) & (z > 10) & (z < 22)
    tree = (x - 42) ** 2 + (z - 40) ** 2 < 16
    hag = np.where(roof, 6.0, np.where(tree, np.maximum(2.0, 12 - 0.5 * ((x - 42) ** 2 + (z - 40) ** 2)) - rng.uniform(0, 3, n), 0.0))
    rows = [(int(i), float(x[i]), float(y[i] + hag[i]), float(z[i]), 0, 2 if tree[i] else 1, 1, 1 if roof[i] else 2 if tree[i] else 0) for i in range(n)]
    return spark.createDataFrame(rows, "pid long, x double, y double, z double, classification int, number_of_returns int, return_number int, truth int")


def test_ground_and_objects(spark):
    from pointmill.storage import settled

    p = settled(suburb(spark))
    g = settled(ground.detect_ground(p, ground.GroundOptions(tile=32)))
    wrong = g.filter("(truth = 0) <> (classification = 2)").count()
    assert wrong / p.count() < 0.02
    whole = ground.detect_ground(p)
    assert whole.join(g.selectExpr("pid", "classification AS c"), "pid").filter("classification <> c").count() == 0
    out, obj = objects.detect_objects(g)
    got = {r["kind"]: r for r in obj.collect()}
    assert set(got) == {"building", "tree"} and obj.count() == 2
    assert got["building"]["area"] == pytest.approx(16 * 12, rel=0.12) and got["building"]["height"] == pytest.approx(6, abs=0.8)
    assert got["tree"]["height"] == pytest.approx(12, abs=1.0) and len(got["building"]["outline"]) >= 4
    m = objects.match_objects(out.selectExpr("pid", "truth AS instance"), out.select("pid", "object_id"))
    assert m.count() == 2


def test_ground_cells_of_a_wide_scan(spark, monkeypatch):
    """However wide a scan, its cells stay as large as asked for."""
    wide = spark.createDataFrame([(k, 25.0 * k, 1.0, 25.0 * k, 2) for k in range(101)], "pid long, x double, y double, z double, classification int")
    seen = []

    def stop(_points, frame):
        seen.append(frame)
        raise InterruptedError

    monkeypatch.setattr(raster, "minimum_surface", stop)
    with pytest.raises(InterruptedError):
        ground.detect_ground(wide)
    assert (seen[0].cell, seen[0].rows, seen[0].cols) == (1.0, 2501, 2501)


def test_heights_of_a_wide_scan(spark, monkeypatch):
    wide = spark.createDataFrame([(k, 25.0 * k, 1.0, 25.0 * k, 2) for k in range(101)], "pid long, x double, y double, z double, classification int")
    monkeypatch.setattr(ground, "height_above_ground", lambda _points, frame: frame)
    f = ground.height_above_classified_ground(wide)
    assert (f.cell, f.rows, f.cols) == (1.0, 2501, 2501)


def test_polygon_volumes(spark):
    a = np.full((40, 40), 10.0)
    a[10:20, 10:30] = 20.0
    ring = [{"x": 5.0, "y": 10.0, "z": 5.0}, {"x": 35.0, "y": 10.0, "z": 5.0}, {"x": 35.0, "y": 10.0, "z": 25.0}, {"x": 5.0, "y": 10.0, "z": 25.0}]
    bow = [ring[0], ring[2], ring[1], ring[3]]
    poly = spark.createDataFrame([(1, ring, "lowest", None, 4.0), (2, bow, "lowest", None, 4.0)], "id int, vertices array<struct<x:double,y:double,z:double>>, base string, custom_base double, height double")
    out = {r["id"]: r for r in measure.measure_polygons(poly, grid_df(spark, a), 0.0, 0.0, 1.0).collect()}
    v = out[1]
    assert v["valid"] and v["plan_area"] == 600 and v["cut"] == pytest.approx(2000) and v["fill"] == 0 and v["filled"] == pytest.approx(800) and v["prism"] == 2400 and v["unmeasured"] == 0 and v["base_mean"] == 10
    assert v["surface_area"] > 600 and not out[2]["valid"] and out[2]["cut"] == 0


@pytest.mark.parametrize("connectivity", [4, 8])
def test_labels_equal_brute_force_across_tiles(spark, connectivity):
    rng = np.random.default_rng(connectivity)
    on = {(int(r), int(c)) for r, c in np.argwhere(rng.random((20, 23)) < (0.45 if connectivity == 8 else 0.6))}
    step = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    want = {}
    for p in sorted(on):
        todo = [] if p in want else [p]
        while todo:
            q = todo.pop()
            if q not in want:
                want[q] = p[0] * 23 + p[1]
                todo += [n for i, j in step if (n := (q[0] + i, q[1] + j)) in on]
    mask = spark.createDataFrame(sorted(on), "row int, col int")
    for tile in (4, 7, 1024):
        got = {(r["row"], r["col"]): r["root"] for r in components.cell_roots(mask, 23, connectivity, tile).collect()}
        assert got == want
    number = {k: i + 1 for i, k in enumerate(sorted(set(want.values())))}
    assert {(r["row"], r["col"]): r["label"] for r in components.label_cells(mask, 23, connectivity).collect()} == {p: number[k] for p, k in want.items()}
    assert components.label_cells(mask.limit(0), 23).count() == 0


def test_edge_roots_across_tiles(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(a) + int(d), int(a) // 5, int(a) % 5) for a, d in zip(rng.integers(0, 60, 45), rng.integers(1, 4, 45), strict=True)]
    root = {n: n for e in edges for n in e[:2]}
    for _ in edges:
        for a, b, _, _ in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long, row int, col int")
    for tile in (3, 100):
        assert {(r["a"], r["b"], r["root"]) for r in components.placed_edge_roots(df, tile).collect()} == {(a, b, root[a]) for a, b, _, _ in edges}


def filled_array(a):
    """Push-pull of a small array, cell by cell."""
    if not np.isnan(a).any() or a.size == 1:
        return a

    def down(v, w):
        r, c = v.shape
        sv, sw = np.zeros(((r + 1) // 2, (c + 1) // 2)), np.zeros(((r + 1) // 2, (c + 1) // 2))
        for i in range(r):
            for j in range(c):
                if w[i, j]:
                    sv[i // 2, j // 2] += v[i, j] * w[i, j]
                    sw[i // 2, j // 2] += w[i, j]
        return np.where(sw > 0, sv / np.maximum(sw, 1e-300), 0), sw

    def fill(v, w):
        if (w > 0).all() or v.size == 1:
            return v
        up = fill(*down(v, w))
        out = v.copy()
        for i, j in zip(*np.nonzero(w == 0), strict=True):
            u, t = min(max((j + 0.5) / 2 - 0.5, 0), up.shape[1] - 1), min(max((i + 0.5) / 2 - 0.5, 0), up.shape[0] - 1)
            j0, i0 = int(u), int(t)
            j1, i1 = min(j0 + 1, up.shape[1] - 1), min(i0 + 1, up.shape[0] - 1)
            fu, ft = u - j0, t - i0
            out[i, j] = (up[i0, j0] * (1 - fu) + up[i0, j1] * fu) * (1 - ft) + (up[i1, j0] * (1 - fu) + up[i1, j1] * fu) * ft
        return out

    return fill(np.nan_to_num(a), (~np.isnan(a)).astype(float))


@pytest.mark.parametrize("dense_cells", [raster.DENSE_CELLS, 4])
def test_push_pull_equals_brute_force(spark, monkeypatch, dense_cells):
    monkeypatch.setattr(raster, "DENSE_CELLS", dense_cells)
    rng = np.random.default_rng(6)
    for shape, share in (((13, 21), 0.5), ((9, 5), 0.06), ((1, 7), 0.5), ((16, 16), 0.02)):
        a = np.where(rng.random(shape) < share, rng.uniform(0, 9, shape), np.nan)
        a[0, 0] = 3.0
        got = dense(raster.push_pull(grid_df(spark, a), *shape), shape)
        assert np.allclose(got, filled_array(a))


@pytest.mark.parametrize("dense_cells", [raster.DENSE_CELLS, 30])
def test_polygons_over_gaps(spark, monkeypatch, dense_cells):
    """Each polygon's surroundings are filled apart; a polygon over nothing is not measured."""
    monkeypatch.setattr(raster, "DENSE_CELLS", dense_cells)
    rng = np.random.default_rng(2)
    a = np.where(rng.random((30, 30)) < 0.4, rng.uniform(9, 12, (30, 30)), np.nan)
    a[20:, 20:] = np.nan
    corner = lambda x, z: {"x": x, "y": 10.0, "z": z}
    box = lambda x0, z0, x1, z1: [corner(x0, z0), corner(x1, z0), corner(x1, z1), corner(x0, z1)]
    shapes = [(1, box(2.0, 3.0, 12.0, 9.0)), (2, box(5.0, 8.0, 25.0, 18.0)), (3, box(23.0, 23.0, 28.0, 28.0)), (4, box(-3.0, 1.0, 4.0, 5.0))]
    poly = spark.createDataFrame([(i, v, "mean", None, -1.0) for i, v in shapes], "id int, vertices array<struct<x:double,y:double,z:double>>, base string, custom_base double, height double")
    out = {r["id"]: r for r in measure.measure_polygons(poly, grid_df(spark, a), 0.0, 0.0, 1.0).collect()}
    assert out[3]["valid"] and out[3]["unmeasured"] == 1 and out[3]["cut"] == 0 == out[3]["prism"]
    for i, v in shapes:
        if i == 3:
            continue
        x0, z0, x1, z1 = int(v[0]["x"]), int(v[0]["z"]), int(v[2]["x"]), int(v[2]["z"])
        crop = np.full((z1 - z0 + 3, x1 - x0 + 3), np.nan)
        for r in range(z0 - 1, z1 + 2):
            for c in range(x0 - 1, x1 + 2):
                if 0 <= r < 30 and 0 <= c < 30:
                    crop[r - z0 + 1, c - x0 + 1] = a[r, c]
        full = filled_array(crop)[1 : 1 + z1 - z0, 1 : 1 + x1 - x0]
        gone = np.isnan(crop)[1 : 1 + z1 - z0, 1 : 1 + x1 - x0]
        assert out[i]["cut"] == pytest.approx(np.maximum(full - 10, 0).sum(), abs=1e-5) and out[i]["fill"] == pytest.approx(np.maximum(10 - full, 0).sum(), abs=1e-5)
        assert out[i]["unmeasured"] == pytest.approx(gone.mean(), abs=1e-5) and out[i]["filled"] == 0


def test_roughness_equals_least_squares(spark):
    rng = np.random.default_rng(4)
    a = np.where(rng.random((12, 12)) < 0.85, rng.uniform(0, 1, (12, 12)), np.nan)

    def brute(r, c):
        cells = [(i, j, a[r + i, c + j]) for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= r + i < 12 and 0 <= c + j < 12 and not np.isnan(a[r + i, c + j])]
        if len(cells) < 6:
            return np.nan
        for turn in range(3):
            m, v = np.array([(1.0, i, j) for i, j, _ in cells]), np.array([x for _, _, x in cells])
            res = v - m @ np.linalg.lstsq(m, v, rcond=None)[0]
            if turn == 2 or len(cells) <= 6 or res.min() >= -0.15:
                return np.sqrt((res * res).mean())
            del cells[int(res.argmin())]

    got = dense(raster.plane_roughness(grid_df(spark, a)).filter("value is not null"), a.shape)
    want = np.array([[np.nan if np.isnan(a[r, c]) else brute(r, c) for c in range(12)] for r in range(12)])
    assert np.allclose(got, want, equal_nan=True)


def test_roughness_at_the_tolerance(spark):
    """Of two neighbourhoods with a residual of exactly the tolerance, the SQL's arithmetic keeps the one's low cell and drops the other's."""
    import duckdb

    from pointmill.queries import ORACLES

    a = np.array([[19.0, 19.6875, 19.46875], [18.984375, 19.296875, 19.53125], [18.90625, 19.359375, 19.421875]])
    b = np.array([[18.53125, 18.453125, 17.59375], [18.6875, 18.140625, 17.59375], [18.46875, 18.046875, 17.53125]])
    con = duckdb.connect()
    for v, known in ((a, 0.123296), (b, 0.054448)):
        cells = ", ".join(f"({r}, {c}, {float(v[r, c])!r}e0)" for r in range(3) for c in range(3))
        sql = f"WITH lo(row, col, value) AS (VALUES {cells}), nb AS (" + ORACLES["plane_roughness"].split(", nb AS (", 1)[1]
        want = {(r, c): x for r, c, x in con.sql(sql).fetchall()}
        got = {(r["row"], r["col"]): r["value"] for r in raster.plane_roughness(grid_df(spark, v)).collect()}
        assert want[1, 1] == known and {k: x if x is None else round(x, 6) for k, x in got.items()} == want


def test_surface_growth_stops_at_edges(spark):
    a = np.full((30, 30), 5.0)
    a[5:15, 5:15] = 9.0 + 0.05 * np.arange(10)
    a[9, 9] = np.nan
    seeds = spark.createDataFrame([(1, 8, 8)], "seed int, row int, col int")
    cells = measure.select_surfaces(grid_df(spark, a), seeds, 1.0, 30, 30)
    assert cells.count() == 100
    d = measure.describe_surfaces(cells, grid_df(spark, a), 1.0, 30).first()
    assert d["plan_area"] == 100 and d["slope"] == pytest.approx(np.degrees(np.arctan(0.05)), abs=0.05) and d["surface_area"] == pytest.approx(100 * np.sqrt(1 + 0.05**2), abs=1e-3)
    assert 9 <= d["center_x"] <= 11 and measure.surface_outline(cells).count() == 40
    # A small window is widened until it holds the whole surface.
    whole = {tuple(r) for r in cells.collect()}
    ground = spark.createDataFrame([(1, 8, 8), (2, 1, 1)], "seed int, row int, col int")
    small = measure.select_surfaces(grid_df(spark, a), ground, 1.0, 30, 30, measure.SurfaceOptions(window=4))
    assert {tuple(r) for r in small.filter("seed = 1").collect()} == whole and small.filter("seed = 2").count() == 800


def test_surface_growth_on_slopes():
    """A steep plane with a little noise is one surface; a seed on a step of its own starts level; the limit of cells holds."""
    rng = np.random.default_rng(7)
    r, c = np.mgrid[:20, :20]
    a = 3 + 0.7 * r + 0.2 * c + rng.uniform(-0.02, 0.02, (20, 20))
    assert len(measure.grow_surface(a, 10, 10, 1.0)) == 400
    a[8:11, 8:11] = 60.0
    assert measure.grow_surface(a, 9, 9, 1.0) == {(i, j) for i in range(8, 11) for j in range(8, 11)}
    assert len(measure.grow_surface(np.zeros((9, 9)), 4, 4, 1.0, measure.SurfaceOptions(max_cells=10))) >= 11


def test_triangulate():
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    t = measure.triangulate(ring)
    area = sum(abs((ring[b][0] - ring[a][0]) * (ring[c][1] - ring[a][1]) - (ring[b][1] - ring[a][1]) * (ring[c][0] - ring[a][0])) / 2 for a, b, c in t)
    assert len(t) == 3 and area == pytest.approx(10)
    assert measure.triangulate([(0, 0), (1, 1), (1, 0), (0, 1)]) is None
