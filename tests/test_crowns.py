import heapq
import math
import random

from pointmill.operators import crowns


def flood(height, cell, share=0.35, low=2.0, tree=2.5):
    """The whole grid at once, with a plain heap by height."""
    owner, heap = {}, []
    for (r, c), v in height.items():
        reach = max(1, math.floor(min(5.0, max(1.0, 0.5 + 0.2 * v)) / cell + 0.5))
        rivals = [(height[r + i, c + j], (r + i, c + j)) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if (i or j) and i * i + j * j <= reach * reach and (r + i, c + j) in height]
        if v >= tree and not any(w > v or (w == v and at < (r, c)) for w, at in rivals):
            owner[r, c] = (r, c)
            heap.append((-v, r, c))
    heapq.heapify(heap)
    while heap:
        _, r, c = heapq.heappop(heap)
        top = owner[r, c]
        t = height[top]
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                n = (r + i, c + j)
                if n not in height or n in owner or height[n] < max(low, share * t) or height[n] > t + 0.5 or math.hypot(n[0] - top[0], n[1] - top[1]) > min(12.0, max(1.5, 1 + 0.3 * t)) / cell:
                    continue
                owner[n] = top
                heapq.heappush(heap, (-height[n], *n))
    return owner


def run(spark, height, cell, cols, **kw):
    df = spark.createDataFrame([(r, c, v) for (r, c), v in height.items()], "row int, col int, value double")
    out = crowns.segment_crowns(df, cell, cols, **kw).collect()
    got = {(r["row"], r["col"]): divmod(r["crown"], cols) for r in out}
    assert len(out) == len(got) and all(r["top"] == height[divmod(r["crown"], cols)] for r in out)
    return got


def test_the_first_to_reach_a_cell_has_it(spark):
    row = {(0, k): v for k, v in enumerate((8.0, 7.0, 5.0, 10.0, 12.0))}
    # The tall tree's flank is taken before the short tree's, so it reaches the valley first.
    assert run(spark, row, 1.0, 5) == {(0, 0): (0, 0), (0, 1): (0, 0), (0, 2): (0, 4), (0, 3): (0, 4), (0, 4): (0, 4)}


def test_tiles_equal_the_whole_grid(spark):
    """A forest of one patch with ties, gaps and crowns over several tiles."""
    rng = random.Random(6)
    size = 44
    trees = [(rng.uniform(0, size), rng.uniform(0, size), rng.uniform(4, 14), rng.uniform(2, 4)) for _ in range(110)]
    height = {}
    for r in range(size):
        for c in range(size):
            v = max(h * math.exp(-((r - y) ** 2 + (c - x) ** 2) / (2 * s * s)) for y, x, h, s in trees) + rng.uniform(-1, 1)
            if v > 2 and rng.random() > 0.03:
                height[r, c] = round(v, 1)
    want = flood(height, 1.0)
    assert len(set(want.values())) > 20
    for tile in (8, 13, 64):
        assert run(spark, height, 1.0, size, tile=tile) == want
    # More than one round was needed: crowns reach over tiles of 8 cells.
    assert any(at[0] // 8 != top[0] // 8 for at, top in want.items())


def test_keys_tell_the_order():
    """Popping by key is popping by height, on random heights."""
    rng = random.Random(1)
    for _ in range(50):
        height = {(r, c): float(rng.randrange(30, 60)) / 10 for r in range(9) for c in range(9)}
        tops = [(r, c, height[r, c]) for r, c in rng.sample(sorted(height), 4)]
        owner, keys = crowns.flood_tile(height, tops, [], 0.1, 2.0, 0.35)
        plain, heap, order = {(r, c): (r, c) for r, c, _ in tops}, [(-v, r, c) for r, c, v in tops], []
        heapq.heapify(heap)
        while heap:
            _, r, c = heapq.heappop(heap)
            order.append((r, c))
            t = plain[r, c]
            for n in [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if n in height and n not in plain and height[n] >= max(2.0, 0.35 * height[t]) and height[n] <= height[t] + 0.5 and math.hypot(n[0] - t[0], n[1] - t[1]) <= crowns.crown_reach(height[t]) / 0.1:
                    plain[n] = t
                    heapq.heappush(heap, (-height[n], *n))
        assert {k: v[:2] for k, v in owner.items()} == plain
        assert sorted(keys, key=keys.get) == order


def test_treetops_in_tiles(spark):
    rng = random.Random(3)
    height = {(r, c): float(rng.randrange(20, 200)) / 10 for r in range(30) for c in range(30) if rng.random() > 0.1}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in height.items()], "row int, col int, value double")
    want = {at for at, top in flood(height, 0.5, tree=0.0).items() if at == top}
    for tile in (7, 1024):
        assert {(r["row"], r["col"]) for r in crowns.treetops(df, 0.5, tile).collect()} == want
    assert crowns.segment_crowns(df.limit(0), 0.5, 30).collect() == []
