import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchor, scale=256, positives=5, negatives=3):
    q = {i: (label, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in q:
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q[a][1], v, strict=True)), i) for i, (_, v) in q.items() if i != a and len(v) == len(q[a][1]))
        for p, pid in [s for s in scored if q[s[1]][0] == q[a][0]][:positives]:
            near = [(-s, i) for s, i in scored if q[i][0] != q[a][0] and 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(a, pid, k + 1, i, -p, s) for k, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_equal_to_brute_force(spark, monkeypatch, small):
    if small:  # many cells, one anchor at a time
        for name, value in {"ROWS": 37, "ANCHORS": 5, "HELD": 50, "LEAST": 10}.items():
            monkeypatch.setattr(hardneg, name, value)
    rng = random.Random(2)
    # Few values, so that scores tie and fall on the limits.
    rows = [(i, [rng.randrange(-3, 4) / 16 for _ in range(6)], rng.randrange(3)) for i in range(-50, 250)]
    got = hardneg.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 9 == 0)
    want = brute(rows, lambda i: i % 9 == 0)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100


def test_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.4], 2), (3, [0.9, 0.4], 2), (4, None, 2), (5, [1.0, None], 2), (6, [nan, 1.0], 2), (7, [1.0, -inf], 2), (8, [1.0, 0.4], None), (None, [0.9, 0.4], 2), (9, [1.0], 2), (10, [], 1), (11, [], 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "block": F.lit(7), "anchor": F.lit(None), "rank": F.lit(1)})
    got = sorted(tuple(r) for r in hardneg.hard_negatives(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute(rows, lambda i: i == 0) and [r[3] for r in got] == [2, 3]
    # Repeated rows are one, and an anchor without another row of its label has none.
    assert sorted(tuple(r) for r in hardneg.hard_negatives(df.union(df), F.col("vec_id") % 50 == 0).collect()) == got
    assert hardneg.hard_negatives(df.filter("vec_id > 1"), F.col("vec_id") % 2 == 0).filter("anchor_id = 10").collect() == []
    assert hardneg.hard_negatives(df.limit(0), F.lit(True)).collect() == []


def test_scores_are_exact():
    rng = np.random.default_rng(1)
    for top in (1 << 8, 1 << 20, 1 << 29):
        a, b = (np.floor(rng.uniform(-top, top, (5, 7))) for _ in "ab")
        want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
        assert hardneg.scores(a, b).tolist() == want
    assert hardneg.scores(np.full((1, 2), 2.0**40), np.full((1, 2), -(2.0**40))).tolist() == [[-(2**63 - 1)]]
