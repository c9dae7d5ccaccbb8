"""Hard-negative mining: every anchor's scores in full, sorted by score and id.

Rows and anchors are dealt into blocks; a cell is one block of each, so memory
is bounded whatever the table holds. A cell scores all its pairs by integer
inner products and sorts each anchor's scores. The first pass keeps each
anchor's best rows of its own label, the positives. In the second the sorted
scores of the other labels are searched for each positive's upper limit, and
what follows down to the lower limit is read. Of several cells of one anchor
the best are merged, which is what one sort over all rows would give.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, shuffle_partitions

#: Rows and anchors of a cell at most, scores held at once, and the least rows worth a cell.
ROWS, ANCHORS, HELD, LEAST = 65_536, 16_384, 1 << 21, 1_024


def quantised(vectors: pa.ChunkedArray | pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of one length, as doubles that hold integers."""
    flat = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * x).reshape(len(flat), -1 if len(flat) and len(x) else 0)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All integer inner products of a's rows and b's: exact in single precision where norms allow it, else in double, else in Python's integers.

    A score beyond 64 bits is the largest or smallest of 64 bits.
    """
    top = float(np.sqrt((a * a).sum(1).max(initial=0) * (b * b).sum(1).max(initial=0)))
    if top < 1 << 23:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if top < 1 << 52:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m.tolist()], dtype=object).reshape(m.shape)
    most = np.iinfo(np.int64).max
    return np.clip(whole(a) @ whole(b).T, -most, most).astype(np.int64)


def _sorted(a: np.ndarray, ids: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each anchor's scores against b, highest first, ties by id, and the rows they belong to; ids ascend."""
    s = scores(a, b)
    # ids ascend, so a stable order by score alone is that by score and id.
    order = np.argsort(-s, axis=1, kind="stable") if len(ids) else np.zeros((len(a), 0), np.int64)
    return np.take_along_axis(s, order, 1), order


def _chunks(n: int, width: int):
    step = max(1, HELD // max(width, 1))
    return ((i, min(i + step, n)) for i in range(0, n, step))


_BEST = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
_NEAR = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def _placed(t: pa.Table, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = t.sort_by("id")
    return t.column("id").to_numpy(), t.column("label").to_numpy(), quantised(t.column("vec"), scale)


def _positives(rows: pa.Table, anchors: pa.Table, scale: int, k: int) -> pa.Table:
    """The best k rows of each anchor's own label in this cell."""
    out = []
    if len(rows) and len(anchors):
        ids, label, vec = _placed(rows, scale)
        aid, alabel, avec = _placed(anchors, scale)
        for own in np.unique(alabel):
            r, a = np.flatnonzero(label == own), np.flatnonzero(alabel == own)
            for lo, hi in _chunks(len(a), len(r)):
                s, order = _sorted(avec[a[lo:hi]], ids[r], vec[r])
                # One more than k, since the anchor may be among them.
                s, order = s[:, : k + 1], order[:, : k + 1]
                at, found = np.repeat(aid[a[lo:hi]], s.shape[1]), ids[r][order].ravel()
                out.append((at[at != found], found[at != found], s.ravel()[at != found]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table([pa.array(c, pa.int64()) for c in cols], schema=_BEST)


def _negatives(rows: pa.Table, anchors: pa.Table, scale: int, k: int, lower: int, upper: int) -> pa.Table:
    """For each anchor and positive, the best k rows of other labels in this cell whose score is ``lower`` to ``upper`` per cent of the positive's."""
    out: list[tuple] = []
    if len(rows) and len(anchors):
        ids, label, vec = _placed(rows, scale)
        anchors = anchors.sort_by("id")
        aid, alabel, avec = _placed(anchors, scale)
        positives = anchors.column("positives").to_pylist()
        for own in np.unique(alabel):
            r, a = np.flatnonzero(label != own), np.flatnonzero(alabel == own)
            for lo, hi in _chunks(len(a), len(r)):
                s, order = _sorted(avec[a[lo:hi]], ids[r], vec[r])
                for i, at in enumerate(a[lo:hi]):
                    down = -s[i]
                    for p in positives[at]:
                        best = p["positive_score"]
                        # 100 * score <= upper * best, in whole numbers: score <= floor(upper * best / 100).
                        first = int(np.searchsorted(down, -(upper * best // 100), "left"))
                        for j in range(first, min(first + k, len(down))):
                            if lower * best > 100 * int(s[i, j]):
                                break
                            out.append((int(aid[at]), p["positive_id"], best, int(ids[r[order[i, j]]]), int(s[i, j])))
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], schema=_NEAR)


def _first(df: DataFrame, by: list[str], score: str, tie: str, k: int, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    scale: int = 256, positives: int = 5, negatives: int = 3, lower: int = 50, upper: int = 95,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the rows for which ``anchor`` holds.

    A component x counts as floor(scale * x); a score is the integer inner
    product with the anchor, higher ones come first, ties by smaller id. An
    anchor's positives are its first other rows of the same label; for each, the
    negatives are the first rows of another label whose score is ``lower`` to
    ``upper`` per cent of the positive's. Anchors without a positive and positives
    without a negative have no row. Rows without an id or label, without a vector
    or with a null, infinite or undefined component take no part. Rows are only
    scored against anchors of as many components. Rows that share an id are one
    row, that of the least label and then the least vector. An empty table gives
    an empty result; other columns are left out.
    """
    x = F.col(vec_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    base = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull()).filter(~bad)
    base = base.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), x.alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    base = base.groupBy("id").agg(F.min(F.struct("label", "vec", "anchor")).alias("v")).select("id", "v.*", F.size("v.vec").alias("dim"))
    base = settled(base)
    n, m = base.agg(F.count("*"), F.count_if("anchor")).first()
    blocks = max(-(-n // ROWS), min(shuffle_partitions(rows.sparkSession), -(-n // LEAST)), 1)
    groups = max(-(-m // ANCHORS), 1)
    block = lambda seed, k: F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    cell = ["dim", "block", "group"]
    r = base.select("id", "label", "vec", "dim", block(1, blocks).alias("block"), every(groups).alias("group")).groupBy(*cell)

    def asked(a: DataFrame):
        return a.withColumn("group", block(2, groups)).withColumn("block", every(blocks)).groupBy(*cell)

    anchors = base.filter("anchor").select("id", "label", "vec", "dim")
    best = r.cogroup(asked(anchors)).applyInArrow(lambda t, a: _positives(t, a, scale, positives), "anchor_id bigint, positive_id bigint, positive_score bigint")
    best = _first(best, ["anchor_id"], "positive_score", "positive_id", positives, "k")
    best = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    near = r.cogroup(asked(settled(anchors.join(best, "id")))).applyInArrow(
        lambda t, a: _negatives(t, a, scale, negatives, lower, upper),
        "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint",
    )
    out = _first(near, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives, "rank")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
