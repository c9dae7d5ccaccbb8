"""MinHash near-duplicates by bottom-k sketches of one hash function.

A text is its set of word shingles. One function maps shingles to ordered
values, and a set's sketch is its k smallest. k grows with the set: at a
similarity of 0.8, two sets cannot differ in more than a fifth of the larger,
so a fifth and one more of its values, and a ninth and one more of the smaller
one's, must have a value in common. Inverted lists of the retained values
therefore generate every pair, and the filters that follow (positions in the
sketches, then the union of both sketches) reject only pairs that cannot reach
the similarity. Full sets confirm what is left, so no link is missed or wrong.

The hash function puts shingles known to be common behind all others, the rarer
first. Which ones these are decides how long the lists get, never the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import P, connected_components, spread_join, stored
from .simhash import shingle_set

#: Shingle width, and the least similarity in per cent.
WIDTH, PERCENT = 4, 80
#: Common shingles are those that SEEN or more different texts of a SAMPLE-th of all hold; the driver takes the commonest ORDERED of them.
SAMPLE, SEEN, ORDERED = 16, 3, 400_000
#: Lists that would make more than LEAD * LEAD pairs are linked through single sets first; what is then left of a list is paired in blocks of about BLOCK sets.
LEAD, BLOCK = 64, 256
#: How many sets of a long list are compared with all of it, turn by turn.
TURNS = (1, 16, 64)
#: Rows of a key beyond this share of all rows are dealt out over several copies of what they are joined with.
SHARE = 2_000
#: Ids of texts to fetch are broadcast up to so many; beyond, both sides are shuffled.
BROADCAST_ROWS = 300_000
#: Values of common shingles start here; all others are hashes below.
COMMON = 1 << 62


def _ordered(s: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The values of a set's shingle hashes ``s``, ascending: two bits shorter, those in ``common`` (ascending) replaced by COMMON and their rank."""
    value = (s >> np.uint64(2)).astype(np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        known = common[at] == s
        value[known] = COMMON + rank[at[known]]
    return np.sort(value)


def _digest(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, as signed longs."""
    import xxhash

    raw = s.tobytes()
    return tuple(int(np.uint64(xxhash.xxh64_intdigest(raw, seed)).astype(np.int64)) for seed in (1, 2))


def _retained(n: int, percent: int) -> tuple[int, int]:
    """How many of n values a set keeps to meet larger sets, and to meet smaller ones."""
    return n - -(-2 * percent * n // (100 + percent)) + 1, n - -(-percent * n // 100) + 1


_SKETCH = "struct<h1:bigint,h2:bigint,n:int,few:int,w:array<bigint>>"


def _sketches(text: pa.Array, width: int, percent: int, common: np.ndarray, rank: np.ndarray) -> pa.Array:
    h1, h2, n, few, at, parts = [], [], [], [], [0], []
    for t in text:
        s = shingle_set(t.as_py(), width)
        a, b = _digest(s)
        f, k = _retained(len(s), percent)
        k = min(k, len(s))
        h1.append(a), h2.append(b), n.append(len(s)), few.append(f)
        parts.append(_ordered(s, common, rank)[:k])
        at.append(at[-1] + k)
    w = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
    return pa.StructArray.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int32()), pa.array(few, pa.int32()), w], ["h1", "h2", "n", "few", "w"])


_SET = "struct<h1:bigint,h2:bigint,s:array<bigint>>"


def _sets(text: pa.Array, width: int) -> pa.Array:
    h1, h2, sets = [], [], []
    for t in text:
        s = shingle_set(t.as_py(), width)
        a, b = _digest(s)
        h1.append(a), h2.append(b), sets.append(s.view(np.int64))
    return pa.StructArray.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["h1", "h2", "s"])


def _common_shingles(docs: DataFrame, raw: Column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of common shingles, ascending, and their rank from rare to common."""
    part = docs.select(raw.alias("t")).withColumn("h", F.xxhash64("t")).filter(F.pmod("h", F.lit(SAMPLE)) == 0).groupBy("h").agg(F.first("t").alias("t"))
    sets = F.arrow_udf(lambda x: pa.array([shingle_set(t.as_py(), width).view(np.int64) for t in x], pa.list_(pa.int64())), "array<bigint>")
    often = part.select(F.explode(sets("t")).alias("key")).groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") >= SEEN)
    got = often.orderBy(F.desc("c"), "key").limit(ORDERED).toArrow()
    keys, c = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((keys, c))] = np.arange(len(keys))
    order = np.argsort(keys)
    return keys[order], rank[order]


def _kept(df: DataFrame) -> DataFrame:
    """Rows computed once. Written as a table, since what Spark infers from one checkpoint to the next doubles in each turn."""
    return stored(df, "minhash")


def with_both(pairs: DataFrame, table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """pairs ``a, b`` with columns of both nodes' rows of table (node, each once), named by ``columns`` and a or b.

    Pairs of a node that is in many of them are dealt out over copies of its row.
    Fewer than SHARE nodes a side are that hot, and together they get at most twice
    as many copies, so the driver takes their numbers. pairs is read three times: keep it first.
    """
    total = pairs.count()
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.col(s).alias("v")) for s in "ab"))).alias("x")
    often = pairs.select(sides).groupBy("x.s", "x.v").agg(F.count("*").alias("n")).filter(F.col("n") * F.lit(SHARE) > F.lit(total)).collect()
    out = pairs
    for s, other in ("ab", "ba"):
        one = table.select(F.col("node").alias(s), *(F.col(c).alias(f"{name}{s}") for c, name in columns.items()))
        many = [(r["v"], -(-r["n"] * SHARE // total)) for r in often if r["s"] == s]
        if not many:
            out = out.join(one, s)
            continue
        hot = F.broadcast(pairs.sparkSession.createDataFrame(many, f"{s} bigint, __k bigint"))
        k = F.coalesce("__k", F.lit(1))
        out = out.join(hot, s, "left").withColumn("__s", F.pmod(F.xxhash64(other), k)).drop("__k")
        one = one.join(hot, s, "left").withColumn("__s", F.explode(F.sequence(F.lit(0).cast("bigint"), k - 1))).drop("__k")
        out = out.join(one, [s, "__s"]).drop("__s")
    return out


def _reach(common: Column, na: Column, nb: Column, percent: int) -> Column:
    """Whether sets of na and nb shingles with so many in common are alike."""
    return common * (100 + percent) >= (na + nb) * percent


def _union_filter(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of nodes that the union of both sketches leaves possible.

    Up to the smaller of their last values, both sketches are whole, so the
    union's share of common values there is an estimate of the similarity, and
    with all that lies behind in common it bounds the similarity from above.
    """

    def most(wa: pa.Array, wb: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        out = []
        for x, y, n, m in zip(wa, wb, na.to_pylist(), nb.to_pylist(), strict=True):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            last = min(x[-1], y[-1])
            x, y = x[: np.searchsorted(x, last, "right")], y[: np.searchsorted(y, last, "right")]
            out.append(len(np.intersect1d(x, y, assume_unique=True)) + min(n - len(x), m - len(y)))
        return pa.array(out, pa.int32())

    both = with_both(pairs, sets, {"n": "n", "w": "w"})
    best = F.arrow_udf(most, "int")("wa", "wb", "na", "nb")
    return _kept(both.withColumn("best", best).filter(_reach(F.col("best"), F.col("na"), F.col("nb"), percent)).select("a", "b"))


def _full_sets(docs: DataFrame, sets: DataFrame, nodes: DataFrame, id_col: str, raw: Column, width: int) -> DataFrame:
    """``node, n, s``: all shingle hashes of the nodes asked for, from their documents' texts."""
    wanted = _kept(sets.select("node", "rep", "h1", "h2", "n").join(nodes, "node"))
    near = F.broadcast if wanted.count() <= BROADCAST_ROWS else (lambda v: v)
    # Not deterministic for Spark, so that no filter on its result moves before the join that leaves few texts.
    hashed = F.arrow_udf(lambda t: _sets(t, width), _SET).asNondeterministic()
    full = docs.select(F.col(id_col).alias("rep"), raw.alias("t")).join(near(wanted.select("rep").distinct()), "rep", "left_semi")
    full = full.select("rep", hashed("t").alias("f")).select("rep", "f.*")
    # Rows may share an id: the set itself tells which of them is meant.
    return _kept(full.join(near(wanted), ["rep", "h1", "h2"]).select("node", "n", "s").dropDuplicates(["node"]))


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of nodes whose full sets are alike."""

    def shared(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([len(np.intersect1d(a.values.to_numpy(), b.values.to_numpy(), assume_unique=True)) for a, b in zip(x, y, strict=True)], pa.int32())

    both = with_both(pairs, full, {"n": "n", "s": "s"})
    alike = _reach(F.arrow_udf(shared, "int")("sa", "sb"), F.col("na"), F.col("nb"), percent)
    return _kept(both.filter(alike).select("a", "b"))


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _long_lists(met: DataFrame) -> DataFrame:
    """``key, size``: lists whose sets of different components would make many pairs."""
    by_comp = met.groupBy("key", "size", "comp").agg(F.count("*").alias("m"))
    lists = by_comp.groupBy("key", "size").agg(F.sum("m").alias("c"), F.sum(F.col("m") * F.col("m")).alias("q"))
    return _kept(lists.filter((F.col("c") * F.col("c") - F.col("q")) / 2 > LEAD * LEAD).select("key", "size"))


def _with_components(met: DataFrame, links: DataFrame) -> DataFrame:
    comp = connected_components(links, "a", "b").withColumnRenamed("node", "linked")
    out = met.drop("comp").join(comp, F.col("node") == F.col("linked"), "left")
    return _kept(out.withColumn("comp", F.coalesce("root", "node")).drop("linked", "root"))


def _with_leads(met: DataFrame, links: DataFrame, lead: DataFrame) -> DataFrame:
    """met whose sets take the least component of the leads (lead, other: its component) they are linked to, if it is less than their own.

    Sets of equal components are then linked, if not the other way round; it takes one aggregation.
    """
    own = lead.groupBy(F.col("lead").alias("to")).agg(F.min("other").alias("root"))
    both = links.select(F.col("a").alias("linked"), F.col("b").alias("to")).union(links.select("b", "a"))
    star = both.join(own, "to").groupBy("linked").agg(F.min("root").alias("root"))
    out = met.join(star, F.col("node") == F.col("linked"), "left")
    return _kept(out.withColumn("comp", F.least("comp", "root")).drop("linked", "root"))


def _links_of_long_lists(met: DataFrame, docs: DataFrame, sets: DataFrame, id_col: str, raw: Column, width: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """met with the components that links within long lists make, and these links.

    Of each list the set whose values most others hold is compared with all of it, as the source of many
    near copies would be; then, in turns, more and more of its sets with those still in
    another component. A large group thus needs few comparisons for each copy. What
    stays apart is left to the comparison of all pairs.
    """
    held = met.groupBy("node").agg(F.count_if(F.col("c") > LEAD).alias("_held"))
    kept = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    rank = _kept(held.join(sets.select("node", "n"), "node").select("node", (F.col("_held") / kept).alias("held")))
    links, full = None, None
    for turn, leads in enumerate(TURNS):
        lists = _long_lists(met)
        if not lists.limit(1).count():
            break
        near = F.broadcast if lists.count() <= BROADCAST_ROWS else (lambda v: v)
        own = met.join(near(lists), ["key", "size"]).select("key", "size", "node", "comp", "n", (F.col("n") - F.col("pos")).alias("upto"))
        if full is None:
            full = _full_sets(docs, sets, own.select("node").distinct(), id_col, raw, width)
        own = _kept(own.join(rank, "node"))
        first = [F.desc("held")] if turn == 0 else []
        w = Window.partitionBy("key", "size").orderBy(*first, F.xxhash64(F.lit(turn), "node"), "node")
        lead = _kept(own.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= leads).select("key", "size", F.col("node").alias("lead"), F.col("comp").alias("other"), F.col("n").alias("m"), F.col("upto").alias("most")))
        near = F.broadcast if lead.count() <= BROADCAST_ROWS else (lambda v: v)
        pairs = own.join(near(lead), ["key", "size"]).filter((F.col("comp") != F.col("other")) & _reach(F.least("upto", "most"), F.col("n"), F.col("m"), percent)).select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b"))
        found = _confirmed(_union_filter(_kept(pairs.distinct()), sets, percent), full, percent)
        links = found if links is None else _kept(links.union(found))
        met = _with_leads(met, found, lead) if turn == 0 else _with_components(met, links)
    return met, links


def _candidates(met: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of nodes of different components that meet in a list and may be alike by their positions.

    A list's sets are dealt into blocks and every two blocks meet in a cell of
    their own, so that a long list is no single task. All that two sets have in
    common lies at or behind their first meeting, and behind their last one but
    for the meetings themselves.
    """
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    e = met.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    x = e.filter("pos < few").withColumnRenamed("own", "bx").withColumnRenamed("other", "by").alias("x")
    y = e.withColumnRenamed("own", "by").withColumnRenamed("other", "bx").withColumn("size", F.explode(F.array(F.col("size"), F.col("size") - 1))).alias("y")
    nx, ny = F.col("x.n"), F.col("y.n")
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.bx") == F.col("y.bx")) & (F.col("x.by") == F.col("y.by"))
    on &= ((nx < ny) | ((nx == ny) & (F.col("x.node") < F.col("y.node")))) & (F.col("x.comp") != F.col("y.comp"))
    on &= _reach(F.least(nx - F.col("x.pos"), ny - F.col("y.pos")), nx, ny, percent)
    both = x.join(y, on).groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"), nx.alias("na"), ny.alias("nb"))
    both = both.agg(F.count("*").alias("k"), F.max("x.pos").alias("i"), F.max("y.pos").alias("j"))
    best = F.col("k") + F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")) - 1
    return both.filter(_reach(best, F.col("na"), F.col("nb"), percent)).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row a document: ``<id_col>, n_shingles, component_id, kept``.

    Words end at ASCII white space, A-Z are lower-cased; a text's set holds its
    distinct shingles of ``width`` words, the whole sequence where there are
    fewer, nothing where there are none. Texts are linked where the sets'
    intersection is ``percent`` per cent of the union or more; component_id is the
    smallest id reachable, kept tells that it is the document's own. Null text
    counts as empty; empty sets are linked with nothing, not with each other
    either. Repeated rows repeat their result, rows that share an id but not the
    text are linked each by its text. A row without an id links nothing: it takes
    the component of documents with the same set, else null, and isn't kept. Texts
    of any length are taken whole; an empty table gives an empty result; other
    columns are left out.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    common, rank = _common_shingles(docs, raw, width)
    sketch = F.arrow_udf(lambda t: _sketches(t, width, percent, common, rank), _SKETCH)
    own = _kept(docs.select(F.col(id_col).alias(f"{P}id"), sketch(raw).alias("s")).select(f"{P}id", "s.*"))
    # Documents with equal sets are one node; its number is stored with it.
    sets = own.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min(f"{P}id").alias("rep"), F.first("few").alias("few"), F.first("w").alias("w"), F.count("*").alias("rows"))
    sets = _kept(sets.withColumn("node", F.monotonically_increasing_id()))
    # Sets of one size class or the next are all that can be alike.
    size = F.floor(F.log(F.col("n").cast("double")) / math.log(1.01 * 100 / percent)).cast("int")
    rows = sets.filter("rep IS NOT NULL").select("node", "n", "few", size.alias("size"), F.posexplode("w").alias("pos", "key"))
    keys = rows.groupBy("key").agg(F.count("*").alias("c"), F.max((F.col("pos") < F.col("few")).cast("int")).alias("met")).filter("c > 1 AND met = 1").select("key", "c")
    met = _kept(rows.join(keys, "key").withColumn("comp", F.col("node")))
    met, links = _links_of_long_lists(met, docs, sets, id_col, raw, width, percent)
    if links is not None:
        keys = met.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
        met = met.join(keys, "key")
    pairs = _union_filter(_kept(_candidates(met, percent)), sets, percent)
    rest = _confirmed(pairs, _full_sets(docs, sets, _nodes(pairs), id_col, raw, width), percent)
    comp = connected_components(rest if links is None else links.union(rest), "a", "b").withColumnRenamed("node", "linked")
    least = comp.join(sets, F.col("linked") == F.col("node")).groupBy("root").agg(F.min("rep").alias("least"))
    named = comp.join(least, "root").select("linked", "least")
    key = F.struct("h1", "h2", "n")
    named = sets.join(named, F.col("node") == F.col("linked"), "left").select(key.alias("set"), F.coalesce("least", "rep").alias("component_id"), "rows")
    placed = spread_join(own.filter("n > 0").select(f"{P}id", "n", key.alias("set")), _kept(named), "set", "rows")
    out = placed.select(f"{P}id", "n", "component_id").union(own.filter("n = 0").select(f"{P}id", "n", f"{P}id"))
    kept = F.coalesce(F.col(f"{P}id") == F.col("component_id"), F.lit(False))
    return out.select(F.col(f"{P}id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), "component_id", kept.alias("kept"))
