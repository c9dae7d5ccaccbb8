"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance 3 or less keep, once one of the three blocks of
bits that holds a difference is left out, at most two differing bits, so the
balls of radius one around both meet in a common variant. Every fingerprint
emits, for each block left out, itself and its one-bit variants (131 in all);
fingerprints that meet on a variant are verified on all 64 bits. The search
is complete: no pair within the radius is missed. Full radius-two balls (2,081
variants) would find the same pairs at sixteen times the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, connected_components, settled, spread_join

BITS = 64
RADIUS = 3
BLOCKS = ((0, 21), (21, 42), (42, 64))
CHUNK = 1 << 16


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


MASKS = [_signed(~(((1 << (hi - lo)) - 1) << lo)) for lo, hi in BLOCKS]


def simhash64(raw: bytes, width: int = 3) -> int:
    """The fingerprint of UTF-8 text: majority bits over XXH64 (seed 42) of its word shingles.

    ASCII letters are lower-cased, words end at ASCII white space, shingles
    count with repeats. Fewer than ``width`` words make one shingle; none make 0.
    """
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = raw.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.zeros(len(words), np.int64)
    np.cumsum(length[:-1] + 1, out=start[1:])
    end = (start + length)[min(width, len(words)) - 1 :]
    total = np.zeros(BITS, np.int64)
    for i in range(0, n, CHUNK):
        pairs = zip(start[i : min(i + CHUNK, n)].tolist(), end[i : min(i + CHUNK, n)].tolist(), strict=True)
        h = np.array([digest(joined[s:e], 42) for s, e in pairs], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def _simhashes(text: pa.Array) -> pa.Array:
    return pa.array([_signed(simhash64(x.as_py() or b"")) for x in text], pa.int64())


def simhash_column(text: Column) -> Column:
    """The fingerprint of a text column, as a signed long."""
    return F.arrow_udf(_simhashes, "bigint")(text.cast("binary"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, fp`` (64 bits as a signed long) of every document; null text counts as empty."""
    return docs.select(F.col(id_col), simhash_column(F.col(text_col)).alias("fp"))


def near_pairs(fps: DataFrame) -> DataFrame:
    """All pairs ``x < y`` of different fingerprints in column fp that differ in RADIUS bits or fewer."""
    flips = [
        F.struct(F.lit(k).cast("tinyint").alias("k"), F.lit(m).cast("bigint").alias("m"), F.lit(_signed(f)).cast("bigint").alias("f"))
        for k, ((lo, hi), m) in enumerate(zip(BLOCKS, MASKS, strict=True))
        for f in [0, *(1 << i for i in range(BITS) if not lo <= i < hi)]
    ]
    ball = (
        fps.select("fp")
        .distinct()
        .select("fp", F.explode(F.array(*flips)).alias("v"))
        .select("fp", F.col("v.k").alias("k"), F.col("fp").bitwiseAND(F.col("v.m")).bitwiseXOR(F.col("v.f")).alias("z"))
    )
    x, y = ball.alias("x"), ball.alias("y")
    mask = F.when(F.col("x.k") == 0, F.lit(MASKS[0])).when(F.col("x.k") == 1, F.lit(MASKS[1])).otherwise(F.lit(MASKS[2]))
    xor = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    rest = xor.bitwiseAND(mask)
    # Of the variants on which a pair meets, one speaks for it: the smaller one's own bits, or the lesser midpoint.
    one = ((F.bit_count(rest) < 2) & (F.col("x.z") == F.col("x.fp").bitwiseAND(mask))) | (
        (F.bit_count(rest) == 2) & (F.col("x.z") < F.col("x.z").bitwiseXOR(rest))
    )
    met = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.z") == F.col("y.z")) & (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(xor) <= RADIUS) & one)
    return met.select(F.col("x.fp").alias("x"), F.col("y.fp").alias("y")).distinct()


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``<id_col>, fp, component_id, n_links``.

    component_id is the smallest id reachable over links between fingerprints
    within RADIUS bits; equal fingerprints, those of empty texts included, are
    one node. n_links counts the other fingerprints linked to the document's
    own. Rows with a null id are kept: they get the smallest id of their
    component, or null where no row of it has one. An empty table gives an
    empty result; other columns are left out.
    """
    return fingerprint_components(fingerprints(docs, id_col, text_col), id_col)


def fingerprint_components(fps: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """:func:`near_duplicate_components` of rows ``<id_col>, fp`` whose fingerprints are known."""
    fp = settled(fps.select(F.col(id_col).alias(f"{P}id"), "fp"))
    # A component's nodes are its fingerprints; the smallest id of each names it.
    node = settled(fp.groupBy("fp").agg(F.min(f"{P}id").alias("rep"), F.count("*").alias("rows")))
    pairs = settled(near_pairs(fp))
    comp = connected_components(pairs, "x", "y")
    root = comp.join(node, comp.node == node.fp).groupBy("root").agg(F.min("rep").alias("least"))
    linked = comp.join(root, "root").select(F.col("node").alias("fp"), "least")
    degree = pairs.select(F.col("x").alias("fp")).union(pairs.select("y")).groupBy("fp").agg(F.count("*").alias("n"))
    node = node.join(linked, "fp", "left").join(degree, "fp", "left")
    node = settled(node.select("fp", F.coalesce("least", "rep").alias("component_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), "rows"))
    return spread_join(fp, node, "fp", "rows").select(F.col(f"{P}id").alias(id_col), "fp", "component_id", "n_links")


#: Near copies: shingle width and similarity.
WIDTH, SIMILARITY = 5, 0.8
#: Ids of texts to compare are broadcast only up to so many; beyond, both sides are shuffled.
BROADCAST_ROWS = 300_000
#: Shingles that at least SEEN of a SAMPLE-th of the different texts hold, the commonest HOT_KEYS of them, are ordered last, rarest first. Any order gives the same pairs.
SAMPLE, SEEN, HOT_KEYS = 16, 3, 400_000
#: Prefix buckets of more than LEAD texts are first linked to their least text; buckets are paired in blocks of about BLOCK texts.
LEAD, BLOCK = 64, 500


def shingle_set(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of a text's word shingles, ascending; a text of fewer words is one shingle, one without words none."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(width, len(words))
    n = len(words) - k + 1
    h = w[:n]
    for i in range(1, k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    return np.unique(h)


def likeness(a: bytes, b: bytes, width: int = WIDTH) -> float:
    """Jaccard similarity of the word shingles of two texts; 1 where neither has a word."""
    x, y = shingle_set(a, width), shingle_set(b, width)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _ordered(s: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A set's shingles by hash, those in ``hot`` (ascending) after all others, by their rank."""
    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    late = hot[at] == s
    return np.concatenate([s[~late], s[late][np.argsort(rank[at[late]])]])


def _prefixes(text: pa.Array, similarity: float, hot: np.ndarray, rank: np.ndarray) -> pa.Array:
    """For each text its SimHash, two hashes of its shingle set, the set's size n, and its first n - ceil(similarity * n) + 1 shingles in the order of :func:`_ordered`.

    Two sets of that similarity share a shingle of their prefixes in any one order.
    """
    import xxhash

    fp, a, b, n, at, parts = [], [], [], [], [0], []
    for t in text:
        t = t.as_py() or b""
        fp.append(_signed(simhash64(t)))
        s = shingle_set(t)
        raw = s.tobytes()
        a.append(_signed(xxhash.xxh64_intdigest(raw, 1))), b.append(_signed(xxhash.xxh64_intdigest(raw, 2))), n.append(len(s))
        if len(s):
            p = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1
            parts.append((_ordered(s, hot, rank) if len(hot) else s)[: min(p, len(s))])
            at.append(at[-1] + len(parts[-1]))
        else:
            at.append(at[-1])
    keys = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.StructArray.from_arrays([pa.array(fp, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys))], ["fp", "h1", "h2", "n", "w"])


def _common_shingles(docs: DataFrame, raw: Column) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many different texts hold, ascending, and their rank from rare to common; a bounded number."""
    texts = docs.select(raw.alias("t")).withColumn("h", F.xxhash64("t")).filter(F.pmod("h", F.lit(SAMPLE)) == 0).groupBy("h").agg(F.first("t").alias("t"))
    sets = F.arrow_udf(lambda x: pa.array([shingle_set(t.as_py()).view(np.int64) for t in x], pa.list_(pa.int64())), "array<bigint>")
    often = texts.select(F.explode(sets("t")).alias("key")).groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") >= SEEN)
    got = often.orderBy(F.desc("c"), "key").limit(HOT_KEYS).toArrow()
    keys, c = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((keys, c))] = np.arange(len(keys))
    order = np.argsort(keys)
    return keys[order], rank[order]


_PREFIX = "struct<fp:bigint,h1:bigint,h2:bigint,n:int,w:array<bigint>>"


def _texts(docs: DataFrame, ids: DataFrame, id_col: str, raw: Column) -> DataFrame:
    """``i, t``: the texts of the rows with one of the ids in column i."""
    near = F.broadcast if ids.count() <= BROADCAST_ROWS else (lambda v: v)
    return docs.select(F.col(id_col).alias("i"), raw.alias("t")).join(near(ids), "i", "left_semi")


def _alike(docs: DataFrame, pairs: DataFrame, id_col: str, raw: Column, similarity: float) -> DataFrame:
    """The pairs ``a, b`` of ids whose texts are alike; of rows that share an id, any."""

    def measure(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([likeness(x.as_py() or b"", y.as_py() or b"") for x, y in zip(a, b, strict=True)], pa.float64())

    ids = settled(pairs.select(F.col("a").alias("i")).union(pairs.select("b")).distinct())
    texts = settled(_texts(docs, ids, id_col, raw).distinct())
    x, y = (texts.select(F.col("i").alias(i), F.col("t").alias(t)) for i, t in (("a", "ta"), ("b", "tb")))
    j = F.arrow_udf(measure, "double")("ta", "tb")
    return settled(pairs.join(x, "a").join(y, "b").select("a", "b", j.alias("j")).filter(F.col("j") >= similarity).select("a", "b"))


def _bucket_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: every pair of one key of ``met`` (key, rep, n, p, comp, c) that may be alike and is not of one component yet.

    A key's texts are dealt into blocks and every two blocks meet in a cell of
    their own, so that a hot key is no single task. A pair that shares k of its
    prefix shingles has at most k more the larger rest in common.
    """
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    e = met.withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    e = e.select("key", "rep", "n", "p", "comp", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    x, y = e.filter("own = lo").alias("x"), e.filter("own = hi").alias("y")
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi"))
    on &= ((F.col("x.lo") < F.col("x.hi")) | (F.col("x.rep") < F.col("y.rep"))) & (F.col("x.comp") != F.col("y.comp"))
    on &= F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(similarity) - 1e-9
    total, rest = F.col("x.n") + F.col("y.n"), F.greatest(F.col("x.n") - F.col("x.p"), F.col("y.n") - F.col("y.p"))
    both = x.join(y, on).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"), total.alias("total"), rest.alias("rest"))
    both = both.groupBy("a", "b", "total", "rest").agg(F.count("*").alias("k"))
    return both.filter(F.col("k") + F.col("rest") >= F.col("total") * F.lit(similarity / (1 + similarity)) - 1e-6).select("a", "b").distinct()


def _with_components(met: DataFrame, comp: DataFrame) -> DataFrame:
    """met with the component of each row's ``rep``, its own where it is linked to none."""
    return met.join(comp, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "rep")).drop("node", "root")


def near_copy_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``<id_col>, component_id`` of every row with an id: groups of texts alike in their word shingles.

    Two texts are linked where their sets of five-word shingles are alike by
    ``similarity`` or more. Candidates are first the texts that SimHash links
    (:func:`fingerprint_components`, the same balls and radius): each is
    compared with the least text of its component. A fingerprint tells a pair
    of that similarity only at times, so what it leaves unlinked is found by
    an exact way: such sets share a shingle of their prefixes (see _prefixes),
    and all texts that meet on one are compared unless they are linked
    already. So that a large group of copies is not expanded into all its
    pairs, the texts of a large bucket are first compared with the least of
    them. component_id is the smallest id of the group. Null text counts as
    empty; texts without a word are one group.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    hot, rank = _common_shingles(docs.filter(F.col(id_col).isNotNull()), raw)
    prefix = F.arrow_udf(lambda x: _prefixes(x, similarity, hot, rank), _PREFIX)
    own = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias(f"{P}id"), prefix(raw).alias("s")).select(f"{P}id", "s.*")
    own = settled(own)
    first = settled(own.groupBy("h1", "h2", "n").agg(F.min(f"{P}id").alias("rep"), F.first("fp").alias("fp"), F.first("w").alias("w"), F.count("*").alias("rows")))
    own = own.drop("w", "fp")
    # The method: SimHash components, each text held against the least of its own.
    hashed = fingerprint_components(first.filter("n > 0").select(F.col("rep").alias("i"), "fp"), "i")
    star = settled(hashed.filter("i <> component_id").select(F.col("component_id").alias("a"), F.col("i").alias("b")).distinct())
    links = _alike(docs, star, id_col, raw, similarity)
    comp = connected_components(links, "a", "b")
    # The exact way for the rest.
    node = first.filter("n > 0").select("rep", "n", "w")
    rows = node.select("rep", "n", F.size("w").alias("p"), F.explode("w").alias("key"))
    keys = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("lead")).filter("c > 1")
    met = settled(_with_components(rows.join(keys, "key"), comp).select("key", "rep", "n", "p", "comp", "c", "lead"))
    large = met.filter((F.col("c") > LEAD) & (F.col("lead") != F.col("rep")))
    if large.limit(1).count():
        pairs = large.select(F.col("lead").alias("a"), F.col("rep").alias("b"), "comp").distinct()
        pairs = pairs.join(comp, F.col("a") == F.col("node"), "left").filter(F.coalesce("root", "a") != F.col("comp"))
        links = links.union(_alike(docs, settled(pairs.select("a", "b")), id_col, raw, similarity))
        comp = connected_components(links, "a", "b")
        met = settled(_with_components(met.select("key", "rep", "n", "p", "c"), comp))
    keys = met.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
    rest = _alike(docs, settled(_bucket_pairs(met.join(keys, "key"), similarity)), id_col, raw, similarity)
    comp = connected_components(links.union(rest), "a", "b")
    # Rows of one shingle set share a key of three columns, held as one.
    key = F.struct("h1", "h2", "n")
    rep = settled(first.join(comp, F.col("rep") == F.col("node"), "left").select(key.alias("set"), F.coalesce("root", "rep").alias("component_id"), "rows"))
    return spread_join(own.select(f"{P}id", key.alias("set")), rep, "set", "rows").select(F.col(f"{P}id").alias(id_col), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies (SimHash, then the exact search for what it leaves): the one whose id names the group.

    Of several rows with that id one stays. Rows without an id are no part of
    any group: they stay, equal texts once.
    """
    comp = near_copy_components(docs, id_col, text_col)
    keep = comp.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(f"{P}id")).distinct()
    out = docs.join(keep, F.col(id_col) == F.col(f"{P}id"), "left_semi")
    # One row for each id that several rows share; a look at the ids tells whether there are any.
    n, d = docs.filter(F.col(id_col).isNotNull()).agg(F.count(id_col), F.countDistinct(id_col)).first()
    if n > d:
        out = out.dropDuplicates([id_col])
    if docs.filter(F.col(id_col).isNull()).limit(1).count():
        out = out.unionByName(docs.filter(F.col(id_col).isNull()).dropDuplicates([text_col]))
    return out
