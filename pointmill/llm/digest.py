"""Canonical exact digests of documents.

A text's canonical form is NFKC, case-folded, NFKC again, with white space
folded to single blanks. Its digest is two XXH64 hashes with different seeds
(128 bits). Documents are grouped by the digest and compared byte by byte
inside equal buckets: where a bucket holds different canonical texts, their
digests get the SHA-256 of the text as a suffix, so equal digests always mean
equal canonical texts.

DataFrame functions only: normalisation and folding are the static methods of
the Unicode library that Spark itself ships, called through reflect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import P, settled, shuffle_partitions, spread_join

#: Ids of documents to compare are broadcast only up to so many; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000


def canonical(text: Column) -> Column:
    """The canonical form; null counts as empty."""
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(fold), r"[\s\p{Z}]+", " "))


def _hashes(canon: Column) -> Column:
    """Both hashes; the canonical text is made once."""
    return F.transform(F.array(canon), lambda c: F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(7), c).alias("b")))[0]


def _hex(h: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h["a"]), 16, "0"), F.lpad(F.hex(h["b"]), 16, "0")))


def colliding_buckets(docs: DataFrame, hashed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``a, b`` of the buckets whose canonical texts differ: byte comparison inside equal buckets.

    hashed has ``id, h`` of docs. Only documents that share a bucket are read
    again; the least and the greatest text of a bucket meet, after map-side
    aggregation, so that a large group of copies costs no more than others.
    """
    several = settled(hashed.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1"))
    ids = settled(spread_join(hashed, several, "h", "c").select(F.col("id").alias(f"{P}id")).distinct())
    near = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    texts = docs.join(near, F.col(id_col) == F.col(f"{P}id"), "left_semi").select(canonical(F.col(text_col)).alias("c"))
    texts = texts.select("c", _hashes(F.col("c")).alias("h"))
    return texts.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").select(F.col("h.a").alias("a"), F.col("h.b").alias("b"))


def _ring(rows: DataFrame) -> DataFrame:
    """rows (``id, r, n, f``, distinct, ids not null) with ``next`` and ``prev``, in the order of id then r; the ends meet.

    Range partitions are ordered inside by a window each; only the first and
    last row of each partition, as many as there are partitions, meet in one place.
    """
    spark = rows.sparkSession
    placed = settled(rows.repartitionByRange(shuffle_partitions(spark), "id", "r").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("id", "r")
    own = F.struct("id", "r", "n", "f")
    placed = placed.select("part", "id", "r", "n", "f", F.lead(own).over(inside).alias("next"), F.lag(own).over(inside).alias("prev"))
    ends = placed.groupBy("part").agg(F.min(F.when(F.col("prev").isNull(), own)).alias("first"), F.max(F.when(F.col("next").isNull(), own)).alias("last"))
    across = Window.orderBy("part")
    everywhere = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        F.col("part").alias("p"),
        F.coalesce(F.lead("first").over(across), F.first("first").over(everywhere)).alias("after"),
        F.coalesce(F.lag("last").over(across), F.last("last").over(everywhere)).alias("before"),
    )
    out = placed.join(F.broadcast(ends), F.col("part") == F.col("p"))
    return out.select("id", "r", "n", "f", F.coalesce("next", "after").alias("next"), F.coalesce("prev", "before").alias("prev"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, fingerprint`` for every row; equal canonical texts, and only they, have equal fingerprints.

    Null text counts as empty. Rows without an id have a fingerprint too; repeated rows repeat it.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    hashed = settled(own.select("id", _hashes(canonical(F.col("t"))).alias("h")))
    bad = settled(colliding_buckets(docs, hashed, id_col, text_col))
    if not bad.limit(1).count():
        return hashed.select(F.col("id").alias(id_col), _hex(F.col("h")).alias("fingerprint"))
    return _suffixed(own.select(F.col("id").alias(id_col), canonical(F.col("t")).alias("c")), "c", "fingerprint", bad).drop("c")


def _suffixed(df: DataFrame, canon: str, name: str, bad: DataFrame) -> DataFrame:
    h = df.withColumn(f"{P}h", _hashes(F.col(canon)))
    x = bad.select(F.struct("a", "b").alias(f"{P}bad"))
    h = h.join(x, F.col(f"{P}h") == F.col(f"{P}bad"), "left")
    tail = F.when(F.col(f"{P}bad").isNotNull(), F.concat(F.lit("-"), F.sha2(canon, 256))).otherwise("")
    return h.withColumn(name, F.concat(_hex(F.col(f"{P}h")), tail)).drop(f"{P}h", f"{P}bad")


def edited_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document.

    Per row ``<id_col>, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. The edited text has its last floor(n_chars / 2)
    code points replaced by the first as many (or all) of the next document in
    the order of ids (rows of one id: in the order of a hash of their text;
    repeated rows count once). Exact digests are alike or not: 1.0 or 0.0. Rows
    without an id have no next document: the replaced half is just cut, near_next is 0.0.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("r", F.xxhash64("t"))
    rows = settled(own.select("id", "r", F.length("t").cast("bigint").alias("n"), _hashes(canonical(F.col("t"))).alias("h")))
    bad = settled(colliding_buckets(docs, rows.select("id", "h"), id_col, text_col))
    if bad.limit(1).count():
        whole = own.select("id", "r", F.length("t").cast("bigint").alias("n"), canonical(F.col("t")).alias("c"))
        rows = settled(_suffixed(whole, "c", "f", bad).drop("c"))
    else:
        rows = rows.select("id", "r", "n", _hex(F.col("h")).alias("f"))
    once = rows.filter("id is not null").distinct()
    ring = settled(
        _ring(once).select(
            F.col("id").alias("i"), F.col("r").alias("s"), "f", F.col("next.f").alias("next_f"),
            F.col("prev.id").alias("prev_id"), F.col("prev.r").alias("prev_r"), F.floor(F.col("prev.n") / 2).cast("int").alias("need"),
        )
    )
    mine = own.filter("id is not null").join(ring, (F.col("id") == F.col("i")) & (F.col("r") == F.col("s"))).drop("i", "s")
    heads = mine.select(F.col("prev_id").alias("i"), F.col("prev_r").alias("s"), F.substring(F.col("t"), F.lit(1), F.col("need")).alias("head"))
    if rows.filter("id is not null").count() > ring.count():
        heads = heads.groupBy("i", "s").agg(F.first("head").alias("head"))
    out = mine.join(heads, (F.col("id") == F.col("i")) & (F.col("r") == F.col("s")), "left").select("id", "t", "f", "next_f", "head")
    if rows.filter("id is null").limit(1).count():
        alone = _suffixed(own.filter("id is null").select("id", "t", canonical(F.col("t")).alias("c")), "c", "f", bad)
        out = out.unionByName(alone.select("id", "t", "f", F.lit(None).cast("string").alias("next_f"), F.lit("").alias("head")))
    n = F.length("t")
    keep = n - F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), keep), F.coalesce("head", F.lit("")))
    out = out.select("id", n.cast("bigint").alias("n_chars"), "t", F.col("f").alias("fingerprint"), "next_f", edited.alias("e"))
    # An edited text whose hashes are those of its text is compared with it byte by byte, as in a bucket.
    near = F.col("fingerprint").startswith(F.col("x"))
    same = F.when(near, canonical(F.col("t")) == canonical(F.col("e"))).otherwise(False)
    out = out.withColumn("x", _hex(_hashes(canonical(F.col("e"))))).withColumn("same", same)
    tail = F.when(near & ~F.col("same"), F.concat(F.lit("-"), F.sha2(canonical(F.col("e")), 256))).otherwise("")
    out = out.withColumn("edited_fingerprint", F.when(F.col("same"), F.col("fingerprint")).otherwise(F.concat("x", tail)))
    return out.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("e", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double").alias("near_edited"),
        F.coalesce((F.col("fingerprint") == F.col("next_f")).cast("double"), F.lit(0.0)).alias("near_next"),
    )
