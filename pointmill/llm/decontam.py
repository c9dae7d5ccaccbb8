"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is contained in a document if at least THRESHOLD of the item's
distinct word shingles stand in it. Items are partitioned by the number of
their shingles; an item's MinHash signature is the floor((1 - THRESHOLD) * s) + 1
smallest of its s shingle hashes, with s of its partition, so a document that
contains it must hold one of them: long documents need no sketch of their own,
and no containing document is missed. Each document's shingle hashes probe
the signatures of the partitions whose items are small enough for the document,
those of a large benchmark after a sieve; what meets is verified on the exact shingles.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, settled

WIDTH, THRESHOLD = 5, 0.8
#: Signatures, items and ids are broadcast only up to so many rows and bytes; beyond, both sides are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: Leading bits of signatures by which documents' hashes are sifted where signatures aren't broadcast: a map of 128 KB.
SIEVE_BITS = 20
NO_WORD = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NO_WORD), lambda w: w != "")


def _shingles(text: Column, width: Column | int, of=None) -> Column:
    """Of each run of ``width`` words, ``of(words)``; the words are split once."""
    width = F.lit(width) if isinstance(width, int) else width
    of = of or (lambda ws, i: F.array_join(F.slice(ws, i, width), " "))
    each = lambda ws: F.when(F.size(ws) >= width, F.transform(F.sequence(F.lit(1), F.size(ws) - width + 1), lambda i: of(ws, i)))
    return F.flatten(F.filter(F.transform(F.array(_words(text)), each), lambda a: a.isNotNull()))


def _hashes(text: Column, width: int) -> Column:
    return _shingles(text, width, lambda ws, i: F.xxhash64(*[F.get(ws, i + (k - 1)) for k in range(width)]))


def index_items(items: DataFrame, item_id: str = "item_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each distinct item: ``item, width, shingles, size, partition, signature``.

    Items with fewer words than ``width`` make one shingle of all their words.
    Items without words are left out; of rows with one id each counts.
    """
    out = items.select(F.col(item_id).alias("item"), F.col(text_col).alias("t")).filter("item is not null and t is not null")
    out = out.withColumn("w", F.least(F.lit(width), F.size(_words(F.col("t"))))).filter("w > 0")
    out = out.select("item", F.col("w").alias("width"), F.array_distinct(_shingles(F.col("t"), F.col("w"))).alias("shingles"))
    out = out.withColumn("size", F.size("shingles")).withColumn("partition", F.ceil(F.log2("size")).cast("int"))
    # XXH64 of the words one after another, as documents are hashed; the width is part of the probe.
    hashed = F.array_sort(F.array_distinct(F.transform("shingles", lambda s: _chain(F.split(s, " "), width))))
    keep = F.least(F.floor(F.pow(F.lit(2.0), "partition") * F.lit(1 - threshold) + F.lit(1e-9)).cast("int") + 1, F.size(hashed))
    return out.withColumn("signature", F.slice(hashed, F.lit(1), keep)).distinct()


def _chain(words: Column, most: int) -> Column:
    out = F.xxhash64(*[F.get(words, F.lit(k)) for k in range(most)])
    for n in range(most - 1, 0, -1):
        out = F.when(F.size(words) == n, F.xxhash64(*[F.get(words, F.lit(k)) for k in range(n)])).otherwise(out)
    return out


def _bytes(df: DataFrame, *columns: str) -> int:
    """Rows of df in bytes, by the lengths of what grows in it."""
    return df.agg(F.coalesce(F.sum(sum((F.length(F.col(c).cast("string")) for c in columns), F.lit(40))), F.lit(0))).first()[0]


def _sifted(seen: DataFrame, signatures: DataFrame) -> DataFrame:
    """seen (a text's hashes hs) with only those hashes whose leading bits some signature (sig) has.

    The leading SIEVE_BITS bits of all signatures are one row of fixed size, so
    hashes are sifted where they are made, before any of them is shuffled.
    """
    bit = lambda v: F.shiftrightunsigned(v, 64 - SIEVE_BITS)
    word, low = (lambda v: F.shiftright(bit(v), 6).cast("int")), (lambda v: bit(v).bitwiseAND(F.lit(63)).cast("int"))
    words = signatures.groupBy(word(F.col("sig")).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), low(F.col("sig")))).alias("bits"))
    # All words of the map in order, those without a bit too.
    whole = seen.sparkSession.range(1 << (SIEVE_BITS - 6)).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    bitmap = whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))), lambda x: x["bits"]).alias("map"))
    held = lambda v: F.call_function("shiftright", F.get("map", word(v)), low(v)).bitwiseAND(F.lit(1)) == 1
    return seen.crossJoin(F.broadcast(bitmap)).select("d", "h", "m", F.filter("hs", held).alias("hs"))  # one row of fixed size


def _contained(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, width: int, threshold: float) -> DataFrame | None:
    """``d, h, item, containment`` of the items that a text (its id d, which may be null, and a hash h of it) contains; None without items."""
    index = settled(index_items(items, item_id, item_text, width, threshold))
    texts = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).filter("t is not null").withColumn("h", F.xxhash64("t"))
    widths = sorted(r[0] for r in index.select("width").distinct().collect())  # at most ``width`` numbers
    met = None
    for w in widths:
        # A text with fewer shingles than the least item of a size partition must hold contains none of it.
        own = index.filter(F.col("width") == w).groupBy("partition").agg(F.min("size").alias("least"))
        own = index.filter(F.col("width") == w).join(F.broadcast(own), "partition").select(F.explode("signature").alias("sig"), "item", F.ceil(F.col("least") * F.lit(threshold) - 1e-9).alias("need"))
        own = settled(own.distinct())
        seen = texts.select("d", "h", _hashes(F.col("t"), w).alias("hs")).select("d", "h", F.size("hs").alias("m"), "hs")
        if own.count() <= BROADCAST_ROWS and _bytes(own, "item") <= BROADCAST_BYTES:
            own = F.broadcast(own)
        else:
            seen = _sifted(seen, own)
        seen = seen.select("d", "h", "m", F.explode("hs").alias("x"))
        own = seen.join(own, (F.col("x") == F.col("sig")) & (F.col("m") >= F.col("need"))).select("d", "h", "item")
        met = own if met is None else met.union(own)
    if met is None:
        return None
    # Only ids travel: each side's shingles are made or looked up where its row is.
    per = settled(met.groupBy("d", "h").agg(F.collect_set("item").alias("items")))
    few = per.count() <= BROADCAST_ROWS and _bytes(per, "d", "items") <= BROADCAST_BYTES
    per = per.select(F.col("d").alias("e"), F.col("h").alias("g"), "items")
    whole = texts.join(F.broadcast(per) if few else per, F.col("d").eqNullSafe(F.col("e")) & (F.col("h") == F.col("g")))
    whole = whole.select("d", "h", "t", F.explode("items").alias("i"))
    known = index.select("item", "width", "shingles", "size").withColumn("joined", F.array_join("shingles", " "))
    known = F.broadcast(known.drop("joined")) if _bytes(known, "joined") <= BROADCAST_BYTES else known.drop("joined")
    whole = whole.join(known, F.col("item") == F.col("i"))
    held = F.size(F.array_intersect("shingles", _shingles(F.col("t"), F.col("width")))) / F.col("size")
    out = whole.select("d", "h", "item", held.alias("containment")).filter(F.col("containment") >= threshold - 1e-12)
    return out.groupBy("d", "h", "item").agg(F.max("containment").alias("containment"))


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD
) -> DataFrame:
    """Rows ``<id_col>, item_id, containment`` for every item contained in a document.

    Null texts have no rows; documents without an id have rows with a null id;
    repeated documents of one id count as one text each, with the highest
    containment. An empty table on either side gives an empty result.
    """
    held = _contained(docs, items, id_col, text_col, item_id, item_text, width, threshold)
    if held is None:
        return docs.select(F.col(id_col)).limit(0).withColumn("item_id", F.lit(None).cast(items.schema[item_id].dataType)).withColumn("containment", F.lit(0.0))
    return held.groupBy(F.col("d").alias(id_col), F.col("item").alias("item_id")).agg(F.max("containment").alias("containment"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """One row for every row of docs: ``<id_col>, n_items, item_ids`` (ascending, comma-joined), ``max_containment, contaminated``.

    Each row is judged by its own text, rows without an id too. Documents
    without a contained item have 0, the empty string, 0.0 and false.
    """
    held = _contained(docs, items, id_col, text_col, item_id, item_text, width, threshold)
    own = docs.select(id_col, F.xxhash64(text_col).alias(f"{P}h"))
    if held is None:
        out = own.withColumns({"x": F.array().cast("array<string>"), "m": F.lit(None).cast("double")}).withColumn("x", F.when(F.col("m").isNotNull(), F.col("x")))
    else:
        per = held.groupBy(F.col("d").alias(f"{P}id"), F.col("h").alias(f"{P}g")).agg(F.sort_array(F.collect_set("item")).alias("x"), F.max("containment").alias("m"))
        out = own.join(per, F.col(id_col).eqNullSafe(F.col(f"{P}id")) & (F.col(f"{P}h") == F.col(f"{P}g")), "left")
    return out.select(
        id_col,
        F.when(F.col("x").isNull(), 0).otherwise(F.size("x")).cast("bigint").alias("n_items"),
        F.coalesce(F.array_join(F.transform("x", lambda v: v.cast("string")), ","), F.lit("")).alias("item_ids"),
        F.coalesce(F.round("m", 6), F.lit(0.0)).alias("max_containment"),
        F.col("x").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text contains a test item; rows without an id are judged too, null texts and repeated clean rows stay."""
    held = _contained(docs, items, id_col, text_col, item_id, item_text, width, threshold)
    if held is None:
        return docs
    held = held.select(F.col("d").alias(f"{P}id"), F.col("h").alias(f"{P}h")).distinct()
    return docs.join(held, F.col(id_col).eqNullSafe(F.col(f"{P}id")) & (F.xxhash64(text_col) == F.col(f"{P}h")), "left_anti")
