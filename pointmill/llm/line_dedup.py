"""Line deduplication by a log-template tree of fixed depth.

A line's variable fields (runs of digits) are masked; its path in the tree is
its number of tokens and its leading tokens, and the leaf at the end of the
path holds its templates. Lines of one leaf that agree in at least SIMILARITY
of their tokens, position by position, fall into one template. Where one or
two tokens may differ, one of two or three segments is equal; lines that meet
on one are joined on all ways to leave out so many tokens, which finds every
pair without comparing all lines. Where more may differ, d of them, lines meet
on one of their d + 1 rarest placed tokens; each is compared with the most
frequent line of its bucket, and then with every line there that is not of its
template yet. A template that recurs in several documents stays in
the first of them and is dropped from the others.

Everything is DataFrame work: lines travel as hashes, only leaves that hold
different lines are looked at token by token, and hot lines are counted before
they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, SHARE, connected_components, settled, spread_join

#: Tree depth (leading tokens), similarity within a leaf, and from how many documents on a template recurs.
DEPTH, SIMILARITY, MIN_DOCS = 3, 0.8, 2
#: Leaves with different lines, and documents to read again, are broadcast only up to so many; beyond, both sides are shuffled.
BROADCAST_ROWS = 300_000
#: Up to so many differences lines meet on masked tokens; beyond, in pairs, a bucket's lines in blocks of about BLOCK.
MASKED, BLOCK = 2, 500


def _lines(docs: DataFrame, id_col: str, text_col: str, depth: int) -> DataFrame:
    """id, pos, masked line, its hash h, its length n in tokens and its leaf; blank lines are left out."""
    text = F.col(text_col)
    # Most texts have neither digits nor odd white space: one look at the text spares a look at each line.
    odd = text.contains("  ") | text.contains("\t") | text.contains("\r") | text.contains("\f")
    out = docs.select(F.col(id_col).alias("id"), text.alias("t"), text.rlike("[0-9]").alias("digits"), odd.alias("odd"))
    out = out.select("id", "digits", "odd", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    masked = F.when(F.col("digits"), F.regexp_replace("line", "[0-9]+", "#")).otherwise(F.col("line"))
    masked = F.when(F.col("odd"), F.regexp_replace(masked, "[ \t\r\f]+", " ")).otherwise(masked)
    out = out.select("id", "pos", F.trim(masked).alias("masked")).filter("masked <> ''")
    n = F.length("masked") - F.length(F.replace(F.col("masked"), F.lit(" "), F.lit(""))) + 1
    return out.select("id", "pos", "masked", F.xxhash64("masked").alias("h"), n.alias("n"), F.xxhash64(n, F.substring_index("masked", " ", depth)).alias("leaf"))


def _differences(n, similarity: float):
    """How many of n tokens may differ."""
    return F.floor(n * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")


def _templates(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str, depth: int, similarity: float) -> DataFrame:
    """h, template of the lines that share a template with a different line."""
    leaves = lines.groupBy("leaf").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select(F.col("leaf").alias("full"))
    leaves = settled(leaves)
    near = F.broadcast if leaves.count() <= BROADCAST_ROWS else (lambda x: x)
    many = settled(lines.join(near(leaves), F.col("leaf") == F.col("full"), "left_semi").groupBy("leaf", "n", "h").agg(F.count("*").alias("seen"), F.min("id").alias("id")))
    # Their texts are read again from one document for each line.
    homes = settled(many.select(F.col("id").alias(f"{P}home")).distinct())
    close = F.broadcast if homes.count() <= BROADCAST_ROWS else (lambda x: x)
    text = _lines(docs.join(close(homes), F.col(id_col) == F.col(f"{P}home"), "left_semi"), id_col, text_col, depth)
    text = text.join(near(leaves), F.col("leaf") == F.col("full"), "left_semi").filter(_differences(F.col("n"), similarity) >= 1)
    text = text.groupBy("h").agg(F.first("masked").alias("masked"))
    text = settled(many.join(text.withColumnRenamed("h", f"{P}h"), F.col("h") == F.col(f"{P}h")).select("leaf", "n", "h", "seen", "masked"))
    few = _differences(F.col("n"), similarity) <= MASKED
    parts = settled(_segments(text.filter(few), similarity).union(_prefixes(text.filter(~few), depth, similarity)))
    head = parts.groupBy("key").agg(F.max(F.struct("seen", "h")).alias("top"), F.count("*").alias("c")).filter("c > 1")
    head = settled(head.select("key", F.col("top.h").alias("o"), "c"))
    met = settled(spread_join(parts.drop("seen"), head, "key", "c"))
    firsts = met.filter(~few & (F.col("h") != F.col("o"))).select("h", "o").union(_masked_pairs(text, met.filter(few), similarity))
    links = settled(_alike(text, settled(firsts.distinct()), similarity))
    # Lines with more differences: all lines of a bucket meet that are not in one template by now.
    comp = connected_components(links, "h", "o")
    long = met.filter(~few).select("key", "h").join(comp, F.col("h") == F.col("node"), "left").select("key", "h", F.coalesce("root", "h").alias("comp"))
    long = settled(long)
    mixed = long.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("c")).filter("a <> b").drop("a", "b")
    if mixed.limit(1).count():
        links = links.union(_alike(text, settled(_block_pairs(long.join(mixed, "key")).distinct()), similarity))
        comp = connected_components(links, "h", "o")
    return comp.select(F.col("node").alias("h"), F.col("root").alias("template"))


def _segments(text: DataFrame, similarity: float) -> DataFrame:
    """``n, h, seen, key`` of the d + 1 segments of each line: of lines that differ in d tokens or fewer, one segment is equal."""
    d = _differences(F.col("n"), similarity)
    # Segment k of d + 1 holds the tokens from n*k/(d+1) on, up to the next.
    cut = lambda k: F.floor(F.col("n") * k / (d + 1)).cast("int")
    tokens = F.array(F.split("masked", " "))
    part = lambda t, k: F.xxhash64("leaf", k, F.slice(t, cut(k) + 1, cut(k + 1) - cut(k)))
    keys = F.flatten(F.transform(tokens, lambda t: F.transform(F.sequence(F.lit(0), d), lambda k: part(t, k))))
    return text.select("n", "h", "seen", F.explode(keys).alias("key"))


def _prefixes(text: DataFrame, depth: int, similarity: float) -> DataFrame:
    """``n, h, seen, key`` of the d + 1 rarest placed tokens of each line: lines of a leaf that differ in d tokens or fewer share one of them.

    That holds in any one order of the leaf's placed tokens. Rarest come
    first, so buckets are small; the leading tokens, which all lines of the
    leaf share, come last and are hardly ever reached.
    """
    items = text.select("leaf", "n", "h", "seen", F.posexplode(F.split("masked", " ")).alias("i", "token")).filter(F.col("i") >= depth)
    items = items.select("leaf", "n", "h", "seen", F.xxhash64("leaf", "i", "token").alias("item"))
    counts = settled(items.groupBy("item").agg(F.count("*").alias("c")).filter("c > 1"))
    placed = spread_join(items, counts.withColumn("freq", F.col("c")), "item", "c", "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("freq", F.lit(1)).alias("freq"), "item")))
    lines = placed.groupBy("leaf", "n", "h", "seen").agg(order.alias("order"))
    leading = F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda k: F.xxhash64("leaf", k))
    return lines.select("n", "h", "seen", F.explode(F.slice(F.concat(F.col("order.item"), leading), F.lit(1), _differences(F.col("n"), similarity) + 1)).alias("key"))


def _masked_pairs(text: DataFrame, met: DataFrame, similarity: float) -> DataFrame:
    """``h, o`` for lines with one or two allowed differences d: lines that are equal with some d tokens left out meet, each with the least of them."""
    own = text.join(met.select(F.col("h").alias(f"{P}h")).distinct(), F.col("h") == F.col(f"{P}h"), "left_semi")
    own = own.select("leaf", "h", _differences(F.col("n"), similarity).alias("d"), F.transform(F.split("masked", " "), lambda t, i: F.xxhash64(i, t)).alias("th"))
    own = own.withColumn("all", F.aggregate("th", F.lit(0).cast("bigint"), lambda s, v: s.bitwiseXOR(v)))
    one = F.transform("th", lambda x, i: F.xxhash64("leaf", i, F.col("all").bitwiseXOR(x)))
    rest = lambda x, i: F.transform(F.slice("th", i + 2, F.size("th")), lambda y, k: F.xxhash64("leaf", i, k, F.col("all").bitwiseXOR(x).bitwiseXOR(y)))
    keys = own.select("h", F.explode(F.when(F.col("d") == 1, one).otherwise(F.flatten(F.transform("th", rest)))).alias("key"))
    least = settled(keys.groupBy("key").agg(F.min("h").alias("o"), F.count("*").alias("c")).filter("c > 1"))
    total = least.agg(F.sum("c")).first()[0] or 0
    # Hot keys, fewer than SHARE, are met where they are, and their rows spread over all tasks, not sent to one.
    hot = least.filter(F.col("c") * F.lit(SHARE) > F.lit(total)).select("key", F.col("o").alias("known"))
    rows = keys.join(F.broadcast(hot), "key", "left").select("h", "known", F.when(F.col("known").isNull(), F.col("key")).otherwise(F.xxhash64("key", "h")).alias("key"))
    return rows.join(least.drop("c"), "key", "left").select("h", F.coalesce("known", "o").alias("o")).filter("h <> o")


def _block_pairs(met: DataFrame) -> DataFrame:
    """``h, o``: all pairs of lines of one bucket (key, h, comp; c lines) but those of one component; a hot bucket is dealt into blocks, two to a cell."""
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    e = met.withColumn("own", F.pmod(F.xxhash64("h"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    e = e.select("key", "h", "comp", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    x, y = e.filter("own = lo").alias("x"), e.filter("own = hi").alias("y")
    on = (F.col("x.comp") != F.col("y.comp")) & ((F.col("x.lo") < F.col("x.hi")) | (F.col("x.h") < F.col("y.h")))
    for c in ("key", "lo", "hi"):
        on &= F.col(f"x.{c}") == F.col(f"y.{c}")
    return x.join(y, on).select(F.least("x.h", "y.h").alias("h"), F.greatest("x.h", "y.h").alias("o"))


def _alike(text: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``h, o`` (settled) of lines that agree in enough positions; an ``o`` of many pairs is copied, so that no task gets all of them."""
    x = text.select("h", F.col("masked").alias("x"))
    y = text.select(F.col("h").alias("o"), F.col("masked").alias("y"))
    total = pairs.count()
    hot = pairs.groupBy("o").agg(F.count("*").alias("c")).filter(F.col("c") * F.lit(SHARE) > F.lit(total))
    # Fewer than SHARE rows; all copies together are fewer than twice as many.
    hot = F.broadcast(settled(hot.select("o", F.ceil(F.col("c") * F.lit(SHARE) / F.lit(max(total, 1))).cast("int").alias("copies"))))
    copies = F.coalesce("copies", F.lit(1))
    met = pairs.join(x, "h").join(hot, "o", "left").withColumn("copy", F.pmod(F.xxhash64("h"), copies).cast("int")).drop("copies")
    y = y.join(hot, "o", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    same = F.aggregate(F.zip_with(F.split("x", " "), F.split("y", " "), lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, v: s + v)
    return met.join(y, ["o", "copy"]).filter(same >= similarity * F.size(F.split("x", " ")) - 1e-9).select("h", "o")


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``<id_col>, drop`` (positions from 0, ascending) of the lines that go, for each document that has any."""
    lines = settled(_lines(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, depth).drop("masked"))
    merged = _templates(docs, lines, id_col, text_col, depth, similarity)
    lines = lines.select("id", "pos", "h")
    # One row for each different line, with the template it stands for.
    each = lines.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("c"))
    each = settled(each.join(merged.withColumnRenamed("h", f"{P}h"), F.col("h") == F.col(f"{P}h"), "left").select("h", F.coalesce("template", "h").alias("t"), "lo", "hi", "c"))
    if min_docs <= 2:
        recurring = each.groupBy("t").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).filter("first <> last")
    else:
        holders = spread_join(lines.select("h", "id").distinct(), each.select("h", "t", "c"), "h", "c").select("t", "id").distinct()
        recurring = holders.groupBy("t").agg(F.min("id").alias("first"), F.count("*").alias("k")).filter(F.col("k") >= min_docs)
    recurring = settled(each.join(recurring.select("t", "first"), "t").select("h", "first", "c"))
    gone = spread_join(lines, recurring, "h", "c").filter(F.col("id") != F.col("first")).select("id", "pos")
    return gone.groupBy(F.col("id").alias(id_col)).agg(F.sort_array(F.collect_set("pos")).alias("drop"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS
) -> DataFrame:
    """docs with the recurring lines taken out of ``text_col``, and ``n_lines, n_dropped``.

    A template that stands in ``min_docs`` documents or more stays in the
    document with the smallest id, all its lines there included, and goes from
    the others. Blank lines and line breaks between kept lines stay as they
    are. No row is dropped: a document whose lines all recur keeps its row with
    what is left, possibly empty. Null text stays null with 0 lines; rows
    without an id are left untouched; rows that share an id count as one
    document. Columns of docs named n_lines or n_dropped are replaced.
    """
    gone = repeated_lines(docs, id_col, text_col, depth, similarity, min_docs).withColumnsRenamed({id_col: f"{P}id", "drop": f"{P}drop"})
    out = docs.join(gone, F.col(id_col) == F.col(f"{P}id"), "left")
    lines = F.split(F.col(text_col), "\n")
    kept = F.flatten(
        F.transform(F.array(lines), lambda ls: F.filter(F.transform(ls, lambda s, i: F.when(~F.array_contains(F.col(f"{P}drop"), i), s)), lambda s: s.isNotNull()))
    )
    return out.withColumns(
        {
            text_col: F.when(F.col(f"{P}drop").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")),
            "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)),
            "n_dropped": F.when(F.col(f"{P}drop").isNull(), 0).otherwise(F.size(f"{P}drop")),
        }
    ).drop(f"{P}id", f"{P}drop")
