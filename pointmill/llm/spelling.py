"""Spelling variants by bands of letter parities.

A word's mask has one bit for each class of letters: whether it occurs an odd
number of times. One edit flips two bits at most, so of three bands of the mask
one is the same for any two words an edit apart, and words are compared where
they agree in a band and their lengths differ by one or less. Common band values
are no large groups: an edit leaves one half of the word alone, so words must
agree in a band and in their first or last half too, which loses no pair.
Everything runs on Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, settled

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A form is RATIO times as frequent as its variant; words have LETTERS code points and SEEN occurrences at least.
RATIO, LETTERS, SEEN = 10, 7, 2
BANDS, BAND_BITS = 3, 21


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LETTERS) -> DataFrame:
    """``id, run``: every maximal run of ``least`` or more letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased; null and empty texts have none."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))
    runs = docs.select(F.col(id_col).alias("id"), F.explode(found).alias("run"))
    # lower() of ASCII alone is that of A-Z; other runs are translated letter by letter.
    low = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    return runs.select("id", low.alias("run"))


def one_letter_less(at: Column, run: Column) -> Column:
    """run without the code point at that place, from 0."""
    place = at.cast("int")
    return F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))


def word_counts(words: DataFrame, word_col: str = "word", least: int = LETTERS, seen: int = SEEN) -> DataFrame:
    """``word, n`` of the words of ``least`` code points and ``seen`` occurrences or more."""
    return words.filter(F.length(word_col) >= least).groupBy(F.col(word_col).alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= seen)


def parity_bands(word: Column) -> list[Column]:
    """The bands of a word's mask: letters by their code point's remainder, then by its quotient."""
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c))
    one = F.lit(1).cast("bigint")

    def band(k: int) -> Column:
        mine = F.filter(codes, lambda c: c % BANDS == k)
        return F.aggregate(mine, F.lit(0).cast("bigint"), lambda acc, c: acc.bitwiseXOR(F.call_function("shiftleft", one, (F.floor(c / BANDS) % BAND_BITS).cast("int"))))

    return [band(k) for k in range(BANDS)]


def near_words(words: DataFrame) -> DataFrame:
    """All pairs ``x, y`` (x before y) of ``word, n`` that differ by one inserted, deleted or replaced code point, with ``nx, ny``; each once."""
    size = F.length("word")
    masked = settled(words.select("word", "n", size.alias("size"), F.array(*parity_bands(F.col("word"))).alias("mask")))
    # A word meets others of its own length or one more, and as the longer one those of one less: half of the shorter length is compared.
    short = F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("short")
    rows = masked.select("word", "n", "size", "mask", short).select("*", F.posexplode("mask").alias("band", "bits"))
    half = F.floor(F.col("short") / 2).cast("int")
    first, last = F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), F.col("size") - half + 1, half)
    rows = rows.select("word", "n", "size", "mask", "short", "band", "bits", F.explode(F.array(F.struct(F.lit(0).alias("side"), first.alias("part")), F.struct(F.lit(1).alias("side"), last.alias("part")))).alias("h"))
    rows = rows.select("word", "n", "size", "mask", "short", "band", "bits", "h.side", "h.part")
    x, y = rows.alias("x"), rows.alias("y")
    on = F.lit(True)
    for c in ("short", "band", "bits", "side", "part"):
        on &= F.col(f"x.{c}") == F.col(f"y.{c}")
    on &= (F.col("x.word") < F.col("y.word")) & (F.least("x.size", "y.size") == F.col("x.short"))
    # Of the bands and halves that agree, the first speaks for the pair.
    for k in range(BANDS - 1):
        on &= (F.col("x.band") <= k) | (F.col("x.mask")[k] != F.col("y.mask")[k])
    h = F.floor(F.col("x.short") / 2).cast("int")
    on &= (F.col("x.side") == 0) | (F.substring(F.col("x.word"), F.lit(1), h) != F.substring(F.col("y.word"), F.lit(1), h))
    on &= F.levenshtein(F.col("x.word"), F.col("y.word"), 1) == 1
    return x.join(y, on).select(F.col("x.word").alias("x"), F.col("x.n").alias("nx"), F.col("y.word").alias("y"), F.col("y.n").alias("ny"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word with a form: forms followed to the last, twice as far each round."""
    at = settled(forms.select("word", F.col("form").alias("root")))
    while True:
        nxt = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = settled(at.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return at


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the different words in ``word, n``.

    n_near counts the words one edit away. A word's form is the most frequent of
    them (ties: the smallest in code-point order) if it is ``ratio`` times as
    frequent, else null; root is where following forms ends, the word itself if it
    has none. Null words and words without a count take no part, rows that share a
    word are one with all their occurrences; no words give no rows.
    """
    words = settled(words.filter("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").cast("bigint").alias("n")))
    pairs = settled(near_words(words))
    both = pairs.select(F.col("x").alias("word"), F.col("y").alias("other"), F.col("ny").alias("m")).union(pairs.select("y", "x", "nx"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("b"))
    best = best.select("word", "n_near", F.col("b.other").alias(f"{P}form"), (-F.col("b.m")).alias(f"{P}m"))
    own = words.join(best, "word", "left")
    follows = F.col(f"{P}m") >= F.col("n") * ratio
    own = settled(own.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(follows, F.col(f"{P}form")).alias("form"), F.when(follows, F.col(f"{P}m")).alias("form_n")))
    out = own.join(_roots(own.filter("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
