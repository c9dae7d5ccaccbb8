"""Toxicity by a lexicon trie met with Levenshtein automata, and by context.

The lexicon is learned from labelled documents: words, and beginnings of
words, that stand in toxic documents and hardly ever in clean ones. It is
kept as a trie. For each distinct word of a text that could be a misspelling
(half of a term is intact in it) a Levenshtein automaton of the word is run
against the trie, so that only branches within reach are walked. Each hit
counts by what its term, or its misspelled form, was worth in training, and by
its window: inside quotation marks or behind a word of reporting it counts as
a quotation, among other hits it counts as abuse.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, bounded_rows, id_bucket, settled

#: At most so many labelled documents are learned from (chosen by a hash of their ids), and so many terms kept.
TRAIN_DOCS, MAX_TERMS = 40_000, 4_000
#: A term must stand in so many toxic documents, of so many kinds, in this share of kinds, and mostly in toxic ones.
MIN_DOCS, MIN_KINDS, VARIETY, MIN_PRECISION = 5, 4, 0.45, 0.7
PREFIX = range(4, 8)
WINDOW = 6
WORD = re.compile(r"[^\W_]+")
QUOTES = re.compile("[\"“”„«»‹›]")
#: Words of reporting in the languages of the corpus (fixed values).
REPORTING = frozenset("said says wrote writes called quote quoted quotes word term sagte sagt schrieb nannte zitat wort dit disait appelé cite mot dijo dice escribió llamó cita palabra".split())
QUOTED_WEIGHT, NEIGHBOUR_BONUS = 0.15, 0.25
#: Misspelled forms worth less are no hits.
LEAST = 0.1
REMEMBER = 150_000
THRESHOLD = 0.3


def allowed_edits(size: int) -> int:
    """Misspellings allowed for a term of this many letters."""
    return 0 if size < 5 else 1 if size < 9 else 2


class LevenshteinAutomaton:
    """States are the reachable band of edit distances to a word; transitions are remembered."""

    def __init__(self, word: str, edits: int):
        self.word, self.edits = word, edits
        self.start = tuple(min(i, edits + 1) for i in range(len(word) + 1))
        self.seen: dict[tuple, tuple | None] = {}

    def step(self, state: tuple, letter: str) -> tuple | None:
        """The state after one more letter, or None where no end is in reach."""
        key = (state, letter if letter in self.word else None)
        if key in self.seen:
            return self.seen[key]
        most = self.edits + 1
        row = [min(state[0] + 1, most)]
        for i, c in enumerate(self.word):
            row.append(min(row[i] + 1, state[i] + (c != letter), state[i + 1] + 1, most))
        out = tuple(row) if min(row) <= self.edits else None
        self.seen[key] = out
        return out

    def distance(self, state: tuple) -> int | None:
        return state[-1] if state[-1] <= self.edits else None


class Lexicon:
    """Terms in a trie. Whole terms may be misspelled; a stem stands for every word that begins with it."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = dict(words), dict(stems)
        self.trie: dict = {}
        for term in self.words:
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
        # k edits leave one of k + 1 parts of the term as it is: the first at the word's start, the last at its end, or one between.
        self.heads: dict[str, tuple[int, int]] = {}
        self.tails: dict[str, tuple[int, int]] = {}
        self.middles: list[tuple[str, int, int]] = []
        #: By the length of a word, the most edits allowed for a term in reach of it.
        self.most_edits: dict[int, int] = {}
        for term in self.words:
            k = allowed_edits(len(term))
            if not k:
                continue
            for n in range(len(term) - k, len(term) + k + 1):
                self.most_edits[n] = max(self.most_edits.get(n, 0), k)
            cuts = [len(term) * i // (k + 1) for i in range(k + 2)]
            parts = [term[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            lo, hi = len(term) - k, len(term) + k
            for part, own in ((parts[0], self.heads), (parts[-1], self.tails)):
                x = own.get(part, (lo, hi))
                own[part] = min(lo, x[0]), max(hi, x[1])
            self.middles += [(m, lo, hi) for m in parts[1:-1]]
        self.head_sizes, self.tail_sizes = sorted({len(x) for x in self.heads}), sorted({len(x) for x in self.tails})
        self.stem_sizes = sorted({len(s) for s in self.stems})

    def _near(self, word: str) -> bool:
        """Whether a part of a term is intact in the word, where it would have to be."""
        n = len(word)
        for k in self.head_sizes:
            if (x := self.heads.get(word[:k])) and x[0] <= n <= x[1]:
                return True
        for k in self.tail_sizes:
            if (x := self.tails.get(word[-k:])) and x[0] <= n <= x[1]:
                return True
        return any(lo <= n <= hi and m in word for m, lo, hi in self.middles)

    def misspelled(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowed edits, by walking trie and automaton together."""
        if len(word) not in self.most_edits or not self._near(word):
            return None
        automaton = LevenshteinAutomaton(word, self.most_edits[len(word)])
        best: tuple[int, str] | None = None
        stack = [(self.trie, automaton.start)]
        while stack:
            node, state = stack.pop()
            for c, below in node.items():
                if c == "":
                    d = automaton.distance(state)
                    if d is not None and d <= allowed_edits(len(below)) and (best is None or (d, below) < best):
                        best = d, below
                elif (after := automaton.step(state, c)) is not None:
                    stack.append((below, after))
        return (best[1], best[0]) if best else None

    def stem_of(self, word: str) -> str | None:
        for n in self.stem_sizes:
            if word[:n] in self.stems:
                return word[:n]
        return None


class Model:
    def __init__(self, words: dict, stems: dict, surfaces: dict, fuzzy: dict, base: float):
        """surfaces: probability by misspelled form seen in training; fuzzy: by term, for other forms; base: without hits."""
        self.lexicon = Lexicon(words, stems)
        self.surfaces, self.fuzzy, self.base = surfaces, fuzzy, base
        self.clean: set[str] = set()  # words looked up without a hit
        self.hit: dict[str, tuple[str, float]] = {}
        self.hit_words: set[str] = set()

    def hits_of(self, words: set[str]) -> set[str]:
        """Those of the words that are hits."""
        if len(self.hit) > REMEMBER:
            self.hit.clear()
            self.hit_words.clear()
        found = words & self.hit_words
        for w in words.difference(self.clean, found):
            if (x := self.lookup(w)) is None:
                self.clean.add(w)
            else:
                self.hit[w] = x
                self.hit_words.add(w)
                found.add(w)
        if len(self.clean) > REMEMBER:
            self.clean.clear()
        return found

    def lookup(self, word: str):
        lex = self.lexicon
        if word in lex.words:
            return word, lex.words[word]
        if lex.stems and (s := lex.stem_of(word)):
            return s, lex.stems[s]
        if (near := lex.misspelled(word)) is None:
            return None
        p = self.surfaces.get(word, self.fuzzy.get(near[0], 0.4 / near[1]))
        return (near[0], p) if p >= LEAST else None

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, str, bool]]]:
        """Probability of the toxic label, and the hits as (start, end, term, quoted)."""
        if not text:
            return self.base, []
        low = text.lower()
        words = WORD.findall(low)
        found = self.hits_of(set(words))
        if not found:
            return self.base, []
        spans = [m for m in WORD.finditer(low) if m[0] in found]
        order = {}
        for i, w in enumerate(words):
            if w in found:
                order.setdefault(w, []).append(i)
        places = sorted(i for x in order.values() for i in x)
        marks = [m.start() for m in QUOTES.finditer(low)]
        hits, clean = [], 1 - self.base
        near = set(places)
        for m, i in zip(spans, places, strict=True):
            term, p = self.hit[m[0]]
            window = words[max(0, i - WINDOW) : i]
            left = bisect.bisect_left(marks, m.start())
            quoted = bool(left % 2 and left < len(marks)) or any(w in REPORTING for w in window)
            crowd = any(j in near for j in range(max(0, i - WINDOW), i + WINDOW + 1) if j != i)
            if quoted:
                p *= QUOTED_WEIGHT
            elif crowd:
                p += p * (1 - p) * NEIGHBOUR_BONUS
            clean *= 1 - min(p, 0.999)
            hits.append((m.start(), m.end(), term, quoted))
        return min(1.0, max(0.0, 1 - clean)), hits


def _term_counts(rows: DataFrame) -> DataFrame:
    """term, kind, pos, neg over the documents (text, label) of rows; each word counts once a document."""

    def count(batches):
        pos, neg = Counter(), Counter()

        def out():
            terms = [t for t in pos.keys() | neg.keys()]
            yield pa.record_batch([pa.array(terms, pa.string()), pa.array([pos[t] for t in terms], pa.int64()), pa.array([neg[t] for t in terms], pa.int64())], ["term", "pos", "neg"])
            pos.clear(), neg.clear()

        for b in batches:
            for text, label in zip(map(lambda t: t.as_py(), b.column(0)), b.column(1).to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                terms = words | {w[:n] + "*" for w in words for n in PREFIX if len(w) > n}
                (pos if label else neg).update(terms)
            if len(pos) + len(neg) > 120_000:
                yield from out()
        if pos or neg:
            yield from out()

    parts = rows.select("t", "y").mapInArrow(count, "term string, pos bigint, neg bigint")
    return parts.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns the lexicon and its weights from the labelled documents outside the held-out fold.

    Rows whose crc32 of the id modulo 4 is 2, and null labels or ids, are left
    out; equal texts count once. No usable row gives a model without terms.
    """
    own = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).filter(id_bucket(id_col, 4) != 2)
    own = own.groupBy(F.col(id_col).alias(f"{P}id")).agg(F.max(label_col).alias("y"))
    own = bounded_rows(own, f"{P}id", TRAIN_DOCS)
    # At most about TRAIN_DOCS ids and labels: they are brought to the texts, which are not shuffled.
    text = F.col(text_col)
    rows = docs.join(F.broadcast(own), F.col(id_col) == F.col(f"{P}id")).filter(text.isNotNull()).select(F.col(f"{P}id"), text.alias("t"), F.col("y").cast("int").alias("y"))
    # One row for each text: copies of a toxic document would make all its words look toxic.
    first = rows.groupBy(F.xxhash64("t").alias("h")).agg(F.max(F.struct("y", F.col(f"{P}id"))).alias("k"))
    first = settled(first.select("k.*"))
    n_pos, n_all = first.agg(F.sum("y"), F.count("*")).first()
    n_pos = n_pos or 0
    base0 = (n_pos + 0.5) / (n_all + 1)
    if not n_pos:
        return Model({}, {}, {}, {}, min(base0, 0.05))
    rows = docs.join(F.broadcast(first), F.col(id_col) == F.col(f"{P}id")).filter(text.isNotNull()).select(text.alias("t"), "y")
    counts = settled(_term_counts(rows))
    # Among so many words some stand in toxic documents by chance: the likelihood ratio must outweigh their number.
    n_terms = counts.filter(F.col("pos") + F.col("neg") >= MIN_DOCS).count()
    p = F.col("pos") / (F.col("pos") + F.col("neg"))
    gain = F.col("pos") * F.log(p / base0) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - p) / (1 - base0))).otherwise(0.0)
    good = counts.filter((F.col("pos") >= MIN_DOCS) & (p >= MIN_PRECISION) & (gain >= math.log(n_terms + 1) + 2))
    top = good.orderBy(F.desc("pos"), F.length("term"), "term").limit(MAX_TERMS).collect()
    chosen = _varied(rows, [r["term"] for r in top])
    worth = {r["term"]: (r["pos"] + 0.5) / (r["pos"] + r["neg"] + 1) for r in top}
    words = {t: worth[t] for t in chosen if not t.endswith("*")}
    stems = {t[:-1]: worth[t] for t in chosen if t.endswith("*")}
    lexicon = Lexicon(words, stems)
    near = _near_forms(counts, lexicon)
    tally = {t: [0, 0] for t in words}
    for _, term, pos, neg in near:
        tally[term][0] += pos
        tally[term][1] += neg
    fuzzy = {t: (p * base0 + 1) / (p * base0 + n + 2) for t, (p, n) in tally.items()}
    # A form's first document counts for nothing: chance forms of clean text are rare one by one.
    surfaces = {form: (max(pos - 1, 0) + fuzzy[term]) / (max(pos, 1) + 2 * neg) for form, term, pos, neg in near}
    model = Model(words, stems, surfaces, fuzzy, 0.0)
    missed, without = _without_hits(rows, model)
    model.base = min(0.29, (missed + 0.5) / (without + 2))
    return model


def _signature(words: set[str]) -> int:
    """Near copies of a document mostly share it, other documents don't: the least hash of its long words."""
    import xxhash

    return min((xxhash.xxh64_intdigest(w) for w in words if len(w) >= 8), default=xxhash.xxh64_intdigest(" ".join(sorted(words))))


def _varied(rows: DataFrame, terms: list[str]) -> list[str]:
    """The terms that stand in toxic documents of many kinds; those of one copied document don't.

    A stem is kept if it unites many words, and no longer stem stands in nearly all of its documents.
    """
    if not terms:
        return []
    full = {t: i for i, t in enumerate(terms)}

    def mine(batches):
        for b in batches:
            out, sig = [], []
            for text in b.column(0).to_pylist():
                words = set(WORD.findall((text or "").lower()))
                out.append(sorted({full[x] for w in words for x in (w, *(w[:n] + "*" for n in PREFIX if len(w) > n)) if x in full}))
                sig.append(f"{_signature(words):x}")
            yield pa.record_batch([pa.array(out, pa.list_(pa.int32())), pa.array(sig, pa.string())], ["k", "sig"])

    # Bounded: one short list for each toxic document of the bounded sample.
    sets = rows.filter("y = 1").select("t").mapInArrow(mine, "k array<int>, sig string").collect()
    has: dict[str, set[int]] = {}
    kinds: dict[str, set[str]] = {}
    for d, r in enumerate(sets):
        for k in r["k"]:
            has.setdefault(terms[k], set()).add(d)
            kinds.setdefault(terms[k], set()).add(r["sig"])
    varied = {t for t in has if len(kinds[t]) >= max(MIN_KINDS, VARIETY * len(has[t]))}
    words = {t for t in varied if not t.endswith("*")}
    stems = {t for t in varied - words if len(has[t]) > 1.5 * max((len(has[w]) for w in has if not w.endswith("*") and w.startswith(t[:-1])), default=0)}
    stems = {t for t in stems if not any(o != t and o.startswith(t[:-1]) and len(has[o]) >= 0.95 * len(has[t]) for o in stems)}
    return sorted(words | stems)


def _near_forms(counts: DataFrame, lexicon: Lexicon) -> list[tuple[str, str, int, int]]:
    """(form, term, pos, neg) of the training words that are misspellings of a term (at most MAX_TERMS * 25, the most frequent)."""

    def look(batches):
        for b in batches:
            words = b.column(0).to_pylist()
            near = [lexicon.misspelled(w) if w not in lexicon.words and not lexicon.stem_of(w) else None for w in words]
            keep = [i for i, x in enumerate(near) if x]
            b = b.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([b.column(0), pa.array([near[i][0] for i in keep], pa.string()), b.column(1), b.column(2)], ["form", "term", "pos", "neg"])

    found = counts.filter(~F.col("term").endswith("*")).select("term", "pos", "neg").mapInArrow(look, "form string, term string, pos bigint, neg bigint")
    return [tuple(r) for r in found.orderBy(F.desc(F.col("pos") + F.col("neg")), "form").limit(MAX_TERMS * 25).collect()]


def _without_hits(rows: DataFrame, model: Model) -> tuple[int, int]:
    def look(batches):
        for b in batches:
            hits = [bool(model.score(t)[1]) for t in b.column(0).to_pylist()]
            yield pa.record_batch([b.column(1), pa.array(hits, pa.bool_())], ["y", "hit"])

    r = rows.select("t", "y").mapInArrow(look, "y int, hit boolean").filter("not hit").agg(F.sum("y"), F.count("*")).first()
    return r[0] or 0, r[1]


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with ``score, predicted, n_hits, n_quoted, hits`` (distinct terms); null and empty text score the base rate.

    Columns of docs with these names are replaced. Every row is scored by its text alone; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<s:double,n:int,q:int,h:string>")
    def score(text: pa.Array) -> pa.Array:
        m = shared.value
        rows = [m.score(t.as_py()) for t in text]
        return pa.StructArray.from_arrays(
            [
                pa.array([s for s, _ in rows], pa.float64()),
                pa.array([len(h) for _, h in rows], pa.int32()),
                pa.array([sum(x[3] for x in h) for _, h in rows], pa.int32()),
                pa.array([",".join(sorted({x[2] for x in h})) for _, h in rows], pa.string()),
            ],
            ["s", "n", "q", "h"],
        )

    s = F.col(f"{P}s")
    out = docs.withColumn(f"{P}s", score(F.col(text_col)))
    out = out.withColumns({"score": F.round(s["s"], 6), "n_hits": s["n"], "n_quoted": s["q"], "hits": s["h"]})
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop(f"{P}s")




def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows scored as toxic; their columns stay as they are."""
    scored = score_documents(docs.withColumn(f"{P}row", F.struct(*docs.columns)).select(f"{P}row", F.col(text_col).alias(f"{P}text")), model, text_col=f"{P}text", threshold=threshold)
    return scored.filter("predicted = 0").select(f"{P}row.*")
