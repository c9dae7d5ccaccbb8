"""Language identification by a byte convolutional network.

Filters of several widths run over the UTF-8 bytes of fixed-length windows,
each filter is max-pooled over its window, and a softmax layer reads the
pooled values. A filter's response is a sum of one table row for each byte
under it, so the network is a handful of table lookups. It is trained in numpy
on a bounded sample of labelled windows and applied to all windows of a text;
the text's distribution is the mean over its windows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, id_bucket

WINDOW, WIDTHS, FILTERS = 64, (2, 3, 4), 8
#: At most so many documents of each language, and so many evenly spaced windows of each, are learned from.
TRAIN_DOCS_PER_LANG, TRAIN_WINDOWS_PER_DOC = 1_500, 6
EPOCHS, BATCH, RATE, SEED = 12, 256, 0.01, 11
#: Windows computed at a time.
BLOCK = 1_024
LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes that are no letter count as blanks.
_FOLD = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def prepared(text: str) -> bytes:
    """Lower-cased letters, words apart by single blanks."""
    return b" ".join(text.lower().encode().translate(_FOLD).split())


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, padded with blanks, and where each text's windows start; every text has one at least."""
    n = [max(1, -(-len(t) // WINDOW)) for t in texts]
    joined = b"".join(t.ljust(k * WINDOW, b" ") for t, k in zip(texts, n, strict=True))
    starts = np.zeros(len(texts), np.int64)
    np.cumsum(n[:-1], out=starts[1:])
    return np.frombuffer(joined, np.uint8).reshape(-1, WINDOW), starts


class Network:
    def __init__(self, classes: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.tables = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)
        self.pairs: list[tuple[np.ndarray, np.ndarray | None]] | None = None

    def prepare(self) -> Network:
        """Tables over pairs of bytes, which halve the lookups."""
        self.pairs = []
        for t in self.tables:
            first = (t[0][:, None, :] + t[1][None, :, :]).reshape(65536, FILTERS)
            rest = None if len(t) == 2 else t[2] if len(t) == 3 else (t[2][:, None, :] + t[3][None, :, :]).reshape(65536, FILTERS)
            self.pairs.append((np.ascontiguousarray(first), rest))
        return self

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Max-pooled filter responses of windows (n, WINDOW), for prediction."""
        wide = x.astype(np.int32)
        pair = (wide[:, :-1] << 8) | wide[:, 1:]
        parts = []
        for (first, rest), w, b in zip(self.pairs, WIDTHS, self.bias, strict=True):
            n = WINDOW - w + 1
            r = first.take(pair[:, :n], axis=0)
            if w == 3:
                r += rest.take(wide[:, 2 : 2 + n], axis=0)
            elif w == 4:
                r += rest.take(pair[:, 2 : 2 + n], axis=0)
            parts.append(np.maximum(r.max(1) + b, 0))
        return np.concatenate(parts, 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of windows (n, WINDOW)."""
        out = np.empty((len(x), len(self.classes)), np.float32)
        for i in range(0, len(x), BLOCK):
            z = self.pooled(x[i : i + BLOCK]) @ self.out + self.out_bias
            e = np.exp(z - z.max(1, keepdims=True))
            out[i : i + BLOCK] = e / e.sum(1, keepdims=True)
        return out

    def _step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weighted cross-entropy of one batch."""
        n = len(x)
        rows = np.arange(n)[:, None]
        where, pooled = [], []
        for t, w, b in zip(self.tables, WIDTHS, self.bias, strict=True):
            m = WINDOW - w + 1
            r = sum(t[j][x[:, j : j + m]] for j in range(w))
            p = r.argmax(1)
            where.append(p)
            pooled.append(r[rows, p, np.arange(FILTERS)[None, :]] + b)
        raw = np.concatenate(pooled, 1)
        h = np.maximum(raw, 0)
        z = h @ self.out + self.out_bias
        e = np.exp(z - z.max(1, keepdims=True))
        g = e / e.sum(1, keepdims=True)
        g[np.arange(n), y] -= 1
        g *= (weight / weight.sum())[:, None]
        grad_out, grad_bias = h.T @ g, g.sum(0)
        gh = (g @ self.out.T) * (raw > 0)
        grads, gb = [], np.zeros_like(self.bias)
        for k, (t, w) in enumerate(zip(self.tables, WIDTHS, strict=True)):
            own = gh[:, k * FILTERS : (k + 1) * FILTERS]
            gb[k] = own.sum(0)
            gt = np.zeros_like(t)
            for j in range(w):
                np.add.at(gt[j], (x[rows, where[k] + j], np.arange(FILTERS)[None, :]), own)
            grads.append(gt)
        return [*grads, gb, grad_out, grad_bias]

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        weight = 1.0 / np.maximum(np.bincount(y, minlength=len(self.classes)), 1)[y]
        params = [*self.tables, self.bias, self.out, self.out_bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            rate = RATE * (1 - epoch / EPOCHS)
            for i in range(0, len(order), BATCH):
                own = order[i : i + BATCH]
                t += 1
                for p, g, a, b in zip(params, self._step(x[own], y[own], weight[own]), m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return self


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """The network of the labelled documents outside the held-out fold (crc32 of the id modulo 5 is not 0); None if there are none."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang")).filter("t is not null and lang is not null")
    own = own.filter(F.col("id").isNotNull() & (id_bucket("id", 5) != 0))
    counts = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    if not counts:
        return None
    luck = F.pmod(F.xxhash64(F.lit(23), "id"), F.lit(1 << 24))
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 24, int((1 << 24) * TRAIN_DOCS_PER_LANG / n)))))
    own = own.filter(luck < share[F.col("lang")])

    def pick(batches):
        for b in batches:
            langs, out = [], []
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not LETTER.search(text):
                    continue
                w, _ = windows_of([prepared(text)])
                for i in np.unique(np.linspace(0, len(w) - 1, TRAIN_WINDOWS_PER_DOC).astype(int)):
                    out.append(w[i].tobytes())
                    langs.append(lang)
            yield pa.record_batch([pa.array(out, pa.binary()), pa.array(langs, pa.string())], ["w", "lang"])

    rows = sorted((r["lang"], bytes(r["w"])) for r in own.select("t", "lang").mapInArrow(pick, "w binary, lang string").collect())
    if not rows:
        return None
    classes = sorted({lang for lang, _ in rows})
    x = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, WINDOW)
    y = np.array([classes.index(lang) for lang, _ in rows])
    return Network(classes).fit(x, y)


def identify(docs: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """docs with ``lang_pred, score``: und and 0.0 where text is null or has no letter, or nothing was learned.

    Columns of docs with these names are replaced. Every row is judged by its whole text alone; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def judge(text: pa.Array) -> pa.Array:
        net = shared.value
        texts = text.to_pylist()
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        own = [i for i, t in enumerate(texts) if net is not None and t and LETTER.search(t)]
        if own:
            if net.pairs is None:
                net.prepare()
            # In groups of texts, so that one long text doesn't make all others wait in memory.
            group, size = [], 0
            for i in [*own, None]:
                if i is None or size > 4_000_000:
                    x, starts = windows_of([g for _, g in group])
                    p = net.predict(x)
                    mean = np.add.reduceat(p.astype(np.float64), starts, axis=0)
                    mean /= mean.sum(1, keepdims=True)
                    for (j, _), m in zip(group, mean, strict=True):
                        k = int(m.argmax())
                        lang[j], score[j] = net.classes[k], float(m[k])
                    group, size = [], 0
                if i is not None:
                    group.append((i, prepared(texts[i])))
                    size += len(group[-1][1])
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["l", "s"])

    out = docs.withColumn(f"{P}l", F.arrow_udf(judge, "struct<l:string,s:double>")(F.col(text_col)))
    return out.withColumns({"lang_pred": F.col(f"{P}l.l"), "score": F.round(F.col(f"{P}l.s"), 6)}).drop(f"{P}l")
