"""Licence scan by a positional index of rare tokens.

Short canonical passages of common licences are indexed by word and position.
For each text, the licence words with the highest inverse document frequency
(counted over all documents) are looked up; the postings of a template are
intersected by relative position (places that agree on where the template
would begin), and a template counts only if its mandatory key phrase stands
there too. Long passages may have words put in or left out: where no one
beginning agrees, the longest chain of postings in order, over beginnings that
are up to a quarter of the passage apart, decides. Exact base phrases are found in every text besides.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels, as the contract has them (fixed values).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, mandatory key phrase, and passage (fixed values: wording of the public licences).
TEMPLATES = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "mit license", "licensed under the mit license"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("apache", "apache license", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "general public license", "it under the terms of the gnu general public license as published by the free software foundation either version"),
    ("lgpl", "lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "eclipse public license", "made available under the terms of the eclipse public license"),
    ("cc-by", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by", "cc by 4", "licensed under cc by 4 0"),
    ("cc0", "cc0 1 0 universal", "dedicated to the public domain under the cc0 1 0 universal"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved", "all rights reserved"),
]
#: Rarest licence words of a text that are looked up, and the share of a template's words that must agree.
RARE, SHARE = 16, 0.7
#: Passages of so many words or more may be matched by a chain, of so large a share of their words, within windows wider by a quarter.
CHAINED, CHAIN, DRIFT = 12, 0.8, 4

#: Every ASCII byte but digits and letters separates words; A-Z become a-z; other bytes stay.
FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


class Index:
    def __init__(self, frequency: dict[bytes, int] | None = None, n_docs: int = 0):
        """frequency: in how many of n_docs documents each licence word stands."""
        self.templates = [(label, key.encode().split(), text.encode().split()) for label, key, text in TEMPLATES]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, _, words) in enumerate(self.templates):
            for p, w in enumerate(words):
                self.postings.setdefault(w, []).append((k, p))
        self.masks = [word_masks(words) for _, _, words in self.templates]
        self.vocabulary = frozenset(self.postings)
        frequency = frequency or {}
        self.idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 0.5)) for w in self.vocabulary}
        # A template is sought by its rarest words.
        self.base = [(p.encode(), tuple(p.encode().split()), label) for p, label in BASE.items()]

    def base_places(self, words: list[bytes], here: set[bytes]) -> list[tuple[int, str]]:
        out = []
        for _, phrase, label in self.base:
            if here.issuperset(phrase):
                out += [(at, label) for at in _places(words, list(phrase))]
        return sorted(out)

    def match(self, words: list[bytes], here: set[bytes]) -> list[tuple[str, int, float]]:
        """(label, start, share) of the templates that stand in a text, best first for each label."""
        present = here & self.vocabulary
        if len(present) < 2:
            return []
        # Of each template, its rarest words in the text; the RARE rarest of the text at least.
        rare = sorted(present, key=lambda w: (-self.idf[w], w))
        sought = set(rare[:RARE])
        for k, (_, key, words_k) in enumerate(self.templates):
            if here.issuperset(key):
                sought.update(sorted((w for w in set(words_k) if w in present), key=lambda w: (-self.idf[w], w))[:3])
        at: set[tuple[int, int]] = set()
        for i, w in enumerate(words):
            if w in sought:
                for k, p in self.postings[w]:
                    at.add((k, i - p))
        best: dict[str, tuple[float, int]] = {}
        chains: dict[str, tuple[float, int]] = {}
        keys: dict[int, list[int]] = {}
        reached: dict[int, int] = {}
        # A start counts where the postings and a place of the key phrase agree; only then words are compared.
        for k, start in sorted(at):
            label, key, template = self.templates[k]
            drift = len(template) // DRIFT if len(template) >= CHAINED else 0
            if k not in keys:
                keys[k] = _places(words, key) if here.issuperset(key) else []
            first = bisect.bisect_left(keys[k], max(0, start - max(2, drift)))
            if first == len(keys[k]) or keys[k][first] > start + len(template) + max(2, drift) - len(key):
                continue
            lo = max(0, start)
            span = words[lo : start + len(template)]
            kept = best
            agree = sum(1 for a, b in zip(span, template[lo - start :], strict=False) if a == b) / len(template)
            if agree < SHARE:
                # A window serves all beginnings up to a drift behind its own.
                if not drift or start <= reached.get(k, start - 1):
                    continue
                reached[k] = start + drift
                agree = chain_length(self.masks[k], len(template), words[max(0, start - drift) : start + len(template) + 2 * drift]) / len(template)
                if agree < CHAIN:
                    continue
                kept = chains
            if label not in kept or (agree, -start) > (kept[label][0], -kept[label][1]):
                kept[label] = (agree, lo)
        # A chain tells a label that no one beginning has.
        return sorted((label, start, share) for label, (share, start) in {**chains, **best}.items())

    def scan(self, raw: bytes | None) -> dict:
        words = words_of(raw or b"")
        here = set(words)
        places = self.base_places(words, here)
        found = self.match(words, here)
        base = sorted({label for _, label in places})
        labels = sorted({*base, *(label for label, _, _ in found)})
        score = 1.0 if base else max((s for _, _, s in found), default=0.0)
        return {
            "n_words": len(words), "n_base": len(places), "first_word": places[0][0] if places else None, "last_word": places[-1][0] if places else None,
            "base_labels": ",".join(base), "labels": ",".join(labels), "score": float(score), "spans": [{"label": a, "start": b, "share": c} for a, b, c in found],
        }


def word_masks(words: list[bytes]) -> dict[bytes, int]:
    """For each word, a bit at each of its positions."""
    out: dict[bytes, int] = {}
    for p, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << p
    return out


def chain_length(masks: dict[bytes, int], m: int, span: list[bytes]) -> int:
    """How many of a passage's m words stand in span in the same order: the longest common subsequence, a row of it held in one number's bits."""
    full = (1 << m) - 1
    row = full
    for w in span:
        if w in masks:
            hit = row & masks[w]
            row = ((row + hit) | (row - hit)) & full
    return m - row.bit_count()


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where a phrase's words stand one after another."""
    out, at, n = [], -1, len(phrase)
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return out
        if words[at : at + n] == phrase:
            out.append(at)


def document_frequency(docs: DataFrame, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word stands, over all documents; as many numbers as the templates have words."""
    vocabulary = Index().vocabulary

    def count(batches):
        seen, n = Counter(), 0
        for b in batches:
            for raw in b.column(0).to_pylist():
                seen.update(vocabulary.intersection(words_of(raw or b"")))
                n += 1
        rows = [(w.decode(), c) for w, c in seen.items()] + [("", n)]
        yield pa.record_batch([pa.array([w for w, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], ["w", "c"])

    parts = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(count, "w string, c bigint")
    total = {r[0]: r[1] for r in parts.groupBy("w").agg(F.sum("c")).collect()}
    n = total.pop("", 0)
    return {w.encode(): c for w, c in total.items()}, n


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``<id_col>, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    Null text counts as empty: no words, no labels, score 0. score is 1 where a
    base phrase stands, else the share of the best template that agrees. spans
    are the template matches (label, first word, share); of a match with words put
    in or left out, the first word is the one its first posting points to.
    Repeated rows and rows without an id get their own result; very long texts
    are read whole; other columns are left out.
    """
    frequency, n = document_frequency(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Index(frequency, n))
    kind = pa.struct(
        [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
         ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64())])))]
    )

    def scan(text: pa.Array) -> pa.Array:
        index = shared.value
        return pa.array([index.scan(t) for t in text.to_pylist()], kind)

    ddl = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,spans:array<struct<label:string,start:bigint,share:double>>>"
    out = docs.select(F.col(id_col), F.arrow_udf(scan, ddl)(F.col(text_col).cast("binary")).alias("__pm_s"))
    return out.select(id_col, *(F.col(f"__pm_s.{c}").alias(c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")))
