"""Exact SentencePiece (BPE) encoding by backtracking, and decoding.

An Aho-Corasick automaton over the pieces lists, for every position of a
segment, the pieces that start there. The encoder walks left to right with the
longest piece, keeps it only if it is compatible with the piece before (the
merge procedure, run on the two of them, gives just these two back), takes a
shorter one or steps back otherwise, and marks positions from which no
encoding ends well in a bitfield, so that none is tried twice. The result is
the sequence that merging by score gives, in time linear in the text for
natural input.

Pieces never hold a word mark behind another character, so a text falls into
segments (marks, then a word) that are encoded apart and remembered.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
#: Segments up to this length are remembered, so many of them; then, and when a task is over, only the first KEEP stay, the commonest for the most part.
REMEMBER_CHARS, REMEMBER, KEEP = 48, 150_000, 50_000
#: Two pieces are remembered as one number, the first times this.
PAIR = 1 << 22


def load_pieces(path: str) -> dict:
    """Pieces, scores and kinds of a SentencePiece model file (bounded by its vocabulary)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    return {
        "pieces": [sp.id_to_piece(i) for i in ids],
        "scores": [sp.get_score(i) for i in ids],
        "bytes": [sp.is_byte(i) for i in ids],
        "other": [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in ids],
        "unk": sp.unk_id(),
    }


def _trim(memory: dict) -> None:
    """Leaves the first KEEP entries."""
    if len(memory) > KEEP:
        first = list(itertools.islice(memory.items(), KEEP))
        memory.clear()
        memory.update(first)


class _Segments(dict):
    """Segment to its ids (as text), and the text that they decode to where that is another; computed where missing."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, segment: str) -> str | tuple[str, str]:
        ids = self.codec.encode_segment(segment)
        joined, back = ",".join(map(str, ids)), self.codec.surface(ids)
        out = joined if back == segment.replace(MARK, " ") else (joined, back)
        if len(segment) <= REMEMBER_CHARS:
            if len(self) >= REMEMBER:
                _trim(self)
            self[segment] = out
        return out


class Codec:
    """Encoder and decoder of one vocabulary (dummy prefix, no other normalisation)."""

    def __init__(self, vocabulary: dict):
        import ahocorasick

        self.pieces = vocabulary["pieces"]
        self.unk = vocabulary["unk"]
        plain = [i for i in range(len(self.pieces)) if not vocabulary["bytes"][i] and not vocabulary["other"][i]]
        self.score = {self.pieces[i]: vocabulary["scores"][i] for i in plain}
        self.id = {self.pieces[i]: i for i in plain}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if vocabulary["bytes"][i]}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.silent = {i for i in range(len(self.pieces)) if vocabulary["other"][i] and i != self.unk}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces that span words are not supported")
        # A piece that merging never forms can't be part of an encoding.
        kept = {p: i for p, i in self.id.items() if len(p) == 1 or self._merge(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        self.size = {i: len(p) for p, i in kept.items()}
        self.shorter: dict[int, int] = {}  # the next shorter piece with the same start
        for p, i in kept.items():
            self.automaton.add_word(p, (i, len(p) - 1))
            if len(p) > 1:
                self.shorter[i] = next((kept[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in kept), -1 - ord(p[0]))
        self.automaton.make_automaton()
        self.alone = "" if any("\n" in p for p in self.id) else "\n"
        self.cut = re.compile(f"{MARK}*[^{MARK}{self.alone}]+|{MARK}+" + ("|\n" if self.alone else ""))
        self.pair: dict[int, bool] = {}
        self.segments = _Segments(self)

    def _merge(self, text: str) -> list[str]:
        """The merge procedure itself, for short texts: best score first, leftmost on a tie."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _text(self, token: int) -> str:
        return self.pieces[token] if token >= 0 else chr(-1 - token)

    def _fits(self, a: int, b: int) -> bool:
        key = a * PAIR + b
        ok = self.pair.get(key)
        if ok is None:
            x, y = self._text(a), self._text(b)
            ok = self._merge(x + y) == [x, y]
            if len(self.pair) >= REMEMBER:
                _trim(self.pair)
            self.pair[key] = ok
        return ok

    def encode_segment(self, segment: str) -> list[int]:
        n = len(segment)
        longest: list[int | None] = [None] * n
        for end, (i, reach) in self.automaton.iter(segment):
            longest[end - reach] = i  # matches come by their end, so the last one is the longest
        fits, size, shorter = self.pair, self.size, self.shorter
        good = bytearray(b"\x01") * (n + 1)
        path: list[int] = []
        pos, token = 0, None
        while pos < n:
            if token is None:
                token = longest[pos]
                if token is None:
                    token = -1 - ord(segment[pos])  # a character without a piece stands for itself
            end = pos + size.get(token, 1)
            if good[end] and (not path or (ok := fits.get(path[-1] * PAIR + token)) or (ok is None and self._fits(path[-1], token))):
                path.append(token)
                pos, token = end, None
                continue
            token = shorter.get(token)
            while token is None:
                good[pos] = 0
                back = path.pop()
                pos -= size.get(back, 1)
                token = shorter.get(back)
        ids: list[int] = []
        for token in path:
            if token >= 0:
                ids.append(token)
            else:
                ids += [self.byte_id[b] for b in chr(-1 - token).encode()] if self.byte_id else [self.unk]
        return ids

    def segmented(self, text: str) -> tuple[list[str], list[str | tuple[str, str]]]:
        """The segments of a text, and what is remembered of each: its ids as comma-joined text, with what they decode to where that is another text."""
        cut = self.cut.findall(MARK + text.replace(" ", MARK)) if text else []
        return cut, list(map(self.segments.__getitem__, cut))

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.segmented(text)[1] for i in (p if isinstance(p, str) else p[0]).split(",")]

    def forget(self) -> None:
        """Only the commonest segments and pairs stay: workers live on after a task, and go on with other work."""
        _trim(self.segments)
        _trim(self.pair)

    def surface(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        run = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(" ⁇ " if i == self.unk else "" if i in self.silent else self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: Iterable[int]) -> str:
        text = self.surface(ids)
        return text[1:] if text.startswith(" ") else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the comma-joined ids and of the text decoded from them."""
        cut, parts = self.segmented(text)
        # No run of byte pieces crosses a segment unless each side is whole UTF-8 by itself.
        try:
            joined, back = ",".join(parts), "".join(cut).replace(MARK, " ")
        except TypeError:  # some decode to another text
            joined = ",".join([p if isinstance(p, str) else p[0] for p in parts])
            back = "".join([c.replace(MARK, " ") if isinstance(p, str) else p[1] for c, p in zip(cut, parts, strict=True)])
        back = back[1:] if back.startswith(" ") else back
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return (joined.count(",") + 1 if parts else 0), sha(joined), sha(back)


_CODECS: dict[str, Codec] = {}


def codec_of(shared) -> Codec:
    """The codec of a broadcast vocabulary, built once in each Python worker."""
    key = str(shared.id) if hasattr(shared, "id") else str(id(shared))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value)
    return _CODECS[key]


def _vocabulary(spark: SparkSession, model_path: str):
    return spark.sparkContext.broadcast(load_pieces(model_path))


def encode_column(spark: SparkSession, model_path: str):
    """A column function: text to the array of its ids (null counts as empty)."""
    shared = _vocabulary(spark, model_path)

    @F.arrow_udf("array<int>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(shared)
        for text in texts:
            yield pa.array([codec.encode(t.as_py() or "") for t in text], pa.list_(pa.int32()))
        codec.forget()

    return encode


def decode_column(spark: SparkSession, model_path: str):
    """A column function: array of ids to text (null to null; bytes that are no UTF-8 become U+FFFD)."""
    shared = _vocabulary(spark, model_path)

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        codec = codec_of(shared)
        return pa.array([None if x is None else codec.decode(x) for x in ids.to_pylist()], pa.string())

    return decode


def token_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_tokens, ids_sha256, decoded_sha256`` for every row; null text counts as empty.

    Empty text has no ids: both digests are that of the empty string. Repeated
    rows give repeated results; other columns are left out. No shuffle.
    """
    shared = _vocabulary(docs.sparkSession, model_path)

    @F.arrow_udf("struct<n:bigint,i:string,d:string>")
    def digest(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(shared)
        for text in texts:
            rows = [codec.digest(t.as_py() or "") for t in text]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["n", "i", "d"])
        codec.forget()

    out = docs.select(F.col(id_col), digest(F.col(text_col)).alias("__pm_d"))
    return out.select(id_col, F.col("__pm_d.n").alias("n_tokens"), F.col("__pm_d.i").alias("ids_sha256"), F.col("__pm_d.d").alias("decoded_sha256"))
