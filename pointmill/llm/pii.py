"""Personal data replaced by keyed surrogates.

Entities are detected by form (addresses, numbers, keys, names behind a form
of address). Each gets a surrogate from a keyed hash of its kind and canonical
value: of the same kind, script and format (digits for digits, letters of the
same case and script, valid check digits where the original's are valid), a
given name of the gender that its form of address tells.

Coreference: what may occur apart is keyed apart. An e-mail's domain, a given
name, a family name and the last nine digits of a phone number have surrogates
of their own, so "Mr John Smith", "Dr Smith" and a bare "Smith" later in the
text agree, and so does a number with and without its country's code. The same
entity gets the same surrogate everywhere, in whatever format it is written.

Collision checks: before anything is replaced, the surrogates of all entities
of the corpus, of all kinds, are compared in Spark with each other and with
all real values. Those that meet another take the next try. From the third try
on a surrogate is longer than its original by one more character each time
(an IPv4 address takes three-digit octets, then an IPv6 address), so a space
whose values are all taken, such as one-digit secrets, is left for a wider
one, and every entity ends with a surrogate that is distinct and not real.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, settled

#: Entities on a later try are broadcast only up to so many rows and bytes; beyond, they are joined to their documents.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 8 << 20
#: From this try on surrogates are wider than their originals, by one character a try, and in the end by LONG.
WIDEN, LAST, LONG = 3, 12, 32
#: Digits of a phone number that are replaced; those before them (country, trunk, first of the area) stay.
NATIONAL = 9
#: Forms of address by gender (fixed values).
MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña")
NEUTRAL = ("Dr", "Prof")
#: Endings of generated given names (fixed values).
ENDINGS = {"m": ("an", "or", "us", "in", "ert"), "f": ("a", "ina", "ella", "ea", "ia")}
_W = r"[^\W\d_]"
_UP = rf"(?=[^\W\d_a-z])(?!\b(?:{'|'.join((*MALE, *FEMALE, *NEUTRAL))})\b){_W}"
#: A capitalised word, also with hyphens or an apostrophe; an initial with its dot.
_PART = rf"{_UP}+(?:['’-]{_W}+)*"
NAME = re.compile(rf"(?<!\w)(?P<title>{'|'.join((*MALE, *FEMALE, *NEUTRAL))})\.?[ \t]+(?P<who>(?:{_UP}\.[ \t]?)*{_PART}(?:[ \t](?:{_UP}\.|{_PART})){{0,2}}|{_UP}\.)")
TITLES = tuple(f"{t}{s}" for t in (*MALE, *FEMALE, *NEUTRAL) for s in (" ", ". ", "\t"))
DIGIT_OR_AT = re.compile(r"[0-9@]|::|(?i:passw|pwd|secret|token|api.?key)")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kind, pattern, and what a text must hold for the pattern to be tried. The earlier pattern wins.
PATTERNS = [
    # The word and the value may stand in quotes, as in JSON; a quoted value may hold spaces.
    ("secret", re.compile(r"(?i)(?<![^\W_])(?:password|passwd|pwd|secret|token|api[_-]?key)(?:[_-](?:key|value|id))?[\"'`]?[ \t]*(?P<sep>[=:])>?[ \t]*(?P<q>[\"'`]?)(?P<v>(?<=[\"'`])[^\"'`\r\n]{1,400}(?=[\"'`])|[^\s,;'\"`]+)"), ("=", ":")),
    ("key", re.compile(r"\b(?P<v>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,})\b"), ("AKIA", "ASIA", "gh", "sk-")),
    ("email", re.compile(r"(?<![\w.%+'’-])(?P<v>\w[\w.%+'’-]*@[\w-]+(?:\.[\w-]+)+)"), ("@",)),
    ("ip6", re.compile(r"(?<![\w:.])(?P<v>[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![\w:]|\.\d)"), (":",)),
    ("ip", re.compile(rf"(?<![\d.])(?P<v>(?:{_OCTET}\.){{3}}{_OCTET})(?![\d]|\.\d)"), (".",)),
    ("iban", re.compile(r"\b(?P<v>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b"), None),
    ("card", re.compile(r"(?<![\d+])(?P<v>\d{4}([ -]?)\d{4}\2\d{4}\2\d{1,7})(?!\d)"), None),
    ("ssn", re.compile(r"(?<![\d-])(?P<v>\d{3}-\d{2}-\d{4})(?![\d-])"), ("-",)),
    # A country's code; a trunk zero; three, three and four or three digits; behind a word for a phone, any digits.
    ("phone", re.compile(r"(?<![\w+])(?P<v>\+\d{1,3}[ .-]?(?:\(\d{1,5}\)|\d{1,5})(?:[ ./-]?\d{2,8}){1,5})(?!\d)"), ("+",)),
    ("phone", re.compile(r"(?<![\d+.-])(?P<v>0\d{1,5}[ /-]\d{3,8}(?:[ -]\d{2,4}){0,2}|0\d(?:[ .]\d{2}){4}|\(0\d{1,5}\)[ ]?\d{3,8}(?:[ -]\d{2,4}){0,2})(?![\d.-]*\d)"), ("0",)),
    ("phone", re.compile(r"(?<![\d+.-])(?P<v>(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}|[6-9]\d{2} \d{3} \d{3})(?![\d-])"), None),
    ("phone", re.compile(r"(?i)\b(?:tel|telephone|phone|mobile|cell|fax|call|telefon|handy|t[ée]l[ée]phone|tel[ée]fono|m[óo]vil)\b[.:]*[ \t]*(?P<v>\d{7,15}(?!\d)|\(?\d[\d ().-]{5,16}\d)(?!\d)"), None),
]
#: Words before four numbers with dots that are no address.
_VERSION = re.compile(r"(?i)(?:version|release|section|kapitel|ver\.|v\.?)[ \t]*$")
_DIGITS = ("phone", "card", "ssn")


def luhn_valid(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def iban_valid(iban: str) -> bool:
    return _mod97(iban) == 1


def canonical(kind: str, value: str) -> str:
    """What all spellings of one entity share."""
    if kind == "phone":
        return re.sub(r"\D", "", value)[-NATIONAL:]
    if kind in _DIGITS:
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind in ("email", "domain"):
        return value.lower()
    if kind == "ip6":
        return ipaddress.IPv6Address(value).exploded
    return value.casefold() if _is_name(kind) else value


def _is_name(kind: str) -> bool:
    return kind in ("family", "given-m", "given-f")


def _sound(kind: str, m: re.Match) -> str | None:
    """The matched value, trimmed, or None where the form alone misleads."""
    v = m["v"]
    if kind == "secret":
        if m["q"] and m.string[m.end("v") : m.end("v") + 1] == m["q"]:
            return v if v.strip() else None
        v = v.rstrip(".!?)]")
        # Behind a colon, a plain word is prose.
        return v if v and (m["sep"] == "=" or not v.isalpha() or not (v.islower() or v.istitle())) else None
    if kind == "phone":
        return v if 7 <= sum(c.isdigit() for c in v) <= 15 else None
    if kind == "ip":
        return None if _VERSION.search(m.string[max(0, m.start("v") - 16) : m.start("v")]) else v
    if kind == "ip6":
        try:
            ipaddress.IPv6Address(v)
        except ValueError:
            return None
        # Words such as "::" and times such as 10:20:30 are none.
        return v if v.count(":") >= 3 or sum(c.isalnum() for c in v) >= 4 else None
    return v


def _gender(name: str) -> str:
    """Where no form of address tells: a guess by the last letter."""
    return "f" if unicodedata.normalize("NFD", name.lower()).rstrip("̀́")[-1:] in ("a", "e", "i", "y") else "m"


def _name_parts(m: re.Match) -> list[tuple[int, int, str]]:
    """(start, end, kind) of a name's parts: the last word is the family name, dots mark initials."""
    at = m.start("who")
    words = [(at + w.start(), at + w.end()) for w in re.finditer(r"[^\s.]+\.?", m["who"])]
    title = m["title"]
    out = []
    for i, (s, e) in enumerate(words):
        word = m.string[s:e]
        if word.endswith(".") and len(word) == 2:
            out.append((s, s + 1, "initial"))
        elif i == len(words) - 1:
            out.append((s, s + len(word.rstrip(".")), "family"))
        else:
            out.append((s, e, f"given-{'m' if title in MALE else 'f' if title in FEMALE else '?'}"))
    return out


def find(text: str | None) -> list[tuple[int, int, str, list[tuple[int, int, str]]]]:
    """(start, end, kind, parts) of the entities of a text, in order, without overlaps; parts are (start, end, kind) of what is keyed apart.

    Kinds are secret, key, email, ip, ip6, iban, card, ssn, phone and name. A
    name is found behind a form of address, and then wherever one of its words
    of three letters or more stands in the text as a word in the same letters.
    """
    if not text:
        return []
    found: dict[int, tuple[int, int, str, list]] = {}
    starts: list[int] = []

    def add(start: int, end: int, kind: str, parts: list) -> bool:
        k = bisect.bisect_right(starts, start)
        if (k and found[starts[k - 1]][1] > start) or (k < len(starts) and starts[k] < end):
            return False
        starts.insert(k, start)
        found[start] = (start, end, kind, parts)
        return True

    if DIGIT_OR_AT.search(text):
        for kind, pattern, needs in PATTERNS:
            if needs is None or any(x in text for x in needs):
                for m in pattern.finditer(text):
                    v = _sound(kind, m)
                    if v is not None:
                        s, e = m.start("v"), m.start("v") + len(v)
                        cut = s + v.index("@") if kind == "email" else e
                        add(s, e, kind, [(s, cut, "email"), (cut + 1, e, "domain")] if kind == "email" else [(s, e, kind)])
    if any(t in text for t in TITLES):
        named = [(m.start("who"), m.end("who"), _name_parts(m)) for m in NAME.finditer(text)]
        known: dict[str, str] = {}
        for _, _, parts in named:
            for s, e, kind in parts:
                word = text[s:e]
                if kind in ("given-m", "given-f"):
                    known.setdefault(word.casefold(), kind)
        words: dict[str, str] = {}
        for s0, e0, parts in named:
            parts = [(s, e, known.get(text[s:e].casefold(), f"given-{_gender(text[s:e])}") if k == "given-?" else k) for s, e, k in parts]
            if add(s0, max(e for _, e, _ in parts), "name", parts):
                for s, e, kind in parts:
                    if e - s >= 3:
                        words.setdefault(text[s:e], kind)
        if words:
            bare = re.compile(rf"(?<![\w@])(?:{'|'.join(sorted(map(re.escape, words), key=len, reverse=True))})(?!\w)")
            for m in bare.finditer(text):
                add(m.start(), m.end(), "name", [(m.start(), m.end(), words[m[0]])])
    return [found[s] for s in starts]


def spans(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of all parts of all entities of a text."""
    out = []
    for start, end, _, parts in find(text):
        for s, e, kind in parts:
            # An e-mail is known by its whole address, though only what stands before @ is its own.
            out.append((s, e, kind, canonical(kind, text[start:end] if kind == "email" else text[s:e])))
    return out


class _Stream:
    """Keyed pseudo-random numbers for one entity and try."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.message = key, "\0".join(parts).encode("utf-8", "surrogatepass")
        self.block, self.left = 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.message + b"\0%d" % self.block, hashlib.sha256).digest()
            self.block += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x % n

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))


_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnprstvwz"


def _is_latin(c: str) -> bool:
    return "a" <= c.lower() <= "z" or unicodedata.name(c, "").startswith("LATIN")


def _letter(c: str, s: _Stream) -> str:
    """Another letter of the same script, case and, for Latin, sound."""
    low = c.lower()
    if _is_latin(c):
        pool = _VOWELS if unicodedata.normalize("NFD", low)[0] in "aeiouy" else _CONSONANTS
    else:
        script = unicodedata.name(low[:1], "").split(" ")[0]
        base = ord(low[0]) & ~0xF
        pool = [x for x in map(chr, range(max(0x80, base - 0x10), base + 0x20)) if x.isalpha() and x == x.lower() and unicodedata.name(x, "").split(" ")[0] == script] or [low]
    d = pool[s.below(len(pool))]
    return d.upper() if c.isupper() and len(d.upper()) == 1 else d


def _like(value: str, s: _Stream) -> str:
    return "".join(str(s.below(10)) if c.isdigit() else _letter(c, s) if c.isalpha() else c for c in value)


def _more(value: str, n: int, s: _Stream) -> str:
    """n more characters of the kind and script in which a value ends."""
    last = next((c for c in reversed(value) if c.isalnum()), "0")
    if last.isdigit():
        return s.digits(n)
    if not _is_latin(last):
        return "".join(_letter(last.lower(), s) for _ in range(n))
    own = "".join((_VOWELS if i % 2 else _CONSONANTS)[s.below(5 if i % 2 else 18)] for i in range(n))
    return own.upper() if value.isupper() else own


def _given(gender: str, canon: str, extra: int, s: _Stream) -> str:
    """A given name of the gender: a stem of about the length of the original, and an ending."""
    if not _is_latin(canon[0]):
        return _like(canon, s) + _more(canon, extra, s)
    stem = "".join((_VOWELS if i % 2 else _CONSONANTS)[s.below(5 if i % 2 else 18)] for i in range(2 * max(1, (len(canon) - 1) // 2) + 1 + 2 * extra))
    return stem + ENDINGS[gender][s.below(len(ENDINGS[gender]))]


def surrogate(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """The canonical surrogate of a part of an entity on a try."""
    s = _Stream(key, kind, canon, str(attempt))
    extra = LONG if attempt >= LAST else max(0, attempt - WIDEN + 1)
    if kind == "email":
        local = canon.partition("@")[0]
        # The domain is replaced apart; beside the original one, the new local part is told apart from others there.
        return f"{(_like(local, s) + _more(local, extra, s)).lower()}@{canon.partition('@')[2]}"
    if kind == "domain":
        labels = canon.split(".")
        new = [_like(x, s) for x in labels[:-1]]
        new[0] += _more(labels[0], extra, s)
        return ".".join([*new, labels[-1]]).lower()
    if kind == "ip":
        if extra > 3:
            return str(ipaddress.IPv6Address((0x20010DB8 << 96) + int(s.digits(28)) % (1 << 96)))
        size = {1: (1, 9), 2: (10, 99), 3: (100, 254)}
        return ".".join(str(lo + s.below(hi - lo + 1)) for lo, hi in (size[3 if extra else len(x)] for x in canon.split(".")))
    if kind == "ip6":
        groups = [g if int(g, 16) == 0 and not extra else f"{1 + s.below((16 ** len(g.lstrip('0')) if g.strip('0') and not extra else 65536) - 1):04x}" for g in canon.split(":")]
        return ":".join(groups)
    if kind == "card":
        body = canon[0] + s.digits(len(canon) - 2 + extra)
        start = s.below(10)
        return next(x for k in range(10) if luhn_valid(x := body + str((start + k) % 10)) == luhn_valid(canon))
    if kind in ("phone", "ssn"):
        return s.digits(len(canon) + extra)
    if kind == "key":
        head = re.match(r"AKIA|ASIA|gh._|sk-", canon)[0]
        body = canon[len(head) :] + canon[-1] * extra
        return head + "".join(str(s.below(10)) if c.isdigit() else chr((65 if c.isupper() else 97) + s.below(26)) if c.isalpha() else c for c in body)
    if kind == "iban":
        body = "".join(str(s.below(10)) if c.isdigit() else chr(65 + s.below(26)) for c in canon[4:]) + s.digits(extra)
        right = 98 - _mod97(f"{canon[:2]}00{body}")
        return f"{canon[:2]}{right if iban_valid(canon) else (right + s.below(90)) % 96 + 2:02d}{body}"
    if kind == "secret":
        hexa = re.fullmatch(r"[0-9a-f]{8,}", canon) is not None
        return ("".join("0123456789abcdef"[s.below(16)] for _ in canon) if hexa else _like(canon, s)) + _more(canon, extra, s)
    if kind in ("given-m", "given-f"):
        return _given(kind[-1], canon, extra, s)
    return (_like(canon, s) + _more(canon, extra, s)).casefold()


def _cased(value: str, new: str) -> str:
    """new with the case of value: all capitals, or a capital at the start of each part."""
    if len(value) > 1 and value.isupper():
        return new.upper()
    return re.sub(rf"(?:^|(?<=['’-])){_W}", lambda m: m[0].upper(), new) if value[:1].isupper() else new


def written(kind: str, value: str, new: str) -> str:
    """The canonical surrogate in the format in which the part was written."""
    if kind in (*_DIGITS, "iban"):
        head = max(0, sum(c.isdigit() for c in value) - NATIONAL) if kind == "phone" else 0
        rest, out = iter(new), []
        for c in value:
            free = c.isalnum() if kind == "iban" else c.isdigit()
            out.append(c if not free or head > 0 else next(rest))
            head -= free
        return "".join([*out, *rest])
    if kind == "email":
        new = new.partition("@")[0]
    if kind in ("email", "domain"):
        return new.upper() if value.isupper() else new
    if kind == "ip6":
        if "::" in value:
            new = ipaddress.IPv6Address(new).compressed
        else:
            new = ":".join(g.lstrip("0").zfill(len(v)) for g, v in zip(new.split(":"), value.split(":"), strict=True))
        return new.upper() if value.upper() == value else new
    return _cased(value, new) if _is_name(kind) else new


def replaced(text: str | None, key: bytes, tries: dict) -> tuple[str | None, list[tuple[int, int, str, list]]]:
    found = find(text)
    if not found:
        return text, []
    # An initial is that of the new given name that it stands for, if the text holds it.
    own = spans(text)
    initials = {}
    for _, _, kind, canon in own:
        if kind.startswith("given"):
            initials.setdefault(canon[0], surrogate(key, kind, canon, tries.get((kind, canon), 0))[0].upper())
    out, at = [], 0
    for start, end, kind, canon in own:
        value = text[start:end]
        if kind == "initial":
            new = initials.get(value.casefold()) or _letter(value, _Stream(key, kind, canon))
        else:
            new = written(kind, value, surrogate(key, kind, canon, tries.get((kind, canon), 0)))
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), found


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, h, kind, canon``, once for each document (its id and a hash of its text) that holds the entity; initials are none."""

    def look(batches):
        for b in batches:
            at, kinds, canons = [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                for kind, canon in sorted({(k, c) for _, _, k, c in spans(text) if k != "initial"}):
                    at.append(i), kinds.append(kind), canons.append(canon)
            rows = pa.array(at, pa.int64())
            yield pa.record_batch([b.column(0).take(rows), b.column(1).take(rows), pa.array(kinds, pa.string()), pa.array(canons, pa.string())], ["id", "h", "kind", "canon"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.xxhash64(text_col), F.col(text_col)).mapInArrow(look, f"id {kind}, h bigint, kind string, canon string")


def settled_tries(found: DataFrame, key: bytes) -> DataFrame:
    """``kind, canon, attempt`` of the entities that need a later try; all surrogates are then distinct and none is a real entity.

    Each round makes the surrogates of the entities that have none yet. The
    least entity keeps one that several want; one that is a real value or was
    given before stays unused. Rounds work on what is left only.
    """

    def make(kind: pa.Array, canon: pa.Array, attempt: pa.Array) -> pa.Array:
        rows = zip(kind.to_pylist(), canon.to_pylist(), attempt.to_pylist(), strict=True)
        return pa.array([surrogate(key, k, c, a).lower() for k, c, a in rows], pa.string())

    own = settled(found.select("kind", "canon").distinct())
    taken = own.select(F.lower("canon").alias("t")).distinct()
    todo, late, attempt = own, None, 0
    while True:
        made = todo.withColumn("s", F.arrow_udf(make, "string")("kind", "canon", F.lit(attempt)))
        first = made.groupBy("s").agg(F.min(F.struct("kind", "canon")).alias("w"))
        given = settled(first.join(taken, F.col("s") == F.col("t"), "left_anti").select("s", F.col("w.kind").alias("kind"), F.col("w.canon").alias("canon")))
        if attempt:
            done = given.select("kind", "canon", F.lit(attempt).alias("attempt"))
            late = done if late is None else late.union(done)
        todo = settled(todo.join(given.select("kind", "canon"), ["kind", "canon"], "left_anti"))
        if not todo.limit(1).count():
            return late if late is not None else own.limit(0).withColumn("attempt", F.lit(0))
        taken = taken.union(given.select("s"))
        attempt += 1


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``text_col`` rewritten, and ``n_entities, kinds`` (distinct, ascending, comma-joined).

    Text outside entities is left as it is. Null text stays null with 0
    entities; equal texts become equal texts; rows without an id and repeated
    rows are handled like others. Columns of docs with the added names are replaced.
    """
    late = settled(settled_tries(entities(docs, id_col, text_col), key))
    n, size = late.agg(F.count("*"), F.coalesce(F.sum(F.length("canon") + 100), F.lit(0))).first()
    kind = "struct<t:string,n:int,k:string>"

    def rows_of(texts, tries):
        rows = [replaced(t, key, x) for t, x in zip(texts, tries, strict=True)]
        return pa.StructArray.from_arrays(
            [pa.array([t for t, _ in rows], pa.string()), pa.array([len(f) for _, f in rows], pa.int32()), pa.array([",".join(sorted({x[2] for x in f})) for _, f in rows], pa.string())],
            ["t", "n", "k"],
        )

    if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        tries = {(r["kind"], r["canon"]): r["attempt"] for r in late.collect()} if n else {}
        shared = docs.sparkSession.sparkContext.broadcast(tries)

        def rewrite(text: pa.Array) -> pa.Array:
            return rows_of(text.to_pylist(), [shared.value] * len(text))

        out = docs.withColumn(f"{P}r", F.arrow_udf(rewrite, kind)(F.col(text_col)))
    else:
        def rewrite_with(text: pa.Array, own: pa.Array) -> pa.Array:
            return rows_of(text.to_pylist(), [{(x["kind"], x["canon"]): x["attempt"] for x in o or []} for o in own.to_pylist()])

        # By id and text: rows without an id meet only those of their own text.
        met = entities(docs, id_col, text_col).distinct().join(late, ["kind", "canon"])
        met = met.groupBy(F.col("id").alias(f"{P}id"), F.col("h").alias(f"{P}h")).agg(F.collect_set(F.struct("kind", "canon", "attempt")).alias(f"{P}late"))
        out = docs.join(met, F.col(id_col).eqNullSafe(F.col(f"{P}id")) & (F.xxhash64(text_col) == F.col(f"{P}h")), "left")
        out = out.withColumn(f"{P}r", F.arrow_udf(rewrite_with, kind)(F.col(text_col), F.col(f"{P}late"))).drop(f"{P}id", f"{P}h", f"{P}late")
    return out.withColumns({text_col: F.col(f"{P}r.t"), "n_entities": F.col(f"{P}r.n"), "kinds": F.col(f"{P}r.k")}).drop(f"{P}r")
