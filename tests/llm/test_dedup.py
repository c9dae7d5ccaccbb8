import random
import unicodedata

import pytest
import xxhash
from pyspark.sql import functions as F

from pointmill.llm import decontam, digest, line_dedup, simhash


def brute_fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    n = max(1, len(w) - width + 1)
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)


def brute_components(fps):
    """id -> smallest id reachable, of (id, fingerprint)."""
    root = {i: i for i, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(fps):
        for j, b in fps[:k]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in fps}


def test_simhash_values(spark, odd_docs):
    out = simhash.fingerprints(odd_docs).join(odd_docs.selectExpr("doc_id AS d", "text"), F.col("doc_id") == F.col("d")).distinct().collect()
    assert len(out) == 9
    for r in out:
        assert r["fp"] % 2**64 == brute_fingerprint(r["text"])
    # XXH64 with seed 42 is what SQL's xxhash64 computes.
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:
        for k in range(6):
            x = b
            for bit in rng.sample(range(64), k):
                x ^= 1 << bit
            fps.add(x)
    fps |= {base[0] ^ 1 << 63, base[0] ^ 1 << 63 ^ 1, 0, 1, 2**64 - 1, 2**64 - 2}
    sign = lambda x: x - 2**64 if x >> 63 else x
    want = {tuple(sorted((sign(a), sign(b)))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    got = {(r["x"], r["y"]) for r in simhash.near_pairs(spark.createDataFrame([(sign(x),) for x in fps], "fp long")).collect()}
    assert got == want


def test_simhash_components(spark):
    from pointmill.llm.common import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    want = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_components(docs).collect()} == want


def test_simhash_odd(spark, odd_docs, no_docs):
    out = [tuple(r) for r in simhash.near_duplicate_components(odd_docs).select("doc_id", "component_id").collect()]
    assert len(out) == 12 and (2, 1) in out and (6, 4) in out and (5, 4) in out and (None, 4) in out
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(4) == 1 and 5 not in ids
    assert simhash.near_duplicate_components(no_docs).count() == 0 and simhash.drop_near_duplicates(no_docs).count() == 0


def test_lines_dropped_from_all_but_the_first(spark):
    boiler = "all rights reserved by the owner of number %d street"
    docs = spark.createDataFrame([(3, f"alpha one\n{boiler % 7}\n\nomega"), (1, f"beta two\n{boiler % 12}"), (2, "gamma three\nbeta two x"), (4, "alpha one\nunique words here")], "doc_id long, text string")
    out = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert out[1] == (f"beta two\n{boiler % 12}", 2, 0)
    assert out[3] == ("alpha one\n\nomega", 4, 1)
    assert out[4] == ("unique words here", 2, 1) and out[2] == ("gamma three\nbeta two x", 2, 0)


def test_templates_generalise(spark):
    line = "user session opened for account %s from the main office building today again"
    docs = spark.createDataFrame([(i, line % w) for i, w in enumerate(("amy", "bob", "cyd", "dan"))] + [(9, "user session opened by nobody at all in this other strange little place now")], "doc_id long, text string")
    out = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs).collect()}
    assert out == {0: 0, 1: 1, 2: 1, 3: 1, 9: 0}
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs, min_docs=5).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 9: 0}


def test_lines_equal_brute_force(spark):
    """Without near lines the result is that of exact comparison."""
    rng = random.Random(2)
    pool = [" ".join(rng.choice("abcdefghij") * 3 + str(k) for _ in range(9)).replace("1", "x") for k in "qwertzuiop"]
    pool = [f"{c} " * 3 + f"head {c}" for c in "abcdefgh"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 5)))) for i in range(40)]
    first = {}
    for i, t in rows:
        for x in t.split("\n"):
            if x.strip():
                first.setdefault(x, i)
    want = {i: "\n".join(x for x in t.split("\n") if not x.strip() or first[x] == i) for i, t in rows}
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_lines_odd(odd_docs, no_docs):
    out = line_dedup.dedup_lines(odd_docs)
    assert out.count() == 12 and set(odd_docs.columns) | {"n_dropped"} == set(out.columns)
    rows = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()]
    assert (5, None, 0, 0) in rows and (4, "", 1, 0) in rows and rows.count((2, "", 1, 1)) == 2
    assert line_dedup.dedup_lines(no_docs).count() == 0


def brute_contained(docs, items, width=5, least=0.8):
    import re

    words = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = set()
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        k = min(width, len(w))
        own = grams(w, k)
        out |= {(d, i) for d, x in docs if d is not None and len(own & grams(words(x), k)) / len(own) >= least}
    return out


def test_decontamination_equals_brute_force(spark):
    from pointmill.llm.common import table

    docs, items = (table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "benchmark"))
    want = brute_contained([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contained_items(docs, items).collect()}
    assert got == want


def test_decontamination_edges(spark, odd_docs, no_docs, monkeypatch):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    text = [word() for _ in range(400)]
    item = text[100:140]
    broken = [*item[:20], "zzz", *item[21:]]
    items = [(1, " ".join(item)), (2, " ".join(broken)), (3, "lazy dog"), (4, None), (5, ""), (None, "x y"), (6, " ".join(word() for _ in range(30))), (1, " ".join(item))]
    docs = [(10, " ".join(text)), (11, "The LAZY, dog!"), (12, None), (13, ""), (None, " ".join(text)), (10, " ".join(text))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contained_items(d, i).collect()}
    assert got == brute_contained(docs, items) | {(None, 1), (None, 2)} == {(10, 1), (10, 2), (11, 3), (None, 1), (None, 2)}
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)  # the way for large benchmarks
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contained_items(d, i).collect()} == got
    # Rows without an id are judged as others.
    assert sorted(r["doc_id"] or 0 for r in decontam.drop_contaminated(d, i).collect()) == [12, 13]
    assert sorted((r["doc_id"] or 0, r["item_ids"]) for r in decontam.contamination(d, i).collect()) == [(0, "1,2"), (10, "1,2"), (10, "1,2"), (11, "3"), (12, ""), (13, "")]
    full = decontam.contamination(odd_docs, i)
    assert full.count() == 12 and full.filter("contaminated").count() >= 4
    assert decontam.contamination(no_docs, i).count() == 0
    assert decontam.contamination(odd_docs, i.filter("item_id > 99")).filter("contaminated").count() == 0


def canon(t):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold()).split())


def brute_digest(t):
    b = canon(t).encode()
    seed = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), 42)
    return f"{xxhash.xxh64_intdigest(b, 42):016x}{xxhash.xxh64_intdigest(b, seed):016x}"


def test_digest_equals_brute_force(spark):
    import hashlib

    from pointmill.llm.common import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    out = {r["doc_id"]: r for r in digest.edited_digests(docs).collect()}
    assert len(out) == len(rows)
    for k, (i, t) in enumerate(rows):
        n, nxt = len(t), rows[(k + 1) % len(rows)][1]
        e = t[: n - n // 2] + nxt[: n // 2]
        r = out[i]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["fingerprint"] == brute_digest(t) and r["edited_fingerprint"] == brute_digest(e)
        assert r["near_edited"] == float(canon(t) == canon(e)) and r["near_next"] == float(canon(t) == canon(nxt))


def test_digest_canonical_forms(spark):
    same = ["Straße  ONE", "strasse one", " STRASSE one\n", "ﬁne", "FINE", "é", "É"]
    df = spark.createDataFrame(list(enumerate(same)), "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in digest.digests(df).collect()}
    assert got[0] == got[1] == got[2] and got[3] == got[4] and got[5] == got[6] and len(set(got.values())) == 3


def test_digest_collisions_get_a_suffix(spark, monkeypatch):
    monkeypatch.setattr(digest, "_hashes", lambda c: F.struct((F.length(c) % 2).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")))
    df = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "AB"), (4, "abc")], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in digest.digests(df).collect()}
    assert got[1] == got[3] != got[2] and "-" in got[1] and "-" not in got[4]
    monkeypatch.setattr(digest, "BROADCAST_ROWS", 0)
    assert {r["doc_id"]: r["fingerprint"] for r in digest.digests(df).collect()} == got
    assert {r["doc_id"]: r["fingerprint"] for r in digest.edited_digests(df).collect()} == got


def test_digest_odd(odd_docs, no_docs):
    out = digest.edited_digests(odd_docs)
    assert out.count() == 12
    by = {}
    for r in out.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert by[4][0]["fingerprint"] == by[5][0]["fingerprint"] == by[6][0]["fingerprint"] == brute_digest("")
    assert by[1][0]["fingerprint"] == by[2][0]["fingerprint"] and by[1][0]["near_next"] == 1.0 and len(by[2]) == 2
    assert digest.edited_digests(no_docs).count() == 0


def test_near_copies(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    rows, group = [], {}
    for g in range(60):
        base = [word() for _ in range(300)]
        for c in range(3):
            w = list(base)
            if c:
                w[rng.randrange(300)] = word()
            group[len(rows)] = g
            rows.append((len(rows), " ".join(w)))
    rows += [(900, rows[0][1]), (901, ""), (902, None), (903, "lone words")]
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_copy_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[900] == out[0] and out[902] == out[901] == 901 and out[903] == 903
    assert all(group[out[i]] == g for i, g in group.items())
    assert sum(out[i] == i for i in group) <= 1.15 * 60
    assert simhash.likeness(b"a b c d e f", b"A b c d e f") == 1.0 and simhash.likeness(b"", b"") == 1.0 and simhash.likeness(b"a", b"") == 0.0


def test_large_group_of_near_copies(spark):
    """One group holds most rows; nothing is lost and its copies are not expanded into all pairs."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    base = [word() for _ in range(400)]
    rows = [(i, " ".join(base)) for i in range(300)]
    for i in range(300, 500):
        w = list(base)
        w[rng.randrange(400)] = word()
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(word() for _ in range(50))) for i in range(500, 600)]
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept[-100:] == list(range(500, 600)) and kept[0] == 0 and len(kept) <= 100 + 12


def brute_copies(rows, similarity=0.8):
    """id -> smallest id reachable over pairs of texts with enough five-word shingles in common."""

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if not a and not b or len(a & b) / (len(a | b) or 1) >= similarity:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_near_copies_among_texts_of_the_same_words(spark):
    """Permuted texts have one set of words; the two copies among them are neither first nor neighbours."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    mix = lambda: rng.sample(words, len(words))
    p, q, r, s = mix(), mix(), mix(), mix()
    twin = list(q)
    twin[50], twin[51] = twin[51], twin[50]
    rows = [(i, " ".join(w)) for i, w in enumerate([p, q, r, s, twin])]
    out = {x["doc_id"]: x["component_id"] for x in simhash.near_copy_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == brute_copies(rows) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 1}


def test_near_copies_against_brute_force(spark, monkeypatch):
    """Scattered changes on both sides of the similarity, a shared passage as hot shingles, several texts a bucket: no pair is missed."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    common, rows = [word() for _ in range(40)], []
    for g in range(40):
        base = [word() for _ in range(rng.choice([6, 30, 150, 300]))]
        for c in range(4):
            w = list(base)
            for k in rng.sample(range(len(w)), min(len(w) // 4, rng.randint(0, 8) if c else 0)):
                w[k] = word()
            rows.append((len(rows), " ".join(w + (common if g % 2 else []))))
    want = brute_copies(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in simhash.near_copy_components(docs).collect()} == want
    for name, value in (("SAMPLE", 1), ("SEEN", 2), ("LEAD", 2), ("BLOCK", 3), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(simhash, name, value)
    assert {x["doc_id"]: x["component_id"] for x in simhash.near_copy_components(docs).collect()} == want
    assert len(set(want.values())) not in (40, len(rows))


def test_several_templates_in_one_leaf(spark, monkeypatch):
    """Templates of every line are those of brute force, however many stand in one leaf and segment."""
    rng = random.Random(8)
    lines = ["opened by user amy via web", "opened by user bob via ssh", "opened by user cyd via ssh"]
    for n in (6, 10, 11, 16, 22):
        for t in range(6):
            base = ["one", "two", "three", *(rng.choice("abc") for _ in range(n - 3))]
            for _ in range(5):
                w = list(base)
                for k in rng.sample(range(3, n), rng.randint(1, n // 5 + 1)):
                    w[k] = rng.choice("defgh")
                lines.append(" ".join(w))
    lines = sorted(set(lines))
    root = list(range(len(lines)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(lines):
        for j in range(i):
            x, y = a.split(), lines[j].split()
            if len(x) == len(y) and x[:3] == y[:3] and sum(u == v for u, v in zip(x, y)) >= 0.8 * len(x) - 1e-9:
                root[find(i)] = find(j)
    want = {frozenset(a for k, a in enumerate(lines) if find(k) == r) for r in map(find, range(len(lines)))}
    docs = spark.createDataFrame([(i, a) for i, a in enumerate(["opened by user amy via web", *lines])], "doc_id long, text string")
    for block in (line_dedup.BLOCK, 2):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        own = line_dedup._lines(docs, "doc_id", "text", 3).select("masked", F.col("h").alias("g")).distinct()
        got = line_dedup._templates(docs, line_dedup._lines(docs, "doc_id", "text", 3).drop("masked"), "doc_id", "text", 3, 0.8)
        by = {}
        for r in own.join(got, F.col("g") == F.col("h"), "left").collect():
            by.setdefault(r["template"] or r["g"], set()).add(r["masked"])
        assert set(map(frozenset, by.values())) == want
    kept = {r["doc_id"] for r in line_dedup.dedup_lines(docs).collect() if r["n_dropped"] == 0}
    assert 1 + lines.index("opened by user bob via ssh") in kept and 1 + lines.index("opened by user cyd via ssh") not in kept


def test_pairs_of_a_leaf_grow_with_its_lines(spark):
    """Lines that share their leading tokens only meet few others, however many they are."""
    rng = random.Random(3)

    def met(count, n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40 * count)]
        lines = ["error in module " + " ".join(rng.choice(words) for _ in range(n - 3)) for _ in range(count)]
        docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
        text = line_dedup._lines(docs, "doc_id", "text", 3).select("leaf", "n", "h", F.lit(1).alias("seen"), "masked")
        c = F.col("c")
        return line_dedup._prefixes(text, 3, 0.8).groupBy("key").agg(F.count("*").alias("c")).agg(F.sum(c * (c - 1) / 2)).first()[0]

    for n in (15, 18, 27):
        assert met(300, n) < 300 and met(600, n) < 600


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(k).getName() for k in range(files.size())) if f.startswith("shuffle_")}


def test_shuffles_of_settled_tables_are_deleted(spark):
    """What was shuffled for a settled or stored table and for the rounds of components is gone soon after, not when garbage is collected."""
    import time

    from pyspark.sql import functions as F

    from pointmill.operators.components import connected_components
    from pointmill.storage import settled, stored

    before = _shuffle_files(spark)
    edges = settled(spark.range(400).selectExpr("id AS a", "id + id % 3 AS b").repartition(4, "a"))
    held = connected_components(edges)
    sums = stored(edges.groupBy("b").agg(F.count("*").alias("n")), "sums")
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    # One look at whether there are edges stays.
    assert len(left) <= 10, len(left)
    assert held.count() and sums.count() == edges.select("b").distinct().count()


def test_near_copies_come_from_simhash(spark, monkeypatch):
    """SimHash finds near copies by itself: also with the exact search for the rest taken away; its links are checked on all shingles."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    rows = []
    for g in range(20):
        base = [word() for _ in range(1_000)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join([*base, word()]))]
    # Fingerprints count repeats, sets do not: alike to SimHash only.
    rows += [(100, "a b c " * 100 + "x y z u v w"), (101, "a b c " * 100 + "p q r s t o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(docs).collect()}
    near = [g for g in range(20) if ((fps[2 * g] ^ fps[2 * g + 1]) & (1 << 64) - 1).bit_count() <= simhash.RADIUS]
    assert len(near) >= 10 and ((fps[100] ^ fps[101]) & (1 << 64) - 1).bit_count() <= simhash.RADIUS
    want = brute_copies(rows)
    assert want[101] == 101
    assert {x["doc_id"]: x["component_id"] for x in simhash.near_copy_components(docs).collect()} == want
    bucket_pairs = simhash._bucket_pairs
    monkeypatch.setattr(simhash, "LEAD", 1 << 30)
    monkeypatch.setattr(simhash, "_bucket_pairs", lambda met, similarity: bucket_pairs(met.limit(0), similarity))
    alone = {x["doc_id"]: x["component_id"] for x in simhash.near_copy_components(docs).collect()}
    assert {g for g in range(20) if alone[2 * g + 1] == 2 * g} == {*near} and alone[101] == 101
