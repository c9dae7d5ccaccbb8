import random

import numpy as np

from pointmill.llm import minhash


def shingles(text, width=4):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows):
    """(id, text) -> id: size of the set, smallest id reachable."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {k: k for k in range(len(sets))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)], least[find(k)] == i) for k, (i, s) in enumerate(sets))


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice(([], [f"x{rng.randrange(9999)}"], [words[k], f"y{rng.randrange(9999)}"]))
    return words


def corpus(seed=4):
    """Texts of 1 to 400 words with copies about the limit of likeness, and a passage that most share."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(40)]
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((1, 2, 3, 4, 5, 9, 20, 60, 150, 400)))]
        if rng.random() < 0.6:
            base += passage
        texts.append(base)
        for _ in range(rng.randrange(6)):
            texts.append(changed(rng, base, rng.randrange(1 + len(base) // 25)))
    return [(k, " ".join(t)) for k, t in enumerate(rng.sample(texts, len(texts)))]


def test_equal_to_brute_force(spark):
    rows = corpus()
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute(rows)
    assert sorted(tuple(r) for r in out.collect()) == want
    assert 0 < sum(not r[3] for r in want) < len(want)


def test_long_lists_equal_to_brute_force(spark, monkeypatch):
    """Leads, blocks, hot nodes and known common shingles, all at small sizes."""
    for name, value in {"LEAD": 3, "BLOCK": 4, "SHARE": 20, "SAMPLE": 2, "SEEN": 2, "BROADCAST_ROWS": 5}.items():
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(8)
    base = [f"b{k}" for k in range(120)]
    rows = corpus(9) + [(1000 + k, " ".join(changed(rng, base, 3))) for k in range(60)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in out.collect()) == brute(rows)


def test_retained_values_meet():
    """Any two sets at the limit share one of the values that each keeps, and sketches keep the order of one function."""
    rng = np.random.default_rng(3)
    for n in range(1, 200):
        few, many = minhash._retained(n, 80)
        assert few <= many <= n
        a = np.unique(rng.integers(0, 2**62, n, dtype=np.uint64))
        for m in range(n, 5 * n // 4 + 1):
            both = -(-80 * (n + m) // 180)
            if both > n:
                continue
            b = np.concatenate([a[rng.permutation(n)[:both]], rng.integers(2**62, 2**63, m - both, dtype=np.uint64)])
            x, y = minhash._ordered(a, np.zeros(0), np.zeros(0)), minhash._ordered(np.sort(b), np.zeros(0), np.zeros(0))
            assert set(x[:few]) & set(y[: minhash._retained(m, 80)[1]])


def test_odd(spark, odd_docs, no_docs):
    out = sorted((tuple(r) for r in minhash.near_duplicates(odd_docs).collect()), key=str)
    assert len(out) == 12
    by = {r[0]: r[1:] for r in out}
    assert by[1][1:] == (1, True) and by[2][1:] == (1, False) and [r[0] for r in out].count(2) == 2
    # Without words: no link, not even among themselves.
    assert by[4] == (0, 4, True) and by[5] == (0, 5, True) and by[6] == (0, 6, True)
    assert by[7] == (1, 7, True)
    # Without an id: no links of their own.
    assert sorted((r[1:] for r in out if r[0] is None), key=str) == [(0, None, False), (len(shingles(odd_docs.filter("doc_id is null and text is not null").first()["text"])), None, False)]
    assert minhash.near_duplicates(no_docs).collect() == []
    same = spark.createDataFrame([(1, "a b c d e f"), (1, "q r s"), (2, "q r s"), (None, "Q  r s")], "doc_id long, text string")
    assert sorted((tuple(r) for r in minhash.near_duplicates(same).collect()), key=str) == [(1, 1, 1, True), (1, 3, 1, True), (2, 1, 1, False), (None, 1, 1, False)]
