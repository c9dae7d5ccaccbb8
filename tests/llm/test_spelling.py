import random
import re
import zlib
from collections import Counter

from pointmill.llm import queries, spelling

ALPHABET = "abcdeé"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def brute(n, ratio=10):
    form, degree = {}, {}
    for w in n:
        others = [o for o in n if near(w, o)]
        degree[w] = len(others)
        best = min(others, key=lambda o: (-n[o], o), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], degree[w], n[form[w]] if w in form else None))
    return sorted(out)


def words(seed, count, lengths):
    rng = random.Random(seed)
    found = {}
    while len(found) < count:
        w = "".join(rng.choice(ALPHABET) for _ in range(rng.choice(lengths)))
        for _ in range(3):
            k = rng.randrange(len(w) + 1)
            found[w] = 10 ** rng.randrange(5) * rng.randrange(2, 4)
            w = rng.choice((w[:k] + rng.choice(ALPHABET) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(ALPHABET) + w[k + 1 :])) or "a"
    return found


def test_equal_to_brute_force(spark):
    n = words(1, 500, (1, 2, 3, 4, 5, 6, 7, 8, 9))
    got = spelling.variant_groups(spark.createDataFrame(list(n.items()), "word string, n long"))
    want = brute(n)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(r[1] and r[2] != r[1] for r in want)


def test_each_pair_once(spark):
    n = words(5, 200, (4, 5, 6))
    got = [(r["x"], r["y"]) for r in spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in n for b in n if a < b and near(a, b)}


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["Because", "throughout", "ÉLÉMENTAIRE", "garçonnet", "possible", "possibly", "sevenly", "sixsix", "naïveté"]
    rows = [(i, " ".join(rng.choice(vocabulary) + rng.choice((",", "", "-x")) for _ in range(80))) for i in range(60)]
    rows += [(100, ""), (101, None), (None, "because because"), (102, "x" * 50_000 + " because"), (103, "because"), (103, "because")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS word", "3 AS n").write.parquet(f"{tmp_path}/documents.parquet")
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    want = brute({w: c for w, c in n.items() if len(w) >= 7 and c >= 2})
    assert sorted(tuple(r) for r in queries.op13_spelling(spark, str(tmp_path)).collect()) == want and any(r[1] for r in want)


def test_odd(spark, no_docs):
    rows = [("abc", 5), ("abc", 95), ("abd", 10), (None, 7), ("xyz", None), ("", 1), ("a", 10)]
    got = spelling.variant_groups(spark.createDataFrame(rows, "word string, n long").selectExpr("*", "1 AS form", "2 AS root"))
    assert sorted(tuple(r) for r in got.collect()) == [("", "a", "a", 1, 1, 10), ("a", None, "a", 10, 1, None), ("abc", None, "abc", 100, 1, None), ("abd", "abc", "abc", 10, 1, 100)]
    assert spelling.variant_groups(spelling.word_counts(spelling.letter_runs(no_docs).selectExpr("run AS word"))).collect() == []
