"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

import functools
import os
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attnlm, decontam, digest, hardneg, langid, license_scan, line_dedup, minhash, pii, simhash, spelling, spm, toxicity
from .common import bounded_batches, id_bucket, table


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public vocabulary files are: a folder in POINTMILL_TOKENIZERS, else their package."""
    if folder := os.environ.get("POINTMILL_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def surrogate_key() -> bytes:
    """The secret of the surrogates: POINTMILL_PII_KEY, which runs that must agree share; where it isn't set, a random one of this process."""
    own = os.environ.get("POINTMILL_PII_KEY")
    return own.encode() if own else secrets.token_bytes(32)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return judged.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.edited_digests(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.token_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attnlm.score_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "n_hits", "n_quoted", "hits")


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicate_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(table(spark, sf_dir, "documents"), surrogate_key())
    return out.select("doc_id", "text", "n_entities", "kinds")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 7 have the next label, those divisible by 50 are the anchors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hardneg.hard_negatives(rows, F.col("vec_id") % 50 == 0)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose crc32, with the document's id (empty where there is none) before it, is a multiple of 31 lose one letter."""
    runs = spelling.letter_runs(table(spark, sf_dir, "documents"))
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    word = F.when(h % 31 == 0, spelling.one_letter_less(h % F.length("run"), F.col("run"))).otherwise(F.col("run"))
    return spelling.variant_groups(spelling.word_counts(runs.select(word.alias("word"))))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language": op2_language,
    "op3_fingerprint": op3_fingerprint,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_attention_lm": op5_attention_lm,
    "op6_toxicity": op6_toxicity,
    "op7_license": op7_license,
    "op8_simhash": op8_simhash,
    "op9_pii": op9_pii,
    "op10_decontamination": op10_decontamination,
    "op11_minhash": op11_minhash,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {}

ORACLES["op10_decontamination"] = r"""
WITH w AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda k: array_to_string(ws[k:k+4], ' ')))) AS s
  FROM w WHERE len(ws) >= 5),
n AS (SELECT item_id, count(*) AS size FROM i GROUP BY item_id),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
e AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda k: array_to_string(ws[k:k+4], ' '))) AS s
  FROM d WHERE len(ws) >= 5)),
held AS (SELECT e.doc_id, i.item_id, count(*) * 1e0 / any_value(n.size) AS c
  FROM e JOIN i ON e.s = i.s JOIN n ON n.item_id = i.item_id GROUP BY 1, 2),
per AS (SELECT doc_id, count(*) AS k, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS ids, max(c) AS m
  FROM held WHERE c >= 0.8 - 1e-12 GROUP BY doc_id)
SELECT t.doc_id, coalesce(per.k, 0) AS n_items, coalesce(per.ids, '') AS item_ids,
  coalesce(round(per.m, 6), 0e0) AS max_containment, per.doc_id IS NOT NULL AS contaminated
FROM documents t LEFT JOIN per ON per.doc_id = t.doc_id
"""

#: SQL that lower-cases A-Z alone.
_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op11_minhash"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 1) + 1), lambda k: array_to_string(ws[k:k+3], ' '))) AS s FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.node),
m AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.doc_id = d.doc_id
"""

ORACLES["op12_hard_negatives"] = r"""
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id <> b.id AND len(a.q) = len(b.q) WHERE a.id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""

# crc32 bit by bit, eight steps a byte; words meet where they agree but for one place of one or both.
_BIT = "CASE WHEN {0} % 2 = 1 THEN xor({0} // 2, 3988292384) ELSE {0} // 2 END"
ORACLES["op13_spelling"] = rf"""
WITH RECURSIVE t0 AS (SELECT i AS b, i AS c FROM range(256) x(i)),
t1 AS (SELECT b, {_BIT.format("c")} AS c FROM t0), t2 AS (SELECT b, {_BIT.format("c")} AS c FROM t1), t3 AS (SELECT b, {_BIT.format("c")} AS c FROM t2),
t4 AS (SELECT b, {_BIT.format("c")} AS c FROM t3), t5 AS (SELECT b, {_BIT.format("c")} AS c FROM t4), t6 AS (SELECT b, {_BIT.format("c")} AS c FROM t5),
t7 AS (SELECT b, {_BIT.format("c")} AS c FROM t6), t8 AS (SELECT b, {_BIT.format("c")} AS c FROM t7),
tab AS (SELECT list(c ORDER BY b) AS t FROM t8),
u AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_AZ.format("text")}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
r AS (SELECT id, run, count(*) AS k FROM u WHERE length(run) >= 7 GROUP BY 1, 2),
y AS (SELECT id, run, k, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END)) AS bytes FROM r),
h AS (SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(bytes, lambda x: CAST(x AS BIGINT))),
    lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1])), 4294967295) AS h FROM y, tab),
z AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM z WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
g AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM g),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM d a JOIN w b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM d a JOIN w b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
form AS (SELECT w.word, w.n, best.n_near, best.m AS form_n, (SELECT min(other) FROM near WHERE near.word = w.word AND near.m = best.m) AS form
  FROM w JOIN best ON best.word = w.word),
f AS (SELECT word, form, form_n FROM form WHERE form_n >= 10 * n),
chain AS (SELECT word, word AS node, 0 AS hop FROM w UNION ALL SELECT c.word, f.form, c.hop + 1 FROM chain c JOIN f ON f.word = c.node)
SELECT w.word, f.form, (SELECT arg_max(node, hop) FROM chain WHERE chain.word = w.word) AS root, w.n, coalesce(form.n_near, 0) AS n_near, f.form_n
FROM w LEFT JOIN form ON form.word = w.word LEFT JOIN f ON f.word = w.word
"""
