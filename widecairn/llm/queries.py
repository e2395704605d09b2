"""The corpus operators as queries: thin functions of (spark, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tokenizer's model file.
TOKENIZER = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_bytes(name: str = TOKENIZER) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in a mixture by the square root of its source's size."""
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"), keep=False).select("doc_id", "source", "_mix.*")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document, by five-word shingles with a Jaccard similarity of at least 0.8."""
    from .jaccard_join import similarity_classes

    return similarity_classes(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document that an earlier one holds too, as a similar line or within the same run of words."""
    from .substring_dedup import repeated_spans

    return repeated_spans(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the kinds of toxicity and of the mark, and the decision, of every document; learnt from labels.toxic."""
    from .toxicity import fit_on, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit_on(docs, _table(spark, sf_dir, "labels")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learnt from labels.quality of rows that are not held out."""
    from .quality_fm import fit_on, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit_on(docs, _table(spark, sf_dir, "labels")))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    from .fingerprint import edited_pairs

    return edited_pairs(_table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of good quality and not toxic; background: all documents."""
    from .lm_score import fit, score

    docs = _table(spark, sf_dir, "documents")
    target = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    out = score(docs, target, *fit(docs, target))
    # To nine places, in which sums don't depend on their order.
    return out.select("doc_id", "n_tokens", *[F.round(c, 9).alias(c) for c in ("loss_background", "loss_target", "score")])


def fingerprint_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5_fingerprint that SQL can express."""
    return op5_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8_pii that SQL can express."""
    return op8_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document; base spans are counted and digested apart."""
    from .pii import find_pii

    return find_pii(_table(spark, sf_dir, "documents"), with_output=False)


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 100, found in graphs of all vectors."""
    from .hnsw import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of ids, and digests of the ids and of the decoded text, of every document."""
    from .sentencepiece_bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), tokenizer_bytes(), with_output=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_toxicity": op4_toxicity,
        "op5_fingerprint": op5_fingerprint,
        "op6_quality": op6_quality,
        "op7_lm_score": op7_lm_score,
        "op8_pii": op8_pii,
        "op9_hnsw": op9_hnsw,
        "op10_sentencepiece": op10_sentencepiece,
        "fingerprint_texts": fingerprint_texts,
        "pii_base_spans": pii_base_spans,
    }


#: Copies, links and classes by brute force over all pairs of documents that share a shingle.
JACCARD_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END)) AS s FROM words
), flat AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS c FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE c >= 0.8 * (n + m - c) - 1e-9),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
copies AS (SELECT x.doc_id, min(y.doc_id) AS copy_id, count(*) AS n_copies FROM sets x JOIN sets y ON x.s = y.s AND (len(x.s) > 0 OR x.doc_id = y.doc_id) GROUP BY x.doc_id)
SELECT doc_id, (SELECT min(b) FROM reach WHERE a = doc_id) AS class_id, copy_id, n_copies,
  (SELECT count(*) FROM links WHERE a = doc_id) AS n_links FROM copies
"""

#: Exact neighbours: what the graphs' answers are measured against, and equal on small tables.
NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda k: (q.e[k] - c.e[k]) * (q.e[k] - c.e[k])))) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM d QUALIFY rank <= 10
"""

#: One period slot by slot: of the sources whose next block is released, the one with the earliest deadline; then all blocks by arithmetic.
MIXING_SQL = """
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n, sqrt(count(*)) AS p FROM documents GROUP BY source
), given AS (
  SELECT source, n, CAST(greatest(1, floor((SELECT greatest(1000, 20 * count(*)) FROM counts) * p / (SELECT sum(p) FROM counts) + 0.5)) AS BIGINT) AS a,
    CAST(row_number() OVER (ORDER BY source NULLS FIRST) AS BIGINT) AS s FROM counts
), src AS (SELECT source, n, s, a // (SELECT list_reduce(list(a), lambda x, y: gcd(x, y)) FROM given) AS a FROM given),
lists AS (SELECT list(a ORDER BY s) AS a, CAST(sum(a) AS BIGINT) AS d FROM src),
walk(t, had, s, i) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(a, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM lists
  UNION ALL
  SELECT t + 1, list_transform(had, lambda h, k: CASE WHEN k = pick THEN h + 1 ELSE h END), pick, had[pick] FROM (
    SELECT w.t, w.had, list_min(list_transform(list_filter(range(1, len(z.a) + 1), lambda k: (w.had[k] * z.d) // z.a[k] <= w.t + 1),
      lambda k: {'d': ((w.had[k] + 1) * z.d + z.a[k] - 1) // z.a[k], 'k': CAST(k AS BIGINT)})).k AS pick
    FROM walk w, lists z WHERE w.t + 1 < z.d)
), numbered AS (
  SELECT doc_id, d.source, src.s, src.a, row_number() OVER (PARTITION BY d.source ORDER BY ('0x' || substr(h, 1, 8))::BIGINT % CAST(ceil(src.n / 100.0) AS BIGINT), h, doc_id) - 1 AS n
  FROM (SELECT doc_id, source, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents) d JOIN src ON src.source IS NOT DISTINCT FROM d.source
), blocks AS (SELECT *, n // 8 AS block, (SELECT d FROM lists) AS d FROM numbered)
SELECT doc_id, source, block, (block * d) // a AS release, ((block + 1) * d + a - 1) // a AS deadline, block // a * d + t AS slot, (block // a * d + t) * 8 + n % 8 AS position
FROM blocks JOIN walk ON walk.s = blocks.s AND walk.i = block % a AND t >= 0
"""


#: Both models by counting words and pairs of words, and the losses without each document's own counts. The end of a text is the word ''.
LM_SQL = """
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') || [''] AS w,
    CAST(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) AS INTEGER) AS target FROM documents
), tokens AS (
  SELECT doc_id, target, len(w) AS n, unnest(list_transform(range(1, len(w) + 1), lambda k: {'a': CASE WHEN k = 1 THEN '' ELSE w[k - 1] END, 'b': w[k]})) AS p FROM docs
), own2 AS (SELECT doc_id, target, n, p.a AS a, p.b AS b, count(*) AS k FROM tokens GROUP BY ALL),
own1 AS (SELECT doc_id, target, b, sum(k) AS k FROM own2 GROUP BY ALL),
all2 AS (SELECT a, b, sum(k) AS k, sum(k * target) AS t FROM own2 GROUP BY ALL),
all1 AS (SELECT b, sum(k) AS k, sum(k * target) AS t FROM own1 GROUP BY ALL),
total AS (SELECT sum(k) AS k, sum(t) AS t, count(*) + 1 AS size FROM all1),
losses AS (
  SELECT o.doc_id, o.n, o.k,
    ln(0.6 * (p.k - o.k) / greatest(c.k - x.k, 1) + 0.4 * (s.k - y.k + 0.5) / (g.k - o.n + 0.5 * g.size)) AS l0,
    ln(0.6 * (p.t - o.k * o.target) / greatest(c.t - x.k * o.target, 1) + 0.4 * (s.t - y.k * o.target + 0.5) / (g.t - o.n * o.target + 0.5 * g.size)) AS l1
  FROM own2 o JOIN all2 p USING (a, b) JOIN all1 c ON c.b = o.a JOIN all1 s ON s.b = o.b
  JOIN own1 x ON x.doc_id = o.doc_id AND x.b = o.a JOIN own1 y ON y.doc_id = o.doc_id AND y.b = o.b, total g
), means AS (SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, -CAST(sum(k * l0) AS DOUBLE) / n AS u, -CAST(sum(k * l1) AS DOUBLE) / n AS v FROM losses GROUP BY doc_id, n)
SELECT doc_id, n_tokens, round(u, 9) AS loss_background, round(v, 9) AS loss_target, round(v - u, 9) AS score FROM means
"""


#: The texts that are fingerprinted, without the fingerprints.
EDITED_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
d AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nxt FROM t)
SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 2) || left(nxt, length(t) // 2)) AS edited_sha256 FROM d
"""

#: The base spans: matches are marked in the text, their places follow from the lengths of what lies between the marks.
BASE_SQL = r"""
WITH rules(kind, name) AS (VALUES (0, 'email'), (1, 'ip'), (2, 'card'), (3, 'phone')),
split AS (
  SELECT doc_id, kind, name, string_split(CASE kind
    WHEN 0 THEN regexp_replace(t, '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+)', chr(1) || '\1' || chr(2), 'g')
    WHEN 1 THEN regexp_replace(t, '([0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+))', chr(1) || '\1' || chr(2), 'g')
    WHEN 2 THEN regexp_replace(t, '([0-9]([\x20-]?[0-9])+)', chr(1) || '\1' || chr(2), 'g')
    ELSE regexp_replace(t, '(\+[0-9][\x20().0-9-]+[0-9])', chr(1) || '\1' || chr(2), 'g') END, chr(1)) AS parts
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), rules
), pieces AS (
  SELECT doc_id, kind, name, unnest(list_transform(range(2, len(parts) + 1), lambda k: {'s': string_split(parts[k], chr(2))[1],
    'before': list_sum(list_transform(parts[1:k - 1], lambda p: length(p))) - (k - 2)})) AS m FROM split
), found AS (
  SELECT doc_id, kind, name, m.s AS s, CAST(m.before AS BIGINT) AS start, CAST(m.before + length(m.s) AS BIGINT) AS stop, regexp_replace(m.s, '[^0-9]', '', 'g') AS digits FROM pieces
), base AS (
  SELECT * FROM found WHERE CASE kind WHEN 0 THEN true
    WHEN 1 THEN len(list_filter(string_split(s, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0
    WHEN 2 THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda k:
      CASE WHEN k % 2 = 1 THEN CAST(digits[-k] AS INT) ELSE 2 * CAST(digits[-k] AS INT) - CASE WHEN CAST(digits[-k] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    ELSE length(digits) BETWEEN 9 AND 15 END
)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
  sha256(coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind), '')) AS base_sha256
FROM documents d LEFT JOIN base b ON b.doc_id = d.doc_id GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": MIXING_SQL, "op2_jaccard_join": JACCARD_SQL, "op7_lm_score": LM_SQL, "op9_hnsw": NEAREST_SQL, "fingerprint_texts": EDITED_SQL, "pii_base_spans": BASE_SQL}
