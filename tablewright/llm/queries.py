"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .language_id import language_id
from .lm_scoring import lm_score
from .mixing import mix_sources
from .near_dedup import near_dedup
from .packing import pack
from .quality_classifier import quality_classifier
from .quality_rules import CLASSES, COMMON, quality_rules
from .substring_dedup import substring_dedup
from .token_counts import document_token_counts
from .topk import top_k

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH rows_ AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op6_sql() -> str:
    lists = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in COMMON.items())
    classes = ", ".join(f"length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')) AS {c}" for c, p in CLASSES.items())
    counts = "[" + ", ".join([*CLASSES, "c_rest"]) + "]"
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({", ".join(f"'{k}'" for k in COMMON)}) THEN lang ELSE '*' END AS ref FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, ' ' || regexp_replace(lower(t), '[^\p{{L}}]+', '  ', 'g') || ' ' AS s,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, {classes}
  FROM t
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
), repeats AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE n > 1) GROUP BY doc_id
), f AS (
  SELECT w.doc_id, ref, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, {", ".join(CLASSES)},
    greatest(length(array_to_string(w, '')) - ({" + ".join(CLASSES)}), 0) AS c_rest,
    list_transform(CASE ref {lists} ELSE [] END, lambda x: (strlen(s) - strlen(replace(s, ' ' || x || ' ', ''))) // (strlen(x) + 2)) AS common
  FROM w LEFT JOIN repeats r ON r.doc_id = w.doc_id
), g AS (
  SELECT *, {counts} AS c, list_append(CASE WHEN ref = '*' THEN list_transform(range(12), lambda x: 0) ELSE common END, greatest(n_words - coalesce(list_sum(common), 0), 0)) AS v FROM f
), sums AS (
  SELECT ref, list_transform(range(1, 7), lambda i: list_sum(list_transform(list(c), lambda x: x[i]))) AS c, list_transform(range(1, 14), lambda i: list_sum(list_transform(list(v), lambda x: x[i]))) AS v
  FROM g GROUP BY ref
), refs AS (
  SELECT ref, list_transform(c, lambda x: (x + 1) / (list_sum(c) + 6)) AS qc, list_transform(v, lambda x: (x + 1) / (list_sum(v) + 13)) AS qv FROM sums
), p AS (
  SELECT g.*, qc, qv, list_transform(c, lambda x: x / list_sum(c)) AS pc, list_transform(v, lambda x: x / greatest(n_words, list_sum(v) - v[13])) AS pv FROM g JOIN refs USING (ref)
), d AS (
  SELECT *, CASE WHEN list_sum(c) >= 200 THEN sqrt(greatest(list_sum(list_transform(list_zip(pc, qc), lambda z:
      (CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END) + z[2] * log2(2 * z[2] / (z[1] + z[2])))) / 2, 0)) ELSE 0 END AS dc,
    CASE WHEN n_words >= 50 AND ref <> '*' THEN sqrt(greatest(list_sum(list_transform(list_zip(pv, qv), lambda z:
      (CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END) + z[2] * log2(2 * z[2] / (z[1] + z[2])))) / 2, 0)) ELSE 0 END AS dw,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND dc <= 0.3 AND dw <= 0.26 AS kept FROM d
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(_documents(spark, sf_dir), keep_columns=False, digest=True, factors=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP7_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS body FROM starts
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later
), per_word AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM words
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.j) AS body, count(*) AS n
  FROM per_word p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.j = g.j WHERE g.j IS NULL GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.body, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_counts(_documents(spark, sf_dir))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_documents(spark, sf_dir))


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT c.x, c.y FROM (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
  ) c JOIN sizes p ON p.doc_id = c.x JOIN sizes q ON q.doc_id = c.y
  WHERE 100 * c.k >= 80 * (p.n + q.n - c.k)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.y FROM reach r JOIN links l ON l.x = r.b
), labels AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_topk": op2_topk,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_token_counts": op9_token_counts,
    "op10_near_dedup": op10_near_dedup,
}

ORACLES: dict[str, str] = {
    "op2_topk": OP2_SQL,
    "op6_quality_rules": _op6_sql(),
    "op7_substring_dedup": OP7_SQL,
    "op10_near_dedup": OP10_SQL,
}
