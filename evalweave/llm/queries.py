"""The queries that apply the operators of this subpackage to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm import exact, langid, media, neardup, packing, pieces, quality, simple8b, substring, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; every machine has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir), words=3, percent=85, bands=32, rows=6)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op4_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.token_file(_documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))[0]


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_digests(_documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_documents(_documents(spark, sf_dir), _labels(spark, sf_dir))
    return found.withColumn("passages", F.size("passages").cast("long"))


def op8_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score_documents(_documents(spark, sf_dir), _labels(spark, sf_dir))
    return found.select("doc_id", "held_out", "score", "predicted")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_documents(spark, sf_dir))[0]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_language, op2_near_duplicates, op3_sentencepiece, op4_simple8b, op5_substring, op6_packing, op7_toxicity, op8_exact_duplicates, op9_quality, op10_media)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 1, 2))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 85 * (na.n + nb.n - x)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, label) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node WHERE r.label < e.b),
c AS (SELECT node, min(label) AS label FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.label, d.doc_id) AS component_id, coalesce(c.label, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""

OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w[p] AS word, p, CASE WHEN p + 49 <= len(w) THEN array_to_string(w[p : p + 49], ' ') END AS k FROM w, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p)),
d AS (SELECT doc_id, word, p, CASE WHEN k IS NOT NULL THEN (min(doc_id) OVER (PARTITION BY k) < doc_id)::INT ELSE 0 END AS dup FROM i),
c AS (SELECT doc_id, word, p, max(dup) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM d),
g AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (gone = 0), '')) AS kept_sha256 FROM c GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id)
"""

OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS k FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_duplicates": OP2_SQL, "op5_substring": OP5_SQL, "op8_exact_duplicates": OP8_SQL}
