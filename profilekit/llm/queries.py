"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from profilekit.llm import bpe, chaining, cross_polytope, exact_substrings, licenses, ngram_ratio, packing, simhash, toxicity, weak_labels
from profilekit.llm.common import documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_substrings.op1(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_ratio.op2(documents(spark, sf_dir), _labels(spark, sf_dir))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.op3(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.op4(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op5(documents(spark, sf_dir), _labels(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.op6(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.op7(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op8(documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.op9(documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op10(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


#: Every 100-byte window by its place, the first place of each, and what other places cover.
OP1_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, s, md5(array_slice(b, s, s + 99)) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS s FROM d)),
f AS (SELECT h, min((doc_id, s)) AS first FROM w GROUP BY h HAVING count(*) > 1),
c AS (SELECT w.doc_id, w.s FROM w JOIN f ON w.h = f.h WHERE (w.doc_id, w.s) <> f.first),
g AS (SELECT doc_id, s, CASE WHEN s - 100 > lag(s) OVER (PARTITION BY doc_id ORDER BY s) THEN 1 WHEN lag(s) OVER (PARTITION BY doc_id ORDER BY s) IS NULL THEN 1 ELSE 0 END AS new FROM c),
r AS (SELECT doc_id, min(s) AS a, max(s) + 99 AS e FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM g) GROUP BY doc_id, k),
t AS (SELECT doc_id, sum(e - a + 1) AS n, count(*) AS k, list(a ORDER BY a) AS firsts, list(e ORDER BY a) AS ends FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans,
 sha256(CASE WHEN k IS NULL THEN b ELSE unhex(array_to_string(list_transform(range(0, k + 1), lambda i: hex(array_slice(b, CASE WHEN i = 0 THEN 1 ELSE ends[i] + 1 END, CASE WHEN i = k THEN octet_length(b) ELSE firsts[i + 1] - 1 END))), '')) END) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """What SQL can say: the others tokenise, hash with functions that SQL lacks, or learn from data."""
    return {"op1_suffix_dedup": OP1_SQL, "op10_license_scan": licenses.oracle()}
