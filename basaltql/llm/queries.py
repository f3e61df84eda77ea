"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basaltql.llm import bpe, chat, decontam, langid, license_scan, merkle, neardup, quality, substring, toxicity
from basaltql.llm.common import table


def vocabulary() -> tuple[str, str]:
    """(path of the rank file, pattern) of the public tokenizer; the file is never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *vocabulary())


def op2_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(spark, table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, table(spark, sf_dir, "documents"), width=4)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_byte_bpe, op2_merkle, op3_minhash_dedup, op4_decontaminate, op5_toxicity, op6_license_scan, op7_chat_format, op8_quality, op9_language_id, op10_substring_dedup)
}

_CONTAINED = r"""
WITH words AS (
  SELECT doc_id AS id, row_number() OVER () AS r, false AS item, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT item_id, 0, true, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') FROM benchmark WHERE item_id IS NOT NULL),
shingles AS (
  SELECT DISTINCT id, r, item, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS s
  FROM (SELECT id, r, item, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
sizes AS (SELECT id AS item_id, count(*) AS n_item FROM shingles WHERE item GROUP BY id),
counted AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n
  FROM shingles d JOIN shingles b ON d.s = b.s AND b.item AND NOT d.item GROUP BY d.id, d.r, b.id),
shared AS (SELECT doc_id, item_id, max(n) AS n_shared FROM counted GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM shared JOIN sizes USING (item_id)
WHERE 100 * n_shared >= 80 * n_item
"""

SQL: dict[str, str] = {"op4_decontaminate": _CONTAINED, "op7_chat_format": chat.SQL}
