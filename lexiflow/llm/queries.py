"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm import (conversation_repair, exact_dedup, fill_in_middle, lang_id, mixing, ngram_join, packing, quality_classifier, quality_rules,
                          substring_dedup, suffix_dedup, token_counts, warc)
from lexiflow.llm.common import UPPER, documents


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source is the site, its languages are the paths."""
    return quality_classifier.quality_classifier(
        documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.col("lang"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language_report(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_report(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_report(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pfair_mix(documents(spark, sf_dir)).select(
        "doc_id", "source", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_report(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(documents(spark, sf_dir))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.transformation_report(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_quality_classifier, op3_language_id, op4_exact_dedup, op5_token_counts,
    op6_ngram_join, op7_warc,
    op8_mix_sources, op9_substring_dedup, op10_quality_rules, op11_suffix_dedup,
    op12_fill_in_middle, op13_conversation_repair)}

OP4_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')) AS text_sha256
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

#: Whole-period EDF as a recursion over slots: state c = blocks that each source has had.
PFAIR_CTE = f"""
mix_n AS (SELECT coalesce(source, chr(0) || 'null') AS s, sqrt(count(*)::DOUBLE) AS v FROM mix_docs GROUP BY 1),
mix_w AS (SELECT s, greatest(1, floor({mixing.SLOTS} * v / (SELECT sum(v ORDER BY s) FROM mix_n) + 0.5)::BIGINT) AS p FROM mix_n),
mix_l AS (SELECT list(p ORDER BY s) AS p, sum(p)::BIGINT AS q, count(*)::BIGINT AS k FROM mix_w),
mix_i AS (SELECT s, p, row_number() OVER (ORDER BY s) AS i FROM mix_w),
mix_t(t, c, pick) AS (
  SELECT (-1)::BIGINT, list_transform(p, lambda x: 0::BIGINT), 0::BIGINT FROM mix_l
  UNION ALL
  SELECT t + 1, list_transform(range(1, k + 1), lambda i: c[i] + (i = g)::BIGINT), g
  FROM (SELECT t, c, k, q, list_min(list_transform(
          list_filter(range(1, k + 1), lambda i: (c[i] * q) // p[i] <= t + 1 AND c[i] < p[i]),
          lambda i: (((c[i] + 1) * q + p[i] - 1) // p[i]) * 1000000 + i)) % 1000000 AS g
        FROM mix_t, mix_l WHERE t + 1 < q)),
mix_s AS (SELECT pick AS i, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j, t FROM mix_t WHERE pick > 0),
mix_r AS (SELECT d.*, coalesce(d.source, chr(0) || 'null') AS s,
                 row_number() OVER (PARTITION BY coalesce(d.source, chr(0) || 'null')
                                    ORDER BY md5(coalesce(d.doc_id::VARCHAR, d.text, '')), d.doc_id) - 1 AS r
          FROM mix_docs d),
mix_b AS (SELECT *, r // {mixing.BLOCK_ROWS} AS b FROM mix_r),
mixed AS (SELECT b.*, m.p, l.q, (b // m.p) * l.q + x.t AS slot
          FROM mix_b b JOIN mix_i m ON m.s = b.s JOIN mix_s x ON x.i = m.i AND x.j = b.b % m.p, mix_l l)
"""

OP8_SQL = f"""
WITH RECURSIVE mix_docs AS (SELECT * FROM documents), {PFAIR_CTE}
SELECT doc_id, source, b AS mix_block, (b * q // p)::BIGINT AS mix_release,
       (((b + 1) * q + p - 1) // p)::BIGINT AS mix_deadline, slot::BIGINT AS mix_slot,
       (slot * {mixing.BLOCK_ROWS} + r % {mixing.BLOCK_ROWS})::BIGINT AS mix_position
FROM mixed
"""

ORACLES = {"op4_exact_dedup": OP4_SQL, "op8_mix_sources": OP8_SQL}
