"""The registered queries of this subpackage: thin, production parameters, whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontam_lsi, lang_fusion, license_rules, line_join, merkle_manifest, pii_bootstrap, quality_fm, quality_rules, sentencepiece_bpe,
               shingle_product, simhash_golay, spelling_variants, warc)
from . import oracle as O
from .common import checkpoint_dir, documents, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(table(spark, sf_dir, "documents"))


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_fm.score(docs, quality_fm.fit(docs, table(spark, sf_dir, "labels")))


def op2_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_golay.simhash_groups(_docs(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op3_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_bootstrap.find_pii(_docs(spark, sf_dir))
    n = {f"n_{k}": F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)") for k in pii_bootstrap.KINDS}
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *[c.alias(k) for k, c in n.items()],
                        F.sha2(pii_bootstrap.spans_text(F.col("base")), 256).alias("base_sha256"),
                        pii_bootstrap.spans_text(every).alias("spans"))


def op4_decontam_lsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return decontam_lsi.contaminated(docs, decontam_lsi.fit(docs, table(spark, sf_dir, "benchmark")))


def op5_lang_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_fusion.identify(table(spark, sf_dir, "pages"), lang_fusion.fit_text_model(table(spark, sf_dir, "documents")))


def op6_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(warc.plan_records(table(spark, sf_dir, "pages")), path)
    return warc.page_records(warc.read_warc(spark, path))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return quality_rules.quality_rules(docs, quality_rules.fit_rules(docs, table(spark, sf_dir, "labels")))


def op8_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_join.dedup_lines(_docs(spark, sf_dir), min_words=1).select("doc_id", "text", F.col("_removed").cast("bigint").alias("n_removed"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_bpe.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_bpe.digests(sentencepiece_bpe.encode_decode(_docs(spark, sf_dir), model))


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan(_docs(spark, sf_dir), license_rules.Rules(spark))


def op11_shingle_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_product.jaccard_groups(_docs(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    picked = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return merkle_manifest.manifest(docs, altered={"text": lowered}, where=picked)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(_docs(spark, sf_dir), damage=spelling_variants.DAMAGE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_fm, op2_simhash_golay, op3_pii_bootstrap, op4_decontam_lsi, op5_lang_fusion, op6_warc_chain,
                                       op7_quality_rules, op8_line_join, op9_sentencepiece, op10_license_rules, op11_shingle_product, op12_merkle_manifest, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL can express the result; the others have brute-force tests."""
    return {"op6_warc_chain": OP6, "op11_shingle_product": O.shingle_product(), "op12_merkle_manifest": O.merkle_manifest(), "op13_spelling_variants": O.spelling_variants()}


OP6 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (1 + ((CAST('0x' || substr(hex, (1 + 5 * (i // 4))::INT, 5) AS BIGINT) >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1) for i in range(32)], '') AS payload_digest,
    min(page_id) OVER (PARTITION BY payload) AS first
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
