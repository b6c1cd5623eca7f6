"""The corpus pipeline: five stages over ``documents``, each calling one operator of ``hopvec.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``; all but the last
return its columns. ``run`` writes each stage's result as Parquet into the session's shared folder
and reads it again for the next one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopvec.llm import decontam_lsi, line_join, quality_rules, sentencepiece_bpe, simhash_golay
from hopvec.llm.common import checkpoint_dir, documents, free_names, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go."""
    rules = quality_rules.fit_rules(documents(docs), table(spark, sf_dir, "labels"))
    verdict, = free_names(docs, "_quality")
    return quality_rules.with_verdict(docs, rules, out=verdict).where(F.col(verdict)["kept"]).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; ``n_chars`` follows the text."""
    out = line_join.dedup_lines(docs, min_words=1)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays (``keep_first``: by id and text)."""
    groups = simhash_golay.simhash_groups(documents(docs), simhash_golay.SHINGLE, simhash_golay.MAX_BITS)
    return simhash_golay.keep_first(docs, groups).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    finders = decontam_lsi.fit(documents(docs), table(spark, sf_dir, "benchmark"))
    found, = free_names(docs, "_found")
    return docs.withColumn(found, decontam_lsi.found_in(docs, finders, F.col("text"))).where(F.size(found) == 0).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ends and the decoded text's digest of every document left."""
    model = sentencepiece_bpe.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    coded = sentencepiece_bpe.encode_decode(documents(docs), model)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "ends", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("simhash_near_dedup", simhash_stage),
          ("benchmark_decontamination", decontamination_stage), ("sentencepiece", encoding_stage)]

# No stage but the base rule can be written in SQL (learned rules, XXH64, SVD, tokenizer).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
