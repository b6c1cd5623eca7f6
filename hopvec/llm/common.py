"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, stored

# A word: a maximal run of anything but space, tab, LF, VT, FF and CR.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id bigint, text string)`` of any frame; every other column is left behind, so
    extra columns cannot clash. A null text becomes the empty text."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names for internal use: each of ``wanted``, with underscores before it until ``df`` has no such
    column (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: Column | str) -> Column:
    """The words of a text, in order (no empty strings)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``max_rows`` labelled ids, chosen by hash of the id.

    A document with several labels takes the smallest. Null ids and null labels are left
    out. The chosen ids are broadcast: their number is bounded by ``max_rows``.
    """
    lab = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
           .where("doc_id is not null and label is not null")
           .groupBy("doc_id").agg(F.min("label").alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    return docs.join(F.broadcast(lab), "doc_id")


__all__ = ["SPACES", "WORD", "table", "documents", "free_names", "words", "labelled_sample", "checkpoint_dir", "stored"]
