"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage works on all that the one before kept and tolerates null, empty and very long texts,
repeated rows, empty tables and further columns (they pass through; those that clash with a
stage's own are replaced). All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontam, line_dedup, near_dup, pieces, toxicity
from trackloom.llm.common import read_table, store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sentence model of ``labels`` scores as toxic go."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines in many documents stay in the document of the largest id alone."""
    return line_dedup.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest id."""
    return near_dup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ``benchmark`` go."""
    return decontam.remove_documents(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding gives the text back."""
    done = pieces.decode(pieces.encode(docs))
    return done.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens",
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


STAGES = [("toxicity", drop_toxic), ("lines", dedup_lines), ("near_duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("pieces", encode)]
#: The weights of the toxicity model have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
