"""A corpus pipeline: toxic documents go, duplicate lines go, one document of each near-duplicate group stays, sources are mixed, and what is left is packed.

Each stage is a function of the session, the documents its predecessor kept, and the folder of the tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm._common import SPACES, fresh, materialize
from llm.best_fit_packing import pack
from llm.line_dedup import dedup_lines
from llm.mixture_sampling import mix
from llm.simhash_golay import drop_near_duplicates
from llm.toxicity import drop_toxic, fit, held_out

#: SQL can't express these stages; tests hold them against plain versions.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold stay. Labels of the held-out fifth aren't learnt from.

    Null and empty texts have the score of a text without evidence, and very long ones are scored whole. Equal texts are treated alike, repeated rows stay together, and an empty table gives
    no rows. Columns stay, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    return drop_toxic(docs, fit(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Duplicate lines go, and ``n_chars`` is counted anew. A document goes if all that had words in it went.

    Null and empty texts have no lines with words and stay as they are. Of equal lines that of the smallest id stays, null ids last; rows that repeat id and text are treated alike. An empty
    table gives no rows. Columns stay, whatever their names.
    """
    lines, removed = fresh(docs, "lines", "removed")
    named = docs.withColumnsRenamed({c: n for c, n in (("n_lines", lines), ("n_removed", removed)) if c in docs.columns})
    cleaned = dedup_lines(named)
    left = F.length(F.translate(F.coalesce("text", F.lit("")), SPACES, "")) > 0
    kept = cleaned.where(left | (F.col("n_removed") == 0))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.drop("n_lines", "n_removed").withColumnsRenamed({lines: "n_lines", removed: "n_removed"}).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a Jaccard similarity of 0.8 or more over five-word shingles that of the smallest id stays, null last.

    Texts without words, null included, are alike. Texts under one id, or without an id, are judged each by itself; rows that repeat id and text are one document, of which one
    row stays. An empty table gives no rows. Columns stay, whatever their names.
    """
    return drop_near_duplicates(docs, shingle=5, similar=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, or one to three rows each.

    Null and empty texts have no words and may be taken up to three times; a null source is the last one. Rows that repeat id and text are taken alike, as often as the one of them that is
    taken most. An empty table gives no rows. Columns stay, whatever their names.
    """
    ident, print_of, copies = fresh(docs, "id", "print", "copies")
    slim = docs.select(F.struct("doc_id", F.xxhash64("text").alias("print")).alias("doc_id"), "text", "source")
    taken = mix(slim).where("copies > 0").groupBy(F.col("id.doc_id").alias(ident), F.col("id.print").alias(print_of)).agg(F.max("copies").alias(copies))
    kept = docs.join(taken, (F.xxhash64(docs["text"]) == F.col(print_of)) & docs["doc_id"].eqNullSafe(F.col(ident)))
    return kept.withColumn(print_of, F.explode(F.sequence(F.lit(1), copies))).select(*(F.col(f"`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens.

    A null or empty text is the end id alone, and a longer text has several pieces. Rows are packed each on its own, repeated ones and null ids too. An empty table gives no rows. Columns other than
    ``doc_id`` and ``text`` aren't in the result.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if stage is packing else materialize(docs, name)
    return docs
