"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing and piece encoding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), where docs is what the stage before
it kept, written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import linededup, mixing, neardup, pieces, quality
from gleanery.llm.common import n_words_of, shared_dir, table, text_of


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules keep.

    Null and empty texts fail the base rules and go; equal and repeated rows are judged alike; null languages and
    sources are groups of their own; other columns are carried; an empty table stays empty.
    """
    return quality.apply_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line stands for; n_chars follows the text.

    A document that loses lines and is left with fewer than ``quality.LEAST_WORDS`` words is a fragment of what earlier documents hold, and
    goes, as the base rules would have it. The earliest of equal lines stays; null doc_ids come first; rows that are
    equal in every column but come twice are told apart by nothing, so both lose what an earlier line stands for; a
    document that loses no line stays whatever its size; an empty table stays empty.
    """
    out = linededup.dedup_lines(docs, lost="_lost")
    whole = (F.col("_lost") <= 0) | (n_words_of(text_of()) >= quality.LEAST_WORDS)
    out = out.where(whole).drop("_lost")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; texts without words and null doc_ids stay; of rows that share that doc_id all stay."""
    return neardup.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once for each epoch that takes them, the one at a source's cut with fewer words; n_chars follows the text.

    Null and empty texts have no size and are never taken; null is a source of its own; rows that repeat take equal shares.
    """
    out = mixing.mix(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the piece ids and their number, for each row; both null for a null text, no ids for an empty one."""
    return pieces.encode(docs).select("doc_id", "lang", "source", "ids", F.when(F.col("ids").isNotNull(), F.size("ids").cast("long")).alias("n_ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: Near-dedup and encoding can't be told in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
