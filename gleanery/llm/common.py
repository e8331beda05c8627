"""What the training-data operators share: words, tables and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evenly(df: DataFrame) -> DataFrame:
    """Dealt out over all cores if the input has fewer splits than there are, as one small file has; a table of many splits stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_of(name: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def held_whole(docs: DataFrame, **needed: Column) -> DataFrame:
    """Each row as one struct column ``_row`` beside the columns needed, so that no other column's name can clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), *[v.alias(k) for k, v in needed.items()])


def let_go(rows: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The columns of ``_row`` again, some of them replaced, others added."""
    return rows.select(*[replaced[c].alias(c) if c in replaced else F.col("_row").getField(c).alias(c) for c in columns], *[v.alias(c) for c, v in replaced.items() if c not in columns])


def fold(text: Column) -> Column:
    """Lower-case A-Z alone, so that other letters keep their bytes."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where none is named, a session with a local master, as in tests, gets a temporary one; on a cluster that is an error,
    as no machine's own folder is seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="gleanery-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def drawn(rows: DataFrame, key: Column, about: int) -> DataFrame:
    """About ``about`` of the rows, all of them if there are fewer: those whose key's hash lies below a threshold.

    The threshold follows from a count, so what comes of it doesn't grow with the rows or their partitions.
    """
    n = rows.count()
    scale = 1 << 40
    return rows if n <= about else rows.where(F.pmod(F.xxhash64(F.lit("draw"), key), F.lit(scale)) < about * scale // n)


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table outlives lost executors, cuts the lineage and carries its true size, so that
    Spark's own size check decides about broadcasting it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
