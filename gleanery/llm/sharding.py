"""Sharding by sampled splitters, so that shards hold nearly equal bytes and equal texts lie near each other.

A size-weighted sample of range keys gives the splitters of ``RANGES`` ranges; every record is dealt to
its range, and a range that came out overfull, such as one that holds a large group of equal texts, is
subdivided by a hash of the doc_id. Running sums within the (sub)ranges and the ranges' totals place each
record in one global order, which is cut where a shard's share of the bytes is reached. The cut is by bytes alone, so a
group of equal texts may straddle two shards, and one that holds more than a shard's share fills several.

Defined results: a null text has size 1 and a null checksum and sorts as an empty text; repeated rows each
get a slot of their own; an empty table gives an empty table; a document larger than a shard's share leaves
the shards that it covers wholly without rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table, text_of

SHARDS = 16
RANGES = 1024
#: Keys drawn for the splitters, on average; this bounds what the driver receives.
SAMPLE = 16_384


def splitters(records: DataFrame, ranges: int = RANGES, sample: int = SAMPLE) -> tuple[list[int], int]:
    """Quantile boundaries of a size-weighted sample of the range keys, and the bytes in all.

    A record is drawn with a chance in proportion to its size, by a hash of its doc_id and its place in the input, so many rows of one doc_id are drawn apart.
    """
    total = records.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [], 0
    chance = F.pmod(F.xxhash64(F.lit("draw"), F.col("doc_id"), F.col("row")), F.lit(1 << 30)) / float(1 << 30)
    drawn = records.where(chance < F.col("size") * (sample / total)).groupBy("text_crc32").agg(F.count("*").alias("n"))
    rows = sorted((r[0] or 0, r[1]) for r in drawn.collect())
    if not rows:
        return [], total
    keys, upto = np.array([k for k, _ in rows]), np.cumsum([n for _, n in rows])
    at = np.searchsorted(upto, np.arange(1, ranges) * (upto[-1] / ranges), side="left")
    return sorted({int(keys[i]) for i in at}), int(total)


def shard_records(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of (doc_id, text)."""
    records = durable(docs.select(
        "doc_id", (F.octet_length(text_of()) + F.lit(1)).cast("long").alias("size"), F.crc32(F.col("text")).alias("text_crc32"), F.xxhash64(text_of()).alias("hash"),
        # Tells rows apart that share everything; written once, so it stays.
        F.monotonically_increasing_id().alias("row"),
    ), "records")
    bounds, total = splitters(records, ranges)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, dtype=np.int64), key.to_numpy(), side="left").astype("int32"))

    dealt = records.withColumn("range", range_of(F.coalesce("text_crc32", F.lit(0)).cast("long")))
    full = dealt.groupBy("range").agg(F.sum("size").alias("_bytes"))
    # A range is overfull beyond twice its even share; it is dealt into parts of about that share.
    parts = durable(full.select(F.col("range").alias("_range"), F.when(F.col("_bytes") > 2 * total / ranges, F.ceil(F.col("_bytes") * ranges / max(total, 1))).otherwise(1).cast("int").alias("_parts")), "ranges")
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id"), F.col("row")), F.col("_parts")).cast("int")
    # One row a range: at most RANGES rows, which bounds the broadcast.
    split = durable(dealt.join(F.broadcast(parts), F.col("range") == F.col("_range")).select("doc_id", "size", "text_crc32", "hash", "row", "range", part.alias("part")), "split")
    order = Window.partitionBy("range", "part").orderBy(F.coalesce("text_crc32", F.lit(0)), "hash", "doc_id", "row")
    every = split.groupBy("range", "part").agg(F.sum("size").alias("_n"))
    starts = every.select(F.col("range").alias("_range"), F.col("part").alias("_part"), (F.sum("_n").over(Window.orderBy("range", "part")) - F.col("_n")).alias("_start"))
    placed = split.withColumn("_within", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(starts, (F.col("range") == F.col("_range")) & (F.col("part") == F.col("_part"))).drop("_range", "_part")
    middle = 2 * (F.col("_start") + F.col("_within")) + F.col("size")
    cut = durable(placed.withColumn("shard", F.least(F.floor(middle * shards / (2.0 * max(total, 1))), F.lit(shards - 1)).cast("int")).drop("_start", "_within"), "placed")
    counts = cut.groupBy("shard", "range", "part").agg(F.count("*").alias("_rows"))
    before = counts.select(F.col("shard").alias("_shard"), F.col("range").alias("_range"), F.col("part").alias("_part"), (F.sum("_rows").over(Window.partitionBy("shard").orderBy("range", "part")) - F.col("_rows")).alias("_before"))
    again = Window.partitionBy("range", "part", "shard").orderBy(F.coalesce("text_crc32", F.lit(0)), "hash", "doc_id", "row")
    slotted = cut.withColumn("_row", F.row_number().over(again)).join(before, (F.col("shard") == F.col("_shard")) & (F.col("range") == F.col("_range")) & (F.col("part") == F.col("_part")))
    return slotted.select("doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_row") - 1).cast("long").alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
