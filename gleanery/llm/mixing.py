"""Mixing sources to target weights.

Every document gets a hash-random key. Keys are dealt into ``RANGES`` equal ranges of hash space within
each source, so that even a source that holds most rows is sorted in many tasks; range totals give each
range its offset, a running sum within the range gives each document its place in its source's random
order, and the source's word budget cuts that order exactly, after as many whole epochs as fit.

Defined results: a null text has size 0; null is a source of its own, after all others; documents of size
0 are never taken; rows that repeat are ordered by doc_id, size and text hash and each takes its own
share; an empty table gives an empty table; other columns are carried by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, durable, held_whole, let_go, n_words_of, table, text_of

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
SEED = "mix"
#: Hex digits of the key that name its range: 16 ** 3 ranges a source. Take more for sources of over 1e10 rows.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same and target: budget shared by weight, capped at ``max_epochs`` sizes.

    Sources reach their cap in the order of cap / weight. The sources capped are those whose ratio is no
    more than the level that the rest of the budget gives to the rest of the weights. One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = (F.row_number().over(order) - 1) % len(weights)
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumns({
        "_cap": F.col("source_size") * float(max_epochs),
        "_budget": F.sum("source_size").over(every) * share_percent / 100.0,
    })
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("_level", level).withColumn("_capped", F.col("_cap") <= F.col("_w") * F.col("_level"))
    rest = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0.0)).over(every)
    free = (F.col("_budget") - rest("_cap", F.col("_capped"))) / rest("_w", ~F.col("_capped"))
    return leveled.select("source", "source_size", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_w") * free).alias("target"))


def placed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, crc, key, range): what the mix needs of each document."""
    return docs.select(
        "doc_id", "source", n_words_of(text_of()).alias("size"), F.crc32(text_of()).alias("crc"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
    ).withColumn("range", F.substring("key", 1, RANGE_DIGITS))


def mix_shares(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, crc, size, source, source_size, target, taken): the words taken of each document, repeats counted."""
    rows = durable(placed(docs, seed), "mix")
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("_n"))
    sizes = ranges.groupBy("source").agg(F.sum("_n").alias("source_size"))
    ranges = ranges.withColumn("_before", F.sum("_n").over(Window.partitionBy("source").orderBy("range")) - F.col("_n"))
    targets = source_targets(sizes, weights, share_percent, max_epochs).withColumnRenamed("source", "_source")
    cut = durable(ranges.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_n").withColumnsRenamed({"source": "_source", "range": "_range"}), "cuts")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    ordered = rows.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = ordered.join(cut, F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range")))
    budget = F.floor("target").cast("long")
    epochs = F.coalesce(F.expr("try_divide(cast(floor(target) as long) - cast(floor(target) as long) % nullif(source_size, 0), source_size)"), F.lit(0)).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("_before") - F.col("_within")
    taken = epochs * F.col("size") + F.least(F.greatest(left, F.lit(0)), F.col("size"))
    return joined.select("doc_id", "crc", "size", "source", "source_size", "target", taken.cast("long").alias("taken"))


def _first_words(text: Column, n: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row once for every epoch that takes it, the one at the cut down to the words taken."""
    shares = mix_shares(docs, **options).where("taken > 0").select(F.col("doc_id").alias("_id"), F.col("crc").alias("_crc"), F.col("source").alias("_src"), "size", "taken")
    shares = shares.groupBy("_id", "_crc", "_src", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("_rows"))
    rows = held_whole(docs, _doc=F.col("doc_id"), _text_crc=F.crc32(text_of()), _source=F.col("source"), _text=F.col("text"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text_crc") == F.col("_crc")) & F.col("_source").eqNullSafe(F.col("_src"))
    per_row = F.ceil(F.col("taken") / F.col("_rows")).cast("long")
    epochs = F.ceil(per_row / F.col("size")).cast("int")
    copies = rows.join(shares, same).withColumn("_n", per_row).withColumn("_epoch", F.explode(F.sequence(F.lit(1), epochs)))
    words = F.least(F.col("size"), F.col("_n") - F.col("size") * (F.col("_epoch") - 1))
    text = F.when(words < F.col("size"), _first_words(F.col("_text"), words)).otherwise(F.col("_text"))
    return let_go(copies, docs.columns, text=text)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_shares(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('{SEED}' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n FROM d GROUP BY source),
w AS (SELECT source, n, 2 * n AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 1.5 * sum(n) OVER () AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, n::BIGINT AS source_size, CASE WHEN cap <= w * level THEN cap ELSE w * (budget - sum(CASE WHEN cap <= w * level THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN cap <= w * level THEN 0 ELSE w END) OVER () END AS target FROM l),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (coalesce(floor(target)::BIGINT // nullif(source_size, 0), 0) * size + least(greatest(floor(target)::BIGINT - coalesce(floor(target)::BIGINT // nullif(source_size, 0), 0) * source_size - pos, 0), size))::BIGINT AS taken
FROM o
"""
