"""Running totals within groups of any size.

Rows are range-partitioned by group and order, so one group may fill many partitions; a window runs within a group's
share of one partition only, and what the group's earlier partitions hold is added to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settled import settled

#: fold -> (aggregate, how two parts' results meet, the result of nothing).
FOLDS = {
    "sum": (F.sum, lambda a, b: a + b, 0),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b), 0),
}


def running(rows: DataFrame, by: list[str], order: list[str | Column], **totals: tuple[str, Column]) -> DataFrame:
    """The rows with ``name=(fold, column)`` added up in their group, from its first row to this one, as longs.

    fold: sum, or xor of bits; nulls add nothing. Rows that are equal in the order get any order among themselves, each its own total. A null
    group is a group of its own; an empty table stays empty; columns of any name are carried, one of a total's name is replaced.
    """
    groups, ranks = [f"by{i}" for i in range(len(by))], [f"rank{i}" for i in range(len(order))]
    folds = {f"v{i}": FOLDS[fold] for i, (fold, _) in enumerate(totals.values())}
    held = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *[F.col(f"`{c}`").alias(g) for c, g in zip(by, groups, strict=True)],
        *[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(r) for c, r in zip(order, ranks, strict=True)], *[column.cast("long").alias(v) for v, (_, column) in zip(folds, totals.values(), strict=True)])
    in_order = [F.col(r).asc_nulls_first() for r in ranks]
    # Written out once, so that every use below sees the same partitions.
    placed = settled(held.repartitionByRange(*groups, *in_order).withColumn("part", F.spark_partition_id()))
    parts = placed.groupBy(*groups, "part").agg(*[total(v).alias(v) for v, (total, _, _) in folds.items()])
    group = Window.partitionBy(*groups)
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spread = parts.withColumns({"parts": F.count("*").over(group)} | {f"before_{v}": total(v).over(before) for v, (total, _, _) in folds.items()}).where("parts > 1")
    # Each border between two partitions cuts one group at most, so these are fewer rows than twice the partitions.
    spread = spread.select(*[F.col(g).alias(f"of_{g}") for g in groups], F.col("part").alias("at"), *[f"before_{v}" for v in folds])
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in groups], F.col("part") == F.col("at"))
    within = Window.partitionBy(*groups, "part").orderBy(*in_order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({f"own_{v}": total(v).over(within) for v, (total, _, _) in folds.items()})
    joined = summed.join(F.broadcast(spread), same, "left")
    met = {name: meet(F.coalesce(f"own_{v}", F.lit(nothing).cast("long")), F.coalesce(f"before_{v}", F.lit(nothing).cast("long"))).alias(name) for name, (v, (_, meet, nothing)) in zip(totals, folds.items(), strict=True)}
    return joined.select(*[F.col("row").getField(c).alias(c) for c in rows.columns if c not in met], *met.values())
