import random

import pytest

from gleanery.operators import running


@pytest.mark.parametrize("parts", ["2", "13"])
def test_running_totals_are_brute_force(spark, parts):
    """A group of most rows over many partitions, null groups and values, ties, and columns of any name."""
    rng = random.Random(6)
    rows = [(1 if rng.random() < 0.6 else rng.choice([None, 2, 3, -5]), i if rng.random() < 0.9 else None, rng.choice([None, rng.randint(-9, 9)]), i) for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame(rows, "g long, at long, v long, _part long").repartition(5)
        got = {r["_part"]: (r.total, r.bits, r.n) for r in running.running(table, ["g"], ["at", "_part"], total=("sum", table.v), bits=("xor", table.v), n=("sum", table["_part"] * 0 + 1)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, state = {}, {}
    for g, at, v, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[3])):
        total, bits, n = state.get(g, (0, 0, 0))
        state[g] = want[i] = (total + (v or 0), bits ^ (v or 0), n + 1)
    assert got == want
    assert running.running(table.where("false"), ["g"], ["at"], n=("sum", table.v)).count() == 0
