import random
from collections import Counter

from pyspark.sql import functions as F

from gleanery.operators import scoring
from gleanery.streaming import screen

FINDINGS = "unit_id long, seq long, title string, severity string, source string, category string, pattern string, location string, evidence string, hits long"


def found(unit, seq, severity, hits=1, pattern=None, title="t"):
    return (unit, seq, title, severity, "CONSTANT", "c", pattern, f"l{seq}", "e", hits)


def decide(folded):
    scores = scoring.unit_scores(folded)
    return scores.select("unit_id", "score", F.when(F.col("critical_findings") > 0, "CRITICAL").when(F.col("score") > 20, "DETECTED").otherwise("NOTABLE").alias("verdict"))


def arrive(spark, rows, path, schema=FINDINGS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(spark, base):
    stream = screen.arriving(spark, f"{base}/in", FINDINGS, 1)
    screen.screen_units(stream, decide, f"{base}/verdicts", f"{base}/ck1").awaitTermination(120)


def count(spark, base):
    verdicts = spark.readStream.schema("unit_id long, score long, verdict string, batch long").parquet(f"{base}/verdicts")
    screen.count_verdicts(verdicts, f"{base}/counts", f"{base}/ck2").awaitTermination(120)
    return {r.verdict: r.units for r in screen.running_counts(spark, f"{base}/counts").collect() if r.units}


def test_units_that_arrive_in_pieces(spark, tmp_path):
    """Three batches, with the stream stopped and started again between them, give each unit the verdict of one batch."""
    base, rng = str(tmp_path), random.Random(2)
    batches = [[found(u, 100 * b + i, rng.choice(["LOW", "MEDIUM", "HIGH"]), rng.randint(1, 5), rng.choice([None, "p", "q"]), rng.choice("tu")) for u in range(6) if (u + b) % 3 or u == 0 for i in range(3)] for b in range(3)]
    batches[2].append(found(0, 999, "CRITICAL", title="last"))
    batches[1].append(found(1, None, "LOW", None, None, None))
    verdicts = []
    for batch in batches:
        arrive(spark, batch, f"{base}/in")
        run(spark, base)
        verdicts.append({r.unit_id: r.verdict for r in screen.latest(spark, f"{base}/verdicts").collect()})
        assert count(spark, base) == Counter(verdicts[-1].values())
    assert verdicts[0][0] != "CRITICAL" and verdicts[2][0] == "CRITICAL"
    whole = spark.createDataFrame([r for b in batches for r in b], FINDINGS)
    want = {r.unit_id: (r.score, r.verdict) for r in decide(scoring.fold_findings(whole)).collect()}
    assert {r.unit_id: (r.score, r.verdict) for r in screen.latest(spark, f"{base}/verdicts").collect()} == want


def test_counts_survive_a_replayed_batch(spark, tmp_path):
    base = str(tmp_path)
    arrive(spark, [found(1, 1, "LOW", pattern="p"), found(2, 1, "LOW", pattern="p")], f"{base}/in")
    run(spark, base)
    assert count(spark, base) == {"NOTABLE": 2}
    arrive(spark, [found(1, 2, "CRITICAL", pattern="q")], f"{base}/in")
    run(spark, base)
    assert count(spark, base) == {"NOTABLE": 1, "CRITICAL": 1}
    # A failure after a batch was written, but before it was marked as done: both streams do their last batch again.
    last = max(int(p.name) for p in (tmp_path / "ck1/commits").iterdir() if p.name.isdigit())
    for folder in ("ck1", "ck2"):
        n = max(int(p.name) for p in (tmp_path / folder / "commits").iterdir() if p.name.isdigit())
        for name in (f"{n}", f".{n}.crc"):
            (tmp_path / folder / "commits" / name).unlink(missing_ok=True)
    run(spark, base)
    assert count(spark, base) == {"NOTABLE": 1, "CRITICAL": 1}
    assert {r.unit_id: r.verdict for r in screen.latest(spark, f"{base}/verdicts").collect()} == {1: "CRITICAL", 2: "NOTABLE"}
    assert spark.read.parquet(f"{base}/verdicts").where(F.col("batch") == last).count() == 1


def test_a_verdict_that_changes_back(spark, tmp_path):
    base = str(tmp_path)
    schema = "unit_id long, score long, verdict string"
    for batch, rows in enumerate([[(1, 5, "A"), (2, 5, "A")], [(1, 6, "B")], [(1, 7, "A"), (3, 1, "B")]]):
        spark.createDataFrame(rows, schema).write.parquet(f"{base}/verdicts/batch={batch}")
        got = count(spark, base)
    assert got == {"A": 2, "B": 1}
