"""Screening while files arrive: findings per batch, verdicts that follow units over batches, running counters.

A unit's surfaces may arrive in several batches. Its folded findings are state, kept by unit in the stream's checkpoint; each
batch re-emits all of a touched unit's findings, so the batch functions score it as if it had come at once. Every batch is written to a folder
of its own, which a replay after a failure replaces.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What is kept of a finding, beside its unit, its source and its hits; the first row's, by ``seq``.
_FIRST = ("seq", "title", "severity", "category", "pattern", "location", "evidence")
_FOLDED = "unit_id long, source string, hits long, title string, severity string, category string, pattern string, location string, evidence string, seq long"


def arriving(spark: SparkSession, path: str, schema, files_a_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def _each_batch(stream: DataFrame, make: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def screen_stream(stream: DataFrame, screen: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Append what ``screen`` finds in each batch; a batch done twice after a failure replaces its own output."""
    return _each_batch(stream, screen, out, checkpoint)


def fold_stream(findings: DataFrame) -> DataFrame:
    """All folded findings of each unit that a batch of findings touches, those of earlier batches too, as ``fold_findings`` gives them for the whole.

    Null titles and patterns fold together; a unit's state grows with its different findings, not with its hits.
    """
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
        for frame in frames:
            for row in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                name = row["title"] if row["pattern"] is None else row["pattern"]
                first, hits = [None if row[c] is None else int(row[c]) if c == "seq" else row[c] for c in _FIRST], int(row["hits"] or 0)
                at = json.dumps([name, row["source"]])
                known = held.get(at)
                rank = lambda f: [(v is not None, v) for v in f]
                held[at] = [hits, first] if known is None else [known[0] + hits, min(known[1], first, key=rank)]
        state.update((json.dumps(held),))
        rows = [(key[0], json.loads(at)[1], hits, *first[1:], first[0]) for at, (hits, first) in held.items()]
        yield pd.DataFrame(rows, columns=["unit_id", "source", "hits", *_FIRST[1:], "seq"])

    some = findings.select("unit_id", "source", "hits", *_FIRST)
    return some.groupBy("unit_id").applyInPandasWithState(fold, _FOLDED, "findings string", "update", GroupStateTimeout.NoTimeout)


def screen_units(findings: DataFrame, decide: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Verdicts of the units that each batch touches, from all their findings so far; ``decide`` makes them from folded findings."""
    return _each_batch(fold_stream(findings), decide, out, checkpoint)


def latest(spark: SparkSession, out: str) -> DataFrame:
    """Each unit's last verdict of those that ``screen_units`` has written."""
    written = spark.read.parquet(out)
    rest = [c for c in written.columns if c not in ("unit_id", "batch")]
    return written.groupBy("unit_id").agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select("unit_id", "_last.*")


def verdict_changes(verdicts: DataFrame) -> DataFrame:
    """(verdict, change) from a stream of (unit_id, verdict, batch): a unit that gets another verdict is taken from its old one.

    Rows of a batch older than the one a unit was last seen in are ignored, and the same verdict again changes nothing, so
    verdicts that are written twice count once.
    """
    def change(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was, seen = state.get if state.exists else (None, -1)
        now = was
        for frame in frames:
            for verdict, batch in zip(frame["verdict"], frame["batch"], strict=True):
                if batch >= seen:
                    now, seen = verdict, int(batch)
        state.update((now, seen))
        if now != was:
            yield pd.DataFrame([(v, n) for v, n in ((was, -1), (now, 1)) if v is not None], columns=["verdict", "change"])

    some = verdicts.select("unit_id", "verdict", F.col("batch").cast("long").alias("batch"))
    return some.groupBy("unit_id").applyInPandasWithState(change, "verdict string, change long", "verdict string, batch long", "update", GroupStateTimeout.NoTimeout)


def count_verdicts(verdicts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep what each batch changes in the counts, one row a verdict and batch at most."""
    return _each_batch(verdict_changes(verdicts), lambda batch: batch.groupBy("verdict").agg(F.sum("change").alias("change")), out, checkpoint)


def running_counts(spark: SparkSession, out: str) -> DataFrame:
    """(verdict, units) as of the last batch that ``count_verdicts`` has written."""
    return spark.read.parquet(out).groupBy("verdict").agg(F.sum("change").alias("units"))
