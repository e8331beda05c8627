"""Term lists, process snapshots and reports on disk."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import ATTENTION, TERMS, sample_terms, verdict_ordinal

PROCESSES = "pid long, exe string, command_line string"
JVMS = "pid string, display_name string, command string, class_path string, jvm_args array<string>, error string"


def read_terms(spark: SparkSession, path: str, defaults: DataFrame | None = None) -> DataFrame:
    """Terms of a JSON array; the defaults if it holds none that can be read."""
    terms = spark.read.schema(TERMS + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    good = terms.where("_corrupt_record IS NULL AND pattern <> ''").drop("_corrupt_record")
    return (sample_terms(spark) if defaults is None else defaults) if good.isEmpty() else good


def write_terms(terms: DataFrame, path: str) -> None:
    """One JSON array; a term list is small enough to be a single row."""
    terms.agg(F.to_json(F.collect_list(F.struct(*terms.columns))).alias("value")).write.mode("overwrite").text(path)


def save_terms(terms: DataFrame, path: str) -> None:
    """Keep a list as a new version below ``path``; it counts once it is whole.

    The list is written to a folder of its own, and a pointer to it last. So a list can be read, changed and saved at
    one place, and a writer that dies half-way leaves the list as it was.
    """
    spark, number = terms.sparkSession, uuid.uuid4().hex
    write_terms(terms, f"{path}/versions/{number}")
    last = _pointers(spark, path)
    spark.createDataFrame([(1 if last is None else last[0] + 1, number)], POINTER).coalesce(1).write.mode("append").json(f"{path}/pointer")


def saved_terms(spark: SparkSession, path: str, defaults: DataFrame | None = None) -> DataFrame:
    """The last list that was saved whole below ``path``; the defaults if there is none."""
    last = _pointers(spark, path)
    if last is None:
        return sample_terms(spark) if defaults is None else defaults
    return read_terms(spark, f"{path}/versions/{last[1]}", defaults)


POINTER = "number long, version string"


def _pointers(spark: SparkSession, path: str) -> tuple[int, str] | None:
    try:
        last = spark.read.schema(POINTER).json(f"{path}/pointer").agg(F.max(F.struct("number", "version")).alias("last")).first()["last"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if last is None else tuple(last)


def read_processes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROCESSES).json(path)


def read_jvms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JVMS).json(path)


def report(verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    """One row a unit, with its findings in order as an array."""
    inside = [c for c in findings.columns if c not in ("unit_id", "seq")]
    listed = findings.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("seq", *inside))).alias("findings"))
    return verdicts.join(listed, "unit_id", "left")


def in_order(rows: DataFrame, name: Column) -> DataFrame:
    """Rows range-partitioned and sorted as a report lists them, worst units first: files read one after another are in order."""
    ranked = rows.withColumns({f"_o{i}": o for i, o in enumerate([verdict_ordinal(F.col("verdict")), F.col("score"), F.lower(name), F.col("unit_id")])})
    by = [F.desc("_o0"), F.desc("_o1"), F.asc("_o2"), F.asc("_o3")]
    return ranked.repartitionByRange(*by).sortWithinPartitions(*by).drop("_o0", "_o1", "_o2", "_o3")


def write_report_json(verdicts: DataFrame, findings: DataFrame, path: str) -> None:
    """The header's counts and one JSON object a unit, worst units first."""
    listed = report(verdicts, findings)
    in_order(listed, F.col("name") if "name" in listed.columns else F.lit("")).write.mode("overwrite").json(f"{path}/units")
    verdicts.groupBy("verdict").agg(F.count("*").alias("units")).write.mode("overwrite").json(f"{path}/header")


def report_text(verdicts: DataFrame) -> DataFrame:
    """A block of labelled lines for each unit that needs attention, worst units first."""
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for label, c in (("Unit", "unit_id"), ("Verdict", "verdict"), ("Score", "score"))]
    listed = in_order(verdicts.where(F.col("verdict").isin(*ATTENTION)), F.col("name") if "name" in verdicts.columns else F.lit(""))
    return listed.select(F.concat_ws("\n", *lines, F.lit("")).alias("value"))


def write_report_text(verdicts: DataFrame, path: str) -> None:
    report_text(verdicts).write.mode("overwrite").text(path)
