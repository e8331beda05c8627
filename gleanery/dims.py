"""Small fixed tables: severities, verdicts and a sample term list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
SEVERITY = {"INFO": 0, "LOW": 5, "MEDIUM": 20, "HIGH": 50, "CRITICAL": 100}
VERDICTS = ("CLEAN", "NOTABLE", "SUSPICIOUS", "DETECTED", "CRITICAL", "UNREADABLE")
ATTENTION = ("SUSPICIOUS", "DETECTED", "CRITICAL", "UNREADABLE")

TERMS = "pattern string, kind string, severity string, category string, description string, enabled boolean, scan_paths boolean, scan_strings boolean, case_sensitive boolean"
FINDINGS = "unit_id long, seq long, title string, severity string, source string, category string, pattern string, location string, evidence string, hits long"

SAMPLE_TERMS = [
    ("that", "WORD", "LOW", "common", "", True, False, True, False),
    ("inoran", "WORD", "HIGH", "rare", "", True, False, True, False),
    ("hehely", "WORD", "CRITICAL", "rare", "", True, False, True, False),
    ("Orre", "WORD", "MEDIUM", "rare", "", True, False, True, True),
    ("MIT License", "WORD", "MEDIUM", "license", "", True, False, True, False),
    ("tion", "LITERAL", "LOW", "common", "", True, False, True, False),
    ("example.com", "LITERAL", "MEDIUM", "host", "", True, True, False, False),
    ("[A-Za-z0-9._]+@[A-Za-z0-9.]+", "REGEX", "HIGH", "contact", "", True, False, True, False),
    ('token = "[0-9a-f]{40}"', "REGEX", "CRITICAL", "secret", "", True, False, True, False),
    ("étion", "LITERAL", "LOW", "common", "", True, False, True, False),
    ("disabledterm", "WORD", "HIGH", "none", "", False, True, True, False),
]


def sample_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE_TERMS, TERMS)


def verdict_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v, i) for i, v in enumerate(VERDICTS)], "verdict string, ordinal int")


def _by_name(column: Column, values: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, number in values.items():
        out = F.when(column == name, number).otherwise(out)
    return out


def severity_weight(severity: Column) -> Column:
    return _by_name(severity, SEVERITY)


def verdict_ordinal(verdict: Column) -> Column:
    return _by_name(verdict, {v: i for i, v in enumerate(VERDICTS)})
