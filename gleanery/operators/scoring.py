"""Evidence to verdicts: folding, scores, the verdict cascade, counts and scorecards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dims import ATTENTION, severity_weight, verdict_ordinal
from .running import running

FOLD_KEY = ("unit_id", "title", "source")


def fold_findings(findings: DataFrame) -> DataFrame:
    """One row for each unit, pattern (or title) and source: hits added up, the first row's place and evidence kept; null hits add nothing, a null ``seq`` comes first."""
    key = F.coalesce("pattern", "title").alias("fold_key")
    kept = ("title", "severity", "category", "pattern", "location", "evidence")
    first = F.min(F.struct("seq", *kept)).alias("first")
    folded = findings.groupBy("unit_id", key, "source").agg(F.coalesce(F.sum("hits"), F.lit(0)).cast("long").alias("hits"), first)
    return folded.select("unit_id", "source", "hits", *[f"first.{c}" for c in (*kept, "seq")])


def unit_scores(folded: DataFrame) -> DataFrame:
    """Each unit's score and what the verdict asks about its findings."""
    weight = severity_weight(F.col("severity"))
    term = F.col("pattern").isNotNull()
    return folded.groupBy("unit_id").agg(
        F.sum(weight + F.least(F.col("hits") - 1, F.lit(10)) * 2).cast("long").alias("score"),
        F.bool_or(term).alias("any_term"),
        F.bool_or(term & (weight >= 50) & ~F.col("source").isin("FILE_NAME", "ENTRY_PATH")).alias("substantive"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_findings"),
        F.count_if(F.col("severity") == "HIGH").alias("high_findings"),
        F.coalesce(F.sum(F.when(term, F.col("hits"))), F.lit(0)).cast("long").alias("term_hits"),
    )


# The order of the rules and their bounds.
def verdict(outcome: Column, resisted: Column) -> Column:
    """The first rule that holds, from the columns of unit_scores."""
    term, substantive, critical = F.col("any_term"), F.col("substantive"), F.col("critical_findings")
    return (
        F.when(outcome.isin("NOT_AN_ARCHIVE", "UNREADABLE"), "UNREADABLE")
        .when(term & resisted & (substantive | (critical >= 2)), "CRITICAL")
        .when(term & substantive, "DETECTED").when(term & (critical > 0), "DETECTED")
        .when(resisted, "SUSPICIOUS").when(term | (F.col("score") >= 20), "NOTABLE").otherwise("CLEAN")
    )


def decide(units: DataFrame, scores: DataFrame) -> DataFrame:
    """Verdicts of all units (unit_id, outcome, obfuscated, encrypted, broken, read, unreadable), with or without findings."""
    joined = units.join(scores, "unit_id", "left").fillna({"score": 0, "any_term": False, "substantive": False, "critical_findings": 0, "high_findings": 0, "term_hits": 0})
    share = F.coalesce(F.try_divide(F.col("unreadable"), F.col("read") + F.col("unreadable")), F.lit(0.0))
    resisted = F.col("obfuscated") | F.col("encrypted") | F.col("broken") | (F.col("outcome") == "FAILED") | (share > 0.25)
    return joined.withColumn("verdict", verdict(F.col("outcome"), resisted))


def verdict_counts(verdicts: DataFrame, table: DataFrame) -> DataFrame:
    """Units of each verdict, none included."""
    counts = verdicts.groupBy("verdict").agg(F.count("*").alias("n"))
    return table.join(counts, "verdict", "left").select("verdict", "ordinal", F.coalesce("n", F.lit(0)).alias("units"))


def summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count("*").alias("found"), F.count_if(F.col("verdict") != "UNREADABLE").alias("analysed"), F.count_if(F.col("verdict") == "UNREADABLE").alias("failed"), F.count_if(F.col("verdict").isin(*ATTENTION)).alias("attention"))


def report_order(verdicts: DataFrame, name: str) -> list[Column]:
    return [verdict_ordinal(F.col("verdict")).desc(), F.desc("score"), F.lower(name).asc(), F.col("unit_id").asc()]


def top_findings(folded: DataFrame) -> DataFrame:
    """Each unit's gravest finding, the earliest of equals."""
    order = Window.partitionBy("unit_id").orderBy(severity_weight(F.col("severity")).desc(), "seq")
    return folded.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def risk_counts(hits: DataFrame) -> DataFrame:
    """(unit_id, high, medium, low, total, band) of risk-rated hits."""
    of = lambda risk: F.coalesce(F.sum(F.when(F.col("risk") == risk, F.col("hits"))), F.lit(0)).cast("long")
    total = F.sum("hits").cast("long")
    band = F.when(total > 20, "high").when(total > 5, "medium").when(total > 0, "low").otherwise("clean")
    return hits.groupBy("unit_id").agg(of("HIGH").alias("high"), of("MEDIUM").alias("medium"), of("LOW").alias("low"), total.alias("total"), band.alias("band"))


def _facts(values: np.ndarray) -> tuple[int, int, float]:
    """How many small numbers, how many distinct ones, and their entropy in bits."""
    counts = np.bincount(values, minlength=256)
    counts = counts[counts > 0]
    return len(values), len(counts), float(np.log2(len(values)) - (counts * np.log2(counts)).sum() / len(values))


_FACTS = T.StructType([T.StructField("n", T.LongType()), T.StructField("kinds", T.LongType()), T.StructField("entropy", T.DoubleType())])


# Counting characters within the row takes a few nanoseconds each in numpy; as array functions it took 650, as exploded rows 400.
@F.pandas_udf(_FACTS)
def _text_facts(texts: pd.Series) -> pd.DataFrame:
    low = (np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint8)[::2] for t in texts)
    return pd.DataFrame([_facts(v) for v in low], columns=["n", "kinds", "entropy"])


@F.pandas_udf(_FACTS)
def _byte_facts(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_facts(np.frombuffer(c, np.uint8)) for c in contents], columns=["n", "kinds", "entropy"])


def text_entropy(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Bits a character of the low bytes of each row's UTF-16 units: (key, units, entropy); nothing for null and empty texts."""
    facts = rows.where(F.length(text) > 0).select(key, _text_facts(text).alias("_facts"))
    return facts.select(key, F.col("_facts.n").alias("units"), "_facts.entropy")


def byte_facts(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, bytes, distinct_bytes, uniform, entropy) of each row's binary content; nothing for null and empty ones."""
    facts = rows.where(F.octet_length(content) > 0).select(key, _byte_facts(content).alias("_facts"))
    return facts.select(key, F.col("_facts.n").alias("bytes"), F.col("_facts.kinds").alias("distinct_bytes"), (F.col("_facts.kinds") == 1).alias("uniform"), "_facts.entropy")


def blob_class(magic: Column) -> Column:
    """From the columns of byte_facts and the known format, if any."""
    return F.when(magic.isNotNull(), magic).when(F.col("uniform"), "uniform").when(F.col("entropy") < 1.0, "sparse").when((F.col("entropy") > 7.5) & (F.col("bytes") > 64), "dense").otherwise("normal")


def literal_sample(rows: DataFrame, most: int = 120_000) -> DataFrame:
    """Texts of at least four characters without ( / ; in order, up to ``most`` characters a unit; a unit of any size is added up in many tasks."""
    fit = rows.where((F.length("text") >= 4) & ~F.col("text").rlike("[(/;]"))
    summed = running(fit, ["unit_id"], ["ordinal"], _upto=("sum", F.length("text")))
    return summed.withColumn("_before", F.col("_upto") - F.length("text")).drop("_upto").where(F.col("_before") < most).withColumn("text", F.left("text", (F.lit(most) - F.col("_before")).cast("int"))).drop("_before")


def name_shapes(names: DataFrame) -> DataFrame:
    """Per unit: classes, short, barcode, invisible and non-ASCII names of (unit_id, name)."""
    from ..functions.names import has_invisible, is_barcode, is_non_ascii, is_short

    name = F.col("name")
    return names.groupBy("unit_id").agg(F.count("*").alias("classes"), *[F.count_if(f(name)).alias(c) for c, f in (("short_names", is_short), ("barcode", is_barcode), ("invisible", has_invisible), ("non_ascii", is_non_ascii))])


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


# Fixed values in the three functions below: weights and bounds of the signals.
def obfuscation_score(row: dict[str, Column]) -> Column:
    """Weighted signals, at most 1. row: class_short, member_short, decrypt, synthetic, no_source (ratios), barcode, invisible, non_ascii, classes, entropy."""
    flag = lambda c, w: F.when(c, w).otherwise(0.0)
    return F.least(F.lit(1.0), 0.32 * row["class_short"] + 0.28 * row["member_short"] + 0.20 * F.least(row["decrypt"] / 2, F.lit(1.0)) + 0.05 * F.least(row["synthetic"] / 0.35, F.lit(1.0)) + 0.05 * row["no_source"]
                   + flag(row["barcode"] > 0, 0.10) + flag(row["invisible"] > 0, 0.20) + flag(row["non_ascii"] > 0.1 * row["classes"], 0.10) + flag(row["entropy"] > 4.8, 0.05))


def is_obfuscated(score: Column, row: dict[str, Column]) -> Column:
    strong = [row["class_short"] > 0.45, row["member_short"] > 0.45, row["decrypt"] > 1.0, row["barcode"] > 2, row["invisible"] > 0]
    return (score >= 0.45) | (sum((F.when(s, 1).otherwise(0) for s in strong[1:]), F.when(strong[0], 1).otherwise(0)) >= 2) | (row["invisible"] > 0)


def tool_guess(marker: Column, obfuscated: Column, row: dict[str, Column]) -> Column:
    return F.coalesce(marker, F.when(~obfuscated, "").when(row["invisible"] > 0, "unicode").when(row["barcode"] > 2, "barcode")
                      .when((row["decrypt"] > 1.5) & (row["entropy"] > 4.5), "strings").when((row["class_short"] > 0.6) & (row["decrypt"] < 0.3), "renamer").otherwise("generic"))


def class_scorecard(facts: DataFrame) -> DataFrame:
    """Per archive_id, from (simple_name, member_count, short_members, synthetic_members, has_source, parsed, decrypt_calls): what the score asks.

    Classes that could not be parsed count as unparseable and have no names.
    """
    from ..functions.names import has_invisible, is_barcode, is_non_ascii

    name, parsed = F.col("simple_name"), F.col("parsed")
    count = lambda when: F.count_if(parsed & when)
    total = lambda c: F.coalesce(F.sum(F.when(parsed, F.col(c))), F.lit(0)).cast("long")
    return facts.groupBy(F.col("archive_id").alias("unit_id")).agg(
        F.count_if(parsed).alias("classes"), F.count_if(~parsed).alias("unparseable"), count(F.length(name) <= 2).alias("short_names"), count(is_barcode(name)).alias("barcode"),
        count(has_invisible(name)).alias("invisible"), count(is_non_ascii(name)).alias("non_ascii"), total("member_count").alias("members"), total("short_members").alias("short_members"),
        total("synthetic_members").alias("synthetic"), count(~F.col("has_source")).alias("no_source"), total("decrypt_calls").alias("decrypt_calls"))


def judged(scorecard: DataFrame, entropy: Column | None = None, marker: Column | None = None) -> DataFrame:
    """Add score, obfuscated and guess to the columns of class_scorecard."""
    of = lambda part, whole: ratio(F.col(part), F.col(whole))
    row = {"class_short": of("short_names", "classes"), "member_short": of("short_members", "members"), "decrypt": of("decrypt_calls", "classes"), "synthetic": of("synthetic", "members"), "no_source": of("no_source", "classes"),
           **{c: F.col(c) for c in ("barcode", "invisible", "non_ascii", "classes")}, "entropy": F.lit(0.0) if entropy is None else entropy}
    scored = scorecard.withColumn("score", F.when(F.col("classes") > 0, obfuscation_score(row)).otherwise(0.0))
    scored = scored.withColumn("obfuscated", (F.col("classes") > 0) & is_obfuscated(F.col("score"), row))
    return scored.withColumn("guess", tool_guess(F.lit(None).cast("string") if marker is None else marker, F.col("obfuscated"), row))


# Weights, bounds and the order of the kinds.
def instruction_scorecard(metrics: DataFrame, first: int = 30) -> DataFrame:
    """Per archive_id, a second score out of instruction counts of its first 30 classes by ordinal.

    metrics: (archive_id, ordinal, short_name, methods, short_methods, synthetic_methods, encrypted_strings, char_arrays, builders, gotos, shrinks, smokes, throws).
    """
    ranked = metrics.withColumn("_n", F.row_number().over(Window.partitionBy("archive_id").orderBy("ordinal"))).where(F.col("_n") <= first)
    sums = ("methods", "short_methods", "synthetic_methods", "encrypted_strings", "char_arrays", "builders", "gotos", "shrinks", "smokes", "throws")
    at = ranked.groupBy("archive_id").agg(F.count("*").alias("classes"), F.count_if("short_name").alias("short_classes"), *[F.sum(c).cast("long").alias(c) for c in sums])
    c = F.col
    short_classes, short_methods = ratio(c("short_classes"), c("classes")), ratio(c("short_methods"), c("methods"))
    bonus = lambda when, w: F.when(when, w).otherwise(0.0)
    score = 0.35 * short_classes + 0.35 * short_methods + bonus(c("encrypted_strings") > 2 * c("classes"), 0.2) + bonus(c("char_arrays") > c("classes"), 0.1) + bonus(c("synthetic_methods") > 0.3 * c("methods"), 0.1) + bonus(c("gotos") > 5 * c("methods"), 0.05)
    at = at.withColumns({"score": score, "short": (short_classes > 0.5) | (short_methods > 0.5), "hidden": (c("encrypted_strings") > 2 * c("classes")) | (c("char_arrays") > c("classes"))})
    at = at.withColumn("obfuscated", (c("score") > 0.3) | c("short") | c("hidden"))
    short, hidden = c("short"), c("hidden")
    kind = (
        F.when(~c("obfuscated"), "none").when(hidden & (c("char_arrays") > 3 * c("classes")), "Stringer").when(hidden & (c("builders") > 5 * c("classes")), "Allatori")
        .when(short & ~hidden & (c("synthetic_methods") > 0.2 * c("methods")), "DashO").when(hidden & (c("shrinks") > 3 * c("classes")) & ~short, "JShrink")
        .when(hidden & (c("smokes") > 2 * c("classes")) & (c("throws") > c("methods")), "Smokescreen").when(short & ~hidden, "ProGuard").when(hidden & (c("score") > 0.6), "ZKM").otherwise("generic"))
    return at.select("archive_id", "classes", "score", "obfuscated", "hidden", kind.alias("kind"))


def triage(units: DataFrame, verdicts: list[str], days: int, as_of: str, text: str = "") -> DataFrame:
    """Units (verdict, modified_at, path, name) with one of these verdicts, of at most so many days or of no known time, that hold the text, in any case, in path or name; with their age in days."""
    aged = units.withColumn("age", F.datediff(F.lit(as_of).cast("date"), F.col("modified_at").cast("date")))
    held = F.lower(F.concat_ws("\n", "path", "name")).contains(text.lower()) if text else F.lit(True)
    return aged.where(F.col("verdict").isin(*verdicts) & (F.col("age").isNull() | (F.col("age") <= days)) & held)


def sample_names(names: DataFrame, most: int = 12) -> DataFrame:
    """(unit_id, names): the first names of each unit by ordinal, at most twelve, of (unit_id, ordinal, name)."""
    from .matching import capped

    listed = F.sort_array(F.collect_list(F.struct("ordinal", "name")))
    ranked = capped(names.select("unit_id", "ordinal", "name"), ["unit_id"], ["ordinal", "name"], most)
    return ranked.groupBy("unit_id").agg(F.transform(listed, lambda r: r["name"]).alias("names"))


def findings_order() -> list[Column]:
    """Findings of a report: the gravest first, then as they were found."""
    return [severity_weight(F.col("severity")).desc(), F.col("seq").asc()]


def manifest_facts(manifests: DataFrame) -> DataFrame:
    """(archive_id, main_class, premain_class, agent_class, tweak_class, core_plugin) of (archive_id, text)."""
    from ..functions.text import manifest_value

    text = F.col("text")
    keys = {"main_class": "Main-Class", "premain_class": "Premain-Class", "agent_class": "Agent-Class", "tweak_class": "TweakClass"}
    return manifests.select("archive_id", *[manifest_value(text, k).alias(c) for c, k in keys.items()], text.contains("FMLCorePlugin").alias("core_plugin"))
