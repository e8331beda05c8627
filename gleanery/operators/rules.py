"""Structural rules over archives and their entries, as one set of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N


def _entry_rules() -> list[tuple[str, Column, str, str, bool]]:
    """(rule, when, severity, source, breaks) of the rules about one entry."""
    name = F.col("name")
    kind = N.entry_kind(name)
    return [
        ("encrypted", N.is_encrypted(F.col("flags")), "CRITICAL", "ENCRYPTION", False),
        ("traversal", N.has_traversal(name), "CRITICAL", "ARCHIVE", True),
        ("odd method", N.is_odd_method(F.col("method")), "MEDIUM", "ARCHIVE", True),
        ("deceptive name", (F.col("flags").bitwiseAND(F.lit(2048)) != 0) & N.is_deceptive(name), "MEDIUM", "ARCHIVE", False),
        ("extreme ratio", N.is_extreme_ratio(F.col("csize"), F.col("usize")), "MEDIUM", "ARCHIVE", True),
        ("native library", kind == "native", "HIGH", "NATIVE_LIB", False),
        ("script", kind == "script", "HIGH", "RESOURCE", False),
    ]


def archive_findings(archives: DataFrame) -> DataFrame:
    """(unit_id, rule, severity, source, breaks, n) of the rules about an archive as a whole; the directory's place counts where it is known."""
    one = F.lit(1)
    rules = [
        ("disguised", F.col("readable") & ~N.is_archive_name(F.col("name")), "CRITICAL", "FILE_NAME", False, one),
        ("recycled", N.in_recycle_bin(F.col("path")), "MEDIUM", "FILE_NAME", False, one),
        ("prefix bytes", F.col("prefix_bytes") > 0, "MEDIUM", "ARCHIVE", False, one),
        ("trailing bytes", F.col("trailing_bytes") > 0, "MEDIUM", "ARCHIVE", False, one),
        ("unreadable", ~F.col("readable"), "HIGH", "ARCHIVE", False, one),
    ]
    if "directory_offset" in archives.columns:
        at, size = F.col("directory_offset"), F.col("directory_size")
        rules.append(("directory out of range", (at < 0) | (size < 0) | (at + size > F.col("size_bytes")), "MEDIUM", "ARCHIVE", True, one))
    return archives.select(F.col("archive_id").alias("unit_id"), F.inline(_held(rules)))


def entry_findings(archives: DataFrame, entries: DataFrame, parts: int | None = None) -> DataFrame:
    """(unit_id, rule, severity, source, breaks, n): the rules about an archive's entries that hold, for how many entries or names.

    Entries are read once. Their own rules become bits before they are dealt out by archive, to so many parts (by default
    Spark's own number); sorted by name, which tells names that come twice, they meet what is known of their archive and are
    added up. Entries of an unknown archive are judged by themselves.
    """
    rules = _entry_rules()
    true = lambda when: F.coalesce(when, F.lit(False))
    bits = reduce(Column.bitwiseOR, [F.when(true(when), 1 << i).otherwise(0) for i, (_, when, *_) in enumerate(rules)])
    own = entries.select("archive_id", "name", "header_offset", bits.alias("_bits"))
    dealt = own.repartition(parts, "archive_id") if parts else own.repartition("archive_id")
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("archive_id", "name").orderBy("name")))
    twice = (F.col("_rank") == 2) & ~F.col("name").endswith("/")
    seen = ranked.select("archive_id", "header_offset", F.when(true(twice), F.col("_bits").bitwiseOR(1 << len(rules))).otherwise(F.col("_bits")).alias("_bits"))
    known = archives.select(F.col("archive_id").alias("_id"), "prefix_bytes", "size_bytes", "declared_entries")
    past = F.col("prefix_bytes") + F.col("header_offset") >= F.col("size_bytes")
    held = lambda i: F.count_if(F.col("_bits").bitwiseAND(1 << i) != 0)
    sums = seen.join(known, F.col("archive_id") == F.col("_id"), "left").groupBy(F.col("archive_id").alias("unit_id")).agg(
        F.count("*").alias("n"), F.max("declared_entries").alias("declared"), F.count_if(true(past)).alias("past"), held(len(rules)).alias("twice"), *[held(i).alias(f"r{i}") for i in range(len(rules))])
    whole = [
        ("duplicate names", F.col("twice") > 0, "HIGH", "ARCHIVE", True, F.col("twice")), ("entry past end", F.col("past") > 0, "MEDIUM", "ARCHIVE", True, F.col("past")),
        ("entry count", F.col("n") != F.col("declared"), "MEDIUM", "ARCHIVE", True, F.lit(1))]
    each = [(rule, F.col(f"r{i}") > 0, severity, source, breaks, F.col(f"r{i}")) for i, (rule, _, severity, source, breaks) in enumerate(rules)]
    return sums.select("unit_id", F.inline(_held([*each, *whole])))


def rule_findings(archives: DataFrame, entries: DataFrame, parts: int | None = None) -> DataFrame:
    """All rules that hold for archives and their entries; entries are dealt out to so many parts."""
    return archive_findings(archives).unionByName(entry_findings(archives, entries, parts))


def _held(rules: list[tuple]) -> Column:
    """The rules that hold, as structs to be inlined: (rule, when, severity, source, breaks, n)."""
    of = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.filter(F.array(*[F.when(when, F.struct(F.lit(rule).alias("rule"), of(severity).alias("severity"), F.lit(source).alias("source"), F.lit(breaks).alias("breaks"), n.cast("long").alias("n"))) for rule, when, severity, source, breaks, n in rules]), F.isnotnull)


def content_findings(entries: DataFrame) -> DataFrame:
    """Dense unknown binaries: of (archive_id, name, magic, bytes, entropy), those of 2048 bytes on at 7.5 bits a byte that are neither text, signature nor a known format."""
    from ..sources.files import TEXT_NAMES

    low = F.lower("name")
    dense = (F.col("bytes") >= 2048) & (F.col("entropy") >= 7.5) & F.col("magic").isNull() & ~N.is_signature(low) & ~low.rlike(TEXT_NAMES)
    return entries.where(dense).groupBy(F.col("archive_id").alias("unit_id")).agg(F.count("*").alias("n")).select(
        "unit_id", F.lit("high entropy").alias("rule"), F.lit("MEDIUM").alias("severity"), F.lit("ENCRYPTION").alias("source"), F.lit(False).alias("breaks"), "n")


def manifest_findings(facts: DataFrame) -> DataFrame:
    """What manifests ask a loader to do, of the columns of manifest_facts."""
    one = F.lit(1)
    return facts.select(F.col("archive_id").alias("unit_id"), F.inline(_held([
        ("agent", F.col("premain_class").isNotNull() | F.col("agent_class").isNotNull(), "HIGH", "MANIFEST", False, one), ("tweaker", F.col("tweak_class").isNotNull(), "MEDIUM", "MANIFEST", False, one), ("core plugin", F.col("core_plugin"), "MEDIUM", "MANIFEST", False, one)])))


def reading_findings(reads: DataFrame, deepest: int = 2) -> DataFrame:
    """What reading an archive met, of (unit_id, depth, nested_error, truncated, signature_error): nested archives too deep or broken, a budget that ran out, a signature that doesn't hold."""
    one = F.lit(1)
    return reads.select("unit_id", F.inline(_held([
        ("nested skipped", F.col("depth") >= deepest, "LOW", "NESTED_JAR", False, one), ("nested failed", F.col("nested_error").isNotNull(), "MEDIUM", "NESTED_JAR", False, one),
        ("incomplete", F.col("truncated"), "MEDIUM", "DECOMPILE_FAIL", False, one), ("bad signature", F.col("signature_error").isNotNull(), "MEDIUM", "ARCHIVE", False, one)])))


def truncated_reads(entries: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """(archive_id, truncated): archives with more entries or bytes than the budget, which are then read in part only."""
    return entries.groupBy("archive_id").agg(((F.count("*") > most_rows) | (F.sum("usize") > most_bytes)).alias("truncated"))


def obfuscation_findings(judged: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """Findings about hidden code, of the columns of scoring.judged and markers (unit_id, marker); all but the unparseable classes ask for a unit that is obfuscated."""
    hidden, classes, bad = F.col("obfuscated"), F.col("classes"), F.col("unparseable")
    found = judged.select("unit_id", F.inline(_held([
        ("bad classes", bad > 0, F.when(bad > 0.25 * (classes + bad), "HIGH").otherwise("MEDIUM"), "DECOMPILE_FAIL", False, bad), ("obfuscated", hidden, "HIGH", "OBFUSCATION", False, F.lit(1)),
        ("invisible names", hidden & (F.col("invisible") > 0), "CRITICAL", "OBFUSCATION", False, F.col("invisible")), ("encrypted strings", hidden & (F.col("decrypt_calls") > 1.5 * classes), "HIGH", "OBFUSCATION", False, F.col("decrypt_calls"))])))
    if markers is None:
        return found
    left = markers.join(judged.where(hidden).select("unit_id"), "unit_id", "left_semi").groupBy("unit_id").agg(F.count("*").alias("n"))
    return found.unionByName(left.select("unit_id", F.lit("tool marker").alias("rule"), F.lit("MEDIUM").alias("severity"), F.lit("OBFUSCATION").alias("source"), F.lit(False).alias("breaks"), "n"))


# What stands in for a unit that can't be read.
def synthesised_rows(ghosts: DataFrame, closed: DataFrame) -> DataFrame:
    """(name, rule, severity, source, verdict, score) of missing files (path) and of processes (exe) closed to inspection: each path once, each process."""
    row = lambda df, name, rule, severity, verdict, score: df.select(F.col(name).alias("name"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit("FILE_NAME").alias("source"), F.lit(verdict).alias("verdict"), F.lit(score).cast("long").alias("score"))
    return row(ghosts.select("path").distinct(), "path", "ghost", "CRITICAL", "DETECTED", 1000).unionByName(row(closed, "exe", "attach disabled", "HIGH", "NOTABLE", 300))


def inventory(entries: DataFrame) -> DataFrame:
    """Entries of each kind by archive, and the classes that can be read and that can't, for being encrypted or packed by an unknown method; directories are neither entries that are read nor resources."""
    kind = N.entry_kind(F.col("name"))
    kinds = ("class", "nested", "native", "script", "resource", "manifest", "directory")
    is_class, closed = F.col("_kind") == "class", F.coalesce(N.is_encrypted(F.col("flags")) | N.is_odd_method(F.col("method")), F.lit(False))
    return entries.withColumn("_kind", kind).groupBy("archive_id").agg(
        F.count("*").alias("entries"), F.count_if(is_class & ~closed).alias("n_read"), F.count_if(is_class & closed).alias("n_unreadable"), *[F.count_if(F.col("_kind") == k).alias(f"n_{k}") for k in kinds])
