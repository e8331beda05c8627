"""Governance of term lists, processes against files, lineage and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settled import settled

# Calls that reach a class, method or field by name.
REFLECTION = (
    ("java/lang/reflect/Method", "invoke", "Method.invoke"), ("java/lang/Class", "forName", "Class.forName"), ("java/lang/Class", "getDeclaredMethod", "Class.getMethod"),
    ("java/lang/Class", "getMethod", "Class.getMethod"), ("java/lang/Class", "getDeclaredField", "Class.getField"), ("java/lang/Class", "getField", "Class.getField"),
    ("java/lang/reflect/Field", "set", "Field.set"), ("java/lang/reflect/Field", "get", "Field.get"), ("java/lang/invoke/MethodHandles", "lookup", "MethodHandles.lookup"),
    ("java/lang/invoke/MethodHandles", "invoke", "MethodHandles.invoke"), ("java/lang/invoke/MethodHandles", "invokeExact", "MethodHandles.invokeExact"),
)

#: Volumes that are sent to every task; of more, each holds a small share of the files.
MOST_VOLUMES = 10_000


def tampered(defaults: DataFrame, current: DataFrame) -> DataFrame:
    """Grave default terms that the current list lacks, whatever the case."""
    have = current.select(F.lower("pattern").alias("_p")).distinct()
    return defaults.where(F.col("severity").isin("HIGH", "CRITICAL")).join(have, F.lower("pattern") == F.col("_p"), "left_anti")


def merged(current: DataFrame, imported: DataFrame) -> DataFrame:
    """The current list and those imported terms that it doesn't have, with a flag for these."""
    new = imported.join(current, ["pattern", "kind"], "left_anti").dropDuplicates(["pattern", "kind"])
    return current.withColumn("added", F.lit(False)).unionByName(new.withColumn("added", F.lit(True)))


def ghosts(referenced: DataFrame, files: DataFrame) -> DataFrame:
    """Paths that processes refer to and no file has, with their processes."""
    return referenced.join(files.select("path").distinct(), "path", "left_anti")


def present(referenced: DataFrame, files: DataFrame) -> DataFrame:
    """References to files that are there; paths that end as directories do, or are marked as such by a ``directory`` column, are no targets."""
    plain = files.where(~F.col("path").rlike(r"[/\\]$"))
    if "directory" in files.columns:
        plain = plain.where(~F.coalesce("directory", F.lit(False)))
    return referenced.join(plain.select("path").distinct(), "path", "left_semi")


def reparented(findings: DataFrame, lineage: DataFrame, depth: int = 2) -> DataFrame:
    """Findings of nested units under their outermost unit, their place prefixed by the way there; deeper ones stay where they are."""
    up = lineage.select(F.col("child_id").alias("_child"), F.col("parent_id").alias("_parent"), F.col("entry").alias("_entry"))
    out = findings.withColumn("nested", F.lit(False))
    for _ in range(depth):
        joined = out.join(up, F.col("unit_id") == F.col("_child"), "left")
        moved = F.col("_parent").isNotNull()
        out = joined.withColumns({
            "unit_id": F.coalesce("_parent", "unit_id"), "location": F.when(moved, F.concat_ws("!", "_entry", "location")).otherwise(F.col("location")),
            "source": F.when(moved, "NESTED_JAR").otherwise(F.col("source")), "nested": F.col("nested") | moved,
        }).drop("_child", "_parent", "_entry")
    return out


def full_paths(nodes: DataFrame, rounds: int = 8) -> DataFrame:
    """(id, path) of (id, parent_id, name) by doubling: after r rounds every chain of up to 2 ** r steps is known.

    A root is its own parent. Chains that are broken, cyclic or longer are left out. Each round is checkpointed, so it
    reads the one before it twice and no more; rounds end early once every chain is known or broken.
    """
    root = F.col("id") == F.col("parent_id")
    at = settled(nodes.select("id", F.when(root, F.lit(None)).otherwise(F.col("parent_id")).alias("up"), F.col("name").alias("path"), root.alias("done")))
    for _ in range(rounds):
        if at.where("up IS NOT NULL AND NOT done").isEmpty():
            break
        above = at.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("done").alias("_done"))
        at = settled(at.join(above, F.col("up") == F.col("_id"), "left").select(
            "id", F.when(F.col("done"), F.lit(None)).otherwise(F.col("_up")).alias("up"),
            F.when(F.col("done") | F.col("_path").isNull(), F.col("path")).otherwise(F.concat_ws("/", "_path", "path")).alias("path"), (F.col("done") | F.coalesce("_done", F.lit(False))).alias("done")))
    return at.where("done").select("id", "path")


def with_ancestors(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes (path) that match or lie above one that does."""
    parts = F.split("path", "/")
    above = matches.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("path")).distinct()
    return nodes.join(above, "path", "left_semi")


def trusted_volumes(reported: DataFrame, files: DataFrame, few: int = 20, share: float = 0.5) -> DataFrame:
    """(volume, reported, resolved, trusted): a volume's reports are trusted if few or at least half of them exist."""
    exists = files.select("path").distinct().withColumn("_there", F.lit(True))
    counts = reported.join(exists, "path", "left").groupBy("volume").agg(F.count("*").alias("reported"), F.count("_there").alias("resolved"))
    return counts.withColumn("trusted", (F.col("reported") < few) | (F.col("resolved") >= share * F.col("reported")))


def trusted_or_scanned(reported: DataFrame, scanned: DataFrame, volumes: DataFrame) -> DataFrame:
    """(volume, path, source): what the index reports of trusted volumes, and what a scan finds of all others, each file once.

    volumes: (volume, trusted). Nothing of a trusted volume is taken from the scan, so the scan needn't list it; volumes that nothing was reported of are scanned.
    """
    trusted = settled(volumes.where("trusted").select("volume"))
    if trusted.limit(MOST_VOLUMES + 1).count() <= MOST_VOLUMES:
        # A volume's files would all go to one task of a join by volume.
        trusted = F.broadcast(trusted)
    kept = reported.join(trusted, "volume", "left_semi").select("volume", "path").distinct().withColumn("source", F.lit("index"))
    rest = scanned.join(trusted, "volume", "left_anti").select("volume", "path").distinct().withColumn("source", F.lit("scan"))
    return kept.unionByName(rest)


def flags_of_outermost(flags: DataFrame, lineage: DataFrame, depth: int = 2) -> DataFrame:
    """(unit_id, encrypted, obfuscated): a unit is either if it is itself or a unit nested in it, two levels deep."""
    up = lineage.select(F.col("child_id").alias("_child"), F.col("parent_id").alias("_parent"))
    out, own = [flags.select("unit_id", "encrypted", "obfuscated")], flags.select("unit_id", "encrypted", "obfuscated")
    for _ in range(depth):
        own = own.join(up, F.col("unit_id") == F.col("_child")).select(F.col("_parent").alias("unit_id"), "encrypted", "obfuscated")
        out.append(own)
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.groupBy("unit_id").agg(F.bool_or("encrypted").alias("encrypted"), F.bool_or("obfuscated").alias("obfuscated"))


def migrated(terms: DataFrame, former: DataFrame) -> DataFrame:
    """Terms whose description is exactly a former one (old, key) get its key; others keep theirs."""
    lookup = former.select(F.col("old").alias("_old"), F.col("key").alias("_key")).dropDuplicates(["_old"])
    joined = terms.join(lookup, F.col("description") == F.col("_old"), "left")
    return joined.withColumn("description", F.coalesce("_key", "description")).select(*terms.columns)


def with_code(archives: DataFrame, entries: DataFrame) -> DataFrame:
    """Archives that hold a class or a manifest."""
    low = F.lower("name")
    return archives.join(entries.where(low.endswith(".class") | (low == "meta-inf/manifest.mf")).select("archive_id"), "archive_id", "left_semi")


def reflection_calls(calls: DataFrame) -> DataFrame:
    """Calls (owner, name, ...) that reach something by name, with what they do as ``type``."""
    rules = calls.sparkSession.createDataFrame(list(REFLECTION), "_owner string, _name string, type string")
    # Eleven rows.
    return calls.join(F.broadcast(rules), (F.col("owner") == F.col("_owner")) & (F.col("name") == F.col("_name"))).drop("_owner", "_name")


def class_name_texts(texts: DataFrame) -> DataFrame:
    """Rows whose text is shaped like a qualified class name."""
    return texts.where((F.length("text") >= 3) & F.col("text").rlike(r"^[A-Z][a-zA-Z0-9_]*(\.[A-Z][a-zA-Z0-9_]*)+$"))


def without_prefixed(rows: DataFrame, prefixes: DataFrame, column: str = "name") -> DataFrame:
    """Rows whose slash-separated name lies below none of the (prefix) packages: each name's own prefixes meet them in an equi-join."""
    parts = F.split(F.col(column), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    hit = rows.select(column, F.explode(above).alias("prefix")).join(prefixes.select("prefix").distinct(), "prefix", "left_semi").select(F.col(column).alias("_hit")).distinct()
    return rows.join(hit, F.col(column) == F.col("_hit"), "left_anti")


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def distinct_union(*routes: DataFrame) -> DataFrame:
    """Targets that several routes found, each once."""
    out = routes[0]
    for r in routes[1:]:
        out = out.unionByName(r)
    return out.distinct()


def effective_keywords(*lists: DataFrame) -> DataFrame:
    """Trimmed, non-empty keywords of all lists, each once."""
    return distinct_union(*(k.select(F.trim("keyword").alias("keyword")) for k in lists)).where("keyword <> ''")


def term_counts(terms: DataFrame) -> DataFrame:
    """Terms, active ones and distinct patterns by category and severity."""
    return terms.groupBy("category", "severity").agg(F.count("*").alias("terms"), F.count_if("enabled").alias("active"), F.countDistinct("pattern").alias("patterns"))


def search_terms(terms: DataFrame, needle: str) -> DataFrame:
    """Terms whose pattern, category or description holds the needle, whatever the case."""
    low = F.lower(F.concat_ws("\n", "pattern", "category", "description"))
    return terms.where(low.contains(needle.lower()))
