"""A registry of queries with their SQL, and the logical tables derived from the given ones.

Each derived table is a list of select expressions that mean the same to Spark and to the SQL twin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def evenly(df: DataFrame) -> DataFrame:
    """Dealt out over all cores if the input has too few splits for them, as one small file has; a table of many splits stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return evenly(rows) if name in ("documents", "lineitem", "customer") else rows


#: Rows that a task of a shuffle may hold.
ROWS_A_PART = 500_000


def parts(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """Parts for a shuffle of these tables, one for each core at least; their rows are told by the files' footers."""
    rows = sum(spark.read.parquet(f"{sf_dir}/{name}.parquet").count() for name in names)
    return max(spark.sparkContext.defaultParallelism, rows // ROWS_A_PART + 1)


DERIVED = {
    "entries": ("lineitem", [
        "l_orderkey AS archive_id", "l_linenumber AS ordinal",
        "CASE l_partkey % 16 WHEN 0 THEN 'META-INF/MANIFEST.MF' WHEN 1 THEN concat('com/acme/C', CAST(l_suppkey % 3 AS STRING), '.class') WHEN 2 THEN '../up.txt' WHEN 3 THEN 'native/fast.DLL' WHEN 4 THEN 'run.bat'"
        " WHEN 5 THEN 'libs/inner.jar' WHEN 6 THEN 'META-INF/SIG.RSA' WHEN 7 THEN 'assets/textures/a.png' WHEN 8 THEN 'lang/de.json' WHEN 9 THEN 'dir/' WHEN 10 THEN '/etc/x' WHEN 11 THEN 'Illl1.class' WHEN 12 THEN 'a.class'"
        " WHEN 13 THEN 'é.txt' WHEN 14 THEN 'Kаt.class' ELSE concat('data/', l_returnflag, l_linestatus, '.bin') END AS name",
        "CASE WHEN l_partkey % 97 = 0 THEN 1 WHEN l_partkey % 89 = 0 THEN 64 WHEN l_partkey % 2 = 0 THEN 2048 ELSE 0 END AS flags",
        "CASE WHEN l_suppkey % 31 = 0 THEN 12 WHEN l_suppkey % 2 = 0 THEN 8 ELSE 0 END AS method",
        "CAST(floor(l_quantity * 30) AS BIGINT) AS csize", "CAST(floor(l_extendedprice * (1 + l_partkey % 50)) AS BIGINT) AS usize", "CAST(floor(l_extendedprice) AS BIGINT) AS header_offset"]),
    "archives": ("orders", [
        "o_orderkey AS archive_id", "concat('mod', CAST(o_orderkey AS STRING), CASE o_orderkey % 5 WHEN 0 THEN '.dll' WHEN 1 THEN '.JAR' ELSE '.jar' END) AS name",
        "concat('/vol', CAST(o_custkey % 3 AS STRING), CASE WHEN o_orderkey % 41 = 0 THEN '/$Recycle.Bin/' ELSE '/lib/' END, 'mod', CAST(o_orderkey AS STRING), '.jar') AS path",
        "CAST(floor(o_totalprice / 4) AS BIGINT) AS size_bytes", "o_orderdate AS modified_at", "CAST(o_orderkey % 7 + 1 AS BIGINT) AS declared_entries",
        "CAST(CASE WHEN o_orderkey % 13 = 0 THEN 100 ELSE 0 END AS BIGINT) AS prefix_bytes", "CAST(CASE WHEN o_orderkey % 17 = 0 THEN 9 ELSE 0 END AS BIGINT) AS trailing_bytes", "o_orderstatus <> 'P' AS readable",
        "CAST(o_custkey % 1000 - CASE WHEN o_orderkey % 211 = 0 THEN 1000 ELSE 0 END AS BIGINT) AS directory_offset", "CAST(floor(o_totalprice / 8) AS BIGINT) AS directory_size"]),
    "surfaces": ("documents", ["doc_id AS unit_id", "CAST(doc_id AS STRING) AS location", "'STRING' AS surface", "'CONSTANT' AS source", "text"]),
    "page_surfaces": ("pages", ["page_id AS unit_id", "url AS location", "'PATH' AS surface", "'ENTRY_PATH' AS source", "url AS text"]),
    "events_findings": ("events", [
        "user_id AS unit_id", "event_id AS seq", "concat('seen ', event_type) AS title",
        "CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'purchase' THEN 'CRITICAL' WHEN 'click' THEN 'MEDIUM' WHEN 'view' THEN 'INFO' ELSE 'LOW' END AS severity",
        "CASE WHEN event_id % 3 = 0 THEN 'FILE_NAME' WHEN event_id % 3 = 1 THEN 'CONSTANT' ELSE 'ARCHIVE' END AS source", "event_type AS category",
        "CASE WHEN event_id % 3 = 2 THEN NULL ELSE concat(event_type, CAST(event_id % 4 AS STRING)) END AS pattern", "concat('e', CAST(event_id AS STRING)) AS location", "props AS evidence", "CAST(1 + event_id % 4 AS BIGINT) AS hits"]),
    "units": ("customer", [
        "c_custkey AS unit_id", "CASE WHEN c_custkey % 29 = 0 THEN 'NOT_AN_ARCHIVE' WHEN c_custkey % 31 = 0 THEN 'FAILED' ELSE 'POOL_SCANNED' END AS outcome", "c_custkey % 7 = 0 AS obfuscated", "c_custkey % 11 = 0 AS encrypted", "c_custkey % 19 = 0 AS broken",
        "CAST(c_custkey % 5 AS BIGINT) AS `read`", "CAST(c_custkey % 3 AS BIGINT) AS unreadable"]),
    "processes": ("supplier", [
        "s_suppkey AS pid", "CASE WHEN s_suppkey % 3 = 0 THEN 'C:/bin/javaw.exe' WHEN s_suppkey % 3 = 1 THEN 'C:/bin/Java.exe' ELSE 'C:/bin/notepad.exe' END AS exe",
        "concat('\"C:/Program Files/j.exe\" -javaagent:/vol', CAST(s_suppkey % 3 AS STRING), '/lib/mod', CAST(s_suppkey AS STRING), '.jar=x -cp /vol1/lib/mod', CAST(s_suppkey * 3 AS STRING), '.jar;', ' /gone/', CAST(s_suppkey AS STRING), '.jar Main', CASE WHEN s_suppkey % 4 = 0 THEN ' -XX:+DisableAttachMechanism' ELSE '' END) AS command_line"]),
    "tokens": ("documents", ["doc_id AS unit_id", "text"]),
    "facts": ("lineitem", [
        "l_orderkey % 97 AS archive_id", "l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS ordinal",
        "CASE WHEN l_orderkey % 97 % 4 = 0 AND l_partkey % 3 > 0 THEN substr('abcdefgh', CAST(1 + l_partkey % 8 AS INT), 1) WHEN l_orderkey % 97 % 7 = 0 AND l_partkey % 5 = 0 THEN 'Illl1O' WHEN l_orderkey % 97 % 11 = 0 AND l_partkey % 4 = 0 THEN 'Kill\u200bAura'"
        " WHEN l_partkey % 31 = 0 THEN 'Caf\u00e9' ELSE concat('Widget', CAST(l_partkey % 10 AS STRING)) END AS simple_name",
        "CAST(l_linenumber + 3 AS BIGINT) AS member_count", "CAST(CASE WHEN l_orderkey % 97 % 4 = 0 THEN l_linenumber ELSE l_linenumber % 2 END AS BIGINT) AS short_members", "CAST(l_linenumber % 3 AS BIGINT) AS synthetic_members",
        "l_partkey % 2 = 0 AS has_source", "l_partkey % (2 + l_orderkey % 97 % 6) <> 1 OR l_orderkey % 97 % 3 = 0 AS parsed", "CAST(CASE WHEN l_orderkey % 97 % 5 = 0 THEN l_linenumber % 4 + 1 ELSE 0 END AS BIGINT) AS decrypt_calls"]),
    "manifests": ("orders", [
        "o_orderkey AS archive_id", "concat('Manifest-Version: 1.0', chr(10), CASE o_orderkey % 6 WHEN 0 THEN 'Premain-Class: a.B' WHEN 1 THEN '  agent-class:  c.D ' WHEN 2 THEN 'TweakClass: t.T' WHEN 3 THEN 'X: FMLCorePlugin' WHEN 4 THEN 'Agent-Class:' ELSE 'Main-Class: m.M' END, chr(10), 'Last: 1') AS text"]),
    "blobs": ("lineitem", [
        "l_orderkey AS archive_id", "CASE l_partkey % 5 WHEN 0 THEN 'META-INF/X.RSA' WHEN 1 THEN 'notes.TXT' ELSE concat('data/', CAST(l_partkey AS STRING), '.bin') END AS name", "CASE WHEN l_suppkey % 7 = 0 THEN 'png' END AS magic",
        "CAST(floor(l_extendedprice) AS BIGINT) AS bytes", "l_quantity / 6 AS entropy"]),
    "reads": ("orders", [
        "o_orderkey AS unit_id", "o_custkey % 4 AS depth", "CASE WHEN o_orderkey % 19 = 0 THEN 'broken' END AS nested_error", "o_orderkey % 23 = 0 AS truncated", "CASE WHEN o_orderkey % 29 = 0 THEN 'digest' END AS signature_error"]),
    "metrics": ("lineitem", [
        "l_suppkey AS archive_id", "l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS ordinal", "l_partkey % 5 < l_suppkey % 6 AS short_name", "CAST(l_linenumber + 2 AS BIGINT) AS methods", "CAST(l_linenumber * (l_suppkey % 2) AS BIGINT) AS short_methods",
        "CAST(l_linenumber % 2 AS BIGINT) AS synthetic_methods", "CAST(l_suppkey % 5 AS BIGINT) AS encrypted_strings", "CAST(l_suppkey % 7 AS BIGINT) AS char_arrays", "CAST(l_suppkey % 11 AS BIGINT) AS builders", "CAST(l_partkey % 40 AS BIGINT) AS gotos",
        "CAST(l_suppkey % 4 AS BIGINT) AS shrinks", "CAST(l_suppkey % 13 AS BIGINT) AS smokes", "CAST(l_suppkey % 17 AS BIGINT) AS throws"]),
    "asset_paths": ("part", [
        "p_partkey AS unit_id", "concat(CASE p_size % 9 WHEN 0 THEN 'assets/minecraft/' WHEN 1 THEN 'mod/lang/' WHEN 2 THEN 'textures/' WHEN 3 THEN 'x/shaders/' WHEN 4 THEN 'font/' WHEN 5 THEN 'Assets/' WHEN 6 THEN 'com/acme/' WHEN 7 THEN 'lang/' ELSE 'x/assets/minecraft/' END, replace(p_name, ' ', '_'),"
        " CASE p_partkey % 9 WHEN 0 THEN '.png' WHEN 1 THEN '.json' WHEN 2 THEN '.class' WHEN 3 THEN '.vsh' WHEN 4 THEN '.woff2x' WHEN 5 THEN '.TTF' WHEN 6 THEN '.png?ab' WHEN 7 THEN '.pngabcdefgh' ELSE '.lang' END) AS location"]),
    "calls": ("events", [
        "event_id", "CASE event_id % 6 WHEN 0 THEN 'java/lang/Class' WHEN 1 THEN 'java/lang/reflect/Method' WHEN 2 THEN 'java/lang/reflect/Field' WHEN 3 THEN 'a/b' WHEN 4 THEN 'java/lang/invoke/MethodHandles' END AS owner",
        "CASE user_id % 6 WHEN 0 THEN 'forName' WHEN 1 THEN 'invoke' WHEN 2 THEN 'get' WHEN 3 THEN 'getMethod' WHEN 4 THEN 'lookup' ELSE 'a' END AS name", "CASE user_id % 5 WHEN 0 THEN '(I)Ljava/lang/String;' WHEN 1 THEN '(Ljava/lang/String;)Ljava/lang/String;' WHEN 2 THEN '(LWorld;LPlayer;)V' WHEN 3 THEN '(LPacket;)V' ELSE '()V' END AS descriptor"]),
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, expressions = DERIVED[name]
    return table(spark, sf_dir, source).selectExpr(*expressions)


def with_derived(sql: str, *names: str) -> str:
    """SQL with the derived tables that it reads as common table expressions."""
    parts = [f"{n} AS (SELECT {', '.join(DERIVED[n][1])} FROM {DERIVED[n][0]})".replace("`", '"') for n in names]
    return f"WITH {', '.join(parts)}{', ' if sql.lstrip().startswith('#') else ' '}{sql.lstrip().removeprefix('#')}"
