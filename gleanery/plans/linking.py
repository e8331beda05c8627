"""Queries that join: term lists, processes and files, lineage, paths, volumes, decoding and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import names as N
from ..functions import text as T
from ..operators import decode as C
from ..operators import joins as J
from ..operators import matching as M
from .base import derived, query, table, with_derived


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """A term list out of the benchmark's first words, graded by their ids."""
    first = F.regexp_extract("text", r"^(\S+)", 1)
    severity = F.when(F.col("item_id") % 3 == 0, "CRITICAL").when(F.col("item_id") % 3 == 1, "HIGH").otherwise("LOW")
    return table(spark, d, "benchmark").select("item_id", first.alias("pattern"), F.lit("WORD").alias("kind"), severity.alias("severity"), F.lit("benchmark").alias("category"))


_TERMS = "t AS (SELECT item_id, regexp_extract(text, '^(\\S+)', 1) AS pattern, 'WORD' AS kind, CASE item_id % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'LOW' END AS severity, 'benchmark' AS category FROM benchmark)"


@query(f"WITH {_TERMS} SELECT item_id, pattern, severity FROM t WHERE severity IN ('HIGH', 'CRITICAL') AND lower(pattern) NOT IN (SELECT lower(pattern) FROM t WHERE item_id % 2 = 0)")
def term_tamper(spark: SparkSession, d: str) -> DataFrame:
    """Grave terms that an edited list has lost."""
    terms = _terms(spark, d)
    return J.tampered(terms, terms.where("item_id % 2 = 0")).select("item_id", "pattern", "severity")


@query(f"WITH {_TERMS}, c AS (SELECT DISTINCT pattern FROM t WHERE item_id < 20), i AS (SELECT DISTINCT pattern FROM t WHERE item_id >= 10) SELECT pattern, false AS added FROM c UNION ALL SELECT pattern, true FROM i WHERE pattern NOT IN (SELECT pattern FROM c)")
def term_merge(spark: SparkSession, d: str) -> DataFrame:
    terms = _terms(spark, d)
    of = lambda when: terms.where(when).select("pattern", "kind").distinct()
    return J.merged(of("item_id < 20"), of("item_id >= 10")).select("pattern", "added")


@query(f"WITH {_TERMS} SELECT category, severity, count(*)::BIGINT AS terms, (count(*) FILTER (item_id % 4 > 0))::BIGINT AS active, count(DISTINCT pattern)::BIGINT AS patterns FROM t GROUP BY ALL")
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    return J.term_counts(_terms(spark, d).withColumn("enabled", F.col("item_id") % 4 > 0))


_REFS = """#a AS (SELECT pid, regexp_extract_all(command_line, '(?:[^ "]|"[^"]*")+') AS args FROM processes), x AS (SELECT pid, replace(unnest(args[2:]), '"', '') AS arg FROM a),
refs AS (SELECT DISTINCT pid, path FROM (SELECT pid, regexp_extract(arg, '^-javaagent:([^=]*)', 1) AS path FROM x WHERE starts_with(arg, '-javaagent:') UNION ALL SELECT pid, trim(unnest(string_split(arg, ';'))) FROM x WHERE NOT starts_with(arg, '-')) WHERE path LIKE '%.jar')"""


def _references(spark: SparkSession, d: str) -> DataFrame:
    words = derived(spark, d, "processes").select("pid", T.command_words(F.col("command_line")).alias("args"))
    plain = F.flatten(F.transform(F.filter("args", lambda a: ~a.startswith("-")), lambda a: T.path_list(a)))
    # The program itself is argument 0.
    words = words.withColumn("args", F.slice("args", 2, F.greatest(F.size("args") - 1, F.lit(0))))
    return words.select("pid", F.explode(F.concat(T.agent_paths(F.col("args")), plain)).alias("path")).where("path LIKE '%.jar'").distinct()


@query(with_derived(_REFS + " SELECT pid, path FROM refs WHERE path NOT IN (SELECT path FROM archives)", "processes", "archives"))
def ghost_files(spark: SparkSession, d: str) -> DataFrame:
    """Archives that running processes use and no disk has."""
    return J.ghosts(_references(spark, d), derived(spark, d, "archives")).select("pid", "path")


@query(with_derived(_REFS + " SELECT pid, path FROM refs WHERE path IN (SELECT path FROM archives WHERE archive_id % 10 <> 0)", "processes", "archives"))
def running_files(spark: SparkSession, d: str) -> DataFrame:
    return J.present(_references(spark, d), derived(spark, d, "archives").withColumn("directory", F.col("archive_id") % 10 == 0)).select("pid", "path")


@query(with_derived("SELECT pid, lower(regexp_extract(exe, '[^/]+$')) IN ('java.exe', 'javaw.exe') AS jvm, contains(lower(command_line), 'disableattachmechanism') AS closed, lower(regexp_extract(exe, '[^/]+$')) IN ('java.exe', 'javaw.exe') AND pid NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) AS hidden FROM processes", "processes"))
def process_flags(spark: SparkSession, d: str) -> DataFrame:
    """JVMs, those closed to inspection and those that no JVM list shows."""
    rows = derived(spark, d, "processes")
    listed = rows.where("pid % 2 = 0").select("pid", F.lit(True).alias("_listed"))
    jvm = N.is_jvm_process(F.col("exe"))
    return rows.join(listed, "pid", "left").select("pid", jvm.alias("jvm"), F.lower("command_line").contains("disableattachmechanism").alias("closed"), (jvm & F.col("_listed").isNull()).alias("hidden"))


@query(with_derived("""#up AS (SELECT DISTINCT user_id AS child, user_id // 2 AS parent FROM events WHERE user_id % 2 = 1), f AS (SELECT * FROM events_findings)
SELECT seq, coalesce(b.parent, a.parent, f.unit_id) AS unit_id, CASE WHEN a.parent IS NULL THEN f.source ELSE 'NESTED_JAR' END AS source,
 CASE WHEN b.parent IS NOT NULL THEN concat('n', b.child, '!n', a.child, '!', location) WHEN a.parent IS NOT NULL THEN concat('n', a.child, '!', location) ELSE location END AS location
FROM f LEFT JOIN up a ON f.unit_id = a.child LEFT JOIN up b ON a.parent = b.child""", "events_findings"))
def nested_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Findings of nested units under their outermost ones, two levels up."""
    users = table(spark, d, "events").select("user_id").where("user_id % 2 = 1").distinct()
    lineage = users.select(F.col("user_id").alias("child_id"), F.expr("user_id div 2").alias("parent_id"), F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("entry"))
    return J.reparented(derived(spark, d, "events_findings"), lineage).select("seq", "unit_id", "source", "location")


@query("""WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey <= 1 THEN c_custkey ELSE c_custkey // 3 END AS parent_id, 'c' || c_custkey AS name FROM customer),
p AS (SELECT id, name AS path FROM n WHERE id = parent_id UNION ALL SELECT n.id, p.path || '/' || n.name FROM n JOIN p ON n.parent_id = p.id WHERE n.id <> n.parent_id) SELECT id, path FROM p""")
def rebuilt_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths out of parent ids by doubling."""
    nodes = table(spark, d, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey <= 1 THEN c_custkey ELSE c_custkey div 3 END AS parent_id", "concat('c', c_custkey) AS name")
    return J.full_paths(nodes)


@query("""WITH u AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS path FROM pages), m AS (SELECT string_split(path, '/') AS s FROM u WHERE contains(path, '/en/')),
a AS (SELECT DISTINCT array_to_string(s[1:k], '/') AS path FROM (SELECT s, unnest(range(1, len(s) + 1)) AS k FROM m)), nodes AS (SELECT path FROM u UNION SELECT regexp_extract(path, '^[^/]*') FROM u) SELECT path FROM nodes WHERE path IN (SELECT path FROM a)""")
def hierarchy_filter(spark: SparkSession, d: str) -> DataFrame:
    """Tree nodes that match, and those above them."""
    urls = table(spark, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")).distinct()
    nodes = urls.union(urls.select(F.regexp_extract("path", "^[^/]*", 0))).distinct()
    return J.with_ancestors(urls.where(F.col("path").contains("/en/")), nodes)


@query(with_derived("SELECT volume, reported, resolved, reported < 20 OR resolved >= 0.5 * reported AS trusted FROM (SELECT concat('v', l_suppkey % 7) AS volume, count(*)::BIGINT AS reported, count(a.path)::BIGINT AS resolved FROM lineitem LEFT JOIN (SELECT DISTINCT path FROM archives) a ON a.path = concat('/vol', l_suppkey % 3, '/lib/mod', l_orderkey, '.jar') GROUP BY 1)", "archives"))
def trusted_volumes(spark: SparkSession, d: str) -> DataFrame:
    reported = table(spark, d, "lineitem").selectExpr("concat('v', l_suppkey % 7) AS volume", "concat('/vol', l_suppkey % 3, '/lib/mod', l_orderkey, '.jar') AS path")
    return J.trusted_volumes(reported, derived(spark, d, "archives"))


@query("SELECT concat('v', o_custkey % 3) AS volume, min_by(o_orderkey, o_orderkey) AS first, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    """One row for each derived name, the first one."""
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "concat('v', o_custkey % 3) AS volume")
    return rows.groupBy("volume").agg(F.min("o_orderkey").alias("first"), F.count("*").alias("n"))


@query("WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/]{20,}={0,2}')) AS run FROM documents), b AS (SELECT *, rtrim(run, '=') AS bare FROM r) SELECT doc_id AS unit_id, run, octet_length(from_base64(CASE WHEN length(bare) % 4 <> 1 THEN rpad(bare, ((length(bare) + 3) // 4 * 4)::INTEGER, '=') END))::INTEGER AS bytes FROM b WHERE length(bare) % 4 <> 1 AND (run = bare OR length(run) % 4 = 0)")
def base64_runs(spark: SparkSession, d: str) -> DataFrame:
    found = C.base64_runs(table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text"))
    return found.select("unit_id", "run", F.octet_length("content").alias("bytes"))


@query("WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/]{20,}={0,2}')) AS run FROM documents), b AS (SELECT *, rtrim(run, '=') AS bare FROM r) SELECT doc_id AS unit_id, run, hex(from_base64(CASE WHEN length(bare) % 4 <> 1 THEN rpad(bare, ((length(bare) + 3) // 4 * 4)::INTEGER, '=') END)) AS content FROM b WHERE length(bare) % 4 <> 1 AND (run = bare OR length(run) % 4 = 0)")
def base64_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Every base64 run that decodes, padded ones too."""
    found = C.base64_runs(table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text"))
    return found.select("unit_id", "run", F.hex("content").alias("content"))


@query("SELECT item_id, text, reverse(text) AS reversed, translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM') AS rotated, translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'zyxwvutsrqponmlkjihgfedcbaZYXWVUTSRQPONMLKJIHGFEDCBA') AS mirrored, regexp_replace(text, '(.)(.)', '\\2\\1', 'gs') AS swapped FROM benchmark")
def simple_ciphers(spark: SparkSession, d: str) -> DataFrame:
    head = F.col("text")
    return table(spark, d, "benchmark").select("item_id", "text", F.reverse(head).alias("reversed"), C.rotated(head, 13).alias("rotated"), C.mirrored(head).alias("mirrored"), C.pairs_swapped(head).alias("swapped"))


@query("SELECT item_id, text, reverse(text) AS reversed, translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM') AS rotated, translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'zyxwvutsrqponmlkjihgfedcbaZYXWVUTSRQPONMLKJIHGFEDCBA') AS mirrored, regexp_replace(text, '(.)(.)', '\\2\\1', 'gs') AS swapped FROM benchmark")
def whole_ciphers(spark: SparkSession, d: str) -> DataFrame:
    """The ciphers of simple_ciphers over whole texts."""
    whole = F.col("text")
    return table(spark, d, "benchmark").select("item_id", "text", F.reverse(whole).alias("reversed"), C.rotated(whole, 13).alias("rotated"), C.mirrored(whole).alias("mirrored"), C.pairs_swapped(whole).alias("swapped"))


_PRINTABLE = "len(list_filter({0}, lambda c: c BETWEEN 32 AND 126 OR c IN (9, 10, 13)))"
_HIDDEN = "h AS (SELECT c_custkey AS unit_id, list_transform(string_split(c_name, ''), lambda c: {0}) AS codes FROM customer)"


def _hidden(spark: SparkSession, d: str, change) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("unit_id"), C._chars(F.col("c_name"), change).alias("text"))


@query(f"""WITH {_HIDDEN.format('xor(ord(c), 200)')}, t AS (SELECT unit_id, k, list_transform(codes, lambda c: xor(c, k)) AS plain FROM h, range(1, 256) r(k) WHERE len(list_filter(codes, lambda c: c > 127)) > 0),
g AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY k) AS n FROM t WHERE {_PRINTABLE.format('plain')} > 0.85 * len(plain)) SELECT unit_id, k::INTEGER AS key, array_to_string(list_transform(plain, lambda c: chr(c::INTEGER)), '') AS decoded FROM g WHERE n = 1""")
def xor_keys(spark: SparkSession, d: str) -> DataFrame:
    """Names hidden under single-byte keys, found again: the lowest key that makes each readable."""
    return C.with_keys(_hidden(spark, d, lambda c, i: c.bitwiseXOR(F.lit(200))), range(1, 256), C.CHANGES["xor"])


@query(f"""WITH {_HIDDEN.format('((ord(c) * 2) & 255)')}, o AS (SELECT unit_id, k, list_transform(codes, lambda c: CASE WHEN k % 2 = 0 THEN (c << (k // 2)::INTEGER) & 255 ELSE (c >> (k // 2)::INTEGER) & 255 END) AS plain FROM h, range(2, 16) r(k) WHERE len(list_filter(codes, lambda c: c > 127)) > 0),
g AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY k) AS n FROM o WHERE {_PRINTABLE.format('plain')} > 0.85 * len(plain)) SELECT unit_id, k::INTEGER AS key, array_to_string(list_transform(plain, lambda c: chr(c::INTEGER)), '') AS decoded FROM g WHERE n = 1""")
def shifted_bits(spark: SparkSession, d: str) -> DataFrame:
    """Names whose bits were moved to the left by one, found again."""
    return C.with_keys(_hidden(spark, d, lambda c, i: F.call_function("shiftleft", c, F.lit(1)).bitwiseAND(F.lit(255))), C.BIT_SHIFTS, C.CHANGES["bit shift"])


@query("""WITH h AS (SELECT c_custkey AS unit_id, list_transform(range(1, length(c_name) + 1), lambda i: xor(ord(c_name[i]), (77 * i) & 255)) AS codes FROM customer),
t AS (SELECT unit_id, k, list_transform(range(1, len(codes) + 1), lambda i: xor(codes[i], (k * i) & 255)) AS plain FROM h, range(1, 256) r(k) WHERE len(list_filter(codes, lambda c: c > 127)) > 0),
g AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY k) AS n FROM t WHERE len(list_filter(plain, lambda c: c BETWEEN 32 AND 126 OR c IN (9, 10, 13))) > 0.85 * len(plain)) SELECT unit_id, k::INTEGER AS key, array_to_string(list_transform(plain, lambda c: chr(c::INTEGER)), '') AS decoded FROM g WHERE n = 1""")
def product_keys(spark: SparkSession, d: str) -> DataFrame:
    """Names hidden under a key times the place, found again."""
    return C.with_keys(_hidden(spark, d, lambda c, i: c.bitwiseXOR((F.lit(77) * (i + 1)).bitwiseAND(F.lit(255)))), range(1, 256), C.CHANGES["xor by product"])


@query("""WITH b AS (SELECT item_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: xor(('0x' || x)::INTEGER, (item_id % 256)::INTEGER))[1:256] AS codes FROM benchmark),
s AS (SELECT item_id, k, (len(list_filter(codes, lambda c: xor(c, k::INTEGER) BETWEEN 32 AND 126 OR xor(c, k::INTEGER) IN (9, 10, 13))) * 100 // len(codes))::INTEGER AS score FROM b, range(0, 256) r(k) WHERE len(codes) > 0),
g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, k) AS n FROM s) SELECT item_id AS unit_id, score, k::INTEGER AS key FROM g WHERE n = 1 AND score >= 80""")
def byte_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key of bytes hidden under one, by the share of printable bytes."""
    codes = C.codes_of(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"))
    hidden = table(spark, d, "benchmark").select("item_id", F.transform(codes, lambda c: c.bitwiseXOR((F.col("item_id") % 256).cast("int"))).alias("codes"))
    return hidden.select(F.col("item_id").alias("unit_id"), C.byte_key(F.col("codes")).alias("k")).where("k IS NOT NULL").select("unit_id", "k.score", "k.key")


@query("""WITH h AS (SELECT c_custkey AS unit_id, list_transform(string_split(c_name, ''), lambda c, i: xor(ord(c), CASE (i - 1) % 3 WHEN 0 THEN 201 WHEN 1 THEN 150 ELSE 230 END)) AS codes FROM customer),
a AS (SELECT unit_id, size, unnest(codes) AS c, unnest(range(0, len(codes))) % size AS place FROM h, range(2, 9) r(size) WHERE len(codes) >= 2 * size AND len(list_filter(codes, lambda c: c > 127)) > 0),
v AS (SELECT unit_id, size, place, k, count(*) FILTER (xor(c, k::INTEGER) BETWEEN 32 AND 126) AS n FROM a, range(0, 256) q(k) GROUP BY ALL), b AS (SELECT unit_id, size, place, arg_max(k, n * 256 - k) AS k FROM v GROUP BY ALL),
k AS (SELECT unit_id, size, list(k ORDER BY place) AS keys FROM b GROUP BY ALL HAVING min(k) > 0), p AS (SELECT unit_id, size, list_transform(codes, lambda c, i: xor(c, keys[((i - 1) % size + 1)::INTEGER]::INTEGER)) AS plain FROM k JOIN h USING (unit_id))
SELECT unit_id, size::INTEGER AS size, array_to_string(list_transform(plain, lambda c: chr(c)), '') AS decoded FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY size) AS n FROM p WHERE len(list_filter(plain, lambda c: c BETWEEN 32 AND 126 OR c IN (9, 10, 13))) > 0.85 * len(plain)) WHERE n = 1""")
def repeating_keys(spark: SparkSession, d: str) -> DataFrame:
    """Names hidden under a key of three characters; tests compare the search with brute force."""
    turns = lambda c, i: c.bitwiseXOR(F.when(i % 3 == 0, 201).when(i % 3 == 1, 150).otherwise(230))
    return C.repeating_key(_hidden(spark, d, turns))


@query("""WITH h AS (SELECT c_custkey AS unit_id, list_transform(string_split(c_name, ''), lambda c: xor(ord(c), 90)) AS codes FROM customer), t AS (SELECT unit_id, k, list_transform(codes, lambda c: xor(c, k)) AS plain FROM h, range(1, 256) r(k)),
g AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY k) AS n FROM t WHERE len(list_filter(plain, lambda c: c BETWEEN 32 AND 126 OR c IN (9, 10, 13))) > 0.85 * len(plain)) SELECT unit_id, k::INTEGER AS key, false AS by_place, array_to_string(list_transform(plain, lambda c: chr(c::INTEGER)), '') AS decoded FROM g WHERE n = 1""")
def base64_keys(spark: SparkSession, d: str) -> DataFrame:
    """Names hidden under a key and written as base64 without padding, found again."""
    hidden = table(spark, d, "customer").select(F.col("c_custkey").alias("unit_id"), F.rtrim(F.base64(F.encode(C._chars(F.col("c_name"), lambda c, i: c.bitwiseXOR(F.lit(90))), "ISO-8859-1")), F.lit("=")).alias("text"))
    return C.base64_then_xor(hidden)


@query("WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/]{20,}={0,2}')) AS run FROM documents), b AS (SELECT *, rtrim(run, '=') AS bare FROM r), c AS (SELECT doc_id, run, from_base64(CASE WHEN length(bare) % 4 <> 1 THEN rpad(bare, ((length(bare) + 3) // 4 * 4)::INTEGER, '=') END) AS c FROM b WHERE length(bare) % 4 <> 1 AND (run = bare OR length(run) % 4 = 0)), x AS (SELECT doc_id, run, hex(c) AS h, len(list_filter(regexp_extract_all(hex(c), '..'), lambda p: p BETWEEN '20' AND '7E' OR p IN ('09', '0A', '0D'))) / octet_length(c) > 0.85 AS plain FROM c) SELECT doc_id AS unit_id, run, CASE WHEN regexp_matches(h, '^(89504E47|FFD8FF|47494638|52494646)') THEN 'image' WHEN starts_with(h, '504B0304') THEN 'zip' WHEN starts_with(h, '1F8B') THEN 'gzip' WHEN starts_with(h, 'CAFEBABE') THEN 'class' WHEN plain THEN 'text' ELSE 'binary' END AS kind FROM x")
def payload_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What the base64 runs of all texts hold."""
    found = C.base64_runs(table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text"))
    return found.select("unit_id", "run", C.payload_class(F.col("content")).alias("kind"))


@query("""WITH b AS (SELECT doc_id, doc_id % 5 AS form, text, CASE doc_id % 5 WHEN 2 THEN unhex('0B3F7B7F') ELSE unhex('8BBFFBFF') END || encode(text) AS keyed FROM documents),
f AS (SELECT *, CASE form WHEN 0 THEN text WHEN 1 THEN to_base64(encode(text)) WHEN 3 THEN to_base64(keyed) END AS shown,
 CASE form WHEN 1 THEN encode(text) WHEN 3 THEN keyed END AS inside,
 CASE form WHEN 0 THEN hex(encode(text)) WHEN 1 THEN '' WHEN 2 THEN hex(keyed) WHEN 3 THEN '' WHEN 4 THEN md5(text) END AS bytes FROM b),
t AS (SELECT *, regexp_replace(shown, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS trimmed, regexp_extract_all(upper(bytes[1:2048]), '..') AS head FROM f),
l AS (SELECT *, coalesce(length(trimmed) % 4 = 0 AND regexp_matches(trimmed, '^[A-Za-z0-9+/ \\t-\\r]+=*$') AND NOT regexp_matches(trimmed, '(the|and|import|public|class) '), false) AS looks FROM t)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN looks AND form = 3 AND NOT regexp_matches(text, '(class|import|package) ') THEN 'base64+xor' WHEN looks THEN 'base64' WHEN form = 2 THEN 'xor'
 WHEN len(list_filter(head, lambda x: x < '09' OR (x > '0D' AND x < '20') OR x > '7E')) > len(head) // 3 THEN 'binary' ELSE 'plain' END AS encoding FROM l""")
def text_encodings(spark: SparkSession, d: str) -> DataFrame:
    """How each document's bytes are written; by its id they are the text's own, in base64, behind a hidden class head, both, or a digest."""
    own = F.encode("text", "UTF-8")
    keyed = F.concat(F.unhex(F.when(F.col("doc_id") % 5 == 2, "0B3F7B7F").otherwise("8BBFFBFF")), own)
    coded = lambda b: F.encode(F.translate(F.base64(b), "\r\n", ""), "UTF-8")
    form = F.col("doc_id") % 5
    content = F.when(form == 0, own).when(form == 1, coded(own)).when(form == 2, keyed).when(form == 3, coded(keyed)).when(form == 4, F.unhex(F.md5(own)))
    rows = table(spark, d, "documents").select("doc_id", content.alias("content"))
    return rows.select("doc_id", C.encoding_class(F.col("content")).alias("encoding"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'view' THEN 'LOW' ELSE 'MEDIUM' END AS risk FROM events")
def call_classes(spark: SparkSession, d: str) -> DataFrame:
    """Events classed by a rule table; unknown types get the middle risk."""
    rules = spark.createDataFrame([("error", "HIGH"), ("view", "LOW")], "event_type string, risk string")
    rows = table(spark, d, "events").join(F.broadcast(rules), "event_type", "left")
    return rows.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce("risk", F.lit("MEDIUM")).alias("risk"))


@query("SELECT DISTINCT word AS keyword FROM (SELECT trim(source) AS word FROM documents UNION ALL SELECT trim(lang) FROM documents UNION ALL SELECT 'cheat') WHERE word <> ''")
def effective_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Default and own keywords, trimmed, each once."""
    docs = table(spark, d, "documents")
    return J.effective_keywords(docs.select(F.col("source").alias("keyword")), docs.select(F.col("lang").alias("keyword")), spark.createDataFrame([("cheat",)], "keyword string"))


@query("SELECT DISTINCT path FROM (SELECT concat('/x/', l_suppkey) AS path FROM lineitem UNION ALL SELECT concat('/x/', s_suppkey) FROM supplier)")
def distinct_targets(spark: SparkSession, d: str) -> DataFrame:
    return J.distinct_union(table(spark, d, "lineitem").selectExpr("concat('/x/', l_suppkey) AS path"), table(spark, d, "supplier").selectExpr("concat('/x/', s_suppkey) AS path"))
