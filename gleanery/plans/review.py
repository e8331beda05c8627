"""Queries for reviewers: findings about content and code, names, labels, lists and orders."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import names as N
from ..functions import text as T
from ..operators import joins as J
from ..operators import matching as M
from ..operators import rules as R
from ..operators import scoring as S
from .base import derived, query, table, with_derived
from .linking import _REFS, _TERMS, _references, _terms

_ASSET = """(regexp_matches(l, '^assets/minecraft/|/assets/minecraft/') OR (regexp_matches(l, '(^|/)lang/') AND regexp_matches(l, '\\.(json|lang)'))
 OR (regexp_matches(l, '^assets/|/assets/|textures/|sounds/|models/|shaders/|/lang/|font/') AND regexp_matches(l, '\\.(png|jpg|jpeg|gif|bmp|tga|webp|ogg|wav|mp3|flac|ttf|otf|woff|woff2|vsh|fsh|glsl|shader|mcmeta|nbt|obj|mtl).{0,3}$')))"""


@query(with_derived(f"SELECT unit_id, location FROM (SELECT *, lower(location) AS l FROM asset_paths) WHERE NOT {_ASSET}", "asset_paths"))
def hits_beside_assets(spark: SparkSession, d: str) -> DataFrame:
    """Hits that do not lie in game data."""
    return M.without_assets(derived(spark, d, "asset_paths")).select("unit_id", "location")


@query(with_derived(f"SELECT unit_id, {_ASSET} AS asset FROM (SELECT *, lower(location) AS l FROM asset_paths)", "asset_paths"))
def asset_flags(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "asset_paths").select("unit_id", N.is_asset_path(F.col("location")).alias("asset"))


_MANIFEST = """#m AS (SELECT archive_id, CASE WHEN archive_id % 6 = 5 THEN 'm.M' END AS main_class, CASE WHEN archive_id % 6 = 0 THEN 'a.B' END AS premain_class, CASE WHEN archive_id % 6 = 1 THEN 'c.D' END AS agent_class, CASE WHEN archive_id % 6 = 2 THEN 't.T' END AS tweak_class, contains(text, 'FMLCorePlugin') AS core_plugin FROM manifests)"""


@query(with_derived(_MANIFEST + " SELECT * FROM m", "manifests"))
def manifest_facts(spark: SparkSession, d: str) -> DataFrame:
    """What manifests name."""
    return S.manifest_facts(derived(spark, d, "manifests"))


@query(with_derived(_MANIFEST + """ SELECT archive_id AS unit_id, 'agent' AS rule, 'HIGH' AS severity, 1::BIGINT AS n FROM m WHERE premain_class IS NOT NULL OR agent_class IS NOT NULL
 UNION ALL SELECT archive_id, 'tweaker', 'MEDIUM', 1 FROM m WHERE tweak_class IS NOT NULL UNION ALL SELECT archive_id, 'core plugin', 'MEDIUM', 1 FROM m WHERE core_plugin""", "manifests"))
def manifest_findings(spark: SparkSession, d: str) -> DataFrame:
    return R.manifest_findings(S.manifest_facts(derived(spark, d, "manifests"))).select("unit_id", "rule", "severity", "n")


@query(with_derived("SELECT archive_id AS unit_id, 'high entropy' AS rule, 'MEDIUM' AS severity, count(*)::BIGINT AS n FROM blobs WHERE bytes >= 2048 AND entropy >= 7.5 AND magic IS NULL AND name LIKE 'data/%' GROUP BY archive_id", "blobs"))
def content_findings(spark: SparkSession, d: str) -> DataFrame:
    """Dense binaries that nothing explains."""
    return R.content_findings(derived(spark, d, "blobs")).select("unit_id", "rule", "severity", "n")


@query(with_derived("""SELECT unit_id, 'nested skipped' AS rule, 'LOW' AS severity FROM reads WHERE depth >= 2 UNION ALL SELECT unit_id, 'nested failed', 'MEDIUM' FROM reads WHERE nested_error IS NOT NULL
 UNION ALL SELECT unit_id, 'incomplete', 'MEDIUM' FROM reads WHERE truncated UNION ALL SELECT unit_id, 'bad signature', 'MEDIUM' FROM reads WHERE signature_error IS NOT NULL""", "reads"))
def reading_findings(spark: SparkSession, d: str) -> DataFrame:
    return R.reading_findings(derived(spark, d, "reads")).select("unit_id", "rule", "severity")


@query(with_derived("SELECT archive_id, count(*) > 5 OR sum(usize) > 2000000 AS truncated FROM entries GROUP BY archive_id", "entries"))
def truncated_reads(spark: SparkSession, d: str) -> DataFrame:
    """Archives over the reading budget are flagged, not silently clean."""
    return R.truncated_reads(derived(spark, d, "entries"), 5, 2_000_000)


_CARD = """#c AS (SELECT archive_id AS unit_id, (count(*) FILTER (parsed))::BIGINT AS classes, (count(*) FILTER (NOT parsed))::BIGINT AS unparseable, (count(*) FILTER (parsed AND length(simple_name) <= 2))::BIGINT AS short_names,
 (count(*) FILTER (parsed AND simple_name = 'Illl1O'))::BIGINT AS barcode, (count(*) FILTER (parsed AND contains(simple_name, 'Kill')))::BIGINT AS invisible, (count(*) FILTER (parsed AND contains(simple_name, 'Caf')))::BIGINT AS non_ascii,
 coalesce(sum(member_count) FILTER (parsed), 0)::BIGINT AS members, coalesce(sum(short_members) FILTER (parsed), 0)::BIGINT AS short_members, coalesce(sum(synthetic_members) FILTER (parsed), 0)::BIGINT AS synthetic,
 (count(*) FILTER (parsed AND NOT has_source))::BIGINT AS no_source, coalesce(sum(decrypt_calls) FILTER (parsed), 0)::BIGINT AS decrypt_calls FROM facts GROUP BY archive_id),
r AS (SELECT *, coalesce(short_names / nullif(classes, 0), 0) AS cs, coalesce(short_members / nullif(members, 0), 0) AS ms, coalesce(decrypt_calls / nullif(classes, 0), 0) AS dc, coalesce(synthetic / nullif(members, 0), 0) AS sr, coalesce(no_source / nullif(classes, 0), 0) AS ns FROM c),
o AS (SELECT *, CASE WHEN classes > 0 THEN least(1.0, 0.32 * cs + 0.28 * ms + 0.20 * least(dc / 2, 1.0) + 0.05 * least(sr / 0.35, 1.0) + 0.05 * ns + CASE WHEN barcode > 0 THEN 0.1 ELSE 0 END + CASE WHEN invisible > 0 THEN 0.2 ELSE 0 END + CASE WHEN non_ascii > 0.1 * classes THEN 0.1 ELSE 0 END) ELSE 0.0 END AS score,
 (cs > 0.45)::INT + (ms > 0.45)::INT + (dc > 1.0)::INT + (barcode > 2)::INT + (invisible > 0)::INT AS strong FROM r), v AS (SELECT *, classes > 0 AND (score >= 0.45 OR strong >= 2 OR invisible > 0) AS obfuscated FROM o)"""


@query(with_derived(_CARD + " SELECT * FROM c", "facts"))
def class_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """Shapes of names and members for each archive."""
    return S.class_scorecard(derived(spark, d, "facts"))


@query(with_derived(_CARD + " SELECT unit_id, round(score, 6) AS score, obfuscated, CASE WHEN NOT obfuscated THEN '' WHEN invisible > 0 THEN 'unicode' WHEN barcode > 2 THEN 'barcode' WHEN cs > 0.6 AND dc < 0.3 THEN 'renamer' ELSE 'generic' END AS guess FROM v", "facts"))
def obfuscation_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Score, decision and guess, all inputs counted from the classes."""
    return S.judged(S.class_scorecard(derived(spark, d, "facts"))).select("unit_id", F.round("score", 6).alias("score"), "obfuscated", "guess")


@query(with_derived(_CARD + """, k AS (SELECT DISTINCT unit_id, CASE WHEN unit_id % 2 = 0 THEN 'ProGuard' ELSE 'Allatori' END AS marker FROM v WHERE unit_id % 3 < 2)
 SELECT unit_id, 'bad classes' AS rule, CASE WHEN unparseable > 0.25 * (classes + unparseable) THEN 'HIGH' ELSE 'MEDIUM' END AS severity, unparseable AS n FROM v WHERE unparseable > 0
 UNION ALL SELECT unit_id, 'obfuscated', 'HIGH', 1 FROM v WHERE obfuscated UNION ALL SELECT unit_id, 'invisible names', 'CRITICAL', invisible FROM v WHERE obfuscated AND invisible > 0
 UNION ALL SELECT unit_id, 'encrypted strings', 'HIGH', decrypt_calls FROM v WHERE obfuscated AND decrypt_calls > 1.5 * classes UNION ALL SELECT unit_id, 'tool marker', 'MEDIUM', count(*) FROM k JOIN v USING (unit_id) WHERE obfuscated GROUP BY unit_id""", "facts"))
def obfuscation_findings(spark: SparkSession, d: str) -> DataFrame:
    """What hidden code leaves behind."""
    facts = derived(spark, d, "facts")
    texts = facts.select(F.col("archive_id").alias("unit_id"), F.when(F.col("archive_id") % 3 == 2, "plain").when(F.col("archive_id") % 2 == 0, "made by PROGUARD").otherwise("Demo of allatori").alias("text"))
    return R.obfuscation_findings(S.judged(S.class_scorecard(facts)), M.markers(texts)).select("unit_id", "rule", "severity", "n")


_SYNTHETIC = _REFS + """, g AS (SELECT DISTINCT path FROM refs WHERE path NOT IN (SELECT path FROM archives)),
s AS (SELECT path AS name, 'ghost' AS rule, 'CRITICAL' AS severity, 'DETECTED' AS verdict, 1000::BIGINT AS score FROM g UNION ALL SELECT exe, 'attach disabled', 'HIGH', 'NOTABLE', 300 FROM processes WHERE contains(command_line, '+DisableAttachMechanism'))"""


def _synthesised(spark: SparkSession, d: str) -> DataFrame:
    ghosts = J.ghosts(_references(spark, d), derived(spark, d, "archives"))
    return R.synthesised_rows(ghosts, derived(spark, d, "processes").where(F.lower("command_line").contains("disableattachmechanism")))


@query(with_derived(_SYNTHETIC + " SELECT * FROM s", "processes", "archives"))
def synthesised_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows for what runs and can't be read."""
    return _synthesised(spark, d).select("name", "rule", "severity", "verdict", "score")


@query(with_derived(_SYNTHETIC + """, every AS (SELECT verdict FROM s UNION ALL SELECT CASE WHEN readable THEN 'CLEAN' ELSE 'UNREADABLE' END FROM archives)
 SELECT o.verdict, o.ordinal, count(every.verdict)::BIGINT AS units FROM (SELECT * FROM (VALUES ('CLEAN',0),('NOTABLE',1),('SUSPICIOUS',2),('DETECTED',3),('CRITICAL',4),('UNREADABLE',5)) o(verdict, ordinal)) o LEFT JOIN every USING (verdict) GROUP BY ALL""", "processes", "archives"))
def recounted_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdict counts with the synthesised rows among the analysed ones."""
    analysed = derived(spark, d, "archives").select(F.when(F.col("readable"), "CLEAN").otherwise("UNREADABLE").alias("verdict"))
    return S.verdict_counts(analysed.unionByName(_synthesised(spark, d).select("verdict")), dims.verdict_table(spark))


@query(with_derived("""SELECT unit_id, CASE WHEN encrypted THEN 'encrypted' WHEN obfuscated THEN CASE unit_id % 3 WHEN 0 THEN 'obfuscated: Allatori' ELSE 'obfuscated' END WHEN outcome = 'NOT_AN_ARCHIVE' THEN 'not an archive' WHEN broken THEN 'broken' ELSE '' END AS reason,
 CASE WHEN outcome = 'POOL_SCANNED' AND unreadable > 0 THEN concat("read", ' / ', "read" + unreadable) ELSE outcome END AS summary, CASE WHEN "read" + unreadable = 0 THEN 'NO_CLASSES' WHEN "read" = 0 THEN 'FAILED' ELSE 'POOL_SCANNED' END AS told FROM units""", "units"))
def unit_labels(spark: SparkSession, d: str) -> DataFrame:
    """Reasons, reading summaries and outcomes for people."""
    tool = F.when(F.col("unit_id") % 3 == 0, " Allatori ").when(F.col("unit_id") % 3 == 1, "Generic")
    c = F.col
    return derived(spark, d, "units").select("unit_id", N.suspicion_reason(c("outcome"), c("encrypted"), c("obfuscated"), c("broken"), tool).alias("reason"), N.read_summary(c("outcome"), c("read"), c("unreadable")).alias("summary"), N.read_outcome(c("read") + c("unreadable"), c("read")).alias("told"))


@query(with_derived("SELECT seq, unit_id, severity FROM events_findings ORDER BY CASE severity WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 50 WHEN 'MEDIUM' THEN 20 WHEN 'LOW' THEN 5 ELSE 0 END DESC, seq LIMIT 200", "events_findings"))
def gravest_findings(spark: SparkSession, d: str) -> DataFrame:
    """The first page of findings."""
    return derived(spark, d, "events_findings").orderBy(*S.findings_order()).limit(200).select("seq", "unit_id", "severity")


@query(with_derived("SELECT archive_id, name FROM archives ORDER BY lower(name), archive_id LIMIT 100", "archives"))
def ordered_targets(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "archives").orderBy(F.lower("name"), "archive_id").limit(100).select("archive_id", "name")


@query(with_derived("""#f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY ordinal) AS n FROM metrics) WHERE n <= 30),
a AS (SELECT archive_id, count(*)::BIGINT AS classes, count(*) FILTER (short_name) / count(*) AS cs, sum(short_methods) / sum(methods) AS ms, sum(methods) AS methods, sum(synthetic_methods) AS sy, sum(encrypted_strings) AS en, sum(char_arrays) AS ca, sum(builders) AS bu, sum(gotos) AS go, sum(shrinks) AS sh, sum(smokes) AS sm, sum(throws) AS th FROM f GROUP BY archive_id),
s AS (SELECT *, 0.35 * cs + 0.35 * ms + CASE WHEN en > 2 * classes THEN 0.2 ELSE 0 END + CASE WHEN ca > classes THEN 0.1 ELSE 0 END + CASE WHEN sy > 0.3 * methods THEN 0.1 ELSE 0 END + CASE WHEN go > 5 * methods THEN 0.05 ELSE 0 END AS score, cs > 0.5 OR ms > 0.5 AS short, en > 2 * classes OR ca > classes AS hidden FROM a),
o AS (SELECT *, score > 0.3 OR short OR hidden AS obfuscated FROM s)
SELECT archive_id, classes, round(score, 6) AS score, obfuscated, hidden, CASE WHEN NOT obfuscated THEN 'none' WHEN hidden AND ca > 3 * classes THEN 'Stringer' WHEN hidden AND bu > 5 * classes THEN 'Allatori' WHEN short AND NOT hidden AND sy > 0.2 * methods THEN 'DashO' WHEN hidden AND sh > 3 * classes AND NOT short THEN 'JShrink'
 WHEN hidden AND sm > 2 * classes AND th > methods THEN 'Smokescreen' WHEN short AND NOT hidden THEN 'ProGuard' WHEN hidden AND score > 0.6 THEN 'ZKM' ELSE 'generic' END AS kind FROM o""", "metrics"))
def instruction_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """The second score, out of instruction counts."""
    return S.instruction_scorecard(derived(spark, d, "metrics")).withColumn("score", F.round("score", 6))


@query(with_derived("SELECT archive_id AS unit_id, list(simple_name ORDER BY ordinal)[1:12] AS names FROM facts GROUP BY archive_id", "facts"))
def sample_names(spark: SparkSession, d: str) -> DataFrame:
    return S.sample_names(derived(spark, d, "facts").select(F.col("archive_id").alias("unit_id"), "ordinal", F.col("simple_name").alias("name")))


_NAMES = "n AS (SELECT p_partkey AS id, CASE p_partkey % 10 WHEN 0 THEN 'fabric.mod.json' WHEN 1 THEN 'META-INF/mods.toml' WHEN 2 THEN 'plugin.yml' WHEN 3 THEN 'Guava-31.jar' WHEN 4 THEN 'mod-sources.jar' WHEN 5 THEN 'client.jar' WHEN 6 THEN 'org/apache/commons/A.class' WHEN 7 THEN 'com/acme/javax/B.class' WHEN 8 THEN 'java/lang/C.class' ELSE concat(replace(p_name, ' ', '-'), '.jar') END AS name FROM part)"


def _part_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(_NAMES[_NAMES.index("SELECT ") + 7:_NAMES.index(" AS id")] + " AS id", _NAMES[_NAMES.index("CASE"):_NAMES.index(" AS name")] + " AS name")


@query(f"WITH {_NAMES} SELECT id, CASE id % 10 WHEN 0 THEN 'Fabric' WHEN 1 THEN 'Forge' WHEN 2 THEN 'Bukkit/Spigot' END AS loader, id % 10 IN (3, 4) AS library, id % 10 IN (6, 8) AS standard FROM n")
def name_origins(spark: SparkSession, d: str) -> DataFrame:
    """Whose a file is, by its name."""
    name = F.col("name")
    return _part_names(spark, d).select("id", N.mod_loader(name).alias("loader"), N.is_library_name(name).alias("library"), N.is_standard_package(name).alias("standard"))


@query(f"WITH {_NAMES} SELECT id, name FROM n WHERE id % 10 NOT IN (6, 8)")
def own_packages(spark: SparkSession, d: str) -> DataFrame:
    """Names outside the platform's packages, by an anti join."""
    return J.without_prefixed(_part_names(spark, d), spark.createDataFrame([(p,) for p in N.STANDARD_PACKAGES], "prefix string")).select("id", "name")


@query(with_derived("SELECT event_id, coalesce(owner, 'java/') = 'a/b' AND descriptor IN ('(I)Ljava/lang/String;', '(Ljava/lang/String;)Ljava/lang/String;') AS decrypts FROM calls", "calls"))
def decrypt_calls(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "calls").select("event_id", N.is_decrypt_call(F.col("owner"), F.col("descriptor")).alias("decrypts"))


@query(with_derived("""SELECT event_id, CASE WHEN owner = 'java/lang/reflect/Method' THEN 'Method.invoke' WHEN name = 'forName' THEN 'Class.forName' WHEN name = 'getMethod' THEN 'Class.getMethod' WHEN owner LIKE '%Field' THEN 'Field.get' ELSE concat('MethodHandles.', name) END AS type FROM calls
 WHERE (owner = 'java/lang/Class' AND name IN ('forName', 'getMethod')) OR (owner = 'java/lang/reflect/Method' AND name = 'invoke') OR (owner = 'java/lang/reflect/Field' AND name = 'get') OR (owner = 'java/lang/invoke/MethodHandles' AND name IN ('lookup', 'invoke'))""", "calls"))
def reflection_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls that reach something by name."""
    return J.reflection_calls(derived(spark, d, "calls")).select("event_id", "type")


@query("SELECT p_partkey AS id, text FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('Acme.', p_type) WHEN 1 THEN concat('acme.', p_type) ELSE p_brand END AS text FROM part) WHERE text LIKE 'Acme.%'")
def class_name_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey AS id", "CASE p_partkey % 3 WHEN 0 THEN concat('Acme.', p_type) WHEN 1 THEN concat('acme.', p_type) ELSE p_brand END AS text")
    return J.class_name_texts(rows)


@query(with_derived("""SELECT event_id, concat(CASE WHEN contains(descriptor, 'Player') THEN 'handlePlayer' WHEN contains(descriptor, 'Packet') THEN 'handlePacket' ELSE 'method' END, ('0x' || substr(md5(concat(coalesce(owner, ''), '.', name, descriptor)), 1, 8))::BIGINT % 100000) AS method,
 concat('field', ('0x' || substr(md5(concat(coalesce(owner, ''), '.', name, descriptor)), 1, 8))::BIGINT % 100000) AS field, concat('deobf/', CASE WHEN owner IS NULL OR owner = 'a/b' THEN 'Class' ELSE left(regexp_extract(owner, '[^/]*$'), 20) END, ('0x' || substr(md5(name), 1, 8))::BIGINT % 100000) AS class FROM calls""", "calls"))
def stable_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that depend on nothing but what they stand for."""
    owner = F.coalesce("owner", F.lit(""))
    c = F.col
    return derived(spark, d, "calls").select("event_id", N.method_name(owner, c("name"), c("descriptor")).alias("method"), N.field_name(owner, c("name"), c("descriptor")).alias("field"), N.class_name(c("name"), c("owner")).alias("class"))


_MEMBERS = """SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 16 AS access, CASE l_partkey % 7 WHEN 0 THEN 'a' WHEN 1 THEN 'aB' WHEN 2 THEN 'toString' WHEN 3 THEN 'abc' WHEN 4 THEN '<init>' WHEN 5 THEN 'x$' ELSE '-1' END AS name,
 CASE l_suppkey % 5 WHEN 0 THEN '(LEntityPlayer;)V' WHEN 1 THEN '(LChatLine;)V' WHEN 2 THEN '(I)V' WHEN 3 THEN '()Z' ELSE '(LItemStack;)V' END AS descriptor,
 concat('com/', CASE l_linenumber % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'bc' ELSE 'Widget' END) AS owner, CASE l_linenumber % 4 WHEN 0 THEN 'java/lang/Object' WHEN 1 THEN 'x/ab' WHEN 2 THEN 'x/AbstractThingOfAVeryLongName' END AS parent,
 CASE l_orderkey % 3 WHEN 0 THEN 'y/Runnable' WHEN 1 THEN 'y/z' END AS interface FROM lineitem"""
#: Between two columns: a comma that follows an alias.
_SPLIT = re.compile(r"(?<=AS id),|(?<=AS access),|(?<=AS name),|(?<=AS descriptor),|(?<=AS owner),|(?<=AS parent),")
_NUMBER = "('0x' || substr(md5({}), 1, 8))::BIGINT % 100000"


@query(f"""WITH m AS ({_MEMBERS}), s AS (SELECT *, regexp_matches(name, '^[a-zA-Z0-9_$]{{1,2}}$') AS short, length(split_part(owner, '/', 2)) <= 2 AS short_owner, CASE WHEN parent LIKE '%Abstract%' THEN 'AbstractThingOfAVery' WHEN interface = 'y/Runnable' THEN 'Runnable' ELSE 'Class' END AS base FROM m)
SELECT id, CASE WHEN short THEN (CASE WHEN descriptor LIKE '%Player%' THEN 'handlePlayer' WHEN descriptor LIKE '%ItemStack%' THEN 'handleItem' WHEN descriptor LIKE '%Chat%' THEN 'handleChat'
 WHEN access & 1 = 1 AND access & 8 = 0 THEN 'publicMethod' WHEN access & 2 = 2 THEN 'privateMethod' WHEN access & 4 = 4 THEN 'protectedMethod' ELSE 'method' END) || {_NUMBER.format("owner || '.' || name || descriptor")} ELSE name END AS method,
 CASE WHEN short_owner THEN 'deobf/' || base || {_NUMBER.format("owner")} ELSE owner END AS class FROM s""")
def renamed_members(spark: SparkSession, d: str) -> DataFrame:
    """New names for members and classes whose own says nothing; telling names and those known by contract stay."""
    c = F.col
    rows = table(spark, d, "lineitem").selectExpr(*[x.strip() for x in _SPLIT.split(_MEMBERS.removeprefix("SELECT ").removesuffix(" FROM lineitem"))])
    method = N.renamed(c("name"), N.method_name(c("owner"), c("name"), c("descriptor"), c("access")))
    return rows.select("id", method.alias("method"), N.renamed(c("owner"), N.class_name(c("owner"), c("parent"), c("interface"))).alias("class"))


@query("SELECT s_suppkey AS pid, s_suppkey % 4 = 1 AS game FROM supplier")
def game_processes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").selectExpr("s_suppkey", "CASE s_suppkey % 4 WHEN 1 THEN 'C:/PrismLauncher/x' ELSE s_name END AS exe")
    return rows.select(F.col("s_suppkey").alias("pid"), N.is_game_process(F.col("exe"), F.lit(None).cast("string")).alias("game"))


@query("SELECT s_suppkey AS pid, s_suppkey % 9 < 3 AS plausible FROM supplier WHERE s_suppkey % 9 <> 8")
def plausible_paths(spark: SparkSession, d: str) -> DataFrame:
    """Which words of a command line may be files."""
    word = F.element_at(F.array(*[F.lit(p) for p in ("C:/x/y.jar", "C:\\x\\y.jar", "\\\\srv\\a.jar", "-C:/x.jar", "C:/a$b.jar", "/unix/x.jar", "C:/no/extension", "C:/d.ir/file", "C:a.jar")]), (F.col("s_suppkey") % 9 + 1).cast("int"))
    return table(spark, d, "supplier").where("s_suppkey % 9 <> 8").select(F.col("s_suppkey").alias("pid"), N.is_plausible_path(word).alias("plausible"))


@query(with_derived("SELECT DISTINCT archive_id FROM entries WHERE lower(name) LIKE '%.class' OR lower(name) = 'meta-inf/manifest.mf'", "entries"))
def archives_with_code(spark: SparkSession, d: str) -> DataFrame:
    return J.with_code(derived(spark, d, "archives"), derived(spark, d, "entries")).select("archive_id")


@query("""WITH u AS (SELECT c_custkey AS unit_id, c_custkey % 7 = 0 AS encrypted, c_custkey % 11 = 0 AS obfuscated FROM customer), l AS (SELECT c_custkey AS child, c_custkey // 2 AS parent FROM customer WHERE c_custkey % 2 = 1 AND c_custkey > 1),
e AS (SELECT * FROM u UNION ALL SELECT parent, encrypted, obfuscated FROM u JOIN l ON unit_id = child UNION ALL SELECT b.parent, encrypted, obfuscated FROM u JOIN l a ON unit_id = a.child JOIN l b ON a.parent = b.child)
SELECT unit_id, bool_or(encrypted) AS encrypted, bool_or(obfuscated) AS obfuscated FROM e GROUP BY unit_id""")
def outermost_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of nested units reach the outermost one."""
    rows = table(spark, d, "customer")
    flags = rows.selectExpr("c_custkey AS unit_id", "c_custkey % 7 = 0 AS encrypted", "c_custkey % 11 = 0 AS obfuscated")
    return J.flags_of_outermost(flags, rows.where("c_custkey % 2 = 1 AND c_custkey > 1").selectExpr("c_custkey AS child_id", "c_custkey div 2 AS parent_id"))


@query(f"WITH {_TERMS} SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'key.grave' ELSE severity END AS description FROM t")
def term_migration(spark: SparkSession, d: str) -> DataFrame:
    """Former descriptions become keys; what a user wrote stays."""
    former = spark.createDataFrame([("CRITICAL", "key.grave"), ("critical", "key.none")], "old string, key string")
    return J.migrated(_terms(spark, d).withColumn("description", F.col("severity")), former).select("item_id", "description")


@query(f"WITH {_TERMS} SELECT item_id FROM t WHERE contains(lower(pattern), 'th') OR severity = 'LOW'")
def term_search(spark: SparkSession, d: str) -> DataFrame:
    rows = _terms(spark, d).withColumn("description", F.when(F.col("severity") == "LOW", "With TH inside"))
    return J.search_terms(rows, "Th").select("item_id")


@query(with_derived("SELECT archive_id, CASE WHEN s >= 300 THEN 'high' WHEN s >= 120 THEN 'raised' WHEN s >= 40 THEN 'some' ELSE 'low' END AS band FROM (SELECT archive_id, size_bytes % 400 AS s FROM archives)", "archives"))
def score_bands(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "archives").select("archive_id", N.score_band(F.col("size_bytes") % 400).alias("band"))


@query("SELECT user_id AS unit_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def first_events(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each key."""
    return J.first_of(table(spark, d, "events"), ["user_id"], [F.col("event_id")]).select(F.col("user_id").alias("unit_id"), "event_id")


@query("SELECT doc_id, regexp_extract_all(text, '[ -~]{4,}') AS runs FROM documents")
def printable_runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.printable_runs(F.encode("text", "UTF-8")).alias("runs"))
