"""Queries over long lists, hot units and hidden texts whose key must be found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions.names import magic_kind
from ..operators import decode as C
from ..operators import joins as J
from ..operators import matching as M
from ..operators import scoring as S
from ..operators.running import running
from ..settled import settled
from .base import derived, query, table, with_derived

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PRINTABLE = "len(list_filter({0}, lambda c: c BETWEEN 32 AND 126 OR c IN (9, 10, 13)))"


@query(f"""WITH t AS (SELECT DISTINCT substr(text, 11, 12) AS pattern, {_LOW.format('substr(text, 11, 12)')} AS needle FROM documents WHERE length(text) > 22),
d AS MATERIALIZED (SELECT doc_id, {_LOW.format('text')} AS low FROM documents), m AS (SELECT doc_id, pattern, needle, low FROM d JOIN t ON contains(low, needle))
SELECT doc_id AS unit_id, pattern, CASE WHEN len(list_filter(range(1, 12), lambda p: substr(needle, p + 1) = left(needle, 12 - p))) = 0 THEN len(string_split(low, needle)) - 1
 ELSE len(list_filter(range(1, length(low) - 10), lambda i: substr(low, i, 12) = needle)) END::BIGINT AS hits FROM m""")
def match_long_list(spark: SparkSession, d: str) -> DataFrame:
    """A literal out of every document, looked for in all of them, overlapping places too."""
    docs = table(spark, d, "documents")
    # The list is used several times; the texts are read once for it.
    picked = settled(docs.where(F.length("text") > 22).select(F.substring("text", 11, 12).alias("pattern")).distinct())
    terms = picked.select("pattern", F.lit("LITERAL").alias("kind"), F.lit("LOW").alias("severity"), F.lit("c").alias("category"), F.lit("").alias("note"), F.lit(True).alias("enabled"), F.lit(True).alias("scan_paths"), F.lit(True).alias("scan_strings"), F.lit(False).alias("case_sensitive"))
    return M.match_literals(derived(spark, d, "surfaces"), terms).select("unit_id", "pattern", "hits")


@query("""WITH b AS (SELECT DISTINCT p_brand AS brand FROM part), t AS (SELECT brand, CASE WHEN brand LIKE '%1' THEN brand || '(' WHEN brand LIKE '%2' THEN '[' || brand WHEN brand LIKE '%3' THEN '*' || brand WHEN brand LIKE '%4' THEN brand || '\\' ELSE brand || '[ 0-9]?' END AS pattern, NOT regexp_matches(brand, '[1-4]$') AS sound FROM b)
SELECT t.pattern, NOT t.sound AS broken, CASE WHEN sound THEN (SELECT count(*) FROM part WHERE starts_with(p_brand, t.brand)) ELSE 0 END::BIGINT AS hits FROM t""")
def broken_terms(spark: SparkSession, d: str) -> DataFrame:
    """A list in which many expressions don't compile: the others' hits, and which are put aside."""
    parts = table(spark, d, "part")
    brand = F.col("p_brand")
    pattern = F.when(brand.endswith("1"), F.concat(brand, F.lit("("))).when(brand.endswith("2"), F.concat(F.lit("["), brand)).when(brand.endswith("3"), F.concat(F.lit("*"), brand)).when(brand.endswith("4"), F.concat(brand, F.lit("\\"))).otherwise(F.concat(brand, F.lit("[ 0-9]?")))
    terms = parts.select("p_brand").distinct().select(pattern.alias("pattern"), F.lit("REGEX").alias("kind"), F.lit("LOW").alias("severity"), F.lit("c").alias("category"), F.lit("").alias("note"), F.lit(True).alias("enabled"), F.lit(True).alias("scan_paths"), F.lit(True).alias("scan_strings"), F.lit(False).alias("case_sensitive"))
    surfaces = parts.select(F.col("p_partkey").alias("unit_id"), F.col("p_name").alias("location"), F.lit("STRING").alias("surface"), F.lit("CONSTANT").alias("source"), brand.alias("text"))
    hits = M.match_expressions(surfaces, terms).groupBy("pattern").agg(F.sum("hits").alias("hits")).select("pattern", F.lit(False).alias("broken"), "hits")
    return hits.unionByName(M.quarantined(terms).select("pattern", F.lit(True).alias("broken"), F.lit(0).cast("long").alias("hits")))


def _cap_sql(most: int, keys: str, order: str, source: str) -> str:
    return f"SELECT unit_id, id FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS n FROM ({source})) WHERE n <= {most}"


_STRINGS = "SELECT ascii(l_returnflag)::BIGINT AS unit_id, l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS size FROM lineitem"


@query(" UNION ALL ".join(f"SELECT '{name}' AS cap, * FROM ({_cap_sql(most, 'unit_id', 'size DESC, id', _STRINGS)})" for name, most in M.REPORT_CAPS.items()))
def report_caps(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of units that each hold a third of all rows, under each of a report's limits."""
    rows = table(spark, d, "lineitem").select(F.ascii("l_returnflag").cast("long").alias("unit_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("size"))
    parts = [M.capped(rows, ["unit_id"], [F.desc("size"), F.col("id")], most).select(F.lit(name).alias("cap"), "unit_id", "id") for name, most in M.REPORT_CAPS.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("SELECT l_returnflag AS unit, l_orderkey, l_linenumber, sum(1) OVER w::BIGINT AS place, sum(floor(l_quantity)::BIGINT) OVER w::BIGINT AS upto FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate ROWS UNBOUNDED PRECEDING)")
def running_totals(spark: SparkSession, d: str) -> DataFrame:
    """Running totals within units that each hold a third of all rows."""
    rows = table(spark, d, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    summed = running(rows.select("l_returnflag", "l_quantity", *order), ["l_returnflag"], order, place=("sum", F.lit(1)), upto=("sum", F.floor("l_quantity")))
    return summed.select(F.col("l_returnflag").alias("unit"), "l_orderkey", "l_linenumber", "place", "upto")


_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_TURNED = "translate({0}, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', substr('abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz', {1} + 1, 26) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJKLMNOPQRSTUVWXYZ', {1} + 1, 26))"
_COUNTS = "[" + ", ".join(f"length(lower({{0}})) - length(replace(lower({{0}}), '{c}', ''))" for c in _ALPHABET) + "]"


@query(f"""WITH c AS (SELECT unnest({_COUNTS.format('text')}) AS n, unnest(range(0, 26)) AS i FROM documents WHERE text IS NOT NULL), n AS (SELECT i, sum(n) AS n FROM c GROUP BY i), s AS (SELECT list(floor(n * 1000000 / (SELECT greatest(sum(n), 1) FROM n))::BIGINT ORDER BY i) AS shares FROM n),
h AS (SELECT doc_id, {_TURNED.format('text', '(doc_id % 26)')} AS text FROM documents), k AS (SELECT doc_id, text, {_COUNTS.format('text')} AS n FROM h),
r AS (SELECT doc_id, text, k, list_sum(list_transform(range(1, 27), lambda i: shares[i] * n[((i - 1 + k) % 26 + 1)::INTEGER]))::BIGINT AS score FROM k, s, range(0, 26) x(k)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) AS p FROM r) SELECT doc_id AS unit_id, k::INTEGER AS key, {_TURNED.format('text', '((26 - k) % 26)')} AS decoded FROM b WHERE p = 1""")
def rotation_keys(spark: SparkSession, d: str) -> DataFrame:
    """Texts rotated by 0 to 25 letters, turned back by the letters of all plain texts."""
    docs = table(spark, d, "documents")
    hidden = F.lit(None).cast("string")
    for k in range(26):
        hidden = F.when(F.col("doc_id") % 26 == k, C.rotated(F.col("text"), k)).otherwise(hidden)
    return C.rotation_keys(docs.select(F.col("doc_id").alias("unit_id"), hidden.alias("text")), docs.select("text"))


@query(with_derived("""#r AS (SELECT concat('v', l_suppkey % 11) AS volume, concat('/vol', l_suppkey % 3, '/lib/mod', l_orderkey, '.jar') AS path FROM lineitem WHERE l_suppkey % 11 < 7 OR l_orderkey < 20), f AS (SELECT DISTINCT path FROM archives),
t AS (SELECT volume FROM (SELECT volume, count(*) AS n, count(f.path) AS there FROM r LEFT JOIN f USING (path) GROUP BY volume) WHERE n < 20 OR there >= 0.5 * n),
s AS (SELECT concat('v', archive_id % 13) AS volume, path FROM archives)
SELECT DISTINCT volume, path, 'index' AS source FROM r WHERE volume IN (SELECT volume FROM t) UNION ALL SELECT DISTINCT volume, path, 'scan' FROM s WHERE volume NOT IN (SELECT volume FROM t)""", "archives"))
def trusted_or_scanned(spark: SparkSession, d: str) -> DataFrame:
    """Files as the index has them where it can be trusted, elsewhere as a scan finds them."""
    reported = table(spark, d, "lineitem").where("l_suppkey % 11 < 7 OR l_orderkey < 20").selectExpr("concat('v', l_suppkey % 11) AS volume", "concat('/vol', l_suppkey % 3, '/lib/mod', l_orderkey, '.jar') AS path")
    archives = derived(spark, d, "archives")
    return J.trusted_or_scanned(reported, archives.selectExpr("concat('v', archive_id % 13) AS volume", "path"), J.trusted_volumes(reported, archives))


#: Form -> (how a code is hidden under 200, how it is shown under k), as SQL over the code c and the place i from 0 on.
_FORMS = {
    "xor": ("xor(c, 200)", "xor(c, k)"),
    "shift": ("(c + 200) & 255", "(c - k) & 255"),
    "xor by place": ("xor(c, (200 + i) & 255)", "xor(c, (k + i) & 255)"),
    "xor by product": ("xor(c, (200 * (i + 1)) & 255)", "xor(c, (k * (i + 1)) & 255)"),
    "shift by place": ("(c + 200 + i) & 255", "(c - k - i) & 255"),
    "xor less place": ("xor((c + i) & 255, 200)", "(xor(c, k) - i) & 255"),
    "xor then shift": ("xor((c - 200) & 255, 200)", "(xor(c, k) + k) & 255"),
}


def _form_sql(which: int, code: str) -> str:
    each = " ".join(f"WHEN {n} THEN {forms[which]}" for n, forms in enumerate(_FORMS.values()))
    # Lists count from 1.
    return f"list_transform({code}, lambda c, p: (CASE form {each.replace(' i)', ' (p - 1))').replace('(i ', '((p - 1) ')} END))"


@query(f"""WITH h AS (SELECT c_custkey AS unit_id, c_custkey % 7 AS form, list_transform(string_split(c_name, ''), lambda c: ord(c)) AS own FROM customer), x AS (SELECT unit_id, form, {_form_sql(0, 'own')} AS codes FROM h),
t AS (SELECT unit_id, form, k, {_form_sql(1, 'codes')} AS plain FROM (SELECT unit_id, form, codes, k::INTEGER AS k FROM x, range(1, 256) r(k) WHERE len(list_filter(codes, lambda c: c > 127)) > 0)),
g AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY k) AS n FROM t WHERE {_PRINTABLE.format('plain')} > 0.85 * len(plain))
SELECT unit_id, form::INTEGER AS form, k::INTEGER AS key, array_to_string(list_transform(plain, lambda c: chr(c::INTEGER)), '') AS decoded FROM g WHERE n = 1""")
def hidden_forms(spark: SparkSession, d: str) -> DataFrame:
    """Names hidden under a key in seven ways, each found again: the lowest key that makes a name readable."""
    whole = lambda x: x.bitwiseAND(F.lit(255))
    hide = [
        lambda c, i: c.bitwiseXOR(F.lit(200)), lambda c, i: whole(c + 200), lambda c, i: c.bitwiseXOR(whole(F.lit(200) + i)), lambda c, i: c.bitwiseXOR(whole(F.lit(200) * (i + 1))),
        lambda c, i: whole(c + 200 + i), lambda c, i: whole(c + i).bitwiseXOR(F.lit(200)), lambda c, i: whole(c - 200).bitwiseXOR(F.lit(200)),
    ]
    names, out = table(spark, d, "customer"), None
    for n, (form, change) in enumerate(zip(_FORMS, hide, strict=True)):
        rows = names.where(F.col("c_custkey") % 7 == n).select(F.col("c_custkey").alias("unit_id"), C._chars(F.col("c_name"), change).alias("text"))
        found = C.with_keys(rows, range(1, 256), C.CHANGES[form]).select("unit_id", F.lit(n).alias("form"), "key", "decoded")
        out = found if out is None else out.unionByName(found)
    return out


@query("""WITH b AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN encode(text) WHEN 1 THEN unhex('89504E47') || encode(text) WHEN 2 THEN encode(repeat('a', length(text))) ELSE encode(repeat('a', 200) || left(text, 1)) END AS c FROM documents WHERE length(text) > 0),
h AS (SELECT doc_id, left(hex(c), 8) AS head, regexp_extract_all(hex(c), '..') AS bs FROM b), u AS (SELECT doc_id, unnest(bs) AS x FROM h), n AS (SELECT doc_id, x, count(*) AS n FROM u GROUP BY ALL),
e AS (SELECT doc_id, sum(n) AS n, count(*) AS kinds, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM n GROUP BY doc_id)
SELECT doc_id, CASE WHEN head = '89504E47' THEN 'png' WHEN kinds = 1 THEN 'uniform' WHEN entropy < 1.0 THEN 'sparse' WHEN entropy > 7.5 AND n > 64 THEN 'dense' ELSE 'normal' END AS kind FROM e JOIN h USING (doc_id)""")
def blob_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What unknown bytes are, whatever their size: a known format, one byte alone, few, many or ordinary kinds of bytes."""
    text, form = F.col("text"), F.col("doc_id") % 4
    own = F.encode(text, "UTF-8")
    content = F.when(form == 0, own).when(form == 1, F.concat(F.unhex(F.lit("89504E47")), own)).when(form == 2, F.encode(F.repeat(F.lit("a"), F.length(text)), "UTF-8")).otherwise(F.encode(F.concat(F.repeat(F.lit("a"), 200), F.left(text, F.lit(1))), "UTF-8"))
    rows = table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", content.alias("content"))
    magic = rows.select("doc_id", magic_kind(F.hex(F.substring("content", 1, 4))).alias("magic"))
    facts = S.byte_facts(rows, "doc_id", "content")
    return facts.join(magic, "doc_id").select("doc_id", S.blob_class(F.col("magic")).alias("kind"))
