"""Screening queries: matching, folding, scores, verdicts and reports over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as T
from ..operators import matching as M
from ..operators import scoring as S
from .base import derived, query, table, with_derived

_WORDS = "SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_$]+')) AS tok FROM documents"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "t(pattern, kind, severity, category, cs) AS (VALUES ('that','WORD','LOW','common',false), ('inoran','WORD','HIGH','rare',false), ('hehely','WORD','CRITICAL','rare',false), ('Orre','WORD','MEDIUM','rare',true))"
_WORD_HITS = f"""{_TERMS}, w AS ({_WORDS}), wc AS (SELECT doc_id, tok, count(*) AS n FROM w WHERE tok <> '' GROUP BY ALL),
hits AS (SELECT doc_id AS unit_id, pattern, kind, severity, category, sum(n)::BIGINT AS hits FROM wc JOIN t ON {_FOLD.format('tok')} = {_FOLD.format('pattern')} AND (NOT cs OR tok = pattern) GROUP BY ALL)"""
_LITERAL = "((length(text) - length(replace(text, {0}, ''))) // length({0}))"
_SEARCHED_HITS = f"""searched AS (
 SELECT doc_id AS unit_id, 'tion' AS pattern, 'LITERAL' AS kind, 'LOW' AS severity, 'common' AS category, ((length(text) - length(replace({_FOLD.format('text')}, 'tion', ''))) // 4)::BIGINT AS hits FROM documents
 UNION ALL SELECT doc_id, 'étion', 'LITERAL', 'LOW', 'common', ((length(text) - length(replace({_FOLD.format('text')}, 'étion', ''))) // 5)::BIGINT FROM documents
 UNION ALL SELECT doc_id, '[A-Za-z0-9._]+@[A-Za-z0-9.]+', 'REGEX', 'HIGH', 'contact', len(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+'))::BIGINT FROM documents
 UNION ALL SELECT doc_id, 'token = "[0-9a-f]{{40}}"', 'REGEX', 'CRITICAL', 'secret', len(regexp_extract_all(text, 'token = "[0-9a-f]{{40}}"'))::BIGINT FROM documents
 UNION ALL SELECT doc_id, 'MIT License', 'WORD', 'MEDIUM', 'license', (len(regexp_extract_all('  ' || replace({_FOLD.format('text')}, ' ', '  ') || ' ', '[^a-z0-9_$]mit  license[^a-z0-9_$]')))::BIGINT FROM documents)"""
_ALL_HITS = f"WITH {_WORD_HITS}, {_SEARCHED_HITS}, every AS (SELECT * FROM hits UNION ALL SELECT * FROM searched WHERE hits > 0)"
_SCORES = """weights(severity, w) AS (VALUES ('INFO',0),('LOW',5),('MEDIUM',20),('HIGH',50),('CRITICAL',100)),
scores AS (SELECT unit_id, sum(w + least(hits - 1, 10) * 2)::BIGINT AS score, bool_or(w >= 50) AS substantive, (count(*) FILTER (severity = 'CRITICAL'))::BIGINT AS critical_findings, sum(hits)::BIGINT AS term_hits FROM every JOIN weights USING (severity) GROUP BY unit_id),
flags AS (SELECT doc_id, bool_or(quality = 0) AS bad, bool_or(toxic = 1) AS enc FROM labels GROUP BY doc_id),
v AS (SELECT d.doc_id AS unit_id, d.source AS name, coalesce(score, 0) AS score, CASE WHEN coalesce(bad, false) THEN 'UNREADABLE' WHEN score IS NOT NULL AND coalesce(enc, false) AND (substantive OR critical_findings >= 2) THEN 'CRITICAL'
  WHEN substantive OR critical_findings > 0 THEN 'DETECTED' WHEN coalesce(enc, false) THEN 'SUSPICIOUS' WHEN score IS NOT NULL THEN 'NOTABLE' ELSE 'CLEAN' END AS verdict
  FROM documents d LEFT JOIN scores ON d.doc_id = unit_id LEFT JOIN flags ON d.doc_id = flags.doc_id)"""
_ORDINAL = "(SELECT * FROM (VALUES ('CLEAN',0),('NOTABLE',1),('SUSPICIOUS',2),('DETECTED',3),('CRITICAL',4),('UNREADABLE',5)) o(verdict, ordinal))"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return M.match_terms(derived(spark, d, "surfaces"), dims.sample_terms(spark))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d)
    findings = hits.select("unit_id", F.lit(0).cast("long").alias("seq"), F.col("pattern").alias("title"), "severity", "source", "category", "pattern", "location", F.lit("").alias("evidence"), "hits")
    flags = table(spark, d, "labels").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 0).alias("bad"), F.bool_or(F.col("toxic") == 1).alias("enc"))
    units = table(spark, d, "documents").select("doc_id", F.col("source").alias("name")).join(flags, "doc_id", "left").select(
        F.col("doc_id").alias("unit_id"), "name", F.when(F.col("bad"), "UNREADABLE").otherwise("POOL_SCANNED").alias("outcome"), F.lit(False).alias("obfuscated"), F.coalesce("enc", F.lit(False)).alias("encrypted"), F.lit(False).alias("broken"), F.lit(1).alias("read"), F.lit(0).alias("unreadable"))
    return S.decide(units, S.unit_scores(S.fold_findings(findings)))


@query(f"WITH {_WORD_HITS} SELECT unit_id, pattern, severity, hits FROM hits")
def match_word(spark: SparkSession, d: str) -> DataFrame:
    """Single-word terms, exact case where asked."""
    return M.match_words(derived(spark, d, "surfaces"), dims.sample_terms(spark)).select("unit_id", "pattern", "severity", "hits")


_ENTRIES = [(p, kind, severity, "c", "", on, False, True, exact) for p, kind, severity, on, exact in (
    ("That", "WORD", "LOW", True, False), ("That", "WORD", "HIGH", True, True), ("That", "WORD", "LOW", True, False), ("that", "WORD", "HIGH", False, False), ("inoran", "WORD", "LOW", False, False), ("\u00e9tion", "WORD", "LOW", True, False), ("\u00e9tion", "WORD", "LOW", False, False))]


@query(f"""WITH w AS ({_WORDS}), a AS (SELECT doc_id AS unit_id, 'That' AS pattern, 'LOW' AS severity, count(*) AS hits FROM w WHERE {_FOLD.format('tok')} = 'that' GROUP BY 1
 UNION ALL SELECT doc_id, 'That', 'HIGH', count(*) FROM w WHERE tok = 'That' GROUP BY 1
 UNION ALL SELECT doc_id, 'étion', 'LOW', len(regexp_extract_all(' ' || replace({_FOLD.format('text')}, 'étion', ' étion ') || ' ', '[^a-z0-9_$] étion [^a-z0-9_$]')) FROM documents) SELECT unit_id, pattern, severity, hits::BIGINT AS hits FROM a WHERE hits > 0""")
def match_entries(spark: SparkSession, d: str) -> DataFrame:
    """A list that holds a pattern several times: switched off, twice the same, and with exact case."""
    return M.match_terms(derived(spark, d, "surfaces"), spark.createDataFrame(_ENTRIES, dims.TERMS)).select("unit_id", "pattern", "severity", "hits")


@query(f"""{_ALL_HITS}, p AS (SELECT DISTINCT unit_id, pattern FROM every WHERE NOT regexp_matches(pattern, '[\\[\\](){{}}|^$*+?\\\\]')), x AS (SELECT p.*, {_FOLD.format('text')} AS low, {_FOLD.format('pattern')} AS needle FROM p JOIN documents ON doc_id = unit_id)
SELECT unit_id, pattern, (instr(low, needle) - 1)::INTEGER AS "first", ((length(low) - length(replace(low, needle, ''))) // length(needle))::BIGINT AS spans FROM x""")
def hit_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where a reader should look first."""
    return M.hit_spans(derived(spark, d, "tokens"), _hits(spark, d))


@query(f"WITH {_SEARCHED_HITS} SELECT unit_id, pattern, kind, hits FROM searched WHERE hits > 0")
def match_searched(spark: SparkSession, d: str) -> DataFrame:
    """Literal, regular-expression, compound and non-ASCII terms."""
    return M.match_searched(derived(spark, d, "surfaces"), dims.sample_terms(spark)).select("unit_id", "pattern", "kind", "hits")


@query("SELECT page_id AS unit_id, url AS location, 'example.com' AS pattern, ((length(url) - length(replace(lower(url), 'example.com', ''))) // 11)::BIGINT AS hits FROM pages WHERE contains(lower(url), 'example.com')")
def match_paths(spark: SparkSession, d: str) -> DataFrame:
    """Only terms for paths apply to paths."""
    return M.match_terms(derived(spark, d, "page_surfaces"), dims.sample_terms(spark)).select("unit_id", "location", "pattern", "hits")


@query(f"{_ALL_HITS}, {_SCORES} SELECT o.verdict, o.ordinal, count(v.unit_id)::BIGINT AS units FROM {_ORDINAL} o LEFT JOIN v USING (verdict) GROUP BY ALL")
def screen_verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    """From texts to verdict counts: match, fold, score, decide, count."""
    return S.verdict_counts(_verdicts(spark, d), dims.verdict_table(spark))


@query(f"{_ALL_HITS}, {_SCORES} SELECT unit_id, name, score, verdict FROM v JOIN {_ORDINAL} o USING (verdict) ORDER BY ordinal DESC, score DESC, lower(name), unit_id LIMIT 100")
def worst_units(spark: SparkSession, d: str) -> DataFrame:
    """The report's first page, worst units first."""
    return _verdicts(spark, d).orderBy(*S.report_order(None, F.col("name"))).limit(100).select("unit_id", "name", "score", "verdict")


@query(f"{_ALL_HITS}, {_SCORES} SELECT count(*)::BIGINT AS found, (count(*) FILTER (verdict <> 'UNREADABLE'))::BIGINT AS analysed, (count(*) FILTER (verdict = 'UNREADABLE'))::BIGINT AS failed, (count(*) FILTER (verdict IN ('SUSPICIOUS','DETECTED','CRITICAL','UNREADABLE')))::BIGINT AS attention FROM v")
def screen_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.summary(_verdicts(spark, d))


_FOLDED = """#f AS (SELECT unit_id, coalesce(pattern, title) AS k, source, sum(hits)::BIGINT AS hits, arg_min(severity, seq) AS severity, arg_min(location, seq) AS location, min(seq) AS seq, arg_min(title, seq) AS title, any_value(pattern) AS pattern FROM events_findings GROUP BY ALL),
weights(severity, w) AS (VALUES ('INFO',0),('LOW',5),('MEDIUM',20),('HIGH',50),('CRITICAL',100)), fw AS (SELECT * FROM f JOIN weights USING (severity))"""


@query(with_derived(_FOLDED + " SELECT unit_id, source, hits, title, severity, location, seq FROM f", "events_findings"))
def fold_findings(spark: SparkSession, d: str) -> DataFrame:
    return S.fold_findings(derived(spark, d, "events_findings")).select("unit_id", "source", "hits", "title", "severity", "location", "seq")


@query(with_derived(_FOLDED + """ SELECT unit_id, sum(w + least(hits - 1, 10) * 2)::BIGINT AS score, bool_or(pattern IS NOT NULL) AS any_term, bool_or(pattern IS NOT NULL AND w >= 50 AND source NOT IN ('FILE_NAME','ENTRY_PATH')) AS substantive,
(count(*) FILTER (severity = 'CRITICAL'))::BIGINT AS critical_findings, (count(*) FILTER (severity = 'HIGH'))::BIGINT AS high_findings, coalesce(sum(hits) FILTER (pattern IS NOT NULL), 0)::BIGINT AS term_hits FROM fw GROUP BY unit_id""", "events_findings"))
def risk_scores(spark: SparkSession, d: str) -> DataFrame:
    return S.unit_scores(S.fold_findings(derived(spark, d, "events_findings")))


@query(with_derived(_FOLDED + """, s AS (SELECT unit_id, sum(w + least(hits - 1, 10) * 2)::BIGINT AS score, bool_or(pattern IS NOT NULL) AS any_term, bool_or(pattern IS NOT NULL AND w >= 50 AND source NOT IN ('FILE_NAME','ENTRY_PATH')) AS substantive, count(*) FILTER (severity = 'CRITICAL') AS crit FROM fw GROUP BY unit_id),
u AS (SELECT units.*, coalesce(score, 0) AS score, coalesce(any_term, false) AS any_term, coalesce(substantive, false) AS sub, coalesce(crit, 0) AS crit, obfuscated OR encrypted OR broken OR outcome = 'FAILED' OR coalesce(unreadable / nullif("read" + unreadable, 0), 0) > 0.25 AS res FROM units LEFT JOIN s USING (unit_id))
SELECT unit_id, score, CASE WHEN outcome IN ('NOT_AN_ARCHIVE','UNREADABLE') THEN 'UNREADABLE' WHEN any_term AND res AND (sub OR crit >= 2) THEN 'CRITICAL' WHEN any_term AND (sub OR crit > 0) THEN 'DETECTED' WHEN res THEN 'SUSPICIOUS' WHEN any_term OR score >= 20 THEN 'NOTABLE' ELSE 'CLEAN' END AS verdict FROM u""", "events_findings", "units"))
def verdict_cascade(spark: SparkSession, d: str) -> DataFrame:
    return S.decide(derived(spark, d, "units"), S.unit_scores(S.fold_findings(derived(spark, d, "events_findings")))).select("unit_id", "score", "verdict")


@query(with_derived(_FOLDED + " SELECT unit_id, title, severity, seq FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY w DESC, seq) AS n FROM fw) WHERE n = 1", "events_findings"))
def top_finding(spark: SparkSession, d: str) -> DataFrame:
    return S.top_findings(S.fold_findings(derived(spark, d, "events_findings"))).select("unit_id", "title", "severity", "seq")


_KEYS = {"thing": "HIGH", "tion": "LOW", "here": None}
_KEY_SQL = "hits AS (" + " UNION ALL ".join(f"SELECT doc_id AS unit_id, '{k}' AS keyword, '{r or 'MEDIUM'}' AS risk, ((length(text) - length(replace({_FOLD.format('text')}, '{k}', ''))) // {len(k)})::BIGINT AS hits FROM documents" for k, r in _KEYS.items()) + ")"


@query(f"WITH {_KEY_SQL} SELECT * FROM hits WHERE hits > 0")
def keyword_risks(spark: SparkSession, d: str) -> DataFrame:
    return M.risk_keywords(derived(spark, d, "surfaces"), _KEYS).select("unit_id", "keyword", "risk", "hits")


@query(f"WITH {_KEY_SQL}, s AS (SELECT unit_id, coalesce(sum(hits) FILTER (risk = 'HIGH'), 0)::BIGINT AS high, coalesce(sum(hits) FILTER (risk = 'MEDIUM'), 0)::BIGINT AS medium, coalesce(sum(hits) FILTER (risk = 'LOW'), 0)::BIGINT AS low, sum(hits)::BIGINT AS total FROM hits WHERE hits > 0 GROUP BY unit_id) SELECT *, CASE WHEN total > 20 THEN 'high' WHEN total > 5 THEN 'medium' ELSE 'low' END AS band FROM s")
def keyword_risk_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.risk_counts(M.risk_keywords(derived(spark, d, "surfaces"), _KEYS))


@query("SELECT doc_id AS unit_id, CASE WHEN contains(lower(text), 'idiot') THEN 'idiot' WHEN contains(lower(text), 'license') THEN 'License' WHEN contains(lower(text), 'the ') THEN 'the ' END AS keyword FROM documents")
def first_keyword(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "tokens").select("unit_id", M.first_keyword(F.col("text"), ["idiot", "License", "the "]).alias("keyword"))


@query("SELECT DISTINCT conv_id AS unit_id, m AS marker FROM conversations, (VALUES ('the'), ('que'), ('und')) k(m) WHERE length(text) BETWEEN 4 AND 200 AND contains(lower(text), m)")
def marker_detection(spark: SparkSession, d: str) -> DataFrame:
    return M.markers(table(spark, d, "conversations").select(F.col("conv_id").alias("unit_id"), "text"), [(m, m) for m in ("the", "que", "und")])


@query("SELECT conv_id AS unit_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def joined_texts(spark: SparkSession, d: str) -> DataFrame:
    return M.joined_text(table(spark, d, "conversations").select(F.col("conv_id").alias("unit_id"), F.col("turn").alias("ordinal"), "text"), most=None)


@query("""WITH p AS (SELECT doc_id, string_split(lower(text), 'thing') AS s FROM documents), q AS (SELECT doc_id, unnest(s[1:len(s) - 1]) AS part, generate_subscripts(s[1:len(s) - 1], 1) AS i FROM p WHERE len(s) > 1)
SELECT doc_id AS unit_id, (sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) + 5 * (i - 1))::BIGINT AS "begin" FROM q WHERE i <= 5000""")
def find_all(spark: SparkSession, d: str) -> DataFrame:
    """Places of a needle in each text."""
    return derived(spark, d, "tokens").select("unit_id", F.inline(T.find_all(F.col("text"), "thing"))).select("unit_id", F.col("begin").cast("long").alias("begin"))


@query("SELECT doc_id AS unit_id, left(regexp_extract(text, '[^\\n]{0,100}License[^\\n]{0,100}'), 220) AS excerpt FROM documents WHERE contains(text, 'License')")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "tokens").where(F.col("text").contains("License")).select("unit_id", M.excerpt(F.col("text"), "License").alias("excerpt"))


@query("SELECT user_id AS unit_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 40")
def capped_hits(spark: SparkSession, d: str) -> DataFrame:
    """A report keeps the first hits of each unit."""
    return M.capped(table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 40).select(F.col("user_id").alias("unit_id"), "event_id")


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT doc_id, ord(ch) & 255 AS b, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL)
SELECT doc_id AS unit_id, sum(n)::BIGINT AS units, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM n GROUP BY doc_id""")
def text_entropy(spark: SparkSession, d: str) -> DataFrame:
    return S.text_entropy(derived(spark, d, "tokens"), "unit_id", "text").select("unit_id", "units", F.round("entropy", 6).alias("entropy"))


@query("""WITH h AS (SELECT doc_id, regexp_extract_all(hex(encode(left(text, 2000))), '(..)', 1) AS b FROM documents), c AS (SELECT doc_id, unnest(b) AS b FROM h), n AS (SELECT doc_id, b, count(*) AS n FROM c GROUP BY ALL)
SELECT doc_id AS unit_id, sum(n)::BIGINT AS bytes, count(*)::BIGINT AS distinct_bytes, count(*) = 1 AS uniform, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM n GROUP BY doc_id""".replace("left(text, 2000)", "text"))
def byte_entropy(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d, "tokens").select("unit_id", F.encode("text", "UTF-8").alias("content"))
    return S.byte_facts(rows, "unit_id", "content").withColumn("entropy", F.round("entropy", 6))


@query(f"""WITH w AS ({_WORDS}), s AS (SELECT doc_id, count(*)::BIGINT AS classes, (count(*) FILTER (length(tok) <= 2))::BIGINT AS short_names, (count(*) FILTER (regexp_matches(tok, '^[Il1iO0o]{{4,}}$')))::BIGINT AS barcode FROM w WHERE tok <> '' GROUP BY doc_id),
r AS (SELECT *, short_names / classes AS cs FROM s), o AS (SELECT *, least(1.0, 0.32 * cs + 0.28 * cs + CASE WHEN barcode > 0 THEN 0.10 ELSE 0 END) AS score FROM r)
SELECT doc_id AS unit_id, classes, short_names, barcode, round(score, 6) AS score, (score >= 0.45 OR (CASE WHEN cs > 0.45 THEN 2 ELSE 0 END + CASE WHEN barcode > 2 THEN 1 ELSE 0 END) >= 2) AS obfuscated,
 CASE WHEN NOT (score >= 0.45 OR (CASE WHEN cs > 0.45 THEN 2 ELSE 0 END + CASE WHEN barcode > 2 THEN 1 ELSE 0 END) >= 2) THEN '' WHEN barcode > 2 THEN 'barcode' WHEN cs > 0.6 THEN 'renamer' ELSE 'generic' END AS guess FROM o""")
def name_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """The words of a document as the names of an archive's classes and members."""
    names = derived(spark, d, "tokens").select("unit_id", F.explode(F.split("text", M.NOT_WORD)).alias("name")).where("name <> ''")
    shapes = S.name_shapes(names)
    short = S.ratio(F.col("short_names"), F.col("classes"))
    row = {"class_short": short, "member_short": short, **{k: F.lit(0.0) for k in ("decrypt", "synthetic", "no_source", "entropy")}, **{k: F.col(k) for k in ("barcode", "invisible", "non_ascii", "classes")}}
    scored = shapes.withColumn("score", S.obfuscation_score(row)).withColumn("obfuscated", S.is_obfuscated(F.col("score"), row))
    return scored.select("unit_id", "classes", "short_names", "barcode", F.round("score", 6).alias("score"), "obfuscated", S.tool_guess(F.lit(None).cast("string"), F.col("obfuscated"), row).alias("guess"))


@query("SELECT sha256(text) AS digest, count(*)::BIGINT AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")
