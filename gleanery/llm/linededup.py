"""Line dedup within one edit, by a deletion neighbourhood, with DataFrame functions alone.

Lines are compared without blanks at their ends. Equal lines meet by digest. For the
rest, emitting every variant with one character deleted would cost a line's length squared, so the
neighbourhood is walked in two steps. First a line is cut into blocks, and every variant with one whole block
deleted is a hashed key: two lines one edit apart agree outside one block, so they share a key. Where
different lines share a key, every variant of the deleted block with one character deleted is emitted; equal
variants at one place are one substitution apart, and a block equal to a variant of another is one insertion
apart. Both need a group's earliest line alone, never its pairs. The edit distance to that line is then
verified. A line goes if an earlier line lies within one edit; the earliest by (doc_id, line number) stays.

The bound on edits follows a line's length: lines of fewer than ``shortest`` characters (by default ``MIN_FUZZY``) allow
none, as one edit of a short line, such as a number's, changes its sense; others allow one. With ``shortest`` 0 all allow one.

Defined results: a null text has no lines; lines without words stay and are not compared; equal lines
at the same line of rows that share a doc_id count as one and are treated alike, different ones are told apart, and a null doc_id comes first; an empty table gives an empty table; other columns are
carried by ``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, held_whole, let_go, table, text_of

#: Lines of fewer characters are compared for equality alone, unless a caller asks for less.
MIN_FUZZY = 20
BLOCKS = 3
#: Schemes beyond this length have more blocks, as a step's cost grows with blocks and with their length.
LONG = 2048


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, whole, line, text, length, digest, mark): the lines that hold a word, without blanks at their ends. whole: a fingerprint of the row's text, mark: of the line."""
    exploded = docs.select("doc_id", F.xxhash64(text_of()).alias("whole"), F.posexplode(F.split(text_of(), "\n")).alias("line", "raw")).where(F.col("raw").rlike(r"[^\x20\x09-\x0D]"))
    lines = exploded.select("doc_id", "whole", F.col("line").cast("long").alias("line"), F.trim("raw").alias("text")).withColumn("length", F.length("text"))
    return lines.withColumn("digest", F.unhex(F.md5("text"))).withColumn("mark", F.xxhash64("digest"))


def _variants(with_block: bool, shortest: int) -> Column:
    """Every variant of ``text`` without one block, by the scheme of its own ``length`` and of one less: the keys, or (key, longer, block).

    longer: whether the text is one character longer than its scheme, so that its deleted block is too.
    """
    text, length = F.col("text"), F.col("length")

    def variant(i, k, extra: int) -> Column:
        scheme = length - extra
        start = F.floor(i * scheme / k).cast("int")
        size = F.floor((i + 1) * scheme / k).cast("int") - start + extra
        key = F.xxhash64(scheme, F.lit(i) if isinstance(i, int) else i, F.left(text, start), F.substr(text, start + size + 1))
        return F.struct(key.alias("key"), F.lit(bool(extra)).alias("longer"), F.substr(text, start + 1, size).alias("block")) if with_block else key

    def long_ones(extra: int) -> Column:
        k = F.ceil(F.sqrt(length - extra) / 12).cast("int")
        return F.transform(F.sequence(F.lit(0), k - 1), lambda i: variant(i, k, extra))

    few = F.array(*[variant(i, BLOCKS, extra) for extra in (0, 1) for i in range(BLOCKS)])
    own = F.array(*[variant(i, BLOCKS, 0) for i in range(BLOCKS)])
    return (
        F.when(length < shortest, F.lit(None)).when(length == shortest, own).when(length <= LONG, few)
        .when(length == LONG + 1, F.concat(long_ones(0), F.array(*[variant(i, BLOCKS, 1) for i in range(BLOCKS)]))).otherwise(F.concat(long_ones(0), long_ones(1)))
    )


def line_verdicts(docs: DataFrame, shortest: int = MIN_FUZZY) -> DataFrame:
    """(doc_id, line, kept, kind, first_doc_id, first_line) for each line with a word.

    kind: first, equal or near; first_*: the earliest line that stands for it.
    """
    return _verdicts(docs, shortest).drop("whole")


def _verdicts(docs: DataFrame, shortest: int) -> DataFrame:
    """The verdicts and ``whole``, which tells rows of one doc_id apart."""
    # Rows may share a doc_id, so a place names its line by mark too.
    names = ["doc_id", "line", "mark"]
    place = F.struct(*names)
    seen = durable(_lines(docs).select("doc_id", "whole", "line", "digest", _variants(False, shortest).alias("keys")), "lines").withColumn("mark", F.xxhash64("digest"))
    firsts = durable(seen.groupBy("digest").agg(F.min(place).alias("first")).select("digest", "first.*"), "firsts")

    # Keys shared by different lines. A line's fingerprint stands for its text here; nothing is decided by it.
    shared = durable(seen.select("mark", F.explode("keys").alias("key")).groupBy("key").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo <> hi").select("key"), "keys")
    near = seen.select(*names, F.explode("keys").alias("key")).join(shared, "key", "left_semi").select(*names).distinct()
    near = durable(near.join(firsts, (near["doc_id"].eqNullSafe(firsts["doc_id"])) & (near["line"] == firsts["line"]) & (near["mark"] == firsts["mark"]), "left_semi"), "near")

    # The texts of those lines, each by its earliest place.
    wanted = near.select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    texts = durable(_lines(rows).join(near.withColumnsRenamed({"doc_id": "_id", "line": "_line", "mark": "_mark"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("line") == F.col("_line")) & (F.col("mark") == F.col("_mark"))).select(*names, "text", "length"), "texts")

    blocks = texts.select(*names, F.inline(_variants(True, shortest))).join(shared, "key", "left_semi")
    size = F.length("block")
    without = lambda j: F.concat(F.left(F.col("block"), j), F.substr(F.col("block"), j + 2))
    places = F.sequence(F.lit(0), size - 1)
    replaced = F.transform(places, lambda j: F.struct(F.xxhash64("key", j, without(j)).alias("variant"), F.lit(0).alias("role")))
    whole = F.array(F.struct(F.xxhash64("key", F.lit(-1), "block").alias("variant"), F.lit(1).alias("role")))
    deleted = F.array_distinct(F.transform(places, lambda j: F.struct(F.xxhash64("key", F.lit(-1), without(j)).alias("variant"), F.lit(2).alias("role"))))
    emitted = blocks.select(*names, F.inline(F.when(F.col("longer"), F.when(size > 0, deleted)).otherwise(F.when(size > 0, F.concat(replaced, whole)).otherwise(whole))))
    emitted = durable(emitted, "variants")
    least = lambda role: F.min(F.when(F.col("role") == role, place))
    groups = emitted.groupBy("variant").agg(least(0).alias("r0"), least(1).alias("r1"), least(2).alias("r2"), F.count("*").alias("n")).where("n > 1").drop("n").withColumnRenamed("variant", "_v")
    met = emitted.join(groups, F.col("variant") == F.col("_v"))
    earlier = F.when(F.col("role") == 0, F.col("r0")).when(F.col("role") == 1, F.col("r2")).otherwise(F.col("r1"))
    found = met.select(*names, earlier.alias("first")).where(F.col("first") < place).groupBy(*names).agg(F.min("first").alias("first"))
    found = durable(found.select(*names, F.col("first.doc_id").alias("first_doc_id"), F.col("first.line").alias("first_line"), F.col("first.mark").alias("first_mark")), "met")

    text_at = lambda d, n: texts.select(F.col("doc_id").alias(d), F.col("line").alias(n), F.col("mark").alias(f"{n}_mark"), F.col("text").alias(f"{n}_text"))
    checked = found.join(text_at("_d", "_n"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("line") == F.col("_n")) & (F.col("mark") == F.col("_n_mark")))
    checked = checked.join(text_at("_e", "_m"), F.col("first_doc_id").eqNullSafe(F.col("_e")) & (F.col("first_line") == F.col("_m")) & (F.col("first_mark") == F.col("_m_mark")))
    checked = checked.where(F.levenshtein("_n_text", "_m_text", 1).between(0, 1)).select(F.col("doc_id").alias("_d"), F.col("line").alias("_n"), "_n_mark", F.col("first_doc_id").alias("_e"), F.col("first_line").alias("_m")).distinct()

    decided = firsts.withColumnsRenamed({"doc_id": "_fd", "line": "_fl"}).join(checked, F.col("_fd").eqNullSafe(F.col("_d")) & (F.col("_fl") == F.col("_n")) & (F.col("mark") == F.col("_n_mark")), "left")
    decided = durable(decided.select(F.col("digest").alias("_digest"), "_fd", "_fl", F.col("_n").isNotNull().alias("_near"), "_e", "_m"), "decided")
    out = seen.join(decided, F.col("digest") == F.col("_digest"))
    is_first = F.col("doc_id").eqNullSafe(F.col("_fd")) & (F.col("line") == F.col("_fl"))
    return out.select(
        "doc_id", "whole", "line", (is_first & ~F.col("_near")).alias("kept"),
        F.when(F.col("_near"), "near").when(is_first, "first").otherwise("equal").alias("kind"),
        F.when(F.col("_near"), F.col("_e")).otherwise(F.col("_fd")).alias("first_doc_id"),
        F.when(F.col("_near"), F.col("_m")).otherwise(F.col("_fl")).alias("first_line"),
    )


def dedup_lines(docs: DataFrame, shortest: int = MIN_FUZZY, lost: str | None = None) -> DataFrame:
    """The rows of ``docs`` with the lines that stay; a text that loses all of them becomes empty. lost: a column to add, how many lines a row loses."""
    gone = _verdicts(docs, shortest).where(~F.col("kept")).groupBy("doc_id", "whole").agg(F.collect_set("line").alias("_gone")).withColumnsRenamed({"doc_id": "_id", "whole": "_whole"})
    rows = held_whole(docs, _doc=F.col("doc_id"), _text=F.col("text"), _own=F.xxhash64(text_of()))
    joined = rows.join(gone, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_whole")), "left")
    left = F.filter(F.split("_text", "\n"), lambda s, i: ~F.array_contains("_gone", i.cast("long")))
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(left, "\n"))
    return let_go(joined, docs.columns, **{lost: F.coalesce(F.size("_gone"), F.lit(0))} if lost else {}, text=text)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_verdicts(table(spark, sf_dir, "documents"), shortest=0)


def line_sql(shortest: int = MIN_FUZZY) -> str:
    return rf"""
WITH seen AS (SELECT doc_id, i - 1 AS line, trim(raw, ' ') AS t
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
l AS (SELECT * FROM seen WHERE regexp_matches(t, '[^\x20\x09-\x0D]')),
f AS (SELECT t, min(doc_id) AS d, arg_min(line, doc_id * 1000000 + line) AS n FROM l GROUP BY t),
g AS (SELECT *, length(t) AS len, d * 1000000 + n AS o FROM f WHERE length(t) >= {shortest}),
s AS (SELECT *, len AS m FROM g UNION ALL SELECT *, len - 1 AS m FROM g WHERE len > {shortest}),
p AS (
  SELECT a.o AS ao, b.o AS bo, a.t AS ta, b.t AS tb FROM s a JOIN s b ON a.m = b.m AND left(a.t, a.m // 2) = left(b.t, b.m // 2) AND a.o > b.o
  UNION SELECT a.o, b.o, a.t, b.t FROM s a JOIN s b ON a.m = b.m AND right(a.t, a.m - a.m // 2) = right(b.t, b.m - b.m // 2) AND a.o > b.o),
q AS (SELECT *, length(ta) AS la, length(tb) AS lb, coalesce(list_filter(range(1, least(length(ta), length(tb)) + 1), lambda i: substr(ta, i, 1) <> substr(tb, i, 1))[1] - 1, least(length(ta), length(tb))) AS same FROM p),
near AS (SELECT ao, min(bo) AS bo FROM q WHERE abs(la - lb) <= 1 AND substr(ta, same + 1 + (la >= lb)::INTEGER) = substr(tb, same + 1 + (lb >= la)::INTEGER) GROUP BY ao)
SELECT l.doc_id, l.line::BIGINT AS line, (near.ao IS NULL AND l.doc_id = f.d AND l.line = f.n) AS kept,
  CASE WHEN near.ao IS NOT NULL THEN 'near' WHEN l.doc_id = f.d AND l.line = f.n THEN 'first' ELSE 'equal' END AS kind,
  (CASE WHEN near.ao IS NOT NULL THEN near.bo // 1000000 ELSE f.d END)::BIGINT AS first_doc_id,
  (CASE WHEN near.ao IS NOT NULL THEN near.bo % 1000000 ELSE f.n END)::BIGINT AS first_line
FROM l JOIN f USING (t) LEFT JOIN near ON near.ao = f.d * 1000000 + f.n
"""


OP1_SQL = line_sql(0)
