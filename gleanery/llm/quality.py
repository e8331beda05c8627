"""Quality rules: adaptive thresholds from mergeable quantile sketches per language and source.

Each document is measured once. Every measure goes into a sketch per (language, source): counts of
values rounded down to ``SKETCH_BITS`` significant bits, so a quantile is off by at most one part in
2 ** (SKETCH_BITS - 1) and two sketches merge by adding counts. The sketches alone decide the fences. Junk
lies beyond one end of a measure, so the spread is taken at the other end: the upper fence is the median and
``FENCE_WIDTH`` times what lies between the first decile and the median, the lower one mirrors it. Groups with fewer
than ``MIN_GROUP`` documents, or without spread, take the merged sketch of their language, and languages of that
kind the merged sketch of everything; if that has no spread either there is no fence. A document is rejected if a
measure lies beyond its group's fence; ``fence_report`` states the share for each group.

Defined results: a null text counts as empty; an empty text fails the base rules; null languages and
sources are groups of their own; repeated rows are judged each by itself; an empty table gives an
empty table; other columns are ignored by ``quality_verdicts`` and carried by ``apply_quality``. Words and windows
are told apart by 64-bit hashes; windows that count as repeated are also equal word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, durable, evenly, held_whole, let_go, table, text_of, words_of

SYMBOLS = "#*$%&|<>"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SKETCH_BITS = 8
MIN_GROUP = 50
#: The base rule about size: documents of fewer words fail.
LEAST_WORDS = 50
#: measure -> (whether it has a lower fence, whether it has an upper one).
FENCES = {
    "punct_rate": (False, True),
    "capital_rate": (False, True),
    "mean_chars": (True, True),
    "variety": (True, False),
}
FENCE_WIDTH = 5

#: Up to so many repeated hashes are sought among a text's windows one by one, beyond that all windows are sorted with their places; a matter of speed alone.
FEW_MET = 16

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _same_window(words: str, i: Column, j: Column) -> Column:
    same = F.get(words, i) == F.get(words, j)
    for k in (1, 2):
        same = same & (F.get(words, i + k) == F.get(words, j + k))
    return same


def measure(docs: DataFrame) -> DataFrame:
    """Add the base counts and the measures, all whole numbers.

    punct_rate and capital_rate: ASCII punctuation and capitals per 1000 characters of words; mean_chars: per 100
    words; variety: 1000 ln(distinct words) / ln(words), which hardly depends on a text's length. Repeated 3-word
    windows are neighbours once the windows of a text are sorted by hash and place; neighbours of one hash are
    compared word by word.
    """
    text = text_of("text")
    has_word = lambda s: s.rlike(WORD)
    held = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
    split = docs.withColumns({
        "_words": words_of(text),
        "_lines": F.filter(F.split(text, "\n"), has_word),
        "n_symbols": F.when(text.rlike(f"[{SYMBOLS}]"), held(SYMBOLS)).otherwise(0).cast("long"),
        "_punct": held(PUNCTUATION),
        "_capitals": held(CAPITALS),
    })
    hashes = F.transform(
        F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    counted = split.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_distinct": F.size(F.array_distinct(F.transform("_words", lambda w: F.xxhash64(w)))).cast("double"),
        "_hashes": hashes,
    }).withColumn("_sorted", F.sort_array("_hashes"))
    # Bare hashes are sorted first. Most texts hold none twice; only where some are, their places are looked for.
    counted = counted.withColumn("_met", F.array_distinct(F.filter("_sorted", lambda h, k: F.coalesce(h == F.get("_sorted", k - 1), F.lit(False))))).drop("_sorted")
    placed = F.transform("_hashes", lambda h, i: F.struct(h.alias("hash"), i.alias("place")))
    some = F.when(F.size("_met") <= FEW_MET, F.filter(placed, lambda w: F.array_contains("_met", w["hash"]))).otherwise(placed)
    counted = counted.withColumn("_windows", F.when(F.size("_met") > 0, F.sort_array(some))).drop("_hashes", "_met")
    like = lambda w, other: F.coalesce((w["hash"] == other["hash"]) & _same_window("_words", w["place"], other["place"]), F.lit(False))
    twice = F.sort_array(F.transform(F.filter("_windows", lambda w, k: like(w, F.get("_windows", k - 1)) | like(w, F.get("_windows", k + 1))), lambda w: w["place"]))
    counted = counted.withColumn("_twice", twice).drop("_words", "_windows", "_lines")
    covered = F.aggregate(
        F.transform("_twice", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_twice", k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda total, n: total + n,
    )
    per = lambda part, whole, unit: F.coalesce(F.try_divide(F.col(part) * unit, F.col(whole)), F.lit(0)).cast("long")
    return counted.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_twice").withColumns({
        "punct_rate": per("_punct", "word_chars", 1000),
        "capital_rate": per("_capitals", "word_chars", 1000),
        "mean_chars": per("word_chars", "n_words", 100),
        "variety": F.when(F.col("n_words") > 1, F.floor(1000 * F.ln("_distinct") / F.ln(F.col("n_words").cast("double")))).otherwise(1000).cast("long"),
        "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        # Keeps filters above this point: pushed below it, they would repeat the work on the words for each word.
        "_at": F.monotonically_increasing_id(),
    }).drop("_punct", "_capitals", "_distinct")


def _rounded(value: Column) -> Column:
    shift = F.greatest(F.length(F.bin(value)) - SKETCH_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(measured: DataFrame) -> DataFrame:
    """Quantile sketches of the documents that pass the base rules: (lang, source, measure, value, n)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), _rounded(F.col(m)).alias("value")) for m in FENCES])
    return (
        measured.where(~F.col("base_failed") & (F.col("_at") >= 0)).select("lang", "source", F.inline(pairs))
        .groupBy("lang", "source", "measure", "value").agg(F.count("*").alias("n"))
    )


def _quantiles(sketched: DataFrame, keys: list[str]) -> DataFrame:
    merged = sketched.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "measure")
    at = merged.withColumns({"_upto": F.sum("n").over(by.orderBy("value")), "_all": F.sum("n").over(by)})
    q = lambda percent: F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * percent, F.col("value")))
    return at.groupBy(*keys, "measure").agg(F.max("_all").alias("n"), q(10).alias("q10"), q(50).alias("q50"), q(90).alias("q90"))


def thresholds(sketched: DataFrame) -> DataFrame:
    """One row per (lang, source) and the fences of each measure: <measure>_lo, <measure>_hi; null where there is none."""
    own, by_lang, overall = (_quantiles(sketched, k) for k in (["lang", "source"], ["lang"], []))
    up = own.alias("o").join(by_lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.measure") == F.col("l.measure")))
    up = up.join(overall.alias("a"), F.col("o.measure") == F.col("a.measure"))

    def fence(of: str, low: bool) -> Column:
        spread = F.col(f"{of}.q90") - F.col(f"{of}.q50") if low else F.col(f"{of}.q50") - F.col(f"{of}.q10")
        enough = (F.col(f"{of}.n") >= MIN_GROUP) if of != "a" else F.lit(True)
        return F.when(enough & (spread > 0), F.col(f"{of}.q50") + (-FENCE_WIDTH if low else FENCE_WIDTH) * spread)

    picked = up.select("o.lang", "o.source", F.col("o.measure").alias("measure"), *[F.coalesce(*[fence(of, low) for of in "ola"]).alias(side) for side, low in (("lo", True), ("hi", False))])
    sides = [F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m, has in FENCES.items() for side, on in zip(("lo", "hi"), has, strict=True) if on]
    return picked.groupBy("lang", "source").agg(*sides)


def _judged(measured: DataFrame, fences: DataFrame) -> DataFrame:
    fences = fences.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = measured.join(fences, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    beyond = F.lit(False)
    for m, (low, high) in FENCES.items():
        if low:
            beyond = beyond | F.coalesce(F.col(m) < F.col(f"{m}_lo"), F.lit(False))
        if high:
            beyond = beyond | F.coalesce(F.col(m) > F.col(f"{m}_hi"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~beyond & (F.col("_at") >= 0))


def fence_report(docs: DataFrame) -> DataFrame:
    """(lang, source, documents, base_failed, rejected, share_rejected, fences): what the rules do to each group; rejected: beyond the base rules."""
    measured = durable(measure(docs.select("text", "lang", "source")).drop("text"), "quality")
    fences = thresholds(sketch(measured))
    bounds = [c for c in fences.columns if c not in ("lang", "source")]
    rejected = F.count_if(~F.col("base_failed") & ~F.col("kept"))
    return _judged(measured, fences).groupBy("lang", "source").agg(
        F.count("*").alias("documents"), F.count_if("base_failed").alias("base_failed"), rejected.alias("rejected"), (rejected / F.count("*")).alias("share_rejected"), *[F.max(c).alias(c) for c in bounds])


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Base counts, ``base_failed`` and ``kept`` for each row of (doc_id, text, lang, source)."""
    measured = durable(measure(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality")
    return _judged(measured, thresholds(sketch(measured))).select("doc_id", *BASE, "base_failed", "kept")


def apply_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns.

    The fences are a small table; documents are measured a second time against them, so that no
    text is shuffled or written.
    """
    own = held_whole(docs, text=F.col("text"), lang=F.col("lang"), source=F.col("source"))
    measured = durable(measure(docs.select("text", "lang", "source")).drop("text"), "quality")
    fences = durable(thresholds(sketch(measured)), "fences")
    return _judged(measure(own), fences).where("kept").transform(let_go, docs.columns)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(evenly(table(spark, sf_dir, "documents")))


def _sql() -> str:
    measures = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM r WHERE NOT base_failed" for m in FENCES)

    def quantiles(name: str, keys: str) -> str:
        by = f"PARTITION BY {keys + ', ' if keys else ''}measure"
        pick = ", ".join(f"min(v) FILTER (upto * 100 >= n * {q}) AS q{q}" for q in (10, 50, 90))
        return (f"{name} AS (SELECT {keys + ', ' if keys else ''}measure, max(n) AS n, {pick} FROM (SELECT *, sum(c) OVER ({by} ORDER BY v) AS upto, sum(c) OVER ({by}) AS n"
                f" FROM (SELECT {keys + ', ' if keys else ''}measure, v, sum(c) AS c FROM sketch GROUP BY ALL)) GROUP BY {keys + ', ' if keys else ''}measure)")

    def fence(low: bool) -> str:
        spread = (lambda t: f"({t}.q90 - {t}.q50)") if low else (lambda t: f"({t}.q50 - {t}.q10)")
        each = ", ".join(f"CASE WHEN {f'{t}.n >= {MIN_GROUP} AND ' if t != 'a' else ''}{spread(t)} > 0 THEN {t}.q50 {'-' if low else '+'} {FENCE_WIDTH} * {spread(t)} END" for t in "ola")
        return f"coalesce({each})"

    beyond = " OR ".join(f"(f.measure = '{m}' AND ({' OR '.join(x for x in (f'{m} < f.lo' if low else '', f'{m} > f.hi' if high else '') if x)}))" for m, (low, high) in FENCES.items())
    strip = lambda chars: "[" + "".join("\\" + c if not c.isalnum() else c for c in chars) + "]"
    held = lambda chars: f"(length(text) - length(regexp_replace(text, '{strip(chars)}', '', 'g')))::BIGINT".replace("\\'", "\\''")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) > 2)),
rep AS (SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM win) WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
c AS (SELECT d.*, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, {held(SYMBOLS)} AS n_symbols,
  {held(PUNCTUATION)} AS punct, {held(CAPITALS)} AS capitals, len(list_distinct(ws)) AS dist, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d JOIN l USING (rid) LEFT JOIN rep USING (rid)),
r AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(punct * 1000 // nullif(word_chars, 0), 0) AS punct_rate, coalesce(capitals * 1000 // nullif(word_chars, 0), 0) AS capital_rate,
  coalesce(word_chars * 100 // nullif(n_words, 0), 0) AS mean_chars, CASE WHEN n_words > 1 THEN floor(1000 * ln(dist) / ln(n_words))::BIGINT ELSE 1000 END AS variety FROM c),
sketch AS (SELECT lang, source, measure, (v >> greatest(length(bin(v)) - {SKETCH_BITS}, 0)) << greatest(length(bin(v)) - {SKETCH_BITS}, 0) AS v, count(*) AS c FROM ({measures}) GROUP BY ALL),
{quantiles('own', 'lang, source')}, {quantiles('by_lang', 'lang')}, {quantiles('whole', '')},
f AS (SELECT o.lang, o.source, o.measure, {fence(True)} AS lo, {fence(False)} AS hi
  FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN whole a ON o.measure = a.measure),
bad AS (SELECT DISTINCT rid FROM r JOIN f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source WHERE {beyond})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.rid IS NULL AS kept FROM r LEFT JOIN bad USING (rid)
"""


OP10_SQL = _sql()
