"""Term matching over surfaces (unit_id, location, surface, source, text).

Words of a text meet a term list of checked size where they are, so that only hits are shuffled; for a longer list each
unit's words are counted first. One equi-join finds any number of terms. Literals of a long list are met by one of their
grams: places of texts that hold such a gram join the list's, with the characters around them; no text is moved. A few literals
are looked for in each text at once. Expressions that don't compile are put aside with a reason (``quarantined``). Terms that are switched off never
take part, an entry that is listed twice counts once, and entries that differ in anything are told apart, also where they share a pattern.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import is_asset_path
from ..functions.text import LOWER, UPPER, fold
from ..settled import settled
from .running import running

NOT_WORD = "[^A-Za-z0-9_$]+"
#: Terms that are sent to every task, and the characters they may have in all; a longer list meets the texts by a shuffle.
MOST_SENT, MOST_SENT_CHARS = 200_000, 16_000_000
#: Up to so many literals are looked for one by one; more are met by their grams.
FEW_LITERALS = 100
#: Expressions in one pass over the texts.
EXPRESSIONS_A_PASS = 500
#: Characters of a literal's gram: the most of these that the literal has.
GRAMS = (1, 2, 3, 4, 6, 8, 12)
#: Characters of the pieces that longer literals are cut into.
PIECE = 64
#: Characters of the parts of a text whose grams are worked out at once.
PART = 32_768
#: Bits of the map of a list's grams that is sent to every task, as a power of two: 16 MB. Of a list too long for it, more places are compared in vain.
MOST_BITS = 27
#: Stands before and behind each text: a code that Unicode keeps free of characters, so that no literal holds it.
_EDGE = "\uffff"
_NAMES = ("unit_id", "location", "surface", "source")
_OWN = ("pattern", "kind", "severity", "category")
#: Texts that tools leave behind, and the tools' names.
MARKERS = (
    ("Allatori", "Allatori"), ("zelix", "Zelix KlassMaster"), ("Stringer", "Stringer"), ("Skidfuscator", "Skidfuscator"), ("Paramorphism", "Paramorphism"),
    ("Branchlock", "Branchlock"), ("Bozar", "Bozar"), ("qProtect", "qProtect"), ("Binscure", "Binscure"), ("Sandmark", "Sandmark"), ("yGuard", "yGuard"),
    ("DashO", "DashO"), ("Prestige", "Prestige"), ("Caesium", "Caesium"), ("proguard", "ProGuard"),
)


def applicable(terms: DataFrame, surface: str) -> DataFrame:
    """Enabled terms for PATH or STRING surfaces."""
    return terms.where(F.col("enabled") & F.col("scan_paths" if surface == "PATH" else "scan_strings"))


def is_single_word(pattern: Column) -> Column:
    return pattern.rlike("^[A-Za-z0-9_$]+$")


def word_counts(surfaces: DataFrame) -> DataFrame:
    """(unit_id, location, surface, source, token, hits): each unit's words with their counts."""
    keys = ["unit_id", "location", "surface", "source"]
    return surfaces.select(*keys, F.explode(F.split("text", NOT_WORD)).alias("token")).where("token <> ''").groupBy(*keys, "token").agg(F.count("*").alias("hits"))


def _entries(terms: DataFrame) -> DataFrame:
    """The enabled terms, each entry once, with a number of its own."""
    return terms.where("enabled").dropDuplicates().withColumn("_term", F.xxhash64(*terms.columns))


def match_words(surfaces: DataFrame, terms: DataFrame) -> DataFrame:
    """Hits of single-word WORD terms, one row for each place and entry."""
    keys, own = ["unit_id", "location", "surface", "source"], ["pattern", "kind", "severity", "category"]
    words = _entries(terms).where((F.col("kind") == "WORD") & is_single_word(F.col("pattern"))).select(fold(F.col("pattern")).alias("_word"), "_term", *own, "case_sensitive", "scan_paths", "scan_strings")
    on = (fold(F.col("token")) == F.col("_word")) & (~F.col("case_sensitive") | (F.col("token") == F.col("pattern"))) & F.when(F.col("surface") == "PATH", F.col("scan_paths")).otherwise(F.col("scan_strings"))
    if _may_be_sent(words, "pattern"):
        tokens = surfaces.select(*keys, F.explode(F.split("text", NOT_WORD)).alias("token"), F.lit(1).cast("long").alias("hits"))
        found = tokens.join(F.broadcast(words), on)
    else:
        found = word_counts(surfaces).join(words, on)
    return found.groupBy(*keys, "_term", *own).agg(F.sum("hits").alias("hits")).drop("_term")


def without_assets(hits: DataFrame, excerpt: str | None = None) -> DataFrame:
    """Hits that do not lie in game data: neither the place nor the excerpt, if there is one, is an asset's path."""
    asset = is_asset_path(F.col("location"))
    return hits.where(~F.coalesce(asset | is_asset_path(F.col(excerpt)) if excerpt else asset, F.lit(False)))


def quoted(text: str) -> str:
    """An expression that matches a text as it stands, also one that holds the sign that ends a quotation."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def _may_be_sent(terms: DataFrame, text: str) -> bool:
    """Whether a term list is small enough for every task."""
    n, chars = terms.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    return n <= MOST_SENT and chars <= MOST_SENT_CHARS


def _applies() -> Column:
    return F.when(F.col("surface") == "PATH", F.col("scan_paths")).otherwise(F.col("scan_strings"))


def broken_expressions(spark: SparkSession, patterns: list[str]) -> dict[str, str]:
    """pattern -> reason, for those that Spark can't compile: all are tried at once, then halves of what fails."""
    try:
        for i in range(0, len(patterns), EXPRESSIONS_A_PASS):
            spark.range(1).select(*[F.regexp_count(F.lit(""), F.lit(p)) for p in patterns[i : i + EXPRESSIONS_A_PASS]]).collect()
    except (PySparkException, Py4JError) as error:
        if len(patterns) == 1:
            return {patterns[0]: str(error).strip().split("\n")[0][:300]}
        half = len(patterns) // 2
        return broken_expressions(spark, patterns[:half]) | broken_expressions(spark, patterns[half:])
    return {}


def quarantined(terms: DataFrame) -> DataFrame:
    """(pattern, kind, severity, category, reason) of the enabled expressions that don't compile; matching goes on without them."""
    rows = _expressions(terms)
    broken = broken_expressions(terms.sparkSession, sorted({r.pattern for r in rows}))
    return terms.sparkSession.createDataFrame([(*(r[c] for c in _OWN), broken[r.pattern]) for r in rows if r.pattern in broken], "pattern string, kind string, severity string, category string, reason string")


def _expressions(terms: DataFrame) -> list:
    return _entries(terms).where((F.col("kind") == "REGEX") & F.col("pattern").isNotNull()).orderBy("pattern", "_term").collect()


def _literals(terms: DataFrame) -> DataFrame:
    """Literals, and words that aren't single ones, with their length, folded unless their case counts."""
    plain = _entries(terms).where(((F.col("kind") == "LITERAL") | ((F.col("kind") == "WORD") & ~is_single_word(F.col("pattern")))) & (F.length("pattern") > 0))
    needle = F.when(F.col("case_sensitive"), F.col("pattern")).otherwise(fold(F.col("pattern")))
    return plain.withColumns({"_needle": needle, "_size": F.length("pattern")})


def _cut(literals: DataFrame) -> DataFrame:
    """The literals, one row for each piece of at most ``PIECE`` characters: (_needle, _at, _last, _pieces, ...); the last piece ends with the literal."""
    ends = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.col("_size") - 1, F.lit(0)), F.lit(PIECE)), lambda i: F.least(i, F.greatest(F.col("_size") - PIECE, F.lit(0)))))
    cut = literals.withColumns({"_pieces": F.size(ends), "_whole": F.col("_size")}).withColumn("_at", F.explode(ends))
    return cut.withColumns({"_needle": F.substr("_needle", F.col("_at") + 1, F.lit(PIECE)), "_last": F.col("_at") + PIECE >= F.col("_whole")})


def match_literals(surfaces: DataFrame, terms: DataFrame) -> DataFrame:
    """Hits of LITERAL terms and of WORD terms that are not single words, one row for each place and entry; case folds for ASCII alone.

    The number of literals is not limited, nor is the length of a text or a literal. A text's places that hold a gram of the list, as a bitmap of fixed
    size tells, go on with the characters around them, and meet the pieces that have the gram. A literal is where all its pieces are.
    """
    few = _few_literals(terms)
    if few is not None:
        return _searched(surfaces, few)
    pieces = settled(_cut(_literals(terms)).withColumn("_id", F.monotonically_increasing_id()))
    index = _gram_index(pieces)
    wanted = settled(pieces.join(index, "_id"))
    n, reach, longest = wanted.agg(F.count("*"), F.coalesce(F.max(F.length("_needle")), F.lit(0)), F.coalesce(F.max("_pieces"), F.lit(0))).first()
    sizes = sorted(r[0] for r in wanted.select(F.length("gram")).distinct().collect())
    bits = 1 << min(MOST_BITS, max(15, (64 * n).bit_length()))
    # 4,096 rows of 4 KB at most.
    marked = wanted.select(F.col("_hash").bitwiseAND(F.lit(bits - 1)).alias("b")).groupBy(F.shiftright("b", 15).alias("at")).agg(F.bitmap_construct_agg(F.col("b").bitwiseAND(F.lit(32_767))).alias("bits"))
    held = bytearray(bits // 8)
    for r in marked.collect():
        held[r["at"] * 4096 : r["at"] * 4096 + 4096] = r["bits"]
    places = _gram_places(surfaces, sizes, reach, terms.sparkSession.sparkContext.broadcast(bytes(held)))
    pieces_met = F.broadcast(wanted) if _may_be_sent(wanted, "_needle") else wanted
    word, size = F.col("kind") == "WORD", F.length("_needle")
    # The place in the characters around a gram where a piece that holds it begins, from 1.
    begin = F.lit(reach + 2) - F.col("_offset")
    text = lambda start, length: F.substr(F.when(F.col("case_sensitive"), F.col("_around")).otherwise(fold(F.col("_around"))), start, length)
    free = lambda at: ~F.substr("_around", at, F.lit(1)).rlike("[A-Za-z0-9_$]")
    alone = ~word | (((F.col("_at") > 0) | free(begin - 1)) & (~F.col("_last") | free(begin + size)))
    met = places.join(pieces_met, "_hash").where(_applies() & (text(begin, size) == F.col("_needle")) & alone)
    keys = [*_NAMES, "_term", *_OWN]
    if longest > 1:
        found = met.groupBy(*keys, "_row", (F.col("_place") - F.col("_offset") - F.col("_at")).alias("_start")).agg(F.count("*").alias("_n"), F.first("_pieces").alias("_pieces"))
        return found.where("_n = _pieces").groupBy(*keys).agg(F.count("*").alias("hits")).drop("_term")
    return met.groupBy(*keys).agg(F.count("*").alias("hits")).drop("_term")


def _hashes(codes: np.ndarray, size: int, known: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """A number for each run of ``size`` codes, by doubling: a run's number follows from those of its two halves."""
    known = {} if known is None else known
    if size not in known:
        if size == 1:
            known[1] = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        else:
            left = size // 2
            a, b = _hashes(codes, left, known), _hashes(codes, size - left, known)
            n = max(0, len(codes) - size + 1)
            mixed = (a[:n] ^ (a[:n] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b[left : left + n]
            known[size] = mixed ^ (mixed >> np.uint64(32))
    return known[size]


@F.pandas_udf(T.LongType())
def _gram_hash(grams: pd.Series) -> pd.Series:
    return pd.Series([int(_hashes(np.frombuffer(g.encode("utf-32-le"), np.uint32), len(g))[0].astype(np.int64)) for g in grams], dtype="int64")


def _gram_places(surfaces: DataFrame, sizes: list[int], reach: int, sent) -> DataFrame:
    """(unit_id, location, surface, source, _row, _place, _hash, _around): places of grams that the bitmap ``sent`` holds, with ``reach`` + 1 characters before and behind them."""
    shown = surfaces.where(F.length("text") > 0).select(*_NAMES, F.monotonically_increasing_id().alias("_row"), "text")

    def found(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
        marks = np.frombuffer(sent.value, np.uint8)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
        edges = _EDGE * (reach + 1)
        for start in range(0, len(codes), PART):
            part, known = codes[start : start + PART + max(sizes, default=0)], {}
            for size in sizes:
                hashes = _hashes(part, size, known)[:PART]
                low = hashes & np.uint64(8 * len(marks) - 1)
                at = np.flatnonzero(marks[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
                if len(at):
                    before = text[max(0, start - reach - 1) : start + PART + 2 * reach + 2]
                    around = edges[: max(0, reach + 1 - start)] + before + edges
                    yield at + start, hashes[at].astype(np.int64), [around[i : i + 2 * reach + 2] for i in at.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                rows, places, hashes, around = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
                for row, text in enumerate(some.column(5).to_pylist()):
                    for at, numbers, texts in found(text):
                        rows += [row] * len(texts)
                        places.append(at)
                        hashes.append(numbers)
                        around += texts
                kept = [some.column(c).take(pa.array(rows, pa.int64())) for c in range(5)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(places)), pa.array(np.concatenate(hashes)), pa.array(around, pa.string())], names=[*_NAMES, "_row", "_place", "_hash", "_around"])

    return shown.mapInArrow(run, T.StructType([*shown.schema.fields[:5], T.StructField("_place", T.LongType()), T.StructField("_hash", T.LongType()), T.StructField("_around", T.StringType())]))


def _few_literals(terms: DataFrame) -> list | None:
    """The literals of a list, if they are few."""
    rows = _literals(terms).orderBy("_term").limit(FEW_LITERALS + 1).collect()
    return rows if len(rows) <= FEW_LITERALS else None


def _searched(surfaces: DataFrame, rows: list) -> DataFrame:
    """Hits of the literals and expressions in ``rows``, each looked for in every text, ``EXPRESSIONS_A_PASS`` in one pass."""
    passes = []
    folded = surfaces.withColumn("_low", fold(F.col("text")))
    for i in range(0, max(len(rows), 1), EXPRESSIONS_A_PASS):
        hits = [F.struct(F.lit(0).cast("long").alias("_term"), *[F.lit("").alias(c) for c in _OWN], F.lit(0).cast("long").alias("hits"))]
        for r in rows[i : i + EXPRESSIONS_A_PASS]:
            on = F.when(F.col("surface") == "PATH", F.lit(r.scan_paths)).otherwise(F.lit(r.scan_strings))
            if r.kind == "REGEX":
                count = F.when(on, F.regexp_count("text", F.lit(r.pattern)))
            else:
                text, needle = F.col("text" if r.case_sensitive else "_low"), quoted(r["_needle"])
                look = f"(?<![A-Za-z0-9_$])(?={needle}(?![A-Za-z0-9_$]))" if r.kind == "WORD" else f"(?={needle})"
                count = F.when(on & text.contains(r["_needle"]), F.regexp_count(text, F.lit(look)))
            hits.append(F.struct(F.lit(r["_term"]).alias("_term"), *[F.lit(r[c]).alias(c) for c in _OWN], count.otherwise(0).cast("long").alias("hits")))
        passes.append(folded.select(*_NAMES, F.inline(F.array(*hits))).where("hits > 0"))
    return reduce(DataFrame.unionByName, passes).groupBy(*_NAMES, "_term", *_OWN).agg(F.sum("hits").alias("hits")).drop("_term")


def _gram_index(pieces: DataFrame) -> DataFrame:
    """(_id, gram, _offset, _hash): of each piece the gram that the fewest pieces hold, and where in the piece it first is; grams are folded and of one of the sizes in ``GRAMS``."""
    low, size = fold(F.col("_needle")), F.length("_needle")
    of = F.lit(None)
    for k in GRAMS:
        of = F.when(size >= k, k).otherwise(of)
    cut = pieces.select("_id", low.alias("_low"), of.alias("_k"))
    grams = cut.select("_id", "_low", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_low") - F.col("_k") + 1), lambda i: F.substr("_low", i, F.col("_k"))))).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("_n"))
    best = grams.join(often, "gram").groupBy("_id").agg(F.min_by(F.struct("gram", "_low"), F.struct("_n", F.xxhash64("gram"), "gram")).alias("g"))
    return best.select("_id", "g.gram", (F.instr("g._low", F.col("g.gram")) - 1).alias("_offset"), _gram_hash("g.gram").alias("_hash"))


def _sound_expressions(terms: DataFrame) -> list:
    rows = _expressions(terms)
    broken = broken_expressions(terms.sparkSession, sorted({r.pattern for r in rows}))
    return [r for r in rows if r.pattern not in broken]


def match_expressions(surfaces: DataFrame, terms: DataFrame) -> DataFrame:
    """Hits of REGEX terms, one row for each place and entry; those that don't compile are left out."""
    return _searched(surfaces, _sound_expressions(terms))


def match_searched(surfaces: DataFrame, terms: DataFrame) -> DataFrame:
    """Hits of LITERAL and REGEX terms and of WORD terms that are not single words; case folds for ASCII alone. A few literals go with the expressions, in one pass."""
    few = _few_literals(terms)
    if few is not None:
        return _searched(surfaces, few + _sound_expressions(terms))
    return match_literals(surfaces, terms).unionByName(match_expressions(surfaces, terms))


def match_terms(surfaces: DataFrame, terms: DataFrame) -> DataFrame:
    """All hits: (unit_id, location, surface, source, pattern, kind, severity, category, hits)."""
    return match_words(surfaces, terms).unionByName(match_searched(surfaces, terms))


def excerpt(text: Column, pattern: str, around: int = 100) -> Column:
    """The part of the first hit's line around it, at most 220 characters."""
    return F.left(F.regexp_extract(text, rf"[^\n]{{0,{around}}}{pattern}[^\n]{{0,{around}}}", 0), F.lit(220))


#: A report's limits: hits of a text, marked resources of an archive, odd names, names of a unit's classes, its strings, places that a reader is shown.
REPORT_CAPS = {"hits": 400, "resources": 40, "names": 20, "classes": 12, "strings": 4000, "places": 5000}
#: Shares that a group's rows are ranked in before its first ones meet.
SHARES = 64


def capped(hits: DataFrame, keys: list[str], order: list, most: int, shares: int = SHARES) -> DataFrame:
    """At most ``most`` rows of each group, first ones first: a report's limit.

    The first rows of each share of a group are found first, so a group of any size is sorted in many tasks, and the task
    that ranks the rest meets ``shares * most`` rows at most.
    """
    free = [n for k in range(len(hits.columns) + 2) if (n := f"_c{k}") not in hits.columns]
    share, number = free[0], free[1]

    def first(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.withColumn(number, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(number) <= most).drop(number)

    dealt = hits.withColumn(share, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in hits.columns]), F.lit(shares)))
    return first(first(dealt, [*keys, share]).drop(share), keys)


def _folded(keyword: str) -> str:
    return keyword.translate(str.maketrans(UPPER, LOWER))


def risk_keywords(surfaces: DataFrame, keywords: dict[str, str]) -> DataFrame:
    """Every place of each keyword, A-Z in any case, with its risk: (unit_id, location, keyword, risk, hits)."""
    low = F.col("_low")
    found = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(risk or "MEDIUM").alias("risk"), F.when(low.contains(_folded(k)), F.regexp_count(low, F.lit(f"(?={quoted(_folded(k))})"))).otherwise(0).cast("long").alias("hits")) for k, risk in keywords.items()])
    return surfaces.withColumn("_low", fold(F.col("text"))).select("unit_id", "location", F.inline(found)).where("hits > 0")


def first_keyword(text: Column, keywords: list[str]) -> Column:
    """The first keyword of the list that a text holds, A-Z in any case; null if none."""
    out = F.lit(None).cast("string")
    for k in reversed(keywords):
        out = F.when(fold(text).contains(_folded(k)), k).otherwise(out)
    return out


def hit_spans(texts: DataFrame, hits: DataFrame, shortest: int = 3) -> DataFrame:
    """(unit_id, pattern, first, spans): where the plain terms that hit a unit's text lie, and how often; offsets from 0.

    texts: (unit_id, text); hits: (unit_id, pattern). Terms of under three characters and those with the signs of a regular
    expression are left out.
    """
    plain = hits.where((F.length("pattern") >= shortest) & ~F.col("pattern").rlike(r"[\\\[\](){}|^$*+?]")).select("unit_id", "pattern").distinct()
    low, needle = fold(F.col("text")), fold(F.col("pattern"))
    # Places that don't overlap, as a reader marks them.
    spans = (F.length(low) - F.length(F.replace(low, needle, F.lit("")))) / F.length(needle)
    return texts.join(plain, "unit_id").select("unit_id", "pattern", (F.instr(low, needle) - 1).alias("first"), spans.cast("long").alias("spans")).where("first >= 0")


def markers(rows: DataFrame, known=MARKERS, shortest: int = 4, longest: int = 200) -> DataFrame:
    """Distinct tools whose marker a text of 4 to 200 characters holds: (unit_id, marker)."""
    sized = rows.where(F.length("text").between(shortest, longest)).withColumn("_low", fold(F.col("text")))
    held = F.filter(F.array(*[F.when(F.col("_low").contains(_folded(m)), F.lit(tool)) for m, tool in known]), F.isnotnull)
    return sized.select("unit_id", F.explode(held).alias("marker")).distinct()


def joined_text(rows: DataFrame, most: int | None = 1_000_000) -> DataFrame:
    """Each unit's texts in order, one a line, up to ``most`` characters, or all of them: (unit_id, text)."""
    kept = rows if most is None else running(rows, ["unit_id"], ["ordinal"], _upto=("sum", F.length("text") + 1)).where(F.col("_upto") <= most + 1)
    ordered = F.sort_array(F.collect_list(F.struct("ordinal", "text")))
    return kept.groupBy("unit_id").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("text"))
