"""Secret scans: candidates by pattern, false positives removed by a random forest in numpy.

A candidate is a run of at least ``SHORTEST`` key characters, told apart from its surroundings by ASCII alone; a name
ends before its ``=``, so the value of an unquoted ``KEY=value`` is a run of its own. A run that holds a key in the
format of a known issuer, such as a URL's path, is cut around it. Whatever stands behind a telling name, of any length
and any characters but blanks, quotes and brackets, is a candidate too, and so
are signed tokens with their dots. The forest sees its length, the make-up and
transitions of its characters, how much of it frequent words cover, its path and its neighbouring words, and
is fitted on labelled findings (about ``SAMPLE`` of each label, of at most ``FITTED_CHARS`` characters). Where no one has labelled findings,
``rule_labels`` labels those in the formats of known issuers or assigned in plain sight as true and plain
words, numbers and repetitions as false, and leaves the rest unlabelled; the forest decides these.

Frequent words and transitions are counted over all documents; candidates are scored where they lie.

Defined results: null and empty texts have no candidates; every occurrence is a finding of its own, also in
repeated rows; without labelled findings of both kinds every score is null and nothing is marked; an empty table gives
an empty table; a null path is an empty one; other columns are ignored. Findings carry the secret's digest, not its text.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drawn, durable, held_whole, let_go, table

#: The shortest run that is a candidate without a telling name, and the shortest assigned value that the rules label.
SHORTEST, LABELLED_SHORTEST = 16, 8
#: Labelled findings of each label that the fit may see, about, drawn by a hash, and the longest of them.
SAMPLE, FITTED_CHARS = 2000, 4096
#: At most so many of the most frequent words, of 3 to 16 characters, count as dictionary: all that are met as often as the last one.
DICTIONARY = 20_000
TREES, DEPTH, LEAST, BINS = 40, 8, 4, 32
THRESHOLD = 0.5
NEAR = 48
FEATURES = ("length", "digits", "upper", "symbols", "hex", "entropy", "switches", "transition", "worst_transition", "coverage", "longest_word", "assigned", "quoted", "before", "after", "path", "distinct")
#: A run's ``=`` at the end belong to it, unless a value follows. The shortest issued key has one character less than ``SHORTEST``.
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{{{SHORTEST - 1},}}(?:={{1,2}}(?![A-Za-z0-9+/=_\-]))?")
ISSUED = (r"^(AKIA|ASIA)[0-9A-Z]{16}$", r"^gh[pousr]_[A-Za-z0-9]{36}$", r"^xox[baprs]-[A-Za-z0-9\-]{10,}$", r"^sk_(live|test)_[A-Za-z0-9]{16,}$")
WITHIN = re.compile("(?<![A-Za-z0-9])(?:" + "|".join(p[1:-1] for p in ISSUED) + ")(?![A-Za-z0-9])")
#: Signed tokens: three parts joined by dots.
SIGNED = re.compile(r"(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]*")
ASSIGNED = re.compile(rf"""(?i)(?:password|passwd|pwd|token|secret|api_?key|access_?key|auth)["']?[ \t]{{0,4}}[=:][ \t]{{0,4}}["']?([^\s"'`,;<>(){{}}\[\]]+)""")
NAMED = r"(?i)(password|passwd|pwd|token|secret|api_?key|access_?key|auth)\W{0,4}[=:]\s*[\"']?$"
_WORD = re.compile(r"\w+")


def _runs(text: str) -> Iterator[tuple[int, int]]:
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        for key in WITHIN.finditer(m[0]):
            a, b = m.start() + key.start(), m.start() + key.end()
            if a - at >= SHORTEST:
                yield at, a
            yield a, b
            at = b
        if len(text[at:end].rstrip("=")) >= SHORTEST:
            yield at, end


def spans(text: str) -> list[tuple[int, int]]:
    """Where each candidate of a text begins and ends, in order, none overlapping another.

    A signed token or assigned value takes the place of the runs within it; it gives way where a run reaches beyond it
    or is an issued key.
    """
    runs = list(_runs(text))
    starts = [a for a, _ in runs]
    gone, added, upto = set(), [], 0
    for a, b in sorted({*(m.span() for m in SIGNED.finditer(text)), *(m.span(1) for m in ASSIGNED.finditer(text))}, key=lambda s: (s[0], -s[1])):
        first = bisect.bisect_left(starts, a)
        first -= first > 0 and runs[first - 1][1] > a
        inside = range(first, bisect.bisect_left(starts, b))
        if a < upto or any(runs[k][0] < a or runs[k][1] > b or WITHIN.fullmatch(text, *runs[k]) for k in inside):
            continue
        gone.update(inside)
        added.append((a, b))
        upto = b
    return sorted([*(r for k, r in enumerate(runs) if k not in gone), *added])


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, path, start, value, before, after) of each candidate in (doc_id, path, text); text_key tells rows of one doc_id apart."""
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, key, path, text in zip(frame["doc_id"].astype(object).where(frame["doc_id"].notna(), None), frame["text_key"], frame["path"], frame["text"], strict=True):
                for a, b in spans(text or ""):
                    rows.append((doc_id, key, path, a, text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR]))
            yield pd.DataFrame(rows, columns=["doc_id", "text_key", "path", "start", "value", "before", "after"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), "text").where("text IS NOT NULL").mapInPandas(find, f"doc_id {dict(docs.dtypes)['doc_id']}, text_key long, path string, start long, value string, before string, after string")


def frequent_words(docs: DataFrame, size: int = DICTIONARY) -> list[tuple[str, int]]:
    """The most frequent words over all documents, at most ``size``, those of one count all or none; counted in tasks before they are shuffled."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for frame in frames:
            for text in frame["text"]:
                counts.update(w for w in _WORD.findall(text.lower()) if 3 <= len(w) <= 16)
                if len(counts) > 500_000:
                    yield pd.DataFrame(counts.items(), columns=["word", "n"])
                    counts.clear()
        if counts:
            yield pd.DataFrame(counts.items(), columns=["word", "n"])

    counted = docs.select("text").where("text IS NOT NULL").mapInPandas(count, "word string, n long")
    totals = durable(counted.where("NOT word rlike '[0-9]'").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # From how many words are met n times follows the least n that no more than ``size`` words reach; one row for each n.
    upto = F.sum("words").over(Window.orderBy(F.desc("n")))
    least = totals.groupBy("n").agg(F.count("*").alias("words")).withColumn("upto", upto).where(F.col("upto") <= size).agg(F.min("n")).first()[0]
    return [] if least is None else sorted(((r.word, r.n) for r in totals.where(F.col("n") >= least).collect()), key=lambda w: (-w[1], w[0]))


class Language:
    """Frequent words and the character transitions in them."""

    def __init__(self, words: list[tuple[str, int]]):
        self.words = {w for w, _ in words}
        pairs: Counter = Counter()
        for w, n in words:
            for a, b in zip("^" + w, w + "$"):
                pairs[a, b] += n
        firsts: Counter = Counter()
        for (a, _), n in pairs.items():
            firsts[a] += n
        self.transition = {(a, b): math.log((n + 0.5) / (firsts[a] + 40)) for (a, b), n in pairs.items()}

    def coverage(self, value: str) -> tuple[float, int]:
        """The share of characters within dictionary words, taken greedily from the left, and the longest word."""
        i = covered = longest = 0
        while i < len(value):
            for n in range(min(16, len(value) - i), 2, -1):
                if value[i : i + n] in self.words:
                    covered, longest, i = covered + n, max(longest, n), i + n
                    break
            else:
                i += 1
        return covered / len(value), longest


def neighbours(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def features(frame: pd.DataFrame, language: Language, odds: dict[str, float]) -> np.ndarray:
    out = np.zeros((len(frame), len(FEATURES)), np.float32)
    for k, (value, before, after, path) in enumerate(zip(frame["value"], frame["before"], frame["after"], frame["path"], strict=True)):
        n, low = len(value), value.lower()
        counts = np.array(list(Counter(value).values())) / n
        steps = [language.transition.get((a, b), -9.0) for a, b in zip("^" + low, low)]
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in value]
        covered, longest = language.coverage(low)
        near = lambda words: max((odds.get(w, 0.0) for w in words), default=0.0)
        tail = before.rstrip()
        out[k] = (
            n, kinds.count("d") / n, kinds.count("u") / n, kinds.count("s") / n, all(c in "0123456789abcdef" for c in low), -(counts * np.log2(counts)).sum(),
            sum(a != b for a, b in zip(kinds, kinds[1:])) / n, sum(steps) / n, min(steps), covered, longest, tail[-1:] in ("=", ":") or tail[:-1].rstrip()[-1:] in ("=", ":"), before[-1:] in ("'", '"'),
            near(neighbours(before)[-3:]), near(neighbours(after)[:3]), near(neighbours(path)), len(counts) / n,
        )
    return out


class Forest:
    """A random forest of binary trees on binned thresholds."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        self.trees = [self._grow(binned[k], y[k], rng) for k in (rng.integers(0, len(y), len(y)) for _ in range(trees))]

    def _grow(self, x: np.ndarray, y: np.ndarray, rng) -> list[tuple]:
        nodes: list[tuple] = []

        def grow(at: np.ndarray, depth: int) -> int:
            me, p = len(nodes), (y[at].sum() + 1) / (len(at) + 2)
            nodes.append((-1, 0, 0, 0, p))
            if depth == DEPTH or len(at) < 2 * LEAST or y[at].min() == y[at].max():
                return me
            best = None
            for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5) + 1), replace=False):
                width = len(self.edges[f]) + 1
                n, ones = np.cumsum(np.bincount(x[at, f], minlength=width))[:-1], np.cumsum(np.bincount(x[at, f], weights=y[at], minlength=width))[:-1]
                m, rest = len(at) - n, y[at].sum() - ones
                with np.errstate(divide="ignore", invalid="ignore"):
                    impure = np.where((n >= LEAST) & (m >= LEAST), ones * (1 - ones / n) + rest * (1 - rest / m), np.inf)
                if len(impure) and np.isfinite(impure.min()) and (best is None or impure.min() < best[0]):
                    best = (impure.min(), f, int(impure.argmin()))
            if best is not None:
                left = x[at, best[1]] <= best[2]
                nodes[me] = (int(best[1]), best[2], grow(at[left], depth + 1), grow(at[~left], depth + 1), p)
            return me

        grow(np.arange(len(y)), 0)
        return nodes

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        total = np.zeros(len(x))
        for nodes in self.trees:
            feature, cut, left, right, p = (np.array(c) for c in zip(*nodes, strict=True))
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                f = feature[at]
                down = np.where(binned[np.arange(len(x)), np.maximum(f, 0)] <= cut[at], left[at], right[at])
                at = np.where(f >= 0, down, at)
            total += p[at]
        return total / len(self.trees)


def rule_labels(found: DataFrame) -> DataFrame:
    """Candidates with a label: 1 issued formats and values assigned to a telling name, 0 plain words, numbers and repetitions, else null."""
    value, true = F.col("value"), F.col("before").rlike(NAMED) & F.col("value").rlike("[0-9]") & (F.length("value") >= LABELLED_SHORTEST)
    for pattern in (*ISSUED, f"^{SIGNED.pattern}$"):
        true = true | value.rlike(pattern)
    false = value.rlike(r"^[A-Z]?[a-z]+([_\-/][A-Za-z][a-z]*)*$") | value.rlike(r"^[0-9\-]+$") | value.rlike(r"^[A-Z]+$") | value.rlike(r"^[_\-+/=]+$")
    return found.withColumn("label", F.when(true, 1).when(false, 0))


def fit(labelled: pd.DataFrame, language: Language) -> tuple[Forest, dict[str, float]]:
    """The forest and the log-odds of words near findings, from (value, before, after, path, label)."""
    y = labelled["label"].to_numpy().astype(float)
    seen = [Counter(), Counter()]
    for before, after, path, label in zip(labelled["before"], labelled["after"], labelled["path"], y, strict=True):
        seen[int(label)].update({*neighbours(before)[-3:], *neighbours(after)[:3], *neighbours(path)})
    odds = {w: math.log((seen[1][w] + 1) / (y.sum() + 2)) - math.log((seen[0][w] + 1) / (len(y) - y.sum() + 2)) for w in {*seen[0], *seen[1]} if seen[0][w] + seen[1][w] > 2}
    return Forest(features(labelled, language, odds), y), odds


def scan(docs: DataFrame, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text_key, start, length, digest, label, score, is_secret) for each candidate in (doc_id, path, text).

    labelled: findings (value, before, after, path, label); by default those that rule_labels tells apart.
    """
    found = durable(rule_labels(candidates(docs)), "candidates")
    language = Language(frequent_words(docs))
    known = (found if labelled is None else labelled).where("label IN (0, 1)").select("value", "before", "after", "path", "label")
    known = known.where(F.length("value") <= FITTED_CHARS)
    order = ["value", "before", "after", "path"]
    seen = [drawn(known.where(F.col("label") == y), F.concat("value", "before", "after"), sample).toPandas().sort_values(order) for y in (0, 1)]
    fitted = fit(pd.concat(seen, ignore_index=True), language) if all(len(d) for d in seen) else None
    sent = docs.sparkSession.sparkContext.broadcast((fitted, language))

    @F.pandas_udf("double")
    def score(value: pd.Series, before: pd.Series, after: pd.Series, path: pd.Series) -> pd.Series:
        fitted, language = sent.value
        if fitted is None:
            return pd.Series([None] * len(value), dtype="float64")
        forest, odds = fitted
        frame = pd.DataFrame({"value": value, "before": before, "after": after, "path": path})
        return pd.Series(forest.predict(features(frame, language, odds)))

    scored = found.withColumn("score", score("value", "before", "after", "path"))
    return scored.select("doc_id", "text_key", "start", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("digest"), "label", "score", F.coalesce(F.col("score") >= THRESHOLD, F.lit(False)).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with the secrets among the findings replaced. A row is told by its doc_id, null ones too, and its text, so unlike texts of one doc_id keep to their own findings."""
    spans = findings.where("is_secret").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("_spans"))
    rows = held_whole(docs, _doc=F.col("doc_id"), _text=F.col("text"), _own=F.xxhash64("text"))
    joined = rows.join(spans, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")), "left")
    end = lambda i: F.when(i < 0, 0).otherwise(F.get("_spans", i)["start"] + F.get("_spans", i)["length"])
    between = lambda i, upto: F.substr(F.col("_text"), (end(i) + 1).cast("int"), (upto - end(i)).cast("int"))
    pieces = F.transform("_spans", lambda s, i: F.concat(between(i - 1, s["start"]), F.lit(mark)))
    text = F.concat(F.array_join(pieces, ""), between(F.size("_spans") - 1, F.length("_text").cast("long")))
    return let_go(joined, docs.columns, text=F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(text))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), "text")).drop("text_key")
