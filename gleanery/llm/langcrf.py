"""Language identification by a linear-chain conditional random field over words.

Each word with a letter is a link of the chain and a language its state. A word's evidence are its characters, character 2- and
3-grams, prefixes and suffixes of up to four letters, all hashed, and its entry in a lexicon of words that tell
languages; neighbouring words are tied by learned transitions. Forward and backward messages give each word its
languages' probabilities, so a text that switches languages is labelled word by word (``spans``). A document's language is
the one with the largest mean probability over its words, and that mean is its score.

The fit sees a bounded sample of labelled documents: about ``SAMPLE`` in all and ``PER_LANG`` of each language, of at most ``FITTED_CHARS``
characters, of the ``MOST_LANGS`` languages with most documents. Documents are cut into runs of words, and runs of several languages
are put one behind another, so that the transitions have switches to learn from. Every word of every document is then scored.

Texts of any length are worked through in pieces of ``PIECE`` words side by side. A piece begins with what the one
before it handed on; pieces whose input has changed are done again until none has, so the result is that of the whole chain.

Defined results: a null text and one without a letter are ``und`` with score 0; equal means go to the smaller language; without a
labelled document everything is ``und`` with score 0; repeated rows are scored alike and learned from once; null doc_ids are scored, not held out and not learned from; an
empty table gives an empty table; other columns are ignored. Words of more than ``LONGEST`` characters count as several.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import evenly, table

FOLDS = 5
SAMPLE, PER_LANG, LEAST_LANG, MOST_LANGS, FITTED_CHARS = 4000, 200, 10, 256, 20_000
HASH_BITS, LONGEST = 16, 32
#: Words of each language in the lexicon, at most, the fewest times one must be seen, and the steps of its log-odds.
LEXICON, SEEN, LEVELS = 5000, 3, 4
LINKS, SEQUENCES, EPOCHS, RATE, DECAY = 48, 128, 3, 0.05, 1e-5
PIECE, CLOSE = 64, 1e-9
KEPT_WORDS, BATCH_CHARS = 300_000, 2_000_000
UNKNOWN = "und"
_GRAMS, _AFFIXES = (1, 2, 3), (4, 5)


def words_in(text: str | None) -> list[str]:
    words = text.split() if text else []
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]


def letters_of(word: str) -> str:
    low = word.lower()
    return low if low.isalpha() else "".join(filter(str.isalpha, low))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features, number of each word's) of words of at least one letter."""
    flat = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = sizes[owner] - place
    found, owners = [], []
    h = np.zeros(len(flat), np.uint64)
    for n in (*_GRAMS, *_AFFIXES):
        # h[i] covers n characters from i on.
        h = (h[: len(flat) - n + 1] ^ flat[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        p, r = place[: len(h)], left[: len(h)]
        keep = (p > 0) & (r > 1) if n == 1 else r >= n if n in _GRAMS else (r == n) | ((p == 0) & (r >= n))
        found.append(((h[keep] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - HASH_BITS)).astype(np.int64))
        owners.append(owner[: len(h)][keep])
    owners = np.concatenate(owners)
    return np.concatenate(found)[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))


class Words:
    """Numbers words with letters from 1; 0 stands for words without."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.letters: list[str] = [""]
        self._of: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        out = list(map(self.number.get, words))
        if None in out:
            out = [self._add(w) if k is None else k for w, k in zip(words, out, strict=True)]
        return np.array(out, np.int64)

    def _add(self, word: str) -> int:
        letters = letters_of(word)
        k = self._of.get(letters) if letters else 0
        if k is None:
            k = self._of[letters] = len(self.letters)
            self.letters.append(letters)
        self.number[word] = k
        return k


class Model:
    """Languages in order, weights of hashed and lexicon features, transitions and starts."""

    def __init__(self, langs: list[str], lexicon: dict[str, int]):
        k = len(langs)
        self.langs, self.lexicon = langs, lexicon
        self.weights = np.zeros(((1 << HASH_BITS) + k * LEVELS, k))
        self.moves, self.start = np.zeros((k, k)), np.zeros(k)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features of words and the number of each word's."""
        found, sizes = features(words)
        known = [(i, (1 << HASH_BITS) + self.lexicon[w]) for i, w in enumerate(words) if w in self.lexicon]
        if known:
            at, more = np.array(known).T
            found, sizes = np.insert(found, np.cumsum(sizes)[at], more), sizes + np.bincount(at, minlength=len(sizes))
        return found, sizes

    def evidence(self, words: list[str]) -> np.ndarray:
        """Log potentials of each word's languages."""
        if not words:
            return np.zeros((0, len(self.langs)))
        out = []
        for i in range(0, len(words), 16_384):
            found, sizes = self.inputs(words[i : i + 16_384])
            out.append(np.add.reduceat(self.weights[found], np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None])
        return np.concatenate(out)


def lexicon_of(counts: dict[str, Counter], langs: list[str]) -> dict[str, int]:
    """word -> language and step of log-odds, as a number, for words that are seen often and tell their language."""
    every = sum(counts.values(), Counter())
    sizes = {x: sum(counts[x].values()) + 1 for x in langs}
    out = {}
    for k, lang in enumerate(langs):
        rest = sum(sizes.values()) - sizes[lang]
        told = []
        for w, n in counts[lang].items():
            odds = np.log((n / sizes[lang]) / ((every[w] - n + 0.5) / max(rest, 1)))
            if n >= SEEN and odds > 0.5:
                told.append((n, w, odds))
        for _, w, odds in sorted(told, reverse=True)[:LEXICON]:
            level = min(LEVELS - 1, int(odds / 1.5))
            if w not in out or out[w] % LEVELS < level:
                out[w] = k * LEVELS + level
    return out


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def chain(evidence: np.ndarray, starts: np.ndarray, model: Model) -> np.ndarray:
    """Each link's probabilities, by forward-backward over chains that begin at ``starts``; no chain is empty."""
    n, k = evidence.shape
    phi, moves = np.exp(evidence - evidence.max(axis=1, keepdims=True)), np.exp(model.moves - model.moves.max())
    ends = np.append(starts[1:], n)
    pieces = np.concatenate([np.arange(s, e, PIECE) for s, e in zip(starts, ends, strict=True)])
    first = np.isin(pieces, starts)
    sizes = np.diff(np.append(pieces, n))
    ahead, back = np.empty((n, k)), np.empty((n, k))
    incoming = np.where(first[:, None], _normal(np.exp(model.start - model.start.max())), 1 / k)
    last = np.append(first[1:], True)

    def passes(incoming: np.ndarray, hands_on: np.ndarray, to: int, run) -> None:
        """Do the pieces, then again those whose input has changed. hands_on: pieces with a neighbour in direction ``to``."""
        todo = np.arange(len(pieces))
        while len(todo):
            todo = todo[np.argsort(-sizes[todo], kind="stable")]
            handed = run(todo, incoming[todo])
            giving = hands_on[todo]
            into, now = todo[giving] + to, handed[giving]
            changed = np.abs(incoming[into] - now).max(axis=1, initial=0) > CLOSE
            incoming[into] = now
            todo = into[changed]

    def forward(todo: np.ndarray, message: np.ndarray) -> np.ndarray:
        m, longest = message.copy(), sizes[todo]
        for t in range(int(longest.max())):
            a = int(np.searchsorted(-longest, -t, "left"))
            rows = pieces[todo[:a]] + t
            ahead[rows] = v = _normal(m[:a] * phi[rows])
            m[:a] = v @ moves
        return _normal(m)

    def backward(todo: np.ndarray, message: np.ndarray) -> np.ndarray:
        m, longest = message.copy(), sizes[todo]
        for t in range(int(longest.max())):
            a = int(np.searchsorted(-longest, -t, "left"))
            rows = pieces[todo[:a]] + longest[:a] - 1 - t
            back[rows] = m[:a]
            m[:a] = _normal((phi[rows] * m[:a]) @ moves.T)
        return m

    passes(incoming, ~last, 1, forward)
    passes(np.full((len(pieces), k), 1 / k), ~first, -1, backward)
    return _normal(ahead * back)


def gradients(model: Model, evidence: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood of sequences (s, t, languages) and its gradients by evidence, moves and start."""
    s, length, k = evidence.shape
    moves = np.exp(model.moves)
    phi = np.exp(evidence - evidence.max(axis=2, keepdims=True))
    ahead, back = np.empty_like(phi), np.ones_like(phi)
    value = evidence.max(axis=2).sum()
    v = np.exp(model.start) * phi[:, 0]
    for t in range(length):
        v = v if t == 0 else (ahead[:, t - 1] @ moves) * phi[:, t]
        scale = v.sum(axis=1, keepdims=True)
        value += np.log(scale).sum()
        ahead[:, t] = v / scale
    for t in range(length - 2, -1, -1):
        back[:, t] = _normal((phi[:, t + 1] * back[:, t + 1]) @ moves.T)
    is_label = np.eye(k)[labels]
    gold = (evidence * is_label).sum() + model.start[labels[:, 0]].sum() + model.moves[labels[:, :-1], labels[:, 1:]].sum()
    by_word = is_label - _normal(ahead * back)
    pair = ahead[:, :-1, :, None] * moves * (phi * back)[:, 1:, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    by_move = np.einsum("stk,stl->kl", is_label[:, :-1], is_label[:, 1:]) - pair.sum(axis=(0, 1))
    return gold - value, by_word, by_move, by_word[:, 0].sum(axis=0)


def switched(docs: list[np.ndarray], langs: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(words, languages) of sequences of ``LINKS`` words, put together from runs of the documents' words."""
    runs: dict[int, list] = {}
    for words, lang in zip(docs, langs, strict=True):
        i = 0
        while i < len(words):
            n = int(rng.integers(3, 30))
            runs.setdefault(int(lang), []).append(words[i : i + n])
            i += n
    for x in runs.values():
        rng.shuffle(x)
    names, most = list(runs), max(map(len, runs.values()))
    out_words, out_langs = [], []
    lang = names[0]
    for i in range(most * len(names)):
        lang = lang if rng.random() < 0.5 else names[int(rng.integers(len(names)))]
        run = runs[lang][i % len(runs[lang])]
        out_words.append(run)
        out_langs.append(np.full(len(run), lang))
    words, labels = np.concatenate(out_words), np.concatenate(out_langs)
    n = len(words) // LINKS * LINKS
    if not n:
        return np.resize(words, (1, LINKS)), np.resize(labels, (1, LINKS))
    return words[:n].reshape(-1, LINKS), labels[:n].reshape(-1, LINKS)


def fit(texts: list[str], langs: list[str], seed: int = 11) -> Model | None:
    """Fit on whole texts and their languages; None if no text has a letter."""
    words, rng = Words(), np.random.default_rng(seed)
    docs = [words.of(words_in(t)) for t in texts]
    docs = [(d[d > 0], lang) for d, lang in zip(docs, langs, strict=True) if (d > 0).any()]
    if not docs:
        return None
    names = sorted({lang for _, lang in docs})
    counts = {lang: Counter() for lang in names}
    for d, lang in docs:
        counts[lang].update(words.letters[i] for i in d)
    model = Model(names, lexicon_of(counts, names))
    found, sizes = model.inputs(words.letters[1:])
    upto = np.concatenate([[0, 0], np.cumsum(sizes)])
    sizes = np.concatenate([[1], sizes])
    code = {lang: i for i, lang in enumerate(names)}
    labels = np.array([code[lang] for _, lang in docs])
    sums = {name: np.full_like(getattr(model, name), 1e-3) for name in ("weights", "moves", "start")}
    for _ in range(EPOCHS):
        seq, gold = switched([d for d, _ in docs], labels, rng)
        order = rng.permutation(len(seq))
        for i in range(0, len(order), SEQUENCES):
            pick = order[i : i + SEQUENCES]
            types, at = np.unique(seq[pick], return_inverse=True)
            n = sizes[types]
            used = np.concatenate([found[upto[t] : upto[t + 1]] for t in types])
            evidence = np.add.reduceat(model.weights[used], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None]
            _, by_word, by_move, by_start = gradients(model, evidence[at.reshape(len(pick), LINKS)], gold[pick])
            by_type = np.zeros_like(evidence)
            np.add.at(by_type, at.ravel(), by_word.reshape(-1, len(names)))
            by_weight = np.zeros_like(model.weights)
            np.add.at(by_weight, used, np.repeat(by_type / np.sqrt(n)[:, None], n, axis=0))
            scale = 1 / len(pick)
            for name, grad in (("weights", by_weight * scale - DECAY * model.weights), ("moves", by_move * scale), ("start", by_start * scale)):
                sums[name] += grad * grad
                getattr(model, name)[...] += RATE * grad / np.sqrt(sums[name])
    return model


class Labeller:
    """Labels texts, and keeps the evidence of the words met, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.words = model, Words()
        self.evidence = np.zeros((1, len(model.langs)))

    def of(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the places of its words with letters and their probabilities, a few texts at a time."""
        i = 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars < BATCH_CHARS):
                chars, j = chars + len(texts[j] or ""), j + 1
            if len(self.words.number) > KEPT_WORDS:
                self.__init__(self.model)
            numbered = [self.words.of(words_in(t)) for t in texts[i:j]]
            fresh = self.words.letters[len(self.evidence) :]
            if fresh:
                self.evidence = np.concatenate([self.evidence, self.model.evidence(fresh)])
            places = [np.flatnonzero(d) for d in numbered]
            ends = np.cumsum([len(p) for p in places])
            flat = np.concatenate([d[p] for d, p in zip(numbered, places, strict=True)])
            starts = np.unique(np.append(0, ends)[:-1])
            p = chain(self.evidence[flat], starts[starts < len(flat)], self.model) if len(flat) else np.zeros((0, len(self.model.langs)))
            yield from zip(places, np.split(p, ends[:-1]), strict=True)
            i = j

    def language(self, p: np.ndarray) -> tuple[str, float]:
        """A text's language and score, from its words' probabilities."""
        if not len(p):
            return UNKNOWN, 0.0
        mean = p.mean(axis=0)
        return self.model.langs[int(mean.argmax())], min(float(mean.max()), 1.0)

    def runs(self, places: np.ndarray, p: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(language, first word, last word, mean probability) of each run of one language; words without letters lie within or between runs."""
        if not len(p):
            return []
        best = p.argmax(axis=1)
        cuts = np.flatnonzero(np.diff(best)) + 1
        parts = zip(np.append(0, cuts), np.append(cuts, len(best)), strict=True)
        return [(self.model.langs[best[i]], int(places[i]), int(places[j - 1]), min(float(p[i:j, best[i]].mean()), 1.0)) for i, j in parts]


def predictions(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(sent.value) if sent.value else None
        for frame in frames:
            found = [labeller.language(p) for _, p in labeller.of(frame["text"].tolist())] if labeller else [(UNKNOWN, 0.0)] * len(frame)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "lang_pred": pd.Series([x for x, _ in found], dtype=object), "score": pd.Series([x for _, x in found], dtype=float)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(predict, "doc_id long, lang_pred string, score double")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, spans) of each row of (doc_id, text): the runs of one language, with the numbers of their first and last word."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(sent.value)
        for frame in frames:
            found = [[dict(zip(("lang", "first", "last", "score"), r, strict=True)) for r in labeller.runs(*x)] for x in labeller.of(frame["text"].tolist())]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "spans": pd.Series(found, dtype=object)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(label, "doc_id long, spans array<struct<lang: string, first: long, last: long, score: double>>")


def labelled_sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """Texts and languages of the documents that the fit sees, drawn by a hash of doc_id and text evenly from each language."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    known = docs.where(F.col("lang").isNotNull() & (fold != 0) & F.col("text").rlike(r"\p{L}") & (F.length("text") <= FITTED_CHARS)).select("doc_id", "lang", "text")
    # At most MOST_LANGS rows.
    counts = known.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_lang").limit(MOST_LANGS).collect()
    if not counts:
        return [], []
    each = max(LEAST_LANG, min(PER_LANG, SAMPLE // len(counts)))
    scale = 1 << 40
    least = known.sparkSession.createDataFrame([(r["_lang"], min(scale, each * scale // r["_n"])) for r in counts], "_lang string, _below long")
    drawn = known.join(F.broadcast(least), F.col("lang") == F.col("_lang")).where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id", F.xxhash64("text")), F.lit(scale)) < F.col("_below"))
    rows = sorted(set(map(tuple, drawn.select("doc_id", "lang", "text").collect())))
    return [r[2] for r in rows], [r[1] for r in rows]


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of (doc_id, text, lang)."""
    model = fit(*labelled_sample(docs))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0, F.lit(False))
    return predictions(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(evenly(table(spark, sf_dir, "documents")))
