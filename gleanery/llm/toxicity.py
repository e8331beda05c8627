"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own embedding beside the mean embedding of its character 3- and 4-grams. A word of more than
``LONGEST`` bytes, as unspaced scripts have them, enters as overlapping chunks that count as words; what a chunk is
cut to says nothing, so all chunks share one embedding and differ by their grams. The network
reads windows of ``WINDOW`` words, each overlapping the next by half; a document scores as its worst window,
calibrated on training documents. It is fitted on a bounded sample of labelled documents (about
``SAMPLE`` of each label, of at most ``FITTED_CHARS`` characters each, which bounds the driver's memory); every window of every document is then scored on the executors.

Labels say only that some window of a document is toxic. So each round of training takes, of the toxic
documents, the window that scores worst so far, and of the others their worst and a random one.

Defined results: null and wordless texts have no window and score 0; repeated rows score alike; a table
without labels of both kinds gives 0 for every document; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drawn, table

WINDOW, STRIDE = 32, 16
#: Labelled documents of each label that the fit may see, about, drawn by a hash of their ids, and the longest of them.
SAMPLE, FITTED_CHARS = 1500, 40_000
HIDDEN, EMBED, HASH_BITS = 8, 6, 15
ROUNDS, EPOCHS, BATCH, RATE = 4, 3, 256, 0.01
BATCH_WINDOWS = 2048
KEPT_WORDS = 300_000
#: Longer words are cut into chunks of ``CHUNK`` bytes, each overlapping the next by half, so that no part of a text is left out.
LONGEST, CHUNK = 64, 32
#: Words whose inputs are made at once.
INPUT_WORDS = 16_384
THRESHOLD = 0.7
_MASK = (1 << HASH_BITS) - 1


def words_in(text: str | None) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [part for word in words for part in (chunks(word) if len(word) > LONGEST else (word,))]


def chunks(word: bytes) -> list[bytes]:
    """Chunks that cover a word with its ends marked; the last one ends with it. Each begins with a blank, which no word holds."""
    w = b"<" + word + b">"
    last = len(w) - CHUNK
    return [b" " + w[i : i + CHUNK] for i in (*range(0, last, CHUNK // 2), last)]


def grams(word: bytes) -> array:
    """Hashed character 3- and 4-grams of a word with its ends marked, or of a chunk."""
    w = word[1:] if word[:1] == b" " else b"<" + word + b">"
    return array("H", [crc32(w[i : i + n]) & _MASK for n in (3, 4) for i in range(max(1, len(w) - n + 1))])


def windows_of(n: int) -> np.ndarray:
    """Starts of the windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    return np.unique(np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW))


class Words:
    """Numbers words from 1 and holds their hashed word and character features; 0 is padding."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.word: list[int] = [0]
        self.gram: list[array] = [array("H", [0])]

    def of(self, words: list[bytes]) -> np.ndarray:
        number, get = self.number, self.number.get
        out = np.fromiter(map(get, words, itertools.repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(out < 0):
            w = words[i]
            if w not in number:
                number[w] = len(self.word)
                self.word.append(crc32(b" " if w[:1] == b" " else w) & _MASK)
                self.gram.append(grams(w))
            out[i] = number[w]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, seed: int = 4):
        rng = np.random.default_rng(seed)
        w = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        self.p = {"word": w(_MASK + 1, EMBED, s=0.1), "gram": w(_MASK + 1, EMBED, s=0.1), "attend": w(2 * HIDDEN, s=0.3), "out": w(2 * HIDDEN, s=0.3), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": w(2 * EMBED, 3 * HIDDEN, s=0.4), f"U{d}": w(HIDDEN, 3 * HIDDEN, s=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, words: Words, start: int = 0) -> np.ndarray:
        """One input row for each word from number ``start`` on."""
        out = np.empty((len(words.word) - start, 2 * EMBED), np.float32)
        out[:, :EMBED] = self.p["word"][np.array(words.word[start:], np.int64)]
        for i in range(0, len(out), INPUT_WORDS):
            some = words.gram[start + i : start + i + INPUT_WORDS]
            sizes = np.array([len(g) for g in some])
            flat = np.fromiter(itertools.chain.from_iterable(some), np.int64, sizes.sum())
            out[i : i + len(some), EMBED:] = np.add.reduceat(self.p["gram"][flat], np.cumsum([0, *sizes[:-1]]), axis=0) / sizes[:, None]
        return out

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Both directions' gate inputs of each word."""
        return np.concatenate([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]], axis=1)

    def forward(self, gates: np.ndarray, real: np.ndarray, keep: bool = False) -> tuple:
        """Logits of windows, from gates [n, t, 6 * HIDDEN] and which words are real [n, t]."""
        n, t, _ = gates.shape
        states, kept = np.empty((n, t, 2 * HIDDEN), np.float32), []
        h_ = HIDDEN
        full = bool(real.all())
        for d, order in enumerate((range(t), range(t - 1, -1, -1))):
            U, h = self.p["Ub" if d else "Uf"], np.zeros((n, h_), np.float32)
            for i in order:
                x, u = gates[:, i, 3 * h_ * d : 3 * h_ * (d + 1)], h @ U
                zr = _sigmoid(x[:, : 2 * h_] + u[:, : 2 * h_])
                new = np.tanh(x[:, 2 * h_ :] + zr[:, h_:] * u[:, 2 * h_ :])
                nxt = new + zr[:, :h_] * (h - new)
                if not full:
                    nxt = np.where(real[:, i, None], nxt, h)
                if keep:
                    kept.append((d, i, h, zr, new, u[:, 2 * h_ :]))
                h = nxt
                states[:, i, h_ * d : h_ * (d + 1)] = h
        e = np.where(real, states @ self.p["attend"], -1e9)
        a = np.exp(e - e.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        pooled = (a[:, :, None] * states).sum(axis=1)
        return pooled @ self.p["out"] + self.p["bias"][0], states, a, pooled, kept

    def gradients(self, ids: np.ndarray, labels: np.ndarray, words: Words) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss over windows of word numbers (0: padding)."""
        distinct, at = np.unique(ids, return_inverse=True)
        at = at.reshape(ids.shape)
        sizes = np.array([len(words.gram[k]) for k in distinct])
        flat = np.fromiter(itertools.chain.from_iterable(words.gram[k] for k in distinct), np.int64, sizes.sum())
        hashed = np.array([words.word[k] for k in distinct])
        mean = np.add.reduceat(self.p["gram"][flat], np.cumsum([0, *sizes[:-1]]), axis=0) / sizes[:, None]
        x = np.concatenate([self.p["word"][hashed], mean], axis=1).astype(np.float32)
        real = ids > 0
        logits, states, a, pooled, kept = self.forward(self.projected(x)[at], real, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d_logit = ((_sigmoid(logits) - labels) / len(labels)).astype(np.float32)
        g["bias"][0], g["out"] = d_logit.sum(), pooled.T @ d_logit
        d_pooled = d_logit[:, None] * self.p["out"]
        d_a = states @ d_pooled[:, :, None]
        d_e = a * (d_a[:, :, 0] - (a * d_a[:, :, 0]).sum(axis=1, keepdims=True))
        g["attend"] = np.einsum("nt,nth->h", d_e, states)
        d_states = a[:, :, None] * d_pooled[:, None, :] + d_e[:, :, None] * self.p["attend"]
        d_gates = np.zeros((*ids.shape, 6 * HIDDEN), np.float32)
        h_, carry, way = HIDDEN, None, None
        for d, i, h, zr, new, un in reversed(kept):
            U = self.p["Ub" if d else "Uf"]
            if way != d:
                carry, way = np.zeros_like(h), d
            total = carry + d_states[:, i, h_ * d : h_ * (d + 1)]
            live = np.where(real[:, i, None], total, 0)
            z, r = zr[:, :h_], zr[:, h_:]
            d_new = live * (1 - z) * (1 - new * new)
            d_z = live * (h - new) * z * (1 - z)
            d_r = d_new * un * r * (1 - r)
            d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_gates[:, i, 3 * h_ * d : 3 * h_ * (d + 1)] = np.concatenate([d_z, d_r, d_new], axis=1)
            g["Ub" if d else "Uf"] += h.T @ d_u
            carry = live * z + d_u @ U.T + (total - live)
        d_word = np.zeros((len(distinct), 6 * HIDDEN), np.float32)
        np.add.at(d_word, at.ravel(), d_gates.reshape(-1, 6 * HIDDEN))
        d_x = np.zeros_like(x)
        for d, part in (("f", d_word[:, : 3 * h_]), ("b", d_word[:, 3 * h_ :])):
            g[f"W{d}"], g[f"c{d}"] = x.T @ part, part.sum(axis=0)
            d_x += part @ self.p[f"W{d}"].T
        np.add.at(g["word"], hashed, d_x[:, :EMBED])
        np.add.at(g["gram"], flat, np.repeat(d_x[:, EMBED:] / sizes[:, None], sizes, axis=0))
        return g

    def worst(self, texts: list[np.ndarray], gates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text of word numbers, the greatest logit of its windows and that window's start (none: -inf, 0)."""
        best, start_of = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
        starts = [windows_of(len(t)) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        if not len(owner):
            return best, start_of
        offset = np.cumsum([0, *[len(t) for t in texts[:-1]]])
        begin = np.concatenate(starts)
        flat = np.concatenate([*texts, np.zeros(WINDOW, np.int64)])
        length = np.array([len(t) for t in texts])[owner]
        order = np.argsort(length < WINDOW, kind="stable")
        logits = np.empty(len(owner), np.float32)
        span = np.arange(WINDOW)
        for i in range(0, len(order), BATCH_WINDOWS):
            k = order[i : i + BATCH_WINDOWS]
            real = span < length[k, None]
            ids = np.where(real, flat[(offset[owner[k]] + begin[k])[:, None] + span], 0)
            width = int(min(length[k].max(), WINDOW))
            logits[k] = self.forward(gates[ids[:, :width]], real[:, :width])[0]
        np.maximum.at(best, owner, logits)
        hit = np.flatnonzero(logits == best[owner].astype(np.float32))
        start_of[owner[hit[::-1]]] = begin[hit[::-1]]
        return best, start_of

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(logit), _sigmoid(self.scale * logit + self.shift), 0.0)


def _log_odds(items: Iterable[set[int]], labels: np.ndarray, size: int) -> np.ndarray:
    counts = np.ones((2, size))
    for s, y in zip(items, labels, strict=True):
        counts[int(y), list(s)] += 1
    return np.log(counts[1] / (labels.sum() + 2)) - np.log(counts[0] / ((1 - labels).sum() + 2))


def fit(texts: list[str | None], labels: np.ndarray, seed: int = 4) -> Network:
    """Fit on whole texts and their labels (0 or 1)."""
    net, words, rng = Network(seed), Words(), np.random.default_rng(seed)
    docs = [words.of(words_in(t)) for t in texts]
    some = [i for i, d in enumerate(docs) if len(d)]
    docs, labels = [docs[i] for i in some], labels[some].astype(float)
    # The first coordinate of each embedding starts as the feature's log-odds among the training documents.
    seen = [np.unique(d) for d in docs]
    net.p["word"][:, 0] = np.clip(_log_odds(({words.word[k] for k in s} for s in seen), labels, _MASK + 1), -4, 4) / 4
    net.p["gram"][:, 0] = np.clip(_log_odds(({g for k in s for g in words.gram[k]} for s in seen), labels, _MASK + 1), -4, 4) / 4
    x = net.inputs(words)
    prior = x[:, 0] + 2 * x[:, EMBED]
    pick = np.array([np.argmax(prior[d]) if y else rng.integers(len(d)) for d, y in zip(docs, labels, strict=True)])
    pick = np.array([min(max(0, k - WINDOW // 2), max(0, len(d) - WINDOW)) for k, d in zip(pick, docs, strict=True)])
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for number in range(ROUNDS):
        if number:
            _, pick = net.worst(docs, net.projected(net.inputs(words)))
        extra = [(i, int(rng.integers(max(1, len(d) - WINDOW + 1)))) for i, d in enumerate(docs) if not labels[i]]
        chosen = [*enumerate(pick), *extra]
        ids = np.zeros((len(chosen), WINDOW), np.int64)
        for row, (i, start) in enumerate(chosen):
            part = docs[i][start : start + WINDOW]
            ids[row, : len(part)] = part
        y = labels[[i for i, _ in chosen]]
        for _ in range(EPOCHS):
            order = rng.permutation(len(ids))
            for i in range(0, len(order), BATCH):
                k, step = order[i : i + BATCH], step + 1
                for name, grad in net.gradients(ids[k], y[k], words).items():
                    m, v = moments[name]
                    m += 0.1 * (grad - m)
                    v += 0.01 * (grad * grad - v)
                    net.p[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    logit, _ = net.worst(docs, net.projected(net.inputs(words)))
    a, b = 1.0, 0.0
    for _ in range(200):  # calibration by gradient steps
        e = _sigmoid(a * logit + b) - labels
        a, b = a - 0.05 * float((e * logit).mean()), b - 0.3 * float(e.mean())
    net.scale, net.shift = max(a, 0.05), b
    return net


def scores(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, score) of each row of (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net, words, gates = sent.value, Words(), None
        for part in parts:
            out = np.zeros(len(part))
            i, texts = 0, part.tolist()
            while net is not None and i < len(texts):
                # A few documents at a time, so that very long ones don't pile up.
                j, chars = i, 0
                while j < len(texts) and (j == i or chars < 2_000_000):
                    chars, j = chars + len(texts[j] or ""), j + 1
                if gates is None or len(words.word) > KEPT_WORDS:
                    words, gates = Words(), net.projected(net.inputs(Words()))
                numbered = [words.of(words_in(t)) for t in texts[i:j]]
                if len(words.word) > len(gates):
                    gates = np.concatenate([gates, net.projected(net.inputs(words, len(gates)))])
                out[i:j] = net.probability(net.worst(numbered, gates)[0])
                i = j
            yield pd.Series(out)

    return docs.select("doc_id", score("text").alias("score"))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list, np.ndarray]:
    """Texts and labels of about ``sample`` training documents of each label; a document with both labels counts for each."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    known = labels.where(fold != 1).where("toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    chosen = [drawn(known.where(F.col("toxic") == y), F.col("doc_id"), sample) for y in (0, 1)]
    short = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= FITTED_CHARS)
    # About 2 * sample rows, which bounds the broadcast and what comes to the driver; copies of a row count once.
    rows = short.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").distinct().toPandas().sort_values(["doc_id", "toxic", "text"])
    return rows["text"].tolist(), rows["toxic"].to_numpy()


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    texts, y = labelled_sample(docs, labels, sample)
    net = fit(texts, y) if 0 < y.sum() < len(y) else None
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return scores(docs.select("doc_id", "text"), net).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
