"""Language-model scores from an n-gram trie in Elias-Fano form.

The trie has two levels, words and their successors, with absolute discounting: p(w | v) = a(v, w) + b(v) p(w),
where a = (c(v, w) - D) / c(v), b = D types(v) / c(v) and p(w) adds 0.1 to each count. It is counted over
all training documents and kept in shards. A shard holds the successors of a range of contexts that fills up
to ``SHARD`` training tokens; a context that fills more is split over several shards by its successors' hash.
Contexts, pointers and successors are monotone sequences in Elias-Fano code, a and b are quantised logarithms;
the levels are written to a file and mapped, and queried where they lie: two pointers bound a context's successors,
and a word is searched between them.

Nothing is asked word by word or document by document. Documents are gathered into blocks of about ``BLOCK``
words, a block asks each shard once about its distinct words and word pairs, and the answers come back to the
block, where its documents are scored. So what moves grows with the distinct pairs of the blocks.

Defined results: a null or wordless text is its end token alone; a null doc_id counts as training; repeated rows are counted and
scored each; an empty table gives an empty table; other columns are ignored. Words are told apart by 64-bit
hashes. Each shard counts the successor types of its split contexts, at most two, and types(v) is their sum over its parts, in scores and kept tries alike.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

HELD_OUT = 10
ADD, DISCOUNT = 0.1, 0.8
BLOCK, SHARD, WORD_SHARD = 1_000_000, 1_000_000, 1_000_000
KEPT_WORDS = 500_000
#: Logarithms are kept in steps of 1 / STEPS, as 1 + STEPS * -log10(p); 0 says that there is none.
STEPS = 4096
UNKNOWN = np.uint64(0xFFFFFFFF)
_64 = np.uint64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


END = xxhash.xxh64_intdigest(b" ")  # no word holds a blank


def packed(a: np.ndarray) -> bytes:
    """An array's bytes, plane by plane, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 1)


def unpacked(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1).T).view(kind).ravel()


def packed_steps(a: np.ndarray) -> bytes:
    """A non-decreasing sequence as its packed steps."""
    return packed(np.diff(a, prepend=0))


def unpacked_steps(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b, np.int64))


class EliasFano:
    """A non-decreasing sequence: the low bits of each value packed, the high bits in unary, and how many ones come before each word of these.

    Nothing is unpacked: a value is read where it lies, so a mapped sequence takes no memory of its own.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.before = n, low_bits, low, high, before

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
        n = len(values)
        bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 2, _64)
        if bits and n:
            at = np.arange(n, dtype=_64) * _64(bits)
            word, off, v = (at >> _64(6)).astype(np.int64), at & _64(63), values & _64((1 << bits) - 1)
            np.bitwise_or.at(low, word, v << off)
            over = np.flatnonzero(off + _64(bits) > _64(64))
            np.bitwise_or.at(low, word[over] + 1, v[over] >> (_64(64) - off[over]))
        high = (values >> _64(bits)).astype(np.int64)
        unary = np.zeros(-(-(int(high[-1]) + n + 1 if n else 1) // 64) * 64, np.uint8)
        unary[high + np.arange(n)] = 1
        words = np.packbits(unary, bitorder="little").view(_64)
        ones = np.bitwise_count(words).astype(np.int64)
        return n, bits, low, words, (np.cumsum(ones) - ones).astype(np.uint32)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), _64)
        at = i.astype(_64) * _64(self.low_bits)
        word, off = (at >> _64(6)).astype(np.int64), at & _64(63)
        spill = np.where(off > 0, self.low[word + 1] << ((_64(64) - off) & _64(63)), _64(0))
        return ((self.low[word] >> off) | spill) & _64((1 << self.low_bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, i.astype(np.uint32), side="right") - 1
        bits, rest, place = np.asarray(self.high[word]), i - self.before[word].astype(np.int64), word * 64
        for width in (32, 16, 8, 4, 2, 1):  # the place of one number ``rest`` of the word, by halves
            ones = np.bitwise_count(bits & _64((1 << width) - 1)).astype(np.int64)
            up = rest >= ones
            rest, place = rest - np.where(up, ones, 0), place + np.where(up, width, 0)
            bits = np.where(up, bits >> _64(width), bits)
        return ((place - i).astype(_64) << _64(self.low_bits)) | self._low(i)

    def find(self, x: np.ndarray, first: np.ndarray | int = 0, end: np.ndarray | None = None) -> np.ndarray:
        """The place of each value among those from ``first`` up to ``end``, or -1."""
        end = np.full(len(x), self.n) if end is None else end
        lo, hi = np.zeros(len(x), np.int64) + first, end.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            less = self[mid] < x[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        hit = lo < end
        hit[hit] = self[lo[hit]] == x[hit]
        return np.where(hit, lo, -1)


def coded(p: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.round(-np.log10(p) * STEPS), 65535).astype(np.uint16)


def decoded(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((1 - code.astype(float)) / STEPS), 0.0)


def build_trie(pairs: np.ndarray, counts: np.ndarray, context_counts: np.ndarray, vocabulary: int) -> bytes:
    """The levels of one shard, from sorted pairs (context << 32 | word), their counts and those of their distinct contexts."""
    contexts, first = np.unique(pairs >> _64(32), return_index=True)
    types = np.diff(np.append(first, len(pairs)))
    rank = np.repeat(np.arange(len(contexts), dtype=_64), types)
    a = coded((counts - DISCOUNT) / np.repeat(context_counts, types))
    b = coded(DISCOUNT * types / context_counts)
    levels = [EliasFano.encode(contexts, vocabulary), EliasFano.encode(np.append(first, len(pairs)).astype(_64), len(pairs) + 1), EliasFano.encode(rank * _64(vocabulary) + (pairs & UNKNOWN), max(1, len(contexts)) * vocabulary)]
    parts = [x.tobytes().ljust(-(-x.nbytes // 8) * 8, b"\0") for k in (2, 3, 4) for x in (level[k] for level in levels)]
    head = np.array([x for n, bits, *arrays in levels for x in (n, bits, *map(len, arrays))] + [vocabulary], np.int64)
    return b"".join([head.tobytes(), *parts, a.tobytes(), b.tobytes()])


class Trie:
    """A shard's levels, mapped from a file."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as file:  # has no name, so nothing is left behind
            file.write(data)
            file.flush()
            whole = np.memmap(file, np.uint8, "r")
        head, at = whole[: 16 * 8].view(np.int64), 16 * 8
        levels: list[list[np.ndarray]] = [[], [], []]
        for part, kind in ((2, _64), (3, _64), (4, np.uint32)):
            for k in range(3):
                size = int(head[5 * k + part]) * np.dtype(kind).itemsize
                levels[k].append(whole[at : at + size].view(kind))
                at += -(-size // 8) * 8
        self.contexts, self.pointers, self.successors = (EliasFano(int(head[5 * k]), int(head[5 * k + 1]), *levels[k]) for k in range(3))
        self.a = whole[at : at + 2 * self.successors.n].view(np.uint16)
        self.b = whole[at + 2 * self.successors.n :].view(np.uint16)
        self.vocabulary = int(head[15])

    def types(self, contexts: np.ndarray) -> np.ndarray:
        """How many successors each context has in this shard."""
        rank = self.contexts.find(contexts)
        at = np.maximum(rank, 0)
        return np.where(rank >= 0, self.pointers[at + 1].astype(np.int64) - self.pointers[at].astype(np.int64), 0) if self.contexts.n else np.zeros(len(contexts), np.int64)

    def ask(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of a for sorted pairs and of b for their distinct contexts; 0 where there is none."""
        contexts, at = np.unique(pairs >> _64(32), return_inverse=True)
        rank = self.contexts.find(contexts)
        b = np.where(rank >= 0, self.b[np.maximum(rank, 0)], 0).astype(np.uint16) if len(self.b) else np.zeros(len(contexts), np.uint16)
        a = np.zeros(len(pairs), np.uint16)
        word = pairs & UNKNOWN
        known = np.flatnonzero((rank[at] >= 0) & (word < _64(self.vocabulary)))
        # A context's successors lie between two pointers.
        here = np.flatnonzero(rank >= 0)
        first, end = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
        first[here], end[here] = self.pointers[rank[here]].astype(np.int64), self.pointers[rank[here] + 1].astype(np.int64)
        place = self.successors.find(rank[at[known]].astype(_64) * _64(self.vocabulary) + word[known], first[at[known]], end[at[known]])
        a[known[place >= 0]] = self.a[place[place >= 0]]
        return a, b


def with_b(data: bytes, contexts: np.ndarray, codes: np.ndarray) -> bytes:
    """A shard's trie with other codes of b for those of its contexts that are given."""
    trie = Trie(data)
    rank = trie.contexts.find(contexts) if trie.contexts.n else np.full(len(contexts), -1)
    b = np.array(trie.b)
    b[rank[rank >= 0]] = codes[rank >= 0]
    return data[: len(data) - b.nbytes] + b.tobytes()


def blocks_of(docs: DataFrame) -> DataFrame:
    """Documents in blocks: their ids, lengths and words as places in the block's sorted distinct hashes."""
    fields = "block long, ids binary, has_id binary, held binary, lengths binary, hashes binary, codes binary, n long"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = _Hashes(), TaskContext.get().partitionId() << 32
        ids, held, texts, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            words = np.concatenate(texts)
            distinct, codes = np.unique(words, return_inverse=True)
            return pa.RecordBatch.from_pylist([{
                "block": number, "ids": np.array([i or 0 for i in ids], np.int64).tobytes(), "has_id": np.array([i is not None for i in ids]).tobytes(), "held": np.array(held, bool).tobytes(),
                "lengths": np.array([len(t) for t in texts], np.int64).tobytes(), "hashes": packed(distinct), "codes": packed(codes.astype(np.uint32)), "n": len(distinct)}], schema=schema)

        schema = pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("ids", "has_id", "held", "lengths", "hashes", "codes")], ("n", pa.int64())])
        for batch in batches:
            for doc_id, out_of, text in zip(*(c.to_pylist() if i < 2 else c for i, c in enumerate(batch.columns)), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                texts.append(np.fromiter((*map(hashes.__getitem__, words), END), _64, len(words) + 1))
                ids.append(doc_id)
                held.append(out_of)
                size += len(words) + 1
                if size >= BLOCK:
                    yield out()
                    ids, held, texts, size, number = [], [], [], 0, number + 1
        if texts:
            yield out()

    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(HELD_OUT)) == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held"), "text").mapInArrow(gather, fields)


def _token_counts(codes: np.ndarray, lengths: np.ndarray, held: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(codes[np.repeat(~held, lengths)], minlength=n)


def _read(row) -> tuple:
    lengths, held = np.frombuffer(row.lengths, np.int64), np.frombuffer(row.held, bool)
    return np.frombuffer(row.ids, np.int64), np.frombuffer(row.has_id, bool), held, lengths, unpacked(row.codes, np.uint32).astype(np.int64)


def _asked_words(blocks: DataFrame, bits: int) -> DataFrame:
    """(shard, block, hashes, counts): a block's distinct words by shard, with their training counts."""
    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                _, _, held, lengths, codes = _read(row)
                hashes = unpacked(row.hashes, _64)
                counts = _token_counts(codes, lengths, held, len(hashes))
                cuts = np.searchsorted(hashes >> _64(64 - bits) if bits else np.zeros(len(hashes), _64), np.arange(1, 1 << bits, dtype=_64)) if bits else []
                parts = [(k, h, c) for k, (h, c) in enumerate(zip(np.split(hashes, cuts), np.split(counts, cuts), strict=True)) if len(h)]
                yield pd.DataFrame({"shard": [p[0] for p in parts], "block": row.block, "hashes": [packed(p[1]) for p in parts], "counts": [packed(p[2].astype(np.uint32)) for p in parts]})

    return blocks.mapInPandas(ask, "shard int, block long, hashes binary, counts binary")


def _answered_words(asked: DataFrame) -> DataFrame:
    """(shard, block, numbers, counts, starts, v, n): how many training words come before each word in its shard, its count, and the counts before it."""
    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        hashes = [unpacked(b, _64) for b in frame["hashes"]]
        counts = [unpacked(b, np.uint32) for b in frame["counts"]]
        distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts).astype(float), minlength=len(distinct)).astype(np.int64)
        number, start = np.cumsum(total > 0) - (total > 0), np.cumsum(total) - total
        places = np.split(at, np.cumsum([len(h) for h in hashes])[:-1])
        return pd.DataFrame({"shard": frame["shard"], "block": frame["block"], "numbers": [packed_steps(number[p]) for p in places], "counts": [packed(total[p]) for p in places], "starts": [packed_steps(start[p]) for p in places], "v": int((total > 0).sum()), "n": int(total.sum())})

    return asked.groupBy("shard").applyInPandas(answer, "shard int, block long, numbers binary, counts binary, starts binary, v long, n long")


class _Block:
    """A block with the answers about its words."""

    def __init__(self, row, words: pd.DataFrame, vocabulary: int):
        self.ids, self.has_id, self.held, self.lengths, codes = _read(row)
        words = words.sort_values("shard")
        shifted = lambda column, before: np.concatenate([unpacked_steps(b) + o for b, o in zip(words[column], words[before], strict=True)])
        counts, starts = np.concatenate([unpacked(b, np.int64) for b in words["counts"]]), shifted("starts", "n_before")
        number = np.where(counts > 0, shifted("numbers", "v_before"), -1)
        self.number, self.count, start = number[codes], counts[codes], starts[codes]
        ends = np.cumsum(self.lengths)
        first = ends - self.lengths
        # The context of a document's first word is the end token.
        before = np.concatenate([[0], np.arange(len(codes) - 1)])
        before[first] = ends - 1
        context = self.number[before]
        self.known = np.flatnonzero(context >= 0)
        before = before[self.known]
        word = np.where(self.number[self.known] >= 0, self.number[self.known].astype(_64), UNKNOWN)
        pairs, self.at = np.unique((context[self.known].astype(_64) << _64(32)) | word, return_inverse=True)
        one = np.zeros(len(pairs), np.int64)
        one[self.at] = before  # any place of each pair
        c, s = self.count[one], start[one]
        parts = (s + c - 1) // SHARD - s // SHARD + 1
        spread = ((pairs & UNKNOWN) * _64(0x9E3779B1)) >> _64(7)
        self.shard = s // SHARD + (spread % parts.astype(_64)).astype(np.int64)
        self.pairs, self.parts, self.context_count = pairs, parts, c
        self.train = np.bincount(self.at[np.repeat(~self.held, self.lengths)[self.known]], minlength=len(pairs))
        # By shard, then pair, as pairs are asked and answered.
        self.order = np.lexsort((pairs, self.shard))

    def slices(self) -> list[tuple[int, np.ndarray]]:
        shards, at = np.unique(self.shard[self.order], return_index=True)
        return list(zip(shards.tolist(), np.split(self.order, at[1:]), strict=True))


def _asked_pairs(blocks: DataFrame, words: DataFrame, vocabulary: int) -> DataFrame:
    def ask(row: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        block = _Block(next(row.itertuples()), words, vocabulary)
        out = []
        for shard, k in block.slices():
            pairs = block.pairs[k]
            first = np.flatnonzero(np.diff(pairs >> _64(32), prepend=UNKNOWN) != 0)
            split = pairs[first][block.parts[k][first] > 1] >> _64(32)
            out.append((shard, row["block"].iloc[0], packed(pairs), packed(block.train[k].astype(np.uint32)), packed(block.context_count[k][first]), packed(split)))
        return pd.DataFrame(out, columns=["shard", "block", "pairs", "counts", "context_counts", "split"])

    return blocks.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(ask, "shard long, block long, pairs binary, counts binary, context_counts binary, split binary")


def _answered_pairs(asked: DataFrame, vocabulary: int, keep_tries: bool) -> DataFrame:
    """(shard, block, a, b) for each question; if they are kept each shard's trie as ``a`` under block -1; under block -2 its split contexts, their types there and their counts."""
    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        pairs, counts = [unpacked(b, _64) for b in frame["pairs"]], [unpacked(b, np.uint32) for b in frame["counts"]]
        every = np.concatenate(pairs)
        context = np.concatenate([np.unique(p >> _64(32)) for p in pairs])
        distinct, at = np.unique(every, return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts).astype(float), minlength=len(distinct))
        seen, total = distinct[total > 0], total[total > 0]
        context, one = np.unique(context, return_index=True)
        context_counts = np.concatenate([unpacked(b, np.int64) for b in frame["context_counts"]])[one]
        trie = build_trie(seen, total, context_counts[np.searchsorted(context, np.unique(seen >> _64(32)))], vocabulary)
        kept = Trie(trie)
        out = [(s, b, *map(packed, kept.ask(p))) for s, b, p in zip(frame["shard"], frame["block"], pairs, strict=True)]
        split = np.unique(np.concatenate([unpacked(b, _64) for b in frame["split"]]))
        if len(split):
            out.append((frame["shard"].iloc[0], -2, packed(split), packed(np.concatenate([kept.types(split), context_counts[np.searchsorted(context, split)]]))))
        return pd.DataFrame([*out, *([(frame["shard"].iloc[0], -1, trie, None)] if keep_tries else [])], columns=["shard", "block", "a", "b"])

    return asked.groupBy("shard").applyInPandas(answer, "shard long, block long, a binary, b binary")


def _split_contexts(pairs: DataFrame) -> DataFrame:
    """(shard, contexts, types, tokens): of each shard the contexts that it shares with others, at most two, with their successor types and tokens over all parts."""
    def unfold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                types, tokens = np.split(unpacked(row.b, np.int64), 2)
                yield pd.DataFrame({"shard": row.shard, "context": unpacked(row.a, _64).astype(np.int64), "types": types, "tokens": tokens})

    parts = durable(pairs.where("block = -2").select("shard", "a", "b").mapInPandas(unfold, "shard long, context long, types long, tokens long"), "splits")
    whole = parts.groupBy(F.col("context").alias("_context")).agg(F.sum("types").alias("_types"), F.max("tokens").alias("_tokens"))
    each = F.sort_array(F.collect_list(F.struct("context", "_types", "_tokens")))
    held = parts.join(whole, F.col("context") == F.col("_context")).groupBy(F.col("shard").alias("_shard")).agg(each.alias("held"))
    return durable(held.select("_shard", F.col("held.context").alias("contexts"), F.col("held._types").alias("types"), F.col("held._tokens").alias("tokens")), "split")


def _b_of(types: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return coded(DISCOUNT * np.asarray(types, float) / np.asarray(tokens, float))


def lm_scores(docs: DataFrame, tries: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of (doc_id, text).

    tries: where to write the trie of each shard as a table (shard, trie); by default a task drops its own when done.
    """
    blocks = durable(blocks_of(docs), "blocks")
    entries = blocks.agg(F.sum("n")).first()[0] or 0
    bits = max(0, int(entries // WORD_SHARD)).bit_length()
    words = durable(_answered_words(_asked_words(blocks, bits)), "words")
    # One row a shard of about WORD_SHARD words.
    shards = words.groupBy("shard").agg(F.max("v").alias("v"), F.max("n").alias("n"))
    v, n = (x or 0 for x in shards.agg(F.sum("v"), F.sum("n")).first())
    if v >= int(UNKNOWN):
        raise ValueError(f"{v} words; at most {int(UNKNOWN) - 1} can be numbered")
    order = Window.orderBy("shard")
    before = shards.select("shard", (F.sum("v").over(order) - F.col("v")).alias("v_before"), (F.sum("n").over(order) - F.col("n")).alias("n_before"))
    words = words.drop("v", "n").join(before, "shard")
    vocabulary = max(int(v), 1)
    blocks = blocks.drop("hashes", "n")
    pairs = durable(_answered_pairs(_asked_pairs(blocks, words, vocabulary), vocabulary, tries is not None), "pairs")
    # What is known of split contexts goes to the answers of their shards, two rows a shard at most.
    pairs = pairs.where("block > -2").join(_split_contexts(pairs), F.col("shard") == F.col("_shard"), "left").drop("_shard")
    if tries is not None:
        corrected = F.udf(lambda trie, contexts, types, tokens: bytes(trie) if contexts is None else with_b(bytes(trie), np.array(contexts, np.int64).astype(_64), _b_of(types, tokens)), "binary")
        pairs.where("block = -1").select("shard", corrected("a", "contexts", "types", "tokens").alias("trie")).write.parquet(tries)

    lines = words.select("block", F.lit(0).alias("kind"), F.col("shard").cast("long").alias("shard"), "numbers", "counts", "starts", "v_before", "n_before", F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"))
    lines = lines.unionByName(pairs.where("block >= 0").select("block", F.lit(1).alias("kind"), "shard", "a", "b", "contexts", "types", "tokens"), allowMissingColumns=True)

    def score(row: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        block = _Block(next(row.itertuples()), lines[lines["kind"] == 0], vocabulary)
        answers = {r.shard: r for r in lines[lines["kind"] == 1].itertuples()}
        a, b = np.zeros(len(block.pairs)), np.ones(len(block.pairs))
        for shard, k in block.slices():
            r = answers[shard]
            whole = block.pairs[k] >> _64(32)
            code = unpacked(r.b, np.uint16)[np.cumsum(np.diff(whole, prepend=UNKNOWN) != 0) - 1]
            if isinstance(r.contexts, np.ndarray):
                for context, own in zip(r.contexts, _b_of(r.types, r.tokens), strict=True):
                    code = np.where(whole == _64(context), own, code)
            a[k] = decoded(unpacked(r.a, np.uint16))
            b[k] = np.where(code > 0, decoded(code), 1.0)
        base = (block.count + ADD) / (n + ADD * (v + 1))
        p = base.copy()
        p[block.known] = a[block.at] + b[block.at] * base[block.known]
        first = np.cumsum(block.lengths) - block.lengths
        add = lambda x: np.add.reduceat(x, first)
        ids = pd.array(block.ids, dtype="Int64")
        ids[~block.has_id] = pd.NA
        return pd.DataFrame({"doc_id": ids, "held_out": block.held, "n_tokens": block.lengths, "n_known": add((block.count > 0).astype(np.int64)), "train_tokens": int(n), "base_score": add(np.log10(base)), "score": add(np.log10(p))})

    return blocks.groupBy("block").cogroup(lines.groupBy("block")).applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
