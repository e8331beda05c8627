"""SentencePiece encoding and decoding with a streaming lattice.

The vocabulary is a merge (BPE) model with byte fallback. Of all segmentations of a text the merge order
allows exactly one, and that one can be found as a best path: a piece may follow another only if merging
the two from their characters gives back the two. So each position has one allowed last piece, its
backpointer. The lattice keeps a window bounded by the longest piece and commits ids as soon as the
backpointers of all positions from which the text can go on lead through one boundary; memory does not grow
with the text. No piece joins a word to the blank before the next word, so such boundaries come often and
the ids of a word are kept for its next use.

Defined results: a null text encodes to null and decodes to null; an empty text encodes to no ids; a text
is taken as it is, whole, with a blank put before it as the model asks and taken off when decoding; code
points without a piece become byte pieces; repeated rows are encoded each by itself; an empty table gives
an empty table; other columns are carried. Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import itertools
import os
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

BLANK = "▁"
NEVER = float("-inf")
MODEL = os.environ.get("GLEANERY_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: Words kept with their ids in each task; when full the store is emptied.
KEPT_WORDS = 400_000
#: A vocabulary is sent to every task, so its size is checked.
MAX_PIECES = 1_000_000
_RUN = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def load_pieces(path: str = MODEL) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id, kind being normal, byte or control; read on the driver alone."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if (n := model.get_piece_size()) > MAX_PIECES:
        raise ValueError(f"{n} pieces; at most {MAX_PIECES} can be sent to the tasks")
    kind = lambda i: "byte" if model.is_byte(i) else "control" if model.is_control(i) or model.is_unknown(i) else "normal"
    return [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(n)]


class Lattice:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.score = {p: s for p, s, kind in pieces if kind == "normal"}
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == "normal"}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.text = [p.encode() if kind == "normal" else bytes([int(p[3:5], 16)]) if kind == "byte" else b"" for p, _, kind in pieces]
        self.longest = max(map(len, self.score), default=1)
        # A boundary before every run of blanks is safe if no piece has a blank after another character.
        self.by_word = not any(BLANK in p.lstrip(BLANK) for p in self.score)
        self.spines: dict[str, tuple | None] = {}
        self.follows: dict[str, dict[str, bool]] = defaultdict(dict)
        self.words: dict[str, bytes] = {}
        self.finder = ahocorasick.Automaton()
        for p in self.score:
            if len(p) == 1 or self.merged(p) == [p]:
                self.finder.add_word(p, (p, len(p)))
        if self.score:
            self.finder.make_automaton()
        # Two characters that stand side by side in no piece have a boundary between them in every text.
        self.inside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.known = {c for c in "".join(self.score) if c in self.score}

    def merged(self, text: str, events: list | None = None) -> list[str]:
        """The pieces of a short text by merging the best pair again and again, the leftmost of equals first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            if events is not None:
                events.append((best, at == 0, at == len(parts) - 2, parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, piece: str) -> tuple | None:
        """What stands at a piece's ends while it is merged: [(part, score of the merge that takes it up)] of its left and right end.

        None if merging doesn't give the piece. The last item says whether every merge scores below its parts' own.
        """
        if piece not in self.spines:
            events: list = []
            if len(piece) > 1 and (piece not in self.score or self.merged(piece, events) != [piece]):
                self.spines[piece] = None
            else:
                known = {c: float("inf") for c in piece}
                falling = True
                for score, _, _, x, y in events:
                    falling = falling and score < known[x] and score < known[y]
                    known[x + y] = score
                left = [(x, score) for score, first, _, x, _ in events if first] + [(piece, NEVER)]
                right = [(y, score) for score, _, final, _, y in events if final] + [(piece, NEVER)]
                self.spines[piece] = (left, right, falling)
        return self.spines[piece]

    def may_follow(self, last: str, piece: str) -> bool:
        """Whether merging the characters of both leaves the two: no merge across their boundary comes first."""
        a, b = self.spine(last), self.spine(piece)
        if not (a[2] and b[2]):
            return self.merged(last + piece) == [last, piece]
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[1][i], b[0][j]
            across = self.score.get(x + y)
            if across is not None and across > x_until and across >= y_until:
                return False
            if x_until == NEVER and y_until == NEVER:
                return True
            if x_until >= y_until:
                i += 1
            else:
                j += 1

    def segments(self, text: str) -> Iterator[str]:
        """The pieces of a text, streamed. Characters without a piece stand alone and nothing merges with them."""
        if self.known.issuperset(text):
            yield from self._best(text)
            return
        for known, run in itertools.groupby(text, self.known.__contains__):
            yield from self._best("".join(run)) if known else run

    def _best(self, text: str) -> list[str] | Iterator[str]:
        if len(text) > 4 * self.longest:
            return self._streamed(text)
        last = {0: ""}
        self._extend(last, self.finder.iter(text), {0: self.follows[""]})
        return [last[p] for p in reversed(self._path(last, len(text), 0))]

    def _streamed(self, text: str) -> Iterator[str]:
        """The same for a text of any length: only a window of positions is held."""
        last, after, done = {0: ""}, {0: self.follows[""]}, 0  # position -> the last piece up to it; what may follow that
        found = self.finder.iter(text)
        for upto in range(2 * self.longest, len(text) + 2 * self.longest, self.longest):
            self._extend(last, found, after, upto)
            # Every path goes on from one of the last `longest` positions; a boundary that all of them share is final.
            end = max(last)
            paths = [self._path(last, p, done) for p in range(end + 1 - self.longest, end + 1) if p in last] if end < len(text) else [self._path(last, end, done)]
            shared = max(set.intersection(*map(set, paths)), default=done)
            if shared > done:
                yield from [last[p] for p in reversed(self._path(last, shared, done))]
                done = shared
                last, after = ({p: x for p, x in d.items() if p >= done} for d in (last, after))

    def _extend(self, last: dict[int, str], found: Iterator, after: dict[int, dict[str, bool]], upto: float = float("inf")) -> None:
        """Set the last piece of each position that the found pieces reach, in the order of their ends, to the first end from ``upto`` on."""
        follows, solved = self.follows, -1
        for at, (piece, size) in found:
            if at == solved or (known := after.get(at + 1 - size)) is None:
                continue
            may = known.get(piece)
            if may is None:
                before = last[at + 1 - size]
                may = known[piece] = not before or self.may_follow(before, piece)
            if may:
                solved = at
                last[at + 1] = piece
                after[at + 1] = follows[piece]
                if at + 1 >= upto:
                    return

    @staticmethod
    def _path(last: dict[int, str], position: int, done: int) -> list[int]:
        out = []
        while position > done:
            out.append(position)
            position -= len(last[position])
        return out

    def ids_of(self, pieces: Iterator[str]) -> bytes:
        """The ids of pieces as packed 32-bit numbers."""
        out = array("i")
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            else:
                out.extend(self.bytes[b] for b in p.encode())
        return out.tobytes()

    def _parts(self, word: str) -> list[str]:
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.inside]
        return [word[i:j] for i, j in itertools.pairwise([0, *cuts, len(word)])]

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(word) <= 4 * self.longest:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def _ids(self, word: str) -> bytes:
        get = self.words.get
        return self._keep(word, b"".join(get(part) or self._keep(part, self.ids_of(self.segments(part))) for part in self._parts(word)))

    def packed(self, text: str) -> bytes:
        """The ids of a text as packed 32-bit numbers."""
        if not text:
            return b""
        text = BLANK + text.replace(" ", BLANK)
        if not self.by_word:
            return self.ids_of(self.segments(text))
        get, ids = self.words.get, self._ids
        return b"".join([get(word) or ids(word) for word in _RUN.findall(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


def _rows(batches: Iterator[pa.RecordBatch], chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds a few million characters or one row."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(0).cast(pa.binary())), 0)) if not pa.types.is_list(batch.column(0).type) else np.asarray(pc.fill_null(pc.list_value_length(batch.column(0)), 0)) * 4)
        start = 0
        while start < batch.num_rows:
            seen = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, seen + chars, side="right")))
            yield batch.slice(start, end - start)
            start = end


def _mapped(df: DataFrame, column: str, added: list[tuple[str, str, pa.DataType]], compute) -> DataFrame:
    """``df`` with columns computed from one of its own; compute(batch's column) gives their arrays."""
    kept = [c for c in df.columns if c not in [name for name, _, _ in added]]
    source = df.select(F.col(column).alias("_of"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rows(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *compute(batch.column(0))], names=[*kept, *(name for name, _, _ in added)])

    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, T._parse_datatype_string(kind)) for name, kind, _ in added])
    return source.mapInArrow(run, schema)


def encode(docs: DataFrame, column: str = "text", to: str = "ids", path: str = MODEL, check: str | None = None) -> DataFrame:
    """Add the piece ids of a text column, and as column ``check`` whether decoding them gives the text back."""
    sent = docs.sparkSession.sparkContext.broadcast(Lattice(load_pieces(path)))

    def compute(texts: pa.Array) -> list[pa.Array]:
        lattice = sent.value  # one for each Python worker, with the words it has met
        parts, ends, same = [], [0], []
        for t in texts:
            t = t.as_py()
            ids = b"" if t is None else lattice.packed(t)
            parts.append(ids)
            ends.append(ends[-1] + len(ids) // 4)
            if check:
                same.append(None if t is None else lattice.decode(np.frombuffer(ids, np.int32).tolist()) == t)
        flat = pa.array(np.frombuffer(b"".join(parts), np.int32))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pc.is_null(texts) if texts.null_count else None)
        return [lists, *([pa.array(same, pa.bool_())] if check else [])]

    added = [(to, "array<int>", pa.list_(pa.int32())), *([(check, "boolean", pa.bool_())] if check else [])]
    return _mapped(docs, column, added, compute)


def decode(encoded: DataFrame, column: str = "ids", to: str = "text", path: str = MODEL) -> DataFrame:
    """Add the text of a column of piece ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(Lattice(load_pieces(path)))

    def compute(ids: pa.Array) -> list[pa.Array]:
        return [pa.array([None if i is None else sent.value.decode(i) for i in ids.to_pylist()], pa.string())]

    return _mapped(encoded, column, [(to, "string", pa.string())], compute)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the ids, their number and whether decoding them gives the text back."""
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check="round_trip")
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "round_trip")
