"""Encoded content: keys are tried within the row, readable results are kept, the lowest key wins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import magic_kind
from ..functions.text import is_readable


def base64_runs(rows: DataFrame, shortest: int = 20) -> DataFrame:
    """(unit_id, run, content) of each base64 run in (unit_id, text) that decodes."""
    runs = rows.select("unit_id", F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-z0-9+/]{{{shortest},}}={{0,2}}"), F.lit(0))).alias("run"))
    return runs.withColumn("content", F.try_to_binary("run", F.lit("base64"))).where("content IS NOT NULL")


def whole_base64(text: Column) -> Column:
    """A text of at least eight characters decoded as base64, padded; null if it isn't, or isn't readable."""
    padded = F.rpad(text, F.ceil(F.length(text) / 4).cast("int") * 4, F.lit("="))
    decoded = F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")
    return F.when((F.length(text) >= 8) & text.rlike("^[A-Za-z0-9+/]+={0,2}$") & is_readable(decoded), decoded)


def _char(code: Column) -> Column:
    """The character of a code below 65536."""
    return F.when(code < 256, F.char(code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE"))


def codes_of(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)


def _chars(text: Column, change) -> Column:
    return F.array_join(F.transform(codes_of(text), lambda c, i: _char(change(c, i))), "")


def may_be_hidden(text: Column, longest: int = 500) -> Column:
    """Whether a text is worth trying keys on: some character beyond 127, and not too long."""
    return F.coalesce((F.length(text) <= longest) & text.rlike(r"[^\x00-\x7F]"), F.lit(False))


def _fits(codes: str, change):
    """key -> whether over 85 % of the codes that it gives are printable."""
    plain = lambda c: c.between(32, 126) | c.isin(9, 10, 13)
    return lambda k: F.size(F.filter(F.transform(codes, lambda c, i: change(c, i, k)), plain)) > 0.85 * F.size(codes)


def _shown(codes: str, change, key: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c, i: _char(change(c, i, key))), "")


_PLAIN = np.array([32 <= c <= 126 or c in (9, 10, 13) for c in range(256)] + [False])


def _places(sizes: np.ndarray) -> np.ndarray:
    """The place of each code within its text, of texts put one behind another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _lowest_keys(codes: np.ndarray, sizes: np.ndarray, keys: range, change) -> np.ndarray:
    """The lowest key of each text, -1 if none, that makes over 85 % of its codes printable; no text is empty."""
    best, left, places = np.full(len(sizes), -1), np.arange(len(sizes)), _places(sizes)
    for key in keys:
        if not len(left):
            break
        plain = _PLAIN[np.minimum(change(codes, places, key), 256)]
        fits = 100 * np.add.reduceat(plain, np.cumsum(sizes) - sizes, dtype=np.int64) > 85 * sizes
        if fits.any():
            best[left[fits]] = key
            kept = np.repeat(~fits, sizes)
            codes, places, left, sizes = codes[kept], places[kept], left[~fits], sizes[~fits]
    return best


def _shown_under(codes: np.ndarray, sizes: np.ndarray, keys: np.ndarray, change) -> list[str]:
    """Each text under its own key."""
    shown = change(codes, _places(sizes), np.repeat(keys, sizes)).astype("<u4").tobytes().decode("utf-32-le")
    ends = np.cumsum(sizes)
    return [shown[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def _codes_under(codes: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return codes[np.repeat(which, sizes)], sizes[which]


def with_keys(rows: DataFrame, keys: range, change, longest: int = 500) -> DataFrame:
    """Each (unit_id, text) under the lowest key that makes it readable: (unit_id, key, decoded). change: (code, place, key) -> code, over numpy arrays.

    Texts that can't be hidden go before any key is tried; a key is tried on all texts of a batch at once, so nothing is multiplied.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            codes, sizes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64), np.array([len(t) for t in texts], np.int64)
            best = _lowest_keys(codes, sizes, keys, change)
            found = best >= 0
            shown = _shown_under(*_codes_under(codes, sizes, found), best[found], change)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(found)), pa.array(best[found], pa.int32()), pa.array(shown, pa.string())], names=["unit_id", "key", "decoded"])

    some = rows.where(may_be_hidden(F.col("text"), longest)).select("unit_id", "text")
    return some.mapInArrow(search, T.StructType([some.schema["unit_id"], T.StructField("key", T.IntegerType()), T.StructField("decoded", T.StringType())]))


CHANGES = {
    "xor": lambda c, i, k: c ^ k,
    "shift": lambda c, i, k: (c - k) & 255,
    "xor by place": lambda c, i, k: c ^ ((k + i) & 255),
    "xor by product": lambda c, i, k: c ^ ((k * (i + 1)) & 255),
    "shift by place": lambda c, i, k: (c - k - i) & 255,
    "xor less place": lambda c, i, k: ((c ^ k) - i) & 255,
    "xor then shift": lambda c, i, k: ((c ^ k) + k) & 255,
    # Key 2 n shifts by n bits to the left, 2 n + 1 to the right.
    "bit shift": lambda c, i, k: np.where(k & 1, c >> (k >> 1), c << (k >> 1)) & 255,
}
#: Left by one bit, right by one, left by two and so on.
BIT_SHIFTS = range(2, 16)


# First bytes that outweigh any share of printable ones.
_TELLING = ((202, 254, 186, 190), (80, 75, 3, 4), (31, 139), (93, 0, 0, 0))


def byte_key(codes: Column) -> Column:
    """(score, key) of the single-byte key that makes the first 256 byte values most printable, the lowest of equals; null under a score of 80.

    The score is the percentage of printable bytes, and 1000 more where a known format begins.
    """
    head = F.slice(codes, 1, 256)

    def scored(k: Column) -> Column:
        plain = F.size(F.filter(head, lambda c: c.bitwiseXOR(k).between(32, 126) | c.bitwiseXOR(k).isin(9, 10, 13)))
        score = F.floor(plain * 100 / F.size(head)).cast("int")
        for magic in _TELLING:
            same = F.lit(True)
            for i, b in enumerate(magic):
                same = same & (F.get(head, F.lit(i)).bitwiseXOR(k) == b)
            score = score + F.when(F.coalesce(same & (F.size(head) >= 4), F.lit(False)), 1000).otherwise(0)
        return F.struct(score.alias("score"), (-k).alias("less"))

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(255)), scored))
    return F.when((F.size(head) > 0) & (best["score"] >= 80), F.struct(best["score"].alias("score"), (-best["less"]).alias("key")))


def _best_key(codes: Column) -> Column:
    """The key below 256 under which most codes are 32 to 126, the lowest of equals; 0 if no code is below 256.

    A code gets one of 32 to 127 from the keys that share its bit 128 and differ in the two bits below it, so eight counts tell the best
    32 keys; of these only those that make some code 127 lose, and the lowest of the others is the best of all.
    """
    block = lambda c: F.shiftright(c, 5)
    counts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda q: F.size(F.filter(codes, lambda c: block(c) == q)))
    votes = F.transform(F.array(counts), lambda n: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda h: F.aggregate(F.slice(n, F.when(h < 4, 1).otherwise(5), 4), F.lit(0), lambda a, x: a + x) - F.get(n, h)))
    first = F.transform(votes, lambda v: 32 * (F.array_position(v, F.array_max(v)).cast("int") - 1))
    free = F.get(F.transform(first, lambda k: F.array_min(F.array_except(F.sequence(k, k + 31), F.transform(codes, lambda c: c.bitwiseXOR(F.lit(127)))))), F.lit(0))
    # Where each of the 32 makes some code 127, all keys are counted.
    counted = lambda k: F.struct(F.size(F.filter(codes, lambda c: c.bitwiseXOR(k).between(32, 126))).alias("n"), (-k).alias("less"))
    return F.coalesce(free, -F.array_max(F.transform(F.sequence(F.lit(0), F.lit(255)), counted))["less"])


def repeating_key(rows: DataFrame, longest: int = 200) -> DataFrame:
    """(unit_id, size, decoded): texts hidden under a repeating key of two to eight characters, the shortest that makes them readable.

    At each place of the key the value below 256 that gives most printable characters counts, the lowest of equals; a key
    that holds 0 is none. All is worked out within the row.
    """
    texts = rows.select("unit_id", "text").where(may_be_hidden(F.col("text"), longest))
    # Of a given number, so that few bytes of text are not put into one task: the work is in the keys.
    dealt = texts.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()), "unit_id", "text").distinct()
    # Exploding an array of one keeps the codes from being found again for each use.
    some = dealt.select("unit_id", F.explode(F.array(codes_of(F.col("text")))).alias("_codes"))
    change = lambda c, i, k: c.bitwiseXOR(F.get(k, i % F.size(k)))

    def keys(size: int) -> Column:
        """The key of this size, null if there is none that makes the text readable."""
        groups = F.array(*[F.transform(F.sequence(F.lit(p), F.size("_codes") - 1, F.lit(size)), lambda j: F.get("_codes", j)) for p in range(size)])
        sound = F.filter(F.array(F.transform(groups, _best_key)), lambda k: ~F.array_contains(k, F.lit(0)) & _fits("_codes", change)(k))
        return F.when(F.size("_codes") >= 2 * size, F.get(sound, F.lit(0)))

    # Longer keys are looked for only where no shorter one is found.
    found = some.select("unit_id", "_codes", F.explode(F.array_compact(F.array(F.coalesce(*[keys(size) for size in range(2, 9)])))).alias("keys"))
    return found.select("unit_id", F.size("keys").alias("size"), _shown("_codes", change, F.col("keys")).alias("decoded"))


def base64_then_xor(rows: DataFrame) -> DataFrame:
    """(unit_id, key, by_place, decoded): base64 texts whose bytes are readable under the lowest key of 1 to 255, else under one that grows with the place."""
    whole = rows.where(F.col("text").rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length("text") >= 8))
    padded = F.rpad("text", F.ceil(F.length("text") / 4).cast("int") * 4, F.lit("="))
    some = whole.select("unit_id", F.try_to_binary(padded, F.lit("base64")).alias("content"))
    same, moving, keys = CHANGES["xor"], CHANGES["xor by place"], range(1, 256)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column(1).to_pylist()
            long = np.array([c is not None and len(c) >= 2 for c in contents], bool)
            units, contents = batch.column(0).filter(pa.array(long)), [c for c in contents if c is not None and len(c) >= 2]
            codes, sizes = np.frombuffer(b"".join(contents), np.uint8).astype(np.int64), np.array([len(c) for c in contents], np.int64)
            best = _lowest_keys(codes, sizes, keys, same)
            for by_place, change in ((False, same), (True, moving)):
                found = best >= 0
                shown = _shown_under(*_codes_under(codes, sizes, found), best[found], change)
                yield pa.RecordBatch.from_arrays([units.filter(pa.array(found)), pa.array(best[found], pa.int32()), pa.array([by_place] * len(shown), pa.bool_()), pa.array(shown, pa.string())], names=["unit_id", "key", "by_place", "decoded"])
                if not by_place:
                    units, (codes, sizes) = units.filter(pa.array(~found)), _codes_under(codes, sizes, ~found)
                    best = _lowest_keys(codes, sizes, keys, moving)

    return some.mapInArrow(search, T.StructType([some.schema["unit_id"], T.StructField("key", T.IntegerType()), T.StructField("by_place", T.BooleanType()), T.StructField("decoded", T.StringType())]))


def payload_class(content: Column) -> Column:
    """What decoded bytes are: a known format, readable text or other binary."""
    known = magic_kind(F.hex(F.substring(content, 1, 4)))
    text = is_readable(F.decode(content, "ISO-8859-1"))
    return F.when(known.isin("png", "jpeg", "gif", "riff"), "image").when(known.isin("zip", "gzip", "class"), known).when(text, "text").otherwise("binary")


# Words that tell plain text from base64, words that tell decoded source, the first bytes of a class.
_PROSE = ("the ", "and ", "import ", "public ", "class ")
_SOURCE = ("class ", "import ", "package ")
_CLASS = (202, 254, 186, 190)


def hidden_class(content: Column) -> Column:
    """Whether bytes begin as a class does under one key of 1 to 255."""
    return F.hex(F.substring(content, 1, 4)).isin([bytes(b ^ key for b in _CLASS).hex().upper() for key in range(1, 256)])


def encoding_class(content: Column) -> Column:
    """How a document's bytes are written: base64, base64+xor, xor, binary (over a third of the first 1024 bytes unprintable) or plain.

    Null without bytes; plain where there are none. Bytes that look like base64 but do not decode are base64 still.
    """
    text = F.regexp_replace(F.decode(content, "ISO-8859-1"), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    looks = (F.length(text) % 4 == 0) & text.rlike(r"^[A-Za-z0-9+/ \t-\r]+=*$") & ~text.rlike("|".join(_PROSE))
    inner = F.try_to_binary(F.regexp_replace(text, r"[ \t-\r]", ""), F.lit("base64"))
    keyed = looks & hidden_class(inner) & ~F.decode(inner, "ISO-8859-1").rlike("|".join(_SOURCE))
    odd = F.length(F.regexp_replace(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), r"[\t-\r\x20-\x7E]", ""))
    binary = odd > F.floor(F.least(F.octet_length(content), F.lit(1024)) / 3)
    named = F.when(keyed, "base64+xor").when(looks, "base64").when(hidden_class(content), "xor").when(binary, "binary")
    return F.when(content.isNotNull(), named.otherwise("plain"))


def rotated(text: Column, by: int) -> Column:
    """Letters moved on in the alphabet."""
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, low + up, low[by:] + low[:by] + up[by:] + up[:by])


_LOW, _UP = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What becomes of each byte when letters move on by 0 to 25.
_MOVED = [bytes.maketrans(_LOW + _UP, _LOW[by:] + _LOW[:by] + _UP[by:] + _UP[:by]) for by in range(26)]


def _letters(text: bytes) -> np.ndarray:
    """How often each letter of the alphabet stands in a text, whatever its case; İ and the Kelvin sign are an i and a k in lower case."""
    n = np.zeros(256, np.int64)
    for at in range(0, len(text), 65536):
        n += np.bincount(np.frombuffer(text, np.uint8, min(65536, len(text) - at), at), minlength=256)
    letters = n[65:91] + n[97:123]
    letters[8] += text.count("\u0130".encode())
    letters[10] += text.count("\u212a".encode())
    return letters


def _bytes_of(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.large_binary()).to_pylist()


def letter_shares(texts: DataFrame) -> DataFrame:
    """One row: the letters' shares in all texts, in parts of a million."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(26, np.int64)
        for batch in batches:
            for text in _bytes_of(batch.column(0)):
                n += _letters(text)
        yield pa.RecordBatch.from_arrays([pa.array(range(26), pa.int32()), pa.array(n)], names=["letter", "n"])

    # A row for each letter and task.
    counted = texts.select("text").where("text IS NOT NULL").mapInArrow(count, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    row = counted.agg(F.sort_array(F.collect_list(F.struct("letter", "n"))).alias("c"), F.greatest(F.sum("n"), F.lit(1)).alias("total"))
    return row.select(F.transform("c", lambda x: F.floor(x["n"] * 1_000_000 / F.col("total")).cast("long")).alias("shares"))


def rotation_keys(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(unit_id, key, decoded): the rotation of 0 to 25 letters that hides each (unit_id, text), told by the letters of plain texts.

    Every rotation of a text can be read, so the one counts whose letters lie closest to those of all plain texts, the lowest of equals; 0: not rotated. Null texts have none.
    A text's letters are counted once, over its bytes: no byte of another character is a letter's.
    """
    # 26 numbers; line k is how they stand under key k.
    shares = np.array(letter_shares(texts).first()[0] or [0] * 26, np.int64)
    turned = np.array([np.roll(shares, k) for k in range(26)])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Nulls go here, as Spark would work a text out twice to filter it.
            batch = batch.filter(batch.column(1).is_valid())
            hidden = _bytes_of(batch.column(1))
            keys = [int(np.argmax(turned @ _letters(text))) for text in hidden]
            plain = pa.array([text.translate(_MOVED[-key % 26]) for text, key in zip(hidden, keys, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int32()), plain.cast(pa.string(), safe=False)], names=["unit_id", "key", "decoded"])

    some = rows.select("unit_id", "text")
    return some.mapInArrow(search, T.StructType([some.schema["unit_id"], T.StructField("key", T.IntegerType()), T.StructField("decoded", T.StringType())]))


def mirrored(text: Column) -> Column:
    """Letters replaced by those as far from the alphabet's other end."""
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, low + up, low[::-1] + up[::-1])


def pairs_swapped(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)(.)(.)", "$2$1")
