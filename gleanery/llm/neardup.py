"""MinHash near-duplicates with HyperMinHash registers.

A document's set holds its distinct five-word shingles (64-bit hashes). Each of ``BUCKETS`` buckets hashes
the set anew, so that small sets fill every bucket too, and stores of its minimum only the count of leading
zeros and ``MANTISSA`` further bits. Four registers packed in a long make a band; equal bands propose pairs.
Within a band's group every member is paired with a center, so a group of any size costs as many pairs as it has
members. Pairs whose collision-corrected estimate is far below the threshold go. The rest are confirmed on the full
sets, each member's best pair first, and joined into components; pairs within a component need no confirming.

Members that still share a band across components are paired so that no link is lost: all of them in groups of at most
``FEW``; those of larger groups by the first shingles of their full sets (``prefix_pairs``), where two sets can only
be linked if they meet early enough in one order of all shingles. What a large group has in common comes last in that
order, so its size alone makes no pairs.

Defined results: a null or wordless text has an empty set, is linked with nothing and is its own component;
equal word sequences form one class and are compared once; repeated rows get equal answers, unlike texts under one
doc_id are each compared as their own; a null doc_id has no component and is kept; an empty table gives an empty
table; other columns are carried by ``dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drawn, durable, held_whole, let_go, table

SHINGLE = 5
PERCENT = 75
BUCKETS, BAND = 128, 4
ZERO_BITS, MANTISSA = 6, 10
#: Standard deviations of the estimate below the threshold at which a pair is dropped.
MARGIN = 5
KEPT_WORDS = 500_000
FLOOR = PERCENT / 100 - MARGIN * (PERCENT / 100 * (1 - PERCENT / 100) / BUCKETS) ** 0.5
#: Groups of at most so many are paired by a join, larger ones by their first shingles in one order.
FEW = 16
#: Sizes that meet are dealt into buckets by this ratio, so that a frequent shingle's group is many small joins.
SIZE_RATIO = 1.1
_CHUNK = 4096
#: Sets that are looked at for frequent shingles, about, the largest of them, and how many frequent shingles come last in the order.
SAMPLED_SETS, SAMPLED_SIZE, LATE = 2048, 4096, 100_000


class _Hashes(dict):
    """Word -> 64-bit hash; the words met are kept, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def words_in(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes.split and bytes.lower know ASCII alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes], hashes: _Hashes) -> np.ndarray:
    """The sorted distinct hashes of a document's shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mixed(out ^ h[i : len(h) - n + 1 + i]) + np.uint64(i + 1)
    return np.unique(out)


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, BUCKETS, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def registers(shingle_set: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """One uint16 a bucket: leading zeros of the minimum, then the bits after its first one."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingle_set), _CHUNK):
        least = np.minimum(least, np.multiply.outer(multipliers, shingle_set[i : i + _CHUNK]).min(axis=1))
    zeros = np.minimum(63 - np.floor(np.log2(np.maximum(least, np.uint64(1)).astype(np.float64))).astype(np.int64), 63).clip(0)
    after = (least << (zeros.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | after).astype(np.uint16)


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that two unlike minima of sets of n and m shingles share a register."""
    z = np.arange(1 << ZERO_BITS)[:, None]
    s, width = (n + m)[None, :].astype(float), 2.0 ** -(z + 1 + MANTISSA)
    return (width * (np.exp(-s * 2.0 ** -(z + 1.0)) - np.exp(-s * 2.0**-z))).sum(axis=0) * (n.astype(float) * m / (n + m))


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of registers, less the collisions to expect."""
    c = collision_rate(n, m)
    return (((a == b).mean(axis=1)) - c) / (1 - c)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, whole: key of the text, digest of the word sequence, n_shingles, bands): one row per row; digest and bands are null without words."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, multipliers = _Hashes(), _multipliers()
        for batch in batches:
            digests, sizes, rows, has = [], [], [], []
            for text in batch.column(2):
                words = words_in(text.as_py())
                s = shingles(words, hashes)
                has.append(bool(words))
                sizes.append(len(s))
                digests.append(hashlib.md5(b" ".join(words)).digest() if words else None)
                if words:
                    rows.append(registers(s, multipliers))
            flat = np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)
            ends = np.cumsum([0, *[BUCKETS // BAND * h for h in has]]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), bands], ["doc_id", "whole", "digest", "n_shingles", "bands"])

    return docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("whole"), "text").mapInArrow(sketch, "doc_id long, whole binary, digest binary, n_shingles long, bands array<long>")


def text_key(text: Column) -> Column:
    """What tells a row's text from other texts of its doc_id; null for a null text."""
    return F.unhex(F.md5(text))


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(cls, n, shingles binary) of each row of (cls, digest, text) whose text has that digest."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            found = []
            for cls, digest, text in zip(*batch.columns, strict=True):
                words = words_in(text.as_py())
                if hashlib.md5(b" ".join(words)).digest() == digest.as_py():
                    found.append((cls.as_py(), shingles(words, hashes)))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([len(x) for _, x in found], pa.int64()), pa.array([x.tobytes() for _, x in found], pa.binary())], ["cls", "n", "shingles"])

    return rows.select("cls", "digest", "text").mapInArrow(sets, "cls long, n long, shingles binary")


def frequent_shingles(sets: DataFrame) -> np.ndarray:
    """The shingles that most sets of a drawn sample hold, the most frequent last; at most ``LATE`` of them, so their size is bounded.

    They only shape an order that is right whatever they are, so the sample and the bound decide about speed alone.
    """
    few = drawn(sets.select("cls", "n", "shingles").where(F.col("n") <= SAMPLED_SIZE), F.col("cls"), SAMPLED_SETS)
    often = few.mapInArrow(_unpacked, "cls long, n long, shingle long").groupBy("shingle").agg(F.count("*").alias("often")).where("often > 2")
    rows = often.orderBy(F.desc("often"), "shingle").limit(LATE).collect()
    return np.array([r.shingle for r in reversed(rows)], np.int64)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cls, n, shingle_set in zip(*batch.columns, strict=True):
            yield pa.RecordBatch.from_arrays([pa.repeat(cls, n.as_py()), pa.repeat(n, n.as_py()), pa.array(np.frombuffer(shingle_set.as_buffer(), np.int64))], ["cls", "n", "shingle"])


def prefixes(sets: DataFrame, late: np.ndarray) -> DataFrame:
    """(cls, n, shingle, left): the first shingles of each set, as many as may be its first shared one; left: how many it has from there on.

    The order is by value, with the frequent shingles ``late`` after all others; it is cut within the row.
    """
    sent = sets.sparkSession.sparkContext.broadcast((np.sort(late), np.argsort(late, kind="stable") + 1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, places = sent.value
        for batch in batches:
            held: list[list] = [[], [], [], []]
            for cls, n, shingle_set in zip(*batch.columns, strict=True):
                own = np.frombuffer(shingle_set.as_buffer(), np.int64)
                rank = np.zeros(len(own), np.int64)
                if len(values):
                    at = np.searchsorted(values, own).clip(0, len(values) - 1)
                    rank = np.where(values[at] == own, places[at], 0)
                most = len(own) - -(-PERCENT * len(own) // 100) + 1
                own = own[np.lexsort((own, rank))[:most]]
                for into, column in zip(held, (np.full(most, cls.as_py()), np.full(most, n.as_py()), own, n.as_py() - np.arange(most)), strict=True):
                    into.append(column)
                if sum(map(len, held[0])) >= 1 << 16:
                    yield _columns(held)
                    held = [[], [], [], []]
            yield _columns(held)

    def _columns(held: list[list]) -> pa.RecordBatch:
        whole = [np.concatenate(c) if c else np.empty(0, np.int64) for c in held]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in whole], ["cls", "n", "shingle", "left"])

    return sets.where("n > 0").select("cls", "n", "shingles").mapInArrow(cut, "cls long, n long, shingle long, left long")


def prefix_pairs(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets in different components that may be linked, by their first shingles; no link is missing.

    All shingles have one order, frequent ones last. If r shingles of a set, this one included,
    don't come before the first shingle that two sets share, their intersection is at most the lesser r; a link needs
    PERCENT / (100 + PERCENT) of both sizes. So the smaller set must be met within its first seventh, the other
    within its first quarter, both at a depth that their sizes allow.
    """
    least = 100 + PERCENT
    side = labels.select(F.col("node").alias("_node"), "component")
    first = prefixes(sets, frequent_shingles(sets)).join(side, F.col("cls") == F.col("_node"), "left")
    rows = durable(first.select("cls", "n", "shingle", "left", F.coalesce("component", "cls").alias("component")), "prefixes")
    # What a shingle's group is mostly made of is one component, and its members needn't meet each other.
    sizes = rows.groupBy("shingle", "component").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy(F.col("shingle").alias("_shingle")).agg(F.count("*").alias("components"), F.max_by("component", F.struct("size", "component")).alias("main")).where("components > 1")
    rows = rows.join(mixed, F.col("shingle") == F.col("_shingle")).select("cls", "n", "shingle", "left", "component", (F.col("component") == F.col("main")).alias("main"))
    bucket = lambda n: F.floor(F.log(n) / float(np.log(SIZE_RATIO))).cast("int")
    small = rows.where(least * F.col("left") >= 2 * PERCENT * F.col("n")).select("cls", "n", "shingle", "left", "component", "main", bucket(F.col("n")).alias("bucket"))
    # The sizes of smaller sets that may still be linked at this depth.
    lowest, highest = F.ceil(F.col("n") * PERCENT / 100), F.least(F.floor(F.col("left") * least / PERCENT) - F.col("n"), F.col("n"))
    large = rows.where(highest >= lowest).select(*[F.col(c).alias(f"_{c}") for c in ("cls", "n", "shingle", "left", "component", "main")], F.explode(F.sequence(bucket(lowest), bucket(highest))).alias("_bucket"))
    ordered = (F.col("n") < F.col("_n")) | ((F.col("n") == F.col("_n")) & (F.col("cls") < F.col("_cls")))
    met = (F.col("shingle") == F.col("_shingle")) & (F.col("bucket") == F.col("_bucket")) & ordered & (F.col("component") != F.col("_component")) & (least * F.least("left", "_left") >= PERCENT * (F.col("n") + F.col("_n")))
    either = [small.where("NOT main").join(large, met), small.where("main").join(large.where("NOT _main"), met)]
    return either[0].unionByName(either[1]).select(F.greatest("cls", "_cls").alias("a"), F.least("cls", "_cls").alias("b")).distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node of (a, b) links: the smallest node that it can reach.

    Alternates large stars (greater neighbours to the least) and small stars (lesser ones to the least) until every
    node hangs on one that hangs on none; each round is written, so no lineage grows.
    """
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while not _is_forest_of_stars(edges):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")).withColumnRenamed("a", "_a")
        large = both.join(least, F.col("a") == F.col("_a")).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "_a")
        small = large.join(least, F.col("a") == F.col("_a"))
        edges = durable(small.select(F.greatest("b", "least").alias("a"), "least").where("a <> least").withColumnRenamed("least", "b").unionByName(least.select(F.col("_a").alias("a"), F.col("least").alias("b"))).distinct(), label)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each a of (a, b) edges has one b, which is no other edge's a."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down")))).alias("end")).select("end.*")
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least")).where("down > 1 OR (down > 0 AND least = 0)").isEmpty()


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose estimated similarity may reach the threshold, with the estimate."""
    side = lambda s: classes.select(F.col("cls").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("bands").alias(f"bands_{s}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    # Sets whose sizes alone rule the similarity out go first.
    joined = joined.where((100 * F.least("n_a", "n_b").cast("long") >= PERCENT * F.greatest("n_a", "n_b").cast("long")) & (F.col("n_a") > 0))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            regs = [get(c).flatten().to_numpy().view(np.uint16).reshape(-1, BUCKETS) for c in ("bands_a", "bands_b")]
            j = estimate(*regs, get("n_a").to_numpy(), get("n_b").to_numpy())
            keep = pa.array(j >= FLOOR)
            yield pa.RecordBatch.from_arrays([get("a").filter(keep), get("b").filter(keep), pa.array(j[j >= FLOOR])], ["a", "b", "estimate"])

    return joined.select("a", "b", "n_a", "n_b", "bands_a", "bands_b").mapInArrow(compare, "a long, b long, estimate double")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, by their full sets."""
    side = lambda s: sets.select(F.col("cls").alias(s), F.col("shingles").alias(f"set_{s}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return joined.mapInArrow(confirm, "a long, b long")


def _split(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    side = lambda s: labels.select(F.col("node").alias(f"_{s}"), F.col("component").alias(f"c{s}"))
    joined = pairs.join(side("a"), F.col("a") == F.col("_a"), "left").join(side("b"), F.col("b") == F.col("_b"), "left")
    return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of (doc_id, text)."""
    return _classified(docs).drop("whole")


def _classified(docs: DataFrame) -> DataFrame:
    """(doc_id, whole, n_shingles, component_id, kept) for each row of (doc_id, text); whole: key of the row's text."""
    sketched = durable(sketches(docs), "sketches")
    known = sketched.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    first = F.min(F.struct("doc_id", "n_shingles", "bands")).alias("first")
    # A class of equal word sequences has a number of its own: two of them may have one doc_id.
    classes = durable(known.groupBy("digest").agg(first).select("digest", F.monotonically_increasing_id().alias("cls"), F.col("first.doc_id").alias("first_id"), "first.n_shingles", "first.bands"), "classes")

    bands = classes.select("cls", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key"))
    groups = bands.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1").withColumnsRenamed({"band": "_band", "key": "_key"})
    same_group = (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key"))
    # The text that others were copied from shares the most bands, so the member that meets the most others is the center.
    # A class has one row a band at most, so its window is small.
    degree = F.sum("size").over(Window.partitionBy("cls"))
    members = durable(bands.join(groups, same_group).select("cls", "n", "band", "key", "size", degree.alias("degree")), "members")
    centers = members.groupBy("band", "key").agg(F.max(F.struct("degree", F.xxhash64("band", "cls").alias("h"), "cls"))["cls"].alias("center")).withColumnsRenamed({"band": "_band", "key": "_key"})
    pairs = members.join(centers, same_group).where("cls <> center").select(F.greatest("cls", "center").alias("a"), F.least("cls", "center").alias("b")).distinct()
    pairs = durable(_estimated(pairs, classes), "pairs")

    met_once = members.select(F.col("cls").alias("_cls")).distinct()
    wanted = classes.join(met_once, F.col("cls") == F.col("_cls"), "left_semi").select(F.col("first_id").alias("_id"), "digest", "cls")
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id") == F.col("_id"))
    sets = durable(shingle_sets(rows.withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "cls", "_text"])), "sets")

    # Each member's best pair first: most pairs then lie within one star and need no confirming.
    best = durable(pairs.groupBy("a").agg(F.max(F.struct("estimate", "b"))["b"].alias("b")), "best")
    found = durable(_confirmed(best, sets), "links")
    stars = durable(_stars(found), "stars")
    found = durable(found.unionByName(_confirmed(_split(pairs.join(best, ["a", "b"], "left_anti"), stars), sets)), "links")
    labels = _joined(found, stars)

    # Members of a band's group that are still apart, from all its others.
    marked = members.join(labels, F.col("cls") == F.col("node"), "left").select("band", "key", "cls", "n", "size", F.coalesce("component", "cls").alias("component"))
    apart = marked.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select(F.col("band").alias("_band"), F.col("key").alias("_key"))
    marked = durable(marked.join(apart, same_group).select("band", "key", "cls", "n", "size", "component"), "apart")
    few = marked.where(F.col("size") <= FEW).drop("size")
    across = few.join(few.toDF("_band", "_key", "b", "_n", "_component"), same_group & (F.col("component") != F.col("_component")) & (F.col("cls") > F.col("b")) & (100 * F.least("n", "_n") >= PERCENT * F.greatest("n", "_n")))
    many = marked.where(F.col("size") > FEW).select(F.col("cls").alias("_cls")).distinct()
    met = durable(prefix_pairs(sets.join(many, F.col("cls") == F.col("_cls"), "left_semi"), labels), "met")
    more = across.select(F.col("cls").alias("a"), "b").unionByName(met).distinct().join(pairs, ["a", "b"], "left_anti")
    more = durable(_estimated(more, classes), "more")
    labels = _joined(durable(_confirmed(more, sets), "links"), labels)

    # A component is named by its smallest doc_id.
    ids = labels.join(classes.select(F.col("cls").alias("_cls"), "first_id"), F.col("node") == F.col("_cls"))
    smallest = ids.groupBy("component").agg(F.min("first_id").alias("component_id")).withColumnRenamed("component", "_component")
    named = labels.join(smallest, F.col("component") == F.col("_component")).select("node", "component_id")
    placed = sketched.join(classes.select(F.col("digest").alias("_digest"), "cls", "first_id"), F.col("digest") == F.col("_digest"), "left")
    placed = placed.join(named, F.col("cls") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "first_id", "doc_id"))
    return placed.select("doc_id", "whole", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _stars(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b) that have each a once: the node that three steps lead to. Parts of components, told without a loop."""
    step = lambda frm, to: links.select(F.col("a").alias(frm), F.col("b").alias(to))
    end = links.join(step("b", "_c"), "b", "left").join(step("_c", "_d"), "_c", "left").select("a", F.coalesce("_d", "_c", "b").alias("component"))
    centers = links.select("b").distinct().join(end.select(F.col("a").alias("b"), "component"), "b", "left").select(F.col("b").alias("node"), F.coalesce("component", "b").alias("component"))
    return end.withColumnRenamed("a", "node").unionByName(centers).dropDuplicates(["node"])


def _joined(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The components once more links are known: those of the components that the links join.

    ``labels`` may name parts of components, if the links tell how they hang together; no node's name is greater than itself.
    """
    if links.isEmpty():
        return labels
    of = lambda s: labels.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    above = components(between).select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    every = labels.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).withColumn("component", F.col("node"))).groupBy("node").agg(F.min("component").alias("component"))
    return durable(every.join(above, F.col("component") == F.col("_node"), "left").select("node", F.coalesce("_component", "component").alias("component")), "labels")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that a document with a smaller doc_id in their component stands for.

    A row is told by its doc_id and its text: unlike texts under one doc_id go or stay each by its own component.
    """
    gone = _classified(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("whole").alias("_whole")).distinct()
    rows = held_whole(docs, _doc=F.col("doc_id").cast("long"), _key=text_key(F.col("text")))
    return rows.join(gone, (F.col("_doc") == F.col("_id")) & (F.col("_key") == F.col("_whole")), "left_anti").transform(let_go, docs.columns)


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
