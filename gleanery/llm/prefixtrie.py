"""Conversations as a trie of turns, in double arrays.

A node is a sequence of first turns that some conversations share. Turns get 128-bit ids by their role and text, and a prefix
is known by its depth and the exclusive or of its turns' ids hashed with their places, a running total that
conversations of any length are cut for. Nodes that one conversation alone reaches are tails, kept out of the arrays, as is
usual with double arrays; there is no more to know of them than their conversation.

What remains are shared paths: conversations that leave the shared nodes at the same place are one path with a count. Paths are
dealt into shards by prefix: the shallowest prefix that at most ``HEAVY`` paths have. In its shard a task numbers the turns
densely, packs BASE and CHECK, and walks all paths through them in step; what nodes add up to goes from the deepest
to the root along CHECK. Nodes above the shards' prefixes are met by several shards; one of them, named in advance, counts such
a node's own words and its place among its parent's children, so that the shards' parts only have to be added up.

Defined results: rows without conv_id take no part; null roles and texts are empty; null turns come first; rows of one turn are ordered by
the hash of role and text, repeated rows are turns each; conversations left without turns are members of the root; an
empty table has no node; other columns are ignored. Memory grows with the longest path that conversations share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import running
from .common import durable, n_words_of, table, text_of

#: A conversation begins with up to ``HEADS - 1`` turns of the first one of its group of ``GROUP`` ids.
GROUP, HEADS = 20, 4
#: Prefixes of more paths are shared by shards; turns that a shard holds, about, beside one prefix's paths.
HEAVY, SHARD_TURNS = 2_000, 200_000
#: Ids of ending conversations are joined to text in spans of so many numbers, as a power of two.
SPAN_BITS = 12
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = ("depth", "a", "b")


class DoubleArray:
    """A trie over sequences of dense ids: a node at place t has its child by id x at BASE[t] + x, if CHECK there is t.

    The root lies at place 0. Ids begin with 1, so BASE can be 0 where a node's children are the only ones to lie there.
    """

    def __init__(self, paths: list[np.ndarray]):
        self.base, self.check = np.zeros(16, np.int64), np.full(16, -1, np.int64)
        self.check[0] = 0
        self._free = 1
        order = sorted(range(len(paths)), key=lambda i: paths[i].tolist())
        sizes = np.array([len(paths[i]) for i in order], np.int64)
        # Nodes to do, a level at a time: (place, first path, last path + 1), all of which go through it.
        level, depth = [(0, 0, len(order))], 0
        columns = _columns([paths[i] for i in order])
        while level:
            below, column = [], columns(depth)
            for place, lo, hi in level:
                # Paths that end here come first.
                while lo < hi and sizes[lo] <= depth:
                    lo += 1
                if lo == hi:
                    continue
                at = column[lo:hi]
                starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                ids = at[starts]
                base = self._fit(ids)
                self.base[place] = base
                self.check[base + ids] = place
                ends = [*starts[1:], hi - lo]
                below.extend((int(base + x), lo + int(s), lo + int(e)) for x, s, e in zip(ids, starts, ends, strict=True))
            level, depth = below, depth + 1

    def _fit(self, ids: np.ndarray) -> int:
        """The first base at which the places of all these ids, in ascending order, are free."""
        while self._free < len(self.check) and self.check[self._free] >= 0:
            self._free += 1
        base = self._free - int(ids[0])
        while True:
            most = base + int(ids[-1])
            if most >= len(self.check):
                grown = max(most + 1, 2 * len(self.check))
                self.base = np.concatenate([self.base, np.zeros(grown - len(self.base), np.int64)])
                self.check = np.concatenate([self.check, np.full(grown - len(self.check), -1, np.int64)])
            if (self.check[base + ids] < 0).all():
                return base
            base += 1
            while base + int(ids[0]) < len(self.check) and self.check[base + int(ids[0])] >= 0:
                base += 1

    def step(self, places: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The children of nodes by id, -1 where there is none."""
        to = self.base[places] + ids
        inside = (to > 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == places), to, -1)


def _columns(paths: list[np.ndarray]):
    """depth -> the ids of all paths there, 0 beyond a path's end."""
    starts = np.cumsum([0, *map(len, paths)])
    flat = np.concatenate([*paths, np.zeros(1, np.int64)])
    sizes = np.diff(starts)
    return lambda d: np.where(sizes > d, flat[np.minimum(starts[:-1] + d, len(flat) - 1)], 0)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, id, words) of each rebuilt conversation's turns, and the table of conversations: (conv_id)."""
    role, text = F.coalesce("role", F.lit("")), text_of()
    key = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("id"), n_words_of(text).alias("words"))
    numbered = durable(running(turns, ["conv_id"], ["turn", "id"], place=("sum", F.lit(1))).withColumn("place", F.col("place") - 1), "turns")
    borrows = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS))
    host = F.col("conv_id") - F.col("conv_id") % GROUP
    convs = durable(numbered.select("conv_id").distinct().select("conv_id", borrows.alias("h"), host.alias("host")), "conversations")
    heads = durable(numbered.where((F.col("conv_id") % GROUP == 0) & (F.col("place") < HEADS - 1)).select(F.col("conv_id").alias("_host"), "place", "id", "words"), "heads")
    # A host has fewer than HEADS of these rows and fewer than twice GROUP guests.
    first = convs.join(heads, (F.col("host") == F.col("_host")) & (F.col("place") < F.col("h"))).select("conv_id", "place", "id", "words")
    sizes = heads.groupBy("_host").agg(F.count("*").alias("held"))
    short = convs.join(sizes, F.col("host") == F.col("_host"), "left").select(F.col("conv_id").alias("_conv"), (F.col("h") - F.coalesce("held", F.lit(0))).alias("short")).where("short > 0")
    own = numbered.where(F.col("place") >= borrows).join(durable(short, "short"), F.col("conv_id") == F.col("_conv"), "left").select("conv_id", (F.col("place") - F.coalesce("short", F.lit(0))).alias("place"), "id", "words")
    return first.unionByName(own).select("conv_id", (F.col("place") + 1).alias("depth"), "id", "words"), convs.select("conv_id")


def _same(left: tuple[str, ...], right: tuple[str, ...]):
    return (F.col(left[0]) == F.col(right[0])) & (F.col(left[1]) == F.col(right[1])) & (F.col(left[2]) == F.col(right[2]))


def _renamed(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in columns])


def prefixes(turns: DataFrame) -> DataFrame:
    """Each row of (conv_id, depth, id, words) with its node (depth, a, b) and the node's parent (pa, pb)."""
    a, b = F.xxhash64("id", "depth"), F.xxhash64("depth", "id")
    keyed = running(turns, ["conv_id"], ["depth"], a=("xor", a), b=("xor", b))
    return keyed.withColumns({"pa": F.col("a").bitwiseXOR(a), "pb": F.col("b").bitwiseXOR(b)})


def trie_nodes(turns: DataFrame, convs: DataFrame, heavy: int = HEAVY, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    turns: (conv_id, depth from 1 on, id, words) without gaps; convs: all conv_ids, those without turns too.
    """
    rows = durable(prefixes(turns), "prefixes")
    reached = durable(rows.groupBy(*NODE).agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"), F.min("pa").alias("pa"), F.min("pb").alias("pb")), "reached")
    tails = durable(reached.where("lo = hi").select(F.col("lo").alias("conv_id"), *NODE, "pa", "pb"), "tails")
    cut = tails.groupBy("conv_id").agg(F.min(F.struct("depth", "pa", "pb")).alias("first"), F.max("depth").alias("last"))
    cut = durable(cut.select(F.col("conv_id").alias("_conv"), F.col("first.depth").alias("cut"), F.col("first.pa").alias("ca"), F.col("first.pb").alias("cb"), "last"), "cuts")

    # Where each conversation leaves the shared nodes: before its tail, at its end, or at the root.
    end = rows.groupBy(F.col("conv_id").alias("_id")).agg(F.max(F.struct("depth", "a", "b")).alias("end"))
    stops = convs.join(end, F.col("conv_id") == F.col("_id"), "left").join(cut, F.col("conv_id") == F.col("_conv"), "left")
    zero = F.lit(0).cast("long")
    pick = lambda at, own: F.when(F.col("cut").isNotNull(), at).otherwise(F.coalesce(own, zero))
    stops = durable(stops.select("conv_id", pick(F.col("cut") - 1, F.col("end.depth")).alias("depth"), pick(F.col("ca"), F.col("end.a")).alias("a"), pick(F.col("cb"), F.col("end.b")).alias("b"), F.col("cut").isNotNull().cast("long").alias("tail")), "stops")
    classes = durable(stops.groupBy(*NODE).agg(F.min("conv_id").alias("path"), F.count("*").alias("n"), F.sum("tail").alias("tails")), "classes")

    parts = durable(_shards(rows, classes, heavy, shard_turns), "parts")
    at_root = classes.where("depth = 0").select(*NODE, F.lit(True).alias("upper"), zero.alias("pa"), zero.alias("pb"), "n", F.col("path").alias("lo"), F.lit(None).cast("long").alias("up"), F.col("tails").alias("children"), F.col("tails").alias("leaves"), zero.alias("saved"))
    # The parts of nodes that several shards meet are added up.
    merged = parts.where("upper").unionByName(at_root).groupBy(*NODE).agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    # A node above the shards has children; only the root of a table without turns has none.
    merged = durable(merged.withColumn("leaves", F.greatest("leaves", F.lit(1))), "merged")
    fields = (*NODE, "pa", "pb", "lo", "n", "children", "leaves", "saved")
    above = _renamed(merged, "u_", *NODE, "lo")
    parent = _same(("_up", "pa", "pb"), ("u_depth", "u_a", "u_b"))
    every = parts.where("NOT upper").select(*fields, "up").unionByName(merged.select(*fields, F.lit(None).cast("long").alias("up")))
    every = every.withColumn("_up", F.when(F.col("up").isNull(), F.col("depth") - 1)).join(above, parent, "left")
    shared = durable(every.select(*fields, F.coalesce("up", "u_lo").alias("up")), "shared")

    ended = _renamed(ends(stops.where("tail = 0")), "e_", *NODE, "sha")
    out = shared.join(ended, _same(NODE, ("e_depth", "e_a", "e_b")), "left").select(
        F.col("lo").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("e_sha", F.lit(NOTHING)).alias("ends_sha256"))

    # Tails: their first node hangs on a shared one, the others on their conversation's own.
    first = cut.select(F.col("_conv").alias("conv_id"), F.col("cut").alias("depth"), "last", "ca", "cb", (F.col("cut") - 1).alias("_up"))
    first = first.join(_renamed(shared, "s_", *NODE, "lo"), _same(("_up", "ca", "cb"), ("s_depth", "s_a", "s_b"))).select("conv_id", "depth", "last", F.col("s_lo").alias("up"))
    rest = tails.join(cut, (F.col("conv_id") == F.col("_conv")) & (F.col("depth") > F.col("cut"))).select("conv_id", "depth", "last", F.col("conv_id").alias("up"))
    is_end = F.col("depth") == F.col("last")
    alone = first.unionByName(rest).select(
        "conv_id", "depth", F.col("up").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(is_end, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        zero.alias("saved_tokens"), F.when(is_end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOTHING)).alias("ends_sha256"))
    return out.unionByName(alone)


def _shards(rows: DataFrame, classes: DataFrame, heavy: int, shard_turns: int) -> DataFrame:
    """What the nodes of each shard add up to; ``upper`` ones are met by other shards too and hold a part."""
    held = classes.where("depth > 0").select(F.col("path").alias("_path"), F.col("depth").alias("_stop"), "n", "tails")
    kept = durable(rows.join(held, (F.col("conv_id") == F.col("_path")) & (F.col("depth") <= F.col("_stop"))).select(F.col("conv_id").alias("path"), "depth", "id", "words", "a", "b", "n", "tails"), "paths")
    uppers = kept.groupBy(*NODE).agg(F.count("*").alias("m"), F.min("path").alias("owner")).where(F.col("m") > heavy)
    flagged = kept.join(durable(_renamed(uppers, "_", *NODE, "owner"), "uppers"), _same(NODE, ("_depth", "_a", "_b")), "left")
    turn = F.struct("depth", "id", "words", "a", "b", F.col("_owner").isNotNull().alias("upper"), (F.col("_owner").isNull() | (F.col("_owner") == F.col("path"))).alias("own"))
    paths = flagged.groupBy("path", "n", "tails").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    lower = F.coalesce(F.get(F.filter("turns", lambda t: ~t["upper"]), F.lit(0)), F.element_at("turns", -1))
    shards = max(1, -(-kept.count() // shard_turns))
    dealt = paths.withColumn("shard", F.pmod(F.xxhash64(lower["a"], lower["b"]), F.lit(shards)))
    fields = [F.col(f"turns.{f}").alias(f) for f in ("id", "words", "a", "b", "upper", "own")]
    return dealt.select("shard", "path", "n", "tails", *fields).groupBy("shard").applyInPandas(_walked, "depth long, a long, b long, upper boolean, pa long, pb long, n long, lo long, up long, children long, leaves long, saved long")


def _walked(paths: pd.DataFrame) -> pd.DataFrame:
    """All nodes of a shard, by its double arrays: the root first, then by depth."""
    sizes = paths["id"].map(len).to_numpy()
    starts = np.cumsum(sizes) - sizes
    flat = {c: np.concatenate([np.asarray(v) for v in paths[c]]) for c in ("words", "a", "b", "upper", "own")}
    dense: dict[bytes, int] = {}
    ids = np.array([dense.setdefault(x, len(dense) + 1) for seq in paths["id"] for x in map(bytes, seq)], np.int64)
    trie = DoubleArray([ids[s : s + k] for s, k in zip(starts, sizes, strict=True)])
    size = len(trie.check)
    n, lo, tails = (paths[c].to_numpy(np.int64) for c in ("n", "path", "tails"))
    convs, least, stops = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
    depth, some = np.zeros(size, np.int64), np.zeros(size, np.int64)
    at, going, levels = np.zeros(len(paths), np.int64), np.arange(len(paths)), [np.zeros(1, np.int64)]
    owned = np.zeros(size, bool)
    np.add.at(convs, at, n)
    np.minimum.at(least, at, lo)
    for d in range(int(sizes.max())):
        going = going[sizes[going] > d]
        turn = starts[going] + d
        at[going] = there = trie.step(at[going], ids[turn])
        if (there < 0).any():
            raise ValueError("a path left its trie")
        np.add.at(convs, there, n[going])
        np.minimum.at(least, there, lo[going])
        np.logical_or.at(owned, there, flat["own"][turn].astype(bool))
        depth[there], some[there] = d + 1, turn
        levels.append(np.unique(there))
    np.add.at(stops, at, tails)
    upper = flat["upper"].astype(bool)[some]
    upper[0], owned[0] = True, False
    words = flat["words"][some].astype(np.int64)
    words[0] = 0
    nodes = np.concatenate(levels)
    children, leaves, saved = stops.copy(), stops.copy(), np.zeros(size, np.int64)
    saved[nodes] = (convs[nodes] - owned[nodes]) * words[nodes]
    for level in reversed(levels[1:]):
        leaves[level] += ~upper[level] & (children[level] == 0)
        up = trie.check[level]
        np.add.at(children, up, owned[level].astype(np.int64))
        np.add.at(leaves, up, leaves[level])
        np.add.at(saved, up, saved[level])
    up = trie.check[nodes]
    key = lambda c, of: np.where(depth[of] > 0, flat[c][some[of]], 0)
    out = {"depth": depth[nodes], "a": key("a", nodes), "b": key("b", nodes), "upper": upper[nodes], "pa": key("a", up), "pb": key("b", up), "n": convs[nodes], "lo": least[nodes]}
    out["up"] = pd.array(least[up], dtype="Int64")
    out["up"][upper[up]] = pd.NA
    return pd.DataFrame(out | {"children": children[nodes], "leaves": leaves[nodes], "saved": saved[nodes]})


def ends(stops: DataFrame) -> DataFrame:
    """(depth, a, b, sha) of each node at which conversations end: SHA-256 of their ids in ascending order, comma-joined.

    A digest can't be put together from parts, but sorting and joining can: spans of numbers are joined to text apart, and the
    last task of a node reads its spans one after another.
    """
    spans = stops.groupBy(*NODE, F.expr(f"shiftright(conv_id, {SPAN_BITS})").alias("span")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done: list[tuple] = []
            for *at, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != node:
                    if node is not None:
                        done.append((*node, sha.hexdigest()))
                    node, sha = at, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _ended(done)
        if node is not None:
            yield _ended([(*node, sha.hexdigest())])

    def _ended(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.int64()) for i in range(3)] + [pa.array([x[3] for x in done], pa.string())], [*NODE, "sha"])

    sorted_spans = spans.repartition(*NODE).sortWithinPartitions(*NODE, "span")
    return sorted_spans.select(*NODE, "ids").mapInArrow(digest, "depth long, a long, b long, sha string")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(*rebuilt(table(spark, sf_dir, "conversations")))


# The unsigned CRC-32 of a number's digits, bit by bit: an element of -1 moves on by one bit, others are bytes.
_CRC = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(s) + 1), lambda i: [ascii(substr(s, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384::BIGINT) ELSE crc >> 1 END)"""
OP13_SQL = rf"""
WITH o AS (SELECT conv_id AS c, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, id) - 1 AS pos FROM o),
k AS (SELECT c, c - c % {GROUP} AS host, xor({_CRC}, 4294967295) % {HEADS} AS h FROM (SELECT DISTINCT c, c::VARCHAR AS s FROM o)),
b AS (SELECT k.c, 0 AS own, p.pos, p.id, p.w FROM k JOIN p ON p.c = k.host AND p.pos < k.h UNION ALL SELECT k.c, 1, p.pos, p.id, p.w FROM k JOIN p ON p.c = k.c AND p.pos >= k.h),
r AS (SELECT c, list(id ORDER BY own, pos) AS ids, list(w ORDER BY own, pos) AS ws FROM b GROUP BY c),
z AS (SELECT k.c, coalesce(ids, []) AS ids, coalesce(ws, []) AS ws FROM k LEFT JOIN r USING (c)),
m AS (SELECT c, d, array_to_string(ids[1:d], '') AS node, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, d = len(ids) AS ends, CASE WHEN d > 0 THEN array_to_string(ids[1:d - 1], '') END AS up FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM z)),
n AS (SELECT node, d, up, min(c) AS conv_id, count(*) AS n, max(w) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS sha FROM m GROUP BY node, d, up),
l AS (SELECT x.node, count(y.node) AS kids FROM n x LEFT JOIN n y ON y.up = x.node GROUP BY x.node),
t AS (SELECT x.node, sum((y.n - 1) * y.w)::BIGINT AS saved, count(*) FILTER (l.kids = 0) AS leaves FROM n x JOIN n y ON starts_with(y.node, x.node) JOIN l ON l.node = y.node GROUP BY x.node)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, l.kids AS n_children, t.leaves AS n_leaves, t.saved AS saved_tokens, n.sha AS ends_sha256
FROM n JOIN l USING (node) JOIN t USING (node) LEFT JOIN n u ON u.node = n.up
"""
