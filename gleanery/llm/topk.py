"""Exact top-k search by inner product, without random access to the lists.

Vectors are dealt into blocks. Where a block of queries meets a block of candidates, the candidates'
components form one sorted list per dimension, read from its top for positive query components and from
its bottom for negative ones. After every round of sequential reads each score lies between a lower bound
(an unread component is at the far end of its list) and an upper bound (it is at most the last value read).
For each query, candidates whose upper bound falls below its k-th lower bound cannot qualify and go; the scores of the
rest are resolved. A query's first bound is its k-th best of a few drawn candidates. A task meets the blocks of its column
one after another and carries each query's k best along, so the k-th of all blocks so far is the bound that the next
block's candidates must reach. The columns' winners, k for each query and column, are then ranked together. Block sizes and columns follow from
the numbers of candidates and queries (``layout``).

Defined results: vectors that are null, or hold nulls, NaN or infinities, take no part; vectors of unlike
lengths have no score with each other; a query never meets rows of its own vec_id, however unlike; repeated rows of one
vec_id and vector count once, unlike rows of one vec_id each count; ties go to the smaller vec_id; an empty table gives
an empty table. Scores must fit a 64-bit integer. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

SCALE, EVERY, K = 64, 20, 20
#: Blocks that the candidates make at least, where they are many enough, and the sizes of a block.
LEAST_BLOCKS, BLOCK_SIZES = 128, (32, 1024)
QUERY_BLOCK = 256
#: Query blocks that a task takes through one column, pairs that it meets, about, and blocks that a column has at least.
QUERY_BLOCKS, TASK_PAIRS, COLUMN_BLOCKS = 2, 200_000_000, 32
#: Candidates that the first bounds come from, for each of the k.
FIRST = 2
#: Depths of the rounds, as shares of the lists.
ROUNDS = (1 / 2, 3 / 4, 7 / 8, 15 / 16, 31 / 32)


def layout(candidates: int, queries: int, cores: int) -> tuple[int, int, int]:
    """(block size, columns, lanes): a lane's query blocks meet each column in one task, so there are columns times lanes tasks."""
    block = min(max(candidates // LEAST_BLOCKS, BLOCK_SIZES[0]), BLOCK_SIZES[1])
    lanes = max(1, -(-queries // (QUERY_BLOCK * QUERY_BLOCKS)))
    tasks = max(candidates * queries // TASK_PAIRS + 1, 2 * cores)
    columns = max(1, min(-(-tasks // lanes), candidates // (block * COLUMN_BLOCKS)))
    return block, columns, lanes


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector array<long>), without the vectors that take no part."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound).select("vec_id", whole.alias("vector")).dropDuplicates()


def _exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest type in which all inner products of rows of a and b are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), np.iinfo(np.int64).min)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.size = np.zeros(queries, np.int64)

    def bound(self) -> np.ndarray:
        """The score that a candidate must reach, -inf while a query has fewer than k."""
        return np.where(self.size >= self.k, self.score[:, -1].astype(float), -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        held, place = np.nonzero(np.arange(self.k) < self.size[:, None])
        query = np.concatenate([held, query])
        ids, score = np.concatenate([self.ids[held, place], ids]), np.concatenate([self.score[held, place], score])
        order = np.lexsort((ids, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        query, rank, order = query[kept], rank[kept], order[kept]
        self.ids[query, rank], self.score[query, rank] = ids[order], score[order]
        self.size = np.bincount(query, minlength=len(self.size))


def nra_block(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int, read: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) places of the pairs that may be among a query's k best, a superset of them; all others are out by their bounds.

    own: for each query, the first and last + 1 place of rows that don't count. bound: the score that a query's k-th best
    so far has, or -inf. read: counts the pairs met and those that each round leaves.
    """
    (m, dims), n = queries.shape, len(rows)
    q, live = np.arange(m), np.arange(n)
    # Which row may still be among the best of which query.
    may = np.ones((m, n), bool)
    for i in np.flatnonzero(own[:, 1] > own[:, 0]):
        may[i, own[i, 0] : own[i, 1]] = False
    read = Counter() if read is None else read
    read["met"] += int(may.sum())
    both = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)
    ordered = np.sort(rows, axis=0)
    low, high = ordered[0], ordered[-1]
    for share in ROUNDS:
        depth = int(n * share)
        if not dims or not len(q) or not len(live):
            break
        if not depth:
            continue
        # A list read from its top has shown every value above its frontier; likewise from its bottom.
        top, bottom, left = ordered[n - depth], ordered[depth - 1], rows[live]
        if np.isneginf(bound[q]).any():
            lower = both[q] @ np.concatenate([np.where(left >= top, left, low), np.where(left <= bottom, left, high)], axis=1).T
            lower = np.where(may, lower, -np.inf)
            kth = np.partition(lower, max(0, lower.shape[1] - k), axis=1)[:, max(0, lower.shape[1] - k)] if lower.shape[1] >= k else np.full(len(q), -np.inf)
            bound = bound.copy()
            bound[q] = np.maximum(bound[q], kth)
        upper = both[q] @ np.concatenate([np.maximum(left, top), np.minimum(left, bottom)], axis=1).T
        may &= upper >= bound[q][:, None]
        read[f"left {share}"] += int(may.sum())
        queries_left, rows_left = may.any(axis=1), may.any(axis=0)
        q, live, may = q[queries_left], live[rows_left], may[np.ix_(queries_left, rows_left)]
    i, j = np.nonzero(may)
    read["resolved"] += len(i)
    return q[i], live[j]


def resolved(queries: np.ndarray, rows: np.ndarray, query: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The whole scores of pairs."""
    if 4 * len(query) > len(queries) * len(rows):
        return (queries @ rows.T)[query, row].astype(np.int64)
    parts = [np.einsum("ij,ij->i", queries[query[i : i + 65536]], rows[row[i : i + 65536]]) for i in range(0, len(query), 65536)]
    return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)


def first_bounds(ids: np.ndarray, rows: np.ndarray, few: list[tuple[int, list]], k: int) -> np.ndarray:
    """The score that each query's k-th best reaches at least, from a few candidates (vec_id, vector); -inf where they are fewer than k."""
    best = Best(len(ids), k)
    like = [(i, v) for i, v in few if len(v) == rows.shape[1]]
    if like:
        names, vectors = np.array([i for i, _ in like]), np.array([v for _, v in like], dtype=np.int64)
        kind = _exact_type(rows, vectors)
        query, place = np.nonzero(ids[:, None] != names)
        best.add(query, names[place], (rows.astype(kind) @ vectors.astype(kind).T)[query, place].astype(np.int64))
    return best.bound()


def _blocks(vectors: DataFrame, size: int, few: list[tuple[int, list]] | None = None, k: int = K) -> DataFrame:
    """Each block packed as one row: (dims, block, n, ids, width, data, bound), sorted by id; blocks are numbered from another start in each task.

    few: candidates for the first bounds of blocks of queries.
    """
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        number = itertools.count(TaskContext.get().partitionId() * 7919)

        def out(dims: int, rows: list) -> pd.DataFrame:
            rows.sort(key=lambda r: r[0])
            ids, data = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64).reshape(len(rows), dims)
            kind = next(t for t in (np.int16, np.int32, np.int64) if np.abs(data).max(initial=0) <= np.iinfo(t).max)
            return pd.DataFrame({"dims": [dims], "block": [next(number)], "n": [len(rows)], "ids": [ids.tobytes()], "width": [np.dtype(kind).itemsize], "data": [data.astype(kind).tobytes()], "bound": [b"" if few is None else first_bounds(ids, data, few, k).tobytes()]})

        for frame in frames:
            for vec_id, vector in zip(frame["vec_id"], frame["vector"], strict=True):
                rows = held.setdefault(len(vector), [])
                rows.append((vec_id, vector))
                if len(rows) == size:
                    yield out(len(vector), held.pop(len(vector)))
        for dims, rows in held.items():
            yield out(dims, rows)

    return vectors.mapInPandas(pack, "dims int, block long, n int, ids binary, width int, data binary, bound binary")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the k best candidates of each query; both sides are (vec_id, vector)."""
    n, m = candidates.count(), queries.count()
    block, columns, lanes = layout(n, m, queries.sparkSession.sparkContext.defaultParallelism)
    # About FIRST * k candidates, whatever their number.
    scale = 1 << 40
    few = [(r[0], list(r[1])) for r in candidates.where(F.pmod(F.xxhash64(F.lit("first"), "vec_id"), F.lit(scale)) < FIRST * k * scale // max(n, 1)).limit(8 * FIRST * k).collect()]
    spread = lambda name, parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(name)
    fields = ("dims", "ids", "width", "data")
    far = _blocks(candidates, block).select(*fields, F.pmod("block", F.lit(columns)).cast("int").alias("column"), spread("lane", lanes))
    near = _blocks(queries, QUERY_BLOCK, few, k).select("block", *[F.col(c).alias(f"q_{c}") for c in (*fields, "bound")], F.pmod("block", F.lit(lanes)).cast("int").alias("q_lane"), spread("q_column", columns))
    # Every task takes its query blocks one after another, each through the whole column.
    pairs = near.join(far.hint("merge"), (F.col("q_lane") == F.col("lane")) & (F.col("q_column") == F.col("column")) & (F.col("q_dims") == F.col("dims")))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = lambda ids, width, data, dims: (np.frombuffer(ids, dtype=np.int64), np.frombuffer(data, dtype=f"i{width}").reshape(-1, dims))
        at, best, first, q_ids, q = None, None, None, None, None

        def out() -> pd.DataFrame:
            query, place = np.nonzero(np.arange(k) < best.size[:, None])
            return pd.DataFrame({"query_id": q_ids[query], "vec_id": best.ids[query, place], "score": best.score[query, place]})

        for frame in frames:
            for r in frame.itertuples():
                if (r.block, r.q_dims, r.column) != at:
                    if best is not None:
                        yield out()
                    at = r.block, r.q_dims, r.column
                    q_ids, q = unpack(r.q_ids, r.q_width, r.q_data, r.dims)
                    best, first = Best(len(q_ids), k), np.frombuffer(r.q_bound)
                ids, rows = unpack(r.ids, r.width, r.data, r.dims)
                kind = _exact_type(q.astype(np.int64), rows.astype(np.int64))
                of, whole = q.astype(kind), rows.astype(kind)
                own = np.stack([np.searchsorted(ids, q_ids, "left"), np.searchsorted(ids, q_ids, "right")], axis=1)
                query, row = nra_block(of, whole, own, np.maximum(best.bound(), first), k)
                best.add(query, ids[row], resolved(of, whole, query, row))
        if best is not None:
            yield out()

    found = pairs.mapInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = durable(quantised(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors.where(F.col("vec_id") % EVERY == 0), vectors)


OP2_SQL = f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
