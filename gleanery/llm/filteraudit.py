"""How filters interact: what each removes alone, after others and on average over all orders, by counting paths.

A document fails a set of filters. The subsets of the filters are the states of a lattice: a state is what has
been applied, and an edge (state, filter) applies one filter more, so an order of all filters is a path from the empty
set to the full one. ``path_counts`` counts, forward, the paths that reach each state and, backward, those that go on from it to the
end; their product over an edge is the number of orders that take it. What an edge removes are the documents that fail its filter and
none of its state's, whatever the order of those. So a filter's Shapley value is the sum of its edges' removals, each
weighted by its orders, and every step of every order is read off the same edges: nothing is filtered twice.

The documents only enter as counts for each part and set of failed filters, 2 ** k cells a part at most, added up where the documents are.

Defined results: a null text counts as empty, a null source as the empty string; a text without words fails A alone of A and B; of equal texts all but the
rows with the smallest doc_id fail E; a null doc_id is neither larger nor smaller than any, so it never fails E nor
makes another fail; repeated rows count each; a document is good or toxic if any of its labels says so; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, WORD, durable, evenly, table, text_of, words_of

FILTERS = "ABCDE"
#: The lattice has k * 2 ** (k - 1) edges, written out for each part.
MOST_FILTERS = 12
LEAST_WORDS, LEAST_VARIETY, MOST_CAPITALS = 200, 50, 2
MARKUP = "[#$%&*|]"


def path_counts(k: int) -> tuple[list[int], list[int]]:
    """For each state, as bits of k filters: the paths from the empty state to it and from it to the full one."""
    states = sorted(range(1 << k), key=int.bit_count)
    forward, backward = [0] * (1 << k), [0] * (1 << k)
    forward[0] = backward[-1] = 1
    for s in states:
        for f in range(k):
            if not s >> f & 1:
                forward[s | 1 << f] += forward[s]
    for s in reversed(states):
        for f in range(k):
            if not s >> f & 1:
                backward[s] += backward[s | 1 << f]
    return forward, backward


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of each document: the filters it fails, as bits from A on, and its labels.

    Copies of a text meet their first by (text, doc_id), so that no group of copies, however large, lies on one key.
    """
    text, words = text_of(), F.col("_words")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    fails = [n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_VARIETY * n, 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(MARKUP)]
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)), F.lit(0))
    facts = docs.select("doc_id", "source", "text").withColumn("_words", words_of(text)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))
    facts = durable(facts, "facts")
    firsts = facts.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("_first")).withColumnRenamed("digest", "_digest")
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(f"_{c}")
    flags = labels.where("quality = 1 OR toxic = 1").groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg(flag("quality"), flag("toxic"))
    joined = facts.join(firsts, (F.col("digest") == F.col("_digest")) & (F.col("doc_id") == F.col("_first")), "left")
    joined = joined.join(durable(flags, "flags"), F.col("doc_id") == F.col("_labelled"), "left")
    copy = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    return joined.select("part", (F.col("mask") + F.when(copy, 1 << len(fails)).otherwise(0)).alias("mask"), F.coalesce("_quality", F.lit(0)).alias("good"), F.coalesce("_toxic", F.lit(0)).alias("toxic"))


def edges(masks: DataFrame, k: int) -> DataFrame:
    """(part, state, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every edge of the lattice, zeros included.

    filter: the bit's number; orders: how many orders take the edge; kept: what is left behind it; shapley: the filter's removals over all orders.
    """
    if k > MOST_FILTERS:
        raise ValueError(f"over {MOST_FILTERS} filters")
    cells = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))
    # At most 2 ** k cells a part.
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    walked = parts.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1))).alias("state"))
    walked = walked.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("filter")).withColumn("bit", F.expr("shiftleft(1, filter)"))
    walked = walked.where(F.col("state").bitwiseAND(F.col("bit")) == 0)
    holds = lambda c, bits: c["mask"].bitwiseAND(F.col(bits)) != 0

    def total(value: str, when) -> Column:
        return F.aggregate(F.filter("cells", when), F.lit(0).cast("long"), lambda so_far, c: so_far + c[value])

    here = lambda c: holds(c, "bit") & ~holds(c, "state")
    forward, backward = path_counts(k)
    at = lambda counts, state: F.get(F.array(*[F.lit(x).cast("long") for x in counts]), state)
    out = walked.select(
        "part", "state", "filter",
        (at(forward, F.col("state")) * at(backward, F.col("state").bitwiseOR(F.col("bit")))).alias("orders"),
        total("n", lambda c: ~holds(c, "bit") & ~holds(c, "state")).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda c: holds(c, "bit") & holds(c, "state")).alias("redundant"),
        total("n", lambda c: c["mask"] == F.col("bit")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "filter"))).drop("orders")


def steps(edges_of: DataFrame, names: str, orders: Sequence[str]) -> DataFrame:
    """(part, filter_order, step, and the edge's figures) for each step of the given orders of the filters' names."""
    bit = {c: i for i, c in enumerate(names)}
    path = [(o, i + 1, sum(1 << bit[c] for c in o[:i]), bit[c]) for o in orders for i, c in enumerate(o)]
    # One row for each order and step asked for, so its size is the caller's list.
    wanted = edges_of.sparkSession.createDataFrame(path, "filter_order string, step int, _state int, _filter int")
    figures = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return edges_of.join(F.broadcast(wanted), (F.col("state") == F.col("_state")) & (F.col("filter") == F.col("_filter"))).select("part", "filter_order", "step", *figures)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = failures(evenly(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return steps(edges(masks, len(FILTERS)), FILTERS, ["".join(o) for o in itertools.permutations(FILTERS)])


_PLACE = "least({})".format(", ".join(f"CASE WHEN contains(fails, '{c}') THEN strpos(o, '{c}') ELSE 6 END" for c in FILTERS))
OP12_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INTEGER) AS good, max(coalesce(toxic = 1, false)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(ws) < {LEAST_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < {LEAST_VARIETY} * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '{MARKUP}') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails FROM w LEFT JOIN l USING (doc_id)),
h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
c AS (SELECT unnest(string_split('{FILTERS}', '')) AS c),
p AS (SELECT a.c || b.c || x.c || y.c || z.c AS o FROM c a JOIN c b ON b.c <> a.c JOIN c x ON x.c NOT IN (a.c, b.c) JOIN c y ON y.c NOT IN (a.c, b.c, x.c) JOIN c z ON z.c NOT IN (a.c, b.c, x.c, y.c)),
g AS (SELECT h.*, o, step, substr(o, step, 1) AS f, {_PLACE} AS place FROM h, p, (SELECT unnest(range(1, 6)) AS step)),
s AS (SELECT part, o AS filter_order, step::INTEGER AS step, f, coalesce(sum(n) FILTER (place > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (place = step), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (contains(fails, f) AND place < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (place = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (place = step), 0)::BIGINT AS toxic_lost FROM g GROUP BY part, o, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM s
"""
