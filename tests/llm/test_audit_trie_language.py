import itertools
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanery.llm import filteraudit, langcrf, prefixtrie


def plain(frame):
    """Rows as a multiset, by sorted column names, with nulls alike."""
    frame = frame[sorted(frame.columns)].astype(object)
    return Counter(tuple(None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, (float, np.integer)) else v for v in r) for r in frame.to_numpy())


# Filter audit


def test_path_counts_are_factorials():
    for k in (1, 3, 5):
        forward, backward = filteraudit.path_counts(k)
        assert forward == [math.factorial(s.bit_count()) for s in range(1 << k)]
        assert backward == [math.factorial(k - s.bit_count()) for s in range(1 << k)]


def audit_rows(rows):
    rng = random.Random(12)
    more = [(i, t, "en", s) for i, t, s in [(400, "SHOUTED " * 260, None), (401, "a b " * 150, "s1"), (402, "a b " * 150, "s2"), (399, "a b " * 150, ""), (403, "x # y", "s1"), (None, "a b " * 150, "s1"), (404, "", None), (405, None, "s1")]]
    docs = [r[:4] for r in rows] + more
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for r in docs if rng.random() < 0.7]
    return docs, labels + labels[:5] + [(401, 0, 1), (401, 1, 0), (None, 1, 1), (9999, 1, 1)]


def test_filter_audit_is_sql(spark, rows):
    docs, labels = audit_rows(rows)
    table = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, lang string, source string, mask string")
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, digest string")
    orders = ["".join(o) for o in itertools.permutations(filteraudit.FILTERS)]
    got = filteraudit.steps(filteraudit.edges(filteraudit.failures(table, marks), 5), filteraudit.FILTERS, orders).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"}))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    want = con.execute(filteraudit.OP12_SQL).df()
    assert plain(got) == plain(want) and len(got) == 600 * len({r[3] or "" for r in docs})
    empty = filteraudit.failures(table.where("false"), marks)
    assert filteraudit.steps(filteraudit.edges(empty, 5), filteraudit.FILTERS, orders).count() == 0


def test_filter_audit_is_brute_force(spark):
    """Any number of filters: documents taken out one order after another."""
    rng, k, names = random.Random(3), 3, "XYZ"
    docs = [(rng.choice("pq"), rng.randrange(1 << k), int(rng.random() < 0.5), int(rng.random() < 0.2)) for _ in range(200)]
    orders = ["".join(o) for o in itertools.permutations(names)]
    want, removals = {}, defaultdict(int)
    for part, order in itertools.product("pq", orders):
        left, gone = [d for d in docs if d[0] == part], []
        for step, name in enumerate(order):
            bit = 1 << names.index(name)
            out = [d for d in left if d[1] & bit]
            want[part, order, step + 1] = [len(left) - len(out), len(out), sum(bool(d[1] & bit) for d in gone), sum(d[1] == bit for d in docs if d[0] == part), sum(d[2] for d in out), sum(d[3] for d in out)]
            removals[part, name] += len(out)
            left, gone = [d for d in left if not d[1] & bit], gone + out
    got = filteraudit.steps(filteraudit.edges(spark.createDataFrame(docs, "part string, mask int, good int, toxic int"), k), names, orders).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] for r in got} == want
    assert all(r.shapley == removals[r.part, r.filter_order[r.step - 1]] for r in got)


# Prefix tries


@pytest.mark.parametrize("seed", range(4))
def test_double_array_holds_its_paths_alone(seed):
    rng = random.Random(seed)
    paths = {tuple(rng.randint(1, 4 if seed else 300) for _ in range(rng.randint(1, 7))) for _ in range(200)}
    trie = prefixtrie.DoubleArray([np.array(p) for p in paths])
    known = {p[:i] for p in paths for i in range(len(p) + 1)}
    place = {(): 0}
    for p in sorted(known, key=len):
        for x in range(1, 302):
            to = int(trie.step(np.array([place[p]]), np.array([x]))[0])
            assert (to >= 0) == ((*p, x) in known)
            if to >= 0:
                place[(*p, x)] = to
    assert len(set(place.values())) == len(known) == int((trie.check >= 0).sum())


def talks():
    """Hosts that are short or absent, null fields, ties, repeated rows, copies, long and turnless conversations."""
    rng, rows = random.Random(13), []
    turn = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["hello there", "a  b\tc", "", None, "one two three four", "é ü"]))
    for c in [*range(0, 130), *range(140, 175), 200, 201, -3, -20, -25, 5_000_003]:
        for t in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            rows.append((c, t if rng.random() < 0.95 else None, *turn()))
    rows += [(c, t, "user", f"shared {t}") for c in range(220, 300) for t in range(6)]
    rows += [(400, t, "user", f"long {t}") for t in range(150)] + [(421, t, "user", f"long {t}") for t in range(150)]
    rows += [(300, 1, "user", "tie"), (300, 1, "user", "tie"), (300, 1, None, "tie"), (None, 0, "user", "nobody"), (60, 0, "user", "x" * 5000)]
    return rows


@pytest.mark.parametrize(("heavy", "shard_turns"), [(prefixtrie.HEAVY, prefixtrie.SHARD_TURNS), (1, 3), (5, 40)])
def test_prefix_trie_is_sql(spark, heavy, shard_turns):
    rows = talks()
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, depth string, path string").repartition(5)
    got = prefixtrie.trie_nodes(*prefixtrie.rebuilt(table), heavy, shard_turns).toPandas()
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    assert plain(got) == plain(con.execute(prefixtrie.OP13_SQL).df())
    assert got.n_convs.max() == len({r[0] for r in rows if r[0] is not None})


def test_prefix_trie_of_nothing(spark):
    table = spark.createDataFrame([(None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefixtrie.trie_nodes(*prefixtrie.rebuilt(table)).count() == 0


# Languages


def model_of(rng, k, scale=1.0):
    model = langcrf.Model([f"l{i}" for i in range(k)], {})
    model.moves, model.start = rng.normal(0, scale, (k, k)), rng.normal(0, scale, k)
    return model


def test_chain_is_enumeration():
    rng = np.random.default_rng(1)
    model, starts = model_of(rng, 3), np.array([0, 4, 5])
    evidence = rng.normal(0, 2, (10, 3))
    want = np.zeros((10, 3))
    for s, e in zip(starts, [4, 5, 10], strict=True):
        for path in itertools.product(range(3), repeat=e - s):
            weight = np.exp(model.start[path[0]] + sum(evidence[s + i, x] for i, x in enumerate(path)) + sum(model.moves[a, b] for a, b in itertools.pairwise(path)))
            for i, x in enumerate(path):
                want[s + i, x] += weight
    assert np.allclose(langcrf.chain(evidence, starts, model), want / want.sum(axis=1, keepdims=True))


@pytest.mark.parametrize("piece", [1, 3, 64])
def test_chain_in_pieces_is_the_whole_chain(piece, monkeypatch):
    """Also where nothing but transitions speaks, so that messages travel far."""
    rng = np.random.default_rng(2)
    model, starts = model_of(rng, 4, 3.0), np.array([0, 1, 7, 400])
    evidence = rng.normal(0, 1, (600, 4))
    evidence[50:350] = 0
    monkeypatch.setattr(langcrf, "PIECE", 10_000)
    whole = langcrf.chain(evidence, starts, model)
    monkeypatch.setattr(langcrf, "PIECE", piece)
    assert np.allclose(langcrf.chain(evidence, starts, model), whole, atol=1e-7)


def test_gradients_are_slopes():
    rng = np.random.default_rng(3)
    model, evidence, labels = model_of(rng, 3), rng.normal(0, 1, (2, 5, 3)), rng.integers(0, 3, (2, 5))
    _, by_word, by_move, by_start = langcrf.gradients(model, evidence, labels)
    for array, grad in ((evidence, by_word), (model.moves, by_move), (model.start, by_start)):
        for at in np.ndindex(array.shape):
            array[at] += 1e-5
            up = langcrf.gradients(model, evidence, labels)[0]
            array[at] -= 2e-5
            down = langcrf.gradients(model, evidence, labels)[0]
            array[at] += 1e-5
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-4


def test_features_are_those_of_each_word_alone():
    words = ["a", "über", "straßenbahn", "日本語", "x" * 32]
    found, sizes = langcrf.features(words)
    parts = np.split(found, np.cumsum(sizes)[:-1])
    for w, part in zip(words, parts, strict=True):
        alone, n = langcrf.features([w])
        marked = len(w) + 2
        assert sorted(part) == sorted(alone) and n[0] == len(w) + (marked - 1) + max(marked - 2, 0) + sum((marked >= k) + (marked > k) for k in (4, 5))


PARTS = {"aa": ["kal", "mor", "tik"], "bb": ["zhu", "xan", "qio"], "cc": ["ell", "eau", "oux"]}


def talk(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_of_switching_texts(spark):
    rng = random.Random(4)
    rows = [(i, talk(rng, lang := "abc"[i % 3] * 2, rng.randint(5, 80)), lang) for i in range(300)]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 ## 4", "bb"), (None, talk(rng, "cc", 40), None), (1004, (talk(rng, "bb", 60) + " ") * 3 + talk(rng, "aa", 20), None), (1005, talk(rng, "aa", 30_000), "zz"), rows[0], (1006, "x" * 3000, None)]
    table = spark.createDataFrame([(*r, "s", "e") for r in rows + odd], "doc_id long, text string, lang string, source string, lang_pred string")
    got = {r.doc_id: r for r in langcrf.languages(table).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert 30 < len(held) < 100 and all(got[r[0]].lang_pred == r[2] for r in held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, None, 1004)] == ["und", "und", "und", "cc", "bb"]
    assert got[1000].score == 0 and all(0 <= r.score <= 1 for r in got.values()) and got[1004].score < 0.95 and not got[None].held_out
    texts, langs = langcrf.labelled_sample(table)
    assert len(texts) == len(set(texts)) and rows[0][1] not in texts or not got[0].held_out
    model = langcrf.fit(texts, langs)
    switch = [(1, talk(rng, "aa", 15) + " 77 " + talk(rng, "bb", 12) + " -- " + talk(rng, "cc", 9)), (2, None), (3, "5")]
    spans = {r.doc_id: r.spans for r in langcrf.spans(spark.createDataFrame(switch, "doc_id long, text string"), model).collect()}
    assert [(s["lang"], s["first"], s["last"]) for s in spans[1]] == [("aa", 0, 14), ("bb", 16, 27), ("cc", 29, 37)] and spans[2] == spans[3] == []
    none = langcrf.languages(table.where("doc_id IN (1000, 1002)")).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)] * 2
    assert langcrf.languages(table.where("false")).count() == 0


def test_languages_of_held_out_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langcrf.languages(table).where("held_out").join(table.select("doc_id", "lang"), "doc_id")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 150 and right >= 0.98 * n
