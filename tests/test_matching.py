import functools
import random
import re

import pytest
from pyspark.sql import functions as F

from gleanery import dims
from gleanery.operators import matching

SURFACES = "unit_id long, location string, surface string, source string, text string"


def term(pattern, kind="LITERAL", severity="LOW", on=True, paths=True, strings=True, exact=False):
    return (pattern, kind, severity, "c", "", on, paths, strings, exact)


@functools.cache
def fold(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def places(text, t):
    """Overlapping places of a term, counted one by one."""
    low, needle = (text, t[0]) if t[8] else (fold(text), fold(t[0]))
    found, i = 0, low.find(needle)
    while i >= 0:
        if t[1] == "LITERAL":
            found += 1
        else:
            before, after = low[i - 1 : i] if i else "", low[i + len(needle) : i + len(needle) + 1]
            found += not re.match("[A-Za-z0-9_$]", before) and not re.match("[A-Za-z0-9_$]", after)
        i = low.find(needle, i + 1)
    return found


def brute(rows, terms):
    out = {}
    for unit, _, surface, _, text in rows:
        for t in set(terms):
            if t[0] and t[5] and t[1] != "REGEX" and text and t[6 if surface == "PATH" else 7] and not (t[1] == "WORD" and re.fullmatch("[A-Za-z0-9_$]+", t[0])):
                n = places(text, t)
                if n:
                    key = (unit, surface, t[0], t[1], t[2], t[8])
                    out[key] = out.get(key, 0) + n
    return out


def hits(spark, rows, terms):
    got = matching.match_literals(spark.createDataFrame(rows, SURFACES), spark.createDataFrame(terms, dims.TERMS))
    return sorted((r.unit_id, r.surface, r.pattern, r.kind, r.severity, r.hits) for r in got.collect())


def flat(found):
    return sorted((u, s, p, k, v, n) for (u, s, p, k, v, _), n in found.items())


ODD = [
    term(r"C:\Example"), term(r"\Q.\E+"), term(r"\E"), term("aa"), term("aaa", severity="HIGH"), term("É t", exact=True), term("é T"), term("foo-bar", "WORD"), term("foo bar", "WORD", exact=True), term("été", "WORD"), term("x"), term("."),
    term("😀b"), term("a\nb"), term("off", on=False), term("only.path", strings=False), term("only.text", paths=False), term("(["), term("foo-bar", "WORD"), term("w" * 60), term(""),
]
TEXTS = [
    r"see C:\EXAMPLE and C:\Example\E twice \E\E", r"\Q.\E+ x", "aaaaaaa A", "É t é t É T É t", "foo-bar foo-bars xfoo-bar FOO-BAR", "foo bar Foo bar foo bar2", "été étés l'été ÉTÉ", "a😀b😀😀B", "a\nb\na\nb", "only.path only.text off", "([([", "w" * 63, "", None, "x",
]


@pytest.mark.parametrize(("few", "part", "sent"), [(100, 32_768, 200_000), (0, 32_768, 200_000), (0, 3, 200_000), (0, 7, 0), (100, 2, 0)])
def test_odd_literals_are_brute_force(spark, monkeypatch, few, part, sent):
    """One by one, by grams, over parts of a few characters, and with a list that is not sent."""
    for name, value in (("FEW_LITERALS", few), ("PART", part), ("MOST_SENT", sent)):
        monkeypatch.setattr(matching, name, value)
    rows = [(i, "l", "PATH" if i % 2 else "STRING", "s", t) for i, t in enumerate(TEXTS * 2)]
    assert hits(spark, rows, ODD) == flat(brute(rows, ODD))


def test_fifty_thousand_literals_are_brute_force(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(12)] + ["ab" * 300]
    terms = {term(" ".join(rng.choice(words) for _ in range(2)), exact=rng.random() < 0.3) for _ in range(49_000)}
    terms |= {term(t[i : i + rng.randint(3, 30)]) for t in texts for i in rng.sample(range(500), 80)} | {term("abab"), term("ba" * 20)}
    rows = [(i, "l", "STRING", "s", t) for i, t in enumerate(texts)]
    want = brute(rows, list(terms))
    assert len(want) > 1500 and hits(spark, rows, sorted(terms)) == flat(want)


def test_literals_read_the_texts_once(spark, tmp_path):
    spark.createDataFrame([(i, "l", "STRING", "s", f"text {i} of some length") for i in range(50)], SURFACES).write.parquet(str(tmp_path / "t"))
    terms = spark.createDataFrame([term(f"text {i}") for i in range(200)], dims.TERMS)
    plan = matching.match_literals(spark.read.parquet(str(tmp_path / "t")), terms)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_broken_expressions_are_put_aside(spark):
    rows = [(1, "l", "STRING", "s", "abc abd xyz"), (2, "l", "STRING", "s", "nothing")]
    terms = [term("ab[cd]", "REGEX"), term("ab(", "REGEX", "HIGH"), term("*", "REGEX"), term("x.z", "REGEX", "CRITICAL"), term("a[", "REGEX", on=False), term("xyz"), term(r"\p{Nonsense}", "REGEX")]
    table = spark.createDataFrame(terms, dims.TERMS)
    got = sorted((r.unit_id, r.pattern, r.hits) for r in matching.match_terms(spark.createDataFrame(rows, SURFACES), table).collect())
    assert got == [(1, "ab[cd]", 2), (1, "x.z", 1), (1, "xyz", 1)]
    aside = {r.pattern: r for r in matching.quarantined(table).collect()}
    assert set(aside) == {"ab(", "*", r"\p{Nonsense}"} and aside["ab("].severity == "HIGH" and all(len(r.reason) > 10 for r in aside.values())
    assert matching.quarantined(table.where("kind = 'LITERAL'")).count() == 0
    only_broken = matching.match_terms(spark.createDataFrame(rows, SURFACES), table.where(F.col("pattern") == "*"))
    assert only_broken.count() == 0 and "hits" in only_broken.columns


@pytest.mark.parametrize(("part", "sent"), [(32_768, 200_000), (5, 0)])
def test_long_literals_are_met_by_their_pieces(spark, monkeypatch, part, sent):
    """Literals beyond one piece, periodic ones and words too; nothing of the texts but the characters around a gram is kept."""
    for name, value in (("FEW_LITERALS", 0), ("PART", part), ("MOST_SENT", sent)):
        monkeypatch.setattr(matching, name, value)
    terms = [term("ab" * 100), term("Ba" * 70 + "b", exact=True), term("x" * 64), term("x" * 65), term("x" * 128), term("x" * 129), term("long-" * 30, "WORD"), term("😀" * 80), term("x", "LITERAL", "HIGH"), term("A" + "b" * 127, exact=True)]
    texts = ["ab" * 300, "Ba" * 75 + "b", "x" * 200, "long-" * 30 + " " + "long-" * 30 + "a", "LONG-" * 30, "😀" * 90, "A" + "b" * 130, "a" + "b" * 130, "x", None, ""]
    rows = [(1, "l", "STRING", "s", t) for t in texts] + [(2, "l", "STRING", "s", texts[0])]
    assert hits(spark, rows, terms) == flat(brute(rows, terms))


def test_literals_meet_texts_without_moving_them(spark, monkeypatch):
    monkeypatch.setattr(matching, "MOST_SENT", 0)
    rows = [(i, "l", "STRING", "s", f"text {i} of some length " * 200) for i in range(50)]
    terms = spark.createDataFrame([term(f"text {i} of") for i in range(200)], dims.TERMS)
    plan = matching.match_literals(spark.createDataFrame(rows, SURFACES), terms)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "text#" in line and ("Exchange" in line or "Join" in line)] and "_around" in plan and plan.count("Scan ExistingRDD") <= 3
