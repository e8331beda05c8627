import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, `_id` string, `_row` string, ids string, label string, node string, path string"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["th", "an", "er", "ou", "st", "ing", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus():
    """Copies, near copies, junk, long, empty and null texts, ties, repeated rows and null columns."""
    rng = random.Random(7)
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(sentence(rng, rng.randint(20, 40)) for _ in range(rng.randint(2, 4))), "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None))
    base = rows[5][1].split(" ")
    for k in range(12):
        words = list(base)
        words[rng.randrange(len(words))] = f"edit{k}"
        rows.append((100 + k, " ".join(words), "en", "s1"))
    rows += [(200 + k, rows[7][1], "en", "s2") for k in range(8)]
    rows += [(300, None, "en", "s1"), (301, "", "en", "s1"), (302, " \t\n ", None, None), (303, "one", "en", "s1"), (304, "ONE", "en", "s1"), (305, "a b c", "en", "s0")]
    rows += [(310, sentence(rng, 20_000), "en", "s1"), (311, "*** $$$ %%% " * 60, "en", "s1"), (312, "the same line of words again\n" * 30, "en", "s2")]
    rows += [(None, sentence(rng, 60), None, None), (None, None, None, None), rows[3], rows[3]]
    rows += [(320, "a line of more than twenty characters here\nanother one", "en", "s0"), (321, "a line of more than twenty characters hers\nanother one", "en", "s0"), (322, "a line of more than twenty character here", "en", "s0")]
    return [(*r, len(r[1] or ""), "x", "y", "z", "r", "i", "l", "n", "p") for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
