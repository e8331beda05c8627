import duckdb
import numpy as np
import pandas as pd
import pytest

from gleanery.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list:
    plain = lambda v: round(v, 6) if isinstance(v, float) else list(v) if isinstance(v, np.ndarray) else v
    frame = frame[sorted(frame.columns)].map(plain)
    return sorted(map(tuple, frame.astype(str).replace({"None": "nan", "<NA>": "nan", "NaT": "nan"}).to_numpy()))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_is_sql(spark, con, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.SQL:
        want = con.sql(registry.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def printable(text):
    return sum(32 <= ord(c) <= 126 or c in "\n\r\t" for c in text) > 0.85 * len(text)


def test_hidden_names_are_found_again(spark):
    """Brute force over all keys: the lowest one that makes a hidden name readable."""
    names = {r.c_custkey: r.c_name for r in spark.read.parquet(f"{DATA}/customer.parquet").collect()}
    got = {r.unit_id: (r.key, r.decoded) for r in registry.QUERIES["xor_keys"](spark, DATA).collect()}
    under = lambda text, key: "".join(chr(ord(c) ^ key) for c in text)
    hidden = {i: under(name, 200) for i, name in names.items()}
    want = {i: next((k, under(text, k)) for k in range(1, 256) if printable(under(text, k))) for i, text in hidden.items()}
    assert got == want and all(k <= 200 for k, _ in want.values())


def test_repeating_keys_are_brute_force(spark):
    names = {r.c_custkey: r.c_name for r in spark.read.parquet(f"{DATA}/customer.parquet").collect()}
    got = {r.unit_id: (r.size, r.decoded) for r in registry.QUERIES["repeating_keys"](spark, DATA).collect()}
    want = {}
    for i, name in names.items():
        text = [ord(c) ^ (201, 150, 230)[k % 3] for k, c in enumerate(name)]
        for size in range(2, 9):
            if len(text) < 2 * size:
                continue
            hits = [[sum(32 <= c ^ k <= 126 for c in text[p::size]) for k in range(256)] for p in range(size)]
            key = [h.index(max(h)) for h in hits]
            decoded = "".join(chr(c ^ key[k % size]) for k, c in enumerate(text))
            if all(key) and printable(decoded):
                want[i] = (size, decoded)
                break
    assert got == want and want


def test_paths_need_few_scans(spark, monkeypatch):
    """Each round reads the checkpoint before it, so no plan holds more than two scans."""
    from gleanery import settled
    from gleanery.operators import joins

    scans = []
    true = settled.settled

    def counted(df):
        scans.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return true(df)

    monkeypatch.setattr(joins, "settled", counted)
    chain = spark.createDataFrame([(i, max(0, i - 1), f"n{i}") for i in range(200)], "id long, parent_id long, name string")
    assert joins.full_paths(chain).count() == 200
    assert 8 <= len(scans) <= 10 and max(scans) <= 2
