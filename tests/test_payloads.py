import base64
import codecs

import duckdb
from pyspark.sql import functions as F

from gleanery.operators import decode
from gleanery.plans import registry


def test_base64_payloads_are_python_s(spark, tmp_path):
    payloads = [bytes((i * 7 + k) % 256 for k in range(n)) for i, n in enumerate(range(15, 75))]
    rows = [(i, f"before {base64.b64encode(p).decode()} after") for i, p in enumerate(payloads)]
    spark.createDataFrame([*rows, (900, None), (901, "no run here")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.unit_id: bytes.fromhex(r.content) for r in registry.QUERIES["base64_payloads"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(payloads))
    view = f"(SELECT * FROM '{tmp_path}/documents.parquet/*.parquet')"
    want = duckdb.connect().sql(registry.SQL["base64_payloads"].replace("FROM documents", f"FROM {view}")).fetchall()
    assert {(i, bytes.fromhex(c)) for i, _, c in want} == set(got.items())


def test_long_texts_are_whole(spark, tmp_path):
    text = "Every letter of a long text counts " * 40
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = registry.QUERIES["whole_ciphers"](spark, str(tmp_path)).first()
    assert got.reversed == text[::-1] and got.rotated == codecs.encode(text, "rot13") and len(got.mirrored) == len(got.swapped) == len(text)
    turns = [(1, k, "user", c * 600_000) for k, c in enumerate("abc")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert registry.QUERIES["joined_texts"](spark, str(tmp_path)).first().text == "\n".join(t[3] for t in turns)
    assert registry.QUERIES["whole_literal_sample"](spark, str(tmp_path)).first().chars == 120_000


def test_encodings_of_documents(spark):
    keyed = lambda k, tail=b"": bytes(b ^ k for b in b"\xca\xfe\xba\xbe") + tail
    cases = [
        (None, None), (b"", "plain"), (b"  \n", "plain"), (b"some plain words, as they come", "plain"), (b"abc", "plain"),
        (base64.b64encode(b"hello world"), "base64"), (b" aGVsbG8g\r\nd29ybGQ= \n", "plain"), (b" aGVsbG8g\t\td29ybG\n\nQ=\n", "base64"),
        (b"use the lids", "plain"), (b"=abc", "plain"), (b"ab==", "base64"), (b"a===", "base64"),
        (keyed(65), "xor"), (keyed(1, b"tail"), "xor"), (keyed(127, b"x" * 3000), "xor"), (keyed(0), "binary"), (keyed(128), "xor"), (keyed(255), "xor"),
        (base64.b64encode(keyed(65, b"\x01\x02")), "base64+xor"), (base64.b64encode(keyed(65, b"class x")), "base64"), (base64.b64encode(keyed(0)), "base64"),
        (bytes(range(128, 256)), "binary"), (b"a" * 1024 + b"\x00" * 9000 + b"!", "plain"), ("é".encode() + b"abcd", "plain"), ("é".encode() + b"abc", "binary"),
    ]
    rows = spark.createDataFrame(list(enumerate(c for c, _ in cases)), "id int, content binary")
    got = {r.id: r.kind for r in rows.select("id", decode.encoding_class(F.col("content")).alias("kind")).collect()}
    assert got == dict(enumerate(k for _, k in cases))


def test_texts_without_characters_have_no_share(spark, tmp_path):
    texts = [None, "", "plain", "a" * 17 + "é" * 3, "a" * 171 + "é" * 29, "é" * 41]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in registry.QUERIES["readability"](spark, str(tmp_path)).collect())
    assert [r[2] for r in got] == [None, None, True, False, True, False]
    view = f"(SELECT * FROM '{tmp_path}/documents.parquet/*.parquet')"
    assert got == sorted(duckdb.connect().sql(registry.SQL["readability"].replace("FROM documents", f"FROM {view}")).fetchall())
