import base64
import random

import pytest
from pyspark.sql import functions as F

from gleanery.functions.names import magic_kind
from gleanery.operators import decode
from gleanery.plans import registry

DATA = "/root/testdata/sf0.001"
BRUTE = {
    "xor": lambda c, i, k: c ^ k, "shift": lambda c, i, k: (c - k) % 256, "xor by place": lambda c, i, k: c ^ (k + i) % 256, "xor by product": lambda c, i, k: c ^ k * (i + 1) % 256,
    "shift by place": lambda c, i, k: (c - k - i) % 256, "xor less place": lambda c, i, k: ((c ^ k) - i) % 256, "xor then shift": lambda c, i, k: ((c ^ k) + k) % 256,
    "bit shift": lambda c, i, k: (c >> k // 2 if k % 2 else c << k // 2) % 256,
}


def lowest(codes, keys, change):
    for k in keys:
        shown = [change(c, i, k) for i, c in enumerate(codes)]
        if 100 * sum(32 <= c <= 126 or c in (9, 10, 13) for c in shown) > 85 * len(codes):
            return k, "".join(map(chr, shown))
    return None


@pytest.mark.parametrize("form", sorted(BRUTE))
def test_keys_are_brute_force(spark, form):
    """Also for texts with characters beyond 65535, which were cut before."""
    rng = random.Random(form)
    texts = ["".join(chr(ord(rng.choice("the quick brown fox 0123")) ^ rng.choice((200, 200, 77))) for _ in range(rng.randint(1, 40))) for _ in range(80)]
    texts += ["".join(chr(ord(c) ^ 150) for c in "plain words go on and on") + "\U0001f600", "plain", "", None, "é" * 501, "日本語", "é" * 500]
    rows = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "unit_id long, text string")
    keys = decode.BIT_SHIFTS if form == "bit shift" else range(1, 256)
    want = {i: f for i, t in enumerate(texts) if t and len(t) <= 500 and not t.isascii() and (f := lowest([*map(ord, t)], keys, BRUTE[form]))}
    got = decode.with_keys(rows, keys, decode.CHANGES[form]).collect()
    assert {r.unit_id: (r.key, r.decoded) for r in got} == want and len(got) == len(want) + (0 in want)
    assert decode.with_keys(rows.where("false"), keys, decode.CHANGES[form]).count() == 0


def test_base64_keys_are_brute_force(spark):
    rng = random.Random(3)
    contents = [bytes(ord(c) ^ (90 + (i if n % 2 else 0)) & 255 for i, c in enumerate("some hidden words, moved " * rng.randint(1, 9))) for n in range(12)] + [rng.randbytes(n) for n in range(40)]
    texts = [base64.b64encode(c).decode().rstrip("=") for c in contents]
    got = decode.base64_then_xor(spark.createDataFrame([*enumerate(texts), (900, None), (901, "no base64!")], "unit_id long, text string"))
    want = {}
    for n, (content, text) in enumerate(zip(contents, texts, strict=True)):
        found = [(f[0], by_place, f[1]) for by_place, form in ((False, "xor"), (True, "xor by place")) if len(text) >= 8 and len(content) > 1 and (f := lowest(content, range(1, 256), BRUTE[form]))]
        if found:
            want[n] = found[0]
    assert {r.unit_id: (r.key, r.by_place, r.decoded) for r in got.collect()} == want and {p for _, p, _ in want.values()} == {False, True}


@pytest.mark.parametrize("name", ["hidden_forms", "xor_keys", "shifted_bits", "product_keys", "base64_keys"])
def test_hidden_names_are_dealt_out(spark, name):
    """The search is shared by all cores, also where the names lie in one small file, and no lambda tries the keys."""
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan and "sequence(" not in plan


def test_repeating_keys_stay_in_the_row(spark):
    """No row for each code and key, and a place whose codes rule out each of the best 32 keys."""
    text = "".join(chr(128 + c) if i % 2 else chr(200 ^ ord("e")) for c in range(32, 64) for i in range(2))
    got = decode.repeating_key(spark.createDataFrame([(1, text), (2, None)], "unit_id long, text string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 3 and "sum(" not in plan and "max_by" not in plan
    codes = [ord(c) for c in text]
    key = [max(range(256), key=lambda k, p=p: (sum(32 <= c ^ k <= 126 for c in codes[p::2]), -k)) for p in range(2)]
    assert [(r.size, r.decoded) for r in got.collect()] == [(2, "".join(chr(c ^ key[i % 2]) for i, c in enumerate(codes)))]


def test_best_key_is_brute_force(spark):
    rng = random.Random(8)
    groups = [[rng.choice((rng.randrange(256), rng.randrange(160, 192), rng.randrange(400))) for _ in range(rng.randint(1, 60))] for _ in range(150)] + [[*range(0, 256)], [*range(128, 256)], [*range(96, 128)], [300], [255, 127]]
    got = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "i int, codes array<int>").select("i", decode._best_key(F.col("codes")).alias("k")).collect()
    assert {r.i: r.k for r in got} == {i: max(range(256), key=lambda k, g=g: (sum(32 <= c ^ k <= 126 for c in g), -k)) for i, g in enumerate(groups)}


def test_a_word_is_no_archive(spark):
    """A text that begins with Rar is none; the format's first bytes are four."""
    heads = [b"Rare ", b"Rar!\x1a\x07", b"Rar", b"\x89PNG\r"]
    rows = spark.createDataFrame([*enumerate(heads)], "i int, c binary").select("i", magic_kind(F.hex(F.substring("c", 1, 4))).alias("k"))
    assert {r.i: r.k for r in rows.collect()} == {0: None, 1: "rar", 2: None, 3: "png"}
