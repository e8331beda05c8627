import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from gleanery import dims
from gleanery.functions import names as N
from gleanery.functions import text as T
from gleanery.operators import decode, joins, matching, scoring
from gleanery.sources import files, lists
from gleanery.streaming import screen

FINDING = dims.FINDINGS


def findings(spark, rows):
    return spark.createDataFrame([(u, i, t, s, src, "c", p, "l", "e", h) for i, (u, t, s, src, p, h) in enumerate(rows)], FINDING)


@pytest.mark.parametrize(("hits", "score"), [(1, 50), (2, 52), (11, 70), (12, 70)])
def test_score_grows_up_to_eleven_hits(spark, hits, score):
    folded = scoring.fold_findings(findings(spark, [(1, "t", "HIGH", "CONSTANT", "p", hits)]))
    assert scoring.unit_scores(folded).first().score == score


def test_folding_ignores_the_order(spark):
    rows = [(1, "t", "HIGH", "CONSTANT", "p", 2), (1, "t", "HIGH", "CONSTANT", "p", 3), (1, "u", "LOW", "ARCHIVE", None, 1)]
    table = findings(spark, rows)
    a, b = (sorted(map(tuple, scoring.fold_findings(t).collect()), key=str) for t in (table, table.orderBy(F.desc("seq"))))
    assert a == b and len(a) == 2


@pytest.mark.parametrize(("found", "unit", "want"), [
    ([], dict(outcome="UNREADABLE"), "UNREADABLE"),
    ([("HIGH", "CONSTANT", "p")], dict(encrypted=True), "CRITICAL"),
    ([("HIGH", "CONSTANT", "p")], {}, "DETECTED"),
    ([("CRITICAL", "FILE_NAME", "p")], {}, "DETECTED"),
    ([("HIGH", "FILE_NAME", "p")], {}, "NOTABLE"),
    ([("CRITICAL", "ARCHIVE", None)], {}, "NOTABLE"),
    ([], dict(broken=True), "SUSPICIOUS"),
    ([], dict(read=3, unreadable=1), "CLEAN"),
    ([], dict(read=2, unreadable=1), "SUSPICIOUS"),
    ([("LOW", "CONSTANT", "p")], {}, "NOTABLE"),
    ([], {}, "CLEAN"),
])
def test_verdict_cascade(spark, found, unit, want):
    unit = dict(unit_id=1, outcome="POOL_SCANNED", obfuscated=False, encrypted=False, broken=False, read=1, unreadable=0) | unit
    scores = scoring.unit_scores(scoring.fold_findings(findings(spark, [(1, f"t{i}", s, src, p, 1) for i, (s, src, p) in enumerate(found)])))
    assert scoring.decide(spark.createDataFrame([unit]), scores).first().verdict == want


def test_names(spark):
    rows = ["Illl1", "a", "<init>", "Kill​Aura", "Kаt", "Привет", "ığüş", "x.class"]
    table = spark.createDataFrame([(r,) for r in rows], "name string")
    name = F.col("name")
    got = table.select(N.is_barcode(name), N.is_short(name), N.has_invisible(name), N.is_deceptive(name)).collect()
    assert [tuple(r) for r in got] == [(True, False, False, False), (False, True, False, False), (False, False, False, False), (False, False, True, True), (False, False, False, True), (False, False, False, False), (False, False, False, False), (False, False, False, False)]


def test_words_and_places(spark):
    surfaces = spark.createDataFrame([(1, "l", "STRING", "CONSTANT", "foo FOO foo_bar xfoo foo$ Ätion étion étion aXa Hello World aaaa")], "unit_id long, location string, surface string, source string, text string")
    term = lambda p, kind, cs=False: (p, kind, "LOW", "c", "", True, True, True, cs)
    terms = spark.createDataFrame([term("foo", "WORD"), term("FOO", "WORD", True), term("hello world", "WORD"), term("étion", "LITERAL"), term("aa", "LITERAL"), term("o+", "REGEX")], dims.TERMS)
    got = {(r.pattern): r.hits for r in matching.match_terms(surfaces, terms).collect()}
    assert got == {"foo": 2, "FOO": 1, "hello world": 1, "étion": 2, "aa": 3, "o+": 9}


def test_text_functions(spark):
    row = spark.createDataFrame([('"a b" -javaagent:/x/y.jar=opt c', "Main-Class:  a.B \nX: \n", "fooXfooxFOO")], "cmd string, manifest string, text string")
    got = row.select(T.command_words(F.col("cmd")).alias("w"), T.agent_paths(T.command_words(F.col("cmd"))).alias("a"), T.manifest_value(F.col("manifest"), "main-class").alias("m"), T.manifest_value(F.col("manifest"), "X").alias("x"), T.find_all(F.col("text"), "foo").alias("f"), T.context_window(F.lit("a" * 300), F.lit(150), F.lit(3)).alias("c")).first()
    assert got.w == ["a b", "-javaagent:/x/y.jar=opt", "c"] and got.a == ["/x/y.jar"] and got.m == "a.B" and got.x is None
    assert [tuple(s) for s in got.f] == [(0, 3), (4, 7), (8, 11)] and got.c.startswith("...") and got.c.endswith("...") and len(got.c) == 169


def test_decoding(spark):
    rows = spark.createDataFrame([(1, "SGVsbG8gV29ybGQh"), (2, "not base64 at all")], "unit_id long, text string")
    assert [r[0] for r in rows.select(decode.whole_base64(F.col("text"))).collect()] == ["Hello World!", None]
    hidden = rows.where("unit_id = 1").select("unit_id", decode._chars(F.lit("plain words"), lambda c, i: c.bitwiseXOR((F.lit(190) + i).bitwiseAND(F.lit(255)))).alias("text"))
    found = decode.with_keys(hidden, range(1, 256), decode.CHANGES["xor by place"])
    assert found.count() == 1 and found.where("key <= 190").count() == 1


def test_entries_of_one_pattern(spark):
    surfaces = spark.createDataFrame([(1, "l", "STRING", "CONSTANT", "foo foo Foo \u00c9tude \u00c9TUDE"), (2, "p", "PATH", "ENTRY_PATH", "foo")], "unit_id long, location string, surface string, source string, text string")
    term = lambda p, severity, on=True, cs=False, paths=False: (p, "WORD", severity, "c", "", on, paths, True, cs)
    terms = spark.createDataFrame([term("foo", "LOW"), term("foo", "LOW"), term("Foo", "HIGH", cs=True), term("FOO", "CRITICAL", on=False), term("foo", "MEDIUM", paths=True)], dims.TERMS)
    got = sorted((r.unit_id, r.pattern, r.severity, r.hits) for r in matching.match_words(surfaces, terms).collect())
    want = [(1, "Foo", "HIGH", 1), (1, "foo", "LOW", 3), (1, "foo", "MEDIUM", 3), (2, "foo", "MEDIUM", 1)]
    assert got == want
    most, matching.MOST_SENT = matching.MOST_SENT, 2
    try:
        assert sorted((r.unit_id, r.pattern, r.severity, r.hits) for r in matching.match_words(surfaces, terms).collect()) == want
    finally:
        matching.MOST_SENT = most
    assert [(r.keyword, r.hits) for r in matching.risk_keywords(surfaces, {"\u00c9tude": "HIGH"}).collect()] == [("\u00c9tude", 2)]


def test_markers_and_assets(spark):
    rows = spark.createDataFrame([(1, "made by ALLATORI"), (1, "zelix"), (2, "pro"), (3, "x" * 201 + "proguard")], "unit_id long, text string")
    assert sorted(map(tuple, matching.markers(rows).collect())) == [(1, "Allatori"), (1, "Zelix KlassMaster")]
    hits = spark.createDataFrame([("a/b.class", "see textures/x.png"), ("a/b.class", "code"), ("x/lang/de.json", "code"), ("assets/ForcefieldModule.class", None)], "location string, excerpt string")
    assert [r.location for r in matching.without_assets(hits, "excerpt").collect()] == ["a/b.class", "assets/ForcefieldModule.class"]


def test_places_of_words(spark):
    paths = ["C:/x/y.jar", "C:\\x\\y.jar", "\\\\srv\\a.jar", "-C:/x.jar", "C:/a$b.jar", "C:/a&b.jar", "C:/a'b.jar", "C:/a`b.jar", "/unix/x.jar", "C:/no/extension", "C:/d.ir/file", "C:/x.", "a.jar", "C:/a.b"]
    table = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.p for r in table.where(N.is_plausible_path(F.col("p"))).collect()] == [paths[0], paths[1], paths[2], paths[-1]]
    assert table.limit(1).select(T.agent_paths(F.array(F.lit("-JavaAgent:C:/a.jar=x"), F.lit("-agentpath:/b"), F.lit("x"))).alias("a")).first().a == ["C:/a.jar", "/b"]


def test_entropy_within_the_row(spark):
    texts = ["", None, "aaaa", "abcd", "\u00e9\u00e8 caf\u00e9 \u4e2d\u6587 \U0001F600\U0001F601", "x" * 5000 + "y"]
    table = spark.createDataFrame(list(enumerate(texts)), "unit_id long, text string")

    def bits(values):
        return -sum(values.count(v) / len(values) * math.log2(values.count(v) / len(values)) for v in set(values))

    got = {r.unit_id: (r.units, r.entropy) for r in scoring.text_entropy(table, "unit_id", "text").collect()}
    for i, t in enumerate(texts):
        if t:
            low = list(t.encode("utf-16-be")[1::2])
            assert got[i][0] == len(low) and abs(got[i][1] - bits(low)) < 1e-9
    assert set(got) == {2, 3, 4, 5}
    facts = {r.unit_id: r for r in scoring.byte_facts(table.select("unit_id", F.encode("text", "UTF-8").alias("content")), "unit_id", "content").collect()}
    for i, t in enumerate(texts):
        if t:
            b = list(t.encode())
            assert (facts[i].bytes, facts[i].distinct_bytes, facts[i].uniform) == (len(b), len(set(b)), len(set(b)) == 1) and abs(facts[i].entropy - bits(b)) < 1e-9


def test_paths_leave_out_cycles(spark):
    nodes = spark.createDataFrame([(1, 1, "r"), (2, 1, "a"), (3, 2, "b"), (4, 5, "x"), (5, 4, "y"), (6, 99, "z")], "id long, parent_id long, name string")
    assert {r.id: r.path for r in joins.full_paths(nodes).collect()} == {1: "r", 2: "r/a", 3: "r/a/b"}


def test_archives(spark, tmp_path):
    def archive(entries):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in entries:
                z.writestr(name, data)
        return out.getvalue()

    deep = archive([("c.txt", "deep")])
    for name in ("l3.jar", "l2.jar", "l1.jar"):
        deep = archive([(name, deep)])
    good = archive([("META-INF/MANIFEST.MF", "Main-Class: A\n"), ("a.txt", "text " * 300), ("run.bat", "x")])
    for name, data in (("good.jar", good), ("hidden.dll", good + b" " * 1100), ("bad.jar", b"nothing here"), ("nested.jar", deep)):
        (tmp_path / name).write_bytes(data)
    found = files.scan_files(spark, str(tmp_path), content=True)
    assert files.by_extension(found).count() == 3
    assert sorted(map(tuple, files.disguised(found).select("name", "length").collect())) == [("hidden.dll", len(good) + 1100)]
    entries = files.explode_archives(found).cache()
    assert entries.where("error IS NOT NULL").select("path").distinct().count() == 1
    assert entries.where("path LIKE '%nested.jar'").agg(F.max("depth")).first()[0] == 2
    assert files.text_surfaces(entries).where("text LIKE 'text%'").count() == 2


def test_lists_and_reports(spark, tmp_path):
    terms = dims.sample_terms(spark)
    lists.write_terms(terms, str(tmp_path / "terms"))
    assert sorted(map(tuple, lists.read_terms(spark, str(tmp_path / "terms")).collect())) == sorted(map(tuple, terms.collect()))
    (tmp_path / "broken.json").write_text("[{oops")
    assert lists.read_terms(spark, str(tmp_path / "broken.json")).count() == terms.count()
    verdicts = spark.createDataFrame([(1, 50, "DETECTED"), (2, 0, "CLEAN")], "unit_id long, score long, verdict string")
    lists.write_report_json(verdicts, findings(spark, [(1, "t", "HIGH", "CONSTANT", "p", 1)]), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/units")).where("size(findings) = 1").count() == 1
    assert lists.report_text(verdicts).first().value.startswith("Unit: 1\nVerdict: DETECTED")


def test_stream_finds_what_a_batch_finds(spark, tmp_path):
    rows = [(i, "l", "STRING", "CONSTANT", "foo bar" if i % 2 else "bar") for i in range(20)]
    surfaces = spark.createDataFrame(rows, "unit_id long, location string, surface string, source string, text string")
    surfaces.repartition(5).write.parquet(str(tmp_path / "in"))
    terms = spark.createDataFrame([("foo", "WORD", "LOW", "c", "", True, True, True, False)], dims.TERMS)
    stream = screen.arriving(spark, str(tmp_path / "in"), surfaces.schema, 2)
    screen.screen_stream(stream, lambda batch: matching.match_words(batch, terms), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == matching.match_words(surfaces, terms).count() == 10
