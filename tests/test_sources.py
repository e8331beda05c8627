import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from gleanery import dims
from gleanery.functions import names as N
from gleanery.operators import decode, joins, matching, rules, scoring
from gleanery.sources import files, lists, probe


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_probing_reads_a_few_bytes_and_finds_what_loading_finds(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "text " * 400)
    good = out.getvalue()
    cases = {"hidden.dll": good + b" " * 200, "late.bin": b"x" * 500_000 + good, "named.jar": good, "small.dat": b"PK\x03\x04" + b"." * 500, "plain.txt": b"nothing " * 9000, "empty": b"", "deep/er/behind.so": good, "deep/far.bin": good + b"z" * 2000}
    for name, data in cases.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    probed = probe.probe_files(spark, str(tmp_path)).cache()
    loaded = files.scan_files(spark, str(tmp_path), content=True)
    found = lambda df: sorted(map(tuple, files.disguised(df).select("name", "length").collect()))
    assert found(probed) == found(loaded) and len(found(probed)) == 4
    assert probed.count() == len(cases) and probed.where("error IS NOT NULL").count() == 0
    assert {r.name: r.bytes_read for r in probed.collect()}["late.bin"] == 4 + 1024 and probed.agg(F.max("bytes_read")).first()[0] == 1028
    assert probe.probe_files(spark, str(tmp_path), most_bytes=100_000, least_bytes=1).count() == len(cases) - 2
    assert probe.probe_files(spark, f"file://{tmp_path}/named.jar").first().length == len(good)


def test_a_list_is_changed_in_place(spark, tmp_path):
    path = str(tmp_path / "list")
    assert lists.saved_terms(spark, path).count() == dims.sample_terms(spark).count()
    first = dims.sample_terms(spark).limit(3)
    lists.save_terms(first, path)
    lists.save_terms(lists.saved_terms(spark, path).withColumn("severity", F.lit("HIGH")), path)
    got = lists.saved_terms(spark, path)
    assert got.count() == 3 and {r.severity for r in got.collect()} == {"HIGH"}
    # A writer that died before its pointer was written, and one that died while it wrote the list.
    lists.write_terms(first.limit(1), f"{path}/versions/half")
    (tmp_path / "list/versions/broken").mkdir()
    (tmp_path / "list/versions/broken/part-0.txt").write_text("[{\"pattern\": \"x")
    assert sorted(map(tuple, lists.saved_terms(spark, path).collect())) == sorted(map(tuple, got.collect()))
    lists.save_terms(dims.sample_terms(spark), path)
    assert lists.saved_terms(spark, path).count() == dims.sample_terms(spark).count()


def test_reports_are_in_order_over_all_files(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice(["CLEAN", "NOTABLE", "SUSPICIOUS", "DETECTED", "CRITICAL", "UNREADABLE"]), rng.randint(0, 40), rng.choice("aBcD")) for i in range(400)]
    verdicts = spark.createDataFrame(rows, "unit_id long, verdict string, score long, name string").repartition(7)
    order = {v: i for i, v in enumerate(["CLEAN", "NOTABLE", "SUSPICIOUS", "DETECTED", "CRITICAL", "UNREADABLE"])}
    want = [r[0] for r in sorted(rows, key=lambda r: (-order[r[1]], -r[2], r[3].lower(), r[0])) if order[r[1]] > 1]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lists.write_report_text(verdicts, str(tmp_path / "text"))
        findings = spark.createDataFrame([(1, 1, "t")], "unit_id long, seq long, title string")
        lists.write_report_json(verdicts, findings, str(tmp_path / "json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(p for p in os.listdir(tmp_path / "text") if p.startswith("part-"))
    text = "".join((tmp_path / "text" / p).read_text() for p in parts)
    assert len(parts) > 1 and [int(line.split(": ")[1]) for line in text.split("\n") if line.startswith("Unit: ")] == want
    assert spark.read.json(str(tmp_path / "json/units")).count() == len(rows)


@pytest.mark.parametrize("most", [1, 20, 5000])
def test_caps_of_hot_units(spark, most):
    rng = random.Random(most)
    rows = [(1 if rng.random() < 0.7 else rng.choice([None, 2, 3]), rng.choice([None, rng.randint(0, 300)]), i) for i in range(4000)] + [(9, 1, 1)] * 3
    table = spark.createDataFrame(rows, "unit_id long, at long, _share long")
    got = sorted(map(str, matching.capped(table, ["unit_id"], [F.col("at"), F.col("_share")], most).collect()))
    kept = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        kept.setdefault(r[0], []).append(r)
    assert got == sorted(map(str, spark.createDataFrame([r for v in kept.values() for r in v[:most]], table.schema).collect()))


def test_no_unit_is_summed_in_one_task(spark):
    rows = spark.createDataFrame([(1, k, "four") for k in range(50)] + [(2, 1, None), (3, 1, "(no)")], "unit_id long, ordinal long, text string")
    for df in (matching.joined_text(rows, 40), scoring.literal_sample(rows, 40)):
        assert "windowspecdefinition(unit_id" not in plan_of(df).split("ObjectHashAggregate")[-1]
    assert matching.joined_text(rows, 40).where("unit_id = 1").first().text == "\n".join(["four"] * 8)
    assert scoring.literal_sample(rows, 39).agg(F.sum(F.length("text"))).first()[0] == 39


def test_trusted_or_scanned(spark):
    reported = spark.createDataFrame([("a", "/1"), ("a", "/1"), ("a", "/2"), ("b", "/3")], "volume string, path string")
    scanned = spark.createDataFrame([("a", "/9"), ("b", "/4"), ("b", "/3"), ("c", "/5"), (None, "/6")], "volume string, path string")
    volumes = spark.createDataFrame([("a", True), ("b", False)], "volume string, trusted boolean")
    got = {(r.volume, r.path, r.source) for r in joins.trusted_or_scanned(reported, scanned, volumes).collect()}
    assert got == {("a", "/1", "index"), ("a", "/2", "index"), ("b", "/4", "scan"), ("b", "/3", "scan"), ("c", "/5", "scan"), (None, "/6", "scan")}


def test_rotations_of_every_key(spark):
    prose = "It was the best of times, it was the worst of times, and everyone there knew the reason for that, too."
    rows = spark.createDataFrame([(1, prose)], "unit_id long, text string")
    hidden = rows.select(F.explode(F.array(*[decode.rotated(F.col("text"), k) for k in range(26)])).alias("text")).withColumn("unit_id", F.monotonically_increasing_id())
    hidden = spark.createDataFrame([(i, r.text) for i, r in enumerate(hidden.collect())] + [(99, None), (98, "")], "unit_id long, text string")
    got = {r.unit_id: (r.key, r.decoded) for r in decode.rotation_keys(hidden, rows).collect()}
    assert got == {k: (k, prose) for k in range(26)} | {98: (0, "")}
    assert {r.key for r in decode.rotation_keys(hidden.where("unit_id < 3"), rows.where("false")).collect()} == {0}


def test_letters_are_counted_in_one_pass(spark):
    """As lower() has them, İ and the Kelvin sign with them; over more than one block of bytes, and no letter is looked for by itself."""
    texts = ["", "aAzZ", "İıIi", "K\u212ak", "éÅ\u212bßſ日本語 q", "xY" * 40000 + "\u212aİ", "\x00`{@["]
    rows = spark.createDataFrame([*enumerate(texts), (99, None)], "unit_id long, text string")
    low = F.lower("text")
    want = {r.unit_id: list(r.n) for r in rows.where("text IS NOT NULL").select("unit_id", F.array(*[F.length(low) - F.length(F.replace(low, F.lit(c), F.lit(""))) for c in "abcdefghijklmnopqrstuvwxyz"]).alias("n")).collect()}
    assert {i: decode._letters(t.encode()).tolist() for i, t in enumerate(texts)} == want
    shares = decode.letter_shares(rows)
    total = [sum(n) for n in zip(*want.values(), strict=True)]
    assert shares.first().shares == [n * 1_000_000 // sum(total) for n in total]
    got = decode.rotation_keys(rows, rows)
    assert "replace(" not in plan_of(got) + plan_of(shares) and got.count() == len(texts)
    turned = {r.unit_id: (r.key, r.decoded) for r in got.collect()}
    assert all(turned[i][1] == rows.where(F.col("unit_id") == i).select(decode.rotated(F.col("text"), (26 - turned[i][0]) % 26)).first()[0] for i in range(len(texts)))
    assert turned[6] == (0, texts[6]) and turned[0] == (0, "")


def test_repeating_keys_are_plain_python(spark):
    rng, rows = random.Random(5), []
    for i in range(60):
        size = rng.randint(1, 9)
        key = [rng.randint(0, 255) for _ in range(size)]
        text = "".join(rng.choice("the quick brown fox 0123\n") for _ in range(rng.randint(2, 60)))
        rows.append((i, "".join(chr(ord(c) ^ key[k % size]) for k, c in enumerate(text))))
    rows += [(100, "plain ascii"), (101, None), (102, ""), (103, "é" * 300), (104, "日本語日本語"), rows[0]]

    def search(text):
        if not text or len(text) > 200 or all(ord(c) < 128 for c in text):
            return None
        codes = [ord(c) for c in text]
        for size in range(2, min(8, len(codes) // 2) + 1):
            key = [max(range(256), key=lambda k, p=place: (sum(32 <= c ^ k <= 126 for c in codes[p::size]), -k)) for place in range(size)]
            shown = [c ^ key[i % size] for i, c in enumerate(codes)]
            if all(key) and sum(32 <= c <= 126 or c in (9, 10, 13) for c in shown) > 0.85 * len(codes):
                return size, "".join(map(chr, shown))
        return None

    got = decode.repeating_key(spark.createDataFrame(rows, "unit_id long, text string"))
    assert {r.unit_id: (r.size, r.decoded) for r in got.collect()} == {i: search(t) for i, t in rows if search(t)}
    assert "Python" not in plan_of(got) and "Arrow" not in plan_of(got)


def test_rules_of_one_pass(spark):
    archives = spark.createDataFrame(
        [(1, "a.jar", "/x/a.jar", 100, 3, 0, 0, True, 90, 20), (2, "b.dll", "/x/b", 100, 9, 5, 1, False, -1, 5), (3, "c.jar", "/x/c", 100, 0, 0, 0, True, 10, 20)],
        "archive_id long, name string, path string, size_bytes long, declared_entries long, prefix_bytes long, trailing_bytes long, readable boolean, directory_offset long, directory_size long")
    entries = spark.createDataFrame(
        [(1, "x.txt", 0, 8, 10, 10, 0), (1, "x.txt", 1, 8, 10, 10, 5), (1, "d/", 0, 8, 0, 0, 9), (1, "d/", 0, 8, 0, 0, 9), (2, "a.dll", 0, 12, 1, 1, 95), (7, "../up", 0, 8, 1, 1, None), (7, None, None, None, None, None, None)],
        "archive_id long, name string, flags int, method int, csize long, usize long, header_offset long")
    got = sorted((r.unit_id, r.rule, r.n) for r in rules.rule_findings(archives, entries).collect())
    assert got == sorted([
        (1, "duplicate names", 1), (1, "encrypted", 1), (1, "entry count", 1), (1, "directory out of range", 1), (2, "directory out of range", 1), (2, "prefix bytes", 1), (2, "trailing bytes", 1), (2, "unreadable", 1),
        (2, "odd method", 1), (2, "native library", 1), (2, "entry past end", 1), (2, "entry count", 1), (7, "traversal", 1)])


def test_rules_hold_no_table_of_names(spark):
    """Names three times or null count rightly; entries are added up once, by archive, in the parts that are asked for."""
    archives = spark.range(50).selectExpr("id AS archive_id", "'a.jar' AS name", "'/x' AS path", "100L AS size_bytes", "9L AS declared_entries", "0L AS prefix_bytes", "0L AS trailing_bytes", "true AS readable")
    entries = spark.range(50 * 9).selectExpr("id % 50 AS archive_id", "CASE WHEN id < 150 THEN 'x' WHEN id < 250 THEN 'd/' WHEN id < 350 THEN NULL ELSE 'y' END AS name", "0 AS flags", "8 AS method", "1L AS csize", "1L AS usize", "0L AS header_offset")
    for parts in (None, 7):
        found = rules.entry_findings(archives, entries, parts)
        assert sorted((r.unit_id, r.rule, r.n) for r in found.collect()) == [(i, "duplicate names", 2) for i in range(50)]
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert found.rdd.getNumPartitions() == 7


def test_rule_findings_have_more_parts_for_more_rows(spark, monkeypatch):
    from gleanery.plans import base, registry

    rows = sum(spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").count() for t in ("lineitem", "orders"))
    monkeypatch.setattr(base, "ROWS_A_PART", 100)
    found = registry.QUERIES["rule_findings"](spark, "/root/testdata/sf0.001")
    assert "hashpartitioning(archive_id" in (plan := found._jdf.queryExecution().executedPlan().toString()) and f", {rows // 100 + 1})" in plan


def test_names_that_stay_and_names_that_go(spark):
    rows = [("a", 1, "publicMethod"), ("a", 9, "method"), ("ab", 2, "privateMethod"), ("x$", 4, "protectedMethod"), ("toString", 1, "toString"), ("abc", 1, "abc"), ("-", 1, "-"), ("<init>", 1, "<init>")]
    table = spark.createDataFrame(rows, "name string, access int, want string")
    new = N.renamed(F.col("name"), N.method_name(F.lit("o"), F.col("name"), F.lit("()V"), F.col("access")))
    assert all(r.new.startswith(r.want) and (r.new == r.name) == (r.want == r.name) for r in table.withColumn("new", new).collect())
    made = table.limit(1).select(*[N.class_name(F.lit("p/a"), F.lit(p), F.lit(i)).alias(f"c{k}") for k, (p, i) in enumerate([("java/lang/Object", "y/Runnable"), ("x/Widget", "y/Runnable"), ("x/ab", "y/z"), (None, None)])]).first()
    assert [c.removeprefix("deobf/").rstrip("0123456789") for c in made] == ["Runnable", "Widget", "Class", "Class"]


def test_triage_and_targets(spark):
    units = spark.createDataFrame([(1, "CRITICAL", "2024-01-01", "/A/x", "n"), (2, "CRITICAL", None, "/b", "has /A"), (3, "CLEAN", "2024-01-01", "/A", "n"), (4, "CRITICAL", "2020-01-01", "/A", "n"), (5, "CRITICAL", "2024-01-01", None, None)], "unit_id long, verdict string, modified_at string, path string, name string")
    assert {r.unit_id for r in scoring.triage(units, ["CRITICAL"], 30, "2024-01-10", "/a").collect()} == {1, 2}
    assert {r.unit_id for r in scoring.triage(units, ["CRITICAL", "CLEAN"], 30, "2024-01-10").collect()} == {1, 2, 3, 5}
    paths = spark.createDataFrame([("/a",), ("/b/",), ("/c",), ("d\\",)], "path string")
    marked = paths.withColumn("directory", F.col("path") == "/c")
    assert {r.path for r in joins.present(paths, marked).collect()} == {"/a"} and {r.path for r in joins.present(paths, paths).collect()} == {"/a", "/c"}


def test_snapshots_with_gaps(spark, tmp_path):
    """Lines without a field, with one too many and with nulls; a line that can't be read is a row of nulls."""
    (tmp_path / "p.json").write_text('{"pid": 1, "exe": "j", "command_line": "j -jar a", "more": 2}\n{"pid": 2}\n{oops\n')
    got = lists.read_processes(spark, str(tmp_path / "p.json"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "j", "j -jar a"), (2, None, None), (None, None, None)]))
    (tmp_path / "j.json").write_text('{"pid": "7", "jvm_args": ["-a", null], "class_path": "x;y"}\n{"pid": "8", "error": "closed"}\n')
    found = {r.pid: (r.jvm_args, r.class_path, r.error) for r in lists.read_jvms(spark, str(tmp_path / "j.json")).collect()}
    assert found == {"7": (["-a", None], "x;y", None), "8": (None, None, "closed")}
    (tmp_path / "none").mkdir()
    assert lists.read_processes(spark, str(tmp_path / "none")).count() == 0
