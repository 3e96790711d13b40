import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from logloom import cli
from logloom.functions import text
from logloom.functions.lines import header_split, parsed
from logloom.operators.extract import extract_repository
from logloom.operators.matching import best_matches
from logloom.plans.rendered import templates as inline
from logloom.sources import files, sinks
from logloom.streaming import live

LINES = {
    "2024-02-29T23:59:58.250Z WARN [pool-7] org.depot.Gate - Gate held open": ("2024-02-29T23:59:58.250Z", "WARN", "pool-7", "org.depot.Gate", "Gate held open"),
    "2024-02-29 23:59:58.250 DEBUG  [pool-7] org.depot.Gate: Gate shut": ("2024-02-29 23:59:58.250", "DEBUG", "pool-7", "org.depot.Gate", "Gate shut"),
    "ERROR: Gate stuck": (None, "ERROR", None, None, "Gate stuck"),
    "TRACE  2024-02-29 23:59:58,250 [io] org.depot.Gate - Gate seen": ("2024-02-29 23:59:58,250", "TRACE", "io", "org.depot.Gate", "Gate seen"),
    "nothing but words": (None, None, None, None, "nothing but words"),
    "  ": (None,) * 5,
    "2024-03-01 06:07:08 WARN Draining basin 4": ("2024-03-01 06:07:08", "WARN", None, "Draining", "basin 4"),
    "2024-03-01 06:07:08 WARN Done": ("2024-03-01 06:07:08", "WARN", None, "Don", "e"),
}


def test_parse_line(spark):
    rows = parsed(spark.createDataFrame([(x,) for x in LINES], "value string")).collect()
    assert {r.value: (r.timestamp, r.level, r.thread, r.logger, r.message) for r in rows} == LINES
    h = spark.createDataFrame([("2024-03-01 06:07:08 WARN Draining basin 4",)], "v string").select(header_split("v").alias("h")).first().h
    assert (h.timestamp, h.level, h.message) == ("2024-03-01 06:07:08", "WARN", "Draining basin 4")


def test_text_functions(spark):
    df = spark.createDataFrame([("%d of %-10s at %.2f%% %n",)], "t string")
    assert df.select(text.holes_from_format("t").alias("t")).first().t == "<*> of <*> at <*>%% <*>"
    words = spark.createDataFrame([(" a b c\x1cd ",)], "t string").select(text.tokens("t").alias("t")).first().t
    assert words == ["a", "b", "c", "d"]
    q = spark.createDataFrame([('"a\\"b"',), ("'x'",), ("plain",)], "t string").select(text.unquote("t").alias("t")).collect()
    assert [r.t for r in q] == ['a\\"b', "x", "plain"]


def test_three_decimals_are_those_of_print(spark):
    rng = random.Random(3)
    middles = [(2 * k + 1) / 2000 for k in range(1000)]
    values = [None, 0.0, 1.0, *(k / 16 for k in range(17)), *middles, *(math.nextafter(m, 0) for m in middles), *(math.nextafter(m, 1) for m in middles), *(rng.random() for _ in range(5000))]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.three_decimals("v").alias("t")).collect()
    assert [r.t for r in rows] == [None if v is None else f"{v:.3f}" for v in values]


@pytest.mark.parametrize("glob,path,hit", [("*.java", "a/b.java", True), ("*/test/*", "x/test/Y.java", True), ("*/test/*", "x/test", False), ("a?c", "abc", True), ("[!a]b", "cb", True), ("[!a]b", "ab", False), ("a.b", "axb", False)])
def test_globs(spark, glob, path, hit):
    assert spark.createDataFrame([(path,)], "p string").select(text.like_any("p", [glob]).alias("h")).first().h is hit


def test_repository(spark, tmp_path):
    for p in ("src/A.java", "src/test/B.java", "target/C.java", "D.java", "E.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("class A { void f() { log.info(\"seen {}\", 1); } }")
    repo = files.Repository(spark, str(tmp_path))
    assert sorted(r.relative for r in repo.files(content=False).collect()) == ["D.java", "src/A.java"] and repo.count() == 2
    assert files.Repository(spark, str(tmp_path), exclude=["D*"]).count() == 1


def test_template_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_templates(inline(spark), path, one_file=True)
    assert files.read_templates(spark, path).count() == inline(spark).count()
    good = {"template_id": "x", "pattern": "é <*>", "static_token_count": 1, "location": {"file_path": "f", "class_name": None, "method_name": None, "line_number": 1}, "level": "info"}
    (tmp_path / "bad.jsonl").write_text("\n".join([json.dumps(good, ensure_ascii=False), "", "{broken", json.dumps(good | {"level": "loud"}), json.dumps({k: v for k, v in good.items() if k != "pattern"})]))
    rows = files.read_templates(spark, str(tmp_path / "bad.jsonl")).collect()
    assert [(r.pattern, r.branch_variant) for r in rows] == [("é <*>", 0)] and files.bad_templates(spark, str(tmp_path / "bad.jsonl")).count() == 3
    assert files.read_templates(spark, str(tmp_path / "none.jsonl")).count() == 0
    assert sorted(r.template_id for r in files.each_template(spark, path)) == sorted(r.template_id for r in inline(spark).collect())


def test_default_output():
    assert re.fullmatch(r"output_templates/depot_\d{8}_\d{6}\.jsonl", sinks.default_output("/src/depot/", 0.0))


def test_templates_of_a_source_tree(spark, tmp_path):
    for p in ("src/A.java", "src/test/B.java"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text('class A { void f() { log.info("seen {}", 1); } }')
    assert [(r.pattern, r.location.method_name) for r in extract_repository(spark, str(tmp_path)).collect()] == [("seen <*>", "f")]
    assert extract_repository(spark, str(tmp_path), include=["*.kt"]).count() == 0


@pytest.mark.parametrize("threshold", [-0.1, 1.1])
def test_threshold_is_a_share(spark, threshold):
    with pytest.raises(ValueError):
        best_matches(spark.createDataFrame([(1, "x")], "line_number long, message string"), inline(spark), threshold)


def test_line_numbers_over_many_splits(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(f"line {i}" if i % 7 else "" for i in range(1, 5001)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.read_log(spark, str(tmp_path / "a.log"))
        assert rows.rdd.getNumPartitions() > 3
        assert rows.count() == 5000 and rows.where("value <> '' and value <> concat('line ', line_number)").count() == 0
        assert rows.agg(F.count_distinct("line_number")).first()[0] == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("2024-03-01 06:07:08 INFO [m] c: Valve 12 was opened\n2024-03-01 06:08:08 WARN [m] c: nothing\n")
    got = []
    query = live.match_stream(live.lines(spark, str(tmp_path / "in")), inline(spark), lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert sorted((r.message, r.template_id) for r in got) == [("Valve 12 was opened", "t1"), ("nothing", None)]
    counts = live.level_counts(live.lines(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("levels").outputMode("complete").start()
    counts.processAllAvailable()
    counts.stop()
    assert {(r.level, r.lines) for r in spark.table("levels").collect()} == {("info", 1), ("warn", 1)}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/A.java").write_text('class A { void f(String u) {\n log.info("Ship {} has left", u);\n log.warn("Left: " + u);\n } }')
    (tmp_path / "x.log").write_text("INFO: Ship bob has left\n\nWARN: Left: now\nINFO: what\n")
    t, o = str(tmp_path / "t"), str(tmp_path / "o")
    assert cli.main(["extract", "-s", str(tmp_path / "src"), "-o", t, "-v"]) == 0
    assert cli.main(["analyze", "-t", t, "-s"]) == 0
    for kind in ("csv", "jsonl", "summary"):
        assert cli.main(["match", "-t", t, "--in", str(tmp_path / "x.log"), "--out", o, "--format", kind, "-v"]) == 0
        assert "Matched lines: 2" in capsys.readouterr().out
    assert cli.main(["match", "-t", t, "--in", str(tmp_path / "x.log"), "--out", o, "--best-only", "--level-filter", "warn"]) == 0
    assert "Lines: 1\n" in capsys.readouterr().out
    assert cli.main(["match", "-t", t, "--in", "x", "--out", o, "--threshold", "2"]) == 1
