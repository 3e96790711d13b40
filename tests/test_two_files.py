"""Logs of several files: a line is told by its file and its number in matching, reports and sinks."""

import json

import pytest

from logloom import cli
from logloom.functions.lines import parsed
from logloom.operators import matching, reports
from logloom.plans.rendered import templates as inline
from logloom.sources import files, sinks

TEMPLATES = [("v", "Valve <*> was opened", 3, "Valve.java", "V", "open", 1, "info", 0)]


@pytest.fixture
def logs(tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.log").write_text("INFO: Valve 1 was opened\nWARN: what is this\n")
    (tmp_path / "logs/b.log").write_text("ERROR: and that\nINFO: Valve 22 was opened\n")
    return str(tmp_path / "logs")


def test_reports(spark, logs):
    best = matching.best_matches(parsed(files.read_log(spark, logs)), inline(spark, TEMPLATES)).persist()
    s = reports.summary(best).first()
    assert (s.total_lines, s.matched_lines, s.unmatched_lines, s.match_rate, s.matched_rows, s.unique_templates_used) == (4, 2, 2, 50.0, 2, 1)
    assert {r.level: r.lines for r in reports.level_distribution(best).collect()} == {"info": 2, "warn": 1, "error": 1}
    assert [(r["file"][-5:], r.line_number, r["sample"]) for r in reports.unmatched_samples(best).collect()] == [("a.log", 2, "what is this"), ("b.log", 1, "and that")]
    top = reports.top_templates(best).first()
    assert (top.uses, top.first_file[-5:], top.first_line) == (2, "a.log", 1)
    assert {(r.level, r.template_id): r.lines for r in reports.by_level_and_template(best).collect()}[(None, None)] == 4


def test_sinks(spark, logs, tmp_path):
    lines = parsed(files.read_log(spark, logs))
    best, every = (f(lines, inline(spark, TEMPLATES)) for f in (matching.best_matches, matching.all_matches))
    sinks.write_csv(best, str(tmp_path / "csv"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    assert sorted((r["file"][-5:], r.line_number, r.extracted_values) for r in rows) == [("a.log", "1", "1"), ("a.log", "2", None), ("b.log", "1", None), ("b.log", "2", "22")]
    sinks.write_json(lines, every, str(tmp_path / "json"))
    said = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert sorted((x["file"][-5:], x["message"], [m["extracted_values"] for m in x["matches"]]) for x in said) == [
        ("a.log", "Valve 1 was opened", [["1"]]), ("a.log", "what is this", []), ("b.log", "Valve 22 was opened", [["22"]]), ("b.log", "and that", []),
    ]


def test_command_line(spark, logs, tmp_path, capsys):
    sinks.write_templates(inline(spark, TEMPLATES), str(tmp_path / "t"))
    for kind in ("csv", "jsonl", "summary"):
        assert cli.main(["match", "-t", str(tmp_path / "t"), "--in", logs, "--out", str(tmp_path / "o"), "--format", kind]) == 0
        said = capsys.readouterr().out
        assert "Lines: 4\nMatched lines: 2\nMatch rate: 50.0%" in said
    assert cli.main(["match", "-t", str(tmp_path / "t"), "--in", logs + "/a.log", "--out", str(tmp_path / "one")]) == 0
    header = spark.read.text(str(tmp_path / "one")).first().value.split(",")
    assert tuple(header) == sinks.CSV_COLUMNS


def test_lines_are_not_shuffled(spark, logs):
    plan = matching.best_matches(spark.read.text(logs).selectExpr("value message", "1L line_number"), inline(spark, TEMPLATES))._jdf.queryExecution().executedPlan().toString()
    lines = plan[plan.index("BroadcastHashJoin") :]
    assert lines.count("FileScan text") == 1
    before_scan = lines[: lines.index("FileScan text")].rsplit("Project", 1)[1]
    assert "Exchange" not in before_scan and "SortAggregate" not in lines.split("BroadcastExchange")[0]


def test_many_templates_are_joined_by_a_shuffle(spark, logs, monkeypatch):
    lines = parsed(files.read_log(spark, logs))
    want = {(r.message, r.template_id) for r in matching.best_matches(lines, inline(spark)).collect()}
    monkeypatch.setattr(matching, "BROADCAST_TEMPLATES", 0)
    assert {(r.message, r.template_id) for r in matching.best_matches(lines, inline(spark)).collect()} == want


def test_templates_one_after_another(spark, tmp_path):
    sinks.write_templates(inline(spark), str(tmp_path / "t"))
    assert sum(1 for _ in files.each_template(spark, str(tmp_path / "t"))) == inline(spark).count()
