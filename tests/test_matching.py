import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import matching, reports
from logloom.operators.templates import build, edges
from logloom.plans.rendered import templates as inline
from logloom.schema import Options
from logloom.sources import sinks

FIVE = [
    ("h1", "Ferry <*> reached pier", 3, "Ferry.java", "FerryLog", "arrive", 64, "info", 0),
    ("h2", "Ferry <*> reached pier after <*>", 4, "Ferry.java", "FerryLog", "arrive", 70, "info", 0),
    ("h3", "Radar lost contact with <*>", 4, "Radar.java", "RadarDesk", "sweep", 205, "error", 0),
    ("h4", "Unloading <*> crates", 2, "Crane.java", "CraneQueue", "unload", 19, "debug", 0),
    ("h5", "<*> drill ended without incident", 4, "Drill.java", "DrillBook", "finish", 88, "info", 0),
]


def lines(spark, messages, levels=None):
    rows = [(i + 1, m, levels[i] if levels else None, None, None) for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, "line_number long, message string, level string, timestamp string, logger string")


def slow(tokens, rows, intra=True):
    """All derivations, depth first: an independent matcher."""
    import re

    out = []

    def go(t, ti, pos, caps, key, tmpl, idx):
        if ti == len(t):
            if pos == len(tokens):
                out.append((tmpl, caps, key, idx))
            return
        if pos >= len(tokens):
            return
        if t[ti] == "<*>":
            for n in range(1, len(tokens) - pos + 1):
                go(t, ti + 1, pos + n, caps + [" ".join(tokens[pos : pos + n])], key + [1 + n], tmpl, idx)
        elif intra and "<*>" in t[ti]:
            m = re.fullmatch(re.escape(t[ti]).replace(r"<\*>", r"(\S+?)"), tokens[pos])
            if m:
                go(t, ti + 1, pos + 1, caps + list(m.groups()), key + [1], tmpl, idx)
        elif t[ti] == tokens[pos]:
            go(t, ti + 1, pos + 1, caps, key + [0], tmpl, idx)

    for idx, row in enumerate(rows):
        go(row[1].split(), 0, 0, [], [], row, idx)
    found = []
    for tmpl, caps, key, idx in out:
        conf = tmpl[2] / len(tokens) + (0.1 if len(tokens) == len(tmpl[1].split()) else 0)
        if caps and sum(len(c.split()) for c in caps) / len(caps) > 5:
            conf -= 0.1
        found.append((-tmpl[2], -min(1.0, max(0.0, conf)), key, idx, tmpl[0], caps))
    return sorted(found)


def test_expected_matches(spark):
    said = {
        "Ferry Alma reached pier": ("h1", ["Alma"]), "Ferry Alma reached pier after 3 hours": ("h2", ["Alma", "3 hours"]), "Radar lost contact with buoy 7": ("h3", ["buoy 7"]),
        "Unloading 40 crates": ("h4", ["40"]), "Evening fire drill ended without incident": ("h5", ["Evening fire"]),
        "Fog over the bay": (None, None), "Ferry": (None, None), "": (None, None), "reached pier Ferry Alma": (None, None),
    }
    got = matching.best_matches(lines(spark, list(said)), inline(spark, FIVE)).collect()
    assert {r.message: (r.template_id, r["values"]) for r in got} == said


@pytest.mark.parametrize("seed", [1, 2])
def test_random_cases_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    words = ["a", "b", "x.y", "k=1", "k=22", "$(z)"]
    pieces = [*words, "<*>", "<*>", "k=<*>"]
    rows = []
    for i in range(25):
        p = [rnd.choice(pieces) for _ in range(rnd.randint(1, 5))]
        rows.append((f"t{i}", " ".join(p), sum(x != "<*>" for x in p), "f", "C", "m", i, "unknown", 0))
    messages = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 8))) for _ in range(60)]
    frame, side = lines(spark, messages), inline(spark, rows)
    best = {r.line_number: r for r in matching.best_matches(frame, side).collect()}
    every = {}
    for r in matching.all_matches(frame, side).orderBy("line_number", "rank").collect():
        every.setdefault(r.line_number, []).append((r.template_id, r["values"], round(r.confidence, 12)))
    for i, m in enumerate(messages, 1):
        want = slow(m.split(), rows)
        assert [(t, v, round(-c, 12)) for _, c, _, _, t, v in want] == every.get(i, [])
        assert (best[i].template_id, best[i]["values"]) == ((want[0][4], want[0][5]) if want else (None, None))


def test_switches(spark):
    special = [("s", "Reading: kind=<*> place=<*>", 3, "f", "C", "m", 1, "unknown", 0)]
    line = lines(spark, ["Reading: kind=GET place=/a"])
    assert matching.best_matches(line, inline(spark, special)).first()["values"] == ["GET", "/a"]
    assert matching.best_matches(line, inline(spark, special), options=Options(intra_token=False)).first().template_id is None
    longer = lines(spark, ["Unloading 5 crates and more"])
    assert matching.best_matches(longer, inline(spark, FIVE)).first().template_id is None
    assert matching.best_matches(longer, inline(spark, FIVE), options=Options(allow_trailing=True)).first().template_id == "h4"


def test_levels_and_threshold(spark):
    frame = lines(spark, ["Ferry Alma reached pier"] * 3, ["INFO", "error", None])
    assert [r.template_id for r in matching.best_matches(frame, inline(spark, FIVE)).orderBy("line_number").collect()] == ["h1", None, "h1"]
    assert matching.level_filter(frame, " info,WARN").count() == 1
    assert matching.best_matches(frame, inline(spark, FIVE), threshold=1.0, use_level=False).where("template_id is not null").count() == 0
    with pytest.raises(ValueError):
        matching.best_matches(frame, inline(spark, FIVE), threshold=1.5)


def test_plan_is_one_broadcast_join_without_python(spark):
    plan = matching.best_matches(lines(spark, ["x"]), inline(spark, FIVE))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Python" not in plan


def test_long_and_adjacent(spark):
    rows = [("l", " ".join(["tok"] * 30 + ["<*>"]), 30, "f", "C", "m", 1, "unknown", 0), ("d", "Ferry <*> <*> reached pier", 3, "f", "C", "m", 2, "unknown", 0)]
    got = matching.best_matches(lines(spark, [" ".join(["tok"] * 30 + ["end"]), "Ferry Alma Nord reached pier"]), inline(spark, rows)).orderBy("line_number").collect()
    assert [r["values"] for r in got] == [["end"], ["Alma", "Nord"]]


def test_reports_and_sinks(spark, tmp_path):
    frame = lines(spark, ["Ferry Alma reached pier", "nothing here", "Ferry a | b reached pier after c", 'say "x", y'], ["INFO", None, "INFO", "WARN"])
    best = matching.best_matches(frame, inline(spark, FIVE)).persist()
    s = reports.summary(best).first()
    assert (s.total_lines, s.matched_lines, s.unmatched_lines, s.match_rate, s.unique_templates_used) == (4, 2, 2, 50.0, 2)
    assert [(r.level, r.lines) for r in reports.level_distribution(best).collect()] == [("info", 2), ("warn", 1)]
    assert reports.summary(best.limit(0)).first().match_rate == 0
    sinks.write_csv(best, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).orderBy("line_number").collect()
    assert back[0].confidence == "0.850" and back[1].template_id is None and back[3].message == 'say "x", y' and back[2].extracted_values == "a | b | c"
    every = matching.all_matches(frame, inline(spark, FIVE))
    sinks.write_json(frame, every, str(tmp_path / "json"))
    rows = spark.read.json(str(tmp_path / "json")).orderBy("line_number").collect()
    assert rows[0].matches[0].template_id == "h1" and rows[0].matches[0].source_location.file == "Ferry.java" and rows[1].matches == []
    assert "Match rate: 50.0%" in sinks.summary_text(best)


def test_tree(spark):
    built = build(inline(spark, FIVE))
    assert edges(built).where("node = 'Ferry <*> reached pier'").collect()[0].token == "after"
    assert built.select(F.max("holes")).first()[0] == 2


def test_single_lines(spark):
    from logloom import api

    side = inline(spark, FIVE)
    assert [r.template_id for r in api.match(side, "Ferry a reached pier after b")] == ["h2"]
    assert api.best_match(side, "Ferry a reached pier", "ERROR") is None and api.best_match(side, "Ferry a reached pier", "info").template_id == "h1"
    assert api.describe(api.best_match(side, "Unloading 9 crates")) == "h4 (0.767) Unloading <*> crates <- 9" and api.size(side) == 5
    assert api.match(side, "") == [] and api.best_match(side, "no such line") is None
