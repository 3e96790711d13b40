"""Queries over rendered log lines, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import text
from logloom.functions.lines import FORMATS, event_time, header_split, parsed
from logloom.operators import matching, reports, templates
from logloom.plans.rendered import duck_lines, duck_templates, log_lines, rendered_lines, table
from logloom.plans.rendered import templates as inline
from logloom.session import shared_folder
from logloom.sources import sinks
from logloom.sources.files import EXCLUDED, read_log, walked
from logloom.streaming import live


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(log_lines(spark, sf_dir))


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.non_blank(lines(spark, sf_dir))


def best(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return matching.best_matches(wanted(spark, sf_dir), inline(spark), **options)


def flat(matches: DataFrame, *more: str) -> DataFrame:
    return matches.select("line_number", "template_id", "confidence", F.array_join("values", " | ").alias("extracted"), *more)


# Oracle pieces -------------------------------------------------------------------------------------------------------------------
def duck_field(field: str) -> str:
    cases = []
    for pattern, groups in FORMATS:
        value = f"nullif(regexp_extract(s, '{pattern}', {groups.index(field) + 1}), '')" if field in groups else "NULL"
        cases.append(f"WHEN regexp_matches(s, '{pattern}') THEN {value}")
    last = "s" if field == "message" else "NULL"
    return f"CASE WHEN coalesce(s, '') = '' THEN NULL {' '.join(cases)} ELSE {last} END AS {'\"timestamp\"' if field == 'timestamp' else field}"


PARSED = f"parsed AS (SELECT line_number, value, {', '.join(map(duck_field, ('timestamp', 'level', 'thread', 'logger', 'message')))} FROM (SELECT *, trim(value) AS s FROM ({duck_lines()}) l) x)"
TOKENS = r"toks AS (SELECT *, regexp_extract_all(message, '\S+') AS tk FROM parsed WHERE coalesce(trim(message), '') <> '')"
NORM = "norm AS (SELECT *, len(tk) AS n, array_to_string(tk, ' ') AS txt FROM toks)"
CONF = "greatest(0.0, least(1.0, CAST(t.static AS DOUBLE) / n.n + CASE WHEN n.n = t.p THEN 0.1 ELSE 0.0 END - CASE WHEN t.holes > 0 AND CAST(n.n - t.p + t.holes AS DOUBLE) / t.holes > 5 THEN 0.1 ELSE 0.0 END))"
LEVEL = "(n.level IS NULL OR t.t_level = 'unknown' OR lower(n.level) = t.t_level)"
CAPS = "array_to_string(list_filter([CASE WHEN t.holes >= 1 THEN regexp_extract(n.txt, t.rx, 1) END, CASE WHEN t.holes >= 2 THEN regexp_extract(n.txt, t.rx, 2) END, CASE WHEN t.holes >= 3 THEN regexp_extract(n.txt, t.rx, 3) END], lambda x: x IS NOT NULL), ' | ')"


def duck_best(threshold: float = 0.0, level: str = LEVEL, where: str = "true") -> str:
    """CTEs up to ``best``: every line (that passes ``where``) with its best match."""
    first_hole = "len(string_split(regexp_extract(n.txt, t.rx, 1), ' '))"
    return f"""WITH {PARSED}, {TOKENS}, {NORM}, lines AS (SELECT * FROM norm WHERE {where}),
ranked AS (SELECT n.line_number, t.*, {CONF} AS confidence, {CAPS} AS extracted,
  row_number() OVER (PARTITION BY n.line_number ORDER BY t.static DESC, {CONF} DESC, CASE WHEN starts_with(t.pattern, '<*>') THEN {first_hole} ELSE 0 END, t.ins_idx) AS rk
  FROM lines n JOIN {duck_templates()} t ON regexp_full_match(n.txt, t.rx) AND {level} AND {CONF} >= {threshold}),
best AS (SELECT l.line_number, l."timestamp", l.level, l.logger, l.message, r.template_id, r.confidence, r.extracted, r.pattern, r.file_path, r.src_line FROM lines l LEFT JOIN ranked r ON r.line_number = l.line_number AND r.rk = 1)
"""


#: Derivations token by token. A token may have one hole within (as in t6).
IN_TOKEN = r"'^' || replace(regexp_replace(replace(s.tt[s.i + 1], '<*>', chr(1)), '([^\w' || chr(1) || '])', '\\\1', 'g'), chr(1), '(\S+?)') || '$'"
ALL = f"""WITH RECURSIVE {PARSED}, {TOKENS}, {NORM}, tmpl AS (SELECT *, string_split(pattern, ' ') AS tt FROM {duck_templates()}),
st AS (SELECT n.line_number, t.template_id, 0 AS i, 0 AS pos, CAST([] AS INTEGER[]) AS ky, CAST([] AS VARCHAR[]) AS caps, n.tk, n.n, t.tt, t.p
  FROM norm n JOIN tmpl t ON {LEVEL} AND n.n >= t.p
  UNION ALL
  SELECT s.line_number, s.template_id, s.i + 1, s.pos + w.len, list_append(s.ky, CASE WHEN s.tt[s.i + 1] = '<*>' THEN CAST(1 + w.len AS INTEGER) WHEN contains(s.tt[s.i + 1], '<*>') THEN 1 ELSE 0 END),
    CASE WHEN s.tt[s.i + 1] = '<*>' THEN list_append(s.caps, array_to_string(s.tk[s.pos + 1:s.pos + w.len], ' ')) WHEN contains(s.tt[s.i + 1], '<*>') THEN list_append(s.caps, regexp_extract(s.tk[s.pos + 1], {IN_TOKEN}, 1)) ELSE s.caps END, s.tk, s.n, s.tt, s.p
  FROM st s JOIN (SELECT unnest(range(1, 40)) AS len) w ON s.i < s.p AND (CASE WHEN s.tt[s.i + 1] = '<*>' THEN s.pos + w.len + (s.p - s.i - 1) <= s.n WHEN contains(s.tt[s.i + 1], '<*>') THEN w.len = 1 AND regexp_matches(s.tk[s.pos + 1], {IN_TOKEN}) ELSE w.len = 1 AND s.tk[s.pos + 1] = s.tt[s.i + 1] END))
"""
RANKED = " AS confidence, CAST(row_number() OVER (PARTITION BY s.line_number ORDER BY t.static DESC, " + CONF + " DESC, s.ky, t.ins_idx) AS INTEGER) AS rank FROM st s JOIN tmpl t USING (template_id) JOIN norm n USING (line_number) WHERE s.i = s.p AND s.pos = s.n"
#: Report pieces over ``best``.
Q: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


@query("parse_lines", f"WITH {PARSED} SELECT line_number, \"timestamp\", level, thread, logger, message FROM parsed")
def parse_lines(spark, sf_dir):
    return lines(spark, sf_dir).drop("value")


@query("header_split", f"""SELECT line_number, CASE WHEN n >= 4 THEN p[1] || ' ' || p[2] END AS "timestamp", CASE WHEN n >= 4 THEN p[3] END AS level,
  CASE WHEN n >= 4 THEN regexp_replace(s, '^\\S+\\s+\\S+\\s+\\S+\\s+', '') ELSE s END AS message FROM (SELECT *, len(p) AS n FROM (SELECT line_number, trim(value) AS s, string_split_regex(trim(value), '\\s+') AS p FROM ({duck_lines()}) l) a) b""")  # fmt: skip
def header_rule(spark, sf_dir):
    return log_lines(spark, sf_dir).select("line_number", header_split("value").alias("h")).select("line_number", "h.timestamp", "h.level", "h.message")


@query("tokenize", f"WITH {PARSED}, {TOKENS} SELECT line_number, CAST(len(tk) AS INTEGER) AS n_tokens, array_to_string(tk, '_') AS tokens FROM toks")
def tokenize(spark, sf_dir):
    return wanted(spark, sf_dir).select("line_number", F.size(text.tokens("message")).alias("n_tokens"), F.array_join(text.tokens("message"), "_").alias("tokens"))


@query("template_identity", f"SELECT template_id, CAST(len(list_filter(string_split(pattern, ' '), lambda x: x <> '<*>')) AS INTEGER) AS static_tokens, substr(md5(file_path || ':' || src_line || ':' || pattern || ':' || branch_variant), 1, 16) AS computed_id FROM {duck_templates()}")
def template_identity(spark, sf_dir):
    at = F.col("location")
    return inline(spark).select("template_id", text.static_token_count("pattern").alias("static_tokens"), text.template_id(at["file_path"], at["line_number"], "pattern", "branch_variant").alias("computed_id"))


@query("location_text", f"SELECT template_id, file_path || ':class:' || class_name || ':method:' || method_name || ':line:' || src_line AS location FROM {duck_templates()}")
def location_text(spark, sf_dir):
    return inline(spark).select("template_id", text.location_text("location").alias("location"))


@query("best_match", duck_best() + "SELECT line_number, template_id, confidence, extracted FROM best")
def best_match(spark, sf_dir):
    return flat(best(spark, sf_dir))


@query("best_match_any_level", duck_best(level="true") + "SELECT line_number, template_id, confidence, extracted FROM best")
def best_match_any_level(spark, sf_dir):
    return flat(best(spark, sf_dir, use_level=False))


@query("best_match_threshold", duck_best(threshold=0.7) + "SELECT line_number, template_id, confidence, extracted FROM best")
def best_match_threshold(spark, sf_dir):
    return flat(best(spark, sf_dir, threshold=0.7))


@query("best_match_level_filter", duck_best(where="upper(level) IN ('ERROR', 'WARN')") + "SELECT line_number, template_id, confidence, extracted FROM best")
def best_match_level_filter(spark, sf_dir):
    return flat(matching.best_matches(matching.level_filter(wanted(spark, sf_dir), "error, WARN"), inline(spark)))


@query("best_match_sample_lines", duck_best(where="line_number <= 500") + "SELECT line_number, template_id, confidence, extracted FROM best")
def best_match_sample_lines(spark, sf_dir):
    return flat(matching.best_matches(matching.sample_lines(wanted(spark, sf_dir), 500), inline(spark)))


DERIVED = ALL + "SELECT s.line_number, s.template_id, array_to_string(s.caps, ' | ') AS extracted, " + CONF + RANKED


@query("all_matches", DERIVED)
def all_matches(spark, sf_dir):
    found = matching.all_matches(wanted(spark, sf_dir), inline(spark))
    return found.select("line_number", "template_id", F.array_join("values", " | ").alias("extracted"), "confidence", "rank")


@query("trie_edges", f"WITH t AS (SELECT string_split(pattern, ' ') AS tt, unnest(range(0, p)) AS i FROM {duck_templates()}) SELECT DISTINCT array_to_string(tt[1:i], ' ') AS node, tt[i + 1] AS token, array_to_string(tt[1:i + 1], ' ') AS child FROM t")
def trie_edges(spark, sf_dir):
    return templates.edges(templates.build(inline(spark)))


@query("trie_size", f"SELECT count(*) AS templates FROM {duck_templates()}")
def trie_size(spark, sf_dir):
    return inline(spark).agg(F.count("*").alias("templates"))


@query("unmatched_lines", duck_best() + "SELECT line_number, message FROM best WHERE template_id IS NULL")
def unmatched_lines(spark, sf_dir):
    return matching.unmatched(wanted(spark, sf_dir), best(spark, sf_dir)).select("line_number", "message")


@query("used_templates", duck_best() + f"SELECT template_id, pattern FROM {duck_templates()} t WHERE template_id IN (SELECT template_id FROM best)")
def used_templates(spark, sf_dir):
    return matching.used_templates(inline(spark), best(spark, sf_dir)).select("template_id", "pattern")


@query("match_summary", duck_best() + "SELECT count(*) AS total_lines, count(template_id) AS matched_lines, count(*) - count(template_id) AS unmatched_lines, CAST(count(template_id) AS DOUBLE) / count(*) * 100 AS match_rate, count(template_id) AS matched_rows, count(DISTINCT template_id) AS unique_templates_used FROM best")
def match_summary(spark, sf_dir):
    return reports.summary(best(spark, sf_dir))


@query("level_distribution", duck_best() + "SELECT lower(level) AS level, count(*) AS lines, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM best WHERE level IS NOT NULL) * 100 AS percent FROM best WHERE level IS NOT NULL GROUP BY 1")
def level_distribution(spark, sf_dir):
    return reports.level_distribution(best(spark, sf_dir))


@query("top_templates", duck_best() + "SELECT template_id, count(*) AS uses, min(line_number) AS first_line FROM best WHERE template_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 10")
def top_templates(spark, sf_dir):
    return reports.top_templates(best(spark, sf_dir))


@query("unmatched_samples", duck_best() + "SELECT line_number, substr(message, 1, 200) AS sample FROM best WHERE template_id IS NULL ORDER BY 1 LIMIT 20")
def unmatched_samples(spark, sf_dir):
    return reports.unmatched_samples(best(spark, sf_dir))


@query("level_template_rollup", duck_best() + "SELECT lower(level) AS level, template_id, count(*) AS lines FROM best WHERE template_id IS NOT NULL GROUP BY ROLLUP (lower(level), template_id)")
def level_template_rollup(spark, sf_dir):
    return reports.by_level_and_template(best(spark, sf_dir).where("template_id is not null"))


@query("csv_rows", duck_best() + "SELECT line_number, coalesce(\"timestamp\", '') AS \"timestamp\", coalesce(level, '') AS level, coalesce(logger, '') AS logger, message, coalesce(template_id, '') AS template_id, coalesce(format('{:.3f}', confidence), '') AS confidence, coalesce(pattern, '') AS pattern, coalesce(extracted, '') AS extracted_values, coalesce(file_path, '') AS source_file, coalesce(CAST(src_line AS VARCHAR), '') AS source_line FROM best")
def csv_rows(spark, sf_dir):
    return sinks.csv_rows(best(spark, sf_dir))


ONE = "to_json({'template_id': s.template_id, 'confidence': " + CONF + ", 'pattern': t.pattern, 'extracted_values': s.caps, 'source_location': {'file': t.file_path, 'line': t.src_line, 'class': t.class_name, 'method': t.method_name}})"
LINE = """'{"line_number":' || n.line_number || ',"timestamp":' || coalesce(CAST(to_json(n."timestamp") AS VARCHAR), 'null') || ',"level":' || coalesce(CAST(to_json(n.level) AS VARCHAR), 'null') || ',"logger":' || coalesce(CAST(to_json(n.logger) AS VARCHAR), 'null') || ',"message":' || CAST(to_json(n.message) AS VARCHAR) || ',"matches":[' || coalesce(f.found, '') || ']}'"""


@query("json_rows", ALL + f", found AS (SELECT line_number, string_agg(CAST(one AS VARCHAR), ',' ORDER BY rank) AS found FROM (SELECT s.line_number, {ONE} AS one, {CONF}{RANKED}) r GROUP BY 1) SELECT n.line_number, {LINE} AS value FROM norm n LEFT JOIN found f USING (line_number)")
def json_rows(spark, sf_dir):
    found = matching.all_matches(wanted(spark, sf_dir), inline(spark))
    return sinks.json_rows(wanted(spark, sf_dir), found)


@query("match_text", duck_best() + "SELECT line_number, 'Match(template_id=' || template_id || ', confidence=' || format('{:.3f}', confidence) || ', location=' || file_path || ':class:' || class_name || ':method:' || method_name || ':line:' || src_line || ')' AS said FROM best JOIN (SELECT template_id, class_name, method_name FROM " + duck_templates() + " d) d USING (template_id)")
def match_text(spark, sf_dir):
    return best(spark, sf_dir).where("template_id is not null").select("line_number", text.match_text("template_id", "confidence", "location").alias("said"))


@query("best_match_no_templates", f"WITH {PARSED}, {TOKENS} SELECT line_number, CAST(NULL AS VARCHAR) AS template_id, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS extracted FROM toks")
def best_match_no_templates(spark, sf_dir):
    """Without any template every line stays, unmatched."""
    return flat(matching.best_matches(wanted(spark, sf_dir), inline(spark, ())))


# Several files: lines are told by file and number ----------------------------------------------------------------------------------
PER_FILE = 2000
DUCK_FILE = f"CAST(floor((line_number - 1) / {PER_FILE}) AS BIGINT)"
DUCK_NUMBER = f"CAST((line_number - 1) % {PER_FILE} + 1 AS BIGINT)"


def in_files(lines: DataFrame) -> DataFrame:
    """The lines as those of files of 2,000 lines each, numbered from 1 within each."""
    at = F.col("line_number") - 1
    return lines.withColumn("file", F.floor(at / PER_FILE).cast("string")).withColumn("line_number", at % PER_FILE + 1)


def best_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.best_matches(in_files(wanted(spark, sf_dir)), inline(spark))


@query("files_summary", SQL["match_summary"])
def files_summary(spark, sf_dir):
    return reports.summary(best_in_files(spark, sf_dir))


@query("files_levels", SQL["level_distribution"])
def files_levels(spark, sf_dir):
    return reports.level_distribution(best_in_files(spark, sf_dir))


@query("files_unmatched", duck_best() + f"SELECT CAST({DUCK_FILE} AS VARCHAR) AS file, {DUCK_NUMBER} AS line_number, message FROM best WHERE template_id IS NULL")
def files_unmatched(spark, sf_dir):
    return matching.unmatched(in_files(wanted(spark, sf_dir)), best_in_files(spark, sf_dir)).select("file", "line_number", "message")


IN_FILES = f"SELECT CAST({DUCK_FILE} AS VARCHAR) AS file, {DUCK_NUMBER} AS line_number, ".replace("line_number -", "s.line_number -")


@query("files_all_matches", ALL + DERIVED[len(ALL) :].replace("SELECT s.line_number, ", IN_FILES))
def files_all_matches(spark, sf_dir):
    found = matching.all_matches(in_files(wanted(spark, sf_dir)), inline(spark))
    return found.select("file", "line_number", "template_id", F.array_join("values", " | ").alias("extracted"), "confidence", "rank")


@query("numbered_lines", f"SELECT {DUCK_FILE} AS shard, {DUCK_NUMBER} AS line_number, value FROM ({duck_lines()}) l")
def numbered_lines(spark, sf_dir):
    """Log texts written to files and read back: every physical line with its number, blank ones counted."""
    where = f"{shared_folder(spark)}/lines_{uuid.uuid4().hex}"
    made = in_files(log_lines(spark, sf_dir)).withColumn("shard", F.col("file").cast("long"))
    made.repartition("shard").sortWithinPartitions("shard", "line_number").select("value", "shard").write.partitionBy("shard").text(where)
    return read_log(spark, where).select(F.regexp_extract("file", r"shard=(\d+)", 1).cast("long").alias("shard"), "line_number", "value")


SAID = """, heads AS (SELECT count(*) AS t, count(template_id) AS m, count(DISTINCT template_id) AS u FROM best),
levels AS (SELECT upper(level) AS l, count(*) AS n FROM best WHERE level IS NOT NULL GROUP BY 1),
tops AS (SELECT template_id, count(*) AS n, min(line_number) AS f FROM best WHERE template_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 10),
samples AS (SELECT line_number, substr(message, 1, 200) AS s FROM best WHERE template_id IS NULL ORDER BY 1 LIMIT 20),
said AS (SELECT 1 AS a, 1 AS b, 'Log matching summary' AS said UNION ALL SELECT 1, 2, repeat('=', 40)
 UNION ALL SELECT 2, 1, 'Total lines: ' || t FROM heads UNION ALL SELECT 2, 2, 'Matched lines: ' || m FROM heads UNION ALL SELECT 2, 3, 'Unmatched lines: ' || (t - m) FROM heads
 UNION ALL SELECT 2, 4, 'Match rate: ' || format('{:.1f}', CAST(m AS DOUBLE) / t * 100) || '%' FROM heads UNION ALL SELECT 2, 5, 'Unique templates used: ' || u FROM heads
 UNION ALL SELECT 3, 1, '' UNION ALL SELECT 3, 2, 'Levels' UNION ALL SELECT 4, row_number() OVER (ORDER BY l), '  ' || l || ': ' || n || ' (' || format('{:.1f}', CAST(n AS DOUBLE) / (SELECT sum(n) FROM levels) * 100) || '%)' FROM levels
 UNION ALL SELECT 5, 1, '' UNION ALL SELECT 5, 2, 'Top templates' UNION ALL SELECT 6, row_number() OVER (ORDER BY n DESC, f), '  ' || template_id || ': ' || n FROM tops
 UNION ALL SELECT 7, 1, '' UNION ALL SELECT 7, 2, 'Unmatched samples' UNION ALL SELECT 8, line_number, '  ' || s FROM samples)
SELECT CAST(row_number() OVER (ORDER BY a, b) AS INTEGER) AS position, said FROM said"""


@query("summary_report", duck_best().rstrip() + SAID)
def summary_report(spark, sf_dir):
    """The text summary, line by line."""
    said = sinks.summary_text(best(spark, sf_dir)).rstrip("\n").split("\n")
    return spark.createDataFrame([*enumerate(said, 1)], "position int, said string")


@query("template_json", f"SELECT CAST(to_json({{'template_id': template_id, 'pattern': pattern, 'static_token_count': static, 'location': {{'file_path': file_path, 'class_name': class_name, 'method_name': method_name, 'line_number': src_line}}, 'level': t_level, 'branch_variant': branch_variant}}) AS VARCHAR) AS value FROM {duck_templates()}")
def template_json(spark, sf_dir):
    return sinks.template_json(inline(spark))


@query("template_totals", f"SELECT count(*) AS templates, count(DISTINCT (file_path, src_line)) AS locations, count(DISTINCT file_path) AS files, count(DISTINCT pattern) AS patterns FROM {duck_templates()}")
def template_totals(spark, sf_dir):
    return reports.template_totals(inline(spark))


@query("template_levels", f"SELECT t_level AS level, count(*) AS templates, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM {duck_templates()}) * 100 AS percent FROM {duck_templates()} GROUP BY 1")
def template_levels(spark, sf_dir):
    return reports.template_levels(inline(spark))


@query("template_complexity", f"SELECT CAST(sum(static) AS DOUBLE) / count(*) AS average, max(static) AS largest, min(static) AS smallest FROM {duck_templates()}")
def template_complexity(spark, sf_dir):
    return reports.complexity(inline(spark))


@query("top_patterns", f"SELECT pattern, count(*) AS templates, CAST(min(ins_idx) AS BIGINT) AS first FROM {duck_templates()} GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 10")
def top_patterns(spark, sf_dir):
    return reports.top_patterns(inline(spark))


@query("top_files", f"SELECT file_path, count(*) AS templates, CAST(min(ins_idx) AS BIGINT) AS first FROM {duck_templates()} GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 10")
def top_files(spark, sf_dir):
    return reports.top_files(inline(spark))


SPEC = r"%[+-]?[0-9]*\.?[0-9]*[diouxXeEfFgGaAcsSn]"
MADE = "'Part %s ' || p_name || ' size %' || CAST(p_size AS STRING) || 'd costs %.2f of %5.1f%% by ' || p_brand || ' \\{\\} {}'"


@query("format_specifiers", f"SELECT p_partkey, regexp_replace({MADE}, '{SPEC}', '<*>', 'g') AS pattern, replace({MADE}, '\\{{\\}}', '{{}}') AS braces, substr(p_name, 1, 5) AS cut FROM part")
def format_specifiers(spark, sf_dir):
    made = table(spark, sf_dir, "part").withColumn("made", F.expr(MADE.replace("\\", "\\\\")))
    return made.select("p_partkey", text.holes_from_format("made").alias("pattern"), text.unescape_braces("made").alias("braces"), F.substring("p_name", 1, 5).alias("cut"))


PATHS = "'/repo/' || CASE CAST(p_partkey % 6 AS INTEGER) WHEN 0 THEN 'src/' WHEN 1 THEN 'target/' WHEN 2 THEN 'src/test/' WHEN 3 THEN 'lib/out/' WHEN 4 THEN 'src/vendor/' ELSE '' END || 'P' || CAST(p_partkey AS STRING) || CASE WHEN p_size % 4 = 0 THEN '.txt' ELSE '.java' END"


@query("walk_files", f"SELECT path FROM (SELECT {PATHS} AS path FROM part) f WHERE path LIKE '%.java' AND NOT regexp_matches(path, '/(target|build|bin|out|test|vendor)/')")
def walk_files(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.expr(PATHS).alias("path"))
    return walked(files, "/repo", ("*.java",), ("*/vendor/*", *EXCLUDED)).select("path")


@query("count_files", f"SELECT count(*) AS files FROM ({SQL['walk_files']}) w")
def count_files(spark, sf_dir):
    return walk_files(spark, sf_dir).agg(F.count("*").alias("files"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of parsed log lines."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return parsed(rendered_lines(spark, events))


@query("stream_best_match", SQL["best_match"])
def stream_best_match(spark, sf_dir):
    """Best matches of a stream: each micro-batch's are one folder, which a repeated batch replaces."""
    where = f"{shared_folder(spark)}/matches_{uuid.uuid4().hex}"
    stream = matching.non_blank(streamed(spark, sf_dir))
    keep = lambda found, number: flat(found).write.mode("overwrite").parquet(f"{where}/rows/batch={number}")
    live.match_stream(stream, inline(spark), keep, f"{where}/state").awaitTermination()
    return spark.read.parquet(f"{where}/rows").drop("batch")


@query("stream_level_counts", f"WITH {PARSED} SELECT substr(\"timestamp\", 1, 10) AS day, lower(level) AS level, count(*) AS lines FROM parsed WHERE \"timestamp\" IS NOT NULL AND level IS NOT NULL GROUP BY 1, 2")
def stream_level_counts(spark, sf_dir):
    """The events as a stream of log lines: counts by day and level, from a watermarked window."""
    stream = streamed(spark, sf_dir).withColumn("event_time", event_time("timestamp"))
    name = f"levels_{uuid.uuid4().hex}"
    counts = live.level_counts(stream, "1 day")
    counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{shared_folder(spark)}/{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "level", "lines")
