"""Sinks: templates and matches as JSON lines, matches as CSV, and the text summary."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import three_decimals
from logloom.operators import reports
from logloom.schema import TEMPLATE, line_key

#: Fixed value: the columns of the CSV form.
CSV_COLUMNS = ("line_number", "timestamp", "level", "logger", "message", "template_id", "confidence", "pattern", "extracted_values", "source_file", "source_line")


def template_json(templates: DataFrame) -> DataFrame:
    return templates.select(F.to_json(F.struct(*[F.col(f.name) for f in TEMPLATE.fields]), {"ignoreNullFields": "false"}).alias("value"))


def write_templates(templates: DataFrame, path: str, one_file: bool = False) -> None:
    rows = template_json(templates.orderBy("location.file_path", "location.line_number", "branch_variant"))
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").text(path)


def csv_rows(matches: DataFrame) -> DataFrame:
    """The CSV form's columns as text; what is missing is empty. Lines of several files have their ``file`` in front."""
    hit = F.col("template_id").isNotNull()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    when = lambda c: F.when(hit, c).otherwise("")
    return matches.select(
        *line_key(matches), text("timestamp").alias("timestamp"), text("level").alias("level"), text("logger").alias("logger"), text("message").alias("message"),
        text("template_id").alias("template_id"), F.coalesce(three_decimals("confidence"), F.lit("")).alias("confidence"), when(text("pattern")).alias("pattern"),
        when(F.coalesce(F.array_join("values", " | "), F.lit(""))).alias("extracted_values"), when(text("location.file_path")).alias("source_file"), when(text("location.line_number")).alias("source_line"),
    )


def write_csv(matches: DataFrame, path: str) -> None:
    rows = csv_rows(matches).repartitionByRange(*line_key(matches)).sortWithinPartitions(*line_key(matches))
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def json_rows(lines: DataFrame, matches: DataFrame) -> DataFrame:
    """One JSON object for each line with its matches in order of rank; nulls are kept. Lines of several files have their ``file`` in front."""
    key = line_key(lines)
    at = F.col("location")
    place = F.struct(at["file_path"].alias("file"), at["line_number"].alias("line"), at["class_name"].alias("class"), at["method_name"].alias("method"))
    rank = F.col("rank") if "rank" in matches.columns else F.lit(1)
    one = F.struct("template_id", "confidence", "pattern", F.col("values").alias("extracted_values"), place.alias("source_location"))
    grouped = matches.where("template_id is not null").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), one.alias("match")))).alias("found"))
    head = [*key, "timestamp", "level", "logger", "message"]
    joined = lines.select(*head).join(grouped, key, "left")
    found = F.coalesce(F.transform("found", lambda x: x["match"]), F.array().cast(one_type(grouped)))
    return joined.select(*key, F.to_json(F.struct(*head, found.alias("matches")), {"ignoreNullFields": "false"}).alias("value"))


def one_type(grouped: DataFrame) -> str:
    return f"array<{grouped.schema['found'].dataType.elementType['match'].dataType.simpleString()}>"


def write_json(lines: DataFrame, matches: DataFrame, path: str) -> None:
    key = line_key(lines)
    json_rows(lines, matches).repartitionByRange(*key).sortWithinPartitions(*key).select("value").write.mode("overwrite").text(path)


def summary_text(matches: DataFrame, patterns: dict[str, str] | None = None) -> str:
    """The report as text. Only its few rows reach the driver."""
    s = reports.summary(matches).first()
    out = ["Log matching summary", "=" * 40, f"Total lines: {s.total_lines}", f"Matched lines: {s.matched_lines}", f"Unmatched lines: {s.unmatched_lines}",
           f"Match rate: {s.match_rate:.1f}%", f"Unique templates used: {s.unique_templates_used}", "", "Levels"]
    out += [f"  {r.level.upper()}: {r.lines} ({r.percent:.1f}%)" for r in reports.level_distribution(matches).collect()]
    out += ["", "Top templates"] + [f"  {r.template_id}: {r.uses}" + (f"  {patterns[r.template_id]}" if patterns and r.template_id in patterns else "") for r in reports.top_templates(matches).collect()]
    out += ["", "Unmatched samples"] + [f"  {r['sample']}" for r in reports.unmatched_samples(matches).collect()]
    return "\n".join(out) + "\n"


def default_output(source: str, now: float | None = None) -> str:
    """Where extracted templates go when no place is given."""
    stamp = time.strftime("%Y%m%d_%H%M%S", time.localtime(now))
    return f"output_templates/{source.rstrip('/').rsplit('/', 1)[-1] or 'repo'}_{stamp}.jsonl"
