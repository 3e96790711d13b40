"""Reports on matches and on templates, as aggregations; ties are broken by first appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.schema import line_key

#: Sizes of the reports.
KEPT_SAMPLES, SHOWN_SAMPLES, TOP, SAMPLE_CHARS = 100, 20, 10, 200


def matched() -> Column:
    return F.col("template_id").isNotNull()


def line(matches: DataFrame) -> Column:
    return F.struct(*line_key(matches))


def summary(matches: DataFrame) -> DataFrame:
    """One row: lines, matched and unmatched lines, match rate in percent, rows, templates used. Lines count once, however many matches they have."""
    per = matches.groupBy(*line_key(matches)).agg(F.max(matched()).alias("hit"), F.count("*").alias("rows"), F.collect_set("template_id").alias("ids"))
    used = matches.agg(F.count_distinct("template_id").alias("unique_templates_used"))
    total, hit = F.count("*"), F.count_if("hit")
    head = per.agg(total.alias("total_lines"), hit.alias("matched_lines"), (total - hit).alias("unmatched_lines"),
        F.when(total > 0, hit / total * 100).otherwise(0.0).alias("match_rate"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("rows"))), F.lit(0)).alias("matched_rows"))
    return head.crossJoin(F.broadcast(used))  # one row each


def level_distribution(matches: DataFrame) -> DataFrame:
    """Lower-cased level, lines and percent of the lines that have a level; in order of level."""
    counts = matches.where("level is not null and level <> ''").groupBy(F.lower("level").alias("level")).agg(F.count_distinct(line(matches)).alias("lines"))
    return with_percent(counts, "lines").orderBy("level")


def with_percent(counts: DataFrame, column: str) -> DataFrame:
    """``percent`` of the column's total; ``counts`` is a small table of groups."""
    total = F.broadcast(counts.agg(F.sum(column).alias("total")))
    return counts.crossJoin(total).withColumn("percent", F.col(column) / F.col("total") * 100).drop("total")


def top_templates(matches: DataFrame, n: int = TOP) -> DataFrame:
    """The templates used most; ties go to the one used first (in order of file, if there are several, and line)."""
    used = matches.where(matched()).groupBy("template_id").agg(F.count("*").alias("uses"), F.min(line(matches)).alias("first"))
    more = [F.col("first.file").alias("first_file")] if "file" in matches.columns else []
    return used.orderBy(F.desc("uses"), "first", "template_id").limit(n).select("template_id", "uses", *more, F.col("first.line_number").alias("first_line"))


def unmatched_samples(matches: DataFrame, n: int = SHOWN_SAMPLES) -> DataFrame:
    """The first unmatched messages, cut to 200 characters."""
    cut = F.substring("message", 1, SAMPLE_CHARS).alias("sample")
    return matches.where(~matched()).select(*line_key(matches), cut).orderBy(*line_key(matches)).limit(min(n, KEPT_SAMPLES))


def template_totals(templates: DataFrame) -> DataFrame:
    """Templates, different call sites, different files and different patterns."""
    at = F.col("location")
    return templates.agg(F.count("*").alias("templates"), F.count_distinct(at["file_path"], at["line_number"]).alias("locations"),
        F.count_distinct(at["file_path"]).alias("files"), F.count_distinct("pattern").alias("patterns"))


def template_levels(templates: DataFrame) -> DataFrame:
    return with_percent(templates.groupBy("level").agg(F.count("*").alias("templates")), "templates").orderBy("level")


def complexity(templates: DataFrame) -> DataFrame:
    c = F.col("static_token_count")
    return templates.agg(F.avg(c).alias("average"), F.max(c).alias("largest"), F.min(c).alias("smallest"))


def top_patterns(templates: DataFrame, n: int = TOP) -> DataFrame:
    counts = templates.groupBy("pattern").agg(F.count("*").alias("templates"), F.min("ins_idx").alias("first"))
    return counts.orderBy(F.desc("templates"), "first").limit(n)


def top_files(templates: DataFrame, n: int = TOP) -> DataFrame:
    counts = templates.groupBy(F.col("location.file_path").alias("file_path")).agg(F.count("*").alias("templates"), F.min("ins_idx").alias("first"))
    return counts.orderBy(F.desc("templates"), "first").limit(n)


def by_level_and_template(matches: DataFrame) -> DataFrame:
    """Roll-up of lines by level and template."""
    return matches.rollup(F.lower("level").alias("level"), "template_id").agg(F.count_distinct(line(matches)).alias("lines"))
