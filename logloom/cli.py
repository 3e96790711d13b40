"""Command line: extract, analyze and match. ``python -m logloom.cli COMMAND --help`` tells the options."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from logloom.functions.lines import parsed
from logloom.functions.text import basename, shortened
from logloom.operators import extract, matching, reports
from logloom.schema import Options
from logloom.sources import files, sinks


def session() -> SparkSession:
    return SparkSession.builder.appName("logloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def options_of(a: argparse.Namespace) -> Options:
    return Options(max_branch_variants=getattr(a, "max_variants", 16))


def run_extract(spark: SparkSession, a: argparse.Namespace) -> int:
    found = extract.extract_repository(spark, a.src, a.include, a.exclude, options_of(a), a.workers, a.cache).persist()
    if found.isEmpty():
        print("No templates found")
        return 0
    out = a.out or sinks.default_output(a.src)
    sinks.write_templates(found, out)
    total = reports.template_totals(found).first()
    print(f"Templates: {total.templates}\nCall sites: {total.locations}\nPatterns: {total.patterns}\nOutput: {out}")
    if a.verbose:
        for r in reports.template_levels(found).collect():
            print(f"  {r.level}: {r.templates}")
    return 0


def run_analyze(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = files.read_templates(spark, a.templates)
    if rows.isEmpty():
        print("No templates found")
        return 1
    t = reports.template_totals(rows).first()
    print(f"Templates: {t.templates}\nFiles: {t.files}\nPatterns: {t.patterns}\nLevels:")
    for r in reports.template_levels(rows).collect():
        print(f"  {r.level}: {r.templates} ({r.percent:.1f}%)")
    if a.stats:
        c = reports.complexity(rows).first()
        print(f"Static tokens: average {c.average:.1f}, most {c.largest}, least {c.smallest}\nTop patterns:")
        for r in reports.top_patterns(rows).withColumn("shown", shortened("pattern", 60)).collect():
            print(f"  {r.templates:5d}  {r.shown}")
    print("Top files:")
    for r in reports.top_files(rows).withColumn("name", basename("file_path")).collect():
        print(f"  {r.templates:5d}  {r['name']}")
    return 0


def run_match(spark: SparkSession, a: argparse.Namespace) -> int:
    if not 0 <= a.threshold <= 1:
        print("Error: threshold must be between 0.0 and 1.0")
        return 1
    templates = files.read_templates(spark, a.templates)
    if templates.isEmpty():
        print("Error: no templates found")
        return 1
    log = files.read_log(spark, a.input)
    if len(spark.read.text(a.input).inputFiles()) == 1:
        log = log.drop("file")  # the line's number says it all
    lines = matching.non_blank(parsed(matching.sample_lines(log, a.sample_lines)))
    lines = matching.level_filter(lines, a.level_filter).drop("value")
    if a.best_only or a.format == "summary":
        found = matching.best_matches(lines, templates, a.threshold)
    else:
        found = matching.all_matches(lines, templates, a.threshold)
        if a.format == "csv":
            found = found.unionByName(matching.unmatched(lines, found), allowMissingColumns=True)
    found = found.persist()
    if a.format == "csv":
        sinks.write_csv(found, a.output)
    elif a.format == "jsonl":
        sinks.write_json(lines, found, a.output)
    else:
        text = sinks.summary_text(found, {r.template_id: r.pattern for r in matching.used_templates(templates, reports.top_templates(found)).collect()})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(a.output)
    every = found if a.format != "jsonl" else found.unionByName(matching.unmatched(lines, found), allowMissingColumns=True)
    s = reports.summary(every).first()
    print(f"Lines: {s.total_lines}\nMatched lines: {s.matched_lines}\nMatch rate: {s.match_rate:.1f}%\nTemplates used: {s.unique_templates_used}\nOutput: {a.output}")
    if a.verbose:
        for r in reports.unmatched_samples(every, 5).collect():
            print(f"  unmatched: {r['sample']}")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="logloom")
    sub = top.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract", help="templates from a Java source tree")
    e.add_argument("--src", "-s", required=True)
    e.add_argument("--out", "-o")
    e.add_argument("--include", "-i", action="append")
    e.add_argument("--exclude", "-e", action="append")
    e.add_argument("--workers", "-w", type=int)
    e.add_argument("--max-variants", type=int, default=16)
    e.add_argument("--cache", help="table of facts by content, so that only new contents are parsed")
    e.add_argument("--verbose", "-v", action="store_true")
    n = sub.add_parser("analyze", help="report on a template table")
    n.add_argument("--templates", "-t", required=True)
    n.add_argument("--stats", "-s", action="store_true")
    m = sub.add_parser("match", help="match log lines to templates")
    m.add_argument("--templates", "-t", required=True)
    m.add_argument("--input", "--in", required=True)
    m.add_argument("--output", "--out", required=True)
    m.add_argument("--format", choices=("csv", "jsonl", "summary"), default="csv")
    m.add_argument("--threshold", type=float, default=0.0)
    m.add_argument("--best-only", action="store_true")
    m.add_argument("--level-filter")
    m.add_argument("--verbose", "-v", action="store_true")
    m.add_argument("--sample-lines", type=int)
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    return {"extract": run_extract, "analyze": run_analyze, "match": run_match}[a.command](session(), a)


if __name__ == "__main__":
    sys.exit(main())
