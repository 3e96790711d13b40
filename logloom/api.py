"""Single lines, for interactive use: the same operators on a table of one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from logloom.operators.matching import all_matches, best_matches
from logloom.schema import Options

LINE = "line_number long, message string, level string"


def match(templates: DataFrame, message: str, level: str | None = None, options: Options = Options()) -> list[Row]:
    """All matches of one message, most specific first."""
    line = templates.sparkSession.createDataFrame([(1, message, level)], LINE)
    return all_matches(line, templates, options=options).orderBy("rank").collect()


def best_match(templates: DataFrame, message: str, level: str | None = None, options: Options = Options()) -> Row | None:
    line = templates.sparkSession.createDataFrame([(1, message, level)], LINE)
    found = best_matches(line, templates, options=options).where(F.col("template_id").isNotNull()).collect()
    return found[0] if found else None


def size(templates: DataFrame) -> int:
    """Templates, equal ones counted as often as they are there."""
    return templates.count()


def describe(row: Row) -> str:
    """One line for a match: template, confidence, pattern and captured values."""
    return f"{row.template_id} ({row.confidence:.3f}) {row.pattern} <- {', '.join(row['values'])}"
