"""Inputs rendered from the driver's tables, by the same SQL in Spark and in the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from logloom.schema import TEMPLATE

#: id, pattern, stored static count, file, class, method, line, level, variant; in order of insertion.
TEMPLATES: tuple[tuple, ...] = (
    ("t1", "Valve <*> was opened", 3, "plant/Valve.java", "ValveControl", "open", 51, "info", 0),
    ("t2", "Valve <*> was opened by <*>", 4, "plant/Valve.java", "ValveControl", "open", 58, "info", 0),
    ("t3", "Pump failure in sector <*>", 4, "plant/Pump.java", "PumpWatch", "check", 102, "error", 0),
    ("t4", "Draining <*> tanks", 2, "plant/Tank.java", "TankFarm", "drain", 33, "debug", 0),
    ("t5", "<*> inspection passed without findings", 4, "plant/Audit.java", "AuditTrail", "close", 71, "unknown", 0),
    ("t6", "Reading: kind=<*> place=<*> state=<*>", 4, "plant/Pump.java", "PumpWatch", "read", 117, "unknown", 0),
    ("t7", "Valve <*> was opened", 3, "plant/Mirror.java", "Mirror", "open", 12, "warn", 0),
    ("t8", "<*> ended <*>", 1, "plant/Audit.java", "AuditTrail", "close", 77, "unknown", 1),
    ("t9", "Shift <*> <*> over", 2, "plant/Tank.java", "TankFarm", "rest", 90, "unknown", 0),
)
LINES = """
SELECT event_id + 1 AS line_number,
  CASE CAST(floor(event_id / 10) AS BIGINT) % 5
    WHEN 0 THEN replace({stamp}, ' ', 'T') || 'Z ' || lvl || ' [t-' || CAST(user_id % 4 AS STRING) || '] org.plant.Main - ' || msg
    WHEN 1 THEN {stamp} || '.123 ' || lvl || '  [main] org.plant.Worker: ' || msg
    WHEN 2 THEN lvl || ': ' || msg
    WHEN 3 THEN lvl || '  ' || {stamp} || ',123 [main] org.plant.Shift - ' || msg
    ELSE msg END AS value
FROM (SELECT *,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'INFO' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'TRACE' END AS lvl,
  CASE event_id % 10
    WHEN 0 THEN 'Valve ' || CAST(user_id AS STRING) || ' was opened'
    WHEN 1 THEN 'Valve ' || CAST(user_id AS STRING) || ' north was opened by 10.0.' || CAST(user_id % 256 AS STRING) || '.' || CAST(event_id % 256 AS STRING)
    WHEN 2 THEN 'Pump failure in sector ' || CAST(event_id AS STRING)
    WHEN 3 THEN 'Draining ' || CAST(event_id % 50 AS STRING) || ' tanks'
    WHEN 4 THEN 'Yearly ' || event_type || ' inspection passed without findings'
    WHEN 5 THEN 'Reading: kind=GET place=/x/' || CAST(user_id AS STRING) || ' state=' || CAST(200 + event_id % 7 AS STRING)
    WHEN 6 THEN 'Nothing known about item ' || CAST(event_id AS STRING)
    WHEN 7 THEN 'Shift a b ' || event_type || ' x ended at last over'
    WHEN 8 THEN 'leak ended then ended again ' || CAST(event_id % 3 AS STRING)
    ELSE '' END AS msg
  FROM events) e
"""
STAMPS = {"spark": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "duck": "strftime(ts, '%Y-%m-%d %H:%M:%S')"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered_lines(spark, table(spark, sf_dir, "events"))


def rendered_lines(spark: SparkSession, events: DataFrame) -> DataFrame:
    return spark.sql(LINES.replace("{stamp}", STAMPS["spark"]).replace("FROM events)", "FROM {events})"), events=events)


def duck_lines() -> str:
    return LINES.replace("{stamp}", STAMPS["duck"])


def templates(spark: SparkSession, rows=TEMPLATES) -> DataFrame:
    data = [(i, p, s, (f, c, m, n), level, v, k) for k, (i, p, s, f, c, m, n, level, v) in enumerate(rows)]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TEMPLATE.fields)
    return spark.createDataFrame(data, fields + ", ins_idx long")


def duck_templates(rows=TEMPLATES) -> str:
    """The templates as VALUES, with a regular expression of their own."""
    quoted = lambda x: "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x)
    out = []
    for k, row in enumerate(rows):
        tokens = row[1].split()
        piece = lambda t: r"(\S+(?: \S+)*?)" if t == "<*>" else re.escape(t).replace(r"<\*>", r"(\S+?)").replace(r"\ ", " ")
        rx = "^" + " ".join(piece(t) for t in tokens) + "$"
        holes = row[1].count("<*>")
        out.append("(" + ", ".join([*map(quoted, row), str(k), str(len(tokens)), str(holes), quoted(rx)]) + ")")
    names = "template_id, pattern, static, file_path, class_name, method_name, src_line, t_level, branch_variant, ins_idx, p, holes, rx"
    return f"(SELECT * FROM (VALUES {', '.join(out)}) v({names}))"
