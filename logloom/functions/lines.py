"""Header parsing of log lines: five formats, tried in order, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import col, strip

#: The header formats. Groups in the order given beside them.
FORMATS: tuple[tuple[str, tuple[str, ...]], ...] = (
    (r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[^\s]*)\s+(\w+)\s+(?:\[([^\]]+)\])?\s*([^\s-]+)?\s*-?\s*(.+)$", ("timestamp", "level", "thread", "logger", "message")),
    (r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}[^\s]*)\s+(\w+)\s+(?:\[([^\]]+)\])?\s*([^\s:]+)?:?\s*(.+)$", ("timestamp", "level", "thread", "logger", "message")),
    (r"^(\w+):\s*(.+)$", ("level", "message")),
    (r"^(\w+)\s+(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}[^\s]*)\s+(?:\[([^\]]+)\])?\s*([^\s-]+)?\s*-?\s*(.+)$", ("level", "timestamp", "thread", "logger", "message")),
)
FIELDS = ("timestamp", "level", "thread", "logger", "message")
#: Unicode classes, and only \n ends a line.
FLAGS = "(?Ud)"
MARK = "\u0001"


def header_split(line: Column | str) -> Column:
    """The simple header rule: date, time, level and the rest; a shorter line is all message."""
    parts = F.split(strip(line), r"(?U)[\s\x1C-\x1F]+", 4)
    empty = F.lit(None).cast("string")
    full = F.struct(F.concat_ws(" ", parts[0], parts[1]).alias("timestamp"), parts[2].alias("level"), empty.alias("thread"), empty.alias("logger"), F.get(parts, F.lit(3)).alias("message"))
    short = F.struct(*[(strip(line) if f == "message" else empty).alias(f) for f in FIELDS])
    return F.when(F.size(parts) == 4, full).otherwise(short)


def parsed(lines, column: str = "value"):
    """The rows of ``lines`` with the five fields as columns: timestamp, level, thread, logger and message; fields that a format
    lacks are null, as are all of a blank line.

    The format is found first, then one replacement with that format's regex writes the groups between marks (U+0001) and one split
    gives them. Lines that hold the mark themselves take the groups one by one.
    """
    found = lines.withColumn("_text", strip(column)).withColumn("_which", which_of("_text"))
    groups = F.when(F.col("_which") == -1, F.lit(None).cast("array<string>"))
    for k, (pattern, names) in enumerate(FORMATS):
        place = lambda f, g=names: f"${g.index(f) + 1}" if f in g else ""
        joined = F.regexp_replace("_text", FLAGS + pattern, MARK.join(map(place, FIELDS)))
        single = F.array(*[F.regexp_extract("_text", FLAGS + pattern, names.index(f) + 1) if f in names else F.lit("") for f in FIELDS])
        groups = groups.when(F.col("_which") == k, F.when(F.contains("_text", F.lit(MARK)), single).otherwise(F.split(joined, MARK)))
    whole = F.array(*[F.col("_text") if f == "message" else F.lit("") for f in FIELDS])
    found = found.withColumn("_groups", groups.otherwise(whole))
    # One struct in an array, expanded: a filter on a field is not pushed below it, where it would parse every line again.
    fields = F.struct(*[F.nullif(F.col("_groups")[k], F.lit("")).alias(f) for k, f in enumerate(FIELDS)])
    return found.select(*lines.columns, F.inline(F.array(fields)))


def which_of(column: str) -> Column:
    """Number of the first format that fits; -1 for a blank line, null for none."""
    out = F.when(F.coalesce(F.col(column), F.lit("")) == "", -1)
    for k, (pattern, _) in enumerate(FORMATS):
        out = out.when(F.col(column).rlike(FLAGS + pattern), k)
    return out


def event_time(timestamp: Column | str) -> Column:
    """The timestamp text as a timestamp where it is one, for windows and watermarks."""
    return F.try_to_timestamp(F.regexp_replace(F.replace(col(timestamp), F.lit(","), F.lit(".")), r"\s+", " "))
