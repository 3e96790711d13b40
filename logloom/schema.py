"""Row types shared by sources, operators and sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Levels of templates.
LEVELS = ("trace", "debug", "info", "warn", "error", "fatal", "unknown")
WILDCARD = "<*>"

LOCATION = T.StructType(
    [T.StructField("file_path", T.StringType()), T.StructField("class_name", T.StringType()), T.StructField("method_name", T.StringType()), T.StructField("line_number", T.IntegerType())]
)
TEMPLATE = T.StructType(
    [
        T.StructField("template_id", T.StringType()), T.StructField("pattern", T.StringType()), T.StructField("static_token_count", T.IntegerType()),
        T.StructField("location", LOCATION), T.StructField("level", T.StringType()), T.StructField("branch_variant", T.IntegerType()),
    ]
)


def line_key(rows: DataFrame) -> list[str]:
    """The columns that tell a line: its number, within its file where there is one."""
    return [c for c in ("file", "line_number") if c in rows.columns]


@dataclass(frozen=True)
class Options:
    """Switches between what is meant (the default) and what a literal reading of the rules gives.

    placeholders: "star" turns ``{}`` of a message into ``<*>`` before tokens are counted; "raw" keeps it.
    intra_token: a ``<*>`` within a token (``id=<*>``) is a wildcard of one token; off: such a token only matches itself.
    nested_format: "resolve" expands ``log.info(String.format(..))``; "raw" gives a method marker.
    slice_mode: "observed" keeps the textually last definition; "branches" keeps every definition of an if/else chain.
    dedupe: one template for each call site; off: one for each enclosing class and method as well.
    include_constructors: constructors and initialisers are searched too.
    allow_trailing: a line may go on after its template ends.
    """

    placeholders: str = "star"
    intra_token: bool = True
    nested_format: str = "resolve"
    slice_mode: str = "observed"
    dedupe: bool = True
    include_constructors: bool = False
    allow_trailing: bool = False
    max_branch_variants: int = 16
