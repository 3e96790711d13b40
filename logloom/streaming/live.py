"""Matching of a stream of log lines. Parsing and best matching keep no state; counts are windowed with a watermark.

Text files in a stream give their lines no numbers, so ``line_number`` is only unique within a micro-batch unless the stream brings its own; best
matching runs per micro-batch on it, with the same operator as a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.lines import event_time, parsed
from logloom.operators.matching import best_matches
from logloom.schema import Options


def lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream of parsed lines."""
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return parsed(raw).withColumn("event_time", event_time("timestamp"))


def match_stream(stream: DataFrame, templates: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, threshold: float = 0.0, options: Options = Options(), trigger: dict | None = None):
    """Starts a query that hands each micro-batch's best matches to ``sink(matches, batch)``; a batch is matched again after a failure.

    ``trigger`` is that of ``DataStreamWriter.trigger``, such as {"processingTime": "10 seconds"}; by default what is there is matched once.
    """

    def each(batch: DataFrame, number: int) -> None:
        numbered = batch if "line_number" in batch.columns else batch.withColumn("line_number", F.monotonically_increasing_id())
        sink(best_matches(numbered, templates, threshold, options=options), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def level_counts(stream: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Lines by level and window of the event time; lines later than ``late`` are left out."""
    seen = stream.where("event_time is not null and level is not null").withWatermark("event_time", late)
    return seen.groupBy(F.window("event_time", window), F.lower("level").alias("level")).agg(F.count("*").alias("lines"))
