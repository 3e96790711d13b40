"""Sources: source trees, template tables (JSON lines) and log texts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from logloom.functions.text import like_any
from logloom.schema import LEVELS, TEMPLATE

#: Splits of log files whose directory is broadcast at most.
BROADCAST_SPLITS = 200_000
#: What a walk leaves out by default.
EXCLUDED = (
    "*/target/*", "*/build/*", "*/bin/*", "*/out/*", "*/.git/*", "*/.svn/*", "*/.hg/*", "*/node_modules/*", "*/__pycache__/*",
    "*/test/*", "*/tests/*", "*/testing/*", "*/example/*", "*/examples/*", "*/sample/*", "*/samples/*",
)


class Repository:
    """A source tree: its files by pattern. Patterns are matched against the path below the root (with a leading slash)."""

    def __init__(self, spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, abs_paths: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        self.include, self.exclude, self.abs_paths = tuple(include or ("*.java",)), (*(exclude or ()), *EXCLUDED), abs_paths

    def files(self, content: bool = True) -> DataFrame:
        """path, relative and (if wanted) content of every file that is walked.

        Names are listed and filtered first (Spark's reader holds a listing on the driver in any case), so that no excluded content is read.
        """
        if content:
            names = [r.path for r in self.files(content=False).select("path").toLocalIterator()]
            if not names:
                return self.spark.createDataFrame([], "path string, content binary, relative string")
            found = self.spark.read.format("binaryFile").option("__globPaths__", "false").load(names).select("path", "content")
            return walked(found, self.root, ("*",), (), self.abs_paths)
        read = self.spark.read.format("binaryFile").option("recursiveFileLookup", True)
        if len(self.include) == 1 and "/" not in self.include[0]:
            read = read.option("pathGlobFilter", self.include[0])
        return walked(read.load(self.root).select("path"), self.root, self.include, self.exclude, self.abs_paths)

    def count(self) -> int:
        return self.files(content=False).count()


def walked(files: DataFrame, root: str, include, exclude, abs_paths: bool = False) -> DataFrame:
    """``files`` (path, ...) whose path matches an include and no exclude; ``relative`` is the path below the root."""
    plain = F.regexp_replace("path", "^file:/*", "/")
    below = F.when(F.startswith(plain, F.lit(root + "/")), F.substr(plain, F.lit(len(root) + 2))).otherwise(plain)
    slashed = F.concat(F.lit("/"), F.ltrim(below, F.lit("/")))
    keep = lambda globs: like_any(below, globs) | like_any(slashed, globs) | (like_any(plain, globs) if abs_paths else F.lit(False))
    return files.where(keep(include) & ~keep(exclude)).withColumn("relative", below)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Templates of a JSON-lines table, in order (``ins_idx``). Bad rows are left out; ``bad_templates`` has them."""
    return _read(spark, path).where(_good()).drop("_corrupt")


def each_template(spark: SparkSession, path: str) -> Iterator[Row]:
    """The templates one after another, a partition at a time."""
    return read_templates(spark, path).toLocalIterator(prefetchPartitions=True)


def bad_templates(spark: SparkSession, path: str) -> DataFrame:
    """Rows that are no templates: broken JSON, missing or mistyped fields, unknown levels."""
    return _read(spark, path).where(~_good())


def _good():
    need = F.lit(True)
    for c in ("template_id", "pattern", "static_token_count", "location.file_path", "location.line_number", "level"):
        need = need & F.col(c).isNotNull()
    return F.col("_corrupt").isNull() & need & F.col("level").isin(*LEVELS)


def _read(spark: SparkSession, path: str) -> DataFrame:
    try:
        lines = spark.read.text(path)
    except Exception as e:  # a missing table has no templates
        if "PATH_NOT_FOUND" not in str(e):
            raise
        lines = spark.createDataFrame([], "value string")
    return template_rows(lines)


def good_templates(lines: DataFrame) -> DataFrame:
    """Templates of JSON lines (``value``)."""
    return template_rows(lines).where(_good()).drop("_corrupt")


def template_rows(lines: DataFrame) -> DataFrame:
    schema = T.StructType([*TEMPLATE.fields, T.StructField("_corrupt", T.StringType())])
    parsed = lines.where(F.trim("value") != "").withColumn("ins_idx", F.monotonically_increasing_id())
    row = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return parsed.select(row.alias("t"), "ins_idx").select("t.*", "ins_idx").withColumn("branch_variant", F.coalesce("branch_variant", F.lit(0)))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines of one or more log files: file, value and line_number (from 1 within each file, blank lines counted).

    Numbers are exact without gathering a file in one task: each split's lines are counted first, and a line's number is its place in
    its split after the lines of the splits before it. Bytes that are no UTF-8 are dropped.
    """
    raw = spark.read.text(path)
    lines = raw.select(
        F.regexp_replace("value", "�", "").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # Ids grow by one within a split and jump between splits, so a split's lines are numbered by difference.
    first = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = first.withColumn("before", F.coalesce(before, F.lit(0))).select("file", "block", "first", "before")
    few = len(raw.inputFiles()) + raw.rdd.getNumPartitions() <= BROADCAST_SPLITS  # no job: a split more for each boundary
    return lines.join(F.broadcast(starts) if few else starts, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line_number"), "value")
