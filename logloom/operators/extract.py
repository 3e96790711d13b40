"""Templates from Java sources. Parsing gives facts (one Arrow function over file contents); rules and slicing are joins on them.

``facts`` has one row for each file. Its arrays become the relations ``calls``, ``stmts``, ``params`` and ``fields``; a file that cannot be read
or parsed has an error instead and harms no other file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from logloom.functions.text import holes_from_braces, level_of, static_token_count, strip, template_id, unescape_braces
from logloom.operators.java_syntax import MARKER, facts
from logloom.schema import Options
from logloom.session import ensure_importable
from logloom.sources.files import Repository

ARG = "struct<kind:string,text:string,direct:string,resolved:string,format:string,concat:array<string>,builder:array<string>,vars:array<string>>"
FACTS = (
    "path string, error string, "
    "calls array<struct<line:int,start:int,receiver:string,method:string,scope_id:int,class_id:int,class_name:string,method_name:string,in_method:boolean,"
    f"enclosing:array<string>,path:array<string>,args:array<{ARG}>,format:string,builder:array<string>>>, "
    "scopes array<struct<scope_id:int,kind:string,class_id:int,class_name:string,method_name:string>>, "
    "stmts array<struct<scope_id:int,seq:int,line:int,uses:array<string>,defs:array<struct<var:string,pattern:string>>,path:array<string>>>, "
    "params array<struct<scope_id:int,name:string>>, fields array<struct<class_id:int,name:string,constant:boolean,pattern:string>>"
)
#: What counts as a logging call, and what the message rule accepts.
LOGGERS, MORE_LOGGERS = ("log", "logger", "LOG", "LOGGER"), ("log4j", "slf4j")
METHODS, MORE_METHODS = ("trace", "debug", "info", "warn", "error", "log"), ("fatal", "print", "println")


def java_facts(files: DataFrame) -> DataFrame:
    """``files``: path and content (binary or text). Files are dealt by path first, as one split of the input may hold very many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    source = content if isinstance(content, str) else bytes(content or b"").decode("utf-8")
                    rows.append({"path": path, "error": None, **facts(source)})
                except Exception as e:  # noqa: BLE001  one bad file is one error row
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}", "calls": [], "scopes": [], "stmts": [], "params": [], "fields": []})
            yield pd.DataFrame(rows, columns=["path", "error", "calls", "scopes", "stmts", "params", "fields"])

    ensure_importable(files.sparkSession)
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "content").repartition(tasks, "path").mapInPandas(run, FACTS)


def cached_facts(files: DataFrame, cache: str) -> DataFrame:
    """``java_facts`` of ``files``, parsing only contents that the Parquet table at ``cache`` lacks; their facts are added to it."""
    spark = files.sparkSession
    keyed = files.withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))
    try:
        known = spark.read.parquet(cache).select("hash")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = keyed.select("hash").limit(0)
    new = keyed.join(known, "hash", "left_anti").dropDuplicates(["hash"]).select(F.col("hash").alias("path"), "content")
    java_facts(new).withColumnRenamed("path", "hash").write.mode("append").parquet(cache)
    return keyed.select("path", "hash").join(spark.read.parquet(cache).dropDuplicates(["hash"]), "hash").drop("hash")


def relation(found: DataFrame, name: str) -> DataFrame:
    return found.select("path", F.explode(name).alias("r")).select("path", "r.*")


def message_argument() -> Column:
    """log with four arguments: the fourth; a name before a message: the second (a marker); otherwise the first."""
    args, n = F.col("args"), F.size("args")
    kind = lambda i: F.get(args, F.lit(i))["kind"]
    marked = F.col("method").isin("trace", "debug", "info", "warn", "error") & (n >= 2) & (kind(0) == "name") & kind(1).isin("string", "binary", "call")
    return F.when((F.col("method") == "log") & (n >= 4), F.get(args, F.lit(3))).when(marked, F.get(args, F.lit(1))).otherwise(F.get(args, F.lit(0)))


# Rules: calls -> (call columns, pattern) ---------------------------------------------------------------------------------------------
def message_rule(calls: DataFrame, options: Options = Options()) -> DataFrame:
    """Message texts of plain logging calls; a message that is a name is left to slicing."""
    text = F.col("message.resolved" if options.nested_format == "resolve" else "message.direct")
    found = calls.where(F.col("receiver").isin(*LOGGERS) & F.col("method").isin(*METHODS)).withColumn("pattern", text)
    found = found.where((F.col("pattern") != "") & (F.col("pattern") != MARKER)).withColumn("pattern", unescape_braces("pattern"))
    return found.withColumn("pattern", holes_from_braces("pattern")) if options.placeholders == "star" else found


def format_rule(calls: DataFrame, options: Options = Options()) -> DataFrame:
    """Format strings of String.format, wherever it is called."""
    return calls.withColumn("pattern", F.col("format")).where("pattern is not null")


def concatenation_rule(calls: DataFrame, options: Options = Options()) -> DataFrame:
    """Concatenations given as an argument; parts are joined by spaces."""
    parts = calls.withColumn("part", F.explode("args")).where("part.concat is not null")
    return parts.withColumn("pattern", F.array_join("part.concat", " ")).drop("part")


def builder_rule(calls: DataFrame, options: Options = Options()) -> DataFrame:
    """StringBuilder chains given as an argument; parts are joined by spaces."""
    parts = calls.withColumn("part", F.explode("args")).where("part.builder is not null")
    return parts.withColumn("pattern", F.array_join("part.builder", " ")).drop("part")


Rule = Callable[[DataFrame, Options], DataFrame]
RULES: dict[str, Rule] = {"message": message_rule, "format": format_rule, "concatenation": concatenation_rule, "builder": builder_rule}
#: The rules that extraction applies to logging calls.
DIRECT = ["message"]


def register_rule(name: str, rule: Rule, direct: bool = True) -> None:
    """Adds a rule: a function of logging calls that returns those it handles with a ``pattern``."""
    RULES[name] = rule
    if direct and name not in DIRECT:
        DIRECT.append(name)


def unregister_rule(name: str) -> None:
    del RULES[name]
    if name in DIRECT:
        DIRECT.remove(name)


def direct_templates(calls: DataFrame, options: Options = Options()) -> DataFrame:
    """Templates of all direct rules; ``level`` is the method's name where it is a level."""
    keep = ["path", "start", "line", "class_name", "method_name", "method"]
    out = None
    for name in DIRECT:
        part = RULES[name](calls, options).where(strip("pattern") != "").select(*keep, "pattern")
        out = part if out is None else out.unionByName(part)
    return out.withColumns({"level": level_of("method"), "variant": F.lit(0)}).drop("method")


# Slicing -----------------------------------------------------------------------------------------------------------------------------
def message_uses(calls: DataFrame) -> DataFrame:
    """(call, variable) of messages that need slicing: none for a literal with ``{}`` and more."""
    first = F.get("args", F.lit(0))
    braces = (first["kind"] == "string") & F.contains(first["text"], F.lit("{}")) & (F.length(F.regexp_replace(first["text"], r"""^["']+|["']+$""", "")) > 2)
    wanted = calls.where(~F.coalesce(braces, F.lit(False)))
    return wanted.select("path", "start", "line", "scope_id", "class_id", "class_name", "method_name", "branch", F.explode("message.vars").alias("var"))


def definitions(stmts: DataFrame) -> DataFrame:
    """Definitions of the one statement of each line: the last to begin there."""
    last = Window.partitionBy("path", "scope_id", "line").orderBy(F.desc("seq"))
    kept = stmts.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
    return kept.select("path", "scope_id", F.col("line").alias("def_line"), "uses", F.col("r_path").alias("def_path"), F.explode("defs").alias("d")).select("path", "scope_id", "def_line", "uses", "def_path", F.col("d.var").alias("var"), F.col("d.pattern").alias("pattern"))


def parted(a: Column, b: Column) -> Column:
    """Whether two branch paths lie in different arms of one statement."""
    arms = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: z["x"] != z["y"])
    first = F.get(arms, F.lit(0))
    return F.coalesce(F.split(first["x"], ":")[0] == F.split(first["y"], ":")[0], F.lit(False))


def inside(outer: Column, inner: Column) -> Column:
    return F.slice(inner, F.lit(1), F.size(outer)) == outer


def reaching(uses: DataFrame, defs: DataFrame, options: Options) -> DataFrame:
    """Definitions that reach a use (path, scope_id, var, line, branch): as-of join on the line.

    Observed: the last one up to the line. Branches: that of the last one which every way to the use passes, and all later ones that do
    not lie in another arm.
    """
    pairs = uses.join(defs, ["path", "scope_id", "var"]).where("def_line <= line")
    key = ["path", "scope_id", "var", "line", "start", "target"]
    if options.slice_mode != "branches":
        last = pairs.groupBy(*key).agg(F.max("def_line").alias("def_line"), F.max_by("uses", "def_line").alias("uses"), F.max_by("def_path", "def_line").alias("def_path"))
        return last
    pairs = pairs.where(~parted(F.col("def_path"), F.col("branch")))
    sure = pairs.groupBy(*key).agg(F.max(F.when(inside(F.col("def_path"), F.col("branch")), F.col("def_line"))).alias("sure"))
    kept = pairs.join(sure, key).where("sure is null or def_line >= sure")
    return kept.select(*key, "def_line", "uses", "def_path").distinct()


def kept(rows: DataFrame) -> DataFrame:
    """``rows``, computed once: in the shared folder where the session names one (lineage ends there), cached otherwise."""
    if rows.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir"):
        return rows.checkpoint()
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def sliced_templates(found: DataFrame, calls: DataFrame, direct: DataFrame, options: Options = Options()) -> DataFrame:
    """Templates of calls without a direct one: patterns of the definitions that their message's variables may have."""
    rest = calls.join(direct.select("path", "start").distinct(), ["path", "start"], "left_anti")
    branched = rest.withColumn("branch", F.col("r_path"))
    wanted = message_uses(branched)
    defs = kept(definitions(relation_with_branch(found, "stmts")))
    # Closure of (variable, line) pairs from each message's variable: a loop over its (short) depth.
    key = ["path", "scope_id", "start", "target", "var", "line"]
    frontier = wanted.select("path", "scope_id", "start", F.col("var").alias("target"), "var", "line", "branch").distinct()
    seen = kept(frontier.select(*key))
    slices = None
    while True:
        step = kept(reaching(frontier, defs, options))
        part = step.select("path", "scope_id", "start", "target", "def_line")
        slices = part if slices is None else slices.unionByName(part)
        after = step.select("path", "scope_id", "start", "target", F.explode("uses").alias("var"), F.col("def_line").alias("line"), F.col("def_path").alias("branch")).distinct()
        # Only variables that are defined in the scope can go further.
        after = after.join(defs.select("path", "scope_id", "var").distinct(), ["path", "scope_id", "var"], "left_semi")
        after = kept(after.join(seen, key, "left_anti"))
        if after.isEmpty():
            break
        seen = kept(seen.unionByName(after.select(*key)))
        frontier = after
    hit = slices.distinct().join(defs.where("pattern is not null").select("path", "scope_id", "def_line", F.col("var").alias("target"), "pattern"), ["path", "scope_id", "def_line", "target"])
    order = Window.partitionBy("path", "scope_id", "start", "target").orderBy("def_line")
    hit = hit.withColumn("variant", F.row_number().over(order) - 1)
    site = wanted.withColumnRenamed("var", "target").drop("branch").distinct()
    from_slices = site.join(hit, ["path", "scope_id", "start", "target"]).drop("def_line")
    none = site.join(hit.select("path", "scope_id", "start", "target").distinct(), ["path", "scope_id", "start", "target"], "left_anti")
    params = relation(found, "params").select("path", "scope_id", F.col("name").alias("target"), F.lit(True).alias("is_param")).distinct()
    fields = relation(found, "fields").groupBy("path", "class_id", F.col("name").alias("target")).agg(F.max("constant").alias("constant"), F.first("pattern", True).alias("value"))
    named = none.join(params, ["path", "scope_id", "target"], "left").join(fields, ["path", "class_id", "target"], "left")
    mark = lambda kind: F.concat(F.lit(f"<{kind}:"), F.col("target"), F.lit(">"))
    fallback = F.when(F.col("is_param"), mark("param")).when(F.col("constant"), F.coalesce("value", mark("const"))).otherwise("<*>")
    from_names = named.withColumn("pattern", fallback).withColumn("variant", F.lit(0))
    columns = ["path", "start", "line", "class_name", "method_name", "pattern", "variant"]
    both = from_slices.select(*columns, "target").unionByName(from_names.select(*columns, "target")).where(strip("pattern") != "")
    return both.withColumn("level", F.lit("unknown"))


def relation_with_branch(found: DataFrame, name: str) -> DataFrame:
    """A relation whose rows have a branch path of their own, named r_path."""
    rows = found.select("path", F.explode(name).alias("r"))
    fields = [f for f in found.schema[name].dataType.elementType.names if f != "path"]
    return rows.select("path", *[F.col(f"r.{f}").alias(f) for f in fields], F.col("r.path").alias("r_path"))


def as_templates(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Template rows in order of place, at most ``max_branch_variants`` for each place (those with most static tokens first)."""
    static = static_token_count("pattern").alias("static_token_count")
    place = F.struct(F.col("path").alias("file_path"), "class_name", "method_name", F.col("line").cast("int").alias("line_number"))
    out = rows.select(template_id("path", "line", "pattern", "variant").alias("template_id"), "pattern", static, place.alias("location"), "level", F.col("variant").cast("int").alias("branch_variant"), "start", "target")
    at = ["location.file_path", "location.class_name", "location.method_name", "location.line_number"]
    limit = Window.partitionBy(*at).orderBy(F.desc("static_token_count"), "start", "target", "branch_variant")
    return out.withColumn("n", F.row_number().over(limit)).where(F.col("n") <= options.max_branch_variants).drop("n", "start", "target")


def extract_templates(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Templates of all logging calls of ``files`` (path, content)."""
    return templates_of(java_facts(files).persist(StorageLevel.MEMORY_AND_DISK), options)


def templates_of(found: DataFrame, options: Options = Options()) -> DataFrame:
    calls = logging_calls(found, options)
    direct = direct_templates(calls, options)
    sliced = sliced_templates(found, calls, direct, options)
    return as_templates(direct.withColumn("target", F.lit("")).unionByName(sliced), options)


def logging_calls(found: DataFrame, options: Options = Options()) -> DataFrame:
    """Logging calls with their message argument, one row for each call (or, without ``dedupe``, for each enclosing class and method)."""
    calls = relation_with_branch(found, "calls")
    calls = calls.where(F.col("receiver").isin(*LOGGERS, *MORE_LOGGERS) & F.col("method").isin(*METHODS, *MORE_METHODS))
    if not options.include_constructors:
        calls = calls.where("in_method")
    if not options.dedupe:
        calls = calls.withColumn("class_name", F.explode(F.when(F.size("enclosing") > 0, F.col("enclosing")).otherwise(F.array("class_name"))))
    return calls.withColumn("message", message_argument())


def all_calls(found: DataFrame) -> DataFrame:
    """Every method call of the files, for rules that are not about logging."""
    return relation_with_branch(found, "calls").withColumn("message", message_argument())


def errors(found: DataFrame) -> DataFrame:
    return found.where("error is not null").select("path", "error")


def extract_repository(spark: SparkSession, root: str, include=None, exclude=None, options: Options = Options(), partitions: int | None = None, cache: str | None = None) -> DataFrame:
    """Templates of a source tree. With ``cache`` only files whose content is new are parsed."""
    files = Repository(spark, root, include, exclude).files()
    files = files.repartition(partitions) if partitions else files
    return templates_of(cached_facts(files, cache).persist(StorageLevel.MEMORY_AND_DISK), options) if cache else extract_templates(files, options)

