"""Queries over Java sources rendered from ``part``: one small class for each row, its shape by ``p_partkey % 6``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import text
from logloom.operators import extract as X
from logloom.plans.rendered import table
from logloom.schema import Options
from logloom.sources.files import good_templates

HEAD = "'public class P' || CAST(p_partkey AS STRING) || ' {' || chr(10) || '    private static final String FIXED = \"Fixed ' || p_brand || '\";' || chr(10) || '    public void work(String name, int size, String message) {' || chr(10) || "
BODIES = (
    "'        log.info(\"Part {} made by ' || p_brand || '\", name);' || chr(10)",
    "'        String msg = \"Type ' || p_type || ' size \" + size;' || chr(10) || '        logger.warn(msg);' || chr(10)",
    "'        String msg = String.format(\"Part %s costs %.2f ' || p_brand || '\",' || chr(10) || '            name, size);' || chr(10) || '        log.debug(msg);' || chr(10)",
    "'        String msg;' || chr(10) || '        if (size > ' || CAST(p_size AS STRING) || ') {' || chr(10) || '            msg = \"Large ' || p_brand || ' \" + name;' || chr(10) || '        } else {' || chr(10) || '            msg = \"Small ' || p_brand || ' \" + name;' || chr(10) || '        }' || chr(10) || '        log.info(msg);' || chr(10)",
    "'        log.error(message);' || chr(10) || '        log.info(FIXED);' || chr(10) || '        log.info(\"Size \" + size + \" of ' || p_type || '\");' || chr(10)",
    "'        String m = \"first ' || p_brand || '\";' || chr(10) || '        String v = m + \"second\";' || chr(10) || '        m = v + \"third\";' || chr(10) || '        LOG.info(m);' || chr(10)",
)
SOURCE = HEAD + "CASE CAST(p_partkey % 6 AS INTEGER) " + " ".join(f"WHEN {k} THEN {b}" for k, b in enumerate(BODIES)) + " END || '    }' || chr(10) || '}' || chr(10)"
PATH = "'src/P' || CAST(p_partkey AS STRING) || '.java'"
#: shape, pattern, line, level, variant as SQL: what each shape must give.
EXPECTED = (
    (0, "'Part <*> made by ' || p_brand", 4, "info", 0),
    (1, "'Type ' || p_type || ' size  <*>'", 5, "unknown", 0),
    (2, "'Part <*> costs <*> ' || p_brand", 6, "unknown", 0),
    (3, "'Small ' || p_brand || '  <*>'", 10, "unknown", 0),
    (4, "'<param:message>'", 4, "unknown", 0),
    (4, "'Fixed ' || p_brand", 5, "unknown", 0),
    (4, "'Size <*> of ' || p_type", 6, "info", 0),
    (5, "'first ' || p_brand", 7, "unknown", 0),
    (5, "'<*> third'", 7, "unknown", 1),
)
BRANCHES = tuple(x for x in EXPECTED if x[0] != 3) + ((3, "'Large ' || p_brand || '  <*>'", 10, "unknown", 0), (3, "'Small ' || p_brand || '  <*>'", 10, "unknown", 1))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.expr(PATH).alias("path"), F.expr(SOURCE.replace("chr(10)", "char(10)")).alias("content"))


def flat(templates: DataFrame) -> DataFrame:
    at = F.col("location")
    return templates.select("template_id", "pattern", F.col("static_token_count").alias("static_tokens"), at["file_path"].alias("file_path"), at["class_name"].alias("class_name"),
        at["method_name"].alias("method_name"), at["line_number"].alias("line_number"), "level", "branch_variant")


def expected(rows=EXPECTED) -> str:
    parts = [f"SELECT {PATH} AS file_path, 'P' || CAST(p_partkey AS STRING) AS class_name, {p} AS pattern, {n} AS line_number, '{level}' AS level, {v} AS branch_variant FROM part WHERE p_partkey % 6 = {k}" for k, p, n, level, v in rows]
    return f"""SELECT substr(md5(file_path || ':' || line_number || ':' || pattern || ':' || branch_variant), 1, 16) AS template_id, pattern,
  CAST(len(list_filter(regexp_extract_all(pattern, '\\S+'), lambda x: x <> '<*>')) AS INTEGER) AS static_tokens, file_path, class_name, 'work' AS method_name, line_number, level, branch_variant
  FROM ({' UNION ALL '.join(parts)}) e"""


Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


@query("extract_templates", expected())
def extract_templates(spark, sf_dir):
    return flat(X.extract_templates(files(spark, sf_dir)))


@query("extract_branches", expected(BRANCHES))
def extract_branches(spark, sf_dir):
    return flat(X.extract_templates(files(spark, sf_dir), Options(slice_mode="branches")))


@query("extract_one_variant", expected(tuple(x for x in EXPECTED if x[4] == 0)))
def extract_one_variant(spark, sf_dir):
    return flat(X.extract_templates(files(spark, sf_dir), Options(max_branch_variants=1)))


@query("extract_raw_placeholders", expected(tuple((0, "'Part {} made by ' || p_brand", 4, "info", 0) if x[0] == 0 else x for x in EXPECTED)))
def extract_raw_placeholders(spark, sf_dir):
    return flat(X.extract_templates(files(spark, sf_dir), Options(placeholders="raw")))


@query("logging_calls", f"SELECT {PATH} AS path, k.line AS line, k.receiver AS receiver, k.method AS method FROM part JOIN (VALUES (0, 4, 'log', 'info'), (1, 5, 'logger', 'warn'), (2, 6, 'log', 'debug'), (3, 10, 'log', 'info'), (4, 4, 'log', 'error'), (4, 5, 'log', 'info'), (4, 6, 'log', 'info'), (5, 7, 'LOG', 'info')) k(shape, line, receiver, method) ON p_partkey % 6 = k.shape")
def logging_calls(spark, sf_dir):
    return X.logging_calls(X.java_facts(files(spark, sf_dir))).select("path", "line", "receiver", "method")


@query("format_rule", f"SELECT {PATH} AS path, 'Part <*> costs <*> ' || p_brand AS pattern FROM part WHERE p_partkey % 6 = 2")
def format_rule(spark, sf_dir):
    return X.format_rule(X.all_calls(X.java_facts(files(spark, sf_dir)))).select("path", "pattern")


@query("concatenation_rule", f"SELECT {PATH} AS path, 'Size  <*>  of ' || p_type AS pattern FROM part WHERE p_partkey % 6 = 4")
def concatenation_rule(spark, sf_dir):
    return X.concatenation_rule(X.all_calls(X.java_facts(files(spark, sf_dir)))).select("path", "pattern")


@query("method_parameters", f"SELECT {PATH} AS path, n.name AS name FROM part, (VALUES ('name'), ('size'), ('message')) n(name)")
def method_parameters(spark, sf_dir):
    return X.relation(X.java_facts(files(spark, sf_dir)), "params").select("path", "name")


@query("class_constants", f"SELECT {PATH} AS path, 'FIXED' AS name, 'Fixed ' || p_brand AS pattern FROM part")
def class_constants(spark, sf_dir):
    return X.relation(X.java_facts(files(spark, sf_dir)), "fields").where("constant").select("path", "name", "pattern")


# Further shapes: builders, lambdas, nested classes, method calls, concatenated format strings, two statements on a line -------------------
MORE_BODIES = (
    "'        log.info(new StringBuilder(\"Stock of \").append(name).append(\" at ' || p_brand || '\").toString());' || chr(10)",
    "'        run(() -> {' || chr(10) || '            String q = \"lambda ' || p_brand || '\";' || chr(10) || '            log.info(q);' || chr(10) || '        });' || chr(10)",
    "'        log.warn(\"outer {} ' || p_brand || '\", name);' || chr(10) || '    }' || chr(10) || '    class Inner {' || chr(10) || '        void go(int n) {' || chr(10) || '            log.warn(\"inner {} ' || p_brand || '\", n);' || chr(10) || '        }' || chr(10)",
    "'        log.debug(name.trim());' || chr(10) || '        String t = helper(size);' || chr(10) || '        log.error(t);' || chr(10)",
    "'        String m = String.format(\"Part %s \" + \"kept %d days by \" + \"' || p_brand || '\", name, size);' || chr(10) || '        log.info(m);' || chr(10)",
    "'        String a = \"one ' || p_brand || '\"; String b = \"two ' || p_brand || '\";' || chr(10) || '        log.info(b);' || chr(10) || '        log.info(a);' || chr(10)",
)
MORE_SOURCE = HEAD + "CASE CAST(p_partkey % 6 AS INTEGER) " + " ".join(f"WHEN {k} THEN {b}" for k, b in enumerate(MORE_BODIES)) + " END || '    }' || chr(10) || '}' || chr(10)"
#: shape, pattern, line, level, class, method.
MORE_EXPECTED = (
    (0, "'Stock of <*> at ' || p_brand", 4, "info", None, "work"),
    (1, "'lambda ' || p_brand", 6, "unknown", None, "work"),
    (2, "'outer <*> ' || p_brand", 4, "warn", None, "work"),
    (2, "'inner <*> ' || p_brand", 8, "warn", "Inner", "go"),
    (3, "'<method:trim()>'", 4, "debug", None, "work"),
    (3, "'<method:helper()>'", 6, "unknown", None, "work"),
    (4, "'Part <*> kept <*> days by ' || p_brand", 5, "unknown", None, "work"),
    (5, "'two ' || p_brand", 5, "unknown", None, "work"),
    (5, "'<*>'", 6, "unknown", None, "work"),
)


def more_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.expr(PATH).alias("path"), F.expr(MORE_SOURCE.replace("chr(10)", "char(10)")).alias("content"))


def more_expected() -> str:
    own = "'P' || CAST(p_partkey AS STRING)"
    parts = [f"SELECT {PATH} AS file_path, {own if c is None else repr(c)} AS class_name, '{m}' AS method_name, {p} AS pattern, {n} AS line_number, '{level}' AS level FROM part WHERE p_partkey % 6 = {k}" for k, p, n, level, c, m in MORE_EXPECTED]
    return " UNION ALL ".join(parts)


@query("extract_more_shapes", more_expected())
def extract_more_shapes(spark, sf_dir):
    return flat(X.extract_templates(more_files(spark, sf_dir))).select("file_path", "class_name", "method_name", "pattern", "line_number", "level")


@query("builder_rule", f"SELECT {PATH} AS path, 'Stock of  <*>  at ' || p_brand AS pattern FROM part WHERE p_partkey % 6 = 0")
def builder_rule(spark, sf_dir):
    return X.builder_rule(X.all_calls(X.java_facts(more_files(spark, sf_dir)))).select("path", "pattern")


# Shapes of calls that the message rule passes over, special method names, blank messages, methods outside classes ------------------------
ODD_BODIES = (
    "'        log.info(addPrefix(\"kept ' || p_brand || '\"));' || chr(10) || '        log.warn(ex.getMessage());' || chr(10) || '        log.info(format(name));' || chr(10)",
    "'        StringBuilder sb = new StringBuilder();' || chr(10) || '        String m = sb.toString();' || chr(10) || '        log.warn(m);' || chr(10)",
    "'        log4j.fatal(wrap(name, join(size)));' || chr(10)",
    "'        log.fatal(join(name, size, name));' || chr(10)",
    "'        log.info(\"\");' || chr(10) || '        log.info(\"kept ' || p_brand || '\");' || chr(10)",
    "'    }' || chr(10) || '}' || chr(10) || 'interface Duty {' || chr(10) || '    default void go(int n) {' || chr(10) || '        log.info(\"free {} ' || p_brand || '\", n);' || chr(10)",
)
ODD_SOURCE = HEAD + "CASE CAST(p_partkey % 6 AS INTEGER) " + " ".join(f"WHEN {k} THEN {b}" for k, b in enumerate(ODD_BODIES)) + " END || '    }' || chr(10) || '}' || chr(10)"
#: shape, pattern, line, level, method, whether in a class.
ODD_EXPECTED = (
    (0, "'<method:addPrefix(kept ' || p_brand || ')>'", 4, "info", "work", True),
    (0, "'<method:getMessage(<*>)>'", 5, "warn", "work", True),
    (0, "'<method:format(<*>)>'", 6, "info", "work", True),
    (1, "'<*>'", 6, "unknown", "work", True),
    (2, "'<param:name>'", 4, "unknown", "work", True),
    (2, "'<param:size>'", 4, "unknown", "work", True),
    (3, "'<param:name>'", 4, "unknown", "work", True),
    (3, "'<param:size>'", 4, "unknown", "work", True),
    (4, "'kept ' || p_brand", 5, "info", "work", True),
    (5, "'free <*> ' || p_brand", 8, "info", "go", False),
)


def odd_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.expr(PATH).alias("path"), F.expr(ODD_SOURCE.replace("chr(10)", "char(10)")).alias("content"))


def odd_expected(rows=ODD_EXPECTED) -> str:
    own = "'P' || CAST(p_partkey AS STRING)"
    return " UNION ALL ".join(f"SELECT {PATH} AS file_path, {own if c else 'CAST(NULL AS VARCHAR)'} AS class_name, '{m}' AS method_name, {p} AS pattern, {n} AS line_number, '{level}' AS level FROM part WHERE p_partkey % 6 = {k}" for k, p, n, level, m, c in rows)


@query("extract_odd_shapes", odd_expected())
def extract_odd_shapes(spark, sf_dir):
    return flat(X.extract_templates(odd_files(spark, sf_dir))).select("file_path", "class_name", "method_name", "pattern", "line_number", "level")


#: With a rule for fatal calls, these are no longer left to slicing.
FATAL = tuple(x for x in ODD_EXPECTED if x[0] not in (2, 3)) + ((2, "'fatal by log4j'", 4, "fatal", "work", True), (3, "'fatal by log'", 4, "fatal", "work", True))


@query("registered_rule", odd_expected(FATAL))
def registered_rule(spark, sf_dir):
    """A user's rule beside the built-in ones: fatal calls give their logger's name."""
    fatal = lambda calls, options: calls.where("method = 'fatal'").withColumn("pattern", F.concat(F.lit("fatal by "), F.col("receiver")))
    X.register_rule("fatal", fatal)
    try:
        return extract_odd_shapes(spark, sf_dir)
    finally:
        X.unregister_rule("fatal")


@query("extraction_errors", f"SELECT {PATH} AS path, 'UnicodeDecodeError' AS error FROM part WHERE p_partkey % 7 = 0")
def extraction_errors(spark, sf_dir):
    """Every seventh file is no UTF-8: an error row for it, none for the others, whose templates are not harmed."""
    bad = files(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.expr(PATH).alias("path"), "p_partkey"), "path")
    bytes_of = F.when(F.col("p_partkey") % 7 == 0, F.lit(bytearray(b"\xff\xfe\x00class"))).otherwise(F.col("content").cast("binary"))
    return X.errors(X.java_facts(bad.select("path", bytes_of.alias("content")))).select("path", F.split("error", ":")[0].alias("error"))


@query("template_rows", f"SELECT 'x' || p_partkey AS template_id, 'Part <*> ' || p_brand AS pattern, {PATH} AS file_path, CAST(p_size AS INTEGER) AS line_number, 'info' AS level, 0 AS branch_variant FROM part WHERE p_partkey % 5 NOT IN (0, 1, 2)")
def template_rows(spark, sf_dir):
    """JSON lines with blank, broken and mistyped rows among them: the good ones are read."""
    row = F.to_json(F.struct(F.expr("concat('x', p_partkey)").alias("template_id"), F.expr("concat('Part <*> ', p_brand)").alias("pattern"), F.lit(2).alias("static_token_count"),
        F.struct(F.expr(PATH).alias("file_path"), F.col("p_size").alias("line_number")).alias("location"), F.when(F.col("p_partkey") % 5 == 2, "loud").otherwise("info").alias("level")))
    lines = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 5 == 0, " ").when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("{"), row)).otherwise(row).alias("value"))
    return good_templates(lines).select("template_id", "pattern", "location.file_path", "location.line_number", "level", "branch_variant")


@query("display_texts", f"SELECT p_partkey, CASE WHEN length(p_name) > 10 THEN substr(p_name, 1, 10) || '...' ELSE p_name END AS cut, regexp_extract({PATH}, '[^/]*$') AS name FROM part")
def display_texts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.shortened("p_name", 10).alias("cut"), text.basename(F.expr(PATH)).alias("name"))


# Slicing on facts that are given as a table: definitions and uses from lineitem ------------------------------------------------------
@query("reaching_definitions", """WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber % 2 = 1), u AS (SELECT l_orderkey, l_linenumber FROM lineitem)
SELECT u.l_orderkey, u.l_linenumber, max(d.l_linenumber) AS def_line FROM u JOIN d ON u.l_orderkey = d.l_orderkey AND d.l_linenumber <= u.l_linenumber GROUP BY 1, 2""")
def reaching_definitions(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    key = F.lit("x").alias("path"), F.col("l_orderkey").alias("scope_id"), F.lit("v").alias("var")
    none = F.array().cast("array<string>")
    uses = items.select(*key, F.col("l_linenumber").alias("line"), F.lit(0).alias("start"), F.lit("v").alias("target"), none.alias("branch"))
    defs = items.where("l_linenumber % 2 = 1").select(*key, F.col("l_linenumber").alias("def_line"), none.alias("uses"), none.alias("def_path"))
    found = X.reaching(uses, defs, Options())
    return found.select(F.col("scope_id").alias("l_orderkey"), F.col("line").alias("l_linenumber"), "def_line")
