"""The build side of matching: templates with their tokens, anchors and regular expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import tokens
from logloom.schema import WILDCARD, Options

#: A hole takes one token or more; lazily, so that the first derivation is the one found. Tokens are joined by single spaces.
HOLE, PART_HOLE = r"([^ ](?:.*?[^ ])??)", r"([^ ]+?)"
ESCAPED = r"([\\.\[\]{}()*+?^$|])"


def with_order(templates: DataFrame) -> DataFrame:
    """``ins_idx``: the order of insertion; rows without one keep the order in which they are read."""
    return templates if "ins_idx" in templates.columns else templates.withColumn("ins_idx", F.monotonically_increasing_id())


def build(templates: DataFrame, options: Options = Options()) -> DataFrame:
    """Templates with tokens, their kinds (0 static, 1 hole within a token, 2 hole), number of holes, anchor key and regex."""
    star = F.lit(WILDCARD)
    kind = lambda t: F.when(t == star, 2).when(F.lit(options.intra_token) & F.contains(t, star), 1).otherwise(0)
    escaped = lambda t: F.regexp_replace(t, ESCAPED, r"\\$1")
    inside = lambda t: F.array_join(F.transform(F.split(t, r"<\*>", -1), escaped), PART_HOLE)
    piece = lambda t: F.when(kind(t) == 2, HOLE).when(kind(t) == 1, inside(t)).otherwise(escaped(t))
    found = with_order(templates).withColumn("tokens", tokens("pattern")).withColumn("p", F.size("tokens")).withColumn("kinds", F.transform("tokens", kind))
    holes = F.aggregate("tokens", F.lit(0), lambda a, t: a + F.when(kind(t) == 0, 0).when(kind(t) == 2, 1).otherwise(F.size(F.split(t, r"<\*>", -1)) - 1))
    # Holes before each token.
    count = lambda a, t: a + F.when(kind(t) == 0, 0).when(kind(t) == 2, 1).otherwise(F.size(F.split(t, r"<\*>", -1)) - 1)
    before = F.transform("tokens", lambda t, i: F.aggregate(F.slice(F.col("tokens"), F.lit(1), i), F.lit(0), count))
    tail = "(?: .*)?$" if options.allow_trailing else "$"
    regex = F.concat(F.lit("(?s)^"), F.array_join(F.transform("tokens", piece), " "), F.lit(tail))
    first, last = F.get("tokens", F.lit(0)), F.element_at("tokens", -1)
    static = lambda i: F.get("kinds", F.lit(i)) == 0
    key = F.when(static(0) & (F.col("p") > 1) & static(1), F.concat(F.lit("2 "), first, F.lit(" "), F.get("tokens", F.lit(1)))).when(static(0), F.concat(F.lit("1 "), first))
    if not options.allow_trailing:
        key = key.when(F.element_at("kinds", -1) == 0, F.concat(F.lit("L "), last))
    return found.where("p > 0").withColumn("holes", holes).withColumn("hole_at", before).withColumn("regex", regex).withColumn("token_regexes", F.transform("tokens", lambda t: F.concat(F.lit("^"), inside(t), F.lit("$")))).withColumn("key", key.otherwise("*"))


def patterns(built: DataFrame) -> DataFrame:
    """One row for each different pattern, stored count and level: the first inserted stands for its equals in best matching."""
    first = F.min_by(F.struct("template_id", "location", "branch_variant", "ins_idx"), "ins_idx").alias("first")
    same = ["pattern", "static_token_count", "level", "p", "holes", "regex", "key"]
    return built.groupBy(*same).agg(first, F.first("kinds").alias("kinds"), F.first("hole_at").alias("hole_at")).select(*same, "kinds", "hole_at", "first.*")


def edges(built: DataFrame) -> DataFrame:
    """The prefix tree as a relation: (node, token, child), where a node is the text of its path."""
    path = lambda n: F.array_join(F.slice("tokens", 1, n), " ")
    steps = built.select("tokens", F.posexplode("tokens").alias("at", "token"))
    return steps.select(path(F.col("at")).alias("node"), "token", path(F.col("at") + 1).alias("child")).distinct()
