"""Matching log lines to templates as anchored equi-joins.

A full match must agree with a template's first two tokens, its first, or its last, if those are static. So every template has one anchor
key, every line has four possible ones, and the candidates come from one broadcast hash join on the key; only templates
with holes at both ends are tried on every line. Candidates are verified by the template's regular expression. The best match is chosen within the line's row, so lines are not shuffled.

The template side is broadcast while it has at most ``BROADCAST_TEMPLATES`` different patterns (checked); beyond that the same join is
shuffled by key, where adaptive execution splits a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.functions.text import confidence, strip, tokens
from logloom.operators.templates import build, patterns
from logloom.schema import Options, line_key

BROADCAST_TEMPLATES = 100_000


def prepared(lines: DataFrame, message: str = "message") -> DataFrame:
    """Lines with their normalised text, tokens, number of tokens and possible anchor keys."""
    out = lines.withColumn("l_tokens", tokens(F.coalesce(strip(message), F.lit(""))))
    out = out.withColumn("n", F.size("l_tokens")).withColumn("norm", F.array_join("l_tokens", " "))
    first, second, last = F.get("l_tokens", F.lit(0)), F.get("l_tokens", F.lit(1)), F.get("l_tokens", F.col("n") - 1)
    keys = F.array(F.lit("*"), F.concat(F.lit("1 "), first), F.concat(F.lit("2 "), first, F.lit(" "), second), F.concat(F.lit("L "), last))
    return out.withColumn("keys", F.when(F.col("n") > 0, F.filter(keys, lambda k: k.isNotNull())).otherwise(F.array().cast("array<string>")))


def level_passes(line_level: Column, template_level: Column) -> Column:
    """Case-insensitive; a line without level, and a template of unknown level, pass."""
    return line_level.isNull() | (line_level == "") | (template_level == "unknown") | (F.lower(line_level) == F.lower(template_level))


def template_side(built: DataFrame) -> DataFrame:
    return F.broadcast(built) if built.limit(BROADCAST_TEMPLATES + 1).count() <= BROADCAST_TEMPLATES else built


def candidates(lines: DataFrame, side: DataFrame, how: str, use_level: bool) -> DataFrame:
    """Lines with the templates of which they have the anchor and the regex."""
    generate = F.explode_outer if how == "left" else F.explode
    keyed = lines.select("*", generate("keys").alias("l_key")).drop("keys")
    right = side.withColumnRenamed("level", "t_level")
    test = (F.col("l_key") == F.col("key")) & (F.col("n") >= F.col("p")) & F.regexp_like("norm", F.col("regex"))
    if use_level and "level" in lines.columns:
        test = test & level_passes(F.col("level"), F.col("t_level"))
    return keyed.join(right, test, how)


def captures(most: int) -> Column:
    """Captured values of the first derivation, from the regex; ``most`` is the largest number of holes."""
    got = F.array(*[F.when(F.col("holes") >= i, F.call_function("regexp_extract", F.col("norm"), F.col("regex"), F.lit(i))) for i in range(1, most + 1)]) if most else F.array().cast("array<string>")
    return F.slice(got, F.lit(1), F.coalesce("holes", F.lit(0))) if most else got


def step_key(values: str) -> Column:
    """Order of derivations: 0 for a static token, 1 for a hole within a token, 1 + length for a hole."""
    width = lambda h: F.size(F.split(F.get(F.col(values), h), " "))
    return F.zip_with("kinds", "hole_at", lambda k, h: F.when(k == 2, 1 + width(h)).otherwise(k))


def most_holes(built: DataFrame) -> int:
    return built.agg(F.max("holes")).first()[0] or 0


def scored(found: DataFrame) -> DataFrame:
    return found.withColumn("confidence", confidence(F.col("static_token_count"), F.col("n"), F.col("p"), F.col("holes")))


def best_matches(lines: DataFrame, templates: DataFrame, threshold: float = 0.0, use_level: bool = True, options: Options = Options(), keep: str = "left") -> DataFrame:
    """Every line with its best match, or nulls: most static tokens, then confidence, then first derivation, then insertion.

    While the patterns are few enough to be broadcast (counted), lines stay where they are: each anchor's patterns are one row, four
    look-ups bring a line its candidates, and the best is chosen within the row. Beyond that candidates are joined by a shuffle and
    reduced by line. ``lines`` needs ``message`` and ``line_number``, unique (within its ``file``, if that is a column).
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    built = build(templates, options)
    folded = patterns(built)
    if folded.limit(BROADCAST_TEMPLATES + 1).count() <= BROADCAST_TEMPLATES:
        return chosen(prepared(lines), folded, lines.columns, threshold, use_level and "level" in lines.columns, most_holes(built))
    side = folded
    own = lines.columns
    found = scored(candidates(prepared(lines), side, keep, use_level)).withColumn("values", captures(most_holes(built)))
    rank = F.struct(
        (-F.col("static_token_count")).alias("a"), (-F.col("confidence")).alias("b"), step_key("values").alias("c"), F.col("ins_idx").alias("d"),
        F.struct("template_id", "confidence", "pattern", "static_token_count", F.col("t_level").alias("template_level"), "values", "location", "branch_variant").alias("match"),
    )
    good = F.col("template_id").isNotNull() & (F.col("confidence") >= threshold)
    # One row of each line stays without a match: that of the key which every line has.
    found = found.where(F.col("template_id").isNotNull() | F.col("l_key").isNull() | (F.col("l_key") == "*"))
    key = [c for c in ("file", "line_number") if c in own]
    best = found.groupBy(*key).agg(F.first(F.struct(*own)).alias("line"), F.min(F.when(good, rank)).alias("best"))
    return best.select("line.*", "best.match.*")


CANDIDATE = ("pattern", "static_token_count", "level", "p", "holes", "regex", "kinds", "hole_at", "template_id", "location", "branch_variant", "ins_idx")


def chosen(lines: DataFrame, folded: DataFrame, own: list[str], threshold: float, use_level: bool, holes: int) -> DataFrame:
    """Best matches without a shuffle of ``lines``: candidates come as arrays, by anchor."""
    anchors = F.broadcast(folded.groupBy("key").agg(F.collect_list(F.struct(*CANDIDATE)).alias("found")))
    none = F.array().cast(anchors.schema["found"].dataType)
    for k in range(4):
        side = anchors.select(F.col("key").alias("anchor"), F.col("found").alias(f"found_{k}"))
        lines = lines.join(side, F.get("keys", F.lit(k)) == F.col("anchor"), "left").drop("anchor")
    lines = lines.withColumn("found", F.concat(*[F.coalesce(f"found_{k}", none) for k in range(4)]))

    def fits(c: Column) -> Column:
        test = (F.col("n") >= c["p"]) & F.regexp_like("norm", c["regex"]) & (score(c) >= threshold)
        return test & level_passes(F.col("level"), c["level"]) if use_level else test

    def score(c: Column) -> Column:
        return confidence(c["static_token_count"], F.col("n"), c["p"], c["holes"])

    def values(c: Column) -> Column:
        if not holes:
            return F.array().cast("array<string>")
        got = [F.when(c["holes"] >= i, F.call_function("regexp_extract", F.col("norm"), c["regex"], F.lit(i))) for i in range(1, holes + 1)]
        return F.slice(F.array(*got), F.lit(1), c["holes"])

    def rank(x: Column) -> Column:
        c, taken = x["c"], x["values"]
        width = lambda h: F.size(F.split(F.get(taken, h), " "))
        steps = F.zip_with(c["kinds"], c["hole_at"], lambda k, h: F.when(k == 2, 1 + width(h)).otherwise(k))
        match = F.struct(c["template_id"].alias("template_id"), score(c).alias("confidence"), c["pattern"].alias("pattern"), c["static_token_count"].alias("static_token_count"),
            c["level"].alias("template_level"), taken.alias("values"), c["location"].alias("location"), c["branch_variant"].alias("branch_variant"))
        return F.struct((-c["static_token_count"]).alias("a"), (-score(c)).alias("b"), steps.alias("c"), c["ins_idx"].alias("d"), match.alias("match"))

    good = F.transform(F.filter("found", fits), lambda c: F.struct(c.alias("c"), values(c).alias("values")))
    return lines.select(*own, F.array_min(F.transform(good, rank)).alias("best")).select(*own, "best.match.*")


def all_matches(lines: DataFrame, templates: DataFrame, threshold: float = 0.0, use_level: bool = True, options: Options = Options()) -> DataFrame:
    """Every derivation of every template for every line, with its rank within the line (from 1); lines without any are left out.

    Candidates are expanded token by token; a hole branches over its possible lengths only as far as the rest of the
    pattern leaves room, and every branch ends in a derivation, since the whole pattern is known to match.
    """
    built = build(templates, options).withColumnRenamed("tokens", "t_tokens")
    side = template_side(built)
    longest = built.agg(F.max("p")).first()[0] or 0
    own = lines.columns
    state = scored(candidates(prepared(lines), side, "inner", use_level)).where(F.col("confidence") >= threshold)
    none = F.array().cast("array<string>")
    state = state.withColumns({"pos": F.lit(0), "step_key": F.array().cast("array<int>"), "values": none})
    for at in range(longest):
        here, kind, token = F.lit(at) < F.col("p"), F.get("kinds", F.lit(at)), F.get("l_tokens", F.col("pos"))
        room = F.col("n") - F.col("pos") - (F.col("p") - at - 1)
        part = F.get("token_regexes", F.lit(at))
        fits = F.when(kind == 0, token == F.get("t_tokens", F.lit(at))).when(kind == 1, F.regexp_like(token, part)).otherwise(room > 0)
        lengths = F.when(~here, F.array(F.lit(0))).when(~F.coalesce(fits & (room > 0), F.lit(False)), F.array().cast("array<int>")).when(kind == 2, F.sequence(F.lit(1), room)).otherwise(F.array(F.lit(1)))
        state = state.withColumn("len", F.explode(lengths))
        span = F.array_join(F.slice("l_tokens", F.col("pos") + 1, F.col("len")), " ")
        holes_here = F.size(F.split(F.get("t_tokens", F.lit(at)), r"<\*>", -1)) - 1
        inner = F.transform(F.sequence(F.lit(1), F.greatest(holes_here, F.lit(1))), captured(token, part))
        taken = F.when(here & (kind == 2), F.array(span)).when(here & (kind == 1), inner).otherwise(none)
        step = F.when(~here, F.array().cast("array<int>")).otherwise(F.array(F.when(kind == 0, 0).when(kind == 1, 1).otherwise(1 + F.col("len")).cast("int")))
        # The position moves in a step of its own: within one projection a lambda would see the new one.
        state = state.withColumns({"values": F.concat("values", taken), "step_key": F.concat("step_key", step)}).withColumn("pos", F.col("pos") + F.col("len")).drop("len")
    done = state if options.allow_trailing else state.where("pos = n")
    order = F.struct((-F.col("static_token_count")).alias("a"), (-F.col("confidence")).alias("b"), F.col("step_key").alias("c"), F.col("ins_idx").alias("d"))
    ranked = done.withColumn("rank", F.row_number().over(Window.partitionBy(*line_key(lines)).orderBy(order)))
    return ranked.select(*own, "rank", "template_id", "confidence", "pattern", "static_token_count", F.col("t_level").alias("template_level"), "values", "location", "branch_variant")


def captured(token: Column, pattern: Column):
    return lambda i: F.call_function("regexp_extract", token, pattern, i)


def unmatched(lines: DataFrame, matches: DataFrame) -> DataFrame:
    """Lines without a match."""
    key = line_key(lines)
    return lines.join(matches.where("template_id is not null").select(*key), key, "left_anti")


def used_templates(templates: DataFrame, matches: DataFrame) -> DataFrame:
    """Templates that some line matched."""
    return templates.join(matches.select("template_id"), "template_id", "left_semi")


def level_filter(lines: DataFrame, levels: str | None) -> DataFrame:
    """Lines whose level is in the comma-separated list; a line without level is in none."""
    if not levels:
        return lines
    return lines.where(F.upper("level").isin([x.strip().upper() for x in levels.split(",")]))


def non_blank(lines: DataFrame) -> DataFrame:
    return lines.where(F.coalesce(strip("message"), F.lit("")) != "")


def sample_lines(lines: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` physical lines (0 or none: all)."""
    return lines.where(F.col("line_number") <= n) if n else lines
