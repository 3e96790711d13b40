"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

``metrics`` turns a text into counts and ratios with built-in functions only; every row is handled on its own, so there is no
shuffle and no skew. ``RULES`` is the threshold table: (name, metric, smallest, largest, least words). A rule rejects a document
that has at least the given number of words and whose metric lies outside the range. ``verdict`` compiles any such table
into one boolean column.

Repeated 5-word windows are found by 64-bit hashes within one document (two different windows of one text agree by chance once
in about 1e10 texts of 60,000 words). A hash set tells whether any window repeats; only then the windows are sorted.

Defined cases: null and empty texts have no words and fail the base rule; ratios over no words are 0; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import SPACE, documents

WINDOW = 5
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is that for it with as was on are by this be at from or an "
    "le la les des de du et un une en est que qui dans pour au aux ce il "
    "der die und das ist ein eine den nicht mit zu von im auf dem sich "
    "el los las y por con para no se del lo su al es"
).split()
#: The threshold table: rule, metric, smallest, largest, and the words from which on it holds.
RULES: tuple[tuple[str, str, float | None, float | None, int], ...] = (
    ("enough_words", "n_words", 10, None, 0),
    ("word_length", "mean_word_chars", 2.0, 16.0, 0),
    ("symbols", "symbol_ratio", None, 0.1, 0),
    ("shouting", "shouted_ratio", None, 0.5, 0),
    ("stop_words", "stop_ratio", 0.01, None, 50),
    ("repeated_lines", "dup_line_ratio", None, 0.5, 0),
    ("repeated_words", "repeat_ratio", None, 0.2, 0),
)


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words covered by windows of ``size`` words that occur at least twice in the array."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = let(pairs, lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])))
        places = F.sort_array(F.transform(same, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(size), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) > size, found).otherwise(F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once: a lambda's variable is bound to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def metrics(docs: DataFrame, carried: str | Column = "doc_id") -> DataFrame:
    """``carried`` of every row, the base counts, and the ratios that the threshold table speaks of."""
    text = F.coalesce(F.col("text"), F.lit(""))
    carried = F.col(carried) if isinstance(carried, str) else carried
    split = docs.select(carried, text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n_words, words = F.size("words"), F.col("words")
    per_word = lambda x: x / F.greatest(n_words, F.lit(1))
    return split.select(
        split.columns[0],
        n_words.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        per_word(F.regexp_count("text", F.lit(r"\p{Lu}{2,}"))).alias("shouted_ratio"),
        per_word(F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS)))).alias("stop_ratio"),
        F.size("lines").alias("n_lines"),
        F.monotonically_increasing_id().alias("row"),
    ).select(
        "*",
        (F.col("word_chars") / F.greatest("n_words", F.lit(1))).alias("mean_word_chars"),
        (F.col("n_symbols") / F.greatest("n_words", F.lit(1))).alias("symbol_ratio"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / F.greatest("n_words", F.lit(1))).alias("repeat_ratio"),
    )


def verdict(rules=RULES) -> Column:
    """True where no rule of the table rejects."""
    out = F.lit(True)
    for _, metric, low, high, words in rules:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (F.col(metric) >= low)
        if high is not None:
            inside = inside & (F.col(metric) <= high)
        out = out & (inside | (F.col("n_words") < words))
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def passing(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that neither the base nor a rule rejects."""
    judged = metrics(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept_row"))
    # The row number is not deterministic, so the optimizer leaves this filter above the projection. Pushed below, every metric
    # would be worked out again for each comparison, in a condition too large to optimize.
    return judged.where((F.col("row") >= 0) & ~base_failed() & verdict(rules)).select("kept_row.*")


def quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """Per row of ``docs``: the base counts, base_failed and kept."""
    failed = base_failed()
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return metrics(docs).select(*counts, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))
