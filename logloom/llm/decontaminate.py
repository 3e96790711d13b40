"""Benchmark decontamination: one Aho-Corasick automaton over normalised windows of test items.

Normalisation: A-Z lower-cased, words are runs of ASCII letters, digits and non-ASCII characters. A window is ``size``
consecutive words of an item; an item with fewer words, but some, is one window. Windows are stored as `` w1 w2 … wn ``
with a space at both ends, so that a match in the normalised text always covers whole words. Each document is scanned once.

Defined cases: null text has no words; null or wordless items have no windows; equal windows of several items count for all
of them; repeated doc_ids give one row per input row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import CHUNK, WORD_BYTES, documents, id_and_bytes, per_row
from logloom.session import ensure_importable

WINDOW = 10
#: Items' text (in bytes) per automaton: a megabyte makes 130,000 windows and takes about 400 MB in each worker, as measured.
#: Benchmarks beyond it are scanned with several automata in turn.
SHARD_BYTES = 1 << 20
FOUND = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
     ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.string())]
)
HITS = pa.schema(
    [("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.int64())),
     ("offsets", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]
)


def item_windows(items: list[tuple[str, bytes]], size: int = WINDOW) -> dict[str, tuple[int, tuple[str, ...]]]:
    """Window text to its number of words and the ids of the items that have it."""
    owners: dict[bytes, set[str]] = defaultdict(set)
    lengths: dict[bytes, int] = {}
    for item, text in items:
        words = text.translate(WORD_BYTES).split()
        n = min(size, len(words))
        for at in range(len(words) - n + 1 if n else 0):
            key = b" %b " % b" ".join(words[at : at + n])
            owners[key].add(item)
            lengths[key] = n
    return {k.decode("latin-1"): (lengths[k], tuple(sorted(v))) for k, v in owners.items()}


def automaton(windows: dict[str, tuple[int, tuple[str, ...]]]) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for text, value in windows.items():
        auto.add_word(text, value)
    auto.make_automaton()
    return auto


def scan(auto: ahocorasick.Automaton, raw: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged runs [first, end) of hit words, items with an occurring window."""
    words = raw.translate(WORD_BYTES).split()
    if not words or not len(auto):
        return len(words), [], set()
    norm = b" %b " % b" ".join(words)
    hits = list(auto.iter(norm.decode("latin-1")))
    if not hits:
        return len(words), [], set()
    spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    ends = np.searchsorted(spaces, [end for end, _ in hits])
    found: set[str] = set()
    spans = []
    for end, (_, (n, items)) in zip(ends.tolist(), hits, strict=True):
        found.update(items)
        spans.append((end - n, end))
    return len(words), merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def offsets(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code point offsets of the original text. Translation keeps every byte in its place."""
    data = np.frombuffer(raw, np.uint8)
    word = np.concatenate(([False], np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 32, [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [(int(points[edges[2 * a]]), int(points[edges[2 * b - 1]])) for a, b in runs]


def _row(doc_id, n_words: int, runs: list[tuple[int, int]], items, points: list[tuple[int, int]]) -> tuple:
    ids = sorted(items)
    return (doc_id, n_words, sum(b - a for a, b in runs), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(),
            bool(runs), ",".join(f"{a}:{b}" for a, b in points))


def shards(benchmark: DataFrame, limit: int = SHARD_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """Items dealt to shards of about ``limit`` bytes of text by a hash of their id; one shard at a time is on the driver."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // limit))
    for k in range(n):
        some = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "text")
        yield [(r.item_id, bytes(r.text)) for r in some.collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, limit: int = SHARD_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the hit spans (code points).

    The automaton is sent to the executors only while the items' text is under ``limit``; larger benchmarks are cut into
    shards, each scanned in turn, and a document's runs and items are united per row. Documents are never shuffled in the
    one-shard case.
    """
    spark = docs.sparkSession
    source = id_and_bytes(docs)
    parts = shards(benchmark, limit)
    first = next(parts)
    second = next(parts, None)
    if second is None:
        return source.mapInArrow(_scanner(spark, first, size), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string")
    source = id_and_bytes(docs, F.xxhash64("doc_id", "text").alias("row"))
    kind = "doc_id long, row long, n_words long, runs array<long>, offsets array<long>, items array<string>"
    each = [source.mapInArrow(_hits(spark, p, size), kind) for p in itertools.chain((first, second), parts)]
    # Equal rows (same id and text) are counted so that they come back as often as they came in.
    rows = reduce(DataFrame.unionByName, each).groupBy("doc_id", "row", "n_words").agg(
        F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("offsets")).alias("offsets"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), (F.count("*") / len(each)).cast("int").alias("times"))

    def united(doc_id, n_words, runs, points, items):
        pairs = lambda x: list(zip(x[::2], x[1::2], strict=True))
        return _row(doc_id, n_words, merged(pairs(runs)), items, merged(pairs(points)))

    rows = rows.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rows.select("doc_id", "n_words", "runs", "offsets", "items").mapInArrow(
        per_row(united, ("doc_id", "n_words", "runs", "offsets", "items"), FOUND),
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, limit: int = SHARD_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of any item. Narrow: every shard is a filter."""
    ensure_importable(docs.sparkSession)
    column = docs.columns.index("text")
    for items in shards(benchmark, limit):
        sent = docs.sparkSession.sparkContext.broadcast(item_windows(items, size))

        def run(batches, sent=sent):
            auto = automaton(sent.value)
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(at, CHUNK)
                    texts = part.column(column).cast(pa.binary()).to_pylist()
                    yield part.filter(pa.array([not scan(auto, t or b"")[1] for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _scanner(spark: SparkSession, items, size: int):
    sent = spark.sparkContext.broadcast(item_windows(items, size))

    def run(batches):
        auto = automaton(sent.value)

        def one(doc_id, raw):
            n, runs, found = scan(auto, raw)
            return _row(doc_id, n, runs, found, offsets(raw, runs) if runs else [])

        yield from per_row(one, ("doc_id", "text"), FOUND)(batches)

    return run


def _hits(spark: SparkSession, items, size: int):
    sent = spark.sparkContext.broadcast(item_windows(items, size))

    def run(batches):
        auto = automaton(sent.value)

        def one(doc_id, raw, row):
            n, runs, found = scan(auto, raw)
            flat = lambda x: [y for p in x for y in p]
            return doc_id, row, n, flat(runs), flat(offsets(raw, runs)) if runs else [], sorted(found)

        yield from per_row(one, ("doc_id", "text", "row"), HITS)(batches)

    return run


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")
