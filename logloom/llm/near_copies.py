"""Near copies: SimHash on five-word shingles, completed by exact Jaccard similarity of 0.8 or more.

1. A text's shingles (A-Z lower-cased, words split on ASCII white space; fewer than five words are one shingle) become a sorted set of
   64-bit hashes. Equal sets become one node at once, so exact copies are never compared.
2. SimHash: each node's fingerprint, linked by ``simhash.links`` (generalised pigeonhole, 4 of 64 bits, an estimated similarity far above
   0.8). Such families count as near copies. 64 bits are too few to find all pairs of similarity 0.8, which lie up to 20 bits apart
   where every probe would meet unrelated texts; the rest is therefore found exactly.
3. Prefix filter: in any order of all shingles, two sets of similarity 0.8 share one of the first n // 5 + 1 of either. The order is
   by hash, but shingles that many nodes have come last; which do decides about the work only, never about the result. All shingles of
   all nodes are counted for it.
4. Every node is compared with that smallest or largest node of its buckets with which it shares most of them, then with the smallest
   and largest ones that are still in other families: linear, and melts families of near copies together without pairs.
5. Nodes of a bucket that lie in different families become a pair only if size, position and sketch (256 parities, whose differences
   are a lower bound of the sets' differences) still allow 0.8; all other pairs end within the join.
6. Every pair is verified, by wider sketches and then on the whole sets; components by star contraction. No pair of similarity 0.8 is missed.

Sets are as large as the texts, so they are made from the texts again where they are needed (a text of each node to count shingles,
all texts for the prefixes, candidates' texts to verify) rather than kept.

Defined cases: null, empty and white-space texts are equal; repeated rows are one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm import blocks as B
from logloom.llm import simhash
from logloom.llm.common import BROADCAST_ROWS, LOWER, ROW, hot_threshold, id_and_bytes, keyed, looked_up, per_row, row_columns, same_row, slices, written
from logloom.llm.components import components

#: Words of a shingle; nodes that have a common shingle at least, and so many common shingles at most.
SIZE, COMMON, COMMON_SHINGLES = 5, 32, 100_000
#: Shingles that a task holds before it sends them to be counted.
COUNTED = 1_000_000
#: Columns of a set's sketch: 64 parities each.
SKETCH = [f"s{k}" for k in range(4)]
#: Nodes that a task remembers as met, and rows in a batch of postings.
SEEN, POSTING_ROWS = 500_000, 200_000
#: Odd factors, one for each word of a shingle.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9], np.uint64)
NODES = pa.schema([("row_id", pa.int64()), ("row_hash", pa.int64()), ("row_check", pa.int32()), ("node", pa.int64()), ("print", pa.int64()), ("n", pa.int32()), *((c, pa.int64()) for c in SKETCH)])
WIDE = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("class", pa.int64()), ("own", pa.list_(pa.int64())), ("half", pa.list_(pa.int64()))])
SETS = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])
DEALT = pa.schema([("part", pa.int32()), ("payload", pa.binary())])
COUNTS = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])
POSTINGS = pa.schema([("shingle", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def shingles(raw: bytes) -> np.ndarray:
    """Sorted hashes of the different shingles."""
    words = raw.translate(LOWER).split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - SIZE + 1) if len(h) else 0
    out = np.zeros(n, np.uint64)
    for k in range(min(SIZE, len(h))):
        out += h[k : k + n] * FACTORS[k]
    out = (out ^ out >> np.uint64(31)) * FACTORS[0]
    return np.unique((out ^ out >> np.uint64(29)).view(np.int64))


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def nodes_of(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: what tells the row, its node, and the node's fingerprint, size and sketch."""

    def one(doc_id, raw: bytes, row_hash: int, row_check: int) -> tuple:
        found = shingles(raw)
        bits = simhash.majority(len(found), (found[a : a + (1 << 16)] for a in range(0, len(found), 1 << 16)))
        return doc_id, row_hash, row_check, node_of(found), bits, len(found), *sketch_of(found)

    kind = "row_id long, row_hash long, row_check int, node long, print long, n int, " + ", ".join(f"{c} long" for c in SKETCH)
    return id_and_bytes(docs, *row_columns()[1:]).mapInArrow(per_row(one, ("doc_id", "text", "row_hash", "row_check"), NODES), kind)


def sketch_of(found: np.ndarray) -> list[int]:
    """Parities of the numbers of shingles in 256 bins. Two sets differ in as many shingles at least as sketches in bits."""
    return parities(found, 256).tolist()


def parities(found: np.ndarray, bins: int) -> np.ndarray:
    odd = np.bincount(found & (bins - 1), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def size_class(n: int) -> int:
    """The power of two that holds ``n``. Sets of a similarity of 0.8 lie one class apart at most."""
    return max(64, 1 << max(0, n - 1).bit_length())


def each_set(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Node and shingles of the texts; a text that the task has just met is passed over."""
    seen: set[int] = set()
    for (raws,) in slices(batches, ("text",)):
        if len(seen) > SEEN:
            seen.clear()
        for raw in raws:
            found = shingles(raw)
            node = node_of(found)
            if node not in seen:
                seen.add(node)
                yield node, found


def sets(texts: DataFrame) -> DataFrame:
    """(node, shingles) of a few texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, found in each_set(batches):
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([found], pa.list_(pa.int64()))], schema=SETS)

    return texts.mapInArrow(run, "node long, shingles array<long>")


def wide_sketches(texts: DataFrame) -> DataFrame:
    """(node, n, class, parities in 4 bins for each shingle that the class holds, the same in half as many bins) of a few texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, found in each_set(batches):
            k = size_class(len(found))
            row = (node, len(found), k, parities(found, 4 * k), parities(found, 2 * k))
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, WIDE, strict=True)], schema=WIDE)

    return texts.mapInArrow(run, "node long, n int, class long, own array<long>, half array<long>")


def close_prints(nodes: DataFrame) -> DataFrame:
    """(a, b): every node of a family of near fingerprints, and the family's smallest node."""
    nodes = nodes.select("node", "print")
    prints = written(nodes.groupBy("print").agg(F.min("node").alias("low"), F.count("*").alias("n")), "prints")
    family = written(simhash.links(prints.select("print")).withColumnRenamed("node", "print").join(prints, "print"), "print-families")
    least = written(family.groupBy("root").agg(F.min("low").alias("b"), F.count("*").alias("n")), "print-roots")
    named = looked_up(family.select("print", "root", F.col("n").alias("nodes")), least, "root").select("print", "b", F.col("nodes").alias("n"))
    return looked_up(nodes, written(named, "print-names"), "print").where("node <> b").select(F.col("node").alias("a"), "b")


def shingle_counts(texts: DataFrame, least: int) -> DataFrame:
    """(shingle, n) of all shingles that at least ``least`` of the nodes have; ``texts`` has one text of each node.

    A part counts the shingles of its range. They are sent sorted, as differences, which pack well; a part's memory is its share of them.
    """
    parts, most = B.parts_for(texts), COUNTED
    bounds = np.array([(k << 64) // parts - (1 << 63) for k in range(1, parts)], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for _, found in each_set(batches):
            held.append(found)
            rows += len(found)
            if rows >= most:
                yield dealt(held, bounds)
                held, rows = [], 0
        if held:
            yield dealt(held, bounds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, some in itertools.groupby(rows, lambda row: row[0]):
            found, n = np.unique(np.concatenate([np.cumsum(B.unpack(payload)[0]) for _, payload in some]), return_counts=True)
            often = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(c[often], f.type) for c, f in zip((found, n), COUNTS, strict=True)], schema=COUNTS)

    sent = id_and_bytes(texts).select("text").mapInArrow(deal, "part int, payload binary")
    return sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(count, "shingle long, n long")


def dealt(held: list[np.ndarray], bounds: np.ndarray) -> pa.RecordBatch:
    """The shingles of some sets for each part that has any. Differences and their sums wrap around alike."""
    found = np.sort(np.concatenate(held))
    ranges = [(p, B.pack(np.diff(x, prepend=np.int64(0)))) for p, x in enumerate(np.split(found, np.searchsorted(found, bounds))) if len(x)]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in ranges], f.type) for k, f in enumerate(DEALT)], schema=DEALT)


def prefixes(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(shingle, node, size of the set, position) of each node's prefix; ``common`` shingles (sorted) stand last."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = sent.value
        held, rows = [], 0
        for node, h in each_set(batches):
            n = len(h)
            if len(late):
                last = late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h
                h = np.concatenate((h[~last], h[last]))
            h = h[: n // SIZE + 1]
            held.append((h, np.full(len(h), node), np.full(len(h), n), np.arange(len(h))))
            rows += len(h)
            if rows > POSTING_ROWS:
                yield posted(held)
                held, rows = [], 0
        if held:
            yield posted(held)

    return id_and_bytes(docs).select("text").mapInArrow(run, "shingle long, node long, n int, pos int").repartition("shingle").distinct()


def posted(held: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*held, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, POSTINGS, strict=True)], schema=POSTINGS)


def may_be_near(n: Column, pos: Column, other_n: Column, other_pos: Column) -> Column:
    """Whether sets with a shingle at these positions can share enough: 9 common >= 4 (n + n') is a similarity of 0.8."""
    most = F.least(pos, other_pos) + 1 + F.least(n - pos, other_n - other_pos) - 1
    return 9 * most >= 4 * (n + other_n)


def few_differences(n: Column, other_n: Column, other: str) -> Column:
    """Whether the sketches allow a similarity of 0.8, which leaves a ninth of the shingles of both sets to differ."""
    apart = [F.bit_count(F.col(c).bitwiseXOR(F.col(other + c))) for c in SKETCH]
    return 9 * sum(apart[1:], apart[0]) <= n + other_n


def texts_of(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text at least of each node in ``pairs``. Texts stay where they are while the nodes are few enough to be broadcast."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    rows = written(nodes.join(wanted, "node", "left_semi").select("first.*").drop("none"), "wanted")
    whole = docs.select(*row_columns(), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return whole.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, same_row(whole, rows), "left_semi").select("text")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The (a, b, ...) of ``pairs`` (a written table) that have a similarity of 0.8 at least: 9 common shingles for 4 of either.

    Sketches as wide as the sets decide nearly all pairs that are not, at a sixteenth of the sets' size; the rest is compared as a whole.
    """
    wide = written(wide_sketches(texts_of(pairs, docs, nodes)).dropDuplicates(["node"]), "wide")
    both = pairs.join(wide.toDF("a", "x_n", "x_class", "x_own", "x_half"), "a").join(wide.toDF("b", "y_n", "y_class", "y_own", "y_half"), "b")
    apart_by = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    differ = F.when(F.col("x_class") == F.col("y_class"), apart_by("x_own", "y_own")).when(F.col("x_class") == 2 * F.col("y_class"), apart_by("x_half", "y_own")).when(F.col("y_class") == 2 * F.col("x_class"), apart_by("x_own", "y_half"))
    near = written(both.where(9 * differ <= F.col("x_n") + F.col("y_n")).select(*pairs.columns), "near")
    whole = written(sets(texts_of(near, docs, nodes)).dropDuplicates(["node"]), "candidates")
    both = near.join(whole.toDF("a", "x"), "a").join(whole.toDF("b", "y"), "b")
    return both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select(*pairs.columns)


def contracted(family: DataFrame, links: DataFrame) -> DataFrame:
    """``family`` (node, root) after ``links`` (a, b) between roots; a node that is not in it is its own root."""
    tops = written(components(links).select(F.col("node").alias("root"), F.col("root").alias("top")), "tops")
    lone = tops.join(family, "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return written(family.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(lone), "families")


def apart(pairs: DataFrame, family: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of different families, with their roots."""
    for end in ("a", "b"):
        pairs = pairs.join(family.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.select("a", "b", F.coalesce("root_a", "a").alias("root_a"), F.coalesce("root_b", "b").alias("root_b")).where("root_a <> root_b")


def families(docs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root) of the nodes that have a near copy; ``rows`` as for ``picked``."""
    counts = written(shingle_counts(picked(docs, rows, nodes.select("first.*").drop("none")), COMMON), "shared-shingles")
    least = max(COMMON, hot_threshold(counts, COMMON_SHINGLES))
    common = np.sort(np.array([r.shingle for r in counts.where(F.col("n") >= least).select("shingle").collect()], np.int64))
    postings = prefixes(docs, common)
    at = F.struct("node", "n", "pos")
    buckets = postings.groupBy("shingle").agg(F.min(at).alias("low"), F.max(at).alias("high")).where("low.node < high.node")
    shared = written(postings.join(buckets, "shingle"), "shared")
    ends = shared.select("node", "n", "pos", F.explode(F.array("low", "high")).alias("end")).where("node <> end.node")
    stars = ends.where(may_be_near(F.col("n"), F.col("pos"), F.col("end.n"), F.col("end.pos")))
    stars = written(stars.groupBy(F.greatest("node", "end.node").alias("a"), F.least("node", "end.node").alias("b")).agg(F.count("*").alias("common")), "stars")
    # Each node with the one end that it shares most buckets with, then with the ends that are still in other families.
    best = written(stars.groupBy("a").agg(F.max(F.struct("common", "b")).alias("most")).select("a", F.col("most.b").alias("b")), "best")
    family = written(components(verified(best, docs, nodes).select("a", "b").unionByName(close_prints(nodes))), "families")
    rest = written(apart(stars.join(best, ["a", "b"], "left_anti").select("a", "b"), family), "rest")
    family = contracted(family, verified(rest, docs, nodes).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    # All pairs between families.
    known = shared.select("shingle", "node", "n", "pos").join(family, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = known.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    known = written(known.join(mixed, "shingle", "left_semi").join(nodes.select("node", *SKETCH), "node"), "mixed")
    other = known.select("shingle", *[F.col(c).alias(f"other_{c}") for c in known.columns if c != "shingle"])
    near = (F.col("node") > F.col("other_node")) & (F.col("root") != F.col("other_root")) & may_be_near(*map(F.col, ("n", "pos", "other_n", "other_pos")))
    near = near & few_differences(F.col("n"), F.col("other_n"), "other_")
    pairs = known.join(other, "shingle").where(near).select(F.col("node").alias("a"), F.col("other_node").alias("b"), "root", "other_root").distinct()
    pairs = written(pairs.join(stars, ["a", "b"], "left_anti"), "pairs")
    return contracted(family, verified(pairs, docs, nodes).select(F.col("root").alias("a"), F.col("other_root").alias("b")))


def picked(docs: DataFrame, rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are in ``kept`` (``ROW``), each once; ``rows`` (a written table) has how often each occurs.

    Texts stay where they are while the rows to drop are few enough to be broadcast; else they are shuffled once.
    """
    chosen = rows.join(kept, same_row(rows, kept), "left_semi")
    once, again = written(chosen.where("times = 1").drop("times"), "kept-once"), written(chosen.where("times > 1").drop("times"), "kept-again")
    gone = written(rows.join(once, same_row(rows, once), "left_anti").drop("times"), "gone")
    whole = keyed(docs)
    if gone.count() <= BROADCAST_ROWS:
        single = whole.join(F.broadcast(gone), same_row(whole, gone), "left_anti")
    else:
        single = whole.join(once, same_row(whole, once), "left_semi")
    out = single.select("whole.*")
    if again.isEmpty():
        return out
    # Rows that repeat word for word, of which one stays.
    same = whole.join(F.broadcast(again) if again.count() <= BROADCAST_ROWS else again, same_row(whole, again), "left_semi").dropDuplicates(ROW)
    return out.unionByName(same.select("whole.*"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: the smallest doc_id (a null only where there is no other), then the smallest hash of the text."""
    table = written(nodes_of(docs), "rows")
    first = F.min(F.struct(F.col("row_id").isNull().alias("none"), *ROW)).alias("first")
    nodes = written(table.groupBy("node", "print", "n", *SKETCH).agg(first), "nodes")
    rows = written(table.groupBy(*ROW).agg(F.count("*").alias("times")), "times")
    kept = written(nodes.join(families(docs, nodes, rows), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select("first.*").drop("none").distinct(), "kept")
    return picked(docs, rows, kept)
