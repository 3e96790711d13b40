"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Fingerprint: A-Z lower-cased, words split on ASCII white space, shingles of four words (repeats included) hashed with
   XXH64 (seed 42); a bit is 1 if more than half the hashes have it. Texts with fewer words are one shingle; none: zero.
2. Equal fingerprints become one node at once (aggregated map-side), so exact copies are never compared.
3. Bits' co-occurrence over all fingerprints tells which bits are correlated; such bits go to the same small group. Each group's
   histogram gives the distribution of distances within it, and a dynamic programme over groups then cuts the 64 bits into
   partitions with unequal thresholds t_i, sum(t_i + 1) = limit + 1, such that the estimated number of probes and candidates is
   smallest. If two fingerprints differ in ``limit`` bits at most, some partition differs in t_i bits at most.
4. A first pass links every fingerprint to the smallest one that agrees with it on a whole partition, if near enough: a star for each
   bucket, which melts families of near copies together without pairs.
5. Probe and verify: every fingerprint probes all values within t_i of its own in partition i; a candidate becomes a link if
   the whole fingerprints differ in ``limit`` bits at most and the two aren't in one component yet. Every link between different
   components is found, none within a family is emitted.
6. Components by star contraction (``components``).

The plan's statistics are 4,096 co-occurrence counts and 256 histogram bars, whatever the input. No fingerprint or link reaches the driver.

Defined cases: null, empty and white-space texts have fingerprint zero and link to each other; repeated rows repeat their result;
a null doc_id is never a component's id unless all its ids are null; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import LOWER, documents, id_and_bytes, looked_up, per_row, written
from logloom.llm.components import components

SHINGLE, SEED, LIMIT, BITS, GROUP = 4, 42, 4, 64, 4
#: Cost of a probe (a shuffled row, about 2 microseconds as measured) in candidates checked within a bucket.
PROBE_COST = 25.0
PRINTS = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])


def fingerprint(raw: bytes, size: int = SHINGLE) -> int:
    """64 bits, as a signed number."""
    words = raw.translate(LOWER).split()
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    n = max(1, len(words) - size + 1)
    return majority(n, (np.array([hash_of(b" ".join(words[i : i + size]), SEED) for i in range(at, min(n, at + (1 << 16)))], "<u8") for at in range(0, n, 1 << 16)))


def majority(n: int, parts) -> int:
    """The bits that over half of ``n`` hashes have, which come in ``parts``; no hashes have none."""
    ones = np.zeros(64, np.int64)
    for some in parts:
        ones += np.unpackbits(some.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint of every row."""
    one = lambda doc_id, raw: (doc_id, fingerprint(raw, size))
    return id_and_bytes(docs).mapInArrow(per_row(one, ("doc_id", "text"), PRINTS), "doc_id long, print long")


def unpacked(column: pa.Array) -> np.ndarray:
    values = np.asarray(column.to_numpy(zero_copy_only=False), "<i8")
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(prints: DataFrame) -> np.ndarray:
    """64 x 64 numbers of fingerprints that have both bits, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        for batch in batches:
            bits = unpacked(batch.column(0)).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(4096), pa.int32()), pa.array(total.ravel(), pa.int64())], names=["at", "n"])

    rows = prints.select("print").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(4096, np.int64)
    for r in rows:
        out[r.at] = r.n
    return out.reshape(64, 64)


def grouped_bits(both: np.ndarray, n: int, size: int = GROUP) -> list[list[int]]:
    """Groups of ``size`` bits, correlated ones together; similar groups stand next to each other."""
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(near, 0)
    left, groups, last = set(range(len(p))), [], None
    while left:
        rest = sorted(left)
        score = near[rest][:, last].sum(1) if last else near[rest][:, rest].sum(1)
        group = [rest[int(score.argmax())]]
        left.discard(group[0])
        while left and len(group) < size:
            rest = sorted(left)
            group.append(rest[int(near[rest][:, group].sum(1).argmax())])
            left.discard(group[-1])
        groups.append(group)
        last = group
    return groups


def histograms(prints: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """How many fingerprints have each value of each group, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bars = [np.zeros(1 << len(g), np.int64) for g in groups]
        for batch in batches:
            bits = unpacked(batch.column(0)).astype(np.int64)
            for bar, g in zip(bars, groups, strict=True):
                bar += np.bincount(bits[:, g] @ (1 << np.arange(len(g))), minlength=len(bar))
        rows = [(k, v, int(n)) for k, bar in enumerate(bars) for v, n in enumerate(bar)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["k", "v", "n"])

    out = [np.zeros(1 << len(g), np.int64) for g in groups]
    for r in prints.select("print").mapInArrow(run, "k int, v int, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).collect():
        out[r.k][r.v] = r.n
    return out


def distances(bars: np.ndarray) -> np.ndarray:
    """Chance of each distance between two fingerprints within a group."""
    share = bars / max(1, bars.sum())
    v = np.arange(len(bars))
    apart = np.bitwise_count(v[:, None] ^ v[None, :])
    return np.bincount(apart.ravel(), np.outer(share, share).ravel(), minlength=len(bars).bit_length())


def allocate(within: list[np.ndarray], sizes: list[int], n: int, limit: int = LIMIT) -> list[tuple[int, int, int]]:
    """Partitions as (first group, end group, threshold) with the least estimated work; sum(threshold + 1) = limit + 1."""
    g = len(within)
    best: dict[tuple[int, int], tuple[float, list]] = {(0, 0): (0.0, [])}
    for at in range(g):
        chances, width = np.ones(1), 0
        for end in range(at + 1, g + 1):
            chances = np.convolve(chances, within[end - 1])
            width += sizes[end - 1]
            for t in range(min(limit, 2) + 1):
                probes = sum(math.comb(width, k) for k in range(t + 1))
                work = n * probes * PROBE_COST + n * n * float(chances[: t + 1].sum())
                for used in range(limit + 1 - t):
                    if (at, used) in best:
                        cost, parts = best[at, used]
                        key = (end, used + t + 1)
                        if key not in best or cost + work < best[key][0]:
                            best[key] = (cost + work, [*parts, (at, end, t)])
    return min((best[e, limit + 1] for e in range(1, g + 1) if (e, limit + 1) in best), key=lambda x: x[0])[1]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(groups: list[list[int]], parts: list[tuple[int, int, int]]) -> list[tuple[int, list[int]]]:
    """For each partition: its bits, and all changes of up to its threshold of them (none is the first)."""
    out = []
    for at, end, t in parts:
        bits = [b for g in groups[at:end] for b in g]
        flips = [signed(sum(1 << b for b in some)) for k in range(t + 1) for some in itertools.combinations(bits, k)]
        out.append((signed(sum(1 << b for b in bits)), flips))
    return out


def apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(node, root) of all fingerprints that have a link; ``nodes`` has one row for each different fingerprint."""
    spark = nodes.sparkSession
    n = nodes.count()
    groups = grouped_bits(bit_counts(nodes), n)
    cut = masks(groups, allocate([distances(h) for h in histograms(nodes, groups)], [len(g) for g in groups], n, limit))
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("print").bitwiseAND(F.lit(m)).alias("key")) for i, (m, _) in enumerate(cut)])
    index = nodes.select("print", F.explode(keys).alias("k")).select("print", "k.part", "k.key")
    # Families of near copies first: a star in each bucket.
    least = index.groupBy("part", "key").agg(F.min("print").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = index.join(least, ["part", "key"]).where((F.col("print") > F.col("low")) & (apart("print", "low") <= limit))
    family = components(stars.select(F.col("print").alias("a"), F.col("low").alias("b")))
    known = written(nodes.join(family.withColumnRenamed("node", "print"), "print", "left").select("print", F.coalesce("root", "print").alias("root")), "family")
    # Probe and verify, between families.
    rows = [(i, flip) for i, (_, flips) in enumerate(cut) for flip in flips]
    flips = spark.createDataFrame(rows, "part int, flip long")
    index = known.select("print", "root", F.explode(keys).alias("k")).select("print", "root", "k.part", "k.key")
    probe = index.join(F.broadcast(flips), "part").select("part", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), F.col("print").alias("probe"), F.col("root").alias("family"))
    near = probe.join(index, ["part", "key"]).where((F.col("probe") > F.col("print")) & (F.col("family") != F.col("root")) & (apart("probe", "print") <= limit))
    found = near.select(F.col("family").alias("a"), F.col("root").alias("b")).distinct()
    joined = components(found).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return known.join(joined, "root", "left").select(F.col("print").alias("node"), F.coalesce("top", "root").alias("root"))


def classes(docs: DataFrame, limit: int = LIMIT, size: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: doc_id, print, and the smallest doc_id of its component.

    Fingerprints of many rows and families of many fingerprints are looked up without gathering their rows.
    """
    prints = written(fingerprints(docs, size), "prints")
    nodes = written(prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    roots = nodes.join(links(nodes.select("print"), limit).withColumnRenamed("node", "print"), "print", "left")
    roots = written(roots.select("print", "first", "n", F.coalesce("root", "print").alias("root")), "roots")
    least = written(roots.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "least")
    named = written(looked_up(roots.select("print", F.col("n").alias("rows"), "root"), least, "root").select("print", "component_id", F.col("rows").alias("n")), "named")
    return looked_up(prints, named, "print")


def simhash(docs: DataFrame, limit: int = LIMIT, size: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id."""
    text = F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint")
    return classes(docs, limit, size).select("doc_id", text, "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(documents(spark, sf_dir))
