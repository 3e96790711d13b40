"""Toxicity by a counterfactual-regularised linear classifier.

Features are a text's distinct words (A-Z lower-cased) and their first 4, 5 and 6 bytes, as 32-bit hashes. Training reads a bounded
sample of labelled rows (``PER_CLASS`` of each class, smallest hash of the id first; the classes are weighted back to their
shares). Spark counts each feature's documents by class; the ``FEATURES`` that tell the classes apart best form the model, whose
weights are fitted by logistic regression with two penalties: the weights' squares, and, for every sentence that names a group, the
squared change of its logit when the group's name is swapped for another of its kind. A group's name therefore
cannot raise a score by itself. Scoring is one narrow pass with a broadcast table of at most ``FEATURES`` weights.

Labels are joined to the sample's ids only, which are broadcast (2 * PER_CLASS rows at most): no text is shuffled.

Defined cases: null and empty texts have no features and score the model's intercept; labels of null or repeated doc_ids count once
(toxic if any says so); without labels of both classes every score is the share of toxic labels (0 without any); repeated rows
repeat their result; language, source and doc_id never enter a score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import WORD_BYTES, documents, fold, id_and_bytes, per_row, rows_to_batch, slices, written

PER_CLASS, FEATURES, LEAST_DOCS, LEAST_CHI2 = 6_000, 4_096, 3, 12.0
PREFIXES = (4, 5, 6)
L2, SWAP, STEPS, RATE, CUT = 2e-4, 1.0, 400, 0.1, 0.3
#: Words whose features a task remembers before it starts anew.
KEPT_WORDS = 300_000
#: Names of groups in English, German, French and Spanish; each is swapped for the others of its line.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "hispanic", "african", "european"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("immigrant", "refugee", "foreigner", "native"), ("disabled", "blind", "deaf"), ("old", "young", "elderly"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"), ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
    ("schwule", "lesben", "bisexuelle", "heterosexuelle"), ("frauen", "männer"), ("frau", "mann"), ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"), ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("gays", "lesbiennes", "bisexuels", "hétérosexuels"), ("femmes", "hommes"), ("femme", "homme"), ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"), ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("gais", "lesbianas", "bisexuales", "heterosexuales"), ("mujeres", "hombres"), ("mujer", "hombre"), ("inmigrantes", "refugiados", "extranjeros", "nativos"),
)
ROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def features(word: bytes) -> tuple[int, ...]:
    """Hashes of a word and its prefixes."""
    return (zlib.crc32(word), *(zlib.crc32(b"^%d" % n + word[:n]) for n in PREFIXES if len(word) >= n))


def words(raw: bytes) -> set[bytes]:
    return set(raw.translate(WORD_BYTES).split())


def sample(labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, with their weight: the class's rows for each sampled one."""
    known = labels.where("doc_id is not null and toxic is not null").where(fold(4) != 2).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).withColumn("weight", F.lit(n / min(n, per_class))) for y, n in sizes.items()]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else known.withColumn("weight", F.lit(1.0))


def training_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("toxic", pa.int32()), ("weight", pa.float64()), ("features", pa.list_(pa.int64()))])
        for raws, ys, weights in slices(batches, ("text", "toxic", "weight")):
            yield rows_to_batch([(y, w, sorted({f for x in words(raw) for f in features(x)})) for raw, y, w in zip(raws, ys, weights, strict=True)], schema)

    rows = id_and_bytes(docs).join(F.broadcast(chosen), "doc_id").select("text", "toxic", "weight")
    return written(rows.mapInArrow(run, "toxic int, weight double, features array<bigint>"), "toxic")


def select_features(rows: DataFrame, most: int = FEATURES) -> list[int]:
    """Features with the largest chi-square, in at least LEAST_DOCS documents."""
    total = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    if not total.t or total.t == total.n:
        return []
    counts = rows.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    t, n, all_t, all_n = F.col("t").cast("double"), F.col("n").cast("double"), float(total.t), float(total.n)
    chi = F.pow(t * all_n - n * all_t, F.lit(2)) * all_n / (n * (all_n - n + 0.5) * all_t * (all_n - all_t))
    best = counts.where(F.col("n") >= LEAST_DOCS).withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI2)
    return [r.f for r in best.orderBy(F.desc("chi"), "f").limit(most).collect()]


def swaps() -> list[tuple[bytes, list[bytes]]]:
    return [(a.encode(), [b.encode() for b in line if b != a]) for line in IDENTITY for a in line]


def fit(y: np.ndarray, weight: np.ndarray, at: np.ndarray, col: np.ndarray, n_features: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray]:
    """Intercept and weights. ``at``, ``col``: row and column of each feature; ``pairs``: columns that a swap removes and adds, one pair for each swap."""
    weight = weight / weight.sum()
    theta = np.zeros(n_features + 1)
    rate = float(np.clip(weight @ y, 1e-6, 1 - 1e-6))
    theta[-1] = math.log(rate / (1 - rate))
    swap_at = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs]) if pairs else np.zeros(0, np.int64)
    swap_col = np.concatenate([np.concatenate(p) for p in pairs]).astype(np.int64) if pairs else np.zeros(0, np.int64)
    sign = np.concatenate([np.concatenate((-np.ones(len(a)), np.ones(len(b)))) for a, b in pairs]) if pairs else np.zeros(0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        logit = theta[-1] + np.bincount(at, theta[col], minlength=len(y))
        err = weight * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y)
        grad = np.append(np.bincount(col, err[at], minlength=n_features), err.sum())
        grad[:-1] += L2 * theta[:-1]
        if pairs:
            change = np.bincount(swap_at, sign * theta[swap_col], minlength=len(pairs))
            grad[:-1] += 2 * SWAP / len(pairs) * np.bincount(swap_col, sign * change[swap_at], minlength=n_features)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return float(theta[-1]), theta[:-1]


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[float, dict[int, float]]:
    """Intercept, and weight by feature."""
    rows = training_rows(docs, sample(labels, per_class))
    chosen = select_features(rows)
    wanted = dict.fromkeys([*chosen, *(f for a, _ in swaps() for f in features(a))])
    # The model's features only: a few numbers for each of at most 2 * per_class rows, as Arrow columns.
    found = narrowed(rows, list(wanted)).toArrow()
    y, weight = found["toxic"].to_numpy().astype(float), found["weight"].to_numpy()
    if not len(y) or y.min() == y.max():
        return (40.0 if len(y) and y[0] else -40.0), {}
    lists = found["features"].combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    names = np.array(sorted(wanted), np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    cols = np.searchsorted(names, lists.flatten().to_numpy())
    column = {int(f): i for i, f in enumerate(names)}
    b, theta = fit(y, weight, np.repeat(np.arange(len(y)), sizes), cols, len(names), swapped(column, cols, np.cumsum(sizes)))
    return b, {int(f): float(t) for f, t in zip(names, theta, strict=True) if t}


def swapped(column: dict[int, int], cols: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Columns that each swap removes and adds, for every sentence that names a group."""
    pairs = []
    for a, others in swaps():
        for at in np.flatnonzero(cols == column[features(a)[0]]):
            row = int(np.searchsorted(ends, at, side="right"))
            has = set(cols[ends[row - 1] if row else 0 : ends[row]].tolist())
            for other in others:
                fa, fb = ({column[f] for f in features(w)} for w in (a, other))
                pairs.append((np.array(sorted(fa - fb), np.int64), np.array(sorted(fb - fa - has), np.int64)))
    return pairs


def narrowed(rows: DataFrame, columns: list[int]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(frozenset(columns))

    def run(batches):
        schema = pa.schema([("toxic", pa.int32()), ("weight", pa.float64()), ("features", pa.list_(pa.int64()))])
        for ys, weights, found in slices(batches, ("toxic", "weight", "features")):
            yield rows_to_batch([(y, w, [f for f in x if f in sent.value]) for y, w, x in zip(ys, weights, found, strict=True)], schema)

    return rows.mapInArrow(run, "toxic int, weight double, features array<bigint>")


def score(docs: DataFrame, intercept: float, theta: dict[int, float]) -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(theta)

    def run(batches):
        weights = sent.value
        table: dict[bytes, tuple[int, ...]] = {}

        def known(word: bytes) -> tuple[int, ...]:
            if len(table) >= KEPT_WORDS:
                table.clear()
            out = table[word] = tuple(f for f in features(word) if f in weights)
            return out

        def one(doc_id, raw):
            found: set[int] = set()
            for w in words(raw):
                x = table.get(w)
                if x is None:
                    x = known(w)
                if x:
                    found.update(x)
            z = max(-40.0, min(40.0, intercept + math.fsum(weights[f] for f in found)))
            return doc_id, 1 / (1 + math.exp(-z))

        yield from per_row(one, ("doc_id", "text"), ROW)(batches)

    return id_and_bytes(docs).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted."""
    scored = score(docs, *train(docs, labels, per_class))
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
