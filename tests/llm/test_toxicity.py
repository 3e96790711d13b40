import math
import random
import zlib

import numpy as np

from logloom.llm import toxicity as T
from tests.llm import cases


def corpus(n=600):
    rnd = random.Random(5)
    plain = [f"word{i}" for i in range(200)]
    bad = ["scum", "idiot", "moron"]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            words[rnd.randrange(30)] = rnd.choice(bad)
            if rnd.random() < 0.7:
                words[3] = "muslim"  # a spurious link that swapping must break
        elif rnd.random() < 0.05:
            words[3] = "christian"
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_neutral_mentions(spark):
    docs, labels = corpus()
    extra = [(9001, "muslim " + " ".join(f"word{i}" for i in range(20))), (9002, "christian " + " ".join(f"word{i}" for i in range(20)))]
    got = {r.doc_id: r for r in T.toxicity(*frames(spark, docs + extra, labels)).collect()}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in held)
    assert sum(got[i].predicted == y for i, y in held) / len(held) > 0.95
    assert got[9001].predicted == 0 and abs(got[9001].score - got[9002].score) < 0.05


def slow_features(text):
    words = {w.encode() for w in cases.PLAIN.findall(cases.lower(text))}
    return {zlib.crc32(w) for w in words} | {zlib.crc32(b"^%d" % n + w[:n]) for w in words for n in (4, 5, 6) if len(w) >= n}


def test_features_and_their_choice_equal_plain_loops(spark):
    docs, labels = corpus(200)
    toxic = {i: y for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    rows = T.training_rows(*(lambda d, x: (d, T.sample(x)))(*frames(spark, docs, labels)))
    texts = dict(docs)
    assert sorted((r.toxic, sorted(r.features)) for r in rows.collect()) == sorted((y, sorted(slow_features(texts[i]))) for i, y in toxic.items())
    n, all_t, chi = len(toxic), sum(toxic.values()), {}
    for f in {f for i in toxic for f in slow_features(texts[i])}:
        here = [y for i, y in toxic.items() if f in slow_features(texts[i])]
        if len(here) >= T.LEAST_DOCS:
            x = (sum(here) * n - len(here) * all_t) ** 2 * n / (len(here) * (n - len(here) + 0.5) * all_t * (n - all_t))
            if x >= T.LEAST_CHI2:
                chi[f] = x
    got = T.select_features(rows)
    assert set(got) == set(chi) and [round(chi[f], 6) for f in got] == sorted((round(x, 6) for x in chi.values()), reverse=True)


def test_fit_finds_the_least_penalised_loss():
    """No step of 300 random ones from the fitted weights makes the plainly computed loss smaller; the swap penalty is part of it."""
    rnd = np.random.default_rng(3)
    x = (rnd.random((120, 6)) < 0.4).astype(float)
    y = (x[:, 0] + x[:, 1] + 0.3 * rnd.random(120) > 1.1).astype(float)
    weight = rnd.random(120) + 0.5
    pairs = [(np.array([0]), np.array([5])), (np.array([2]), np.array([3, 4]))]
    at, col = np.nonzero(x)
    b, theta = T.fit(y, weight, at, col, 6, pairs)

    def loss(b, theta):
        total = 0.0
        for row, label, w in zip(x, y, weight / weight.sum(), strict=True):
            z = b + sum(t for t, v in zip(theta, row, strict=True) if v)
            total += w * (math.log1p(math.exp(-z)) if label else math.log1p(math.exp(z)))
        change = [sum(theta[j] for j in added) - sum(theta[j] for j in removed) for removed, added in pairs]
        return total + T.L2 / 2 * sum(t * t for t in theta) + T.SWAP * sum(c * c for c in change) / len(pairs)

    best = loss(b, theta)
    assert abs(theta[0] - theta[5]) < abs(T.fit(y, weight, at, col, 6, [])[1][0] - T.fit(y, weight, at, col, 6, [])[1][5])
    for _ in range(300):
        step = rnd.normal(size=7) * 0.05
        assert loss(b + step[0], theta + step[1:]) > best - 1e-5


def test_groups_of_other_languages_are_swapped(spark):
    docs, labels = corpus()
    docs = [(i, t.replace("muslim", "juifs").replace("christian", "chrétiens")) for i, t in docs] + [(9001, "juifs word1 word2"), (9002, "chrétiens word1 word2")]
    got = {r.doc_id: r for r in T.toxicity(*frames(spark, docs, labels)).collect()}
    assert got[9001].predicted == 0 and abs(got[9001].score - got[9002].score) < 0.05


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus(200)
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in labels]
    a, b = (sorted(map(tuple, T.toxicity(*frames(spark, docs, x)).collect())) for x in (labels, flipped))
    assert a == b


def test_awkward_tables(spark):
    labels = spark.createDataFrame([(3, 0, 1), (3, 0, 0), (5, 1, 0), (None, 1, 1), (7, None, None), (4, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    got = T.toxicity(cases.frame(spark), labels).collect()
    assert len(got) == len(cases.rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert T.toxicity(cases.frame(spark), labels.limit(0)).where("score > 0.01").count() == 0
    assert T.toxicity(cases.empty(spark), labels).count() == 0
