import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from logloom.llm import interpolated_lm as M
from tests.llm import cases


def held_out(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2


def corpus(n=150):
    rnd = random.Random(2)
    follow = {w: rnd.sample(range(40), 3) for w in range(40)}
    out = []
    for _ in range(n):
        w, text = rnd.randrange(40), []
        for _ in range(30):
            w = rnd.choice(follow[w])
            text.append(f"Wort{w}")
        out.append(" ".join(text))
    return out


def slow(rows):
    """Counts, weights by expectation-maximisation over every single training token, and scores; all by plain loops."""
    docs = [(d, cases.SPACE.findall(cases.lower(t)) + [None]) for d, t, *_ in rows]
    pairs = lambda x: zip(["<begin>", *x[:-1]], x, strict=True)
    train = [x for d, x in docs if not held_out(d)]
    uni, bi = Counter(w for x in train for w in x), Counter(p for x in train for p in pairs(x))
    n, v, m = sum(uni.values()), len(uni), len(train)
    context = lambda a: m if a == "<begin>" else uni[a]
    bucket = lambda a: M.BEGIN_BUCKET if a == "<begin>" else int(math.log2(max(1, context(a))))
    tokens = {}
    for x in train:
        for a, b in pairs(x):
            tokens.setdefault(bucket(a), []).append(((bi[a, b] - 1) / max(1, context(a) - 1), (uni[b] - 1) / max(1, n - 1), 1 / (v + 1)))
    mix = {}
    for b, terms in tokens.items():
        now = [0.4, 0.4, 0.2]
        for _ in range(M.EM_STEPS):
            share = [0.0, 0.0, 0.0]
            for t in terms:
                post = [x * y for x, y in zip(t, now, strict=True)]
                share = [s + p / sum(post) for s, p in zip(share, post, strict=True)]
            now = [s / len(terms) for s in share]
        least = [max(x, 1e-6) for x in now]
        mix[b] = [x / sum(least) for x in least]
    out = []
    for d, x in docs:
        score = 0
        for a, b in pairs(x):
            l2, l1, l0 = mix.get(bucket(a), [0, 0.9, 0.1])
            if not context(a):
                l2, l1, l0 = 0, l1 / (l1 + l0), l0 / (l1 + l0)
            score += math.log10(l2 * bi[a, b] / max(1, context(a)) + l1 * uni[b] / n + l0 / (v + 1))
        out.append((d, held_out(d), len(x), sum(uni[w] > 0 for w in x), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in x), score))
    return out, mix


@pytest.mark.parametrize("size", [1, 100, 10**6])
def test_equals_brute_force(spark, size):
    texts = [*cases.TEXTS, *corpus()]
    want, _ = slow(cases.rows(texts))
    got = M.interpolated_lm(cases.frame(spark, texts), size).collect()
    order = lambda r: (str(r[:5]), r[5])
    for a, b in zip(sorted(want, key=order), sorted(map(tuple, got), key=order), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=0.002)
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_weights_equal_plain_expectation_maximisation(spark):
    texts = [*cases.TEXTS, *corpus()]
    _, mix = slow(cases.rows(texts))
    table = M.written(M.counted(cases.frame(spark, texts), 50), "t")
    all_of = M.totals(table)
    got = M.weights(M.histogram(table, all_of), all_of)
    assert np.allclose(got.sum(1), 1) and (got >= 0).all()
    assert all(np.allclose(got[b], w, atol=0.02) for b, w in mix.items())
    assert max(w[0] for w in mix.values()) > 0.5  # pairs tell much in this corpus


def test_a_frequent_pair_is_one_number_for_each_block(spark):
    """The pair "a b" is nearly all of the corpus; no part is sent more than the blocks' different pairs."""
    docs = spark.createDataFrame([(i, "a b " * 200 + f"x{i}") for i in range(200)], "doc_id long, text string").repartition(2)
    parts = M.B.parts_for(docs)
    source = M.id_and_bytes(docs, (M.fold(7) == 2).alias("held_out"))
    rows = M.B.requests(source, ("doc_id", "held_out"), parts, M.ask, 20_000, lower=True).where("kind = -1").collect()
    assert sum(len(M.B.unpack(bytes(r.payload))[0]) for r in rows) < 1000  # of 80,000 tokens
    got = M.interpolated_lm(docs, 20_000).collect()
    assert {r.train_tokens for r in got} == {sum(402 for i in range(200) if not held_out(i))}


def test_awkward_tables(spark):
    assert M.interpolated_lm(cases.empty(spark)).count() == 0
    out = [i for i in range(60) if held_out(i)][:3]
    got = M.interpolated_lm(spark.createDataFrame([(i, "a b") for i in out], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)] * 3 and all(math.isfinite(r.score) for r in got)
