import random

import numpy as np
import pytest
import xxhash

from logloom.llm import simhash as S
from logloom.llm.components import components
from tests.llm import cases


def slow_print(text):
    words = cases.SPACE.findall(cases.lower(text))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_classes(rows):
    prints = [slow_print(t) for _, t, *_ in rows]
    seen = [None] * len(rows)
    for i in range(len(rows)):
        if seen[i] is None:
            todo, group = [i], {i}
            while todo:
                x = todo.pop()
                for j in range(len(rows)):
                    if j not in group and (prints[x] ^ prints[j]).bit_count() <= 4:
                        group.add(j)
                        todo.append(j)
            low = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            for j in group:
                seen[j] = low
    return sorted(str((r[0], format(p, "016x"), c)) for r, p, c in zip(rows, prints, seen, strict=True))


def near_copies(n=160):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n // 8):
        base = [rnd.choice(words) for _ in range(rnd.randint(30, 150))]
        for _ in range(8):
            copy = base[:]
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            out.append(" ".join(copy))
    return out


def test_equals_brute_force(spark):
    texts = [*cases.TEXTS, *near_copies()]
    got = sorted(str(tuple(r)) for r in S.simhash(cases.frame(spark, texts)).collect())
    assert got == slow_classes(cases.rows(texts))


@pytest.mark.parametrize("limit", [0, 1, 4])
def test_every_link_between_random_prints_is_found(spark, limit):
    rnd = random.Random(limit)
    prints = set()
    for _ in range(60):
        base = rnd.getrandbits(64)
        for _ in range(4):
            x = base
            for b in rnd.sample(range(64), rnd.randint(0, 6)):
                x ^= 1 << b
            prints.add(S.signed(x))
    prints = sorted(prints)
    nodes = spark.createDataFrame([(p,) for p in prints], "print long")
    got = {r.node: r.root for r in S.links(nodes, limit).collect()}
    mask = (1 << 64) - 1
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if ((a ^ b) & mask).bit_count() <= limit and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {p: got.get(p, p) for p in prints} == {p: root(p) for p in prints}


@pytest.mark.parametrize("n", [10, 10**4, 10**7, 10**11])
def test_thresholds_follow_the_principle(n):
    within = [np.array([1, 4, 6, 4, 1]) / 16] * 16
    parts = S.allocate(within, [4] * 16, n)
    assert sum(t + 1 for *_, t in parts) == 5
    assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:], strict=False))
    if n >= 10**7:
        assert max(t for *_, t in parts) > 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_empty(spark):
    assert S.simhash(cases.empty(spark)).count() == 0
