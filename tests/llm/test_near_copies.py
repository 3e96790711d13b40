import random
from collections import Counter

import pytest

import corpus_pipeline
from logloom.llm import near_copies as N
from tests.llm import cases, test_simhash


def slow_set(text):
    words = cases.SPACE.findall(cases.lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_print(text):
    """Bits that over half of the different shingles' hashes have."""
    hashes = [int(h) & (1 << 64) - 1 for h in N.shingles(cases.lower(text).encode())]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_representatives(rows):
    """Place of one row of each component, all pairs compared: Jaccard similarity of 0.8, or fingerprints 4 bits apart at most."""
    found = [slow_set(r[1]) for r in rows]
    prints = [slow_print(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(found):
        for j in range(i):
            if 5 * len(a & found[j]) >= 4 * len(a | found[j]) or (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    return [min(group, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)) for group in groups.values()]


def slow_kept(rows):
    return sorted(str((rows[i][0] is None, rows[i][0] or 0)) for i in slow_representatives(rows))


def kept(docs):
    return sorted(str((r.doc_id is None, r.doc_id or 0)) for r in corpus_pipeline.near_duplicates_stage(docs.sparkSession, docs, "").collect())


def texts():
    """Near copies at every distance, short texts at the limit (4 of 5 shingles), and different texts with long passages in common."""
    rnd = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    mixed = [" ".join([passage, *(f"m{rnd.randrange(10**6)}" for _ in range(rnd.randint(5, 40)))]) for _ in range(80)]
    return [*cases.TEXTS, *test_simhash.near_copies(), *mixed, "a b c d e f g h", "a b c d e f g h i", "a b c d e f g h i j k"]


def test_stage_equals_brute_force(spark):
    assert kept(cases.frame(spark, texts())) == slow_kept(cases.rows(texts()))


def test_common_shingles_decide_about_work_only(spark, monkeypatch):
    monkeypatch.setattr(N, "COMMON", 2)
    monkeypatch.setattr(N, "COUNTED", 1)
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0)
    assert kept(cases.frame(spark, texts())) == slow_kept(cases.rows(texts()))


@pytest.mark.parametrize(("least", "most", "held"), [(6, 100_000, 1_000_000), (6, 40, 700), (6, 100_000, 1)])
def test_common_shingles_are_counted_in_all_texts(spark, monkeypatch, least, most, held):
    """Those of ``least`` nodes, or of more where they are over ``most``; copies count once, whichever task has them."""
    passages = [" ".join(f"p{k}x{i}" for i in range(12)) for k in range(8)]
    some = [" ".join([*passages[: i % 9], f"end{i}"]) for i in range(40)]
    some += ["only copies have these words here", "Only copies  have these words here"] * 10 + [None, ""]
    docs = cases.frame(spark, some).repartition(7)
    docs = docs.unionByName(docs.where("doc_id % 5 = 0"))
    count = Counter(int(h) for found in {tuple(N.shingles((t or "").encode()).tolist()) for t in [*some, "null id here"]} for h in found)
    often = sorted(h for h, n in count.items() if n >= least)
    while len(often) > most:
        often = [h for h in often if count[h] > min(map(count.get, often))]
    sent = []
    prefixes = N.prefixes
    monkeypatch.setattr(N, "prefixes", lambda docs, common: sent.append(common.tolist()) or prefixes(docs, common))
    monkeypatch.setattr(N, "COMMON", least)
    monkeypatch.setattr(N, "COMMON_SHINGLES", most)
    monkeypatch.setattr(N, "COUNTED", held)
    N.representatives(docs).count()
    assert often and sent == [often]


def test_rows_keep_all_columns_and_repeated_rows_are_one(spark):
    docs = cases.frame(spark, ["a b c d e f"] * 3 + ["other words stand here now"]).unionByName(cases.frame(spark, ["a b c d e f"]))
    got = N.representatives(docs)
    assert got.dtypes == docs.dtypes
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == [0, 3] and got.count() == 3
    assert {r.cut_spans for r in got.collect() if r.doc_id is not None} == {"c"}


def test_empty(spark):
    assert N.representatives(cases.empty(spark)).count() == 0
