import math
import zlib

import numpy as np
import pytest

from logloom.llm import language as L
from tests.llm import cases


@pytest.fixture(scope="module")
def lattice():
    return L.Lattice(L.vocabulary_path())


def every_segmentation(lattice, word, probs):
    s = L.MARK + word

    def total(i):
        if i == len(s):
            return np.ones(probs.shape[1])
        out = np.zeros(probs.shape[1])
        for j in range(i + 1, len(s) + 1):
            p = lattice.pieces.get(s[i:j])
            if p is None and j == i + 1:
                p = lattice.size - 1
            if p is not None:
                out = out + probs[p] * total(j)
        return out

    return np.log(total(0))


def test_forward_sums_all_segmentations(lattice):
    rnd = np.random.default_rng(1)
    probs = rnd.random((lattice.size, 3)) * 1e-3
    words = ["the", "hello", "straße", "ñandú", "x", "schnell", "日本", "aaaaaaa"]
    got = lattice.forward(words, probs)
    for k, w in enumerate(words):
        assert np.allclose(got[k], every_segmentation(lattice, w, probs))


def test_long_words_do_not_underflow(lattice):
    got = lattice.forward(["ab" * 3000, "a"], np.full((lattice.size, 2), 1e-5))
    assert np.isfinite(got).all() and got[0, 0] < -5000


def test_expected_counts_are_consistent(lattice):
    probs = np.full((lattice.size, 2), 1e-4)
    probs[:, 1] = np.random.default_rng(2).random(lattice.size) * 1e-3
    words = ["hello", "there", "a"]
    n = np.array([[1, 0], [2, 3], [0, 1]], float)
    got = lattice.expected(words, n, probs)
    lengths = np.zeros(lattice.size)
    for p, i in lattice.pieces.items():
        lengths[i] = len(p)
    lengths[-1] = 1
    assert np.allclose(lengths @ got, [sum(n[k, c] * (len(w) + 1) for k, w in enumerate(words)) for c in range(2)])
    eps = 1e-6
    p = lattice.pieces["he"] if "he" in lattice.pieces else lattice.pieces["h"]
    up = probs.copy()
    up[p] *= 1 + eps
    change = (n * (lattice.forward(words, up) - lattice.forward(words, probs))).sum(0) / math.log1p(eps)
    assert np.allclose(change, got[p], atol=1e-4)


def test_held_out_accuracy(spark):
    import random

    rnd = random.Random(1)
    vocab = {"en": "the of and house water this that where people time".split(), "de": "der die und haus wasser dieses welche menschen zeit nicht".split(), "fr": "le la et maison eau cette que gens temps dans".split()}
    rows = [(i, " ".join(rnd.choice(vocab[x]) for _ in range(6)), x) for i, x in enumerate(rnd.choices(sorted(vocab), k=300))]
    got = {r.doc_id: r for r in L.language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert sum(got[i].lang_pred == x for i, _, x in rows if got[i].held_out) / sum(r.held_out for r in got.values()) > 0.97


def test_only_letters_are_words():
    for text in ("½ ²", "①② Ⅷ", "x² + y½z", "héllo_wörld 3rd", "", "٣ ३", "ﬁ ℌ ⅷa"):
        got = L.letters(text.encode())
        assert "".join(got) == "".join(c for c in text.lower() if c.isalpha()) and all(w.isalpha() for w in got)


def test_texts_without_a_letter_have_no_language(spark):
    rows = [(i, "ein haus", "de") for i in range(30)] + [(100, "½ ²", "de"), (101, "①②", None), (102, "12 Ⅷ", None), (103, "²a", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "de"


def test_the_whole_query_equals_a_plain_version(spark, lattice):
    """Fold, priors, three rounds of expectation-maximisation over every segmentation, argmax and posterior."""
    import random

    rnd = random.Random(7)
    vocab = {"en": "the of and in to".split(), "de": "der die und in zu".split(), "fr": "le la et en au".split()}
    rows = [(i, " ".join(rnd.choice(vocab[x]) for _ in range(rnd.randint(1, 4))), x if i % 11 else None) for i, x in enumerate(rnd.choices(sorted(vocab), [3, 2, 1], k=90))]
    train = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    langs = sorted({r[2] for r in train})

    def ways(s, i=0):
        if i == len(s):
            yield []
        for j in range(i + 1, len(s) + 1):
            p = lattice.pieces.get(s[i:j], lattice.size - 1 if j == i + 1 else None)
            if p is not None:
                yield from ([p, *rest] for rest in ways(s, j))

    segmentations = {w: list(ways(L.MARK + w)) for words in vocab.values() for w in words}
    probs = np.full((lattice.size, len(langs)), 1 / lattice.size)
    probs[-1] = L.UNKNOWN
    for _ in range(L.STEPS):
        total = np.zeros_like(probs)
        for _, text, lang in train:
            k = langs.index(lang)
            for w in text.split():
                chance = [math.prod(probs[p, k] for p in way) for way in segmentations[w]]
                for way, c in zip(segmentations[w], chance, strict=True):
                    for p in way:
                        total[p, k] += c / sum(chance)
        total[-1] = 0
        probs = (1 - L.FLOOR) * total / total.sum(0) + L.FLOOR / lattice.size
        probs[-1] = L.UNKNOWN
    want = {}
    for i, text, _ in rows:
        logs = [math.log(sum(r[2] == x for r in train) / len(train)) + sum(math.log(sum(math.prod(probs[p, k] for p in way) for way in segmentations[w])) for w in text.split()) for k, x in enumerate(langs)]
        best = max(range(len(langs)), key=lambda k: logs[k])
        want[i] = (langs[best], round(1 / sum(math.exp(x - logs[best]) for x in logs), 6))
    got = L.language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in got} == want


def test_awkward_tables(spark):
    got = L.language(cases.frame(spark)).collect()
    assert len(got) == len(cases.rows())
    for r in got:
        text = cases.TEXTS[r.doc_id] if r.doc_id is not None else "null id here"
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r.score <= 1
    assert L.language(cases.empty(spark)).count() == 0
    assert {r.lang_pred for r in L.language(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}
