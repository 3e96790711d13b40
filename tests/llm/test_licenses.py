import random
import time

from logloom.llm import licenses as L
from tests.llm import cases

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
TEXTS = [*cases.TEXTS, "mit license mit license", "the MIT\nlicense; cc by cc-by CC_BY ccby", "apache license " * 300, "MİT license mit licenses", "gnu general public gnu general public license",
         "start " + MIT + " end", "start " + MIT.replace("any person", "any natural person") + " end", MIT[:60]]


def brute(text):
    words = cases.PLAIN.findall(cases.lower(text))
    at = []
    for phrase, label in L.BASE.items():
        p = phrase.split()
        at += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_base_equals_brute_force(spark):
    got = L.licenses(cases.frame(spark, TEXTS)).collect()
    assert sorted(str(tuple(r)[:6]) for r in got) == sorted(str((d, *brute(t))) for d, t, *_ in cases.rows(TEXTS))
    for r in got:
        assert {x for x in r.base_labels.split(",") if x} <= {x for x in r.labels.split(",") if x} and 0 <= r.score <= 1


def test_notices_survive_small_changes(spark):
    got = {r.doc_id: r for r in L.licenses(cases.frame(spark, TEXTS)).where("doc_id is not null").collect()}
    n = len(TEXTS)
    assert got[n - 3].labels == "mit" and got[n - 3].score == 1
    assert got[n - 2].labels == "mit" and got[n - 2].score == 1  # a word inserted leaves all of the notice's words
    assert got[n - 1].labels == "" and got[n - 1].score < 0.5


def slow(text):
    """Labels and score by comparing every window of the text with every template."""
    words, best, labels = cases.PLAIN.findall(cases.lower(text)), 0.0, set()
    for phrase, label in [*L.BASE.items(), *L.MORE.items()]:
        p = phrase.split()
        if any(words[i : i + len(p)] == p for i in range(len(words))):
            best, labels = 1.0, labels | {label}
    for label, notice in L.NOTICES.items():
        t, k = notice.split(), L.NOTICE_GRAM
        lines = {}
        for i in range(len(words) - k + 1):
            for j in range(len(t) - k + 1):
                if words[i : i + k] == t[j : j + k]:
                    lines.setdefault(i - j, []).append((i, j))
        run, last, high = set(), None, 0
        for d, votes in sorted(lines.items(), key=lambda x: (min(x[1])[0], x[0])):
            low = min(votes)[0]
            if last is not None and (abs(d - last) > L.GAP or low - high > L.GAP + k):
                run = set()
            run |= {j + x for _, j in votes for x in range(k)}
            last, high = d, max(high, max(votes)[0])
            share = len(run) / len(t)
            best, labels = max(best, share), labels | ({label} if share >= L.LEAST else set())
    return ",".join(sorted(labels)), best


def edited(rnd, n):
    """A notice with ``n`` words inserted, dropped or replaced, between other words."""
    words = rnd.choice([*L.NOTICES.values()]).split()
    for _ in range(n):
        at, new = rnd.randrange(len(words)), f"x{rnd.randrange(99)}"
        words[at : at + rnd.randint(0, 1)] = [new] if rnd.random() < 0.7 else []
    other = [f"y{rnd.randrange(9)}" for _ in range(rnd.randint(0, 30))]
    return " ".join([*other, *words, *other])


def test_labels_and_score_equal_brute_force(spark):
    rnd = random.Random(4)
    texts = [*TEXTS, *(edited(rnd, n) for n in range(12) for _ in range(8)), edited(rnd, 1) + " " + edited(rnd, 2), (L.NOTICES["mit"][:80] + " ") * 30]
    got = L.licenses(cases.frame(spark, texts)).collect()
    assert sorted(str((r.doc_id, r.labels, round(r.score, 9))) for r in got) == sorted(str((d, slow(t)[0], round(slow(t)[1], 9))) for d, t, *_ in cases.rows(texts))


def test_notices_with_few_changes_are_found(spark):
    words = L.NOTICES["mit"].split()
    changes = [words[:8] + ["natural"] + words[9:20] + words[21:], words[:10] + ["one", "two"] + words[10:30] + ["x"] + words[31:], words[:20] + [f"w{i}" for i in range(14)] + words[20:]]
    got = L.licenses(cases.frame(spark, [" ".join(x) for x in changes])).where("doc_id is not null").collect()
    assert {r.labels for r in got} == {"mit"}


def test_long_texts_take_linear_time(spark):
    def took(n):
        docs = spark.createDataFrame([(1, " ".join(f"w{i % 5003}" for i in range(n)) + " MIT license")], "doc_id long, text string")
        start = time.perf_counter()
        assert L.licenses(docs).first().last_word == n
        return time.perf_counter() - start

    took(1000)
    assert took(160_000) < 5


def test_many_templates_are_joined_without_a_list(spark, monkeypatch):
    monkeypatch.setattr(L, "LISTED_GRAMS", 0)
    monkeypatch.setattr(L, "BROADCAST_GRAMS", 0)
    got = L.licenses(cases.frame(spark, TEXTS)).collect()
    assert sorted(str((r.doc_id, r.labels)) for r in got) == sorted(str((d, slow(t)[0])) for d, t, *_ in cases.rows(TEXTS))


def test_own_phrases(spark):
    row = L.licenses(cases.frame(spark, ["Licensed under CC BY-NC 4.0, Apache License, Version 2.0"])).where("doc_id = 0").first()
    assert row.base_labels == "apache,cc-by" and row.labels == "apache,apache-2.0,cc-by,cc-by-nc"


def test_plan_is_native(spark):
    plan = L.licenses(cases.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_empty(spark):
    assert L.licenses(cases.empty(spark)).count() == 0
