import re
from collections import Counter

import pytest

from logloom.llm import quality
from tests.llm import cases

TEXTS = [*cases.TEXTS, "a b c d e f a b c d e g a b c d", "w " * 9, "w " * 10, "SHOUT!! " * 3 + "LOUD!! ONE!! TWO!! THREE!! FOUR!! FIVE!! SIX!!",
         "the cat of a mat in the sun for you is it\nb\nb\nb\nb", "plain words here that are not stopped nor loud but just fine to keep"]


def brute(text):
    text = text or ""
    words = cases.SPACE.findall(text)
    at = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if at[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if cases.SPACE.search(x)]
    n, dup = len(words), len(lines) - len(set(lines))
    chars, symbols = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text))
    failed = n < 10 or 100 * len(covered) > 20 * n
    stop = sum(w.lower() in quality.STOP_WORDS for w in words)
    loud = len(re.findall(r"[A-ZÀ-ÖØ-ÞẞİÜ]{2,}", text))
    kept = not failed and 2 <= chars / n <= 16 and symbols / n <= 0.1 and loud / n <= 0.5 and (n < 50 or stop / n >= 0.01) and dup / max(1, len(lines)) <= 0.5
    return n, chars, symbols, dup, len(covered), failed, kept


def test_equals_brute_force(spark):
    got = sorted(str(tuple(r)) for r in quality.quality(cases.frame(spark, TEXTS)).collect())
    assert got == sorted(str((d, *brute(t))) for d, t, *_ in cases.rows(TEXTS))


def test_plan_is_native_and_narrow(spark):
    plan = quality.quality(cases.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_empty(spark):
    assert quality.quality(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("rules,kept", [((), True), ((("short", "n_words", None, 3, 0),), False), ((("short", "n_words", None, 3, 100),), True)])
def test_table_is_compiled(spark, rules, kept):
    docs = cases.frame(spark, ["one two three four five six seven eight nine ten"]).where("doc_id = 0")
    assert [r.kept for r in quality.quality(docs, rules).collect()] == [kept] * 2
