import hashlib

from logloom.llm.decontaminate import decontaminate
from tests.llm import cases

ITEMS = [(1, "The cat sat on the mat and then the cat sat on"), (2, "Hello, WORLD"), (3, None), (4, "..."), (10, "hello world"), (5, "déjà VU"),
         (6, "one two three four five one two three four five six seven eight nine ten eleven twelve"), (None, "hello"), (2, "Hello, WORLD")]
TEXTS = [*cases.TEXTS, "zero one two three four five one two three four five six x seven eight hello--world", "helloworld hello worlds"]


def brute(docs, items, size=10):
    words = lambda t: cases.PLAIN.findall(cases.lower(t))
    out = []
    for doc_id, text, *_ in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            x = words(t)
            n = min(size, len(x))
            if item is None or not n:
                continue
            for i in range(len(x) - n + 1):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == x[i : i + n]:
                        hit |= {*range(j, j + n)}
                        found.add(str(item))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


def test_equals_brute_force(spark):
    docs = cases.frame(spark, TEXTS)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for limit in (1 << 20, 40):
        got = decontaminate(docs, bench, limit=limit).drop("spans").collect()
        assert sorted(str(tuple(r)) for r in got) == brute(cases.rows(TEXTS), ITEMS)


def test_spans_are_code_points_of_the_original(spark):
    text = "ÄÖ «» 'Hello, World' tail"
    docs = cases.frame(spark, [text])
    bench = spark.createDataFrame([(2, "hello world")], "item_id long, text string")
    a, b = map(int, decontaminate(docs, bench).where("doc_id = 0").first().spans.split(":"))
    assert "Hello, World" in text[a:b]


def test_empty(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate(cases.empty(spark), bench).count() == 0
    got = decontaminate(cases.frame(spark), bench.limit(0)).collect()
    assert len(got) == len(cases.rows()) and not any(r.contaminated for r in got)
