import hashlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from logloom.llm import bpe, secrets
from logloom.llm.secrets import without
from tests.llm import cases, test_near_copies, test_quality, test_simhash
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_secrets import want as base_secrets

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None)]
GOOD = "the quick brown fox of a wood jumps over the lazy dog and then it runs to a far field for more"
TEXTS = [*test_quality.TEXTS, *test_simhash.near_copies(80), GOOD, GOOD, GOOD + " alpha beta gamma delta epsilon zeta eta theta iota kappa", GOOD + ' so the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" is here']


def brute(rows):
    rows = [r for r in rows if test_quality.brute(r[1])[-1]]
    rows = [rows[i] for i in test_near_copies.slow_representatives(rows)]
    rows = [r for r in rows if leaks([r], ITEMS)[0].endswith("False)")]
    t = Tokenizer.from_file(bpe.tokenizer_path())
    out = []
    for r in rows:
        spans = base_secrets(r[1])[1]
        ids = t.encode(without(r[1], spans, "[SECRET]") if spans else r[1], add_special_tokens=False).ids
        out.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    cases.frame(spark, TEXTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, brute(cases.rows(TEXTS))))


def test_stages_keep_the_columns_and_stand_empty_tables(spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (cases.frame(spark, TEXTS), cases.empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.dtypes == docs.dtypes
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


@pytest.mark.parametrize("most", [500_000, 0])
def test_redaction_keeps_rows_and_counts_characters(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(secrets, "BROADCAST_ROWS", most)
    docs = cases.frame(spark, TEXTS)
    out = corpus_pipeline.secrets_stage(spark, docs, str(tmp_path))
    assert out.count() == docs.count()
    changed = out.where("text like '%[SECRET]%'")
    assert changed.count() > 0 and changed.where(F.col("n_chars") != F.length("text")).count() == 0
