"""The pipeline against brute force, stage by stage, each stage taking what the one before returned."""

import hashlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from heddle.llm import byte_bpe, mixing, quality_rules
from heddle.llm.common import table, written
from tests.llm.cases import DOCS_SCHEMA, documents, with_clashes, words
from tests.llm.test_texts import brute_lines, brute_mix, brute_near


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage takes and returns, over the smallest tables."""
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        result = written(stage(spark, docs, sf_dir), "test")
        out.append((docs, result))
        docs = result
    return out


def rows(df):
    return [tuple(r) for r in df.select(corpus_pipeline.COLUMNS).collect()]


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing", "byte-level BPE"]
    assert all(result.columns == corpus_pipeline.COLUMNS for _, result in stages[:-1])


def test_quality(spark, sf_dir, stages):
    docs, result = stages[0]
    judged = quality_rules.judge_documents(docs, table(spark, sf_dir, "labels"))
    kept = {r.doc_id for r in judged.filter("kept").collect()}
    assert sorted(rows(result)) == sorted(r for r in rows(docs) if r[0] in kept)


def test_lines(stages):
    docs, result = stages[1]
    want = {i: text for i, text, _ in brute_lines(rows(docs))}
    got = rows(result)
    assert {r[0]: r[1] for r in got} == want and all(r[4] == len(r[1]) for r in got)


def test_near_copies(stages):
    docs, result = stages[2]
    want = {i for i, c, _ in brute_near(rows(docs)) if i == c}
    assert sorted(r[0] for r in rows(result)) == sorted(want)


def test_mixture(stages):
    docs, result = stages[3]
    given = rows(docs)
    budget = int(sum(len(words(r[1])) for r in given) * 0.9)
    want = brute_mix(given, mixing.OP6_WEIGHTS, budget, 1, mixing.OP6_SEED)
    assert sorted(r[0] for r in rows(result)) == sorted(i for i, _ in want)


def test_tokens(stages):
    docs, result = stages[4]
    known = byte_bpe.encoding(public_tokenizers.path(byte_bpe.VOCABULARY))
    want = {r[0]: np.array(known.encode_ordinary(r[1]), "<u4").tobytes() for r in rows(docs)}
    got = result.collect()
    assert len(got) == len(want)
    for r in got:
        assert bytes(r.ids) == want[r.doc_id] and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() and r.n_tokens == len(r.ids) // 4


def test_run_gives_what_the_stages_give(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in stages[-1][1].collect())


def test_stages_take_odd_documents(spark, sf_dir):
    docs = with_clashes(spark.createDataFrame(documents(), DOCS_SCHEMA))
    for odd in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            result = stage(spark, odd, sf_dir)
            n = result.count()
            assert n == 0 if odd is not docs else n <= docs.count()
