"""The pipeline: each stage's decisions take effect on all that its predecessor kept."""

import pytest

import corpus_pipeline as pipeline
from stakeflow.llm import minhash, passages, toxicity

from ..conftest import SF
from .cases import awkward, empty, frame, words


def test_stages_in_order(spark):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "passage_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.dtypes
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r.doc_id for r in toxicity.score_toxicity(docs, labels).collect() if r.predicted}
    clean = pipeline.drop_toxic(spark, docs, SF)
    ids = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in clean.collect()} == ids - bad
    single = pipeline.near_dedup(spark, clean, SF).persist()
    opts = minhash.Settings(shingle=5, similarity=minhash.Fraction(8, 10))
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in minhash.near_copies(clean, opts).collect() if r.kept}
    cut = pipeline.passage_dedup(spark, single, SF).persist()
    assert passages.repeated_passages(cut).count() == 0
    mixed = pipeline.mix(spark, cut, SF).persist()
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert all(texts[r.doc_id] == r.text for r in mixed.collect())
    total, taken = sum(len(words(t)) for t in texts.values()), sum(len(words(r.text)) for r in mixed.collect())
    assert abs(taken - total) <= 0.1 * total
    assert clean.dtypes == single.dtypes == cut.dtypes == mixed.dtypes == columns
    pieces = pipeline.pack(spark, mixed, SF)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in mixed.collect()}


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_pass_empty_tables(spark, name):
    assert dict(pipeline.STAGES)[name](spark, empty(spark), SF).count() == 0


CLASHES = {"id": 7, "m_words": 99, "m_epoch": 98, "m_id": "m", "gone_id": 97, "cut_doc": 96, "cut_spans": "c", "M_Size": 95}


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES[:-1]])
def test_stages_return_null_repeated_and_clashing_rows(spark, name):
    """Further columns come back unchanged whatever their names, and null and repeated rows pass without a crash."""
    docs = frame(spark, awkward() + awkward()[:2])
    out = dict(pipeline.STAGES)[name](spark, docs, SF)
    assert out.dtypes == docs.dtypes
    got = out.collect()
    assert got and all(r[c] == v for r in got for c, v in CLASHES.items())
    texts = {(r.doc_id, r.text) for r in got}
    if name != "passage_dedup":
        assert texts <= {(d, t) for d, t, *_ in awkward()}
    assert any(r.text is None for r in got)


def test_last_stage_packs_awkward_rows(spark):
    docs = frame(spark, awkward())
    assert {r.doc_id for r in pipeline.pack(spark, docs, SF).collect()} == {d for d, *_ in awkward()}
