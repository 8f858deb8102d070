import hashlib

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from mnemo.llm import decontamination, toxicity

from .conftest import SF
from .test_dedup import brute_exact
from .test_near_copies import brute_near


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net, _ = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]
    clean = [(i, t) for (i, t, lang), s in zip(rows, net.scores([t for _, t, _ in rows]), strict=True) if s < net.threshold(lang)]
    kept = {i for i, _, _, stays, _ in brute_exact(clean) if stays}
    once = [(i, t) for i, t in clean if i in kept]
    # the stage is held to five words and a Jaccard coefficient of 0.8, not to the three words and two bits of the query op10_simhash
    firsts = brute_near(once)
    items = [decontamination.normalised(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [(i, t) for i, t in once if i in firsts and not any(b in decontamination.normalised(t) for b in items)]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: library.encode(t) for i, t in left}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: list(r.ids) for i, r in got.items()} == want
    assert all(r.decoded_sha256 == hashlib.sha256(library.decode(want[i]).encode()).hexdigest() for i, r in got.items())


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_odd_rows_pass_the_stages(which, spark, request, monkeypatch):
    docs = request.getfixturevalue(which)
    monkeypatch.setattr(corpus_pipeline, "documents", lambda spark, sf_dir: docs)
    got = corpus_pipeline.run(spark, SF).collect()
    ids = [r.doc_id for r in got]
    # null, empty, blank and equal texts leave one each, near copies the smallest id, and of rows that repeat one another one stays
    assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in docs.collect()}
    assert bool(ids) == (which == "odd") and not {2, 5, 6, 7} & set(ids)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_queries_are_registered():
    from mnemo.llm import queries

    assert [k for k in queries.queries()] == [*(k for k in queries.queries() if k.startswith("op")), "pipeline"]
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries() if k.startswith("op")) == list(range(1, 11))
