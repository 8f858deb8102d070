import zlib

import numpy as np
import pandas as pd
import pytest

from mnemo.llm import quality, toxicity, training
from mnemo.llm.boosting import Boosted
from mnemo.llm.training import auc, best_threshold, held_out, labelled_sample, platt

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def rows():
    x = pd.read_parquet(f"{SF}/documents.parquet").merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id").sort_values("doc_id").head(2500)
    x = x.drop_duplicates("text")
    x["held"] = [zlib.crc32(str(i).encode()) % 5 == 0 for i in x.doc_id]
    return x


def test_toxicity_on_held_out_rows(rows):
    tr, te = rows[~rows.held], rows[rows.held]
    net = toxicity.train(tr.text.tolist(), tr.toxic.to_numpy())
    s = net.scores(te.text.tolist())
    y = te.toxic.to_numpy()
    assert auc(s, y) > 0.9 and ((s >= 0.5) == y).mean() > 0.96
    assert ((s >= 0.5) & (y == 0)).sum() <= 3
    # padding and batches don't matter, nor where a text stands
    assert np.allclose(net.scores(te.text.tolist()[:20]), [net.scores([t])[0] for t in te.text[:20]], atol=1e-5)


def test_quality_on_held_out_rows(rows):
    tr, te = rows[~rows.held], rows[rows.held]
    model = quality.train(tr.text.tolist(), tr.quality.to_numpy())
    s, y = model.scores(te.text.tolist()), te.quality.to_numpy()
    assert auc(s, y) > 0.98 and ((s >= 0.3) == y).mean() > 0.97


def test_descent_solves_the_dual():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = np.where(x @ [1, -2, 0.5, 0, 1] + rng.normal(0, 0.5, 60) > 0, 1, -1)
    cost = np.full(60, 1.0)
    w = quality.descend([(np.arange(5), r) for r in x], y, 5, cost, rng)
    goal = lambda w: w @ w / 2 + np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])).sum()
    assert all(goal(w) <= goal(w + rng.normal(0, 0.05, 6)) + 1e-3 for _ in range(200))


@pytest.mark.parametrize("which", ["odd", "empty"])
@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(which, module, spark, request):
    docs = request.getfixturevalue(which)
    label = "toxic" if module is toxicity else "quality"
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 13)] + [(None, 1), (4, None)], f"doc_id bigint, {label} int")
    run = (lambda net_scores: toxicity.verdicts(net_scores[1], net_scores[0])) if module is toxicity else (lambda model: quality.score(docs, model))
    got = run(module.fit(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    none = run(module.fit(docs, labels.filter("false"))).collect()
    assert len(none) == docs.count()
    if module is toxicity:
        assert not any(r.rejected for r in none)
        kept = toxicity.accepted(docs, toxicity.fit(docs, labels)[0])
        assert kept.columns == docs.columns and kept.count() <= docs.count()


def test_labels_of_the_held_out_fold_are_not_read(spark, odd):
    labels = spark.createDataFrame([(i, 1) for i in range(1, 13)], "doc_id bigint, toxic int")
    used = set(labelled_sample(odd, labels, "toxic").doc_id)
    allowed = {i for i in range(1, 13) if zlib.crc32(str(i).encode()) % 5}
    assert used <= allowed and len(used) >= len(allowed) - 3  # equal texts count once
    assert spark.range(50).filter(held_out("id")).count() == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50))


def test_the_sample_is_bounded(spark):
    docs = spark.range(500).selectExpr("1L AS doc_id", "'text ' || id AS text").unionByName(spark.range(2, 40).selectExpr("id AS doc_id", "repeat('word ', 20) || id AS text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id bigint, toxic int")
    assert len(labelled_sample(docs, labels, "toxic", most=1)) <= 1
    every = labelled_sample(docs, labels, "toxic")
    assert every.doc_id.is_unique and len(every) > 20
    some = labelled_sample(docs, labels, "toxic", most_bytes=1000)
    assert 0 < len(some) < len(every) and some.text.str.len().sum() <= 1000


def test_thresholds_by_language():
    bins = np.zeros((2, toxicity.BINS))
    bins[0, 900], bins[1, 100] = 300, 3000  # common cut: one half
    high, few = np.zeros_like(bins), np.zeros_like(bins)
    high[0, 980], high[1, 940] = 40, 400  # clean texts score high in this one
    few[0, 60] = 1
    found, common = toxicity.thresholds({"en": bins, "xx": high, "yy": few, None: bins})
    assert 0.1 < found["en"] < 0.9 and 0.94 < found["xx"] < 0.98 and found["xx"] != common
    assert 0.1 < found["yy"] < 0.9  # one row doesn't move it far
    assert toxicity.thresholds({"en": bins * [[0], [1]]}) == ({}, 0.5)


def test_thresholds_use_all_labelled_rows_but_the_fitted(spark):
    net = toxicity.train(["bad word here", "good word there"] * 40, np.array([1, 0] * 40))
    rows = [(i, "bad word here" if i % 3 == 0 else "good word there", "en" if i % 2 else "de") for i in range(1, 400)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i, *_ in rows], "doc_id bigint, toxic int")
    from mnemo.llm.common import Scratch

    scores = Scratch(spark, "t").put("scores", toxicity.scored(docs, net))
    toxicity.calibrated(net, [1, 2, 3], scores, labels)
    assert set(net.thresholds) == {"en", "de"}
    assert {r.doc_id for r in toxicity.accepted(docs, net).collect()} == {i for i, *_ in rows if i % 3}


def test_a_negative_ratio_lowers_the_margin():
    ratio, w = np.array([0.0, 2.0, -2.0, -1.0]), np.array([0.0, 0.5, -0.5, 0.0])
    share = quality.interpolated(w, ratio) * ratio
    assert share[0] == 0 and share[1] > 0 and share[2] < 0
    mean = quality.interpolated(np.zeros(4), ratio) * ratio
    assert (mean == 0).all()
    unfitted = quality.interpolated(np.array([0.0, 1.0, -1.0, 0.0]), ratio)
    assert unfitted[3] * ratio[3] < 0


def test_calibration():
    rng = np.random.default_rng(0)
    m = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * m - 1)))).astype(int)
    a, b = platt(m, y)
    assert abs(a - 2) < 0.2 and abs(b + 1) < 0.2
    assert best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.55)
    assert platt(np.zeros(0), np.zeros(0)) == (1.0, 0.0)


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = Boosted.fit(x[:600], y[:600])
    assert ((model.scores(x[600:]) > 0.5) == y[600:]).mean() > 0.95


def _labelled(spark, texts):
    """Rows outside the held-out fold, in the order in which the sample takes them."""
    from pyspark.sql import functions as F

    ids = [r.id for r in spark.range(400).filter(~training.held_out("id")).orderBy(F.xxhash64("id"), "id").limit(len(texts)).collect()]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string")
    return ids, docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))


def test_a_text_that_does_not_fit_is_passed_over(spark):
    ids, docs, labels = _labelled(spark, ["x" * 5000] + [f"text {i}" for i in range(20)] + ["y" * 900, "z"])
    got = training.labelled_sample(docs, labels, "toxic", most_bytes=500)
    assert sorted(got.doc_id) == sorted(ids[1:21] + ids[22:])
    with pytest.raises(ValueError, match="more than"):
        training.labelled_sample(docs, labels, "toxic", most_bytes=0)
    assert len(training.labelled_sample(docs, labels.filter("false"), "toxic", most_bytes=0)) == 0


def test_copies_of_fitted_texts_set_no_threshold(spark):
    ids, docs, labels = _labelled(spark, [f"text {i % 10}" for i in range(40)])
    fitted = training.labelled_sample(docs, labels, "toxic", most=12)
    net = toxicity.train(fitted.text.tolist(), fitted.y.to_numpy())
    scores = toxicity.scored(docs, net).cache()
    toxicity.calibrated(net, fitted.hash.tolist(), scores, labels)
    # every text has a copy among the fitted ones
    assert set(fitted.text) == {f"text {i}" for i in range(10)} and net.thresholds == {} and net.common == 0.5
    toxicity.calibrated(net, fitted.hash.tolist()[:5], scores, labels)
    assert net.thresholds
