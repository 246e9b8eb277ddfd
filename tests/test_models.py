"""Learnability, relational-vs-ML scoring agreement, threshold rule, persistence."""
import os
import tempfile

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from glossa.operators import evaluate as EV
from glossa.operators import models as MO

POS = ["love", "great", "wonderful", "yeah right", "totally", "sure"]
NEG = ["meeting", "report", "schedule", "weather", "train", "office"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for i in range(100):
        words = POS if i % 2 else NEG
        rows.append((i, f"{words[i % 6]} {words[(i + 1) % 6]} day {i}", i % 2))
    return spark.createDataFrame(rows, "doc_id bigint, text string, label bigint")


@pytest.fixture(scope="module")
def trained(corpus):
    return MO.fit_lr(corpus, "doc_id", "text", "label", min_df=1, max_iter=50)


def test_separable_corpus_is_learned(corpus, trained):
    model, _ = trained
    scored = MO.score(corpus, model).join(corpus.select("doc_id", "label"), "doc_id")
    pred = scored.withColumn("pred", MO.predict_class("probability"))
    assert EV.report(pred).first()["macro_f1"] > 0.9


def test_relational_score_equals_ml_transform(corpus, trained):
    model, ml = trained
    fs = MO.fit_features(corpus, "doc_id", "text", min_df=1, checkpoint=False)
    vec = MO.vectorize(corpus, fs, "doc_id", "text")
    ml_p = {r["doc_id"]: r["p"] for r in ml.transform(vec).select(
        "doc_id", vector_to_array("probability")[1].alias("p")).collect()}
    rel = {r["doc_id"]: r["probability"] for r in MO.score(corpus, model).collect()}
    assert rel.keys() == ml_p.keys()
    for k in rel:
        assert rel[k] == pytest.approx(ml_p[k], abs=1e-9)


def test_probabilities_in_unit_interval_and_empty_text(spark, trained):
    model, _ = trained
    df = spark.createDataFrame([(1, ""), (2, "zzz unknown")], "doc_id bigint, text string")
    out = MO.score(df, model).collect()
    assert len(out) == 2
    assert all(0.0 < r["probability"] < 1.0 for r in out)


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(0.5,), (0.4999,)], "p double")
    out = [r[0] for r in df.select(MO.decide("p", 0.5)).collect()]
    assert out[0] != out[1]
    assert [r[0] for r in df.select(MO.predict_class("p", 0.5)).collect()] == [1, 0]


def test_save_load_round_trip_and_fallback(spark, trained, corpus):
    model, _ = trained
    d = tempfile.mkdtemp(prefix="glossa-model-")
    path = os.path.join(d, "m")
    model.save(path)
    loaded = MO.load_first_available(spark, [os.path.join(d, "missing"), path])
    assert loaded is not None and loaded.model_version == model.model_version
    a = sorted(MO.score(corpus, model).collect())
    b = sorted(MO.score(corpus, loaded).collect())
    assert [r["probability"] for r in a] == pytest.approx([r["probability"] for r in b])
    assert MO.load_first_available(spark, [os.path.join(d, "missing")]) is None
    with pytest.raises(RuntimeError):
        MO.require_model(None)


def test_contributions_sign_agrees_with_score(corpus, trained):
    model, _ = trained
    from glossa.operators import features as FE

    terms = FE.doc_terms(corpus.where("doc_id = 1"), "doc_id", "text", model.ngram_range, model.clean)
    contrib = MO.term_contributions(terms, model, k=1000).agg(F.sum("contribution")).first()[0]
    p = MO.score(corpus.where("doc_id = 1"), model).first()["probability"]
    import math

    assert 1 / (1 + math.exp(-(contrib + model.intercept))) == pytest.approx(p, abs=1e-9)


def test_single_pass_fixed_model_equals_two_pass(corpus):
    from glossa.operators import features as FE

    terms = FE.doc_terms(corpus.select("doc_id", "text"), "doc_id", "text", (1, 2), {"html": "basic"})
    vocab = FE.vocabulary(terms, FE.count_docs(corpus), 1, 50_000)
    two = MO.log_count_ratio_model(terms, corpus, vocab, "doc_id", "label", 50_000)
    one, vocab1 = MO.labelled_log_count_ratio_model(corpus, "doc_id", "label", "text", (1, 2),
                                                    {"html": "basic"}, 1, 50_000)
    assert sorted(vocab.collect()) == sorted(vocab1.collect())
    a = sorted(two.params.select("term", "idf", "index", "coef").collect())
    b = sorted(one.params.select("term", "idf", "index", "coef").collect())
    assert a == b
    assert two.intercept.first()[0] == pytest.approx(one.intercept.first()[0])
