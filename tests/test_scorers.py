"""Scorers of every kind behave alike: score, explain, save, load, choose."""
import pytest
from pyspark.sql import functions as F

from glossa.config import Settings
from glossa.operators import explain as X
from glossa.operators import models as MO
from glossa.operators import scorers as SC


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"oh great another monday {i % 7}", 1) for i in range(20)]
    rows += [(100 + i, f"the meeting is at ten {i % 7}", 0) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, label bigint").cache()


@pytest.fixture(scope="module")
def bayes(corpus):
    fs = MO.fit_features(corpus, max_features=None)
    vectors = MO.vectorize(corpus, fs, carry=["label"]).withColumn("label_d", F.col("label").cast("double"))
    return SC.SparkMLScorer(fs, MO.fit_other(vectors, "naive_bayes"), "naive_bayes")


def length_scorer():
    predict = MO.batch_scorer(MO.logistic_factory([0.05], 0.0), batch_size=8, input_tensor_shapes=[[1]])
    return SC.BatchScorer(predict, lambda t: F.array(F.length(t).cast("double")))


def test_fit_persist_reload(spark, corpus, tmp_path):
    scorer = SC.fit_and_persist(corpus, str(tmp_path / "lr"))
    got = {r["doc_id"]: r["probability"] for r in scorer.score(corpus, "text", ["doc_id"]).collect()}
    assert all((p >= 0.5) == (d < 100) for d, p in got.items())


def test_save_load_of_another_family(spark, corpus, bayes, tmp_path):
    bayes.save(str(tmp_path / "nb"))
    loaded = SC.first_scorer(spark, [str(tmp_path / "none"), str(tmp_path / "nb")])
    one = {r["doc_id"]: r["probability"] for r in bayes.score(corpus, "text", ["doc_id"]).collect()}
    assert {r["doc_id"]: r["probability"] for r in loaded.score(corpus, "text", ["doc_id"]).collect()} == pytest.approx(one)
    assert SC.first_scorer(spark, [str(tmp_path / "none")]) is None


def test_empty_in_empty_out(corpus, bayes):
    for scorer in (bayes, length_scorer(), SC.ConstantScorer(0.3)):
        assert scorer.score(corpus.limit(0), "text", ["doc_id"]).count() == 0


def test_explains_any_scorer(corpus, bayes):
    df = corpus.where("doc_id in (1, 101)")
    for scorer in (bayes, length_scorer()):
        for r in X.explain(df, scorer, num_samples=40).collect():
            assert 0 <= r["probability"] <= 1 and r["tokens"] and r["text"]
    flat = X.explain(df, SC.ConstantScorer(0.7), num_samples=20).collect()
    assert all(r["decision"] == "SARCASTIC" and all(abs(t["weight"]) < 1e-9 for t in r["tokens"]) for r in flat)


def test_choose_returns_the_winner(corpus, bayes):
    name, winner, table = SC.choose({"never": SC.ConstantScorer(0.1), "bayes": bayes}, corpus)
    assert name == "bayes" and winner is bayes and table.count() == 2


def test_settings_are_checked():
    for bad in ({"max_iter": 0}, {"explain_samples": 1}, {"explain_features": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)
