"""Model choice: the macro-F1 evaluator in Spark ML's tuning, and the epoch trainer."""
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import functions as F

from glossa.operators import evaluate as EV
from glossa.operators import models as MO
from glossa.operators import selection as SE
from glossa.session import scratch_path
from glossa.sources import versions


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    pos, neg = ["great", "sure", "totally", "love"], ["report", "train", "office", "agenda"]
    rows = []
    for i in range(240):
        label = int(i % 3 == 0)
        own = pos if label else neg
        words = [rng.choice(own) for _ in range(3)] + [rng.choice(pos + neg) for _ in range(2)] + [f"w{rng.randrange(20)}"]
        rows.append((i, " ".join(words), label))
    rows += [(900, "", 0), (901, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, label long").repartition(3)


@pytest.fixture(scope="module")
def parts(corpus):
    return corpus.where("doc_id % 5 <> 0").cache(), corpus.where("doc_id % 5 = 0").cache()


@pytest.mark.parametrize("pairs,want", [
    ([(0, 0.0), (1, 1.0)], 1.0), ([(0, 0.0), (0, 0.0)], 1.0), ([(0, 1.0), (1, 0.0)], 0.0), ([(0, 0.0), (0, 1.0)], 1 / 3), ([], 0.0)])
def test_evaluator_values(spark, pairs, want):
    df = spark.createDataFrame(pairs, "label long, prediction double")
    assert SE.MacroF1Evaluator().evaluate(df) == pytest.approx(want)


def test_evaluator_in_tuning(spark, corpus, tmp_path):
    fs = MO.fit_features(corpus, min_df=1)
    data = MO.weighted(MO.vectorize(corpus, fs, carry=["label"]), corpus).withColumn("fold", (F.col("doc_id") % 2).cast("int")).cache()
    lr = LogisticRegression(labelCol="label_d", weightCol="weight", maxIter=20)
    grid = ParamGridBuilder().addGrid(lr.regParam, [1e-3, 100.0]).build()
    judge = SE.MacroF1Evaluator(labelCol="label_d")
    judge.write().overwrite().save(str(tmp_path / "judge"))
    assert SE.MacroF1Evaluator.load(str(tmp_path / "judge")).getLabelCol() == "label_d" and judge.isLargerBetter()
    split = TrainValidationSplit(estimator=lr, estimatorParamMaps=grid, evaluator=judge, trainRatio=0.7, seed=1).fit(data)
    assert split.bestModel.getOrDefault("regParam") == grid[int(np.argmax(split.validationMetrics))][lr.regParam]
    folds = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=judge, numFolds=2, foldCol="fold",
                           collectSubModels=True).fit(data)
    own = [EV.report(folds.subModels[f][0].transform(data.where(f"fold = {f}")), "label", "prediction").first()["macro_f1"]
           for f in range(2)]
    assert folds.avgMetrics[0] == pytest.approx(sum(own) / 2)


def test_gradient_is_that_of_the_loss(spark):
    rng = np.random.default_rng(3)
    dense, label, weight = rng.normal(size=(40, 6)), rng.integers(0, 2, 40), rng.uniform(0.5, 2, 40)
    dense[rng.random(dense.shape) < 0.5] = 0
    dense[7] = 0
    rows = [(int(y), float(w), np.flatnonzero(x).tolist(), x[np.flatnonzero(x)].tolist()) for x, y, w in zip(dense, label, weight)]
    df = spark.createDataFrame(rows, "label long, weight double, indices array<int>, values array<double>").repartition(3)
    coef = rng.normal(size=7)
    p = 1 / (1 + np.exp(-(dense @ coef[:-1] + coef[-1])))
    want = np.concatenate([dense.T @ (weight * (p - label)), [np.sum(weight * (p - label)), weight.sum()]])
    assert np.allclose(SE.gradient(df, coef), want, atol=1e-12)
    got = {r["label"]: r["n"] for r in SE.probabilities(df, coef).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == 40
    assert SE.gradient(df.limit(0), coef).tolist() == [0.0] * 8


@pytest.mark.parametrize("history,patience,best,over", [
    ([0.5], 2, 1, False), ([0.5, 0.5, 0.5], 2, 1, True), ([0.1, 0.3, 0.2], 2, 2, False), ([0.1, 0.3, 0.2, 0.25], 2, 2, True),
    ([0.1, 0.3, 0.2, 0.4], 2, 4, False), ([0.4, 0.3], 1, 1, True)])
def test_patience_rule(history, patience, best, over):
    assert SE.best_of(history) == best and SE.patience_over(history, patience) is over


def test_epochs_stop_and_return_the_best(spark, parts):
    train, held = parts
    path = scratch_path(spark, "epochs")
    run = SE.fit_epochs(train, held, path, SE.EpochSettings(epochs=4, batches=2), min_df=1)
    assert len(run.history) == 4 or run.stopped_early
    assert run.history[run.best_epoch - 1] == max(run.history) > 0.8
    scored = MO.score(held, run.model, carry=["label"]).withColumn("pred", MO.predict_class("probability"))
    assert EV.report(scored).first()["macro_f1"] == pytest.approx(max(run.history), abs=1e-12)
    with pytest.raises(ValueError, match="other settings"):
        SE.fit_epochs(train, held, path, SE.EpochSettings(epochs=4, batches=2, learning_rate=0.1))


def test_restart_after_a_crash_gives_the_same_model(spark, parts, monkeypatch):
    """A run that dies inside an epoch goes on after the last whole one."""
    train, held = parts
    how = SE.EpochSettings(epochs=3, patience=9, batches=2)
    whole = SE.fit_epochs(train, held, scratch_path(spark, "epochs"), how, min_df=1)
    path, real, steps = scratch_path(spark, "epochs"), SE.gradient, []

    def dies(rows, coef):
        steps.append(1)
        if len(steps) == 2 * how.batches + 2:
            raise RuntimeError("lost")
        return real(rows, coef)

    monkeypatch.setattr(SE, "gradient", dies)
    with pytest.raises(RuntimeError, match="lost"):
        SE.fit_epochs(train, held, path, how, min_df=1)
    assert len(versions.entries(spark, f"{path}/epochs")) == 2
    monkeypatch.undo()
    again = SE.fit_epochs(train, held, path, how, min_df=1)
    assert again.history == whole.history and again.best_epoch == whole.best_epoch
    a, b = ({r["term"]: r["coef"] for r in run.model.params.collect()} for run in (whole, again))
    assert a.keys() == b.keys() and all(abs(a[t] - b[t]) < 1e-10 for t in a)


def test_epoch_settings_are_checked(spark, parts, monkeypatch):
    for bad in ({"epochs": 0}, {"patience": 0}, {"learning_rate": 0}, {"batches": 0}, {"C": -1}):
        with pytest.raises(ValueError):
            SE.EpochSettings(**bad)
    monkeypatch.setattr(SE, "MAX_FEATURES", 3)
    with pytest.raises(ValueError, match="at most 3 coefficients"):
        SE.fit_epochs(*parts, scratch_path(spark, "epochs"), min_df=1)


def test_a_save_that_dies_leaves_the_old_model(spark, corpus, monkeypatch):
    """The log row comes last; without it readers stay with the version before."""
    from glossa.operators import scorers as SC

    model, fitted = MO.fit_lr(corpus, max_iter=3, min_df=1)
    path = scratch_path(spark, "model")
    model.save(path)
    before = {r["term"]: r["coef"] for r in SC.load_scorer(spark, path).model.params.collect()}
    other = SC.SparkMLScorer(MO.fit_features(corpus, min_df=1), fitted, "logistic")
    monkeypatch.setattr(versions, "publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    model.params = model.params.withColumn("coef", F.lit(0.0))
    for one in (model, other):
        with pytest.raises(OSError, match="killed"):
            one.save(path)
    monkeypatch.undo()
    loaded = SC.load_scorer(spark, path)
    assert isinstance(loaded, SC.LinearScorer) and {r["term"]: r["coef"] for r in loaded.model.params.collect()} == before
    other.save(path)
    assert isinstance(SC.load_scorer(spark, path), SC.SparkMLScorer)
    model.save(path)
    assert SC.load_scorer(spark, path).model.params.where("coef <> 0").isEmpty()
    assert [e["seq"] for e in versions.entries(spark, path)] == [1, 2, 3]


def test_truncation_reaches_models(spark, corpus):
    """features, vectors and scores see the first max_length tokens."""
    fs = MO.fit_features(corpus, min_df=1, max_length=2, ngram_range=(1, 1))
    model, _ = MO.fit_lr(corpus, fs=fs, max_iter=5)
    assert model.max_length == 2
    path = scratch_path(spark, "model")
    model.save(path)
    loaded = MO.LinearTextModel.load(spark, path)
    texts = spark.createDataFrame([(1, "great love report office"), (2, "great love"), (3, "great love train")], "doc_id long, text string")
    for m in (model, loaded):
        assert len({r["probability"] for r in MO.score(texts, m).collect()}) == 1
    assert len({tuple(r["indices"]) for r in MO.sparse_rows(texts, fs).collect()}) == 1


@pytest.mark.parametrize("family", ["naive_bayes", "linear_svc", "dense_lr"])
def test_families_take_class_weights(spark, corpus, family):
    """With balanced weights the rare class is predicted more often than without."""
    rare = corpus.where("label = 0 or doc_id % 9 = 0 or doc_id = 901")
    fs = MO.fit_features(rare, min_df=1)
    vec = MO.vectorize(rare, fs, carry=["label"]).cache()
    found = {}
    for mode in ("balanced", None):
        kw = {"naive_bayes": {}, "linear_svc": {"C": 0.01, "maxIter": 10}, "dense_lr": {"C": 0.01}}[family]
        scored = MO.ml_positive_score(MO.fit_other(vec, family, class_weight=mode, **kw), vec, family)
        found[mode] = scored.agg(F.avg("probability_")).first()[0]
    assert found["balanced"] > found[None]
