"""Queries on training and model choice (T4-T7) that SQL can check: sizes from the tables, and
booleans that hold for every right implementation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.config import settings
from glossa.functions import metrics as M
from glossa.operators import explain as X
from glossa.operators import features as FE
from glossa.operators import models as MO
from glossa.operators import selection as SE
from glossa.operators import split as SP
from glossa.operators import text_batches as TB
from glossa.plans import data as D
from glossa.plans.flagship import prepared_corpus
from glossa.session import materialized, scratch_path


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows: a stratified share of the training split."""
    corpus = prepared_corpus(spark, sf)
    split = SP.stratified_split(corpus, "doc_id", "label", settings.test_size, settings.random_seed)
    both = materialized(SP.stratified_split(split.where("split = 'train'").drop("split"), "doc_id", "label", settings.val_size,
                                            settings.random_seed, "part"), "split")
    return both.where("part = 'train'"), both.where("part = 'test'")


def tuned_by_macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    """T7 with Spark ML's ``TrainValidationSplit`` and the macro-F1 evaluator: whether each
    candidate's metric is A12 of its own predictions, and whether the largest wins."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit

    train, validation = _parts(spark, sf)
    rows = train.unionByName(validation)
    fs = MO.fit_features(train)
    data = materialized(MO.weighted(MO.vectorize(rows, fs, carry=["label"]), rows), "training-rows")
    lr = LogisticRegression(labelCol="label_d", weightCol="weight", standardization=False, maxIter=50)
    grid = ParamGridBuilder().addGrid(lr.regParam, [1e-4, 1e-2, 10.0]).build()
    tuning = TrainValidationSplit(estimator=lr, estimatorParamMaps=grid, evaluator=SE.MacroF1Evaluator(labelCol="label_d"),
                                  trainRatio=1 - settings.val_size, seed=settings.random_seed, collectSubModels=True)
    found = tuning.fit(data)
    held = data.select("*", F.rand(settings.random_seed).alias("_r")).where(F.col("_r") >= 1 - settings.val_size)
    own = []
    for model in found.subModels:
        counts = model.transform(held).groupBy().agg(*M.confusion_aggs("label", "prediction"))
        own.append(counts.select(M.macro_f1().alias("f")).first()["f"])
    metrics = found.validationMetrics
    best = found.bestModel.getOrDefault("regParam")
    facts = [(len(metrics), all(abs(a - b) < 1e-12 for a, b in zip(own, metrics)),
              best == grid[max(range(len(own)), key=lambda i: own[i])][lr.regParam])]
    return spark.createDataFrame(facts, "n_candidates long, metric_is_macro_f1 boolean, winner_is_argmax boolean").crossJoin(
        data.agg(F.count("*").alias("n_rows"), F.count_if(F.col("label") == 1).alias("n_positive")))


def early_stopping(spark: SparkSession, sf: str) -> DataFrame:
    """T7 epochs: whether the run ends where the patience rule says, the returned model is that of
    the best epoch, its macro-F1 is A12 of the relational score, and a run that is cut after two
    epochs and started again ends in the same model."""
    train, validation = _parts(spark, sf)
    how = SE.EpochSettings()
    fs = MO.fit_features(train)
    run = SE.fit_epochs(train, validation, scratch_path(spark, "epochs"), how, fs=fs)
    path = scratch_path(spark, "epochs")
    SE.fit_epochs(train, validation, path, SE.EpochSettings(epochs=2), fs=fs, rows_of=run)
    again = SE.fit_epochs(train, validation, path, how)
    scored = MO.score(validation, run.model, carry=["label"]).withColumn("pred", MO.predict_class("probability"))
    f1 = scored.agg(*M.confusion_aggs("label", "pred")).select(M.macro_f1().alias("f")).first()["f"]
    h = run.history
    ends = [i for i in range(1, len(h) + 1) if SE.patience_over(h[:i], how.patience)]
    apart = run.model.params.select("term", "coef").join(
        again.model.params.select("term", F.col("coef").alias("other")), "term", "full").agg(
        F.max(F.coalesce(F.abs(F.col("coef") - F.col("other")), F.lit(1.0)))).first()[0]
    facts = [(len(h) == (ends[0] if ends else how.epochs), run.best_epoch == h.index(max(h)) + 1,
              abs(f1 - max(h)) < 1e-9, again.history == h and apart < 1e-9 and abs(run.model.intercept - again.model.intercept) < 1e-9)]
    return spark.createDataFrame(
        facts, "stops_by_patience boolean, best_is_argmax boolean, score_is_best_epoch boolean, restart_is_same boolean").crossJoin(
        validation.agg(F.count("*").alias("n_validation"), F.count_if(F.col("label") == 1).alias("n_positive")))


#: A weight per hashed token, by a rule.
TOKEN_WEIGHTS = [((i * 37) % 101 - 50) / 10 for i in range(1 << 12)]


def text_batches_agree(spark: SparkSession, sf: str) -> DataFrame:
    """P5 + F7 on texts: mini-batches of ids and masks, by length, against the same score computed by
    expressions; every twentieth text is emptied."""
    docs = D.documents(spark, sf).select("doc_id", F.when(F.pmod("doc_id", F.lit(20)) != 3, F.col("text")).alias("text"))
    scored = TB.score_text_batches(docs, TB.mean_weight_factory(TOKEN_WEIGHTS, 0.25), vocabulary=len(TOKEN_WEIGHTS))
    tokens = F.coalesce(FE.doc_tokens(docs, "text", None, TB.BUCKETS[-1]), F.array().cast("array<string>"))
    own = docs.select("doc_id", tokens.alias("t")).select(
        "doc_id", TB.mean_weight_score(F.col("t"), TOKEN_WEIGHTS, 0.25).alias("own"))
    return scored.join(own, "doc_id").select("doc_id", "n_tokens", (F.abs(F.col("own") - F.col("probability")) < 1e-9).alias("agrees"))


def family_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Every family on the training rows, balanced by class: rows scored, scores in [0, 1], and
    whether the classes weigh the same in the fit."""
    train, validation = _parts(spark, sf)
    fs = MO.fit_features(train)
    vec, held = (materialized(MO.vectorize(p, fs, carry=["label"]), "vectors") for p in (train, validation))
    sides = MO.weighted(vec, train).groupBy("label").agg(F.sum("weight").alias("w")).agg(
        (F.max("w") - F.min("w") < 1e-6).alias("classes_weigh_alike"))
    found = None
    for family in MO.ESTIMATORS:
        scored = MO.ml_positive_score(MO.fit_other(vec, family), held, family)
        row = scored.agg(F.lit(family).alias("family"), F.count("*").alias("n_scored"),
                         F.every(F.col("probability_").between(0.0, 1.0)).alias("in_unit_interval"),
                         (F.stddev("probability_") > 0).alias("scores_differ"))
        found = row if found is None else found.unionByName(row)
    return found.crossJoin(sides)


def perturbation_checks(spark: SparkSession, sf: str) -> DataFrame:
    """L1 + L3 of all labelled documents: distinct words, samples, whether the intact sample keeps every
    word at weight 1, and whether the others drop at least one at a lower weight."""
    docs = D.labelled(spark, sf).select("doc_id", "text")
    samples = X.perturbations(docs, num_samples=8).select(
        "doc_id", "sample", F.size("words").alias("d"), F.size(F.filter("mask", lambda b: b)).alias("kept"))
    weight = F.when(F.col("d") > 0, X.proximity(F.col("kept"), F.col("d")))
    intact, other = F.col("sample") == 0, (F.col("sample") > 0) & (F.col("d") > 0)
    return samples.withColumn("w", weight).groupBy("doc_id").agg(
        F.max("d").cast("bigint").alias("n_words"), F.count("*").alias("n_samples"),
        F.every(~intact | (F.col("d") == 0) | ((F.col("kept") == F.col("d")) & (F.col("w") == 1.0))).alias("intact_is_whole"),
        F.every(~other | ((F.col("kept") < F.col("d")) & (F.col("w") < 1.0))).alias("others_drop"))


QUERIES = {"family_checks": family_checks, "perturbation_checks": perturbation_checks, "tuned_by_macro_f1": tuned_by_macro_f1, "early_stopping": early_stopping, "text_batches_agree": text_batches_agree}
