"""Queries that take the given tables through the sources and sinks (S1–S11): each writes
files below the shared folder, reads them back and returns what it read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import models as MO
from glossa.operators import scorers as SC
from glossa.operators import validate as V
from glossa.plans import data as D
from glossa.plans.flagship import _fixed_model_materialised, prepared_corpus
from glossa.session import read_table, scratch_path
from glossa.sources import corpus as S


def corpus_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Materialise a corpus under other column names, skip it when present, read it."""
    raw = D.documents(spark, sf).join(read_table(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.col("text").alias("tweet"), F.col("toxic").alias("sarcastic"))
    path = S.materialize(raw, scratch_path(spark, "corpus"))
    S.materialize(raw.limit(0), path)  # present: nothing happens
    return S.read_corpus(spark, path, "stored", "en", keep=["doc_id"])


def curated_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Append the valid curation rows in two batches, read them strictly."""
    valid, _ = V.split_valid(D.curation_frame(spark, sf).drop("doc_id"))
    path = scratch_path(spark, "curated")
    for register in ("en-IN", "hi-en"):
        S.append_labels(valid.where(F.col("register") == register), path)
    return S.read_curated_strict(spark, path)


def curated_lenient(spark: SparkSession, sf: str) -> DataFrame:
    """The same file as a corpus, with its own registers; a missing one adds no rows."""
    valid, _ = V.split_valid(D.curation_frame(spark, sf).drop("doc_id"))
    path = scratch_path(spark, "curated")
    S.append_labels(valid, path)
    read = S.read_curated_lenient(spark, path, register_col="register")
    return read.unionByName(S.read_curated_lenient(spark, scratch_path(spark, "missing")))


def usable_candidate(spark: SparkSession, sf: str) -> DataFrame:
    """Past a missing path, a table without the columns and one that breaks while it is read,
    to the first good one, in its second format."""
    lab = D.labelled(spark, sf)
    missing, other, broken, good = (scratch_path(spark, n) for n in ("missing", "other", "broken", "good"))
    lab.select("doc_id").write.option("header", True).csv(other)
    lab.select(F.lit("t").alias("tweet"), F.lit("no number").alias("sarcastic")).write.option("header", True).csv(broken)
    text = F.when(F.col("source") != D.PROBE_SOURCE, F.col("text"))
    lab.select(text.alias("tweet"), F.col("label").alias("sarcastic")).write.json(good)
    return S.first_usable(spark, [missing, other, broken, good])[0]


def stored_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """S9 + J1: prediction tables of two models, written, read by name and joined."""
    from glossa.operators import errors as E

    scored = D.with_stand_ins(D.labelled(spark, sf))
    paths = {m: S.materialize(scored.select("doc_id", "label", "language_register", f"pred_{m}", f"prob_{m}"),
                              scratch_path(spark, f"predictions-{m}")) for m in ("a", "b")}
    read = S.read_predictions(spark, paths)
    return E.join_predictions(read["a"], [read["b"].select("doc_id", "pred_b", "prob_b")], "doc_id")


def saved_model_score(spark: SparkSession, sf: str) -> DataFrame:
    """Save the fixed-weight model, find it past a missing one, score with the copy."""
    path = scratch_path(spark, "model")
    _fixed_model_materialised(spark, sf).save(path)
    scorer = SC.first_scorer(spark, [scratch_path(spark, "none"), path])
    scored = scorer.score(D.labelled(spark, sf), "text", ["doc_id"])
    return scored.select("doc_id", "probability", MO.predict_class("probability", scorer.threshold).alias("pred"))


def train_checks(spark: SparkSession, sf: str) -> DataFrame:
    """T4/T5 checked on a real fit: sizes of the split, class supports of the test rows, whether the
    relational score is the fitted model's own on every test row, and whether the fit converged."""
    from pyspark.ml.functions import vector_to_array

    from glossa.config import settings
    from glossa.operators import split as SP
    from glossa.session import materialized

    split = materialized(SP.stratified_split(prepared_corpus(spark, sf), "doc_id", "label", settings.test_size,
                                             settings.random_seed), "split")
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    fs = MO.fit_features(train)
    model, fitted = MO.fit_lr(train, fs=fs)
    own = fitted.transform(MO.vectorize(test, fs, carry=["label"])).select(
        "doc_id", "label", vector_to_array("probability")[1].alias("own"))
    both = own.join(MO.score(test, model), "doc_id")
    return both.agg(
        F.count(F.lit(1)).alias("n_test"), F.count_if(F.col("label") == 0).alias("n_negative"),
        F.count_if(F.col("label") == 1).alias("n_positive"),
        (F.max(F.abs(F.col("own") - F.col("probability"))) < 1e-9).alias("same_score"),
    ).crossJoin(train.agg(F.count(F.lit(1)).alias("n_train"))).withColumn(
        "converged", F.lit(fitted.summary.totalIterations < settings.max_iter))


QUERIES = {
    "corpus_round_trip": corpus_round_trip,
    "curated_round_trip": curated_round_trip,
    "curated_lenient": curated_lenient,
    "usable_candidate": usable_candidate,
    "stored_predictions": stored_predictions,
    "saved_model_score": saved_model_score,
    "train_checks": train_checks,
}
