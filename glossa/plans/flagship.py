"""End-to-end flows built from the operators: prepare -> split -> TF-IDF ->
balanced LR -> score -> evaluate, and the training-centred queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.config import settings
from glossa.operators import evaluate as EV
from glossa.operators import models as MO
from glossa.operators import split as SP
from glossa.operators.normalize import merge_corpora, normalize
from glossa.plans import data as D
from glossa.session import materialized, read_table


def prepared_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """documents + labels -> normalised -> first-wins dedup on text; doc_id kept as key."""
    raw = D.documents(spark, sf).join(read_table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "text", F.col("quality").alias("label"), "lang")
    norm = normalize(raw, source="documents", register_col="lang", keep=["doc_id"])
    merged = merge_corpora([(norm, ["doc_id"])], deduplicate=True)
    rows = merged.select(F.col("row_key").alias("doc_id"), "text", "label", "source", "language_register")
    return materialized(rows, "corpus")  # a split reads keys and labels several times, texts once


def train_and_score(spark: SparkSession, sf: str, max_iter: int = settings.max_iter):
    corpus = prepared_corpus(spark, sf)
    split = materialized(SP.stratified_split(corpus, "doc_id", "label", 0.2, 42), "split")
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test")
    model, ml = MO.fit_lr(train, "doc_id", "text", "label", max_iter=max_iter)
    scored = MO.score(test, model, "doc_id", "text", carry=["label", "language_register"])
    scored = scored.withColumn("pred", MO.predict_class("probability", model.threshold))
    return model, ml, scored


def per_language_report(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: macro-F1 and n per language on the held-out split."""
    _, _, scored = train_and_score(spark, sf)
    return EV.per_slice_f1(scored, "label", "pred", "language_register")


def train_lr_report(spark: SparkSession, sf: str) -> DataFrame:
    """T4/T5 + A14: held-out report of the balanced TF-IDF LR."""
    _, _, scored = train_and_score(spark, sf)
    r = EV.report(scored, "label", "pred")
    return r.select("accuracy", "macro_f1", F.col("negative.f1").alias("f1_negative"),
                    F.col("positive.f1").alias("f1_positive"),
                    F.col("confusion")[0][0].alias("tn"), F.col("confusion")[0][1].alias("fp"),
                    F.col("confusion")[1][0].alias("fn"), F.col("confusion")[1][1].alias("tp"))


def select_best_model(spark: SparkSession, sf: str) -> DataFrame:
    """Several families and C values on one feature space, chosen by
    validation macro-F1 (validation = stratified 15 % of the training split)."""
    corpus = prepared_corpus(spark, sf)
    split = SP.stratified_split(corpus, "doc_id", "label", 0.2, 42)
    train_all = split.where(F.col("split") == "train").drop("split")
    tv = materialized(SP.stratified_split(train_all, "doc_id", "label", settings.val_size, settings.random_seed, "part"), "split")
    train = tv.where(F.col("part") == "train")
    val = tv.where(F.col("part") == "test")
    fs = MO.fit_features(train, "doc_id", "text")
    tr_vec = materialized(MO.vectorize(train, fs, "doc_id", "text", carry=["label"]), "vectors")
    cands = {}
    for C in (0.1, 1.0, 10.0):
        model, _ = MO.fit_lr(train, "doc_id", "text", "label", C=C, fs=fs, vectors=tr_vec)
        s = MO.score(val, model, "doc_id", "text", carry=["label"])
        cands[f"lr_C{C:g}"] = s.withColumn("pred", MO.predict_class("probability"))
    va_vec = MO.vectorize(val, fs, "doc_id", "text", carry=["label"])
    for fam in ("naive_bayes", "linear_svc"):
        m = MO.fit_other(tr_vec, fam)
        s = MO.ml_positive_score(m, va_vec, fam)
        cands[fam] = s.withColumn("pred", MO.predict_class("probability_"))
    return MO.select_best(cands, "label", "pred")


def _embedding_data(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", "embedding", array_to_vector("embedding").alias("features"),
                    (F.col("label") >= 5).cast("bigint").alias("label"))


def _embedding_model(spark: SparkSession, sf: str):
    split = SP.stratified_split(_embedding_data(spark, sf), "vec_id", "label", 0.2, 42)
    train = split.where(F.col("split") == "train")
    return MO.fit_other(train.select("vec_id", "label", "features"), "dense_lr"), split


def embedding_lr_report(spark: SparkSession, sf: str) -> DataFrame:
    """LR on the dense embedding column, held-out report."""
    from pyspark.ml.functions import vector_to_array

    ml, split = _embedding_model(spark, sf)
    test = split.where(F.col("split") == "test")
    s = ml.transform(test).withColumn("pred", (vector_to_array("probability")[1] >= 0.5).cast("bigint"))
    return EV.report(s, "label", "pred").select("accuracy", "macro_f1")


def batch_udf_score(spark: SparkSession, sf: str) -> DataFrame:
    """P5: mini-batched scoring through a pluggable model factory."""
    ml, split = _embedding_model(spark, sf)
    fn = MO.batch_scorer(MO.logistic_factory(ml.coefficients.toArray().tolist(), ml.intercept),
                         batch_size=32, input_tensor_shapes=[[64]])
    data = split.select("vec_id", "label", "split", "features", F.col("embedding").cast("array<double>").alias("x"))
    return ml.transform(data.withColumn("batched", fn("x")))


def batch_udf_agrees(spark: SparkSession, sf: str) -> DataFrame:
    """P5 checked: the batched scorer gives the fitted model's own probability on every row."""
    from pyspark.ml.functions import vector_to_array

    own = vector_to_array("probability")[1]
    return batch_udf_score(spark, sf).select("vec_id", "label", "split", (F.abs(F.col("batched") - own) < 1e-9).alias("agrees"))


def explain_tokens(spark: SparkSession, sf: str, num_samples: int = 200) -> DataFrame:
    """Explanations of all labelled documents under the fixed-weight model."""
    from glossa.operators import explain as X

    model = _fixed_model_materialised(spark, sf)
    return X.explain(D.labelled(spark, sf).select("doc_id", "text"), model, "doc_id", "text", num_samples, 10)


def explain_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """L5 fields that SQL can derive: the intact sample's probability and decision."""
    out = explain_tokens(spark, sf, num_samples=2)  # only the intact sample counts here
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), "probability", "decision", "threshold",
                      "model_version")


def _fixed_model_materialised(spark: SparkSession, sf: str) -> MO.LinearTextModel:
    lab = D.labelled(spark, sf).repartition("doc_id")  # a large table may come in few row groups, each read by one task
    m, _ = MO.labelled_log_count_ratio_model(lab, "doc_id", "label", "text", (1, 2), None, 2, 50_000)
    m.params = materialized(m.params, "params")
    m.intercept = float(m.intercept.first()["intercept"])
    return m


def stream_score(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a file stream, validated and scored per micro-batch.  Every document
    comes back: scored, or with the reason why it was set aside."""
    from glossa.session import scratch_path
    from glossa.streaming.jobs import read_batches
    from glossa.streaming.jobs import stream_score as run

    model = _fixed_model_materialised(spark, sf)
    schema = D.documents(spark, sf).select("doc_id", "text").schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(
        f"{sf}/documents*.parquet").select("doc_id", "text")
    out, bad, ck = scratch_path(spark, "scored"), scratch_path(spark, "quarantine"), scratch_path(spark, "ck")
    q = run(spark, src, model, out, bad, ck)
    q.awaitTermination()
    scored = read_batches(spark, out, "doc_id long, probability double, decision string, threshold double, model_version string")
    aside = read_batches(spark, bad, "doc_id long, reason string")
    return scored.select("doc_id", F.lit("scored").alias("status"), "probability", "decision").unionByName(
        aside.select("doc_id", F.col("reason").alias("status"), F.lit(None).cast("double").alias("probability"),
                     F.lit(None).cast("string").alias("decision")))


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """R2: first-arrival exact-text dedup with a bounded-state watermark."""
    from glossa.session import scratch_path
    from glossa.streaming.jobs import stream_dedup as run

    schema = D.documents(spark, sf).select("doc_id", "text", "lang").schema
    src = spark.readStream.schema(schema).parquet(f"{sf}/documents*.parquet").withColumn(
        "event_time", F.timestamp_seconds(F.col("doc_id") + 1))  # a row at the epoch would be late for the first watermark
    out, ck = scratch_path(spark, "dedup"), scratch_path(spark, "ck")
    q = run(src, out, ck, "event_time", "365 days")
    q.awaitTermination()
    return spark.read.parquet(out)
