"""Training and scoring.

Scoring is relational: (doc, term, tf) rows join a broadcast parameter table
(term, idf, coef) bounded by the vocabulary cap, and one aggregation per
document computes ``sum(w * coef)`` and ``sum(w * w)`` together; because all
rows of a document are produced in the same task, map-side partial
aggregation leaves one small row per document to shuffle.

Training uses Spark ML ``LogisticRegression`` on SparseVectors with the
reference objective (L2, C, balanced class weights, unpenalised intercept):
``regParam = 1 / (C * sum(weights))``, ``standardization=False``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.config import settings
from glossa.operators import features as FE
from glossa.operators.split import class_weights
from glossa.operators.text_samples import TermTable
from glossa.schemas import LABEL_NAMES
from glossa.session import materialized
from glossa.sources import versions
from glossa.sources.corpus import path_exists

TABLE_TERMS = 1 << 20  # terms of a linear model that go to the driver and to every worker, at most


@dataclass
class LinearTextModel:
    """A linear model over TF-IDF terms, as tables.

    ``params``: DataFrame ``term, idf, coef[, index]``; ``intercept``: float or
    a one-row DataFrame with column ``intercept``."""

    params: DataFrame
    intercept: float | DataFrame
    threshold: float = settings.threshold
    model_version: str = settings.model_version
    kind: str = "baseline"
    ngram_range: tuple[int, int] = settings.ngram_range
    max_features: int | None = settings.max_features
    clean: dict = field(default_factory=lambda: dict(FE.FULL_CLEAN))
    max_length: int | None = None

    def save(self, path: str) -> None:
        """Parameter table as parquet plus a one-row metadata table, as a new version that
        readers see only when it is whole."""
        spark = self.params.sparkSession
        folder = versions.new_folder(path)
        self.params.write.parquet(f"{folder}/params")
        icpt = self.intercept if isinstance(self.intercept, DataFrame) else spark.createDataFrame(
            [(float(self.intercept),)], "intercept double")
        meta = icpt.select(
            "intercept",
            F.lit(self.threshold).alias("threshold"),
            F.lit(self.model_version).alias("model_version"),
            F.lit(self.kind).alias("kind"),
            F.lit(json.dumps({"ngram_range": list(self.ngram_range), "max_features": self.max_features,
                              "clean": self.clean, "max_length": self.max_length})).alias("options"),
        )
        meta.coalesce(1).write.parquet(f"{folder}/meta")
        versions.publish(spark, path, folder)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LinearTextModel":
        """Load the current version; a missing path raises FileNotFoundError."""
        folder = versions.current(spark, path) or path  # a folder of its own holds one unversioned model
        if not path_exists(spark, f"{folder}/meta"):
            raise FileNotFoundError(f"{path} holds no saved linear model")
        meta = spark.read.parquet(f"{folder}/meta").first()
        opts = json.loads(meta["options"])
        return cls(
            params=spark.read.parquet(f"{folder}/params"),
            intercept=float(meta["intercept"]),
            threshold=float(meta["threshold"]),
            model_version=meta["model_version"],
            kind=meta["kind"],
            ngram_range=tuple(opts["ngram_range"]),
            max_features=opts["max_features"],
            clean=opts["clean"],
            max_length=opts["max_length"],
        )


def load_first_available(spark: SparkSession, paths: Sequence[str]) -> LinearTextModel | None:
    """First present model in preference order, else None (degraded).  Only a
    missing one is passed over; one that cannot be read raises."""
    for p in paths:
        try:
            return LinearTextModel.load(spark, p)
        except FileNotFoundError:
            continue
    return None


def require_model(model: LinearTextModel | None) -> LinearTextModel:
    if model is None:
        raise RuntimeError("no model available: scoring is unavailable (degraded)")
    return model


# --------------------------------------------------------------------------- scoring

def _intercept_col(intercept: float | DataFrame, df: DataFrame) -> tuple[DataFrame, Column]:
    if isinstance(intercept, DataFrame):
        return df.crossJoin(F.broadcast(intercept.select(F.col("intercept").alias("_b")))), F.col("_b")
    return df, F.lit(float(intercept))


def score_terms(
    terms: DataFrame, model: LinearTextModel, key: str | Sequence[str] = "doc_id",
    carry: Sequence[str] = (),
) -> DataFrame:
    """P1 on (key, carry..., term, tf) rows -> (key, carry..., probability).

    Documents with no known term keep one row (NULL term) and score the
    intercept alone."""
    keys = ([key] if isinstance(key, str) else list(key)) + list(carry)
    p = model.params.select("term", "idf", "coef")
    j = terms.join(p, "term", "left")
    w = (1.0 + F.ln(F.col("tf"))) * F.col("idf")
    per_doc = j.groupBy(*keys).agg(
        F.coalesce(F.sum(w * F.col("coef")), F.lit(0.0)).alias("_dot"),
        F.coalesce(F.sum(w * w), F.lit(0.0)).alias("_ss"),
    )
    per_doc, b = _intercept_col(model.intercept, per_doc)
    z = F.when(F.col("_ss") > 0, F.col("_dot") / F.sqrt("_ss")).otherwise(F.lit(0.0)) + b
    return per_doc.select(*keys, (1.0 / (1.0 + F.exp(-z))).alias("probability"))


def score(
    df: DataFrame, model: LinearTextModel, key: str | Sequence[str] = "doc_id", text: str = "text",
    carry: Sequence[str] = (), tokens_col: str | None = None,
) -> DataFrame:
    """Score a table of texts (empty in -> empty out)."""
    terms = FE.doc_terms(
        df.select(*([key] if isinstance(key, str) else list(key)), *carry,
                  *([tokens_col] if tokens_col else [text])),
        [key] + list(carry) if isinstance(key, str) else list(key) + list(carry),
        text, model.ngram_range, model.clean, tokens_col=tokens_col, keep_empty=True, max_length=model.max_length,
    )
    return score_terms(terms, model, key, carry)


def intercept_value(model: LinearTextModel) -> float:
    icpt = model.intercept
    return float(icpt.first()["intercept"] if isinstance(icpt, DataFrame) else icpt)


def term_table(model: LinearTextModel) -> TermTable | None:
    """The model's terms for use inside a task, or None if there are more than ``TABLE_TERMS``.  A term of
    several rows adds up as the join of ``score_terms`` has it."""
    params = model.params.where(F.col("term").isNotNull()).groupBy("term").agg(
        F.coalesce(F.sum(F.col("idf") * F.col("coef")), F.lit(0.0)).alias("dot"),
        F.coalesce(F.sum(F.col("idf") * F.col("idf")), F.lit(0.0)).alias("square"))
    if model.params.count() > TABLE_TERMS:
        return None
    return TermTable(params.toArrow(), *model.ngram_range, model.max_length)


def decide(prob: Column | str, threshold: float = settings.threshold,
           label_names: Sequence[str] = LABEL_NAMES) -> Column:
    """``>=`` threshold -> positive name, else negative name."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return F.when(p >= F.lit(threshold), F.lit(label_names[1])).otherwise(F.lit(label_names[0]))


def predict_class(prob: Column | str, threshold: float = settings.threshold) -> Column:
    """Integer class at threshold (``>=``)."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return (p >= F.lit(threshold)).cast("bigint")


def with_decision(scored: DataFrame, model: LinearTextModel, prob: str = "probability",
                  label_names: Sequence[str] = LABEL_NAMES) -> DataFrame:
    """PREDICTION fields: probability, decision, threshold, model_version."""
    return scored.withColumns({
        "decision": decide(prob, model.threshold, label_names),
        "threshold": F.lit(float(model.threshold)),
        "model_version": F.lit(model.model_version),
    })


def term_contributions(
    terms: DataFrame, model: LinearTextModel, key: str = "doc_id", k: int = 10,
) -> DataFrame:
    """L6 + K3: exact per-term contribution ``weight * coef`` of a linear model,
    top-k per document by |contribution| (ties by term)."""
    from pyspark.sql import Window

    p = model.params.select("term", "idf", "coef")
    j = terms.join(p, "term")
    w = (1.0 + F.ln(F.col("tf"))) * F.col("idf")
    x = j.select(key, "term", (w * F.col("coef")).alias("_wc"), (w * w).alias("_ww"))
    wd = Window.partitionBy(key)
    # the norm is one number per document: ranks are those of the unscaled products, and one sort serves both windows
    rk = F.row_number().over(Window.partitionBy(key).orderBy(F.abs("_wc").desc(), F.col("term")))
    x = x.withColumn("rank", rk.cast("bigint")).withColumn("contribution", F.col("_wc") / F.sqrt(F.sum("_ww").over(wd)))
    return x.where(F.col("rank") <= k).select(
        key, "rank", "term", "contribution")


def sort_token_weights(tokens: Column | str) -> Column:
    """K3: array<struct<token, weight>> ordered by |weight| descending."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    keyed = F.transform(t, lambda x: F.struct((-F.abs(x["weight"])).alias("k"), x["token"].alias("token"),
                                              x["weight"].alias("weight")))
    return F.transform(F.sort_array(keyed), lambda x: F.struct(x["token"].alias("token"), x["weight"].alias("weight")))


# --------------------------------------------------------------------------- fixed-weight model

def log_count_ratio_model(
    terms: DataFrame, labels: DataFrame, vocab: DataFrame, key: str = "doc_id", label: str = "label",
    max_features: int | None = settings.max_features,
) -> LinearTextModel:
    """A linear model with weights fixed by a rule (no optimiser):
    coef = ln((df_pos + 1) / (n_pos + 2)) - ln((df_neg + 1) / (n_neg + 2)),
    intercept = ln(n_pos / n_neg).  Used for relational-scoring checks."""
    j = terms.where(F.col("term").isNotNull()).join(labels.select(key, label), key)
    return _ratio_model(FE.term_stats(j, label=label), labels, vocab, label, max_features=max_features)


def _ratio_model(stats: DataFrame, labels: DataFrame, vocab: DataFrame, label: str, **options) -> LinearTextModel:
    """The weight rule on per-term class frequencies (``df_pos``, ``df_neg``)."""
    cls = labels.agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    v = vocab.select("term", "idf", "index")
    params = stats.select("term", "df_pos", "df_neg").join(v, "term").crossJoin(F.broadcast(cls)).select(
        "term", "idf", "index",
        (F.ln((F.col("df_pos") + 1.0) / (F.col("n_pos") + 2.0))
         - F.ln((F.col("df_neg") + 1.0) / (F.col("n_neg") + 2.0))).alias("coef"),
    )
    icpt = cls.select(F.ln(F.col("n_pos") / F.col("n_neg")).alias("intercept"))
    return LinearTextModel(params=params, intercept=icpt, kind="log_count_ratio", **options)


def labelled_log_count_ratio_model(
    lab: DataFrame, key: str = "doc_id", label: str = "label", text: str = "text",
    ngram_range: tuple[int, int] = (1, 2), clean: dict | None = None, min_df: int = 2,
    max_features: int | None = settings.max_features,
) -> tuple[LinearTextModel, DataFrame]:
    """``log_count_ratio_model`` from one labelled table in one term pass.

    The label rides on the term rows, so the vocabulary statistics and the
    per-class document frequencies come from a single aggregation by term
    (same weights as ``log_count_ratio_model``).  Returns (model, vocabulary)."""
    clean = clean or dict(FE.FULL_CLEAN)
    terms = FE.doc_terms(lab.select(key, label, text), [key, label], text, ngram_range, clean)
    # written: the vocabulary and the weights both read it, and texts are cut into terms once
    st = materialized(FE.term_stats(terms, label=label).where(F.col("df") >= min_df), "term-stats")
    vocab = FE.indexed_vocabulary(st.select("term", "df", "tf_total"), FE.count_docs(lab), max_features)
    model = _ratio_model(st, lab, vocab, label, ngram_range=ngram_range, max_features=max_features, clean=clean)
    return model, vocab


# --------------------------------------------------------------------------- training

@dataclass
class FeatureSpace:
    vocab: DataFrame
    size: int
    ngram_range: tuple[int, int]
    max_features: int | None
    clean: dict
    max_length: int | None = None


def fit_features(
    df: DataFrame, key: str = "doc_id", text: str = "text", ngram_range=settings.ngram_range,
    min_df: int = settings.min_df, max_features: int | None = settings.max_features,
    clean: dict | None = None, checkpoint: bool = True, max_length: int | None = None,
) -> FeatureSpace:
    """F1–F3/K4 fit: the vocabulary (term, df, tf_total, idf, index).

    The vocabulary is cut from the plan (reliable checkpoint to the shared
    folder) because every later stage reads it."""
    clean = clean or dict(FE.FULL_CLEAN)
    terms = FE.doc_terms(df.select(key, text), key, text, ngram_range, clean, max_length=max_length)
    vocab = FE.vocabulary(terms, FE.count_docs(df), min_df, max_features)
    if checkpoint:
        vocab = materialized(vocab, "vocabulary")
    size = vocab.count()
    return FeatureSpace(vocab, size, ngram_range, max_features, clean, max_length)


def sparse_rows(
    df: DataFrame, fs: FeatureSpace, key: str = "doc_id", text: str = "text",
    carry: Sequence[str] = (), tokens_col: str | None = None,
) -> DataFrame:
    """(key, carry..., indices array<int>, values array<double>) of every text: L2-normalised
    sublinear TF-IDF, indices ascending.  Texts are dealt by key before they become terms, so
    the terms of a text meet again without an exchange."""
    keys = [key] + list(carry)
    terms = FE.terms_by_key(df, keys, text, fs.ngram_range, fs.clean, tokens_col, keep_empty=True,
                            max_length=fs.max_length, by=[key])
    v = fs.vocab.select("term", "idf", "index")
    j = terms.join(v, "term", "left")
    w = (1.0 + F.ln(F.col("tf"))) * F.col("idf")
    per_doc = j.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("index").isNotNull(), F.struct(F.col("index").alias("i"), w.alias("w")))))
        .alias("_e"),
        F.coalesce(F.sum(w * w), F.lit(0.0)).alias("_ss"),
    )
    nrm = F.when(F.col("_ss") > 0, F.sqrt("_ss")).otherwise(F.lit(1.0))
    return per_doc.select(*keys, F.col("_e.i").alias("indices"), F.transform(F.col("_e.w"), lambda x: x / nrm).alias("values"))


def as_vectors(rows: DataFrame, size: int) -> DataFrame:
    """``indices`` and ``values`` become one Spark ML sparse vector, ``features``.

    A vector column is a struct in the engine's own rows.  The struct is built by expressions;
    no built-in function gives it the vector type, so Arrow batches pass through one task
    function unchanged, declared as vectors."""
    struct = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), "indices", "values")
    plain = rows.select(*[c for c in rows.columns if c not in ("indices", "values")], struct.alias("features"))
    fields = [T.StructField("features", VectorUDT()) if f.name == "features" else f for f in plain.schema.fields]
    return plain.mapInArrow(lambda batches: batches, T.StructType(fields))


def vectorize(
    df: DataFrame, fs: FeatureSpace, key: str = "doc_id", text: str = "text",
    carry: Sequence[str] = (), tokens_col: str | None = None,
) -> DataFrame:
    """(key, carry..., features SparseVector) — L2-normalised sublinear TF-IDF."""
    return as_vectors(sparse_rows(df, fs, key, text, carry, tokens_col), fs.size)


def weighted(vec: DataFrame, train: DataFrame, label: str = "label", class_weight="balanced") -> DataFrame:
    """``vec`` with ``label_d`` and the class's ``weight`` (one row per class is joined)."""
    cw = class_weights(train, label, class_weight)
    return vec.join(F.broadcast(cw.select(label, "weight")), label).withColumn("label_d", F.col(label).cast("double"))


def fit_lr(
    train: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label",
    C: float = settings.C, class_weight="balanced", max_iter: int = settings.max_iter,
    tol: float = 1e-4, fs: FeatureSpace | None = None, threshold: float = settings.threshold,
    model_version: str = settings.model_version, vectors: DataFrame | None = None, **feature_kw,
) -> tuple[LinearTextModel, object]:
    """T4/T5: balanced L2 logistic regression on TF-IDF.

    ``vectors`` is ``vectorize(train)`` already cut from its lineage, for several fits on one
    table.  Returns the relational ``LinearTextModel`` and the Spark ML model."""
    fs = fs or fit_features(train, key, text, **feature_kw)
    vec = vectors if vectors is not None else vectorize(train, fs, key, text, carry=[label])
    data = weighted(vec, train, label, class_weight)
    if vectors is None:
        # The optimiser reads its input once per iteration: cut the lineage into
        # the shared folder so a lost executor re-reads, not recomputes.
        data = materialized(data, "training-rows")
    total_w = data.agg(F.sum("weight")).first()[0]
    lr = LogisticRegression(
        featuresCol="features", labelCol="label_d", weightCol="weight",
        regParam=1.0 / (C * total_w), elasticNetParam=0.0, standardization=False,
        maxIter=max_iter, tol=tol, fitIntercept=True,
    )
    ml = lr.fit(data)
    spark = train.sparkSession
    model = linear_model(spark, fs, ml.coefficients.toArray(), float(ml.intercept), threshold, model_version)
    return model, ml


def linear_model(spark: SparkSession, fs: FeatureSpace, coefs, intercept: float, threshold: float = settings.threshold,
                 model_version: str = settings.model_version, kind: str = "baseline") -> LinearTextModel:
    """The relational model of a coefficient array over ``fs`` (the optimiser's own, on the driver)."""
    import numpy as np
    import pyarrow as pa

    table = pa.table({"index": np.arange(len(coefs), dtype=np.int32), "coef": np.asarray(coefs, dtype=np.float64)})
    params = materialized(fs.vocab.select("term", "idf", "index").join(spark.createDataFrame(table), "index"), "params")
    return LinearTextModel(params=params, intercept=intercept, threshold=threshold, model_version=model_version, kind=kind,
                           ngram_range=fs.ngram_range, max_features=fs.max_features, clean=fs.clean,
                           max_length=fs.max_length)


ESTIMATORS: Mapping[str, Callable[..., object]] = {
    "naive_bayes": lambda **kw: NaiveBayes(featuresCol="features", labelCol="label_d", modelType="multinomial",
                                           probabilityCol="probv", **kw),
    "linear_svc": lambda **kw: LinearSVC(featuresCol="features", labelCol="label_d", **kw),
    "dense_lr": lambda **kw: LogisticRegression(featuresCol="features", labelCol="label_d", elasticNetParam=0.0,
                                                standardization=False, maxIter=settings.max_iter, **kw),
}


def fit_other(train_vec: DataFrame, family: str, label: str = "label", class_weight="balanced", C: float = settings.C, **kw):
    """Another Spark ML family on the same feature table, with the class weights of T3.
    Families with a penalty take the strength of T4, ``1 / (C * sum(weights))``."""
    data = materialized(weighted(train_vec.drop("label_d"), train_vec, label, class_weight), "training-rows")
    if family != "naive_bayes" and "regParam" not in kw:
        kw["regParam"] = 1.0 / (C * data.agg(F.sum("weight")).first()[0])
    return ESTIMATORS[family](weightCol="weight", **kw).fit(data)


def ml_positive_score(ml_model, vec: DataFrame, family: str) -> DataFrame:
    """P(class 1) (or the margin squashed through a sigmoid for LinearSVC)."""
    from pyspark.ml.functions import vector_to_array

    out = ml_model.transform(vec)
    if family == "linear_svc":
        raw = vector_to_array("rawPrediction")[1]
        return out.withColumn("probability_", 1.0 / (1.0 + F.exp(-raw)))
    col = "probv" if family == "naive_bayes" else "probability"
    return out.withColumn("probability_", vector_to_array(col)[1])


def select_best(candidates: Mapping[str, DataFrame], label: str = "label", pred: str = "pred") -> DataFrame:
    """Macro-F1 of each candidate's validation predictions, best flagged.

    ``candidates`` maps name -> DataFrame(label, pred)."""
    from glossa.functions import metrics as M

    parts = [df.select(F.lit(n).alias("candidate"), F.col(label), F.col(pred)) for n, df in candidates.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    c = u.groupBy("candidate").agg(*M.confusion_aggs(label, pred))
    from pyspark.sql import Window

    s = c.select("candidate", M.macro_f1().alias("macro_f1"))
    best = F.row_number().over(Window.orderBy(F.col("macro_f1").desc(), F.col("candidate")))
    return s.withColumn("is_best", best == 1)


# --------------------------------------------------------------------------- batch inference

def batch_scorer(make_predict_fn: Callable, return_type=T.DoubleType(), batch_size: int = 32,
                 input_tensor_shapes=None):
    """P5: model-agnostic mini-batched scoring (Arrow batches of ``batch_size``).

    ``make_predict_fn`` is a factory executed once per Python worker that
    returns ``predict(np.ndarray) -> np.ndarray``; heavy imports belong inside it."""
    from pyspark.ml.functions import predict_batch_udf

    return predict_batch_udf(make_predict_fn, return_type=return_type, batch_size=batch_size,
                             input_tensor_shapes=input_tensor_shapes)


def logistic_factory(coefs: Sequence[float], intercept: float):
    """Factory for a NumPy logistic scorer over dense arrays (softmax of 2 logits)."""
    w = [float(c) for c in coefs]
    b = float(intercept)

    def make():
        import numpy as np

        wv = np.asarray(w, dtype=np.float64)

        def predict(x):
            z = np.asarray(x, dtype=np.float64) @ wv + b
            logits = np.stack([np.zeros_like(z), z], axis=1)
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            return (e / e.sum(axis=1, keepdims=True))[:, 1]

        return predict

    return make

