"""One way to score for every kind of model.

A scorer has ``threshold``, ``model_version`` and ``score(df, text, keys)``, which
returns the keys and ``probability`` for every row (empty in, empty out).
Explanation and model choice take any scorer.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.config import settings
from glossa.operators import models as MO
from glossa.session import materialized
from glossa.sources import versions
from glossa.sources.corpus import path_exists


class Scorer(Protocol):
    threshold: float
    model_version: str

    def score(self, df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame: ...


@dataclass
class LinearScorer:
    """The relational linear model."""

    model: MO.LinearTextModel

    @property
    def threshold(self) -> float:
        return self.model.threshold

    @property
    def model_version(self) -> str:
        return self.model.model_version

    def score(self, df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
        return MO.score(df, self.model, list(keys), text)

    def score_tokens(self, df: DataFrame, tokens: str, keys: Sequence[str]) -> DataFrame:
        """Pre-tokenised input: nothing is cleaned or split again."""
        return MO.score(df, self.model, list(keys), tokens_col=tokens)

    def save(self, path: str) -> None:
        self.model.save(path)


@dataclass
class SparkMLScorer:
    """A fitted Spark ML classifier on the TF-IDF feature table."""

    features: MO.FeatureSpace
    fitted: object
    family: str
    threshold: float = settings.threshold
    model_version: str = settings.model_version

    def score(self, df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
        first, *rest = keys
        vectors = MO.vectorize(df, self.features, first, text, carry=rest)
        return MO.ml_positive_score(self.fitted, vectors, self.family).select(
            *keys, F.col("probability_").alias("probability"))

    def save(self, path: str) -> None:
        spark = self.features.vocab.sparkSession
        folder = versions.new_folder(path)
        self.features.vocab.write.parquet(f"{folder}/vocabulary")
        self.fitted.write().save(f"{folder}/fitted")
        fs = self.features
        options = json.dumps({"size": fs.size, "ngram_range": list(fs.ngram_range), "max_features": fs.max_features,
                              "clean": fs.clean, "max_length": fs.max_length})
        spark.createDataFrame([(self.family, self.threshold, self.model_version, options)],
                              "family string, threshold double, model_version string, options string") \
            .coalesce(1).write.parquet(f"{folder}/scorer")
        versions.publish(spark, path, folder)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SparkMLScorer":
        folder = versions.current(spark, path) or path
        meta = spark.read.parquet(f"{folder}/scorer").first()
        opts = json.loads(meta["options"])
        fs = MO.FeatureSpace(spark.read.parquet(f"{folder}/vocabulary"), opts["size"], tuple(opts["ngram_range"]),
                             opts["max_features"], opts["clean"], opts["max_length"])
        fitted = DefaultParamsReader.loadParamsInstance(f"{folder}/fitted", spark)
        return cls(fs, fitted, meta["family"], meta["threshold"], meta["model_version"])


@dataclass
class BatchScorer:
    """Any batched prediction function over an array column that ``inputs`` builds from the text."""

    predict: Callable
    inputs: Callable[[str], F.Column]
    threshold: float = settings.threshold
    model_version: str = settings.model_version

    def score(self, df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
        return df.select(*keys, self.inputs(text).alias("_x")).select(*keys, self.predict("_x").alias("probability"))


@dataclass
class ConstantScorer:
    """Scores every text alike (a stand-in for tests and degraded service)."""

    probability: float
    threshold: float = settings.threshold
    model_version: str = settings.model_version
    seen: list = field(default_factory=list)

    def score(self, df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
        return df.select(*keys, F.lit(float(self.probability)).alias("probability"))


def load_scorer(spark: SparkSession, path: str) -> Scorer:
    """The saved scorer of either kind; a missing one raises FileNotFoundError."""
    if path_exists(spark, f"{versions.current(spark, path) or path}/scorer"):
        return SparkMLScorer.load(spark, path)
    return LinearScorer(MO.LinearTextModel.load(spark, path))


def first_scorer(spark: SparkSession, paths: Sequence[str]) -> Scorer | None:
    """S11 across kinds: the first path that holds one, in order of preference."""
    for path in paths:
        try:
            return load_scorer(spark, path)
        except FileNotFoundError:
            continue
    return None


def choose(scorers: Mapping[str, Scorer], validation: DataFrame, key: str = "doc_id", text: str = "text",
           label: str = "label") -> tuple[str, Scorer, DataFrame]:
    """Score the validation rows with each, compare by macro-F1, return the winner with its
    name and the table of all."""
    rows = materialized(validation.select(key, text, label), "validation")
    preds = {}
    for name, scorer in scorers.items():
        scored = scorer.score(rows, text, [key, label])
        preds[name] = scored.select(label, MO.predict_class("probability", scorer.threshold).alias("pred"))
    table = materialized(MO.select_best(preds, label, "pred"), "choice")
    best = table.where("is_best").first()["candidate"]
    return best, scorers[best], table


def fit_and_persist(corpus: DataFrame, path: str, key: str = "doc_id", text: str = "text", label: str = "label",
                    **options) -> Scorer:
    """T5: fit on all rows, save, and hand back what a later process would load."""
    model, _ = MO.fit_lr(corpus, key, text, label, **options)
    model.save(path)
    return load_scorer(corpus.sparkSession, path)
