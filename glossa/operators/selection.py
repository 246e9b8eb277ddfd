"""Model choice by validation macro-F1 (T7): an evaluator for Spark ML's own tuning, and an
epoch trainer that stops early and goes back to its best epoch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.config import settings
from glossa.functions import metrics as M
from glossa.operators import models as MO
from glossa.operators.split import class_weights
from glossa.sources import versions


class MacroF1Evaluator(Evaluator, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A12 as a Spark ML evaluator, for ``TrainValidationSplit`` and ``CrossValidator``: the mean F1
    over the classes that occur in labels or predictions (Spark's own "f1" is the weighted one)."""

    @keyword_only
    def __init__(self, *, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        counts = dataset.agg(*M.confusion_aggs(F.col(self.getLabelCol()), F.col(self.getPredictionCol())))
        return float(counts.select(M.macro_f1().alias("f")).first()["f"])

    def isLargerBetter(self) -> bool:
        return True


#: Coefficients of one epoch are an array on the driver and in every task: 32 MB at this many.
MAX_FEATURES = 1 << 22


@dataclass(frozen=True)
class EpochSettings:
    """How to train.  An epoch goes over all rows in ``batches`` steps; training stops when
    ``patience`` epochs in a row have not raised the best macro-F1."""

    epochs: int = 10
    patience: int = 2
    batches: int = 4
    learning_rate: float = 0.5
    C: float = settings.C
    seed: int = settings.random_seed

    def __post_init__(self) -> None:
        for name in ("epochs", "patience", "batches"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.learning_rate <= 0 or self.C <= 0:
            raise ValueError("learning_rate and C must be positive")


@dataclass
class EpochRun:
    """``history``: macro-F1 of each epoch, from 1.  ``model`` is that of ``best_epoch``."""

    model: MO.LinearTextModel
    history: list[float]
    best_epoch: int
    stopped_early: bool
    folder: str = ""  # the feature rows that it was trained on


def best_of(history: list[float]) -> int:
    """The first epoch of the highest value (1-based)."""
    return int(np.argmax(history)) + 1


def patience_over(history: list[float], patience: int) -> bool:
    return len(history) - best_of(history) >= patience


def _flat(batch: pa.RecordBatch, coef: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, index and value of every entry of a batch, and the margins; the last coefficient is the intercept."""
    indices, values = batch.column("indices"), batch.column("values")
    index, value = indices.flatten().to_numpy(), values.flatten().to_numpy()
    row = np.repeat(np.arange(batch.num_rows), np.diff(indices.offsets.to_numpy()))
    return row, index, value, np.bincount(row, value * coef[index], batch.num_rows) + coef[-1]


def gradient(rows: DataFrame, coef: np.ndarray) -> np.ndarray:
    """Sum over ``rows`` (label, weight, indices, values) of the weighted logistic loss's gradient;
    one more place, at the end, holds the sum of weights.  Each task sends one sum per index."""
    shared = rows.sparkSession.sparkContext.broadcast(coef)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(len(own) + 1)
        for batch in batches:
            row, index, value, margin = _flat(batch, own)
            weight = batch.column("weight").to_numpy()
            residual = weight * (1.0 / (1.0 + np.exp(-margin)) - batch.column("label").to_numpy())
            total[:-2] += np.bincount(index, residual[row] * value, len(own) - 1)
            total[-2] += residual.sum()
            total[-1] += weight.sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["index", "g"])

    sums = rows.select("label", "weight", "indices", "values").mapInArrow(run, "index int, g double")
    got = sums.groupBy("index").agg(F.sum("g").alias("g")).toArrow()  # at most one row per coefficient
    shared.unpersist()
    out = np.zeros(len(coef) + 1)
    out[got.column("index").to_numpy()] = got.column("g").to_numpy()
    return out


def probabilities(rows: DataFrame, coef: np.ndarray) -> DataFrame:
    """(label, probability) of ``rows`` (label, indices, values)."""
    shared = rows.sparkSession.sparkContext.broadcast(coef)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = _flat(batch, shared.value)[3]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(1.0 / (1.0 + np.exp(-margin)))],
                                             names=["label", "probability"])

    return rows.select("label", "indices", "values").mapInArrow(run, "label long, probability double")


def validation_f1(rows: DataFrame, coef: np.ndarray, threshold: float = settings.threshold) -> float:
    scored = probabilities(rows, coef).withColumn("prediction", MO.predict_class("probability", threshold))
    return MacroF1Evaluator().evaluate(scored)


def _prepare(train: DataFrame, validation: DataFrame, folder: str, key: str, text: str, label: str, class_weight,
             fs: MO.FeatureSpace | None, **feature_kw) -> MO.FeatureSpace:
    """Vocabulary and feature rows of both parts, written once for all epochs and restarts."""
    fs = fs or MO.fit_features(train, key, text, **feature_kw)
    fs.vocab.write.parquet(f"{folder}/vocabulary")
    weights = class_weights(train, label, class_weight).select(F.col(label).alias("label"), "weight")
    for name, part in (("train", train), ("validation", validation)):
        rows = MO.sparse_rows(part.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label")),
                              fs, "key", "text", ["label"])
        rows.join(F.broadcast(weights), "label", "left").write.parquet(f"{folder}/{name}")
    return fs


def _start(spark: SparkSession, train: DataFrame, validation: DataFrame, path: str, how: EpochSettings, key: str, text: str,
           label: str, class_weight, fs: MO.FeatureSpace | None, feature_kw: dict,
           rows_of: EpochRun | None) -> tuple[MO.FeatureSpace, str]:
    known = versions.entries(spark, f"{path}/setup")
    if known:
        note = known[-1]["note"]
        if {k: v for k, v in note["how"].items() if k != "epochs"} != {k: v for k, v in asdict(how).items() if k != "epochs"}:
            raise ValueError(f"{path} holds a run with other settings: {note['how']}")
        folder, o = note.get("rows", known[-1]["folder"]), note["features"]
        return MO.FeatureSpace(spark.read.parquet(f"{folder}/vocabulary"), o["size"], tuple(o["ngram_range"]),
                               o["max_features"], o["clean"], o["max_length"]), folder
    own = folder = versions.new_folder(f"{path}/setup")
    if rows_of is None:
        fs = _prepare(train, validation, folder, key, text, label, class_weight, fs, **feature_kw)
    elif fs is None:
        raise ValueError("the feature rows of another run need its feature space")
    else:
        folder = rows_of.folder
    if fs.size > MAX_FEATURES:
        raise ValueError(f"{fs.size} features: the epoch trainer holds at most {MAX_FEATURES} coefficients; "
                         "set max_features, or use fit_lr")
    options = {"size": fs.size, "ngram_range": list(fs.ngram_range), "max_features": fs.max_features, "clean": fs.clean,
               "max_length": fs.max_length}
    versions.publish(spark, f"{path}/setup", own, {"how": asdict(how), "features": options, **({"rows": folder} if rows_of else {})})
    return fs, folder


def fit_epochs(
    train: DataFrame, validation: DataFrame, path: str, how: EpochSettings | None = None, key: str = "doc_id",
    text: str = "text", label: str = "label", class_weight="balanced", threshold: float = settings.threshold,
    fs: MO.FeatureSpace | None = None, rows_of: EpochRun | None = None, **feature_kw,
) -> EpochRun:
    """Train a balanced linear model epoch by epoch, judge each by macro-F1 on ``validation``,
    stop by patience, and return the best epoch's model.

    Every step is one pass over a hash share of the rows; Spark sums the gradients and the driver
    updates the coefficients (AdaGrad).  Each epoch's state goes to ``path`` and its log row is
    written last, so a run on the same path goes on after the last whole epoch, and the result does
    not depend on where an earlier run stopped.  ``rows_of`` is a run on the same parts and feature
    space, whose feature rows serve again."""
    how = how or EpochSettings()
    spark = train.sparkSession
    fs, folder = _start(spark, train, validation, path, how, key, text, label, class_weight, fs, feature_kw, rows_of)
    rows, held = spark.read.parquet(f"{folder}/train"), spark.read.parquet(f"{folder}/validation")
    total = rows.agg(F.sum("weight")).first()[0]
    done = versions.entries(spark, f"{path}/epochs")
    history = [e["note"]["macro_f1"] for e in done]
    coef, squares = _state(spark, done[-1]["folder"]) if done else (np.zeros(fs.size + 1), np.zeros(fs.size + 1))
    while len(history) < how.epochs and not (history and patience_over(history, how.patience)):
        epoch = len(history) + 1
        share = F.pmod(F.xxhash64("key", F.lit(how.seed), F.lit(epoch)), F.lit(how.batches))
        for step in range(how.batches):
            sums = gradient(rows.where(share == step), coef)
            if not sums[-1]:
                continue
            g = sums[:-1] / sums[-1]
            g[:-1] += coef[:-1] / (how.C * total)
            squares += g * g
            coef = coef - how.learning_rate * g / np.sqrt(squares + 1e-12)
        history.append(validation_f1(held, coef, threshold))
        state = versions.new_folder(f"{path}/epochs")
        table = pa.table({"index": np.arange(len(coef), dtype=np.int32), "coef": coef, "squares": squares})
        spark.createDataFrame(table).write.parquet(state)
        versions.publish(spark, f"{path}/epochs", state, {"macro_f1": history[-1]})
    best = best_of(history)
    kept = _state(spark, versions.entries(spark, f"{path}/epochs")[best - 1]["folder"])[0]
    model = MO.linear_model(spark, fs, kept[:-1], float(kept[-1]), threshold, kind="epochs")
    return EpochRun(model, history, best, patience_over(history, how.patience), folder)


def _state(spark: SparkSession, folder: str) -> tuple[np.ndarray, np.ndarray]:
    table = spark.read.parquet(folder).orderBy("index").toArrow()
    return table.column("coef").to_numpy().copy(), table.column("squares").to_numpy().copy()
