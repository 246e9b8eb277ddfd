"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other training rows, labelled or not,
are the unlabelled set.  A linear model over word presence is trained in numpy on
the non-negative risk  pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))  with the
logistic loss: where the corrected negative part falls below zero, the step goes
against it, which keeps the model from memorising the positives.  The class
prior pi is the share of toxic rows among the labelled training rows.

The fit uses every distinct training text.  A feature is a folded word
``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` that enough of the positives hold and that is
significantly more frequent among them than among the unlabelled, which keeps words
out that a few copies share by chance.  Spark counts the words of all rows; only those that
enough positives hold come to the driver, at most the mean number of words of a positive text
over the least share.  The unlabelled rows are dealt into shards of about ``SHARD`` by a hash of
the text, each with all positives (beyond ``SHARD`` of them with one of several groups).  A shard
is trained in a task of its own and the model is the mean of the shards' weights, so every row
counts and no task or driver holds them all.  How many positives must hold a word, and how
significantly, is chosen among ``SETTINGS`` on folds of the training rows by
recall ** 2 / share of rows predicted positive, which needs no negatives; the folds' counts are
summed over the shards.  Scoring reads every whole text.

Null and empty texts score by the intercept alone.  Without positives nothing is
learned and every score is 0.  Rows with null labels are unlabelled; a doc id
with several label rows is positive if one of them is toxic.  Repeated document
rows score alike.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import kernels as K
from glossa.llm.repeats import settled

SHARD = 2_000  # rows of a side that are trained together, about
SLICE = 1 << 19  # bytes of text that a task holds as word hashes at a time
MIN_DOCS = 3
#: (least share of the positives that hold a word, least z of the lift), strictest first.
SETTINGS = ((0.02, 8.0), (0.02, 5.0), (0.02, 3.0), (0.005, 8.0), (0.005, 5.0))
FOLDS = 3
STEPS, RATE, DECAY = 300, 0.1, 1e-4
DEFAULT_PRIOR = 0.1


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct folded words of every row, and the rows' offsets among them."""
    data, at = K.flat(texts)
    data = K.LOWER[data]
    s, e, rows = K.words(data, at, K.ALNUM)
    h, row = K.span_hashes(data, s, e), K.row_of(rows)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(at)))


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    prior: float

    def logits(self, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(rows) - 1, self.bias)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        w = np.where(self.words[at] == h, self.weights[at], 0.0)
        return self.bias + np.bincount(K.row_of(rows), weights=w, minlength=len(rows) - 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def telling(in_positives, in_all, positives: int, rows: int, min_docs: int, least_share: float, least_z: float):
    """Which words mark the positives: frequent enough there, and by far more than elsewhere
    (arrays or Columns of counts)."""
    rest = max(1, rows - positives)
    lift = in_positives / positives - (in_all - in_positives) / rest
    z = lift / ((in_all + 1) / rows / positives) ** 0.5
    return (z >= least_z) & (in_positives >= max(min(min_docs, positives), least_share * positives))


@dataclass
class Sample:
    """Texts as lists of word numbers: those of text i are ``cols[at[i]:at[i + 1]]``."""

    cols: np.ndarray
    at: np.ndarray
    positive: np.ndarray
    size: int

    def part(self, take: np.ndarray) -> Sample:
        row = K.row_of(self.at)
        sizes = np.diff(self.at)[take]
        return Sample(self.cols[take[row]], np.concatenate([[0], np.cumsum(sizes)]), self.positive[take], self.size)

    def telling(self, setting: tuple[float, float], min_docs: int) -> np.ndarray:
        """Which words tell, by the counts of these texts alone."""
        held = np.repeat(self.positive, np.diff(self.at))
        return telling(np.bincount(self.cols, weights=held, minlength=self.size), np.bincount(self.cols, minlength=self.size),
                       int(self.positive.sum()), len(self.positive), min_docs, *setting)

    def trained(self, kept: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
        """Weights of all words (0 for those not ``kept``) and the bias."""
        use = kept[self.cols]
        rows = np.concatenate([[0], np.cumsum(use)])[self.at]
        weights = np.zeros(self.size)
        weights[kept], bias = train((np.cumsum(kept) - 1)[self.cols[use]], rows, self.positive, int(kept.sum()), prior)
        return weights, bias

    def fitted(self, setting: tuple[float, float], min_docs: int, prior: float) -> tuple[np.ndarray, float]:
        return self.trained(self.telling(setting, min_docs), prior)

    def flagged(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(K.row_of(self.at), weights=weights[self.cols], minlength=len(self.positive)) >= 0


def fold_counts(sample: Sample, fold: np.ndarray, kept, prior: float) -> list[tuple[int, int, int, int, int, int]]:
    """(setting, fold, positives flagged, positives, others flagged, others) of every fold, under the
    model of the other folds; ``kept(i, f, inside)`` are the words of setting i without fold f."""
    out = []
    for f in range(FOLDS):
        inside, held = sample.part(fold != f), sample.part(fold == f)
        if not inside.positive.any() or not len(held.positive):
            continue
        for i in range(len(SETTINGS)):
            flagged = held.flagged(*inside.trained(kept(i, f, inside), prior))
            out.append((i, f, int(flagged[held.positive].sum()), int(held.positive.sum()),
                        int(flagged[~held.positive].sum()), int((~held.positive).sum())))
    return out


def best_setting(counts: list[tuple[int, int, int, int, int, int]], prior: float) -> int:
    """The setting of highest mean recall ** 2 / share predicted positive over the folds (ties: the first)."""
    values: dict[int, list[float]] = {}
    for i, _, hits, positives, others_hit, others in sorted(counts):
        if not positives:
            continue
        recall = hits / positives
        # rows are weighted as the prior has them, as the shards hold more positives than the corpus
        share = prior * recall + (1 - prior) * (others_hit / others if others else 0)
        values.setdefault(i, []).append(recall ** 2 / share if share else 0.0)
    best, found = -1.0, 0
    for i, value in values.items():
        if np.mean(value) > best + 1e-9:
            best, found = float(np.mean(value)), i
    return found


def chosen_setting(sample: Sample, fold: np.ndarray, min_docs: int, prior: float) -> tuple[float, float]:
    """``best_setting`` of one sample, with words told by its own counts."""
    counts = fold_counts(sample, fold, lambda i, f, inside: inside.telling(SETTINGS[i], min_docs), prior)
    return SETTINGS[best_setting(counts, prior)]


def train(cols: np.ndarray, rows: np.ndarray, positive: np.ndarray, size: int,
          prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam steps on the non-negative risk."""
    row = K.row_of(rows)
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(row, weights=w[cols], minlength=len(positive))
        p = _sigmoid(z)
        as_negative = np.logaddexp(0, z)
        rest = as_negative[~positive].sum() / n_u - prior * as_negative[positive].sum() / n_p
        up = np.where(positive, prior * (p - 1) / n_p, 0.0)  # gradient of pi * R_p(+)
        down = np.where(positive, -prior * p / n_p, p / n_u)  # gradient of R_u(-) - pi * R_p(-)
        g = up + down if rest >= 0 else -down
        grad = np.concatenate([np.bincount(cols, weights=g[row], minlength=size) + DECAY * w, [g.sum()]])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return w, float(b)


def _numbered(lists: pa.Array, known: np.ndarray, rows: int) -> pa.Array:
    """Lists of word hashes as numbers among the ``known`` (sorted); other words go."""
    h, row = lists.flatten().to_numpy().view(K.U), np.repeat(np.arange(rows), np.diff(lists.offsets.to_numpy()))
    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    use = known[at] == h if len(known) else np.zeros(len(h), bool)
    return K.lists(pa.array(at[use].astype(np.int32)), np.searchsorted(row[use], np.arange(rows + 1)))


def _tallied(rows: DataFrame, size: int) -> np.ndarray:
    """How many of ``rows`` (p, fold, words) hold each word, by [fold, positive, word]; a task sends one sum per word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * FOLDS * size, np.int64)
        for batch in batches:
            words = batch.column("words")
            side = 2 * batch.column("fold").to_numpy() + batch.column("p").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), np.diff(words.offsets.to_numpy()))
            total += np.bincount(side[row].astype(np.int64) * size + words.flatten().to_numpy(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    got = rows.select("p", "fold", "words").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * FOLDS * size, np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(FOLDS, 2, size)


def _sample(rows: pa.Table, size: int) -> Sample:
    lists = rows.column("words").combine_chunks()
    return Sample(lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py(),
                  rows.column("p").to_numpy().astype(bool), size)


def training_rows(docs: DataFrame, known: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """(p, d, fold, shard, text) of every row with a text; ``d`` is the text's digest."""
    # written: the planner knows how few they are
    toxic = settled(known.where("_y = 1").select("_k"), "toxicity-keys").withColumn("_p", F.lit(True))
    own = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("text")).where("text is not null")
    return own.join(toxic, "_k", "left").select(
        F.coalesce("_p", F.lit(False)).alias("p"), F.md5("text").alias("d"),
        F.pmod(F.xxhash64("text", F.lit(FOLDS)), F.lit(FOLDS)).cast("int").alias("fold"),
        F.pmod(F.xxhash64("text", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"), "text")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        shard: int = SHARD, min_docs: int = MIN_DOCS) -> Model:
    """Fit on the rows of ``docs``; ``labels`` holds (key, label) for some of them."""
    spark = docs.sparkSession
    known = (labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where("_k is not null")
             .groupBy("_k").agg(F.max("_y").alias("_y")))
    counted = docs.select(F.col(key).alias("_k")).join(known, "_k", "left").agg(
        F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg"),
        F.count_if(F.coalesce(F.col("_y"), F.lit(0)) != 1).alias("rest")).head()
    none = Model(np.zeros(0, K.U), np.zeros(0), -np.inf, 0.0)
    if not counted["pos"]:
        return none
    prior = counted["pos"] / (counted["pos"] + counted["neg"]) if counted["neg"] else DEFAULT_PRIOR
    prior = min(0.9, max(1e-4, prior))
    groups = -(-counted["pos"] // shard)
    shards = max(groups, -(-counted["rest"] // shard))
    chosen = training_rows(docs, known, key, text, shards)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text=0, max_bytes=SLICE):
            h, rows = distinct_words(batch.column(0))
            yield pa.RecordBatch.from_arrays([K.lists(K.as_long(h), rows)], names=["words"])

    one = settled(chosen.where("p").dropDuplicates(["d"]).select("text").mapInArrow(words_of, "words array<long>"), "toxicity-positives")
    positives = one.count()
    if not positives:
        return none
    loosest = [min(x) for x in zip(*SETTINGS)]
    counts = one.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    held_by_enough = counts.where(F.col("n") >= max(min(min_docs, positives), loosest[0] * positives))
    words = np.sort(held_by_enough.select("word").toArrow().column("word").to_numpy().astype(np.int64).view(K.U))
    shared = spark.sparkContext.broadcast(words)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text=4, max_bytes=SLICE):
            h, rows = distinct_words(batch.column(4))
            lists = _numbered(K.lists(K.as_long(h), rows), shared.value, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists], names=["p", "d", "fold", "shard", "words"])

    every = chosen.mapInArrow(numbered, "p boolean, d string, fold int, shard int, words array<int>")
    rows = settled(every.groupBy("p", "d", "fold", "shard").agg(F.any_value("words").alias("words")), "toxicity-rows")
    tally = _tallied(rows, len(words))
    sizes = np.zeros((FOLDS, 2), np.int64)
    for r in rows.groupBy("fold", "p").count().collect():
        sizes[r["fold"], int(r["p"])] = r["count"]

    def told(setting: tuple[float, float], without: int | None = None) -> np.ndarray:
        use = [f for f in range(FOLDS) if f != without]
        inside, n = tally[use].sum(axis=0), sizes[use].sum(axis=0)
        if not n[1]:
            return np.zeros(len(words), bool)
        return telling(inside[1], inside.sum(axis=0), int(n[1]), int(n.sum()), min_docs, *setting)

    wide = told(loosest)
    size, place = int(wide.sum()), np.where(wide, np.cumsum(wide) - 1, -1).astype(np.int32)
    masks = spark.sparkContext.broadcast((place, [[told(s, f)[wide] for f in range(FOLDS)] for s in SETTINGS]))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            row, at = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), masks.value[0][lists.flatten().to_numpy()]
            ends = np.searchsorted(row[at >= 0], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], K.lists(pa.array(at[at >= 0]), ends)],
                                             names=["p", "fold", "shard", "words"])

    few = rows.select("p", "fold", "shard", "words").mapInArrow(kept, "p boolean, fold int, shard int, words array<int>")
    own = F.when(F.col("p"), F.sequence(F.col("shard") % groups, F.lit(shards - 1), F.lit(groups))).otherwise(F.array("shard"))
    dealt = settled(few.select("p", "fold", "words", F.explode(own).alias("shard")).repartition(shards, "shard"), "toxicity-shards")
    by_shard = dealt.repartition(shards, "shard").groupBy("shard")

    def judged(part: pa.Table) -> pa.Table:
        found = fold_counts(_sample(part, size), part.column("fold").to_numpy(), lambda i, f, _: masks.value[1][i][f], prior)
        names = ["setting", "fold", "hits", "positives", "others_hit", "others"]
        return pa.table([pa.array([r[j] for r in found], pa.int64()) for j in range(len(names))], names=names)

    judgements = by_shard.applyInArrow(judged, "setting long, fold long, hits long, positives long, others_hit long, others long")
    sums = judgements.groupBy("setting", "fold").agg(*[F.sum(c).alias(c) for c in ("hits", "positives", "others_hit", "others")])
    telling_words = told(SETTINGS[best_setting([tuple(r) for r in sums.collect()], prior)])[wide]

    def fitted(part: pa.Table) -> pa.Table:
        sample = _sample(part, size)
        weights, bias = sample.trained(telling_words, prior) if sample.positive.any() else (np.zeros(0), None)
        at = np.flatnonzero(weights)
        word, weight = ([*at, -1], [*weights[at], bias]) if bias is not None else ([], [])
        return pa.table([pa.array(word, pa.int64()), pa.array(weight, pa.float64())], names=["word", "weight"])

    sums = by_shard.applyInArrow(fitted, "word long, weight double").groupBy("word").agg(
        F.sum("weight").alias("weight"), F.count("*").alias("n")).toArrow()
    found = {w: (total, n) for w, total, n in zip(*(sums.column(c).to_pylist() for c in ("word", "weight", "n")))}
    total, trained = found.pop(-1)
    at = np.array(sorted(found), np.int64)
    weights = np.array([found[i][0] for i in at]) / trained
    return Model(words[wide][at], weights, total / trained, prior)


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the model predicts toxic, columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text=place, max_bytes=SLICE):
            clean = shared.value.logits(*distinct_words(batch.column(place))) < 0
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, max_bytes=SLICE):
            p = _sigmoid(shared.value.logits(*distinct_words(batch.column(1))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                names=[key, "score", "predicted"])

    own = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("_text"))
    return own.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, predicted int")
