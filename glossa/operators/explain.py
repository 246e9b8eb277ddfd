"""Per-token explanations of a text model (L1–L5), after the local
surrogate method of Ribeiro, Singh & Guestrin (KDD 2016).

For each document: ``num_samples`` word-removal perturbations (sample 0 is
the intact text), each scored by the same relational scorer as production,
weighted by an exponential kernel on the cosine distance of the kept-word mask
to the intact text, and fitted with a weighted ridge surrogate per document
(``applyInPandas``; the group is one document's samples).  Masks travel as bits, 64 words
to a long; the surrogate is solved in the space of the samples, whose inner products are
popcounts, and masks are unpacked ``BLOCK`` words at a time.  Masks are drawn from
``xxhash64(doc, sample, word, seed)``, so they do not depend on partitioning.

A linear model whose terms are few enough to hold (``MO.TABLE_TERMS``) scores the samples of a text where
the text is: texts are dealt once, and one Arrow step draws the masks, scores and fits (``text_samples``),
so no sample becomes a row.  Any other scorer gets every sample as a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.config import settings
from glossa.operators import features as FE
from glossa.operators import models as MO
from glossa.operators import text_samples as TS
from glossa.operators.scorers import LinearScorer, Scorer
from glossa.schemas import TOKEN_WEIGHT
from glossa.session import materialized

# Surrogate parameters (kernel width, ridge penalty).
KERNEL_WIDTH = 25.0
RIDGE_ALPHA = 1.0
PACKED_FLAGS = 1 << 20  # flags that a task packs at a time, about
BLOCK = 4096  # words whose masks are unpacked at a time, a multiple of 64


def perturbations(
    df: DataFrame, key: str = "doc_id", text: str = "text", num_samples: int = settings.explain_samples,
    seed: int = settings.random_seed, clean: dict | None = None,
) -> DataFrame:
    """L1: ``(key, sample, words, kept_tokens, mask)``; sample 0 keeps everything."""
    base = df.select(key, FE.doc_tokens(df, text, clean).alias("_tok"))
    base = base.select(key, "_tok", F.array_distinct("_tok").alias("words"))
    s = base.select(key, "_tok", "words", F.explode(F.sequence(F.lit(0), F.lit(num_samples - 1))).alias("sample"))
    d = F.size("words")
    # number of words to remove, uniform in [1, d] (0 for the intact sample)
    k = F.when((F.col("sample") == 0) | (d < 1), F.lit(0)).otherwise(
        1 + F.pmod(F.xxhash64(F.col(key), F.col("sample"), F.lit(seed)), F.greatest(d, F.lit(1))))
    s = s.withColumn("_k", k.cast("int")).withColumn(
        "_hs", F.sort_array(F.transform("words", lambda w: F.xxhash64(F.col(key), F.col("sample"), w, F.lit(seed)))))
    s = s.withColumn("_thr", F.when(F.col("_k") > 0, F.element_at("_hs", F.col("_k"))))
    kept = lambda w: F.col("_thr").isNull() | (F.xxhash64(F.col(key), F.col("sample"), w, F.lit(seed)) > F.col("_thr"))
    s = s.withColumn("kept_tokens", F.filter("_tok", kept)).withColumn("mask", F.transform("words", kept))
    return s.select(key, "sample", "words", "kept_tokens", "mask")


def proximity(kept: Column, words: Column) -> Column:
    """L3: weight of a sample that keeps ``kept`` of ``words`` distinct words: an exponential kernel on the
    cosine distance (in percent) of its mask to the intact one."""
    distance = (F.lit(1.0) - F.sqrt(kept / words)) * 100.0
    return F.sqrt(F.exp(-(distance * distance) / (KERNEL_WIDTH * KERNEL_WIDTH)))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _packed(masks: pa.Array) -> pa.Array:
    ends, parts, start = masks.offsets.to_numpy().astype(np.int64), [np.zeros(0, np.int64)], 0
    longs = np.maximum(-(-np.diff(ends) // 64), 1)
    while start < len(masks):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + PACKED_FLAGS, "right")) - 1)
        sizes, at = np.diff(ends[start:stop + 1]), np.concatenate([[0], np.cumsum(longs[start:stop])])
        place = np.arange(ends[stop] - ends[start]) + np.repeat(at[:-1] * 64 - (ends[start:stop] - ends[start]), sizes)
        flags = np.zeros(at[-1] * 64, np.uint8)
        flags[place] = masks.slice(start, stop - start).flatten().to_numpy(zero_copy_only=False)
        parts.append(np.packbits(flags, bitorder="little").view(np.int64))
        start = stop
    offsets = np.concatenate([[0], np.cumsum(longs)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))


def packed(mask: str) -> Column:
    """A boolean array as longs of 64 flags, the first flag in the lowest bit; packed in Arrow batches,
    ``PACKED_FLAGS`` flags at a time."""
    return _packed(F.coalesce(F.col(mask), F.array().cast("array<boolean>")))


def _unpacked(bits: np.ndarray, words: int) -> np.ndarray:
    """(samples, words) flags of packed rows."""
    flags = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little")
    return flags[:, :words].astype(np.float64)


def surrogate(bits: np.ndarray, words: int, y: np.ndarray, copies: int = 1) -> np.ndarray:
    """Weights of the words in a weighted ridge fit of ``y`` on the masks ``bits`` (samples x longs), each
    sample taken ``copies`` times.

    The dual form needs the samples' inner products, and each word's weight is a sum over samples;
    so nothing of size samples x words is held."""
    n, step = len(y), BLOCK // 64
    blocks = [(i, bits[:, i:i + step]) for i in range(0, bits.shape[1], step)]
    inner = np.zeros((n, n))
    for i, part in blocks:
        # products of a block are counts below 2 ** 24: exact in single precision
        X = _unpacked(part, min(words - i * 64, BLOCK)).astype(np.float32)
        inner += X @ X.T
    dist = (1.0 - np.sqrt(np.diag(inner) / words)) * 100.0
    sw = copies * np.sqrt(np.exp(-(dist ** 2) / KERNEL_WIDTH ** 2))
    total, root = sw.sum(), np.sqrt(sw)
    # the weighted mean mask is sw @ X / total, so its products follow from the samples' own
    with_mean = inner @ sw / total
    centred = inner - with_mean[:, None] - with_mean[None, :] + sw @ with_mean / total
    gram = centred * root[:, None] * root[None, :] + RIDGE_ALPHA * np.eye(n)
    alpha = root * np.linalg.solve(gram, (y - sw @ y / total) * root)
    out = np.empty(words)
    for i, part in blocks:
        at = slice(i * 64, min(words, (i + step) * 64))
        X = _unpacked(part, at.stop - at.start)
        out[at] = alpha @ X - alpha.sum() * (sw @ X / total)
    return out


def _strongest(words: list[str], coef: np.ndarray, num_features: int) -> list[tuple[str, float]]:
    """The ``num_features`` words of largest absolute weight (ties: by word), in that order."""
    largest = np.argpartition(-np.abs(coef), min(num_features, len(words)) - 1)[:num_features]
    near = np.flatnonzero(np.abs(coef) >= np.abs(coef[largest]).min())  # with all ties of the last
    order = sorted(near.tolist(), key=lambda i: (-abs(coef[i]), words[i]))[:num_features]
    return [(words[i], float(coef[i])) for i in order]


def _surrogate_fn(key: str, num_features: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample")
        words = list(pdf["words"].iloc[0])
        bits = np.stack([np.asarray(m, dtype=np.int64) for m in pdf["mask"]])
        coef = surrogate(bits, len(words), pdf["probability"].to_numpy(dtype=np.float64))
        best = _strongest(words, coef, num_features)
        return pd.DataFrame({key: pdf[key].iloc[0], "token": [w for w, _ in best], "weight": [x for _, x in best]})

    return fit


def _of_rows(
    df: DataFrame, scorer: Scorer, key: str, text: str, num_samples: int, num_features: int, seed: int,
) -> DataFrame:
    """(key, text, probability, tokens): every sample is a row, scored by the scorer; a group is a document."""
    clean = scorer.model.clean if isinstance(scorer, LinearScorer) else None
    pert = perturbations(df, key, text, num_samples, seed, clean)
    if isinstance(scorer, LinearScorer):
        scored = scorer.score_tokens(pert.select(key, "sample", "kept_tokens"), "kept_tokens", [key, "sample"])
    else:
        kept = pert.select(key, "sample", F.array_join("kept_tokens", " ").alias("_kept"))
        scored = scorer.score(kept, "_kept", [key, "sample"])
    # the words travel once, with the intact sample; the others carry their masks only
    words = F.when(F.col("sample") == 0, F.col("words")).alias("words")
    joined = pert.where(F.size("words") > 0).select(key, "sample", words, packed("mask").alias("mask")).join(scored, [key, "sample"])
    key_type = df.schema[key].dataType
    out_schema = T.StructType([T.StructField(key, key_type), T.StructField("token", T.StringType()),
                               T.StructField("weight", T.DoubleType())])
    # a text without tokens has nothing to weigh: the left join below gives it an empty list
    weights = joined.groupBy(key).applyInPandas(_surrogate_fn(key, num_features), out_schema)
    tokens = weights.groupBy(key).agg(
        MO.sort_token_weights(F.collect_list(F.struct("token", "weight").cast(TOKEN_WEIGHT))).alias("tokens"))
    intact = scored.where(F.col("sample") == 0).select(key, "probability")
    return df.select(key, text).join(intact, key).join(tokens, key, "left").withColumn(
        "tokens", F.coalesce("tokens", F.array().cast(T.ArrayType(TOKEN_WEIGHT))))


def _explainer(table, intercept: float, num_samples: int, num_features: int, seed: int):
    """The Arrow step of ``_of_texts``: (hash of the key, tokens, copies of the row) -> (probability, tokens)."""

    def one(words: pa.Array, number: np.ndarray, at: np.ndarray, hashed_key: int, copies: int):
        draw = TS.Draw(hashed_key, words, num_samples, seed)
        bits = np.zeros((num_samples, -(-len(words) // 64) * 8), np.uint8)
        dot, square = np.empty(num_samples), np.empty(num_samples)
        step = max(1, TS.FLAGS // len(at))
        for i in range(0, num_samples, step):
            kept = draw.kept(i, min(num_samples, i + step))
            own = slice(i, i + len(kept))
            dot[own], square[own] = table.value.sums(kept, at, number)
            raw = np.packbits(kept, axis=1, bitorder="little")
            bits[own, :raw.shape[1]] = raw
        # rows of one key are scored together: a row that comes ``copies`` times adds its terms as often
        z = np.divide(copies * dot, np.sqrt(copies * square), out=np.zeros(num_samples), where=square > 0) + intercept
        y = 1.0 / (1.0 + np.exp(-z))
        return float(y[0]), _strongest(words.to_pylist(), surrogate(bits.view(np.int64), len(words), y, copies), num_features)

    @F.arrow_udf(T.StructType([T.StructField("probability", T.DoubleType()), T.StructField("tokens", T.ArrayType(TOKEN_WEIGHT))]))
    def explained(hashed: pa.Array, tokens: pa.Array, copies: pa.Array) -> pa.Array:
        words, texts = TS.distinct_tokens(tokens)
        number = table.value.numbers(words)
        none = 1.0 / (1.0 + float(np.exp(-intercept)))
        probability, ends, best = [], [0], []
        for (own, at), hashed_key, n in zip(texts, hashed.to_pylist(), copies.to_pylist()):
            p, found = one(words.take(pa.array(own)), number[own], at, hashed_key, n) if len(own) else (none, [])
            probability.append(p)
            best += found
            ends.append(len(best))
        pairs = pa.StructArray.from_arrays([pa.array([w for w, _ in best], pa.string()), pa.array([x for _, x in best], pa.float64())],
                                           names=["token", "weight"])
        return pa.StructArray.from_arrays([pa.array(probability, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)],
                                          names=["probability", "tokens"])

    return explained


def _of_texts(
    df: DataFrame, model: MO.LinearTextModel, table: TS.TermTable, key: str, text: str, num_samples: int, num_features: int, seed: int,
) -> DataFrame:
    """(key, text, probability, tokens) of rows whose key names one text, as ``_of_rows`` gives them: texts are
    dealt by key, and a row that comes several times is explained once."""
    spark = df.sparkSession
    step = _explainer(spark.sparkContext.broadcast(table), MO.intercept_value(model), num_samples, num_features, seed)
    own = df.select(key, text).where(F.col(key).isNotNull()).repartition(key)
    own = own.groupBy(key, text).agg(F.count(F.lit(1)).alias("_m"))
    tokens = F.coalesce(FE.doc_tokens(own, text, model.clean), F.array().cast("array<string>"))
    out = own.select(key, text, "_m", step(F.xxhash64(key), tokens, "_m").alias("_e"))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("_m").cast("int")))
    return out.select(key, text, "_e", copies.alias("_c")).select(key, text, "_e.probability", "_e.tokens")


def explain(
    df: DataFrame, model: MO.LinearTextModel | Scorer, key: str = "doc_id", text: str = "text",
    num_samples: int = settings.explain_samples, num_features: int = settings.explain_features,
    seed: int = settings.random_seed,
) -> DataFrame:
    """``key, text, probability, decision, threshold, tokens, model_version``.

    ``tokens`` is array<struct<token, weight>> sorted by |weight| descending.  Any scorer
    can be explained; one that is not linear gets the kept words joined by spaces.  Rows of one
    key are scored together."""
    scorer = LinearScorer(model) if isinstance(model, MO.LinearTextModel) else model
    table = MO.term_table(scorer.model) if isinstance(scorer, LinearScorer) else None
    options = (key, text, num_samples, num_features, seed)
    if table is None:
        res = _of_rows(df, scorer, *options)
    else:
        digest = F.xxhash64(text)
        several = materialized(df.groupBy(key).agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where(
            F.col(key).isNotNull() & (F.col("a") != F.col("b"))).select(key), "keys-of-several-texts")
        if several.isEmpty():
            res = _of_texts(df, scorer.model, table, *options)
        else:
            res = _of_texts(df.join(several, key, "left_anti"), scorer.model, table, *options).unionByName(
                _of_rows(df.join(several, key, "left_semi"), scorer, *options))
    return MO.with_decision(res, scorer).select(key, text, "probability", "decision", "threshold",
                                               "tokens", "model_version")
