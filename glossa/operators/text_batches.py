"""Mini-batched scoring of texts of any length (P5, F7): two ragged inputs, token ids and a mask.

A text becomes at most ``max_length`` token ids in the JVM.  Texts are dealt by length into
buckets, padded to the bucket's length, written once partitioned by bucket, and each bucket goes
through ``predict_batch_udf`` with its own fixed shapes; so a short text is not padded to the
longest one's length.  Empty and NULL texts have an all-zero mask.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.operators import features as FE
from glossa.session import scratch_path

BUCKETS = (16, 32, 64, 128)


def token_ids(tokens: Column | str, vocabulary: int) -> Column:
    """Hashed token ids in [0, vocabulary)."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.transform(t, lambda x: F.pmod(F.xxhash64(x), F.lit(vocabulary)).cast("int"))


def padded(ids: str, length: int) -> tuple[Column, Column]:
    """``ids`` and their mask, both with ``length`` places."""
    n = F.size(ids)
    fill = F.greatest(F.lit(length) - n, F.lit(0))
    zeros, ones = F.array_repeat(F.lit(0), fill), F.array_repeat(F.lit(1), n)
    return F.concat(ids, zeros), F.concat(ones, zeros)


def score_text_batches(
    df: DataFrame, make_predict_fn: Callable, key: str = "doc_id", text: str = "text", vocabulary: int = 1 << 15,
    max_length: int | None = None, buckets: Sequence[int] = BUCKETS, batch_size: int = 32, clean: dict | None = None,
) -> DataFrame:
    """(key, n_tokens, probability) of every row.  ``make_predict_fn`` runs once per Python worker and
    returns ``predict(ids, mask)`` over two (rows, length) arrays.  Texts are cut at ``max_length``
    tokens, by default the largest bucket (F7)."""
    buckets = sorted(buckets)
    longest = min(max_length or buckets[-1], buckets[-1])
    tokens = F.coalesce(FE.doc_tokens(df, text, clean, longest), F.array().cast("array<string>"))
    ids = df.select(key, tokens.alias("t")).select(key, token_ids("t", vocabulary).alias("ids"))
    size = reduce(lambda rest, b: F.when(F.size("ids") <= b, b).otherwise(rest), reversed(buckets[:-1]), F.lit(buckets[-1]))
    path = scratch_path(df.sparkSession, "text-batches")
    ids.withColumn("bucket", size).write.partitionBy("bucket").parquet(path)
    schema = T.StructType([*ids.schema.fields, T.StructField("bucket", T.IntegerType())])
    stored = df.sparkSession.read.schema(schema).parquet(path)

    def scored(length: int) -> DataFrame:
        predict = predict_batch_udf(make_predict_fn, return_type=T.DoubleType(), batch_size=batch_size,
                                    input_tensor_shapes=[[length], [length]])
        own, mask = padded("ids", length)
        part = stored.where(F.col("bucket") == length).select(key, F.size("ids").cast("bigint").alias("n_tokens"),
                                                              own.alias("own"), mask.alias("mask"))
        return part.select(key, "n_tokens", predict("own", "mask").alias("probability"))

    return reduce(DataFrame.unionByName, map(scored, buckets))


def mean_weight_factory(weights: Sequence[float], intercept: float):
    """Factory of a bag-of-tokens scorer: the logistic of the mean weight of the tokens (softmax of
    two logits); a text without tokens scores the intercept alone."""
    table, b = [float(w) for w in weights], float(intercept)

    def make():
        import numpy as np

        own = np.asarray(table)

        def predict(ids, mask):
            m = np.asarray(mask, dtype=np.float64)
            total = (own[np.asarray(ids, dtype=np.int64)] * m).sum(axis=1)
            z = total / np.maximum(m.sum(axis=1), 1.0) + b
            logits = np.stack([np.zeros_like(z), z], axis=1)
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            return (e / e.sum(axis=1, keepdims=True))[:, 1]

        return predict

    return make


def mean_weight_score(tokens: Column, weights: Sequence[float], intercept: float) -> Column:
    """The same score as an expression in the JVM."""
    table = F.lit([float(w) for w in weights])
    ids = token_ids(tokens, len(weights))
    total = F.aggregate(ids, F.lit(0.0), lambda s, i: s + F.get(table, i))
    z = total / F.greatest(F.size(tokens), F.lit(1)) + F.lit(float(intercept))
    return 1.0 / (1.0 + F.exp(-z))
