"""Operator 8 learns from all rows."""
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glossa.llm import toxicity

from llm_helpers import by_row
from test_language_toxicity import toxic_corpus


def test_toxicity_learns_from_every_shard(spark):
    texts, truth, docs, labels = toxic_corpus(spark)
    doubled = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10 ** 6))  # copies of a text count once, if labelled alike
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    rows = {(t, d in toxic) for d, t in texts if t is not None} | {(t, False) for _, t in texts if t is not None}
    counts = Counter()
    for t, p in rows:
        counts.update((int(h), p) for h in toxicity.distinct_words(pa.array([t]))[0])
    words = sorted({h for h, _ in counts})
    own, every = (np.array([sum(counts[h, p] for p in side) for h in words]) for side in ((True,), (True, False)))
    positives = sum(p for _, p in rows)
    found = [{h for h, k in zip(words, toxicity.telling(own, every, positives, len(rows), toxicity.MIN_DOCS, *s)) if k}
             for s in toxicity.SETTINGS]
    for shard in (40, 10 ** 6):
        model = toxicity.fit(doubled, labels, shard=shard)
        assert set(model.words.tolist()) in found
        got = by_row(toxicity.score(docs, model))
        assert np.mean([got[i][0]["predicted"] == truth[i] for i, _ in texts]) > 0.97


def test_shards_hold_every_row_once_and_positives_in_each(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    known = spark.createDataFrame([(i, int(i < 90)) for i in range(200)], "_k long, _y int")
    rows = toxicity.training_rows(docs, known, "doc_id", "text", 9)
    assert rows.count() == 900 and rows.where("p").count() == 90
    sizes = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}
    assert set(sizes) == set(range(9)) and max(sizes.values()) < 200
