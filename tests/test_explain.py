"""The surrogate from packed masks against the plain weighted ridge."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import explain as X
from glossa.operators import models as MO


def plain(masks, y):
    kept, d = masks.sum(axis=1), masks.shape[1]
    sw = np.sqrt(np.exp(-(((1 - np.sqrt(kept / d)) * 100) ** 2) / X.KERNEL_WIDTH ** 2))
    xm, ym, r = sw @ masks / sw.sum(), sw @ y / sw.sum(), np.sqrt(sw)
    A, b = (masks - xm) * r[:, None], (y - ym) * r
    return np.linalg.solve(A.T @ A + X.RIDGE_ALPHA * np.eye(d), A.T @ b)


def pack(masks):
    n, d = masks.shape
    wide = np.zeros((n, -(-d // 64) * 64), np.uint8)
    wide[:, :d] = masks
    return np.packbits(wide, axis=1, bitorder="little").view(np.int64)


@pytest.mark.parametrize("words", [1, 3, 63, 64, 65, 130, 700])
@pytest.mark.parametrize("block", [64, 4096])
def test_weights_equal_the_plain_fit(words, block, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", block)
    rng = np.random.default_rng(words)
    masks = (rng.random((200, words)) < 0.6).astype(np.float64)
    masks[0] = 1
    y = rng.random(200)
    assert np.allclose(X.surrogate(pack(masks), words, y), plain(masks, y), atol=1e-9)


@pytest.mark.parametrize("words", [1, 64, 65, 200])
def test_masks_are_packed_in_order(spark, words):
    rng = random.Random(words)
    flags = [rng.random() < 0.5 for _ in range(words)]
    got = spark.createDataFrame([(flags,)], "mask array<boolean>").select(X.packed("mask")).first()[0]
    assert np.array_equal(X._unpacked(np.array([got], np.int64), words)[0], np.array(flags, float))


def test_a_text_of_many_words(spark):
    """100,000 distinct words: masks of all samples are 2.5 MB of bits."""
    rng = np.random.default_rng(1)
    bits = rng.integers(-(1 << 62), 1 << 62, size=(200, 100_000 // 64 + 1), dtype=np.int64)
    bits[:, -1] &= (1 << (100_000 % 64)) - 1
    bits[0, :-1], bits[0, -1] = -1, (1 << (100_000 % 64)) - 1
    y = rng.random(200)
    got = X.surrogate(bits, 100_000, y)
    assert len(got) == 100_000 and np.isfinite(got).all() and np.abs(got).max() > 0


def test_explained_documents(spark):
    params = spark.createDataFrame([("good", 1.0, 3.0), ("bad", 1.0, -3.0), ("day", 1.0, 0.0)], "term string, idf double, coef double")
    model = MO.LinearTextModel(params, 0.1, ngram_range=(1, 1))
    docs = spark.createDataFrame([(1, "good day today"), (2, "bad day " + " ".join(f"x{i}" for i in range(90))), (3, ""), (4, None)],
                                 "doc_id long, text string")
    got = {r["doc_id"]: r for r in X.explain(docs, model, num_samples=100).collect()}
    assert got[1]["tokens"][0]["token"] == "good" and got[1]["tokens"][0]["weight"] > 0
    assert got[2]["tokens"][0]["token"] == "bad" and got[2]["tokens"][0]["weight"] < 0
    assert list(got[3]["tokens"]) == list(got[4]["tokens"]) == []
    samples = X.perturbations(docs, num_samples=20).where("doc_id = 1")
    assert samples.where("sample = 0").select(F.forall("mask", lambda m: m)).first()[0] is True
    assert samples.where("sample > 0 and size(kept_tokens) >= 3").count() == 0
