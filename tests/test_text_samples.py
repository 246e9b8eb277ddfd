"""Samples drawn, scored and fitted where the text is: against a row per sample."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.operators import explain as X
from glossa.operators import models as MO
from glossa.operators import text_samples as TS

LETTERS = "abcdefghijklmnopqrstuvwxyzé\U00010400_0123456789"


def words_of_all_lengths(rng, n):
    return ["".join(rng.choice(LETTERS) for _ in range(rng.choice([2, 3, 4, 5, 7, 8, 9, 12, 16, 31, 32, 33, 40, 70]))) for _ in range(n)]


@pytest.mark.parametrize("seed", [42, -3, 1 << 40])
def test_masks_are_those_of_the_perturbations(spark, seed):
    rng = random.Random(seed)
    docs = spark.createDataFrame([(i, " ".join(words_of_all_lengths(rng, 20 * i))) for i in range(1, 5)], "doc_id long, text string")
    rows = X.perturbations(docs, num_samples=12, seed=seed).withColumn("h", F.xxhash64("doc_id")).collect()
    for key in range(1, 5):
        own = sorted((r for r in rows if r["doc_id"] == key), key=lambda r: r["sample"])
        draw = TS.Draw(own[0]["h"], pa.array(own[0]["words"], pa.string()), 12, seed)
        got = np.concatenate([draw.kept(0, 5), draw.kept(5, 12)])
        assert np.array_equal(got, np.array([r["mask"] for r in own]))


@pytest.fixture
def texts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["good", "bad", "day", "x1", "x2", "x3", f"own{i}"]) for _ in range(rng.randrange(1, 40))))
            for i in range(12)]
    rows += [(20, ""), (21, None), (22, "good"), (22, "good"), (22, "good"), (23, "a &amp; b"), (None, "good day"), (24, "day day day")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def linear(spark, ngram_range, max_length=None):
    terms = [("good", 1.0, 3.0), ("bad", 1.5, -3.0), ("day", 1.2, 0.0), ("good day", 2.0, 1.0), ("bad x1", 2.0, -1.0), ("x1 x2 x3", 2.5, 0.7),
             ("x2 good", 1.1, 0.4), ("day", 1.0, 0.5), ("good  day", 9.0, 9.0), (None, 1.0, 1.0), ("x3", None, 1.0), ("x2", 1.0, None)]
    params = spark.createDataFrame(terms, "term string, idf double, coef double")
    return MO.LinearTextModel(params, 0.1, ngram_range=ngram_range, max_length=max_length)


def plain(rows):
    return sorted(((r["doc_id"], r["text"] or "", round(r["probability"], 9), r["decision"], [(t["token"], round(t["weight"], 7)) for t in r["tokens"]])
                   for r in rows), key=repr)


@pytest.mark.parametrize("ngram_range,max_length,flags", [((1, 1), None, 1 << 20), ((1, 2), None, 40), ((1, 3), 7, 100), ((2, 3), None, 1 << 20)])
def test_equal_to_a_row_per_sample(spark, texts, ngram_range, max_length, flags, monkeypatch):
    monkeypatch.setattr(TS, "FLAGS", flags)
    model = linear(spark, ngram_range, max_length)
    got = plain(X.explain(texts, model, num_samples=25).collect())
    monkeypatch.setattr(MO, "TABLE_TERMS", 0)
    want = plain(X.explain(texts, model, num_samples=25).collect())
    assert len(got) == 19 and [(r[0], r[2], r[3]) for r in got] == [(r[0], r[2], r[3]) for r in want]
    for one, two in zip(got, want):  # words without effect may swap places by the last digit
        assert [w for _, w in one[4]] == pytest.approx([w for _, w in two[4]], abs=1e-6)


def test_pairs_that_do_not_fit_a_table_of_cells(spark, texts, monkeypatch):
    model = linear(spark, (1, 3))
    table = MO.term_table(model)
    kept, at = np.random.default_rng(3).random((30, 6)) < 0.7, np.random.default_rng(4).integers(0, 6, 50)
    number = table.numbers(pa.array(["good", "day", "x1", "x2", "x3", "none"]))
    want = table.sums(kept, at, number)
    monkeypatch.setattr(TS, "CELLS", 0)
    assert np.allclose(table.sums(kept, at, number), want) and want[1].min() >= 0


def test_no_sample_is_a_row(spark, texts):
    plan = X.explain(texts, linear(spark, (1, 2)), num_samples=25)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "sequence(0" not in plan and plan.count("[explained(") == 1


def test_keys_of_several_texts_keep_their_joint_score(spark):
    docs = spark.createDataFrame([(1, "good day"), (1, "bad day"), (2, "good x1")], "doc_id long, text string")
    got = X.explain(docs, linear(spark, (1, 1)), num_samples=2).select("doc_id", "text", "probability").collect()
    joint = {r["text"]: r["probability"] for r in got if r["doc_id"] == 1}
    assert len(got) == 3 and joint["good day"] == joint["bad day"]
